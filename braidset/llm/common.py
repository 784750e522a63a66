"""Small helpers that several operators share."""

from __future__ import annotations

import sys
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word of the contracts, for Spark and for Python.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, across tasks."""
    return vars(sys).setdefault("_llm_cache", {})


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset (tests), a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    root = root or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="llm-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` into the shared folder once and go on from the files."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def identified(docs: DataFrame, tag: str, rows: Column | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a column that no two rows share, and its name, which no column of ``docs`` has.

    Rows are told apart by it whatever their keys are: null, repeated, or the same in every column. ``rows`` may
    give it (``file_rows``); else ``docs`` is written once with a number for each row.
    """
    name = "_row"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    if rows is not None:
        return docs.withColumn(name, rows), name
    return written(docs.withColumn(name, F.monotonically_increasing_id()), tag), name


def file_rows(docs: DataFrame) -> Column | None:
    """File and row number of every row of a table as it is read from Parquet files; None for any other table.

    Behind a join or a generator two rows may come from one row of a file, so the plan must be the read itself.
    """
    plan = docs._jdf.queryExecution().analyzed()
    if plan.nodeName() != "LogicalRelation" or not plan.toString().rstrip().endswith("parquet"):
        return None
    at = docs.metadataColumn("_metadata")
    return F.struct(at["file_path"].alias("file"), at["row_index"].alias("at"))


def key_crc(key: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids count as the text 'null'."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")) % F.lit(mod)


def crc_words(buffer) -> int:
    return zlib.crc32(buffer)
