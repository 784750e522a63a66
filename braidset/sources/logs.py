"""Result logs in runs that are committed whole, so that a repeated run neither doubles nor loses rows.

An append writes files below ``run=<name>/attempt=<n>`` and then one line to the manifest beside them. Readers take
the last attempt in the manifest of each run: until that line is there they see the attempt before, and files
without a line are nobody's.
"""

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST = "_manifest"
_RUN = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def committed(spark: SparkSession, root: str) -> DataFrame | None:
    """``run, attempt`` that count, or None where there is no manifest."""
    try:
        lines = spark.read.schema("run string, attempt int").json(f"{root.rstrip('/')}/{MANIFEST}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return lines.groupBy("run").agg(F.max("attempt").alias("attempt"))


def append_run(writer_of, df: DataFrame, root: str, run: str | None = None) -> str:
    """Write ``df`` as the next attempt of ``run`` (by default a run of its own) and commit it. Returns the run's name.

    ``writer_of(df)`` gives a writer with its format and folders set. Attempts of one run follow each other; runs are
    independent.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    run = run or uuid.uuid4().hex
    if not _RUN.fullmatch(run):
        raise ValueError(f"a run is named by letters, digits, dots and dashes, not {run!r}")
    have = committed(spark, root)
    last = have.where(F.col("run") == run).first() if have is not None else None
    attempt = last.attempt + 1 if last else 0
    # What a broken try of this attempt left is replaced.
    writer_of(df).mode("overwrite").save(f"{root}/run={run}/attempt={attempt}")
    line = spark.createDataFrame([(run, attempt)], "run string, attempt int")
    line.coalesce(1).write.mode("append").json(f"{root}/{MANIFEST}")
    return run


def only_committed(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """Of ``files`` (with ``path``) those of committed attempts, and those that belong to no run."""
    have = committed(spark, root)
    if have is None:
        return files
    part = lambda name: F.regexp_extract("path", rf"/{name}=([^/]+)/", 1)
    placed = files.withColumns({"_run": part("run"), "_attempt": part("attempt").try_cast("int")})
    valid = have.select(F.col("run").alias("_run"), F.col("attempt").alias("_last"))
    joined = placed.join(valid, "_run", "left")
    return joined.where((F.col("_run") == "") | (F.col("_attempt") == F.col("_last"))).drop("_run", "_attempt", "_last")
