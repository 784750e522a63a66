"""The corpus pipeline: toxicity, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and is written as Parquet and read again for the next.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidset.llm import pipeline
from braidset.llm.common import shared_path, table

STAGES = [
    ("toxicity", pipeline.drop_toxic),
    ("near_copies", pipeline.drop_near_copies),
    ("pii", pipeline.redact_pii),
    ("mixing", pipeline.mix_sources),
    ("packing", pipeline.pack_sequences),
]

#: SQL can't express a factorization machine, a conditional random field or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
