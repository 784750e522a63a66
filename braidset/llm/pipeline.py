"""Stages of the corpus pipeline: each applies one operator and lets its decisions take effect.

All stages take null, empty and very long texts, null and repeated ids, rows that are equal in every column, and no
rows at all, as their operators state. Rows of a table read from files are told apart by their place there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidset.llm import mixing, packing, pii, simhash, toxicity
from braidset.llm.common import file_rows, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. Learnt from the labelled rows of ``docs`` that are not held out."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.keep_civil(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, that of the least id."""
    return simhash.keep_one(docs, rows=file_rows(docs))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; lengths follow the text."""
    out = pii.redact(docs, pii.train(docs))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them; lengths follow the text."""
    out = mixing.apply_mix(docs, rows=file_rows(docs))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in their sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids."""
    return packing.digests(packing.pack(docs), keep_ids=True)
