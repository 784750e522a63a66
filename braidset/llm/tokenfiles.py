"""Token ids in Parquet: list columns, dictionary or delta encoded, in controlled row groups and pages."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidset.llm import tokens

FIELDS = "row long, doc_id long, local_start long, n_tokens long, ids array<int>"


def _encode(path: str, end: int):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        enc, row, start = tokens.encoder(path), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                ids, counts = enc.encode_all(texts, end)
                ends = counts.cumsum()
                offsets = pa.array([0, *ends.tolist()], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(row, row + len(texts)), pa.int64()),
                        part.column(0),
                        pa.array(start + ends - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                    ],
                    schema=schema,
                )
                row += len(texts)
                start += int(ends[-1]) if len(ends) else 0

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end: int = 2,
    row_group_mb: int = 32,
    page_kb: int = 256,
    key: str = "doc_id",
    text: str = "text",
) -> None:
    """Write the ids of every whole text, ``end`` after each, in ascending order of the key.

    The table has a folder per ``shard``, a range of keys; shards follow each other in key order,
    and ``row`` counts in each. Columns: doc_id, n_tokens, local_start (ids before it in its shard)
    and ids. Ids use a dictionary (it holds the whole vocabulary), the narrow columns delta
    encoding. Row groups bound a reader's memory; pages with column indexes let it skip to a few
    documents, and the narrow columns are read without the ids.

    Null texts are empty; a document of no ids has ``end`` alone. Null keys come first; repeated
    keys stay, ordered by a hash of the text. An empty table gives a table of no rows. Other columns play no part.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # The texts are dealt and sorted before they are encoded: the sampling pass costs a scan only. Rows of
    # one key, or of none, are dealt by their texts, so that no task gets all of them.
    first, tie = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    dealt = rows.repartitionByRange(first, tie).sortWithinPartitions(first, tie, "text")
    encoded = dealt.mapInArrow(_encode(tokenizer or tokens.default_path(), end), FIELDS).withColumn("shard", F.spark_partition_id())
    (
        encoded.write.mode("errorifexists")
        .partitionBy("shard")
        .option("compression", "zstd")
        .option("parquet.block.size", row_group_mb << 20)
        .option("parquet.page.size", page_kb << 10)
        .option("parquet.page.row.count.limit", 2000)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#row", "false")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#local_start", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a token table: shard, row, doc_id, local_start, n_tokens, ids. Select columns to read only those."""
    return spark.read.schema(FIELDS + ", shard int").parquet(path)


def starts(table: DataFrame) -> DataFrame:
    """``start`` (ids of all documents before it in the table) added; it reads narrow columns only."""
    per = table.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    # One row per shard, and shards are no more than spark.sql.shuffle.partitions: a bounded broadcast.
    before = F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("shard", F.coalesce(before, F.lit(0)).alias("_before"))
    return table.join(F.broadcast(per), "shard").withColumn("start", F.col("_before") + F.col("local_start")).drop("_before")


def _crc(batches):
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(table: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens and the crc32 of its ids as little-endian 32-bit integers."""
    rows = starts(table).select("doc_id", "start", "n_tokens", "ids")
    return rows.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
