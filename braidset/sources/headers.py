"""Column names of files as a table, read in tasks from the first bytes of each file.

Listings come from Spark; neither paths nor names pass through the driver. A file costs one block
to ask, whatever its size: the first record of a CSV file, the footer of a Parquet file.
"""

import csv
import io
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of one look into a file.
BLOCK = 64 * 1024
#: Schemes that tasks can open by themselves; files elsewhere are read through Spark.
_OPENED = {"file": "file", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "abfs": "abfs", "abfss": "abfss"}


def listed(spark: SparkSession, path, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """``path, bytes`` of the files at ``path`` (one or a list); contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("bytes"))


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest:
        return pafs.LocalFileSystem(), unquote("/" + rest.lstrip("/")) if rest else path
    return pafs.FileSystem.from_uri(f"{_OPENED[scheme]}:{rest}")


def first_record(stream) -> str | None:
    """The first CSV record of a stream: up to the first line break outside quotes. None for an empty file."""
    text = b""
    while True:
        block = stream.read(BLOCK)
        text += block
        at = -1
        while (at := text.find(b"\n", at + 1)) >= 0:
            if text.count(b'"', 0, at) % 2 == 0:
                return text[:at].decode("utf-8-sig", "replace")
        if not block:
            return text.decode("utf-8-sig", "replace") if text else None


def record_names(record: str | None) -> list[str]:
    rows = list(csv.reader(io.StringIO(record or "")))
    return [name.strip() for name in rows[0]] if rows else []


def _names(fmt: str):
    def of(path: str) -> list[str]:
        fs, at = _located(path)
        if fmt == "parquet":
            with fs.open_input_file(at) as file:
                return pq.read_schema(file).names
        with fs.open_input_stream(at, compression="detect", buffer_size=BLOCK) as stream:
            return record_names(first_record(stream))

    def run(batches):
        for batch in batches:
            paths = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(p) for p in paths], pa.list_(pa.string()))], names=["path", "columns"])

    return run


def _through_spark(spark: SparkSession, files: DataFrame, path, recursive: bool) -> DataFrame:
    """The names of CSV files that only Spark can open: their text, of which a task passes on one line a file."""
    lines = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    first = lines.mapInArrow(_first_lines, "path string, columns array<string>")
    return files.select("path").join(first, "path")


def _first_lines(batches):
    """Lines come in order, and a file's first block starts at zero."""
    seen = set()
    for batch in batches:
        found = []
        for path, start, line in zip(*(c.to_pylist() for c in batch.columns)):
            if start == 0 and path not in seen:
                seen.add(path)
                found.append((path, record_names(line.removeprefix("﻿"))))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found]), pa.array([n for _, n in found], pa.list_(pa.string()))], names=["path", "columns"])


def header_table(files: DataFrame, path, fmt: str = "csv", recursive: bool = False) -> DataFrame:
    """``path, columns`` of every file in ``files`` (from ``listed``); ``path`` is where they were listed."""
    spark = files.sparkSession
    one = files.select("path").first()
    if one and one.path.partition(":")[0] not in _OPENED and fmt == "csv":
        return _through_spark(spark, files, path, recursive)
    # Each file is a small request: spread them over all cores, not by their sizes.
    parts = spark.sparkContext.defaultParallelism
    return files.select("path").repartition(parts, "path").mapInArrow(_names(fmt), "path string, columns array<string>")
