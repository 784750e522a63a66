"""Writers for samples, splits, result logs, documents and summaries."""

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from braidset import schemas
from braidset.operators.combine import as_text_columns
from braidset.operators.curate import type_documents
from braidset.operators.score import export_view
from braidset.sources.logs import append_run


# Without the last two the writer would trim texts.
CSV_WRITE_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


# Rows of one file. Records with line breaks can only be read from a file's start, so that a file is one task's work:
# this keeps it to some 100 MB of narrow rows (logs) or of texts.
LOG_ROWS = 250_000
TEXT_ROWS = 10_000


def _writer(df: DataFrame, mode: str, fmt: str, rows: int | None = None):
    writer = df.write.mode(mode).format(fmt).option("maxRecordsPerFile", rows or TEXT_ROWS)
    return writer.options(**CSV_WRITE_OPTIONS) if fmt == "csv" else writer


def write_split(cases: DataFrame, path: str, fmt: str = "csv") -> None:
    """Overwrite the combined dataset, one folder per split, columns in the declared order."""
    stored = as_text_columns(cases).select(*schemas.TANGLED.fieldNames(), "split")
    _writer(stored, "overwrite", fmt).partitionBy("split").save(path)


def append_samples(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Append curated records; an empty table changes nothing."""
    if not df.isEmpty():
        _writer(df.select(*schemas.ATOMIC.fieldNames()), "append", fmt).save(path)


def append_results(scored: DataFrame, path: str, fmt: str = "csv", by: Sequence[str] = (), run: str | None = None) -> None:
    """Append scored rows with the declared result columns, in folders by ``by``.

    Readers of folders named by setting prune the files they do not need. With ``run``, and always in a columnar
    format, the rows are committed as that run (``logs``): appended twice they count once. Lists are stored as text.
    """
    lists = ("predicted_types", "actual_types", "shas")
    text = {c: F.to_json(c) for c in lists if dict(scored.dtypes)[c].startswith("array")}
    copies = {f"{c}_dir": F.col(c) for c in by}
    stored = scored.withColumns({**text, **copies})
    declared = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.RESULTS.fields]

    def writer_of(df):
        writer = _writer(df, "append", fmt, LOG_ROWS)
        return writer.partitionBy(*copies) if copies else writer

    stored = stored.select(*declared, *copies)
    if fmt == "csv" and run is None:
        writer_of(stored).save(path)
    else:
        append_run(writer_of, stored, path, run)


def export_type_documents(df: DataFrame, path: str, layout: str = "table") -> None:
    """One document per record. ``table``: Parquet by type; ``files``: one text file each."""
    docs = type_documents(df)
    if layout == "table":
        docs.write.mode("overwrite").partitionBy("type").parquet(path)
    else:
        docs.write.mode("overwrite").partitionBy("type", "file_name").text(path)


def write_summary_json(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)


def export_evaluation(view: DataFrame, path: str) -> None:
    _writer(export_view(view), "overwrite", "csv", LOG_ROWS).save(path)


def write_resumable(df: DataFrame, path: str, key: Sequence[str]) -> None:
    """Append only the rows whose key is not stored yet, so a broken run can go on."""
    key = list(key)
    try:
        done = df.sparkSession.read.parquet(path).select(*key)
        df = df.join(done, key, "left_anti")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    df.write.mode("append").parquet(path)


