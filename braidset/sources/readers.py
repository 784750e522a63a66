"""Readers with declared schemas and contract checks. CSV or any columnar format."""

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from braidset import schemas
from braidset.functions.labels import parse_labels
from braidset.plans.staging import stage
from braidset.sources.headers import header_table, listed
from braidset.sources.logs import only_committed

# Diffs hold line breaks and quotes.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}

# File stems of summaries that sit beside result logs.
SUMMARY_SUFFIXES = ("_macro", "_macro_by_concern")
REQUIRED_RESULTS = ("precision", "recall", "f1", "exact_match", "hamming_loss", "inference_time", "concern_count")


def missing_columns(have: Sequence[str], required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in have]


def check_headers(headers: DataFrame, required=REQUIRED_RESULTS) -> DataFrame:
    """``path, columns, missing, usable`` for every file of a header table."""
    wanted = F.array(*map(F.lit, required)) if required else F.array().cast("array<string>")
    lack = F.array_except(wanted, F.col("columns"))
    return headers.withColumn("missing", lack).withColumn("usable", F.size("missing") == 0)


def _csv_by_name(spark, path, headers: DataFrame, types: dict, every: bool, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """Rows of the CSV files in ``headers`` with the columns in ``types`` by name, and ``_path``.

    Files of one layout are read with it. Else every file is read by position in one pass, and each row's
    values are looked up by the names of its file; ``every`` says that ``headers`` has all files at ``path``.
    """
    layouts, width, names = headers.agg(F.count_distinct("columns"), F.max(F.size("columns")), F.min("columns")).first()
    one = layouts == 1
    columns = names if one else [f"_{i}" for i in range(width or 0)]
    layout = T.StructType([T.StructField(c, types.get(c, T.StringType()) if one else T.StringType()) for c in columns])
    reader = spark.read.schema(layout).options(**CSV_OPTIONS)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.csv(path)
    folders = [c for c in df.columns if c not in columns]
    df = df.withColumn("_path", F.col("_metadata.file_path"))
    if not (one and every):
        df = df.join(headers.select(F.col("path").alias("_path"), F.col("columns").alias("_names")), "_path")
    if one:
        value = lambda c: F.col(f"`{c}`") if c in columns else F.lit(None)
    else:
        values = F.array(*[F.col(c) for c in columns])
        value = lambda c: F.try_element_at(values, F.nullif(F.array_position("_names", F.lit(c)), F.lit(0)).cast("int"))
    cast = lambda c: value(c).try_cast(types[c]) if not one else value(c).cast(types[c])
    return df.select(*[cast(c).alias(c) for c in types], *folders, "_path")


def _types(schema: T.StructType) -> dict:
    return {f.name: f.dataType for f in schema.fields}


def _refuse_incomplete(checked: DataFrame) -> None:
    """Raise for the first files that lack a column."""
    bad = checked.where("NOT usable").orderBy("path").limit(5).collect()
    if bad:
        raise ValueError("missing required columns: " + "; ".join(f"{list(h.missing)} in {h.path}" for h in bad))


def _by_name(spark, path, schema: T.StructType, required, fmt: str) -> DataFrame:
    """The columns of ``path`` by name; raises when a file lacks a required one."""
    if fmt == "csv":
        headers = stage(check_headers(header_table(listed(spark, path), path), required), "headers")
        if headers.isEmpty():
            raise ValueError(f"dataset is empty: {path}")
        _refuse_incomplete(headers)
        return _csv_by_name(spark, path, headers, _types(schema), every=True).drop("_path")
    df = spark.read.format(fmt).load(path)
    missing = missing_columns(df.columns, required)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def _read(spark, path, schema: T.StructType, required, fmt: str) -> DataFrame:
    df = _by_name(spark, path, schema, required, fmt)
    if df.isEmpty():
        raise ValueError(f"dataset is empty: {path}")
    return df


def read_atomic(spark: SparkSession, path, fmt: str = "csv") -> DataFrame:
    """Raw labelled records; raises when empty or when a column is missing."""
    names = schemas.ATOMIC.fieldNames()
    return _read(spark, path, schemas.ATOMIC, names, fmt).select(*names)


def read_tangled(spark: SparkSession, path, fmt: str = "csv") -> DataFrame:
    """Combined cases with list columns parsed; raises when empty or incomplete."""
    df = _read(spark, path, schemas.TANGLED, ("diff", "types", "shas"), fmt)
    listed = {c: parse_labels(F.col(c)) for c, t in df.dtypes if c in ("diff", "types", "shas") and t == "string"}
    return df.withColumns(listed)


def read_parquet_split(spark: SparkSession, root: str, split: str) -> DataFrame:
    """A split of a published dataset, kept as a local Parquet copy."""
    return spark.read.parquet(f"{root.rstrip('/')}/{split}")


def read_excluded(spark: SparkSession, path, fmt: str = "csv") -> DataFrame:
    """Distinct values of the column ``sha``, wherever it stands."""
    return _by_name(spark, path, schemas.EXCLUDED, ["sha"], fmt).select("sha").distinct()


def existing_samples(spark: SparkSession, path, fmt: str = "csv") -> DataFrame:
    """Records sampled before; an empty table when there are none yet."""
    try:
        names = schemas.ATOMIC.fieldNames()
        return _by_name(spark, path, schemas.ATOMIC, names, fmt).select(*names)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schemas.ATOMIC)
        raise


def discover(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """Files below ``root`` with their sizes, sorted; contents are not read."""
    return listed(spark, root, pattern, recursive=True).orderBy("path")


def folder_of(path: Column) -> Column:
    """The folder of a file, with its last slash: where a table written in parts lies, it names the table."""
    return F.left(path, F.length(path) - F.length(F.substring_index(path, "/", -1)))


def written_tables(found: DataFrame) -> DataFrame:
    """``path, bytes`` of the tables in a listing: the parts of one folder count as one file, named by the folder."""
    return found.groupBy(folder_of(F.col("path")).alias("path")).agg(F.sum("bytes").alias("bytes"))


def missing_files(found: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required file names that ``discover`` did not find."""
    names = found.select(F.element_at(F.split("path", "/"), -1).alias("file"))
    wanted = found.sparkSession.createDataFrame([(r,) for r in required], "file string")
    return wanted.join(names, "file", "left_anti")


def _log_files(path: Column, fmt: str, analysis_dir: str | None) -> Column:
    """True for raw result logs: no summaries, nothing from the analysis folder. Tested on every row, so no pattern."""
    keep = F.lit(True)
    for suffix in SUMMARY_SUFFIXES:
        keep = keep & ~path.endswith(f"{suffix}.{fmt}")
    if analysis_dir:
        keep = keep & ~F.contains(path, F.lit(f"/{analysis_dir.strip('/')}/"))
    return keep


def result_files(spark: SparkSession, root: str, analysis_dir: str | None = None, fmt: str = "csv") -> DataFrame:
    """Raw result logs below ``root``; of committed runs the last attempt."""
    files = discover(spark, root, f"*.{fmt}").where(_log_files(F.col("path"), fmt, analysis_dir))
    return only_committed(spark, files, root)


def _parse_lists(df: DataFrame) -> DataFrame:
    return df.withColumns({c: parse_labels(F.col(c)) for c in ("predicted_types", "actual_types", "shas")})


def _with_lineage(df: DataFrame) -> DataFrame:
    name = F.substring_index("_path", "/", -1)
    return _parse_lists(df).withColumns({"source_file": name, "source_path": F.col("_path")}).drop("_path")


def read_results(
    spark: SparkSession, root: str, analysis_dir: str | None = None, fmt: str = "csv"
) -> tuple[DataFrame, DataFrame]:
    """All result logs below ``root`` in one table, and a report of the files left out (``path, missing``).

    Logs in folders of runs (``append_results``) are read by the manifest. Columns are found by name in each file;
    those a file lacks are NULL. Adds ``source_file`` (name) and ``source_path``.
    """
    pattern = f"*.{fmt}"
    files = result_files(spark, root, analysis_dir, fmt)
    headers = stage(check_headers(header_table(files, root, fmt, recursive=True)), "headers")
    counts = headers.agg(F.count(F.lit(1)).alias("found"), F.count_if("usable").alias("usable")).first()
    if not counts.found:
        raise FileNotFoundError(f"no result files below {root}")
    if not counts.usable:
        raise ValueError("no result file has the required columns")
    usable = headers.where("usable")
    types = _types(schemas.RESULTS)
    if fmt == "csv":
        rows = _csv_by_name(spark, root, usable, types, every=False, recursive=True, pattern=pattern)
    else:
        reader = spark.read.schema(schemas.RESULTS).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        rows = reader.format(fmt).load(root).withColumn("_path", F.col("_metadata.file_path"))
        rows = rows.join(usable.select(F.col("path").alias("_path")), "_path", "left_semi").select(*types, "_path")
    # As a test of constant paths this also spares the files themselves.
    rows = rows.where(_log_files(F.col("_path"), fmt, analysis_dir))
    return _with_lineage(rows), headers.where("NOT usable").select("path", "missing")


def union_with_lineage(
    spark: SparkSession, paths: Sequence[str], cols: Sequence[str], lineage: Sequence[str] = ("source_file",)
) -> DataFrame:
    """Named columns of many result files plus ``source_file`` (and ``source_path`` if ``lineage`` has it); raises on a missing column."""
    return _named_files(spark, paths, cols).select(*cols, *lineage)


def concat_results(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Result files one under the other, without lineage."""
    return _named_files(spark, paths, ()).drop("source_file", "source_path")


def _named_files(spark, paths, required) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no files given")
    headers = stage(check_headers(header_table(listed(spark, paths), paths), required), "headers")
    _refuse_incomplete(headers)
    return _with_lineage(_csv_by_name(spark, paths, headers, _types(schemas.RESULTS), every=True))
