"""Macro metrics kept up to date while result files arrive."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from braidset.operators.aggregate import macro_metrics
from braidset.plans.staging import scratch_path

POINTERS, POINTER = "_pointers", "version bigint"


def result_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """New files below ``path`` as a stream, with a declared schema."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.options(header="true", quote='"', escape='"')
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def live_macro(scored: DataFrame, by=("concern_count",)) -> DataFrame:
    """The batch aggregate on a stream of scored rows.

    State is one row per group, so no watermark is needed: results have no event time.
    """
    return macro_metrics(scored, by)


def publish(path: str):
    """A writer of batches: each becomes a version, and a pointer to it is written last.

    A batch that comes again after its pointer was written changes nothing; one that broke off before is written
    anew. Readers go by the last pointer, so they never see half a table, and one they have open is not replaced.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, root = batch.sparkSession, path.rstrip("/")
        last = latest_version(spark, path)
        if last is not None and last >= number:
            return
        batch.write.mode("overwrite").parquet(f"{root}/version={number}")
        pointer = spark.createDataFrame([(number,)], POINTER)
        pointer.coalesce(1).write.mode("append").json(f"{root}/{POINTERS}")

    return write


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The number of the last whole version, None before the first."""
    try:
        pointers = spark.read.schema(POINTER).json(f"{path.rstrip('/')}/{POINTERS}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return pointers.agg(F.max("version")).first()[0]


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its last whole version."""
    version = latest_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing was published at {path} yet")
    return spark.read.parquet(f"{path.rstrip('/')}/version={version}")


def start(live: DataFrame, path: str, checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
    """Publish each refreshed result at ``path`` (``publish``). ``once`` reads what is there and stops."""
    writer = live.writeStream.outputMode("complete").foreachBatch(publish(path))
    writer = writer.option("checkpointLocation", checkpoint or scratch_path(live.sparkSession, "live"))
    return (writer.trigger(availableNow=True) if once else writer).start()
