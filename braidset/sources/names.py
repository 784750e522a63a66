"""Experiment settings written into file names and paths."""

from pyspark.sql import Column, functions as F

from braidset.schemas import LABEL_ABBREVIATIONS, SHOT_ABBREVIATIONS

# The naming patterns.
DATASET_NAME = r"^c(\d+)_t(\d+)_s(\d+)_([um])_([a-z_]+?)(\.[a-z]+)?$"
RUN_FILE = r"/?([^/]+?)_(\d+)_(zs|os|ts)_msg([01])\.csv$"
RUN_FOLDER = r"/?([^/]*?)/?msg([01])/(\d+)_(zs|os|ts)\.csv$"
RUN_MODE = r"(with_message|diff_only)/([^/]+)_(Zero|One|Two)_shot_(\d+)\.csv$"


def _mapping(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def parse_dataset_name(name: Column) -> Column:
    """Struct of the parts of ``c{N}_t{T}_s{S}_{u|m}_{types}``; NULL when it does not fit."""
    part = lambda i: F.regexp_extract(name, DATASET_NAME, i)
    types = F.transform(F.split(part(5), "_"), lambda t: _mapping(LABEL_ABBREVIATIONS)[t])
    fields = F.struct(
        part(1).try_cast("int").alias("concerns_per_case"),
        part(2).try_cast("int").alias("num_types"),
        part(3).try_cast("int").alias("num_samples"),
        (part(4) == "u").alias("ensure_different_types"),
        types.alias("types"),
    )
    return F.when(F.regexp_like(name, F.lit(DATASET_NAME)), fields)


def parse_run_name(path: Column) -> Column:
    """Struct ``model, context_len, shot, with_message`` from any of the three layouts.

    The folder layout names the model only by the folder above, when there is one.
    """
    x = F.regexp_extract
    shots = _mapping(SHOT_ABBREVIATIONS)

    def found(model, context, shot, flag):
        return F.struct(
            F.nullif(model, F.lit("")).alias("model"),
            context.try_cast("int").alias("context_len"),
            shot.alias("shot"),
            flag.alias("with_message"),
        )

    by_file = found(x(path, RUN_FILE, 1), x(path, RUN_FILE, 2), shots[x(path, RUN_FILE, 3)], x(path, RUN_FILE, 4) == "1")
    by_folder = found(x(path, RUN_FOLDER, 1), x(path, RUN_FOLDER, 3), shots[x(path, RUN_FOLDER, 4)], x(path, RUN_FOLDER, 2) == "1")
    by_mode = found(
        x(path, RUN_MODE, 2),
        x(path, RUN_MODE, 4),
        F.concat(x(path, RUN_MODE, 3), F.lit("-shot")),
        x(path, RUN_MODE, 1) == "with_message",
    )
    fits = lambda p: F.regexp_like(path, F.lit(p))
    return F.when(fits(RUN_FILE), by_file).when(fits(RUN_FOLDER), by_folder).when(fits(RUN_MODE), by_mode)


def experiment_id(model: Column, context: Column, with_message: Column, date: str) -> Column:
    """``{model}_{context}_{yes|no}_{YYYYMMDD}``; the date is an argument so that reruns agree."""
    flag = F.when(with_message, F.lit("yes")).otherwise(F.lit("no"))
    return F.concat_ws("_", model, context.cast("string"), flag, F.lit(date))
