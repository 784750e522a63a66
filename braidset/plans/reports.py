"""Documents put together from several operators: one nested row each."""

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from braidset.functions import effects
from braidset.operators import correlate, groups, quantiles, score
from braidset.operators.ranking import attach
from braidset.plans.staging import stage
from braidset.sources import readers
from braidset.sources.names import experiment_id, parse_run_name

_SUMMARY = {
    "accuracy": "exact_match",
    "precision": "precision",
    "recall": "recall",
    "f1": "f1",
    "hamming_loss": "hamming_loss",
    "inference_time_avg": "inference_time",
}


def run_summary(
    df: DataFrame, run: Sequence[str] = ("model", "context_len", "with_message"), date: str = "19700101"
) -> DataFrame:
    """Per run: macro metrics, metrics by concern count and the number of empty predictions.

    Rows without a prediction are left out of the metrics (``num_scored``) but
    counted in ``num_samples``; ``score.empty_predictions`` lists them. The rows are
    read once, into sums per run and concern count.
    """
    run = list(run)
    empty = score.is_empty_prediction(F.col("predicted_types"))
    kept_sum = lambda c: F.sum(F.when(~empty, F.col(c).cast("double")))
    cells = df.groupBy(*run, "concern_count").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(~empty).alias("_kept"),
        *[kept_sum(c).alias(n) for n, c in _SUMMARY.items()],
    )
    means = lambda n, extra, total: F.struct(*extra, *[F.try_divide(total(c), n).alias(c) for c in _SUMMARY])
    one = means(F.col("_kept"), [F.col("concern_count"), F.col("_kept").alias("num_samples")], F.col)
    ident = experiment_id(F.col("model"), F.col("context_len"), F.col("with_message"), date)
    return (
        cells.groupBy(*run)
        .agg(
            F.sum("_rows").alias("num_samples"),
            F.sum("_kept").alias("num_scored"),
            means(F.sum("_kept"), [], F.sum).alias("metrics_macro"),
            F.array_sort(F.collect_list(F.when(F.col("_kept") > 0, one))).alias("metrics_by_concern"),
        )
        .select(
            ident.alias("experiment_id"),
            *run,
            "num_samples",
            "num_scored",
            "metrics_macro",
            "metrics_by_concern",
            F.struct((F.col("num_samples") - F.col("num_scored")).alias("count")).alias("outliers"),
            F.lit(date).alias("created_at"),
        )
    )


def with_model(results: DataFrame, root: str) -> DataFrame:
    """``results`` of ``read_results`` with ``model``: from the name of the file or run, else the folder below ``root``, else the start of the file name."""
    path = F.col("source_path")
    run = F.regexp_extract(path, r"/run=([^/]+)/", 1)
    below = F.regexp_extract(path, "/" + re.escape(root.rstrip("/").rpartition("/")[2]) + r"/([^/=]+)/", 1)
    stem = F.regexp_extract("source_file", r"^([^_.]+)", 1)
    named = [parse_run_name(path)["model"], parse_run_name(F.concat(run, F.lit(".csv")))["model"]]
    filled = [F.nullif(c, F.lit("")) for c in (run, below, stem)]
    return results.withColumn("model", F.coalesce(*named, *filled))


def summaries_from_files(
    spark: SparkSession, root: str, date: str, analysis_dir: str | None = None, fmt: str = "csv"
) -> DataFrame:
    """A summary of every run whose logs lie below ``root``, as ``run_summary`` gives, in one plan over all logs.

    ``sinks.write_summary_json`` stores them. Rows without a prediction count as samples but not in the metrics.
    """
    results, _ = readers.read_results(spark, root, analysis_dir, fmt)
    # Models are named once a file, not once a row.
    files = readers.result_files(spark, root, analysis_dir, fmt)
    files = files.select(F.col("path").alias("source_path"), F.substring_index("path", "/", -1).alias("source_file"))
    models = stage(with_model(files, root).select("source_path", "model"), "models")
    return run_summary(results.join(models, "source_path"), date=date)


def _kept(remove: bool):
    return ~F.col("is_outlier") if remove else F.lit(True)


def _outlier_columns(remove: bool) -> list:
    out = F.count_if("is_outlier")
    percent = F.coalesce(F.bround(F.try_divide(out * 100.0, F.count(F.lit(1))), 1), F.lit(0.0))
    return [out.alias("outlier_count"), ((out > 0) & F.lit(remove)).alias("removed"), percent.alias("outlier_percent")]


def _sd(name: str):
    return F.sqrt(F.try_divide(F.col(f"s_{name}_{name}"), F.col("n") - 1))


def _outlier_analysis():
    return F.struct(
        F.col("outlier_count").alias("total_detected"),
        F.col("removed").alias("removed_from_analysis"),
        F.col("outlier_percent").alias("percentage_of_data"),
    ).alias("outlier_analysis")


def efficiency_report(
    df: DataFrame, x: str, y: str = "inference_time", remove_outliers: bool = True, p_values: bool = True
) -> DataFrame:
    """How ``y`` depends on ``x`` (a number, or a true/false column): one nested row.

    Ranges are the true least and greatest values. The outlying rows themselves
    come from ``quantiles.outlier_rows``. The two columns are written once, since
    the fences take several passes.
    """
    narrow = stage(df.select(x, y), "pairs")
    return _efficiency(quantiles.flag_outliers(narrow, y), dict(df.dtypes)[x], x, y, remove_outliers, p_values)


def _efficiency(flagged: DataFrame, x_type: str, x: str, y: str, remove: bool, p_values: bool) -> DataFrame:
    """The report from rows with ``is_outlier``: one aggregate, the rest is arithmetic on its row."""
    number = F.col(x).cast("int") if x_type == "boolean" else F.col(x)
    kept = _kept(remove)
    values = {"x": F.when(kept, number), "y": F.when(kept, F.col(y))}
    row = correlate.line_from(correlate.moments(flagged, {"": values}, (), _outlier_columns(remove)))
    if p_values:
        row = correlate.with_t_value(correlate.with_p(row))
    digits = 6 if x == "context_len" else 4
    formula = F.concat(
        F.lit("y = "), F.format_string(f"%.{digits}f", "slope"), F.lit("x + "), F.format_string("%.4f", "intercept")
    )
    rounded = lambda c, n, name: F.bround(c, n).alias(name)
    tests = [F.col("p").alias("p_value"), (F.col("p") < 0.05).alias("significant")] if p_values else []
    interval = F.struct(F.lit(95).alias("level"), F.bround("t_value", 4).alias("t_value")) if p_values else None
    return row.select(
        F.struct(
            F.col("n").alias("total_samples"),
            F.col("outlier_count").alias("outliers_detected"),
            F.col("removed").alias("outliers_removed"),
            F.struct(F.col("x_min").alias("min"), F.col("x_max").alias("max")).alias("x_range"),
        ).alias("data_summary"),
        F.struct(
            rounded("r", 4, "coefficient"),
            *tests,
            effects.correlation_size(F.col("r")).alias("effect_size"),
            effects.correlation_direction(F.col("r")).alias("interpretation"),
            effects.correlation_sign(F.col("r")).alias("sign"),
        ).alias("correlation_analysis"),
        F.struct(
            F.struct(
                rounded("slope", digits, "slope"), rounded("intercept", 4, "intercept"), formula.alias("formula")
            ).alias("equation"),
            F.struct(
                rounded("r2", 4, "r_squared"),
                rounded("standard_error", 4, "standard_error"),
                effects.fit_quality(F.col("r2")).alias("interpretation"),
            ).alias("model_fit"),
            *([interval.alias("confidence_interval")] if p_values else []),
        ).alias("linear_regression"),
        F.struct(
            F.struct(rounded("mean_x", 2, "mean"), rounded(_sd("x"), 2, "std")).alias("x"),
            F.struct(
                rounded("mean_y", 4, "mean"), rounded(_sd("y"), 4, "std"), rounded("min_y", 4, "min"), rounded("max_y", 4, "max")
            ).alias("y"),
        ).alias("descriptive_statistics"),
        _outlier_analysis(),
    )


def message_report(df: DataFrame, y: str = "inference_time", remove_outliers: bool = True) -> DataFrame:
    """``efficiency_report`` on ``with_message`` with both groups and the tests between them.

    The two columns it needs are written once, since several passes read them.
    """
    flagged = quantiles.flag_outliers(stage(df.select("with_message", y), "pairs"), y)
    flagged = stage(flagged, "flagged")
    clean = flagged.where(_kept(remove_outliers)).drop("is_outlier")
    row = _efficiency(flagged, "boolean", "with_message", y, remove_outliers, True)
    stats = groups.group_stats(clean, y)
    entry = F.struct("count", *[F.bround(c, 4).alias(c) for c in ("mean", "std", "median", "min", "max")])
    pick = lambda on: F.max(F.when(F.col("with_message") == on, entry))
    both = stats.agg(F.struct(pick(True).alias("with_message"), pick(False).alias("without_message")).alias("group_comparison"))
    t = groups.with_t_p(groups.two_sample(clean, y)).drop("n1", "n0")
    u = groups.with_u_p(groups.mann_whitney(clean, y))
    enough = (F.col("n1") > 1) & (F.col("n0") > 1)
    test = lambda s, p: F.struct(F.col(s).alias("statistic"), F.col(p).alias("p_value"), (F.col(p) < 0.05).alias("significant"))
    tested = attach(t, u, ()).select(
        F.when(
            enough,
            F.struct(
                test("t_statistic", "t_p_value").alias("t_test"),
                test("u_statistic", "u_p_value").alias("mann_whitney_u"),
                F.struct(F.col("cohens_d"), F.col("effect").alias("interpretation")).alias("effect_size"),
            ),
        ).alias("statistical_tests")
    )
    return attach(attach(row, both, ()), tested, ())


# The five correlations of the interaction report.
INTERACTION_PAIRS = {
    "tokens_time": ("context_len", "inference_time"),
    "concern_time": ("concern_count", "inference_time"),
    "tokens_concern": ("context_len", "concern_count"),
    "log_tokens_log_time": ("log_tokens", "log_time"),
    "concern_log_time": ("concern_count", "log_time"),
}


_MODEL = ("log_tokens", "concern_count", "log_tokens_x_concern")


def interaction_rows(df: DataFrame) -> DataFrame:
    """Rows of the interaction model with their logarithms; ``is_outlier`` by fences on the log of time."""
    narrow = stage(df.select("context_len", "inference_time", "concern_count"), "triples")
    return quantiles.flag_outliers(correlate.log_features(correlate.positive_domain(narrow)), "log_time")


def interaction_report(df: DataFrame, remove_outliers: bool = True) -> DataFrame:
    """The interaction model, five correlations and descriptives, all from one aggregate."""
    kept = _kept(remove_outliers)
    names = ("context_len", "inference_time", *_MODEL, "log_time")
    values = {c: F.when(kept, F.col(c)) for c in names}
    row = correlate.moments(interaction_rows(df), {"": values}, (), _outlier_columns(remove_outliers))
    s = lambda a, b: F.col("s_" + "_".join(sorted((a, b), key=names.index)))
    row = correlate.ols_from(row, _MODEL, "log_time")
    r = lambda a, b: correlate.pearson_from(s(a, b), s(a, a), s(b, b))
    number = lambda c: F.struct(
        F.col(f"mean_{c}").alias("mean"), _sd(c).alias("std"), F.col(f"min_{c}").alias("min"), F.col(f"max_{c}").alias("max")
    ).alias(c)
    return row.select(
        F.struct(
            F.col("n").alias("total_samples"),
            F.col("outlier_count").alias("outliers_detected"),
            F.col("removed").alias("outliers_removed"),
        ).alias("data_summary"),
        F.struct(
            F.struct(
                "intercept",
                F.col("beta_log_tokens").alias("log_tokens"),
                F.col("beta_concern_count").alias("concern_count"),
                F.col("beta_log_tokens_x_concern").alias("interaction"),
            ).alias("coefficients"),
            F.struct(
                F.col("r2").alias("r_squared"),
                F.col("adj_r2").alias("adjusted_r_squared"),
                "rmse",
                effects.fit_quality(F.col("r2")).alias("interpretation"),
            ).alias("model_fit"),
        ).alias("regression_model"),
        F.struct(*[r(a, b).alias(n) for n, (a, b) in INTERACTION_PAIRS.items()]).alias("pearson_correlations"),
        F.struct(*[number(c) for c in ("context_len", "inference_time", "concern_count")]).alias("descriptive_statistics"),
        _outlier_analysis(),
    )


def correlation_report(df: DataFrame) -> DataFrame:
    """Correlations with stars and the stronger factor per metric, as rows."""
    table = correlate.with_significance(correlate.correlation_table(df))
    stronger = correlate.stronger_factor(table).select("metric", "stronger")
    return table.join(stronger, "metric")
