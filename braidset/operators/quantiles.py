"""Exact interpolated quantiles and what rests on them: fences, outliers, boxes."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from braidset.operators.ranking import attach, number_levels, order_statistics

IQR_FACTOR = 1.5


def exact_quantiles(
    df: DataFrame, col: str, probs: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """One row per group: ``by``, ``n`` and a column per entry of ``probs``.

    Linear interpolation between neighbours. NULL and NaN are left out. Works by
    counting, so it holds for any number of distinct values.
    """
    x = F.col(col).cast("double")
    clean = df.where(x.isNotNull() & ~F.isnan(x))
    spot = lambda n, p: (n - 1) * F.lit(float(p))

    def ranks(n: Column) -> Column:
        ends = [f(spot(n, p)).cast("bigint") for p in probs.values() for f in (F.floor, F.ceil)]
        return F.array_distinct(F.array(*ends))

    found = order_statistics(clean, number_levels(x), ranks, by)
    found = found.groupBy(*by).agg(
        F.first("n").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"),
    )
    out = {}
    for name, p in probs.items():
        at = spot(F.col("n"), p)
        low = F.element_at("_at", F.floor(at).cast("bigint"))
        high = F.element_at("_at", F.ceil(at).cast("bigint"))
        out[name] = low + (at - F.floor(at)) * (high - low)
    return found.withColumns(out).drop("_at")


def iqr_fences(df, col, k: float = IQR_FACTOR, by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``q1``, ``q3``, ``low``, ``high``."""
    q = exact_quantiles(df, col, {"q1": 0.25, "q3": 0.75}, by)
    iqr = F.col("q3") - F.col("q1")
    return q.select(
        *by, "q1", "q3", (F.col("q1") - k * iqr).alias("low"), (F.col("q3") + k * iqr).alias("high")
    )


def flag_outliers(
    df: DataFrame,
    col: str,
    k: float = IQR_FACTOR,
    by: Sequence[str] = (),
    flag: str = "is_outlier",
) -> DataFrame:
    """Mark values strictly outside the fences, which span all rows (or each group)."""
    fences = iqr_fences(df, col, k, by).select(*by, F.col("low").alias("_lo"), F.col("high").alias("_hi"))
    x = F.col(col)
    # NaN is above every number in Spark's order, but no outlier.
    outside = F.coalesce(~F.isnan(x.cast("double")) & ((x < F.col("_lo")) | (x > F.col("_hi"))), F.lit(False))
    return attach(df, fences, by).withColumn(flag, outside).drop("_lo", "_hi")


def drop_outliers(df, col, k: float = IQR_FACTOR, by: Sequence[str] = ()) -> DataFrame:
    return flag_outliers(df, col, k, by, "_out").where(~F.col("_out")).drop("_out")


def outlier_rows(df, col, k: float = IQR_FACTOR, by: Sequence[str] = ()) -> DataFrame:
    return flag_outliers(df, col, k, by, "_out").where("_out").drop("_out")


def outlier_report(flagged: DataFrame, col: str, removed: bool = True) -> DataFrame:
    """Counts and range of the flagged rows; the rows themselves come from ``outlier_rows``.

    The percentage is taken of the rows before removal.
    """
    n_out = F.count_if("is_outlier")
    x = F.when(F.col("is_outlier"), F.col(col))
    return flagged.agg(
        F.count(F.lit(1)).alias("n_before"),
        n_out.alias("outlier_count"),
        ((n_out > 0) & F.lit(removed)).alias("removed"),
        F.min(x).alias("outlier_min"),
        F.max(x).alias("outlier_max"),
        F.coalesce(F.bround(F.try_divide(n_out * 100.0, F.count(F.lit(1))), 1), F.lit(0.0)).alias(
            "outlier_percent"
        ),
    )


def box_summary(
    df: DataFrame, x: str, by: Sequence[str], k: float = IQR_FACTOR
) -> DataFrame:
    """Quartiles, whisker ends (the last values inside the fences) and count of fliers."""
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    q = exact_quantiles(df, x, probs, by)
    reach = k * (F.col("q3") - F.col("q1"))
    known = ~F.isnan(F.col(x).cast("double"))
    inside = known & F.col(x).between(F.col("q1") - reach, F.col("q3") + reach)
    whiskers = (
        attach(df.select(*by, x), q, by)
        .groupBy(*by)
        .agg(
            F.min(F.when(inside, F.col(x))).alias("whisker_low"),
            F.max(F.when(inside, F.col(x))).alias("whisker_high"),
            F.count_if(known & ~inside).alias("fliers"),
        )
    )
    # Groups whose values are all NULL have no box but stay.
    ends = ("whisker_low", "whisker_high", "fliers")
    return whiskers.join(q, list(by), "left").select(*by, *[c for c in q.columns if c not in by], *ends)


def fliers(df: DataFrame, x: str, by: Sequence[str], k: float = IQR_FACTOR) -> DataFrame:
    """The rows a box plot draws as single points."""
    return outlier_rows(df, x, k, by)


def describe(df: DataFrame, continuous: Sequence[str], discrete: Sequence[str] = ()) -> DataFrame:
    """Long table (column, statistic, value): count, mean, std, min, quartiles, max.

    ``discrete`` columns have few distinct values (factors, ratios of small counts),
    so one pass with the built-in exact percentile serves them all; ``continuous``
    ones are ranked by counting.
    """
    stats = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")

    def moments(c):
        x = F.col(c).cast("double")
        x = F.when(~F.isnan(x), x)
        return {"count": F.count(x).cast("double"), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)}

    def long(row, c, field):
        return [F.struct(F.lit(c).alias("column"), F.lit(s).alias("statistic"), field(s).alias("value")) for s in stats]

    cols = [*continuous, *discrete]
    row = df.agg(
        *[v.alias(f"{c}|{s}") for c in cols for s, v in moments(c).items()],
        *[F.percentile(F.col(c).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"{c}|q") for c in discrete],
    )
    for c in continuous:
        q = exact_quantiles(df, c, {f"{c}|25%": 0.25, f"{c}|50%": 0.5, f"{c}|75%": 0.75}).drop("n")
        row = attach(row, q, ())
    for c in discrete:
        row = row.withColumns({f"{c}|{s}": F.col(f"{c}|q")[i] for i, s in enumerate(("25%", "50%", "75%"))})
    entries = [e for c in cols for e in long(row, c, lambda s, c=c: F.col(f"{c}|{s}"))]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
