"""Two-group comparison: descriptive statistics, t test, rank sum test, effect size."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from braidset.functions.distributions import rank_sum_p_value, t_p_value
from braidset.functions.effects import group_effect
from braidset.operators.quantiles import exact_quantiles
from braidset.operators.ranking import number_level


def group_stats(df: DataFrame, value: str = "inference_time", group: str = "with_message") -> DataFrame:
    x = F.col(value).cast("double")
    moments = df.groupBy(group).agg(
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    medians = exact_quantiles(df, value, {"median": 0.5}, [group]).drop("n")
    # A group of NULLs alone has no median but stays, and so does the group without a name.
    medians = medians.withColumnRenamed(group, "_group")
    return moments.join(medians, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")


def two_sample(df: DataFrame, value: str = "inference_time", flag: str = "with_message") -> DataFrame:
    """Pooled-variance t statistic and Cohen's d; NULL when a group has fewer than two rows."""
    side = lambda on: F.when(F.col(flag) == on, F.col(value).cast("double"))
    a, b = side(True), side(False)
    row = df.agg(
        *[f(c).alias(n + t) for t, c in (("1", a), ("0", b)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    )
    n1, n0 = F.col("n1"), F.col("n0")
    enough = (n1 > 1) & (n0 > 1)
    spread = (n1 - 1) * F.col("var1") + (n0 - 1) * F.col("var0")
    pooled = F.when(enough, F.try_divide(spread, n1 + n0 - 2))
    diff = F.col("mean1") - F.col("mean0")
    sd = F.nullif(F.sqrt(pooled), F.lit(0.0))
    d = diff / sd
    return row.select(
        "n1",
        "n0",
        (d / F.sqrt(F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n0))).alias("t_statistic"),
        (n1 + n0 - 2).alias("df"),
        d.alias("cohens_d"),
        F.when(d.isNotNull(), group_effect(d)).alias("effect"),
    )


def with_t_p(row: DataFrame) -> DataFrame:
    return row.withColumn("t_p_value", t_p_value(F.col("t_statistic"), F.col("df")))


def _before(total: Column, by, order) -> Column:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(total).over(w), F.lit(0.0))


def mann_whitney(df: DataFrame, value: str = "inference_time", flag: str = "with_message") -> DataFrame:
    """U of the flagged group, tie term and signed z, without a global sort.

    Equal values are counted first. U is then the sum of three parts: pairs whose
    values lie in different coarse buckets, in different fine buckets of one coarse
    bucket, and in one fine bucket. Each part needs a running sum over few rows.
    """
    x = F.col(value).cast("double")
    counted = (
        df.where(x.isNotNull() & ~F.isnan(x) & F.col(flag).isNotNull())
        .groupBy(number_level(x, 10).alias("c"), number_level(x, 24).alias("f"), x.alias("x"))
        .agg(F.count_if(F.col(flag)).cast("double").alias("n1"), F.count_if(~F.col(flag)).cast("double").alias("n0"))
    )
    total = lambda d, *keys: d.groupBy(*keys).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    fine = total(counted, "c", "f")
    coarse = total(fine, "c")
    zero = F.lit(0.0)

    def part(d, by, order, half):
        pairs = F.col("n1") * (F.col("earlier") + half * F.col("n0"))
        t = F.col("n1") + F.col("n0")
        tied = (t * t * t - t) * half * 2
        return d.withColumn("earlier", _before(F.col("n0"), by, order)).agg(
            F.sum(pairs).alias("u"),
            F.sum(tied).alias("ties"),
            *[F.sum(F.col(c) * half * 2).alias(c) for c in ("n1", "n0")],
        )

    parts = (
        part(coarse, [], "c", zero)
        .unionByName(part(fine, ["c"], "f", zero))
        .unionByName(part(counted, ["c", "f"], "x", F.lit(0.5)))
    )
    row = parts.agg(*[F.sum(c).alias(c) for c in ("u", "ties", "n1", "n0")])
    n1, n0, u = F.col("n1"), F.col("n0"), F.col("u")
    n = n1 + n0
    middle = n1 * n0 / 2
    spread = F.sqrt(n1 * n0 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    z = (F.greatest(u, n1 * n0 - u) - middle - 0.5) / F.nullif(spread, F.lit(0.0))
    return row.select(
        n1.cast("bigint").alias("n1"),
        n0.cast("bigint").alias("n0"),
        u.alias("u_statistic"),
        F.col("ties").alias("tie_term"),
        z.alias("z"),
    ).withColumn("u_statistic", F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("u_statistic")))


def with_u_p(row: DataFrame) -> DataFrame:
    p = rank_sum_p_value(F.col("u_statistic"), F.col("n1"), F.col("n0"), F.col("z"), F.col("tie_term") > 0)
    return row.withColumn("u_p_value", p)
