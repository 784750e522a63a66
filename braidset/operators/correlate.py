"""Correlation and linear regression from one pass of sums of squares and products.

Each statistic is a closed form over a single aggregated row, so its cost is one
scan however many metrics are asked for.
"""

from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from braidset.functions.distributions import t_critical, t_p_value
from braidset.functions.effects import stars
from braidset.operators.aggregate import level_product
from braidset.operators.ranking import attach

# Factors and metrics of the standard correlation table.
FACTORS = ("context_len", "concern_count")
METRICS = ("precision", "recall", "f1", "inference_time")


def moments(
    df: DataFrame, specs: dict[str, dict[str, Column]], by: Sequence[str] = (), extra: Sequence[Column] = ()
) -> DataFrame:
    """One aggregate for several sets of columns, named by prefix.

    Per set, over the rows where each of its columns has a number: ``n``, ``mean_a``,
    ``min_a``, ``max_a`` and ``s_a_b``, the centred sum of a times b.
    """
    values, aggs = {}, []
    for prefix, cols in specs.items():
        doubles = [c.cast("double") for c in cols.values()]
        total = sum(doubles[1:], doubles[0])
        whole = total.isNotNull() & ~F.isnan(total)
        for name, c in zip(cols, doubles):
            values[f"{prefix}{name}"] = F.when(whole, c)
        first = f"{prefix}{next(iter(cols))}"
        aggs.append(F.expr(f"count({first}) AS {prefix}n"))
        for name in cols:
            v = f"{prefix}{name}"
            aggs += [F.expr(f"{f}({v}) AS {prefix}{n}_{name}") for f, n in (("avg", "mean"), ("min", "min"), ("max", "max"))]
        for a, b in combinations_with_replacement(cols, 2):
            aggs.append(F.expr(f"covar_pop({prefix}{a}, {prefix}{b}) * count({first}) AS {prefix}s_{a}_{b}"))
    return df.withColumns(values).groupBy(*by).agg(*aggs, *extra)


def _nz(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def _not_below_zero(c: Column) -> Column:
    """Rounding can push a sum of squares under zero; NULL stays NULL."""
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def pearson_from(sxy: Column, sxx: Column, syy: Column) -> Column:
    """r, NULL for a constant column."""
    r = sxy / _nz(F.sqrt(sxx * syy))
    return F.when(F.abs(r) > 1, F.signum(r)).otherwise(r)


def t_of_r(r: Column, n: Column) -> Column:
    left = 1 - r * r
    return F.when(left > 0, r * F.sqrt((n - 2) / left)).otherwise(r * F.lit(float("inf")))


def p_of_r(r: Column, n: Column, df: Column | None = None) -> Column:
    df = n - 2 if df is None else df
    t = F.when(n > 2, t_of_r(r, n))
    return F.when(n > 2, t_p_value(t, df)).when(r.isNotNull(), F.lit(1.0))


def pearson(df: DataFrame, x: str | Column, y: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``n``, ``r``; r is 0 below two rows, NULL for a constant column."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    row = moments(df, {"": {"x": x, "y": y}}, by)
    r = pearson_from(F.col("s_x_y"), F.col("s_x_x"), F.col("s_y_y"))
    return row.select(*by, "n", F.when(F.col("n") < 2, F.lit(0.0)).otherwise(r).alias("r"))


def with_p(rows: DataFrame) -> DataFrame:
    """Add ``p`` to rows with ``n`` and ``r``; p is 1 below two rows."""
    p = p_of_r(F.col("r"), F.col("n"))
    return rows.withColumn("p", F.when(F.col("n") < 2, F.lit(1.0)).otherwise(p))


def point_biserial(df: DataFrame, flag: str, y: str) -> DataFrame:
    return pearson(df, F.col(flag).cast("int"), F.col(y))


def _long(row: DataFrame, entries: Sequence[Column]) -> DataFrame:
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def correlation_table(
    df: DataFrame, factors: Sequence[str] = FACTORS, metrics: Sequence[str] = METRICS
) -> DataFrame:
    """``factor, metric, n, r, abs_r, slope, intercept`` for every pair, from one aggregate."""
    pairs = [(f, m) for f in factors for m in metrics]
    specs = {f"p{i}_": {"x": F.col(f), "y": F.col(m)} for i, (f, m) in enumerate(pairs)}
    c = lambda i, n: F.col(f"p{i}_{n}")

    def entry(i, f, m):
        r = pearson_from(c(i, "s_x_y"), c(i, "s_x_x"), c(i, "s_y_y"))
        slope = c(i, "s_x_y") / _nz(c(i, "s_x_x"))
        return F.struct(
            F.lit(f).alias("factor"),
            F.lit(m).alias("metric"),
            c(i, "n").alias("n"),
            r.alias("r"),
            F.abs(r).alias("abs_r"),
            slope.alias("slope"),
            (c(i, "mean_y") - slope * c(i, "mean_x")).alias("intercept"),
        )

    return _long(moments(df, specs), [entry(i, f, m) for i, (f, m) in enumerate(pairs)])


def with_significance(table: DataFrame) -> DataFrame:
    """Add ``p``, ``significant`` and ``stars`` to a correlation table."""
    return table.withColumn("p", p_of_r(F.col("r"), F.col("n"))).withColumns(
        {"significant": F.col("p") < 0.05, "stars": stars(F.col("p"))}
    )


def stronger_factor(table: DataFrame, first: str = FACTORS[0], second: str = FACTORS[1]) -> DataFrame:
    """Per metric the factor with the larger ``|r|``; ``second`` on a tie."""
    pick = lambda f: F.max(F.when(F.col("factor") == f, F.col("abs_r")))
    wide = table.groupBy("metric").agg(pick(first).alias("a"), pick(second).alias("b"))
    stronger = F.when(F.col("a") > F.col("b"), F.lit(first)).otherwise(F.lit(second))
    return wide.select(
        "metric", F.col("a").alias(f"abs_r_{first}"), F.col("b").alias(f"abs_r_{second}"), stronger.alias("stronger")
    )


def correlation_set(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """One row, one named r per pair."""
    row = moments(df, {f"{n}_": {"x": F.col(x), "y": F.col(y)} for n, (x, y) in pairs.items()})
    r = lambda n: pearson_from(F.col(f"{n}_s_x_y"), F.col(f"{n}_s_x_x"), F.col(f"{n}_s_y_y"))
    return row.select(*[r(n).alias(n) for n in pairs])


def _solve(s, xs: Sequence[str], y: str) -> list[dict[str, Column]]:
    """Steps of Gaussian elimination on the normal equations, as columns of a single row.

    ``s(a, b)`` gives the centred sum of products. Returns the columns to add, step
    by step; the last ones are ``beta_<x>``.
    """
    steps, p = [], len(xs)
    m = {(i, j): s(xs[i], xs[j]) for i in range(p) for j in range(p)}
    v = {i: s(xs[i], y) for i in range(p)}
    for k in range(p - 1):
        added = {}
        for i in range(k + 1, p):
            f = m[i, k] / _nz(m[k, k])
            for j in range(k + 1, p):
                added[f"_m{k}_{i}_{j}"] = m[i, j] - f * m[k, j]
            added[f"_v{k}_{i}"] = v[i] - f * v[k]
        steps.append(added)
        for i in range(k + 1, p):
            for j in range(k + 1, p):
                m[i, j] = F.col(f"_m{k}_{i}_{j}")
            v[i] = F.col(f"_v{k}_{i}")
    for i in reversed(range(p)):
        known = sum((m[i, j] * F.col(f"beta_{xs[j]}") for j in range(i + 1, p)), F.lit(0.0))
        steps.append({f"beta_{xs[i]}": (v[i] - known) / _nz(m[i, i])})
    return steps


def ols(df: DataFrame, y: Column, xs: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Least squares of ``y`` on up to a few predictors.

    ``n``, ``intercept``, ``beta_<x>``, ``r2``, ``adj_r2``, ``mse`` (over n), ``rmse``.
    A predictor that is constant or a combination of others gives NULL.
    """
    row = moments(df, {"": {**xs, "y": y}}, by)
    fitted = ols_from(row, list(xs), "y")
    return fitted.select(*by, "n", "intercept", *[f"beta_{x}" for x in xs], "r2", "adj_r2", "mse", "rmse")


def ols_from(row: DataFrame, names: Sequence[str], y: str) -> DataFrame:
    """``ols`` from a row of ``moments`` that has all the columns in this order."""
    order = {c: i for i, c in enumerate([*names, y])}
    s = lambda a, b: F.col("s_" + "_".join(sorted((a, b), key=order.get)))
    for added in _solve(s, names, y):
        row = row.withColumns(added)
    beta = {x: F.col(f"beta_{x}") for x in names}
    explained = sum((beta[x] * s(x, y) for x in names), F.lit(0.0))
    r2 = explained / _nz(s(y, y))
    n, p = F.col("n"), len(names)
    mse = F.try_divide(s(y, y) - explained, n)
    return row.withColumns(
        {
            "intercept": F.col(f"mean_{y}") - sum((beta[x] * F.col(f"mean_{x}") for x in names), F.lit(0.0)),
            "r2": r2,
            "adj_r2": 1 - (1 - r2) * F.try_divide(n - 1, n - p - 1),
            "mse": mse,
            "rmse": F.sqrt(_not_below_zero(mse)),
        }
    )


def simple_ols(df: DataFrame, x: str | Column, y: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Line through (x, y) with residual error on n − 2 degrees of freedom."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return line_from(moments(df, {"": {"x": x, "y": y}}, by)).select(*by, *LINE)


LINE = ("n", "slope", "intercept", "r2", "standard_error", "mse", "x_mean", "ss_x", "x_min", "x_max")


def line_from(row: DataFrame) -> DataFrame:
    """Add the ``LINE`` columns and ``r`` to a row of ``moments`` over x and y."""
    slope = F.col("s_x_y") / _nz(F.col("s_x_x"))
    res = _not_below_zero(F.col("s_y_y") - slope * F.col("s_x_y"))
    mse = F.when(F.col("n") > 2, F.try_divide(res, F.col("n") - 2))
    r = pearson_from(F.col("s_x_y"), F.col("s_x_x"), F.col("s_y_y"))
    return row.withColumns(
        {
            "slope": slope,
            "intercept": F.col("mean_y") - slope * F.col("mean_x"),
            "r2": slope * F.col("s_x_y") / _nz(F.col("s_y_y")),
            "standard_error": F.sqrt(mse),
            "mse": mse,
            "x_mean": F.col("mean_x"),
            "ss_x": F.col("s_x_x"),
            "x_min": F.col("min_x"),
            "x_max": F.col("max_x"),
            "r": F.when(F.col("n") < 2, F.lit(0.0)).otherwise(r),
        }
    )


def with_t_value(fit: DataFrame) -> DataFrame:
    return fit.withColumn("t_value", t_critical(F.col("n") - 2))


def with_slope_test(fit: DataFrame) -> DataFrame:
    """Add ``r``, ``p`` and the 95 % interval of the slope (``slope_low``, ``slope_high``) to a line with ``t_value``."""
    r = F.signum("slope") * F.sqrt("r2")
    reach = F.col("t_value") * F.col("standard_error") / _nz(F.sqrt("ss_x"))
    tested = fit.withColumn("r", r)
    return with_p(tested).withColumns({"slope_low": F.col("slope") - reach, "slope_high": F.col("slope") + reach})


def ci_band(fit: DataFrame, t_value: Column | None = None, points: int = 100) -> DataFrame:
    """The line and its 95 % band on evenly spaced x from least to greatest."""
    if t_value is None:
        fit, t_value = with_t_value(fit), F.col("t_value")
    step = F.col("i") / F.lit(float(points - 1))
    x = F.col("x_min") + (F.col("x_max") - F.col("x_min")) * step
    at = fit.withColumn("_t", t_value).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", x)
    se = F.sqrt(F.col("mse") * (1 / F.col("n") + (F.col("x") - F.col("x_mean")) ** 2 / _nz(F.col("ss_x"))))
    y = F.col("slope") * F.col("x") + F.col("intercept")
    return at.select(
        F.col("i").alias("point"), "x", y.alias("y"), (y - F.col("_t") * se).alias("ci_low"), (y + F.col("_t") * se).alias("ci_high")
    )


def partial_table(
    df: DataFrame,
    first: str = "context_len",
    second: str = "concern_count",
    metrics: Sequence[str] = METRICS,
) -> DataFrame:
    """Per metric: plain and partial correlation of both factors, the two-factor fit
    ``y ~ log2(first) + second``, the R² each adds, variance inflation, standard betas.

    Plain r of ``first`` uses it as it is; all the rest uses its logarithm.
    """
    log = F.log2(F.col(first).cast("double"))
    specs = {
        f"m{i}_": {"a": log, "b": F.col(second), "o": F.col(first), "y": F.col(m)} for i, m in enumerate(metrics)
    }
    row = moments(df, specs)

    def entry(i, m):
        c = lambda n: F.col(f"m{i}_{n}")
        s = lambda p, q: c(f"s_{p}_{q}")
        r_ay = pearson_from(s("a", "y"), s("a", "a"), s("y", "y"))
        r_by = pearson_from(s("b", "y"), s("b", "b"), s("y", "y"))
        r_ab = pearson_from(s("a", "b"), s("a", "a"), s("b", "b"))
        part = lambda r1, r2: (r1 - r_ab * r2) / _nz(F.sqrt((1 - r_ab * r_ab) * (1 - r2 * r2)))
        det = _nz(s("a", "a") * s("b", "b") - s("a", "b") * s("a", "b"))
        beta_a = (s("a", "y") * s("b", "b") - s("b", "y") * s("a", "b")) / det
        beta_b = (s("b", "y") * s("a", "a") - s("a", "y") * s("a", "b")) / det
        r2 = (beta_a * s("a", "y") + beta_b * s("b", "y")) / _nz(s("y", "y"))
        left = 1 - r_ab * r_ab
        vif = F.when(left == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), left))
        spread = lambda p: F.sqrt(s(p, p) / c("n"))
        y_sd = F.when(s("y", "y") == 0, F.lit(1.0)).otherwise(spread("y"))
        std_a, std_b = beta_a * spread("a") / y_sd, beta_b * spread("b") / y_sd
        return F.struct(
            F.lit(m).alias("metric"),
            c("n").alias("n"),
            pearson_from(s("o", "y"), s("o", "o"), s("y", "y")).alias(f"pearson_r_{first}"),
            r_by.alias(f"pearson_r_{second}"),
            part(r_ay, r_by).alias(f"partial_r_{first}"),
            part(r_by, r_ay).alias(f"partial_r_{second}"),
            beta_a.alias(f"beta_{first}"),
            beta_b.alias(f"beta_{second}"),
            r2.alias("r2"),
            (r2 - r_by * r_by).alias(f"delta_r2_{first}"),
            (r2 - r_ay * r_ay).alias(f"delta_r2_{second}"),
            vif.alias(f"vif_{first}"),
            vif.alias(f"vif_{second}"),
            std_a.alias(f"std_beta_{first}"),
            std_b.alias(f"std_beta_{second}"),
            F.when(F.abs(std_a) > F.abs(std_b), F.lit(f"log2_{first}")).otherwise(F.lit(second)).alias("stronger"),
        )

    return _long(row, [entry(i, m) for i, m in enumerate(metrics)])


def with_partial_p(table: DataFrame, first: str = "context_len", second: str = "concern_count") -> DataFrame:
    """Add p-values; partial ones on n − 2 degrees of freedom, and on n − 3 as ``_df3``."""
    n = F.col("n")
    added = {}
    for f in (first, second):
        added[f"pearson_p_{f}"] = p_of_r(F.col(f"pearson_r_{f}"), n)
        r = F.col(f"partial_r_{f}")
        added[f"partial_p_{f}"] = p_of_r(r, n)
        t3 = F.when(n > 3, r * F.sqrt((n - 3) / _nz(1 - r * r)))
        added[f"partial_p_df3_{f}"] = F.when(n > 3, t_p_value(t3, n - 3))
    return table.withColumns(added)


def residual_table(df: DataFrame, x: Column, y: Column, z: Column, keep: Sequence[str]) -> DataFrame:
    """Per row the residuals of x and y given z, with the line through them."""
    work = df.select(*keep, x.cast("double").alias("_x"), y.cast("double").alias("_y"), z.cast("double").alias("_z"))
    row = moments(work, {"": {"x": F.col("_x"), "y": F.col("_y"), "z": F.col("_z")}})
    bx, by_ = (F.col(f"s_{v}_z") / _nz(F.col("s_z_z")) for v in ("x", "y"))
    fit = row.select(
        bx.alias("bx"),
        (F.col("mean_x") - bx * F.col("mean_z")).alias("ax"),
        by_.alias("by"),
        (F.col("mean_y") - by_ * F.col("mean_z")).alias("ay"),
        ((F.col("s_x_y") - bx * F.col("s_y_z")) / _nz(F.col("s_x_x") - bx * F.col("s_x_z"))).alias("line_slope"),
    )
    at = attach(work, fit, ())
    return at.select(
        *keep,
        (F.col("_x") - F.col("ax") - F.col("bx") * F.col("_z")).alias("x_residual"),
        (F.col("_y") - F.col("ay") - F.col("by") * F.col("_z")).alias("y_residual"),
        "line_slope",
        F.lit(0.0).alias("line_intercept"),
    )


# Fixed value: keeps the logarithm of zero away.
LOG_EPSILON = 1e-6


def positive_domain(df: DataFrame) -> DataFrame:
    """Rows whose logarithms exist; NaN, which Spark orders above every number, is not one of them."""
    numbers = ("context_len", "inference_time", "concern_count")
    known = reduce(and_, [~F.isnan(F.col(c).cast("double")) for c in numbers])
    return df.where("context_len > 0 AND inference_time > 0 AND concern_count >= 0").where(known)


def log_features(df: DataFrame) -> DataFrame:
    tokens = F.log(F.col("context_len") + LOG_EPSILON)
    return df.withColumns(
        {
            "log_tokens": tokens,
            "log_time": F.log(F.col("inference_time") + LOG_EPSILON),
            "log_tokens_x_concern": tokens * F.col("concern_count"),
        }
    )


def interaction_ols(df: DataFrame) -> DataFrame:
    """``ln(time) ~ ln(tokens) + concern + product`` on rows with ``log_features``."""
    names = ("log_tokens", "concern_count", "log_tokens_x_concern")
    return ols(df, F.col("log_time"), {c: F.col(c) for c in names})


def prediction_grid(df: DataFrame, fit: DataFrame) -> DataFrame:
    """Fitted time for every context length with every concern count, however many levels they have."""
    grid = attach(level_product(df, "context_len", "concern_count"), fit, ())
    log_tokens = F.log(F.col("context_len") + LOG_EPSILON)
    y = (
        F.col("intercept")
        + F.col("beta_log_tokens") * log_tokens
        + F.col("beta_concern_count") * F.col("concern_count")
        + F.col("beta_log_tokens_x_concern") * log_tokens * F.col("concern_count")
    )
    return grid.select("context_len", "concern_count", F.exp(y).alias("predicted_time"))
