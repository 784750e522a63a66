"""Macro metrics, token histograms and label distributions."""

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from braidset.functions.labels import parse_labels
from braidset.functions.tokens import token_count, token_range
from braidset.operators.quantiles import exact_quantiles
from braidset.operators.ranking import attach, dense_index, number_level
from braidset.plans.staging import stage
from braidset.schemas import RESULT_METRICS, TOKEN_RANGES

RANGE_NAMES = tuple(name for _, name in TOKEN_RANGES)


def _mean(c) -> Column:
    return F.avg(F.col(c).cast("double"))


def macro_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means of the case metrics, over all rows or per group."""
    missing = [c for c in RESULT_METRICS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns for macro metrics: {missing}")
    return df.groupBy(*by).agg(
        _mean("precision").alias("macro_precision"),
        _mean("recall").alias("macro_recall"),
        _mean("f1").alias("macro_f1"),
        _mean("exact_match").alias("macro_accuracy"),
        _mean("hamming_loss").alias("macro_hamming_loss"),
        _mean("inference_time").alias("inference_time_avg"),
        F.count(F.lit(1)).alias("num_samples"),
    )


def macro_by_concern(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    keys = [*by, "concern_count"]
    return macro_metrics(df, keys).orderBy(*keys)


def token_table(
    df: DataFrame, text: str, row_id: str, count: Callable[[Column], Column] = token_count
) -> DataFrame:
    """``row_idx, token_count, token_range`` of every row whose text is not NULL; ``count`` counts a text's tokens."""
    counted = df.where(F.col(text).isNotNull()).select(
        F.col(row_id).alias("row_idx"), count(F.col(text)).alias("token_count")
    )
    return counted.withColumn("token_range", token_range(F.col("token_count")))


def token_histogram(tokens: DataFrame) -> DataFrame:
    """All ranges in order with count and percent; ranges without rows show zero."""
    counts = [F.count_if(F.col("token_range") == n).alias(f"c{i}") for i, n in enumerate(RANGE_NAMES)]
    row = tokens.agg(F.count(F.lit(1)).alias("n"), *counts)
    percent = lambda c: F.coalesce(F.bround(F.try_divide(c, F.col("n")) * 100.0, 1), F.lit(0.0))
    lines = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("token_range"),
            F.col(f"c{i}").alias("count"),
            percent(F.col(f"c{i}")).alias("percentage"),
        )
        for i, name in enumerate(RANGE_NAMES)
    ]
    return row.select(F.explode(F.array(*lines)).alias("l")).select("l.*")


def token_thresholds(histogram: DataFrame) -> DataFrame:
    """Sums of the rounded percentages up to three limits."""
    upto = lambda i: F.coalesce(F.sum(F.when(F.col("position") <= i, F.col("percentage"))), F.lit(0.0))
    return histogram.agg(upto(0).alias("le_1024"), upto(2).alias("le_4096"), upto(3).alias("le_8192"))


def token_stats(tokens: DataFrame) -> DataFrame:
    """Rows, median, mean and range of the token counts, whole numbers; the median is found by counting."""
    whole = tokens.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.avg("token_count").cast("int").alias("mean_tokens"),
        F.min("token_count").alias("min_tokens"),
        F.max("token_count").alias("max_tokens"),
    )
    median = exact_quantiles(tokens, "token_count", {"median": 0.5}).select(F.col("median").cast("int").alias("median_tokens"))
    return attach(whole, median, ()).select("total_samples", "median_tokens", "mean_tokens", "min_tokens", "max_tokens")


def label_combinations(df: DataFrame, types: str = "types") -> DataFrame:
    """Sorted label set, count, percent and the number of distinct sets; unparsable rows are left out."""
    listed = F.col(types)
    if not dict(df.dtypes)[types].startswith("array"):
        listed = F.from_json(types, "array<string>")
    counts = (
        df.select(listed.alias("_t"))
        .where(F.col("_t").isNotNull())
        .groupBy(F.array_join(F.array_sort("_t"), ", ").alias("combination"))
        .count()
    )
    whole = counts.agg(F.sum("count").alias("_all"), F.count(F.lit(1)).alias("unique_combinations"))
    share = F.bround(F.col("count") * 100.0 / F.col("_all"), 1)
    return (
        attach(counts, whole, ())
        .select("combination", "count", share.alias("percentage"), "unique_combinations")
        .orderBy(F.desc("count"), "combination")
    )


def tokens_by_concern(df: DataFrame, tokens: str = "token_length") -> DataFrame:
    """Per concern count the share of each range up to 16384; longer rows count in the total only."""
    names = RANGE_NAMES[:5]
    inside = [F.count_if(token_range(F.col(tokens)) == n).alias(f"c{i}") for i, n in enumerate(names)]
    grouped = df.groupBy("concern_count").agg(F.count(F.lit(1)).alias("total"), *inside)
    lines = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(n).alias("token_range"),
            F.col(f"c{i}").alias("count"),
            F.bround(F.col(f"c{i}") * 100.0 / F.col("total"), 1).alias("percentage"),
        )
        for i, n in enumerate(names)
    ]
    return grouped.select("concern_count", "total", F.explode(F.array(*lines)).alias("l")).select(
        "concern_count", "total", "l.*"
    )


def dataset_basics(df: DataFrame, tokens: str = "token_length") -> DataFrame:
    """Rows per concern count beside the token range of the whole table, from one pass."""
    per_count = df.groupBy("concern_count").agg(
        F.count(F.lit(1)).alias("count"),
        F.min(tokens).alias("_min"),
        F.max(tokens).alias("_max"),
        F.sum(tokens).alias("_sum"),
    )
    whole = Window.partitionBy()
    return per_count.select(
        "concern_count",
        "count",
        F.min("_min").over(whole).alias("min_tokens"),
        F.max("_max").over(whole).alias("max_tokens"),
        (F.sum("_sum").over(whole) / F.sum("count").over(whole)).alias("mean_tokens"),
    ).orderBy("concern_count")


def descriptives(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long table: column, mean, std, min, max."""
    x = lambda c: F.col(c).cast("double")
    row = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.avg(x(c)).alias("mean"),
                F.stddev_samp(x(c)).alias("std"),
                F.min(x(c)).alias("min"),
                F.max(x(c)).alias("max"),
            ).alias(f"_{i}")
            for i, c in enumerate(cols)
        ]
    )
    return row.select(F.explode(F.array(*row.columns)).alias("s")).select("s.*")


def sorted_levels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the sorted distinct values of each factor."""
    return df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in cols])


def level_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column, position, level``: the sorted distinct values of numeric factors as rows, however many there are."""
    parts = []
    for c in cols:
        levels = df.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("level")).distinct()
        x = F.col("level")
        placed = dense_index(levels, [number_level(x, 10), number_level(x, 20)], ["level"], name="position")
        parts.append(placed.select(F.lit(c).alias("column"), "position", "level"))
    return reduce(DataFrame.unionByName, parts)


def level_product(df: DataFrame, first: str, second: str) -> DataFrame:
    """Every level of ``first`` with every level of ``second``: the pairs are numbered and looked up, dealt by range."""
    levels = stage(level_table(df, (first, second)), "levels")
    sizes = levels.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["column"]: r["n"] for r in sizes.collect()}
    n, m = counts.get(first, 0), counts.get(second, 0)
    numbers = df.sparkSession.range(n * m)
    side = lambda c, at: levels.where(F.col("column") == c).select(F.col("position").alias(at), F.col("level").alias(f"_{at}"))
    placed = numbers.select(F.expr(f"id div {max(m, 1)}").alias("a"), (F.col("id") % max(m, 1)).alias("b"))
    found = placed.join(side(first, "a"), "a").join(side(second, "b"), "b")
    types = dict(df.dtypes)
    return found.select(F.col("_a").cast(types[first]).alias(first), F.col("_b").cast(types[second]).alias(second))


def dataset_manifest(configurations: dict[str, DataFrame]) -> DataFrame:
    """Row count and column names of every configuration."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("num_rows")).select(
            F.lit(name).alias("configuration"), "num_rows", F.lit(", ".join(df.columns)).alias("columns")
        )
        for name, df in configurations.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def manifest_with_files(configurations: dict[str, DataFrame], files: DataFrame, folders: dict[str, str]) -> DataFrame:
    """``dataset_manifest`` with ``files`` and ``bytes`` of each configuration and whether any are ``missing``.

    ``files`` has ``path, bytes`` (a listing, contents unread); ``folders`` says in which folder a configuration lies. A
    configuration without files stays in the table, with no rows.
    """
    inside = F.lit(None).cast("string")
    for name, folder in folders.items():
        inside = F.when(F.contains(F.col("path"), F.lit(f"/{folder.strip('/')}/")), F.lit(name)).otherwise(inside)
    sizes = files.select(inside.alias("configuration"), "bytes").groupBy("configuration").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")
    )
    zero = F.lit(0).cast("bigint")
    wanted = files.sparkSession.createDataFrame([(n,) for n in folders], "configuration string")
    rows = wanted.join(dataset_manifest(configurations), "configuration", "left").join(sizes, "configuration", "left")
    rows = rows.withColumns({c: F.coalesce(c, zero) for c in ("num_rows", "files", "bytes")})
    return rows.withColumn("missing", F.col("files") == 0)


def parsed_types(df: DataFrame, col: str = "types") -> DataFrame:
    return df.withColumn(col, parse_labels(F.col(col)))
