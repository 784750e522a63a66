"""Row-by-row comparison of two models on the same cases."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

# The outcomes of a comparison, and the metrics compared.
RELATIONS = ("LLM>SLM", "Equal", "SLM>LLM")
UNKNOWN = "Unknown"
METRICS = ("precision", "recall", "f1", "exact_match")
# What tells the cases of a result log apart.
LOG_KEY = ("context_len", "with_message", "shas")
COPY_CHUNK = 100_000


def numeric(df: DataFrame, col: str) -> Column:
    """The metric as a double; text that is no number, and NaN, become NULL."""
    c = F.col(col)
    if dict(df.dtypes)[col] == "string":
        flags = {"true": 1.0, "false": 0.0}
        word = F.lower(c)
        c = F.when(word == "true", flags["true"]).when(word == "false", flags["false"]).otherwise(
            c.try_cast("double")
        )
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def pair_models(
    slm: DataFrame, llm: DataFrame, key: Sequence[str] = ("row_id",), metrics: Sequence[str] = METRICS
) -> DataFrame:
    """The cases both models answered, with ``<metric>_SLM`` and ``<metric>_LLM``. ``key`` tells the cases apart; logs without one go through ``pair_logs``."""
    key = list(key)
    side = lambda df, tag: df.select(*key, *[numeric(df, m).alias(f"{m}_{tag}") for m in metrics])
    return side(slm, "SLM").join(side(llm, "LLM"), key)


def pair_logs(
    slm: DataFrame,
    llm: DataFrame,
    key: Sequence[str] = LOG_KEY,
    metrics: Sequence[str] = METRICS,
    counts: Observation | None = None,
) -> DataFrame:
    """``pair_models`` for result logs, whose rows have no id: paired by ``key``, and copies one to one.

    Rows that agree in the key are told apart by ``copy``, their number among them in the order of their
    metrics; what one log has more of stays unpaired. Rows equal in key and metrics are counted, not numbered: each
    such group is a range of copies, and ranges that overlap pair. ``counts`` receives ``pairs`` and ``repeats`` (pairs
    beyond the first of a key) when the job runs. NULLs in the key are equal to each other.
    """
    key = list(key)

    def side(df, tag):
        values = [f"{m}_{tag}" for m in metrics]
        # Structs are equal where they hold NULLs, and the join takes the window's partitions as they are.
        rows = df.select(F.struct(*key).alias("_key"), *[numeric(df, m).alias(v) for m, v in zip(metrics, values)])
        groups = rows.groupBy("_key", *values).agg(F.count(F.lit(1)).alias("_n"))
        # As many rows as a key has different outcomes.
        upto = Window.partitionBy("_key").orderBy(*values).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = F.sum("_n").over(upto)
        return groups.withColumns({f"_to_{tag}": last, f"_from_{tag}": last - F.col("_n")}).drop("_n")

    first, last = F.greatest("_from_SLM", "_from_LLM"), F.least("_to_SLM", "_to_LLM")
    met = side(slm, "SLM").join(side(llm, "LLM"), "_key").where(first < last)
    # In chunks: no row holds the list of all its copies.
    pairs = (
        met.withColumn("_at", F.explode(F.sequence(first, last - 1, F.lit(COPY_CHUNK))))
        .withColumn("copy", F.explode(F.sequence("_at", F.least(F.col("_at") + COPY_CHUNK, last) - 1)))
        .select("_key.*", "copy", *[f"{m}_{tag}" for tag in ("SLM", "LLM") for m in metrics])
    )
    if counts is not None:
        pairs = pairs.observe(counts, F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("copy") > 0).alias("repeats"))
    return pairs


def relation(llm: Column, slm: Column) -> Column:
    return (
        F.when(llm.isNull() | slm.isNull(), F.lit(UNKNOWN))
        .when(llm > slm, F.lit(RELATIONS[0]))
        .when(llm == slm, F.lit(RELATIONS[1]))
        .otherwise(F.lit(RELATIONS[2]))
    )


def compare_models(pairs: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    return pairs.withColumns(
        {f"relation_{m}": relation(F.col(f"{m}_LLM"), F.col(f"{m}_SLM")) for m in metrics}
    )


def comparison_summary(
    compared: DataFrame, key: Sequence[str] = ("row_id",), metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Wins per case over all metrics and their pattern as text."""
    cols = [f"relation_{m}" for m in metrics]
    wins = lambda value: sum((F.col(c) == value).cast("int") for c in cols)
    names = ("llm_wins_count", "equal_count", "slm_wins_count")
    counted = compared.select(*key, *cols, *[wins(v).alias(n) for v, n in zip(RELATIONS, names)])
    a, b, c = [F.col(n).cast("string") for n in names]
    pattern = F.concat(F.lit("LLM_"), a, F.lit("_Equal_"), b, F.lit("_SLM_"), c)
    return counted.withColumn("overall_pattern", pattern)


def metric_table(
    compared: DataFrame, key: Sequence[str] = ("row_id",), metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Long form: one line per case and metric."""
    lines = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(f"{m}_SLM").alias("slm"),
            F.col(f"{m}_LLM").alias("llm"),
            F.col(f"relation_{m}").alias("relation"),
        )
        for m in metrics
    ]
    return compared.select(*key, F.explode(F.array(*lines)).alias("l")).select(*key, "l.*")


def relation_distribution(compared: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Count of each relation per metric, zeros included, in fixed order."""
    row = compared.agg(
        *[
            F.count_if(F.col(f"relation_{m}") == r).alias(f"{m}|{r}")
            for m in metrics
            for r in (*RELATIONS, UNKNOWN)
        ]
    )
    lines = [
        F.struct(
            F.lit(m).alias("metric"),
            F.lit(i).alias("position"),
            F.lit(r).alias("comparison_type"),
            F.col(f"{m}|{r}").alias("count"),
        )
        for m in metrics
        for i, r in enumerate((*RELATIONS, UNKNOWN))
    ]
    return row.select(F.explode(F.array(*lines)).alias("l")).select("l.*")


def _only(winner: str, loser: str) -> Column:
    return (F.col(f"exact_match_{winner}") == 1.0) & (F.col(f"exact_match_{loser}") == 0.0)


def accuracy_breakdown(pairs: DataFrame) -> DataFrame:
    slm, llm = F.col("exact_match_SLM"), F.col("exact_match_LLM")
    return pairs.agg(
        F.count_if((slm == 1.0) & (llm == 1.0)).alias("both_correct"),
        F.count_if(_only("LLM", "SLM")).alias("only_llm_correct"),
        F.count_if(_only("SLM", "LLM")).alias("only_slm_correct"),
        F.count_if((slm == 0.0) & (llm == 0.0)).alias("both_wrong"),
    )


def rows_won_only_by(
    source: DataFrame, pairs: DataFrame, winner: str, key: Sequence[str] = ("row_id",)
) -> DataFrame:
    """Full rows of ``source`` for the cases only ``winner`` ("SLM" or "LLM") got exactly right."""
    loser = {"SLM": "LLM", "LLM": "SLM"}[winner]
    won = pairs.where(_only(winner, loser)).select(*key)
    return source.join(won, list(key), "left_semi")
