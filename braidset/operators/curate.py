"""From raw labelled records to a balanced sample and its train/test split."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from braidset.functions.labels import normalize_type
from braidset.functions.tokens import tokens_of
from braidset.operators.ranking import dense_index, seeded_key, seeded_split, seeded_take
from braidset.plans.staging import stage
from braidset.schemas import LABELS, SAMPLES_PER_TYPE, SEED, TOKEN_LIMIT, TRAIN_SHARE

Counter = Callable[[Column], Column]

# Column names of raw records and their short forms.
SHORT_NAMES = {
    "masked_commit_message": "message",
    "git_diff": "diff",
    "sha": "sha",
    "annotated_type": "type",
}


def rename_select(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(SHORT_NAMES).select(*SHORT_NAMES.values())


def stringify(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def normalize(df: DataFrame, col: str = "annotated_type") -> DataFrame:
    return df.withColumn(col, normalize_type(F.col(col)))


def exclude_by_sha(df: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop records on the list. Spark broadcasts the list when its size allows."""
    return df.join(excluded.select("sha"), "sha", "left_anti")


def exclude_existing(df: DataFrame, existing: DataFrame) -> DataFrame:
    return df.join(existing.select("sha"), "sha", "left_anti")


def record_tokens(diff: Column, message: Column, count: Counter | None = None) -> Column:
    """Tokens of diff, a space and message; without a counter of one's own the joined text is not built."""
    if count is not None:
        return count(F.concat_ws(" ", F.coalesce(diff, F.lit("")), F.coalesce(message, F.lit(""))))
    chars = lambda c: F.length(F.coalesce(c, F.lit("")))
    return tokens_of(chars(diff) + 1 + chars(message))


def within_token_limit(
    df: DataFrame, limit: int = TOKEN_LIMIT, diff="git_diff", message="masked_commit_message", count: Counter | None = None
):
    return df.where(record_tokens(F.col(diff), F.col(message), count) <= limit)


def valid_types(df: DataFrame, col: str = "annotated_type", counts: Observation | None = None):
    """Keep the known labels; ``counts`` receives kept and dropped rows when the job runs."""
    known = F.coalesce(F.col(col).isin(*LABELS), F.lit(False))
    if counts is not None:
        df = df.observe(counts, F.count_if(known).alias("kept"), F.count_if(~known).alias("dropped"))
    return df.where(known)


def type_counts(df: DataFrame, col: str = "annotated_type") -> DataFrame:
    return df.groupBy(col).count().orderBy(F.desc("count"), col)


def distinct_types(df: DataFrame, col: str = "annotated_type") -> DataFrame:
    return df.select(col).distinct()


def topup_sample(
    pool: DataFrame,
    existing_counts: DataFrame,
    target: int = SAMPLES_PER_TYPE,
    seed: int = SEED,
    type_col: str = "annotated_type",
    keys: DataFrame | None = None,
) -> DataFrame:
    """Per type, as many records as ``target`` lacks, in seeded order.

    ``existing_counts`` has ``type_col`` and ``count``. Texts are only read to be
    written: the cut is found in the keys (``keys``: the pool's type and sha).
    """
    have = existing_counts.select(type_col, F.col("count").alias("_have"))
    need = F.greatest(F.lit(0), F.lit(target) - F.coalesce(F.col("_have"), F.lit(0)))
    key = seeded_key(F.col("sha"), seed=seed)
    return seeded_take(pool, key, lambda _: need, [type_col], have, keys)


def curate(
    pool: DataFrame,
    excluded: DataFrame,
    existing: DataFrame,
    existing_counts: DataFrame | None = None,
    target: int = SAMPLES_PER_TYPE,
    limit: int = TOKEN_LIMIT,
    seed: int = SEED,
    count: Counter | None = None,
) -> DataFrame:
    """The whole curation: exclusions, normalising, limits, balanced top-up. ``count`` counts a text's tokens.

    Cheap tests come first: the label test needs no text and trims the rows the
    joins and the length test see. The survivors' keys are written once, so the
    texts are read twice: for their lengths, and for the sample.
    """
    if existing_counts is None:
        existing_counts = type_counts(valid_types(normalize(existing)))
    clean = valid_types(normalize(pool))
    clean = exclude_existing(exclude_by_sha(clean, excluded), existing)
    if count is not None:
        # A tokenizer is dear: the records it lets through are written with their texts, not counted twice.
        clean = stage(within_token_limit(clean, limit, count=count), "counted")
    else:
        clean = within_token_limit(clean, limit)
    keys = stage(clean.select("annotated_type", "sha"), "keys")
    return topup_sample(clean, existing_counts, target, seed, keys=keys)


def curation_counts(pool, excluded, existing, limit: int = TOKEN_LIMIT, count: Counter | None = None) -> DataFrame:
    """How many records each step removes, in the order of the steps."""
    mark = lambda df, name: df.select("sha").distinct().withColumn(name, F.lit(True))
    flagged = (
        normalize(pool)
        .select(
            "sha",
            F.coalesce(F.col("annotated_type").isin(*LABELS), F.lit(False)).alias("known"),
            (record_tokens(F.col("git_diff"), F.col("masked_commit_message"), count) > limit).alias("long"),
        )
        .join(mark(excluded, "ex"), "sha", "left")
        .join(mark(existing, "old"), "sha", "left")
    )
    step = (
        F.when(F.col("ex"), F.lit("excluded"))
        .when(F.col("old"), F.lit("existing"))
        .when(F.col("long"), F.lit("over_limit"))
        .when(~F.col("known"), F.lit("unknown_type"))
        .otherwise(F.lit("kept"))
    )
    return flagged.groupBy(step.alias("step")).count()


def split_by_type(
    df: DataFrame, share: float = TRAIN_SHARE, seed: int = SEED, type_col: str = "type"
) -> DataFrame:
    """Add ``split``: the first ``floor(share * n)`` of each type by seeded order train, the rest test."""
    flagged = seeded_split(
        df,
        seeded_key(F.col("sha"), seed=seed),
        lambda n: F.floor(n * F.lit(share)),
        [type_col],
        flag="_train",
    )
    side = F.when(F.col("_train"), F.lit("train")).otherwise(F.lit("test"))
    return flagged.withColumn("split", side).drop("_train")


def sample_n(df: DataFrame, n: int, key: Sequence[str] = ("sha",), seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows with a new ``row_idx``; the job stops when there are fewer."""
    chosen = seeded_take(df, seeded_key(*map(F.col, key), seed=seed), lambda _: F.lit(n))
    keyed = chosen.withColumn("_key", seeded_key(*map(F.col, key), seed=seed))
    indexed = dense_index(
        keyed, [F.substring("_key", 1, 4)], ["_key", *key], name="row_idx", size="_size"
    )
    short = F.raise_error(F.concat(F.lit(f"cannot sample {n} rows, found "), F.col("_size")))
    enough = F.when(F.col("_size") >= n, F.lit(True)).otherwise(short.cast("boolean"))
    return indexed.where(enough).select("row_idx", *df.columns)


def sample_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("concern_count").alias("min_concern"),
        F.max("concern_count").alias("max_concern"),
        F.avg("concern_count").alias("mean_concern"),
        F.lit("types" in df.columns).alias("has_types"),
        F.lit("shas" in df.columns).alias("has_shas"),
    )


def type_documents(df: DataFrame, seed: int = SEED) -> DataFrame:
    """One text document per record: ``type``, ``file_name``, ``content``.

    The ordinal counts the records of a type in seeded order.
    """
    keyed = df.withColumn("_key", seeded_key(F.col("sha"), seed=seed))
    numbered = dense_index(
        keyed, [F.substring("_key", 1, 4)], ["_key", "sha"], ["annotated_type"], "_at"
    )
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    # The header lines of a stored document.
    content = F.concat_ws(
        "\n",
        F.concat(F.lit("# Type: "), F.col("annotated_type")),
        F.concat(F.lit("# Commit Message: "), text("masked_commit_message")),
        F.concat(F.lit("# SHA: "), F.col("sha")),
        F.lit(""),
        F.lit("# === Git Diff Content ==="),
        F.lit(""),
        text("git_diff"),
    )
    name = F.concat_ws("_", "annotated_type", (F.col("_at") + 1).cast("string"), "sha")
    return numbered.select(
        F.col("annotated_type").alias("type"),
        F.concat(name, F.lit(".diff")).alias("file_name"),
        content.alias("content"),
    )
