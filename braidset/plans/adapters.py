"""Shape general tables into the inputs of the operators.

Every adapter reads whole tables and whole texts and stays row by row, except
``results``, which groups lines by order with a fixed-size state.
"""

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from braidset.functions.labels import empty_labels, label_array
from braidset.schemas import CONTEXT_WINDOWS, LABELS


# Prices become times; a prime divisor keeps means off the edges of decimal rounding.
SCALE = 977.0


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def label_at(n: Column) -> Column:
    return label_array()[F.pmod(n, F.lit(len(LABELS))).cast("int")]


def sha_of(id_: Column) -> Column:
    return F.md5(id_.cast("string"))


# The columns of label sets as bits.
BITS = ("predicted_bits", "actual_bits")

# Label sets as bits, in alphabetical order so that unpacking needs no sort.
_SORTED = sorted(LABELS)


_SETS = [[x for i, x in enumerate(_SORTED) if m >> i & 1] for m in range(1 << len(LABELS))]


def labels_in(mask: Column) -> Column:
    """The labels whose bit is set, sorted: one look into the list of all sets, which Spark folds to a constant."""
    sets = F.from_json(F.lit(json.dumps(_SETS)), "array<array<string>>")
    at = mask.cast("int").bitwiseAND(F.lit(len(_SETS) - 1))
    return F.coalesce(F.element_at(sets, at + 1), F.array().cast("array<string>"))


def canonical_bits(mask: Column) -> Column:
    """Bits by position in ``LABELS``, moved to alphabetical positions."""
    moved = [
        F.call_function("shiftleft", F.getbit(mask, F.lit(i)).cast("int"), F.lit(_SORTED.index(x)))
        for i, x in enumerate(LABELS)
    ]
    return sum(moved[1:], moved[0])


def _message() -> Column:
    return F.concat_ws(" ", "source", "lang", F.col("doc_id").cast("string"))


def atomic(spark, root) -> DataFrame:
    """Raw labelled records; every fifth label is in capitals with space around it."""
    label = label_at(F.col("doc_id"))
    noisy = F.concat(F.lit(" \t"), F.upper(label), F.lit(" \n"))
    return table(spark, root, "documents").select(
        F.when(F.col("doc_id") % 5 == 0, noisy).otherwise(label).alias("annotated_type"),
        _message().alias("masked_commit_message"),
        F.col("text").alias("git_diff"),
        sha_of(F.col("doc_id")).alias("sha"),
    )


def records(spark, root) -> DataFrame:
    """The same records with clean labels and short column names."""
    return table(spark, root, "documents").select(
        _message().alias("message"),
        F.col("text").alias("diff"),
        sha_of(F.col("doc_id")).alias("sha"),
        label_at(F.col("doc_id")).alias("type"),
    )


def excluded(spark, root) -> DataFrame:
    return table(spark, root, "labels").where("toxic = 1").select(sha_of(F.col("doc_id")).alias("sha"))


def existing(spark, root) -> DataFrame:
    return (
        table(spark, root, "labels")
        .where("quality = 0")
        .select(sha_of(F.col("doc_id")).alias("sha"), label_at(F.col("doc_id")).alias("annotated_type"))
    )


def tangled(spark, root) -> DataFrame:
    """Documents as multi-label cases: the text in 1 to 5 equal parts, as many labels."""
    n = (F.col("doc_id") % 5 + 1).cast("int")
    wide = F.greatest(F.ceil(F.length("text") / n), F.lit(1)).cast("int")
    width = F.col("width")
    each = lambda f: F.transform(F.sequence(F.lit(0), n - 1), f)
    return table(spark, root, "documents").withColumn("width", wide).select(
        "doc_id",
        _message().alias("commit_message"),
        each(lambda i: F.substring(F.col("text"), i * width + 1, width)).alias("diff"),
        n.alias("concern_count"),
        each(lambda i: F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), i.cast("string")))).alias("shas"),
        each(lambda i: label_at(F.col("doc_id") + i)).alias("types"),
    )


def _bit(n: Column) -> Column:
    bits = F.array(*[F.lit(1 << _SORTED.index(x)) for x in LABELS])
    return bits[F.pmod(n, F.lit(len(LABELS))).cast("int")]


def results(spark, root, predicted_by: str = "l_partkey", model: str = "alpha") -> DataFrame:
    """One answered case per order. Label sets are kept as bits while lines are grouped, and beside the lists."""
    masks = table(spark, root, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.bit_or(_bit(F.col("l_linenumber"))).alias("a"), F.bit_or(_bit(F.col(predicted_by))).alias("p")
    )
    orders = table(spark, root, "orders").select("o_orderkey", "o_totalprice")
    key = F.col("o_orderkey")
    actual = labels_in(F.col("a"))
    guess = labels_in(F.col("p"))
    contexts = F.array(*map(F.lit, CONTEXT_WINDOWS))
    joined = masks.join(orders, "o_orderkey")
    return joined.select(
        key.alias("row_id"),
        F.when(key % 50 == 0, empty_labels())
        .when(key % 53 == 0, F.sort_array(F.array_append(guess, F.lit("junk"))))
        .otherwise(guess)
        .alias("predicted_types"),
        actual.alias("actual_types"),
        (F.col("o_totalprice") / SCALE).alias("inference_time"),
        F.transform(actual, lambda t: F.md5(F.concat_ws("|", key.cast("string"), t))).alias("shas"),
        contexts[(key % 5).cast("int")].alias("context_len"),
        (key % 2 == 0).alias("with_message"),
        F.lit(model).alias("model"),
        F.when(key % 50 == 0, 0).otherwise(F.col("p")).alias("predicted_bits"),
        F.col("a").alias("actual_bits"),
    )


def line_cases(lines: DataFrame) -> DataFrame:
    """One answered case per line, row by row: works on a stream of lines as well."""
    bits = lines.select(
        canonical_bits(F.col("l_suppkey") % 128).alias("predicted_bits"),
        canonical_bits(F.col("l_partkey") % 127 + 1).alias("actual_bits"),
        (F.col("l_extendedprice") / SCALE).alias("inference_time"),
    )
    lists = {"predicted_types": labels_in(F.col("predicted_bits")), "actual_types": labels_in(F.col("actual_bits"))}
    return bits.withColumns(lists)


def responses(spark, root) -> DataFrame:
    """Answers of a model as text: clean, with prose around it, broken, or no list."""
    label = label_at(F.col("event_id"))
    other = label_at(F.col("event_id") + F.col("user_id"))
    clean = F.concat(F.lit('{"types": ["'), label, F.lit('", "'), other, F.lit('"]}'))
    form = F.col("event_id") % 4
    return table(spark, root, "events").select(
        "event_id",
        F.when(form == 0, clean)
        .when(form == 1, F.concat(F.lit("Sure: "), clean, F.lit(" as in "), F.col("event_type")))
        .when(form == 2, F.concat(F.lit('{"types": ["'), label))
        .otherwise(F.concat(F.lit('{"types": "'), label, F.lit('", "props": '), F.col("props"), F.lit("}")))
        .alias("response"),
    )


def explanations(spark, root) -> DataFrame:
    """Answers with a reasoning field: filled, absent, broken, or empty text."""
    form = F.col("event_id") % 4
    return table(spark, root, "events").select(
        "event_id",
        F.when(form == 0, F.concat(F.lit('{"reasoning": "  '), F.col("event_type"), F.lit(' seen  "}')))
        .when(form == 1, F.col("props"))
        .when(form == 2, F.concat(F.lit(" not json "), F.col("event_type"), F.lit(" ")))
        .otherwise(F.lit(""))
        .alias("response"),
    )
