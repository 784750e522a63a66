"""Mixing sources to target weights by Sainte-Lague apportionment, in SQL functions alone.

Token budgets become seats of ``block`` words. Sources get seats by the highest quotients
of their targets, the shards of a source by the highest quotients of their sizes, and in a
shard the documents follow each other in seeded order until its blocks are used up.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidset.llm.common import WORD, identified, written

#: Fixed values of the contract: weights of sources in code point order, share of all words, cap per source.
WEIGHTS = (3, 1, 2)
SHARE = (3, 2)
CAP = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(key: Column, text: Column, seed: int) -> Column:
    """32 hex digits that order rows by seed, key and text, so that rows of one key, or of none, are spread too."""
    of_text = F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")), of_text).cast("binary"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """One row per source: source, docs, source_size, target.

    Targets share ``share`` of all words by weight; none is above ``cap`` times its source,
    and what is cut goes to the others by weight. That is min(cap * size, level * weight) with
    one level for all: sources fill up in rising order of cap per weight, and the level is what
    the unfilled ones share. The table has a row per source, so its windows are small.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_n") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("_n", F.row_number().over(order)).withColumn("_w", weight.cast("long"))
    per = per.withColumn("_cap", F.col("source_size") * cap)
    rising = Window.orderBy(F.col("_cap") / F.col("_w"), "_n")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    budget = F.sum("source_size").over(whole) * F.lit(share[0]) / F.lit(share[1])
    left = budget - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    level = left / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    per = per.withColumn("_level", level)
    fits = F.when(F.col("_cap") / F.col("_w") >= F.col("_level"), F.col("_level"))
    # The first source, in rising order, that is not filled sets the level; later ones keep it.
    first = F.min_by(F.col("_level"), F.when(fits.isNotNull(), F.struct(F.col("_cap") / F.col("_w"), F.col("_n")))).over(whole)
    target = F.when(first.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), first * F.col("_w")))
    return per.select("source", "docs", "source_size", target.cast("double").alias("target"))


def sainte_lague(parties: DataFrame, by: list[str], party: list[str], weight: str, seats: str, name: str) -> DataFrame:
    """``parties`` with column ``name``: the seats each gets, in every group ``by``, by Sainte-Lague.

    ``seats`` is the group's number of seats, ``weight`` a party's votes. A quotient
    weight / (2k + 1) wins if it is among the highest ``seats``; ties go by ``party``.
    With divisor W / (seats - n/2) all rounded seats surely win, with W / (seats + n/2)
    at least ``seats`` do; only the quotients between are ranked, about two per party.
    """
    group = Window.partitionBy(*by)
    total, count = F.sum(weight).over(group), F.count(F.lit(1)).over(group)
    low = F.when(F.col(seats) * 2 > F.col("_n"), F.round(F.col(weight) * (F.col(seats) - F.col("_n") / 2) / F.col("_all") - F.lit(1e-6)))
    base = F.when((F.col("_all") > 0) & low.isNotNull(), F.greatest(low - 1, F.lit(0))).otherwise(0).cast("long")
    high = F.ceil(F.col(weight) * (F.col(seats) + F.col("_n") / 2) / F.col("_all")) + 1
    top = F.when(F.col("_all") > 0, high).otherwise(0).cast("long")
    rows = parties.withColumn("_all", total).withColumn("_n", count).withColumn("_base", base).withColumn("_top", top)
    open_seats = F.col(seats) - F.sum("_base").over(group)
    rows = rows.withColumn("_open", F.when(F.col("_all") > 0, open_seats).otherwise(0))
    steps = F.when((F.col("_top") > F.col("_base")) & (F.col(weight) > 0), F.sequence(F.col("_base"), F.col("_top") - 1))
    bids = rows.select(*by, *party, "_open", F.explode(steps).alias("_k"), F.col(weight).alias("_v"))
    bids = bids.withColumn("_q", F.col("_v") / (F.col("_k") * 2 + 1))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_q").desc(), *[F.col(p).asc_nulls_last() for p in party], "_k"))
    won = bids.withColumn("_r", rank).where("_r <= _open").groupBy(*by, *party).agg(F.count(F.lit(1)).alias("_won"))
    won = won.select(*[F.col(c).alias(f"_won_{c}") for c in [*by, *party]], "_won")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_won_{c}")) for c in [*by, *party]])
    got = (F.col("_base") + F.coalesce(F.col("_won"), F.lit(0))).alias(name)
    return rows.join(won, same, "left").select(*parties.columns, got)


def mix(
    docs: DataFrame,
    seed: int = 7,
    block: int = 8,
    shard_docs: int = 2048,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Per document: its key, source, size, source_size, target and the words ``taken``.

    A source's blocks are split over shards of about ``shard_docs`` documents (by hash of the
    key and the text), so that a source with a third of all rows is worked on in as many tasks as it needs.
    A shard whose blocks exceed its words gives every document again before any a third time:
    no document gives more than twice its words. ``taken`` div ``size`` is the number of whole
    copies, the rest the words of one more, cut one.

    Null and empty texts have size 0 and give 0; a null source is a source of its own, the last;
    null or repeated keys are rows like others (rows equal in key and text share their order and may swap);
    an empty table gives no row. Other columns play no part.
    """
    return mix_sizes(_sizes(docs, seed, key, text, source), block, shard_docs).drop("_row")


def _sizes(docs: DataFrame, seed: int, key: str, text: str, source: str, row: Column | None = None) -> DataFrame:
    """The narrow columns of the mix; the texts are read once for them."""
    sizes = docs.select(
        (F.lit(0) if row is None else row).alias("_row"), F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"),
        word_count(F.col(text)).alias("size"), seeded(F.col(key), F.col(text), seed).alias("_seeded"),
    )
    return written(sizes, "mix-sizes")


def mix_sizes(sizes: DataFrame, block: int = 8, shard_docs: int = 2048) -> DataFrame:
    """``mix`` over columns _row, doc_id, source, size and _seeded.

    Small tables, with a row for each source or shard, are written, so that later steps read them and plan anew.
    """
    targets = source_targets(sizes)
    # The targets add up to the share of all words; in whole numbers, so that no rounding of sums decides a seat.
    words = F.sum("source_size").over(Window.partitionBy())
    all_seats = F.floor((words * (2 * SHARE[0]) + SHARE[1] * block) / F.lit(2 * SHARE[1] * block)).cast("long")
    seated = sainte_lague(targets.withColumn("_seats", all_seats), [], ["source"], "target", "_seats", "_blocks").drop("_seats")
    seated = written(seated.withColumn("_shards", F.ceil(F.col("docs") / shard_docs).cast("long")), "mix-sources")
    # A row per source: small beside the documents, whose shuffle by source this spares where it fits.
    placed = sizes.join(seated.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "inner")
    placed = placed.withColumn("_shard", F.conv(F.substring("_seeded", 1, 8), 16, 10).cast("long") % F.col("_shards"))
    shards = written(placed.groupBy("source", "_shard").agg(F.sum("size").alias("_words"), F.first("_blocks").alias("_blocks")), "mix-shards")
    quotas = sainte_lague(shards, ["source"], ["_shard"], "_words", "_blocks", "_quota")
    quotas = written(quotas.select(F.col("source").alias("_qs"), F.col("_shard").alias("_qk"), "_words", "_quota"), "mix-quotas")
    rows = placed.join(quotas, F.col("source").eqNullSafe(F.col("_qs")) & (F.col("_shard") == F.col("_qk")))
    order = Window.partitionBy("source", "_shard").orderBy("_seeded", "doc_id", "size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    budget = F.least(F.col("_quota") * block, F.col("_words") * CAP)
    whole = F.when(F.col("_words") > 0, F.floor(budget / F.col("_words"))).otherwise(0).cast("long")
    rest = budget - whole * F.col("_words") - F.col("_before")
    taken = whole * F.col("size") + F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    return rows.select("_row", "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply_mix(docs: DataFrame, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source", rows: Column | None = None) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: each as many times as it was taken whole,
    and once more cut after its last taken word where a part was taken. Documents of no words stay once.

    Every row follows its own plan: null and repeated keys, and rows equal in all columns, are told apart by the row
    (``rows``, see ``identified``). Null and empty texts stay once; an empty table gives no row; all columns stay, whatever their names.
    """
    numbered, row = identified(docs, "mix-docs", rows)
    plan = mix_sizes(_sizes(numbered, seed, key, text, source, F.col(row))).select(F.col("_row").alias("_at"), F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    texts = numbered.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(row).alias("_number"), F.col(text).alias("_text"))
    texts = texts.join(plan, F.col("_number") == F.col("_at"))
    copies = F.when(F.col("_size") == 0, 1).otherwise(F.floor(F.col("_taken") / F.col("_size")))
    part = F.when(F.col("_size") == 0, 0).otherwise(F.col("_taken") % F.col("_size"))
    pieces = F.regexp_extract_all(F.col("_text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(pieces, 1, F.col("_part").cast("int")), "")
    rest = F.when(F.col("_part") > 0, F.array(head)).otherwise(F.array().cast("array<string>"))
    texts = texts.withColumn("_part", part).withColumn("_taken_text", F.explode(F.concat(F.array_repeat(F.col("_text"), copies.cast("int")), rest)))
    return texts.select(*[(F.col("_taken_text") if c == text else F.col("_row")[c]).alias(c) for c in docs.columns])
