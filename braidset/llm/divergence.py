"""How sources of a language differ in their terms, in exact whole numbers.

Smoothed shares p of every kept term in every group (lang, source) are compared between groups by
sums of floor((p - q)^2 / q). Most terms are absent from most groups, so a sum over all terms is that
for two absent counts, plus corrections for terms present in one of the two groups, plus corrections
for terms present in both. The last come from frequent-pattern trees: each term's row of nonzero
counts, in the order of sources, is a path; rows that begin alike share its nodes, and each node adds
its correction with each ancestor once, times the terms that pass through it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidset.llm.common import written
from braidset.llm.scan import Texts, coded, gaps, lowered, steps

#: Fixed values of the contract: the scale of shares, the documents a kept term is in, the ranks of terms.
SCALE, LEAST_DOCS, RANKS = 1_000_000_000, 3, 200
#: Bytes of texts of a step, and rows of counts a task holds.
STEP, HELD = 4 << 20, 500_000
_LETTERS = lowered(gaps("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))


def _pairs_once(owner: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(owner * size + code)
    return both // size, both % size


def _counted(part: pa.RecordBatch) -> pa.Table | None:
    """Occurrences and documents of each term in each group of one step."""
    texts = Texts(part.column(2))
    words, n = texts.words(_LETTERS)
    code, terms = coded(words)
    if not len(terms):
        return None
    lang, langs = coded(part.column(0))
    source, sources = coded(part.column(1))
    group = lang * len(sources) + source
    owner = np.repeat(np.arange(len(texts)), n)
    keys, seen = np.unique(group[owner] * len(terms) + code, return_counts=True)
    doc, term = _pairs_once(owner, code, len(terms))
    # The same keys, as every occurrence is in some document.
    docs = np.unique(group[doc] * len(terms) + term, return_counts=True)[1]
    of, term = keys // len(terms), keys % len(terms)
    columns = [langs.take(pa.array(of // len(sources))), sources.take(pa.array(of % len(sources))), terms.take(pa.array(term)), pa.array(seen, pa.int64()), pa.array(docs, pa.int64())]
    return pa.table(columns, names=["lang", "source", "term", "n", "docs"])


def _counts(batches):
    """Counts of a task's documents, added up where they are until their rows are too many to hold."""
    held, rows = [], 0
    for batch in batches:
        for part in steps(batch, 2, STEP):
            found = _counted(part)
            if found is None:
                continue
            held.append(found)
            rows += len(found)
            if rows > 2 * HELD:
                held = [_added(held)]
                rows = len(held[0])
                if rows > HELD:
                    yield from held[0].to_batches(1 << 16)
                    held, rows = [], 0
    if held:
        yield from _added(held).to_batches(1 << 16)


def _added(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return whole.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exact at any size."""
    over = f"({total} + {kept})"
    wide = f"CAST((CAST({count} + 1 AS DECIMAL(20, 0)) * {SCALE}) div CAST({over} AS DECIMAL(20, 0)) AS BIGINT)"
    return F.expr(f"1 + CASE WHEN {count} < {2**62 // SCALE} THEN ({count} + 1) * CAST({SCALE} AS BIGINT) div {over} ELSE {wide} END")


def gap(p: str, q: str) -> str:
    """floor((p - q)^2 / q): below 2^63, as shares reach little above SCALE."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents with the term. ``docs``: lang, source, text, no nulls."""
    found = docs.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """``lang, term, total, row``: terms in ``least`` documents of their language, and the nonzero counts by source, in its order."""
    row = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("row")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), row)
    return kept.where(F.col("docs") >= least).drop("docs")


def group_sizes(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """``lang, source, size, lang_size, kept, absent`` of every group: its words, its language's words and kept terms, and the share of a term it lacks."""
    sizes = terms.select("lang", F.explode("row").alias("r")).groupBy("lang", F.col("r.source").alias("source")).agg(F.sum("r.n").alias("size"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_size"))
    zero = F.lit(0).cast("long")
    out = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    out = out.withColumns({c: F.coalesce(c, zero) for c in ("size", "kept", "lang_size")})
    return out.withColumn("absent", F.when(F.col("kept") > 0, share("CAST(0 AS BIGINT)", "size", "kept")))


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _tree(batches):
    """Corrections of node and ancestor, summed by pair of sources, from rows in order.

    Rows come as lang, row (source, share, share of an absent term) and how many terms have it.
    A node starts at the row where its path first differs from the row before, and ends where it next does.
    Each batch is a tree of its own: its corrections add up with those of others.
    """
    for batch in batches:
        langs, rows, times = batch.column(0), batch.column(1), np.asarray(batch.column(2))
        ends = np.asarray(rows.offsets)
        ends = ends - ends[0]
        starts, lengths = ends[:-1], np.diff(ends)
        sources, p, absent = rows.flatten().flatten()
        source, names = coded(sources)
        p, absent = np.asarray(p), np.asarray(absent)
        lang, langs = coded(langs)
        depth = np.arange(len(source)) - np.repeat(starts, lengths)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        # A row shares an item with the one before if that holds it at the same depth, and all before it are shared.
        before = np.maximum(np.repeat(np.concatenate([[0], starts[:-1]]), lengths) + depth, 0)
        there = (owner > 0) & (depth < np.concatenate([[0], lengths[:-1]])[owner])
        before = np.where(there, before, 0)
        same = there & (source[before] == source) & (p[before] == p) & (lang[np.maximum(owner - 1, 0)] == lang[owner])
        unlike = np.cumsum(~same) - (np.cumsum(~same) - ~same)[starts[owner]]
        opens = np.flatnonzero(unlike > 0)
        opens = opens[np.lexsort((owner[opens], depth[opens]))]
        # At one depth a node lasts until the next opens there, or a row is too short or differs above: rows with an item at that depth, in order.
        order = np.lexsort((owner, depth))
        reach = np.concatenate([[0], np.cumsum(times[owner[order]])])
        first = np.searchsorted(depth[order] * (len(lengths) + 1) + owner[order], depth[opens] * (len(lengths) + 1) + owner[opens])
        last = np.append(first[1:], len(order))
        mult = reach[last] - reach[first]
        # Every node with its ancestors, which stand before it in the row that opens it.
        up = depth[opens]
        node = np.repeat(opens, up)
        above = np.repeat(starts[owner[opens]], up) + np.arange(len(node)) - np.repeat(np.cumsum(up) - up, up)
        weight = np.repeat(mult, up)
        for own, other in ((node, above), (above, node)):
            key = (lang[owner[own]] * len(names) + source[own]) * len(names) + source[other]
            value = _gaps(p[own], p[other]) - _gaps(p[own], absent[other]) - _gaps(absent[own], p[other]) + _gaps(absent[own], absent[other])
            found, at = np.unique(key, return_inverse=True)
            high, low = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
            # In two halves, whose sums can't overflow.
            np.add.at(high, at, (value >> 32) * weight)
            np.add.at(low, at, (value & 0xFFFFFFFF) * weight)
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(found // len(names) ** 2)), names.take(pa.array(found // len(names) % len(names))), names.take(pa.array(found % len(names))), pa.array(high), pa.array(low)],
                names=["lang", "source", "item", "high", "low"],
            )


def both_present(rows: DataFrame) -> DataFrame:
    """``lang, source, item, value``: corrections for terms that both sources have. ``rows``: lang, row (source, p, absent), times."""
    ordered = rows.repartitionByRange("lang", "row").sortWithinPartitions("lang", "row")
    found = ordered.select("lang", "row", "times").mapInArrow(_tree, "lang string, source string, item string, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    value = wide("high") * F.lit(1 << 32).cast("decimal(11,0)") + wide("low")
    return found.groupBy("lang", "source", "item").agg(value.cast("decimal(38,0)").alias("value"))


def pair_sums(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of every ordered pair of a language's groups. ``terms``: lang, source, term, n, p, absent."""
    wide = lambda sql: F.expr(f"CAST({sql} AS DECIMAL(38, 0))")
    own = groups.select("lang", "source", "kept", "absent")
    other = groups.select(F.col("lang").alias("_lang"), F.col("source").alias("item"), F.col("absent").alias("other"))
    both = own.join(other, (F.col("lang") == F.col("_lang")) & (F.col("source") != F.col("item"))).drop("_lang")
    base = both.select("lang", "source", "item", wide(f"coalesce(kept * CAST({gap('absent', 'other')} AS DECIMAL(20, 0)), 0)").alias("value"))
    # Terms of equal share in a group correct alike: counted once.
    shares = terms.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    met = shares.withColumnRenamed("lang", "_l").withColumnRenamed("source", "_s").join(both, (F.col("_l") == F.col("lang")) & (F.col("_s") == F.col("source")))
    one = met.select("lang", "source", "item", wide(f"times * CAST({gap('p', 'other')} - {gap('absent', 'other')} AS DECIMAL(20, 0))").alias("value"))
    # The same shares seen from the other group.
    two = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), wide(f"times * CAST({gap('other', 'p')} - {gap('other', 'absent')} AS DECIMAL(20, 0))").alias("value"))
    rows = terms.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "absent"))).alias("row"))
    rows = rows.groupBy("lang", "row").agg(F.count(F.lit(1)).alias("times"))
    whole = base.unionByName(one).unionByName(two).unionByName(both_present(rows))
    return whole.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def divergence(docs: DataFrame, least: int = LEAST_DOCS, ranks: int = RANKS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per group (lang, source): its distance to each other source of its language (part ``pair``, all ranks), and the terms it
    has more of than its language (part ``term``, ``ranks`` of them), as lang, source, part, item, value, rank.

    Null texts, languages and sources are empty text, which is a language or source like others. A group without kept terms has
    pairs but no terms; a language without kept terms has pairs of value 0; one with a single group has no pairs. Repeated rows
    are documents each. No documents give no row. Other columns play no part, whatever their names.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    kept = written(kept_terms(term_counts(rows), least), "divergence-terms")
    groups = written(group_sizes(rows.select("lang", "source").distinct(), kept), "divergence-groups")
    flat = kept.select("lang", "term", "total", F.explode("row").alias("r")).select("lang", "term", "total", F.col("r.source").alias("source"), F.col("r.n").alias("n"))
    shared = flat.join(groups, ["lang", "source"]).withColumn("p", share("n", "size", "kept")).withColumn("q", share("total", "lang_size", "kept"))
    shared = written(shared.select("lang", "source", "term", "p", "q", "absent"), "divergence-shares")
    pairs = pair_sums(shared, groups).withColumn("part", F.lit("pair"))
    more = shared.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"), F.lit("term").alias("part"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")).alias("rank")
    some = more.select("*", place).where(F.col("rank") <= ranks)
    return pairs.select("*", place).unionByName(some).select("lang", "source", "part", "item", "value", "rank")
