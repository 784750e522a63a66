"""Audit of how filters interact: what each removes, alone and after others, in every order.

A document's failures are a mask of five bits. All that the audit reports is a sum over the 32
masks of a part, so documents are counted by mask once and the 120 orders are worked out from
these counts.

Four filters look at one text. The fifth asks whether a smaller id has the same text. Before any
text is shuffled, a counting Bloom sketch is merged over all documents: a text with a cell of count
one is surely unique. Only texts of which all cells are met again travel, to be grouped by the full text.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidset.llm.common import written
from braidset.llm.scan import Texts, coded, steps

#: Fixed values of the contract: the filters, bit by bit.
FILTERS = "ABCDE"
WORDS, DISTINCT, CAPITALS = 200, 50, 2
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#$%&*|", np.uint8))
_CAPITALS = np.isin(np.arange(256), np.arange(65, 91))
_INNER = np.isin(np.arange(256), np.arange(0x80, 0xC0))
_AS_IS = np.arange(256, dtype=np.uint8)

#: Cells of the sketch: so many a document, and never more than this (as bits, 16 MB). Beyond that
#: more unique texts are taken for possible repeats and travel; the result stays exact.
CELLS, MOST_CELLS = 16, 1 << 27


def text_masks(texts: Texts) -> np.ndarray:
    """Bits 0 to 3: few words, few distinct words, many capitals, a symbol."""
    words, n = texts.words(_AS_IS)
    code, distinct = coded(words)
    seen = np.unique(np.repeat(np.arange(len(texts)), n) * max(1, len(distinct)) + code)
    unlike = np.bincount(seen // max(1, len(distinct)), minlength=len(texts))
    points = np.diff(texts.offsets) - texts.count(_INNER)
    fails = (n < WORDS, 100 * unlike < DISTINCT * n, 100 * texts.count(_CAPITALS) > CAPITALS * points, texts.count(SYMBOLS) > 0)
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def _digests(texts: Texts) -> list[bytes]:
    raw, ends = texts.raw.data, texts.offsets.tolist()
    return [hashlib.sha256(raw[a:b]).digest() for a, b in zip(ends, ends[1:])]


def _masks(batches):
    for batch in batches:
        for part in steps(batch, 2):
            texts = Texts(part.column(2))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(text_masks(texts), pa.int32()), pa.array(_digests(texts), pa.binary())],
                names=["doc_id", "part", "mask", "digest"],
            )


def _halves(digest: Column) -> list[Column]:
    """Two numbers of 60 bits from a digest."""
    digits = F.hex(digest)
    return [F.conv(F.substring(digits, at, 15), 16, 10).cast("long") for at in (1, 16)]


def crowded_cells(digests: DataFrame, cells: int) -> np.ndarray:
    """The merged sketch as bits: which of the ``cells`` (a power of two) count two or more.

    Tasks count their own cells first; what reaches the driver is a row for 64 cells at most.
    """
    counts = digests.select(F.explode(F.array(*[h % cells for h in _halves(F.col("digest"))])).alias("cell")).groupBy("cell").count()
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("cell") % 64).cast("int"))
    words = counts.where("count > 1").groupBy(F.floor(F.col("cell") / 64).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(max(1, cells // 64), np.int64)
    out[np.asarray(words.column("at"))] = np.asarray(words.column("bits"))
    return out


def cells_of(digests: list[bytes], cells: int) -> np.ndarray:
    """The two cells of each digest."""
    raw = np.frombuffer(b"".join(d[:16] for d in digests), np.uint8).reshape(-1, 16).astype(np.uint64)
    first, second = np.zeros(len(raw), np.uint64), np.zeros(len(raw), np.uint64)
    for i in range(7):
        first = first << np.uint64(8) | raw[:, i]
    first = first << np.uint64(4) | raw[:, 7] >> np.uint64(4)
    second = raw[:, 7] & np.uint64(15)
    for i in range(8, 15):
        second = second << np.uint64(8) | raw[:, i]
    return np.stack([first, second], axis=1) % np.uint64(cells)


def _possible(sketch, cells: int):
    def run(batches):
        bits = sketch.value
        for batch in batches:
            for part in steps(batch, 1):
                digests = _digests(Texts(part.column(1)))
                at = cells_of(digests, cells)
                again = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)).astype(np.int64) & 1).astype(bool).all(axis=1)
                rows = np.flatnonzero(again)
                if len(rows):
                    kept = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1).fill_null(""), pa.array([digests[i] for i in rows], pa.binary())], names=["doc_id", "text", "digest"])

    return run


def first_ids(docs: DataFrame, digests: DataFrame, cells: int = CELLS, most: int = MOST_CELLS) -> DataFrame:
    """``_digest, first``: the least id of every text that has an id twice or more. Texts are told apart by themselves.

    ``docs``: doc_id, text. The digest carries the outcome back to rows without their texts.
    """
    size = 1 << 16
    while size < min(most, cells * digests.count()):
        size *= 2
    size = min(size, most)
    sketch = docs.sparkSession.sparkContext.broadcast(crowded_cells(digests, size))
    found = docs.mapInArrow(_possible(sketch, size), "doc_id long, text string, digest binary")
    groups = found.groupBy("digest", "text").agg(F.min("doc_id").alias("first"), F.count("doc_id").alias("n"))
    return groups.where("n > 1").select(F.col("digest").alias("_digest"), "first")


def masks(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, part, mask`` of every document; bit i of the mask: it fails filter i."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").alias("text"))
    narrow = written(rows.mapInArrow(_masks, "doc_id long, part string, mask int, digest binary"), "audit-masks")
    first = written(first_ids(rows.select("doc_id", "text"), narrow), "audit-first")
    joined = narrow.join(first, F.col("digest") == F.col("_digest"), "left")
    repeat = F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)
    return joined.select("doc_id", "part", F.col("mask").bitwiseOR(repeat).alias("mask"))


def mask_counts(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the filters they fail. A document with several labels has each of them."""
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("long").alias(f"_{c}")
    known = labels.select(F.col(key).cast("long").alias("_id"), "quality", "toxic").where("_id IS NOT NULL").groupBy("_id").agg(flag("quality"), flag("toxic"))
    zero = F.lit(0).cast("long")
    some = rows.join(known, F.col("doc_id") == F.col("_id")).select("part", "mask", zero.alias("n"), "_quality", "_toxic")
    every = rows.select("part", "mask", F.lit(1).cast("long").alias("n"), zero.alias("_quality"), zero.alias("_toxic"))
    both = every.unionByName(some)
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum("_quality").alias("good"), F.sum("_toxic").alias("toxic"))


def _bit(letter: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), letter) - 1)


def _steps(counts: DataFrame) -> DataFrame:
    """Each row of ``counts`` for every order and step, with the bits of its filter and of those before."""
    orders = F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])
    letter = lambda at: F.substring("filter_order", at, 1)
    rows = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    earlier = F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(0), lambda acc, at: F.when(at < F.col("step"), acc.bitwiseOR(_bit(letter(at)))).otherwise(acc))
    return rows.withColumns({"_bit": _bit(letter(F.col("step"))), "_before": earlier})


def report(counts: DataFrame) -> DataFrame:
    """The audit from the counts by mask: a row per part, order and step."""
    # 32 masks at most in a part.
    lists = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("_m"))
    rows = _steps(lists)
    fails = lambda m, bits: m["mask"].bitwiseAND(bits) != 0
    zero = F.lit(0).cast("long")
    total = lambda what, cond: F.aggregate(F.col("_m"), zero, lambda acc, m: acc + F.when(cond(m), m[what]).otherwise(zero))
    bit, before = F.col("_bit"), F.col("_before")
    here = lambda m: fails(m, bit) & ~fails(m, before)
    # Of a document's failed filters each comes first in as many orders: 120 / their number, a whole number up to five.
    first = lambda m: (F.lit(factorial(len(FILTERS))) / F.bit_count(m["mask"])).cast("long")
    shapley = F.aggregate(F.col("_m"), zero, lambda acc, m: acc + F.when(fails(m, bit), first(m) * m["n"]).otherwise(zero))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~fails(m, bit.bitwiseOR(before))).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m, bit) & fails(m, before)).alias("redundant"),
        total("n", lambda m: m["mask"] == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row per part (source), filter_order (120) and step (1 to 5), zeros included: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley, as counts of documents.

    Null texts are empty, and empty texts are copies of each other; a null source is the part ''. Rows of null keys
    never count as repeats and make none; rows that repeat a key with its text are no repeats of each other, as
    neither id is smaller; labels of null keys are left out, and a key with several labels has each. No
    documents give no row. Other columns play no part.
    """
    rows = written(masks(docs, key, text, source), "audit-rows")
    return report(written(mask_counts(rows, labels, key), "audit-counts"))
