"""Benchmark decontamination as a prefix-filtered set join, with exact containment.

A window is ``size`` consecutive words of an item (a shorter item is one window). Its set of
shingles must be contained in a document whole, so by the prefix filter one shingle is enough to
meet: its rarest in the documents. The steps are:

1. Documents are read once. Stretches whose every shingle may belong to an item, by a filter of
   bounded size, are written down; all else is done with.
2. Shingles are counted over these stretches; windows with a shingle that no document has are out,
   the others are keyed by their rarest one.
3. Places of such shingles join the windows on the key. The shingle's place in the window and the
   stretch's ends bound where the window may lie; there its words are compared one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidset.llm.common import written
from braidset.llm.scan import Texts, coded, gaps, lowered, steps

#: Fixed value of the contract: words of a window.
SIZE = 10
#: Words of a shingle; shorter windows are one shingle.
SHINGLE = 5
#: Bits of the filter: so many a shingle, and never more than this (16 MB). Beyond that more stretches are written; the result stays exact.
BITS, MOST_BITS = 16, 1 << 27
_WORDS = lowered(gaps("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words; each distinct one is hashed once."""
    from xxhash import xxh64_intdigest

    code, distinct = coded(words)
    return np.fromiter((xxh64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))[code]


def _shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words; equal runs have equal hashes, and unequal ones are told apart later."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(out)]
    out ^= out >> np.uint64(31)
    return (out * np.uint64(0xBF58476D1CE4E5B9)) ^ np.uint64(n)


def _bits_of(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(keys >> np.uint64(s)) % np.uint64(bits) for s in (0, 32)]


def key_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """A filter of ``bits`` (a power of two) set for each ``key``; a row for 64 bits reaches the driver."""
    places = F.array(*[F.shiftrightunsigned("key", s).bitwiseAND(F.lit(bits - 1).cast("long")) for s in (0, 32)])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    words = keys.select(F.explode(places).alias("place")).groupBy(F.floor(F.col("place") / 64).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(words.column("at"))] = np.asarray(words.column("bits"))
    return out


def _met(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for at in _bits_of(keys, len(filled) * 64):
        out &= (filled[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)).astype(np.int64) & 1).astype(bool)
    return out


def _windows(size: int, shingle: int):
    def run(batches):
        for batch in batches:
            for part in steps(batch, 1, 1 << 18):
                texts = Texts(part.column(1))
                words, counts = texts.words(_WORDS)
                hashes, words, item = _hashes(words), words.to_pylist(), part.column(0).to_pylist()
                rows, at = ([], [], [], []), 0
                for i, n in enumerate(counts.tolist()):
                    long = min(n, size)
                    small = min(long, shingle)
                    keys = _shingles(hashes[at : at + n], small).view(np.int64).tolist() if n else []
                    for k in range(n - long + 1 if n else 0):
                        for row, x in zip(rows, (item[i], " ".join(words[at + k : at + k + long]), long, keys[k : k + long - small + 1])):
                            row.append(x)
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.list_(pa.int64()))], names=["item_id", "words", "n", "keys"])

    return run


def windows(benchmark: DataFrame, size: int = SIZE, shingle: int = SHINGLE, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, words, n, keys`` of every window: its words joined by spaces, their number, and the hashes of its shingles in order."""
    rows = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_windows(size, shingle), "item_id string, words string, n int, keys array<long>")


def _stretches(sketch, sizes: list[int]):
    def run(batches):
        filled = sketch.value
        for batch in batches:
            for part in steps(batch, 1):
                texts = Texts(part.column(1))
                words, counts = texts.words(_WORDS)
                total = len(words)
                hashes = _hashes(words)
                owner = np.repeat(np.arange(len(counts)), counts)
                # Words covered by a shingle that may be an item's; no shingle spans two texts.
                open_at = np.zeros(total + 1, np.int32)
                for n in sizes:
                    at = np.flatnonzero(_met(filled, _shingles(hashes, n)))
                    at = at[owner[at] == owner[at + n - 1]]
                    open_at[at] += 1
                    open_at[at + n] -= 1
                cover = np.flatnonzero(np.cumsum(open_at[:-1]) > 0)
                cut = np.flatnonzero((np.diff(cover) > 1) | (np.diff(owner[cover]) > 0))
                edges = np.concatenate([[-1], cut, [len(cover) - 1]]).astype(np.int64)
                left, right = (cover[edges[:-1] + 1], cover[edges[1:]] + 1) if len(cover) else (cover, cover)
                found = [[] for _ in counts]
                starts = np.cumsum(counts) - counts
                for a, b, o in zip(left.tolist(), right.tolist(), owner[left].tolist()):
                    found[o].append({"at": a - int(starts[o]), "words": " ".join(words.slice(a, b - a).to_pylist())})
                kind = pa.list_(pa.struct([("at", pa.int32()), ("words", pa.string())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["doc_id", "n_words", "stretches"])

    return run


def _places(sizes: list[int], around: int, sketch=None):
    """Shingles of stretches: with a filter, those it holds with the words around them; else all, counted."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, 2, 1 << 20):
                texts = Texts(part.column(2))
                words, counts = texts.words(np.arange(256, dtype=np.uint8))
                hashes, ends = _hashes(words), np.cumsum(counts)
                owner = np.repeat(np.arange(len(counts)), counts)
                every = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
                for n in sizes:
                    keys = _shingles(hashes, n)
                    own = owner[: len(keys)] == owner[n - 1 :][: len(keys)]
                    keep = np.flatnonzero(own if sketch is None else own & _met(sketch.value, keys))
                    every.append((keep, keys[keep]))
                at, keys = (np.concatenate(x) for x in zip(*every))
                if sketch is None:
                    keys, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])
                    continue
                row, starts = owner[at], ends - counts
                first = np.maximum(at - around, starts[row])
                last = np.minimum(at + max(sizes, default=1) + around, ends[row])
                size = last - first
                reach = np.concatenate([[0], np.cumsum(size)])
                inner = np.repeat(first - reach[:-1], size) + np.arange(reach[-1])
                context = pa.ListArray.from_arrays(pa.array(reach, pa.int32()), words.take(pa.array(inner)))
                uid, offset = np.asarray(part.column(0)), np.asarray(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid[row]), pa.array(keys.view(np.int64)), pa.array(offset[row] + first - starts[row], pa.int64()), pa.array(at - first, pa.int32()), context],
                    names=["uid", "key", "at", "place", "context"],
                )

    return run


def _bits(n: int, most: int) -> int:
    bits = 1 << 16
    while bits < min(most, BITS * n):
        bits *= 2
    return bits


def keyed_windows(found: DataFrame, counts: DataFrame) -> DataFrame:
    """``words, n, key, offset`` of distinct windows: the rarest shingle, and its place. Windows with a shingle that is nowhere are out."""
    shingles = found.select("words", "n", F.size("keys").alias("parts"), F.posexplode("keys").alias("offset", "key")).distinct()
    rare = shingles.join(counts, "key").groupBy("words", "n", "parts").agg(F.count(F.lit(1)).alias("have"), F.min(F.struct("count", "key", "offset")).alias("least"))
    return rare.where("have = parts").select("words", "n", "least.key", "least.offset")


def occurrences(stretched: DataFrame, found: DataFrame, sizes: list[int], size: int, most: int) -> tuple[DataFrame, DataFrame]:
    """``uid, at, n, window``: every place in a document where a window's words stand; and ``window, words``. ``stretched``: uid, stretches."""
    rows = stretched.select("uid", F.explode("stretches").alias("s")).select("uid", F.col("s.at").cast("long").alias("at"), F.col("s.words").alias("words"))
    counts = rows.mapInArrow(_places(sizes, 0), "key long, n long").groupBy("key").agg(F.sum("n").alias("count"))
    keyed = written(keyed_windows(found, counts).withColumn("window", F.monotonically_increasing_id()), "decontaminate-keys")
    keys = keyed.select("key").distinct()
    sketch = rows.sparkSession.sparkContext.broadcast(key_filter(keys, _bits(keys.count(), most)))
    around = size - min(sizes, default=1)
    places = rows.mapInArrow(_places(sizes, around, sketch), "uid long, key long, at long, place int, context array<string>")
    met = places.join(keyed, "key")
    first = F.col("place") - F.col("offset")
    met = met.where((first >= 0) & (first + F.col("n") <= F.size("context")))
    same = F.array_join(F.slice("context", first + 1, F.col("n")), " ") == F.col("words")
    return met.where(same).select("uid", (F.col("at") + first).alias("at"), "n", "window"), keyed.select("window", "words")


def _covered(spans: Column) -> Column:
    """Words in the union of spans (at, end), sorted."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))
    add = lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["total"] + F.greatest(s["end"] - F.greatest(acc["end"], s["at"]), F.lit(0))).alias("total"))
    return F.aggregate(spans, start, add, lambda acc: acc["total"])


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = SIZE, shingle: int = SHINGLE, most: int = MOST_BITS, key: str = "doc_id", text: str = "text", item: str = "item_id"
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256 and contaminated.

    Null texts have no words; null and repeated keys keep a row each; items without words have no window;
    items that share an id are one, and a null id reads as ''. An empty benchmark hits nothing; no documents
    give no row. Other columns play no part.
    """
    found = written(windows(benchmark, size, shingle, item, text), "decontaminate-windows")
    # Five lengths at most, as no shingle is longer.
    sizes = sorted(r.n for r in found.select(F.least(F.col("n"), F.lit(shingle)).alias("n")).distinct().collect())
    keys = found.select(F.explode("keys").alias("key")).distinct()
    sketch = docs.sparkSession.sparkContext.broadcast(key_filter(keys, _bits(keys.count(), most)))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    read = rows.mapInArrow(_stretches(sketch, sizes), f"doc_id {kind}, n_words long, stretches array<struct<at: int, words: string>>")
    read = written(read.withColumn("uid", F.monotonically_increasing_id()), "decontaminate-stretches")
    met, keyed = occurrences(read.select("uid", "stretches"), found, sizes, size, most)
    met = written(met, "decontaminate-met")
    span = F.struct("at", (F.col("at") + F.col("n")).alias("end"))
    # A document's own places and windows: no more than its words.
    own = met.groupBy("uid").agg(_covered(F.array_sort(F.collect_set(span))).alias("hit"), F.array_sort(F.collect_set("window")).alias("held"))
    own = written(own, "decontaminate-own")
    # Documents that hold the same windows have the same items: worked out once for each such set.
    sets = own.select("held").distinct().withColumn("window", F.explode("held"))
    items = keyed.join(found.select("words", "item_id").distinct(), "words").select("window", "item_id")
    named = sets.join(items, "window").groupBy("held").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    named = named.select(F.col("held").alias("_held"), F.size("items").cast("long").alias("items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("digest"))
    hits = own.join(named, F.col("held") == F.col("_held")).select(F.col("uid").alias("_uid"), "hit", "items", "digest")
    zero = F.lit(0).cast("long")
    out = read.select("uid", "doc_id", "n_words").join(hits, F.col("uid") == F.col("_uid"), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("hit", zero).alias("n_hit"), F.coalesce("items", zero).alias("n_items"),
        F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (F.coalesce("hit", zero) > 0).alias("contaminated"),
    )
