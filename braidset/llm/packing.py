"""Packing documents into fixed sequences by cutting-stock column generation.

Documents longer than a sequence give full pieces and a rest. The rests' lengths, counted by
Spark, are the demand of a cutting-stock problem: a linear program over patterns (which lengths
share a sequence), whose columns a knapsack dynamic program prices. The rounded patterns are
dealt to the pieces by their rank in their length class, so that no task sees more than a bucket
of pieces. What rounding leaves is a bounded number of pieces, placed by best fit.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidset.llm import tokens
from braidset.llm.common import written

SIZE = 2048


def class_sizes(size: int, precision: int = 128) -> np.ndarray:
    """Upper ends of the length classes: exact up to ``precision``, then ``precision / 2`` to each doubling."""
    out, at = list(range(1, min(precision, size) + 1)), precision
    while at < size:
        step = max(1, 2 * at // precision)
        out += range(at + step, min(2 * at, size) + 1, step)
        at *= 2
    return np.array(sorted({*out, size}), np.int64)


def knapsack(sizes: np.ndarray, values: np.ndarray, most: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The most valuable filling of ``size`` with at most ``most`` of each, by dynamic programming: its value and counts."""
    items = []
    for k in np.flatnonzero((values > 1e-12) & (most > 0)).tolist():
        left, n = int(most[k]), 1
        while left > 0:
            items.append((k, min(n, left)))
            left -= n
            n *= 2
    best = np.zeros(size + 1)
    chosen = np.zeros((len(items), size + 1), bool)
    for i, (k, n) in enumerate(items):
        weight = int(sizes[k]) * n
        if weight > size:
            continue
        got = best[: size + 1 - weight] + values[k] * n
        np.greater(got, best[weight:] + 1e-12, out=chosen[i, weight:])
        best[weight:] = np.maximum(best[weight:], got)
    counts, c = np.zeros(len(sizes), np.int64), size
    for i in range(len(items) - 1, -1, -1):
        if chosen[i, c]:
            k, n = items[i]
            counts[k] += n
            c -= int(sizes[k]) * n
    return float(best[size]), counts


def first_patterns(sizes: np.ndarray, demand: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A basis to start from: column k is the pattern that used up length k, and how often it was used.

    Each pattern takes the longest length left and fills up with what is left, by the same dynamic
    program, and is used until a length runs out. Later patterns lack that length, so the columns
    are independent.
    """
    basis, x, left = np.diag(size // sizes).astype(float), np.zeros(len(sizes)), demand.copy()
    worth = sizes * (1 + 0.1 * sizes / size)
    while (left > 0).any():
        k = int(np.flatnonzero(left > 0)[-1])
        most = np.where(left > 0, np.maximum(1, np.ceil(4 * left * sizes[k] / max(1.0, left @ sizes))), 0).astype(np.int64)
        most[k] = max(0, most[k] - 1)
        _, counts = knapsack(sizes, worth, np.minimum(most, size // sizes), size - int(sizes[k]))
        counts[k] += 1
        some = counts > 0
        times = (left[some] / counts[some]).min()
        gone = np.flatnonzero(some)[np.argmin(left[some] / counts[some])]
        basis[:, gone], x[gone] = counts, times
        left[some] -= times * counts[some]
        left[gone] = 0
        left[left < 1e-9] = 0
    return basis, x


def cutting_stock(
    sizes: np.ndarray, demand: np.ndarray, size: int, gap: float = 2e-3, rounds: int = 2000, hold: float = 0.5, spread: float = 2.0
) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows of counts) and how often each is used, in fractions: the linear program's solution.

    The revised simplex method starts from greedy patterns; its duals price new ones by the
    dynamic program. It ends once the use is within ``gap`` of the greatest lower bound found, or
    after ``rounds``. Pricing takes duals smoothed towards length / size, which no pattern exceeds,
    so that early duals don't mislead it; a pattern that doesn't improve is priced anew without.
    """
    basis, x = first_patterns(sizes, demand, size)
    inverse = np.linalg.inv(basis)
    centre = sizes / size
    # A pattern with many pieces of a rare length could hardly be used: a few times its share at most.
    most = np.minimum(size // sizes, np.maximum(1, np.ceil(spread * demand / (demand @ centre)))).astype(np.int64)
    bound, keep = float(demand @ centre), hold
    for turn in range(rounds):
        if x.sum() <= bound * (1 + gap):
            break
        duals = inverse.sum(axis=0)  # each pattern costs one sequence
        mixed = keep * centre + (1 - keep) * duals
        value, column = knapsack(sizes, mixed, most, size)
        if duals @ column <= 1 + 1e-7:
            if not keep:
                break
            keep = 0.0 if keep < 0.05 else keep / 2
            continue
        keep = hold
        step = inverse @ column
        rising = step > 1e-7
        ratios = np.where(rising, x / np.where(rising, step, 1), np.inf)
        near = ratios <= ratios.min() * (1 + 1e-9) + 1e-12
        out = int(np.where(near, step, -1).argmax())  # of equal ratios the firmest pivot
        t = ratios[out]
        x = np.maximum(x - t * step, 0)
        x[out] = t
        basis[:, out] = column
        if turn % 100 == 99:
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ demand, 0)
        else:
            inverse[out] /= step[out]
            step[out] = 0
            inverse -= np.outer(step, inverse[out])
    return np.rint(basis.T).astype(np.int64), x


def plan_sequences(sizes: np.ndarray, demand: np.ndarray, size: int, gap: float = 2e-3) -> tuple[np.ndarray, ...]:
    """Which sequences take the pieces of each class, by rank.

    Arrays with a row per run: class, first rank, pieces per sequence, first sequence, first slot;
    sorted by class and rank. Runs are no more than the patterns' lengths and the pieces
    that rounding leaves, whatever the demand.
    """
    present = np.flatnonzero(demand)
    runs, used, taken = [], 0, np.zeros(len(sizes), np.int64)

    def add(counts, times):
        nonlocal used
        slot = 0
        for k in np.flatnonzero(counts)[::-1].tolist():
            runs.append((k, int(taken[k]), int(counts[k]), used, slot))
            taken[k] += int(counts[k]) * times
            slot += int(counts[k])
        used += times

    if len(present):
        patterns, x = cutting_stock(sizes[present], demand[present].astype(float), size, gap)
        for row, times in zip(patterns, np.floor(x + 1e-9).astype(np.int64).tolist()):
            full = np.zeros(len(sizes), np.int64)
            full[present] = row
            some = full > 0
            times = min(times, int(((demand - taken)[some] // full[some]).min())) if some.any() else 0
            if times > 0:
                add(full, times)
    # The rest, at most a sequence or so for each pattern: best fit, longest first.
    rest, bins = demand - taken, []
    by_room: dict[int, list[int]] = {}
    for k in np.flatnonzero(rest)[::-1].tolist():
        length = int(sizes[k])
        for _ in range(int(rest[k])):
            room = next((r for r in sorted(by_room) if r >= length and by_room[r]), None)
            if room is None:
                bins.append(np.zeros(len(sizes), np.int64))
                at, room = len(bins) - 1, size
            else:
                at = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
            bins[at][k] += 1
            by_room.setdefault(room - length, []).append(at)
    for counts in bins:
        add(counts, 1)
    runs.sort()
    return tuple(np.array(c, np.int64) for c in zip(*runs)) if runs else tuple(np.zeros(0, np.int64) for _ in range(5))


def _encode(path: str, end: int):
    def run(batches):
        enc = tokens.encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, counts = enc.encode_all(part.column(1).cast(pa.binary()).to_pylist(), end)
                data, ends = ids.astype("<u4").tobytes(), (counts.cumsum() * 4).tolist()
                pieces = [data[a:b] for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(pieces, pa.binary())], names=["doc_id", "doc_tokens", "ids"])

    return run


def token_table(docs: DataFrame, tokenizer: str | None = None, end: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """uid, doc_id, doc_tokens and ids (little-endian 32-bit integers), written once into the shared folder."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.mapInArrow(_encode(tokenizer or tokens.default_path(), end), "doc_id long, doc_tokens long, ids binary")
    return written(rows.withColumn("uid", F.monotonically_increasing_id()), "pack-tokens")


def _placed(sizes: np.ndarray, runs: tuple[np.ndarray, ...]):
    kind, first, per, sequence, slot = runs
    lows = np.searchsorted(kind, np.arange(len(sizes) + 1))

    def run(batches):
        for batch in batches:
            k, rank = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            at = np.empty(len(k), np.int64)
            for c in np.unique(k).tolist():
                own = k == c
                at[own] = lows[c] + np.searchsorted(first[lows[c] : lows[c + 1]], rank[own], "right") - 1
            inside = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sequence[at] + inside // per[at]), pa.array(slot[at] + inside % per[at])],
                names=["uid", "start", "length", "sequence_id", "slot"],
            )

    return run


def place(lengths: DataFrame, size: int = SIZE, precision: int = 128, gap: float = 2e-3, bucket: int = 4096) -> DataFrame:
    """Pieces of documents (columns uid, doc_tokens): uid, start, length, sequence_id, offset.

    ``doc_tokens`` above ``size`` gives full pieces, each a sequence of its own, and a rest.
    """
    spark = lengths.sparkSession
    sizes = class_sizes(size, precision)
    pieces = lengths.where("doc_tokens > 0").select(
        "uid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_tokens") - 1, F.lit(size).cast("long"))).alias("start"), "doc_tokens"
    )
    pieces = pieces.select("uid", "start", F.least(F.lit(size), F.col("doc_tokens") - F.col("start")).cast("long").alias("length"))
    # A row per length at most, so the driver holds ``size`` rows.
    exact = np.zeros(size + 1, np.int64)
    for n, c in pieces.groupBy("length").count().collect():
        exact[n] = c
    kind_of = np.searchsorted(sizes, np.arange(size + 1))
    demand = np.bincount(kind_of[1:], exact[1:], len(sizes)).astype(np.int64)
    runs = plan_sequences(sizes, demand, size, gap)
    kinds = F.array(*[F.lit(int(k)) for k in kind_of])
    buckets = F.array(*[F.lit(int(-(-d // bucket) or 1)) for d in demand])
    pieces = pieces.withColumn("kind", F.element_at(kinds, (F.col("length") + 1).cast("int")))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("uid", "start"), F.element_at(buckets, F.col("kind") + 1).cast("long")))
    counts = pieces.groupBy("kind", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("kind", "bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("kind", "bucket").orderBy("uid", "start"))
    ranked = pieces.withColumn("_n", number).join(counts, ["kind", "bucket"])
    ranked = ranked.select("uid", "start", "length", F.col("kind").cast("long").alias("kind"), (F.col("_before") + F.col("_n") - 1).alias("rank"))
    placed = ranked.mapInArrow(_placed(sizes, runs), "uid long, start long, length long, sequence_id long, slot long")
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("uid", "start", "length", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))


def pack(
    docs: DataFrame,
    size: int = SIZE,
    tokenizer: str | None = None,
    end: int = 1,
    precision: int = 128,
    gap: float = 2e-3,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of all documents, placed: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    Each whole text is encoded and closed by id ``end``; every id lies in exactly one piece, and a
    sequence's pieces are gapless from offset 0. ``ids`` holds the piece's ids as little-endian
    32-bit integers.

    Null and empty texts are the end id alone; null and repeated keys are documents of their own;
    a very long text is many full pieces; an empty table gives no row. Other columns play no part.
    """
    table = token_table(docs, tokenizer, end, key, text)
    placed = place(table.select("uid", "doc_tokens"), size, precision, gap)
    joined = placed.join(table, "uid")
    piece = F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))")
    return joined.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", piece.alias("ids"))


def _crc(batches):
    for batch in batches:
        sums = [zlib.crc32(x) for x in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(sums, pa.int64()), *batch.columns[4:]],
            names=["doc_id", "start", "length", "ids_crc32", *batch.schema.names[4:]],
        )


def digests(packed: DataFrame, keep_ids: bool = False) -> DataFrame:
    """The pieces with the crc32 of their ids, beside or in place of the ids."""
    kept = ["doc_tokens", "sequence_id", "offset"]
    rows = packed.select("doc_id", "start", "length", "ids", *kept, *([F.col("ids").alias("piece")] if keep_ids else []))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    out = rows.mapInArrow(_crc, schema + (", piece binary" if keep_ids else ""))
    return out.withColumnRenamed("piece", "ids")
