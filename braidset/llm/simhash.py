"""SimHash near-duplicates by tiled exact comparison.

Fingerprints that differ in at most ``radius`` bits have popcounts that differ by no more, in all
and summed over their four 16-bit words. Distinct fingerprints are therefore laid into cells by
the popcounts of these words; a cell is compared, tile by tile, with itself and the cells within
the radius, by exclusive or and bit count, and with no others. Tiles bound what a task holds.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidset.llm.common import identified, written
from braidset.llm.components import components

#: Fixed values of the contract: words per shingle, seed of XXH64.
SHINGLE, SEED = 3, 42


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, lowest first."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = len(bits) // 255 * 255
    total = bits[full:].sum(axis=0, dtype=np.int64)
    if full:
        # 255 rows can't overflow a byte, and bytes add fastest.
        total += np.add.reduce(bits[:full].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes | None) -> int:
    """The unsigned fingerprint of one whole text: bit by bit the majority of its shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: 1 - SHINGLE].tolist()
    total, n = np.zeros(64, np.int64), len(starts)
    ends = ends[SHINGLE - 1 :].tolist()
    for at in range(0, n, 1 << 16):
        part = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])]
        total += bit_counts(np.array(part, np.uint64))
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        *kept, texts = batch.columns
        found = np.array([fingerprint(t.as_py()) for t in texts.cast(pa.binary())], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*kept, pa.array(found)], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long), and ``row`` where a column with the rows' numbers is named."""
    kept = [F.col(key).cast("long").alias("doc_id"), *([F.col(row).alias("row")] if row else [])]
    rows = docs.select(*kept, F.col(text).alias("text"))
    schema = rows.drop("text").withColumn("fp", F.lit(0).cast("long")).schema
    return rows.mapInArrow(_fingerprints, schema)


def _cells(fps: np.ndarray) -> np.ndarray:
    words = np.bitwise_count(fps.astype("<i8").view("<u2").reshape(-1, 4)).astype(np.int64)
    return words @ np.array([4913, 289, 17, 1])


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of word popcounts within the radius whose first nonzero one is positive."""
    near = [d for d in product(range(-radius, radius + 1), repeat=4) if 0 < sum(map(abs, d)) <= radius]
    return [d for d in near if next(x for x in d if x) > 0]


def _deal(counts: np.ndarray, radius: int, tile: int, visitors: int):
    """Keys (cell, tile, share of visitors) under which a fingerprint is compared, at home or as a visitor."""
    steps = _steps(radius)
    grid = counts.reshape(17, 17, 17, 17)
    tiles = -(-counts // tile)
    guests = np.zeros_like(grid)
    for d in steps:
        # Visitors of cell c come from the cells c + d.
        to = tuple(slice(max(0, -x), 17 - max(0, x)) for x in d)
        of = tuple(slice(max(0, x), 17 - max(0, -x)) for x in d)
        guests[to] += grid[of]
    guests = guests.reshape(-1) + np.where(tiles > 1, counts, 0)
    shares = np.maximum(1, -(-guests // visitors))

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            cells = _cells(fps)
            mix = (fps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            axis = np.stack(np.unravel_index(cells, (17,) * 4), axis=1)
            keys, values, roles = [], [], []

            def add(own, cell, i, j, role):
                keys.append((cell << 40) | (i << 20) | j)
                values.append(own)
                roles.append(np.full(len(own), role))

            at = (mix % tiles[cells].astype(np.uint64)).astype(np.int64)
            busy = (guests[cells] > 0) | (counts[cells] > 1)
            for j in range(int(shares[cells].max(initial=0))):
                on = busy & (shares[cells] > j)
                add(fps[on], cells[on], at[on], np.int64(j), 0)
            for d in [*steps, (0, 0, 0, 0)]:
                home = axis - np.array(d)
                ok = ((home >= 0) & (home <= 16)).all(axis=1)
                cell = np.where(ok, home @ np.array([4913, 289, 17, 1]), 0)
                ok &= (counts[cell] > 0) if any(d) else (tiles[cell] > 1)
                own, cell, salt = fps[ok], cell[ok], mix[ok] >> np.uint64(13)
                share = (salt % shares[cell].astype(np.uint64)).astype(np.int64)
                for i in range(int(tiles[cell].max(initial=0))):
                    on = tiles[cell] > i
                    add(own[on], cell[on], np.int64(i), share[on], 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (keys, values, roles)], names=["key", "fp", "role"])

    return run


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a with b: every item's label is the least index of its component."""
    while True:
        la, lb = labels[a], labels[b]
        if (la == lb).all():
            return labels
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]


def compare(fps: np.ndarray, visitor: np.ndarray, radius: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links among home fingerprints, and of home with visitors, as a forest: pairs of fingerprints."""
    bits = fps.view(np.uint64)
    order = np.lexsort((bits, np.bitwise_count(bits)))
    bits, visitor = bits[order], visitor[order]
    pops = np.bitwise_count(bits).astype(np.int64)
    home = np.flatnonzero(~visitor)
    labels = np.arange(len(bits))
    for i in range(0, len(home), tile):
        rows = home[i : i + tile]
        for j in range(0, len(bits), 4 * tile):
            columns = slice(j, j + 4 * tile)
            # Both are in order of popcounts: a tile pair beyond the radius is not compared.
            if pops[columns][0] > pops[rows[-1]] + radius or pops[columns][-1] < pops[rows[0]] - radius:
                continue
            a, b = np.nonzero(np.bitwise_count(bits[rows][:, None] ^ bits[columns][None, :]) <= radius)
            a, b = rows[a], b + j
            some = a != b
            labels = _join(labels, a[some], b[some])
    linked = np.flatnonzero(labels != np.arange(len(labels)))
    return bits[linked].view(np.int64), bits[labels[linked]].view(np.int64)


def _links(radius: int):
    def run(batches):
        def flush(key_parts):
            fps, roles = (np.concatenate(x) for x in zip(*key_parts))
            if len(fps) < 2 or roles.all():
                return None
            a, b = compare(fps, roles == 1, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]) if len(a) else None

        now, held = None, []
        for batch in batches:
            keys, fps, roles = (c.to_numpy() for c in batch.columns)
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for s, e in zip(edges[:-1], edges[1:]):
                if s == e:
                    continue
                if held and keys[s] != now:
                    if (found := flush(held)) is not None:
                        yield found
                    held = []
                now = keys[s]
                held.append((fps[s:e], roles[s:e]))
        if held and (found := flush(held)) is not None:
            yield found

    return run


def links(distinct: DataFrame, radius: int = 2, tile: int = 2048, visitors: int = 8192) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) at most ``radius`` bits apart, as forests.

    Each tile pair yields a spanning forest of its links, no more rows than it has fingerprints,
    which connects what all its pairs connect.
    """
    cell = sum((F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))) * w for i, w in enumerate((4913, 289, 17, 1))), F.lit(0))
    counts = np.zeros(17**4, np.int64)
    # A row per cell: 83,521 at most, however many fingerprints there are.
    for c, n in distinct.groupBy(cell.alias("cell")).count().collect():
        counts[c] = n
    dealt = distinct.select("fp").mapInArrow(_deal(counts, radius, tile, visitors), "key long, fp long, role long")
    dealt = dealt.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits) and component_id, the least id it reaches by links.

    Copies share a fingerprint and are one node, so a group of copies costs one comparison.

    Null, empty and blank texts have fingerprint zero and are linked like others. Null keys keep
    their row; a component of null keys alone has a null id. Repeated keys give a row each. An
    empty table gives no row. Other columns play no part.
    """
    rows = written(fingerprints(docs, key, text), "simhash")
    out = _joined(rows, radius)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _joined(rows: DataFrame, radius: int) -> DataFrame:
    """``rows`` (doc_id, fp) with ``root``, their component, and ``component_id``, its least id."""
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = components(links(distinct, radius))
    rooted = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "_root")
    # Fingerprints without links are their own; only the others meet in a group.
    named = rooted.join(least, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "root", "component_id")
    return rows.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


def keep_one(docs: DataFrame, radius: int = 2, key: str = "doc_id", text: str = "text", rows: Column | None = None) -> DataFrame:
    """``docs`` with one row of each component: that of the least id (nulls last), of repeated ids the first.

    Null, empty and blank texts are one component with what is near them. Null and repeated keys are told apart by the
    row, so rows that are equal in all columns leave one as well; ``rows`` may tell them apart (``identified``). An empty
    table gives no row. All columns stay, whatever their names.
    """
    whole, row = identified(docs, "simhash-docs", rows)
    found = _joined(written(fingerprints(whole, key, text, row), "simhash"), radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    kept = found.groupBy("root").agg(first).select(F.col("first.row").alias("__llm_kept"))
    return whole.join(kept, F.col(row) == F.col("__llm_kept"), "left_semi").drop(row)
