"""Exact removal of repeated byte strings by suffix arrays of content-defined shards.

A byte goes if a string of ``SIZE`` bytes that covers it also starts elsewhere. Each such window
holds the least hash of its 32-byte grams at one place, its anchor; equal windows have equal
anchors at equal places. Runs of windows that share an anchor are therefore dealt out by the
anchor's hash, so that windows which may be equal meet in one shard; anchors that occur once go
nowhere, and equal segments of an anchor go as one. A shard's segments are put into a suffix array (Larsson-Sadakane), neighbours' common
prefixes (Kasai) show the repeated windows, and where one anchor's segments need several arrays,
these are merged by binary search. The windows' places go back to their documents.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidset.llm import suffixes
from braidset.llm.common import written

#: Fixed value of the contract: bytes of a repeated string.
SIZE = 200
GRAM = 32
SPAN = SIZE - GRAM + 1
#: Bytes of a text that are anchored at once; windows of a longer text belong to the part they start in.
PART = 1 << 22
_BYTE = np.random.default_rng(31).integers(1, 2**63, 256, np.uint64)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class Anchors:
    """Finds runs of windows with one anchor in buffers of up to ``most`` bytes."""

    def __init__(self):
        self.powers = self.backs = np.ones(0, np.uint64)

    def runs(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """anchor hash, text, first window (within its text), windows, place of the anchor behind the first window.

        ``bounds`` are the ends of the texts in the buffer.
        """
        n = len(raw)
        if n < SIZE:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        if len(self.powers) < n:
            self.powers, self.backs = _powers(_STEP, n), _powers(_BACK, n)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * self.powers[:n], dtype=np.uint64)])
        h = (prefix[GRAM:] - prefix[:-GRAM]) * self.backs[: n - GRAM + 1]
        del prefix
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        # Place in the low bits: of equal hashes the leftmost is least.
        keys = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        # Least of each SPAN in a row: from block beginnings and block ends.
        blocks = -(-len(keys) // SPAN)
        padded = np.full(blocks * SPAN, np.uint64(2**64 - 1))
        padded[: len(keys)] = keys
        grid = padded.reshape(blocks, SPAN)
        ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        windows = n - SIZE + 1
        anchor = (np.minimum(behind[:windows], ahead[SPAN - 1 : SPAN - 1 + windows]) & np.uint64(0xFFFFFF)).astype(np.int64)
        begins = np.concatenate([[0], bounds[:-1]])
        # Windows of one text: those that end within it.
        sizes = np.maximum(bounds - begins - SIZE + 1, 0)
        at = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        if not len(at):
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        text = np.repeat(np.arange(len(bounds)), sizes)
        a = anchor[at]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])]))
        many = np.diff(np.concatenate([first, [len(at)]]))
        return h[a[first]].view(np.int64), text[first], at[first] - begins[text[first]], many, a[first] - at[first]


_RUN = "anchor long, hash long, bytes long, first long, windows int, lead int"


def _parts(text: bytes) -> list[tuple[int, bytes]]:
    return [(at, text[at : at + PART + SIZE - 1]) for at in range(0, max(1, len(text) - SIZE + 1), PART)]


def _find_runs(batches):
    finder = Anchors()
    for batch in batches:
        hashes, sizes, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        at = 0
        while at < batch.num_rows:
            owner, offset, data, total = [], [], [], 0
            while at < batch.num_rows and (not data or total < 1 << 19):
                for o, x in _parts(texts[at].as_py()):
                    owner.append(at)
                    offset.append(o)
                    data.append(x)
                    total += len(x)
                at += 1
            groups = [range(len(data))] if total < 1 << 23 else [[i] for i in range(len(data))]
            for some in groups:
                raw = np.frombuffer(b"".join(data[i] for i in some), np.uint8)
                anchor, part, first, many, lead = finder.runs(raw, np.cumsum([len(data[i]) for i in some]))
                own, base = np.array([owner[i] for i in some])[part], np.array([offset[i] for i in some])[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(hashes[own]), pa.array(sizes[own]), pa.array(first + base), pa.array(many.astype(np.int32)), pa.array(lead.astype(np.int32))],
                    names=["anchor", "hash", "bytes", "first", "windows", "lead"],
                )
    _trim()


def _pack(batches):
    """Texts compressed, for two shuffles."""
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([packer.compress(t) for t in part.column(2).to_pylist()], pa.binary())], names=["hash", "bytes", "packed"])


def _unpacked(batch):
    """Row number, text, and the fields of its list of structs as lists."""
    opener = zstandard.ZstdDecompressor()
    lists = batch.column(3)
    edges = lists.offsets.to_pylist()
    fields = [f.to_numpy(zero_copy_only=False) for f in lists.values.flatten()] if isinstance(lists.values, pa.StructArray) else []
    for i in range(batch.num_rows):
        yield i, opener.decompress(batch.column(2)[i].as_py()), [f[edges[i] : edges[i + 1]] for f in fields]


def _trim():
    """Give freed memory back at a task's end: the worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


_PLACE = "anchor long, lead int, windows int, first long, content long, hash long, bytes long"
_SEGMENT = "anchor long, content long, windows int, segment binary, count long, lead int"


def _places(batches):
    """A row for each run of a document, with the hash of its segment: the bytes of all its windows."""
    names = ["anchor", "lead", "windows", "first", "content", "hash", "bytes"]
    for batch in batches:
        hashes, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        parts, total = [], 0
        for i, text, (anchor, lead, many, first) in _unpacked(batch):
            content = [xxhash.xxh64_intdigest(text[a:e], k) for k, a, e in zip(lead.tolist(), first.tolist(), (first + many + (SIZE - 1)).tolist())]
            n = len(content)
            parts.append((anchor, lead, many, first, np.array(content, np.uint64).view(np.int64), np.full(n, hashes[i]), np.full(n, sizes[i])))
            total += n
            if total > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=names)
                parts, total = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=names)
    _trim()


def _cut(batches):
    """The segments that a document stands for."""
    for batch in batches:
        for _, text, (anchor, content, many, first, count, lead) in _unpacked(batch):
            segments = [text[a:e] for a, e in zip(first.tolist(), (first + many + (SIZE - 1)).tolist())]
            columns = [pa.array(anchor), pa.array(content), pa.array(many), pa.array(segments, pa.binary()), pa.array(count), pa.array(lead)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "content", "windows", "segment", "count", "lead"])
    _trim()


def _intervals(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _shard(budget: int):
    """Suffix arrays over rows in order of anchors: anchor, content, from, to of repeated windows of each segment."""

    def solve(rows):
        # Whole anchors come in one call. They fill shards of ``budget`` bytes; an anchor of more spans several.
        shards, now, size = [], [], 0
        for row in rows:
            if now and size + len(row[3]) > budget:
                shards.append(now)
                now, size = [], 0
            now.append(row)
            size += len(row[3])
        shards.append(now)
        done = []
        for shard in shards:
            mask, at, places = suffixes.repeated_windows([r[3] for r in shard], [r[2] for r in shard], SIZE)
            words = None
            if len(shards) > 1:
                words = suffixes.windows(np.frombuffer(b"".join(r[3] for r in shard), np.uint8), at, SIZE)
            done.append((shard, mask, places, words))
        for i in range(len(done)):
            for j in range(len(done)):
                if i != j:
                    _, mask, places, words = done[i]
                    rest = np.flatnonzero(~mask[places])
                    hit = suffixes.occur_in(words[rest], done[j][3])
                    mask[places[rest[hit]]] = True
        for shard, mask, _, _ in done:
            out, at = [], 0
            for anchor, content, many, _, copies in shard:
                own = mask[at : at + many]
                at += many
                # Segments of several places are repeated as a whole, which the caller knows.
                if copies == 1:
                    out += [(anchor, content, int(a), int(b)) for a, b in zip(*_intervals(own))]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["anchor", "content", "from", "to"]
                )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > budget and held[-1][0] != row[0]:
                    yield from solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield from solve(held)
        _trim()

    return run


def _explode(batches):
    """Each window of a hot anchor's segments by its content: anchor, place, window (128 bits), content, at."""
    for batch in batches:
        for anchor, content, many, segment, _, lead in zip(*(c.to_pylist() for c in batch.columns)):
            keys = [hashlib.blake2b(segment[k : k + SIZE], digest_size=16).digest() for k in range(many)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([anchor] * many), pa.array([lead - k for k in range(many)], pa.int32()), pa.array(keys, pa.binary()), pa.array([content] * many), pa.array(range(many), pa.int32())],
                names=["anchor", "place", "window", "content", "at"],
            )


def repeated(docs: DataFrame, shard_bytes: int = 1 << 19, hot: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Of texts (columns hash, bytes, text as binary): runs of repeated windows (hash, bytes, from, to), and the texts (packed) they may lie in.

    Equal texts are one here; their copies are the caller's.
    """
    long = docs.where(F.col("bytes") >= SIZE)
    runs = written(long.mapInArrow(_find_runs, _RUN), "repeats-runs")
    # Places are counted first, as hashes: the least and the greatest differ if an anchor has two.
    place = F.xxhash64("hash", "bytes", "first")
    twice = runs.groupBy("anchor").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least <> most").select(F.col("anchor").alias("_anchor"))
    # Written, so that both sides of the join are plain exchanges, whose hot anchors Spark can split; so below.
    twice = written(twice, "repeats-anchors")
    kept = runs.join(twice, F.col("anchor") == F.col("_anchor"), "left_semi").dropDuplicates(["hash", "bytes", "first"])
    same = (F.col("hash") == F.col("_hash")) & (F.col("bytes") == F.col("_bytes"))
    whose = {"hash": "_hash", "bytes": "_bytes"}
    lists = kept.groupBy("hash", "bytes").agg(F.collect_list(F.struct("anchor", "lead", "windows", "first")).alias("runs")).withColumnsRenamed(whose)
    packed = long.mapInArrow(_pack, "hash long, bytes long, packed binary")
    texts = written(packed.join(lists, same).select("hash", "bytes", "packed", "runs").dropDuplicates(["hash", "bytes"]), "repeats-texts")
    places = written(texts.mapInArrow(_places, _PLACE), "repeats-places")
    # Equal segments are one, with the number of their places; the least place stands for them.
    groups = places.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("count"), F.min(F.struct("hash", "bytes", "first", "windows", "lead")).alias("at")
    )
    groups = written(groups.select("anchor", "content", "count", "at.*"), "repeats-groups")
    many = groups.groupBy("anchor").count().select(F.col("anchor").alias("_anchor"), F.col("count").alias("_n")).where("_n > 1")
    many = written(many, "repeats-mixed")
    mixed = groups.join(many, F.col("anchor") == F.col("_anchor"))
    wanted = mixed.groupBy("hash", "bytes").agg(F.collect_list(F.struct("anchor", "content", "windows", "first", "count", "lead", "_n")).alias("runs")).withColumnsRenamed(whose)
    held = texts.select("hash", "bytes", "packed").join(wanted, same)

    def segments(crowded: bool) -> DataFrame:
        chosen = F.filter("runs", lambda r: (r["_n"] > hot) if crowded else (r["_n"] <= hot))
        rows = held.select("hash", "bytes", "packed", chosen.alias("runs")).where(F.size("runs") > 0)
        fields = F.transform("runs", lambda r: F.struct(*[r[c].alias(c) for c in ("anchor", "content", "windows", "first", "count", "lead")]))
        return rows.withColumn("runs", fields).mapInArrow(_cut, _SEGMENT)

    whole = groups.where("count > 1").select("anchor", "content", F.lit(0).alias("from"), F.col("windows").alias("to"))
    usual = segments(False).select("anchor", "content", "windows", "segment", "count").repartition("anchor").sortWithinPartitions("anchor")
    found = usual.mapInArrow(_shard(shard_bytes), "anchor long, content long, `from` int, `to` int")
    # An anchor of very many different segments, as at the edge of a passage that very many documents share:
    # its windows are counted by content, which spreads over all tasks.
    spread = written(segments(True).mapInArrow(_explode, "anchor long, place int, window binary, content long, at int"), "repeats-crowd")
    counted = spread.groupBy("anchor", "place", "window").count().where(F.col("count") > 1)
    counted = counted.select(F.col("anchor").alias("_a"), F.col("place").alias("_p"), F.col("window").alias("_w"))
    counted = written(counted, "repeats-windows")
    again = spread.join(counted, (F.col("anchor") == F.col("_a")) & (F.col("place") == F.col("_p")) & (F.col("window") == F.col("_w")), "left_semi")
    single = again.select("anchor", "content", F.col("at").alias("from"), (F.col("at") + 1).alias("to"))
    found = found.unionAll(single).unionAll(whole).withColumnsRenamed({"anchor": "_anchor", "content": "_content"})
    met = places.select("anchor", "content", "hash", "bytes", "first").join(found, (F.col("anchor") == F.col("_anchor")) & (F.col("content") == F.col("_content")))
    spans = met.select("hash", "bytes", (F.col("first") + F.col("from")).alias("from"), (F.col("first") + F.col("to") + (SIZE - 1)).alias("to"))
    return spans, texts.drop("runs")


_KEPT = "hash long, bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _remove(batches):
    for batch in batches:
        for i, text, (begins, ends) in _unpacked(batch):
            spans = sorted(zip(begins.tolist(), ends.tolist()))
            out, last, removed, n = [], 0, 0, 0
            start, end = spans[0]
            for a, b in [*spans[1:], (len(text) + 1, 0)]:
                if a <= end:
                    end = max(end, b)
                    continue
                out.append(text[last:start])
                last, removed, n = end, removed + end - start, n + 1
                start, end = a, b
            kept = b"".join([*out, text[last:]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([removed]), pa.array([n]), pa.array([hashlib.sha256(kept).hexdigest()]), pa.array([kept], pa.binary())],
                names=["hash", "bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept, the remaining bytes (null where nothing or all went).

    Texts are UTF-8 bytes; strings are judged on the input. Documents whose whole texts are equal
    (by 64-bit hash and length) are worked on once and, from 200 bytes, removed wholly.

    Null and empty texts have no bytes and lose none; null and repeated keys keep a row each; an
    empty table gives no row; very long texts are anchored in parts. Other columns play no part.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("hash", F.xxhash64("_text")).withColumn("bytes", F.octet_length("_text").cast("long"))
    spans, texts = repeated(rows.select("hash", "bytes", F.col("_text").cast("binary").alias("text")))
    per = spans.groupBy("hash", "bytes").agg(F.collect_set(F.struct("from", "to")).alias("spans")).withColumnsRenamed({"hash": "_hash", "bytes": "_bytes"})
    partly = texts.join(per, (F.col("hash") == F.col("_hash")) & (F.col("bytes") == F.col("_bytes"))).select("hash", "bytes", "packed", "spans")
    partly = partly.mapInArrow(_remove, _KEPT).withColumnsRenamed({"hash": "_hash", "bytes": "_bytes"})
    narrow = rows.select("doc_id", "hash", "bytes", F.sha2("_text", 256).alias("_sha"))
    copies = narrow.groupBy("hash", "bytes").count().where(F.col("count") > 1).select(F.col("hash").alias("_h"), F.col("bytes").alias("_b"))
    out = narrow.join(copies, (F.col("hash") == F.col("_h")) & (F.col("bytes") == F.col("_b")), "left")
    out = out.join(partly, (F.col("hash") == F.col("_hash")) & (F.col("bytes") == F.col("_bytes")), "left")
    gone = F.col("_h").isNotNull() & (F.col("bytes") >= SIZE)
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id",
        F.col("bytes").alias("n_bytes"),
        F.when(gone, F.col("bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "_sha")).alias("kept_sha256"),
        F.when(~gone, F.col("kept")).alias("kept"),
    )
