"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and their first four bytes, each once a document, hashed into
2**bits buckets. Beside a weight, each bucket has a short vector; two terms of a text add the
product of their vectors, so that a pair may count for more, or less, than its terms apart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidset.llm.common import key_crc, worker_cache, written
from braidset.llm.units import UnitHasher

BITS = 22
#: The bound of the labelled sample that the model is fit on.
SAMPLE = 20_000
#: The screens: texts a bucket is in, chi-square of its labels, standard errors of a pair's interaction, buckets whose pairs are tested.
LEAST, CHANCE, SURE, CANDIDATES = 4, 10.8, 6.0, 1024


def terms(texts: list[bytes | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of every whole text, one text after the other, and the number of each."""
    cache = worker_cache()
    hasher = cache.setdefault("units", UnitHasher())
    out, at = [], 0
    counts = np.zeros(len(texts), np.int64)
    while at < len(texts):
        first, take, size = at, [], 0
        while at < len(texts) and (not take or size < 1 << 19):
            take.append(texts[at] or b"")
            size += len(take[-1])
            at += 1
        units = hasher.units(b" ".join(take) + b" ")
        word = units.words()
        starts, ends = units.starts[word], units.ends[word]
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in take]), starts, "right")
        whole = units.hashes(starts, ends) >> np.uint64(64 - bits)
        head = (units.hashes(starts, np.minimum(ends, starts + 4)) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - bits)
        both = np.concatenate([(text.astype(np.uint64) << np.uint64(bits)) | h for h in (whole, head)])
        both = np.unique(both)
        counts[first:at] = np.bincount((both >> np.uint64(bits)).astype(np.int64), minlength=len(take))
        out.append((both & np.uint64((1 << bits) - 1)).astype(np.int32))
    return (np.concatenate(out) if out else np.zeros(0, np.int32)), counts


@dataclass
class Machine:
    """A fitted factorization machine over the buckets it keeps."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, items: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Margins of ``n`` texts; ``items`` are kept buckets' positions, ``owner`` their texts."""
        out = self.bias + np.bincount(owner, self.weights[items], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[items, f]
            out += (np.bincount(owner, v, n) ** 2 - np.bincount(owner, v * v, n)) / 2
        return out

    def scores(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(self.buckets):
            return np.full(len(counts), 1 / (1 + np.exp(-self.bias)))
        at = np.minimum(np.searchsorted(self.buckets, buckets), len(self.buckets) - 1)
        known = self.buckets[at] == buckets
        owner = np.repeat(np.arange(len(counts)), counts)[known]
        return 1 / (1 + np.exp(-np.clip(self.margins(at[known], owner, len(counts)), -40, 40)))


def odd_terms(seen, marked, n: int, share: float):
    """Chi-square of terms' counts under the labels: ``seen`` and ``marked`` may be numpy arrays or columns."""
    return (marked - share * seen) ** 2 / (share * (1 - share) * seen * (1 - seen / max(n, 1)) + 1e-9)


def interactions(present: np.ndarray, labels: np.ndarray, block: slice, sure: float = SURE) -> list[tuple[int, int, float]]:
    """Pairs (i, j, log odds) of a column in ``block`` with a later one, that no sum of two weights explains.

    The log odds of the label are taken in the four cells of a pair; what is left of them beyond a
    sum is the interaction, kept if it is over ``sure`` standard errors from zero.
    """
    x = present.astype(np.float32)
    some = labels != 0
    tables = []
    for rows, y in ((x, len(labels)), (x[some], int(some.sum()))):
        both = rows[:, block].T @ rows
        one, other = rows[:, block].sum(axis=0)[:, None], rows.sum(axis=0)[None, :]
        tables.append([both, one - both, other - both, y - one - other + both])
    theta, spread = 0.0, 0.0
    for n, p, sign in zip(*tables, (1, -1, -1, 1)):
        p, q = p + 0.5, n - p + 0.5
        theta = theta + sign * np.log(p / q)
        spread = spread + 1 / p + 1 / q
    first = np.arange(x.shape[1])[block][:, None]
    i, j = np.nonzero((np.abs(theta) >= sure * np.sqrt(spread)) & (np.arange(x.shape[1])[None, :] > first))
    return [(int(first[a, 0]), int(b), float(theta[a, b])) for a, b in zip(i, j)]


def paired_factors(size: int, pairs: list[tuple[int, int, float]], rank: int) -> np.ndarray:
    """Vectors whose products come near the pairs' log odds: the leading eigenvectors of their matrix.

    Its diagonal, which no text uses, is set so that all eigenvalues are positive.
    """
    used = sorted({k for i, j, _ in pairs for k in (i, j)})
    at = {k: n for n, k in enumerate(used)}
    table = np.zeros((len(used), len(used)))
    for i, j, theta in pairs:
        table[at[i], at[j]] = table[at[j], at[i]] = theta
    table[np.diag_indices(len(used))] = np.abs(table).sum(axis=1)
    values, vectors = np.linalg.eigh(table)
    lead = vectors[:, ::-1][:, :rank] * np.sqrt(np.maximum(values[::-1][:rank], 0))
    out = np.zeros((size, rank))
    out[used, : lead.shape[1]] = lead
    return out


def fit_kept(
    kept: np.ndarray, pairs: list[tuple[int, int, float]], items: np.ndarray, owner: np.ndarray, labels: np.ndarray, rank: int = 4, epochs: int = 30, rate: float = 0.2, decay: float = 1e-5, seed: int = 5
) -> Machine:
    """Logistic loss by mini-batches with AdaGrad steps, over the ``kept`` buckets.

    ``items`` are positions in ``kept``, ``owner`` their texts, in rising order; ``pairs`` hold positions too,
    and where the vectors of their buckets start.
    """
    n = len(labels)
    share = np.clip(labels.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    rng = np.random.default_rng(seed)
    model = Machine(kept, float(np.log(share / (1 - share))), np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), rank)))
    if not len(kept) or labels.min() == labels.max():
        return model
    if pairs:
        model.factors += paired_factors(len(kept), pairs, rank)
    ends = np.cumsum(np.bincount(owner, minlength=n))
    starts = np.concatenate([[0], ends[:-1]])
    sums = [1e-6, np.full(len(kept), 1e-6), np.full((len(kept), rank), 1e-6)]
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), max(1, n // 256)):
            sizes = (ends - starts)[part]
            index = np.repeat(starts[part] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            own, k = np.repeat(np.arange(len(part)), sizes), items[index]
            error = 1 / (1 + np.exp(-np.clip(model.margins(k, own, len(part)), -40, 40))) - labels[part]
            g = error.mean()
            sums[0] += g * g
            model.bias -= rate * g / np.sqrt(sums[0])
            pull = error[own] / len(part)
            used, local = np.unique(k, return_inverse=True)
            g = np.bincount(local, pull) + decay * model.weights[used]
            sums[1][used] += g * g
            grads = []
            for f in range(rank):
                v = model.factors[k, f]
                whole = np.bincount(own, v, len(part))
                grads.append(np.bincount(local, pull * (whole[own] - v)) + decay * model.factors[used, f])
            model.weights[used] -= rate * g / np.sqrt(sums[1][used])
            g = np.stack(grads, axis=1)
            sums[2][used] += g * g
            model.factors[used] -= 0.1 * rate * g / np.sqrt(sums[2][used])
    return model


def fit_machine(
    buckets: np.ndarray, counts: np.ndarray, labels: np.ndarray, rank: int = 4, least: int = LEAST, chance: float = CHANCE, sure: float = SURE, candidates: int = CANDIDATES, **options
) -> Machine:
    """A machine over a sample in memory, with the screens of ``train``."""
    n = len(labels)
    share = float(np.clip(labels.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    owner = np.repeat(np.arange(n), counts)
    seen = np.bincount(buckets, minlength=1)
    marked = np.bincount(buckets, labels[owner], minlength=1)
    odd = np.flatnonzero((seen >= least) & (odd_terms(seen, marked, n, share) >= chance))
    even = np.array(sorted(np.flatnonzero(seen >= least).tolist(), key=lambda k: (-int(seen[k]) * (n - int(seen[k])), k))[:candidates], np.int64)
    present = np.zeros((n, len(even)), bool)
    place = np.full(len(seen), -1)
    place[even] = np.arange(len(even))
    present[owner[place[buckets] >= 0], place[buckets][place[buckets] >= 0]] = True
    pairs = [(even[i], even[j], t) for i, j, t in interactions(present, labels, slice(0, len(even)), sure)]
    kept = np.array(sorted({*odd.tolist(), *(int(k) for i, j, _ in pairs for k in (i, j))}), np.int32)
    place = np.full(len(seen), -1)
    place[kept] = np.arange(len(kept))
    known = place[buckets] >= 0
    return fit_kept(kept, [(int(place[i]), int(place[j]), t) for i, j, t in pairs], place[buckets][known], owner[known], labels, rank, **options)


def _buckets(bits: int):
    def run(batches):
        for batch in batches:
            found, counts = terms(batch.column(2).cast(pa.binary()).to_pylist(), bits)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["id", "label", "buckets"])

    return run


def _places(lists: pa.Array, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's buckets those in ``wanted`` (sorted), as positions in it, and their texts."""
    flat, counts = np.asarray(lists.flatten()), np.diff(np.asarray(lists.offsets))
    at = np.minimum(np.searchsorted(wanted, flat), len(wanted) - 1) if len(wanted) else np.zeros(len(flat), np.int64)
    known = wanted[at] == flat if len(wanted) else np.zeros(len(flat), bool)
    return at[known], np.repeat(np.arange(len(counts)), counts)[known]


def _present(wanted: np.ndarray):
    def run(batches):
        for batch in batches:
            at, owner = _places(batch.column(1), wanted)
            grid = np.zeros((batch.num_rows, len(wanted)), bool)
            grid[owner, at] = True
            rows = [r.tobytes() for r in np.packbits(grid, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["label", "present"])

    return run


def _only(wanted: np.ndarray):
    def run(batches):
        for batch in batches:
            at, owner = _places(batch.column(1), wanted)
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))], names=["label", "items"])

    return run


def _tested(sample, width: int, block: int, sure: float):
    def run(batches):
        rows, labels = sample.value
        present = np.unpackbits(np.frombuffer(rows, np.uint8).reshape(len(labels), -1), axis=1)[:, :width].astype(bool)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                found = interactions(present, labels, slice(k * block, min(width, (k + 1) * block)), sure)
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["i", "j", "theta"])

    return run


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", sample: int = SAMPLE, bits: int = BITS, key: str = "doc_id", text: str = "text",
    least: int = LEAST, chance: float = CHANCE, sure: float = SURE, candidates: int = CANDIDATES,
) -> Machine:
    """A machine fit on labelled rows for which ``learn`` (over the labels' ``doc_id``) holds.

    Of more than ``sample`` such ids those of the least hashes are taken: the bound of what is learnt from.
    Rows with a null label or id are left out; of repeated labels of one id the least counts, and of repeated
    rows one; an empty sample gives a score of one half.

    Spark counts the sample's buckets. Kept are those in ``least`` texts whose counts under the two labels differ by
    more than chance (chi-square ``chance``), as a text's many common terms would drown its telling ones; and the buckets of
    pairs with an interaction (``sure`` standard errors), which may tell nothing alone. Pairs are those of the ``candidates``
    buckets nearest to half of the texts, where there are cells to compare. The driver receives the kept buckets of the sample.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("_label"))
    known = known.where(learn & F.col("_label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("_label").alias("_label"))
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("text")).join(F.broadcast(taken), F.col("_key") == F.col("_id")).select("_id", "_label", "text")
    found = rows.mapInArrow(_buckets(bits), "id long, label int, buckets array<int>")
    found = written(found.groupBy("id", "label").agg(F.min("buckets").alias("buckets")), "toxicity-terms")
    n, share = found.agg(F.count(F.lit(1)), F.avg("label")).first()
    share = float(np.clip(share if n else 0.5, 1e-3, 1 - 1e-3))
    counts = found.select("label", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("seen"), F.sum("label").alias("marked"))
    counts = written(counts.where(F.col("seen") >= least), "toxicity-counts")
    ids = lambda df: np.asarray(df.select("bucket").toArrow().column(0), dtype=np.int32)
    odd = ids(counts.where(odd_terms(F.col("seen"), F.col("marked"), n, share) >= chance))
    even = np.sort(ids(counts.orderBy((F.col("seen") * (F.lit(n) - F.col("seen"))).desc(), "bucket").limit(candidates)))
    pairs = []
    if len(even) > 1:
        got = found.select("label", "buckets").mapInArrow(_present(even), "label int, present binary").toArrow()
        # The sample's candidates as bits: sample x candidates / 8 bytes.
        bits_of = spark.sparkContext.broadcast((b"".join(got.column("present").to_pylist()), np.asarray(got.column("label"))))
        blocks = -(-len(even) // 64)
        tested = spark.range(blocks).repartition(blocks).mapInArrow(_tested(bits_of, len(even), 64, sure), "i int, j int, theta double")
        pairs = [(int(even[r.i]), int(even[r.j]), r.theta) for r in tested.orderBy("i", "j").collect()]
    kept = np.array(sorted({*odd.tolist(), *(k for i, j, _ in pairs for k in (i, j))}), np.int32)
    place = {int(k): at for at, k in enumerate(kept)}
    got = found.select("label", "buckets").mapInArrow(_only(kept), "label int, items array<int>").toArrow()
    items = [np.asarray(x.values) for x in got.column("items")]
    y = np.asarray(got.column("label"), dtype=float)
    # The rows' order is Spark's; the fit takes them in an order of their own.
    order = sorted(range(len(items)), key=lambda i: (y[i], items[i].tolist()))
    owner = np.repeat(np.arange(len(order)), [len(items[i]) for i in order])
    flat = np.concatenate([items[i] for i in order]) if order else np.zeros(0, np.int32)
    return fit_kept(kept, [(place[i], place[j], t) for i, j, t in pairs], flat, owner, y[order] if order else y)


def _score(model: Machine, bits: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found, counts = terms(part.column(1).cast(pa.binary()).to_pylist(), bits)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(found, counts))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Machine, threshold: float = 0.7, bits: int = BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and predicted (1 from ``threshold``) of every whole text.

    Only the text enters the score. Null and empty texts get the score of no terms; null and
    repeated keys keep a row each; an empty table gives no row; other columns play no part.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.mapInArrow(_score(model, bits), "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(key: Column) -> Column:
    """Fixed by the contract: rows whose crc32 of the id, modulo 3, is 1 are never learnt from."""
    return key_crc(key, 3) == 1


def _reject(model: Machine, threshold: float, bits: int, text: str):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(part.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
                yield part.filter(pa.array(model.scores(*terms(texts, bits)) < threshold))

    return run


def keep_civil(docs: DataFrame, model: Machine, threshold: float = 0.7, bits: int = BITS, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, in one pass without a shuffle.

    Null and empty texts have the score of no terms. Keys play no part, so null and repeated ones, and rows equal in
    every column, are each judged by their text; all columns stay, whatever their names; an empty table gives no row.
    """
    return docs.mapInArrow(_reject(model, threshold, bits, text), docs.schema)
