"""Approximate nearest neighbours by cross-polytope hashing.

Three rounds of random signs and a Hadamard transform turn a unit vector pseudo-randomly; its hash
is the nearest signed axis. A table joins as many such hashes as its number of buckets needs, which
follows the number of vectors until a query's probes would meet less than a stated share of them; from
there on buckets grow. A query probes, in each table, the buckets that its turned vector comes nearest
to, and what it meets there is ranked by exact distance. Directions tell little about vectors of unlike
lengths: those are compared exactly, block by block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidset.llm.common import written


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths; rows are a power of two long."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def axes_for(rows: int, dimension: int, per_bucket: float = 2.0) -> list[int]:
    """How many axes each hash of a table uses, so that buckets are about rows / ``per_bucket``."""
    out, left = [], max(2.0, rows / per_bucket)
    while left >= 2:
        k = min(dimension, 1 << max(0, int(math.log2(left / 2))))
        out.append(k)
        left /= 2 * k
    return out


class Tables:
    """``count`` tables of hashes over vectors of ``dimension``; all is drawn from ``seed``."""

    def __init__(self, dimension: int, rows: int, count: int, seed: int):
        self.width = 1 << max(1, (dimension - 1).bit_length())
        self.axes = axes_for(rows, self.width)
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (count, len(self.axes), 3, self.width))

    def turned(self, unit: np.ndarray, t: int, k: int) -> np.ndarray:
        x = unit
        for s in self.signs[t, k]:
            x = hadamard(x * s)
        return x[:, : self.axes[k]]

    def unit(self, x: np.ndarray) -> np.ndarray:
        x = np.pad(x, ((0, 0), (0, self.width - x.shape[1])))
        # Scaled first, so that squares neither overflow nor vanish.
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def hashes(self, unit: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Per vector the joined code of all hashes but the last, and the last."""
        code = np.zeros(len(unit), np.int64)
        for k, axes in enumerate(self.axes):
            y = self.turned(unit, t, k)
            a = np.abs(y).argmax(axis=1)
            last = 2 * a + (y[np.arange(len(y)), a] < 0)
            if k < len(self.axes) - 1:
                code = code * (2 * axes) + last
        return code, last

    def probes(self, unit: np.ndarray, t: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query the ``most`` likely buckets: codes and last hashes, by how far its coordinates fall short of the largest."""
        gaps, codes, last = np.zeros((len(unit), 1)), np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1), np.int64)
        for k, axes in enumerate(self.axes):
            y = self.turned(unit, t, k)
            short = (np.abs(y).max(axis=1)[:, None] - np.stack([y, -y], axis=2).reshape(len(y), -1)) ** 2
            order = np.argsort(short, axis=1, kind="stable")[:, :most]
            sums = (gaps[:, :, None] + np.take_along_axis(short, order, 1)[:, None, :]).reshape(len(y), -1)
            hashes = np.broadcast_to(order[:, None, :], (len(y), gaps.shape[1], order.shape[1])).reshape(len(y), -1)
            prefix = np.repeat(codes * (2 * self.axes[k - 1]) + last if k else codes, order.shape[1], axis=1)
            best = np.argsort(sums, axis=1, kind="stable")[:, :most]
            gaps, codes, last = (np.take_along_axis(z, best, 1) for z in (sums, prefix, hashes))
        return codes, last

def _length(vector: Column) -> Column:
    """The Euclidean length, scaled first, so that squares neither overflow nor vanish."""
    most = F.array_max(F.transform(vector, F.abs))
    return most * F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + (v / most) * (v / most)))


def _vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _rows(tables: Tables, count: int):
    def run(batches):
        for batch in batches:
            x = _vectors(batch.column(1))
            unit = tables.unit(x)
            for t in range(count):
                code, last = tables.hashes(unit, t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code * count + t), batch.column(0), batch.column(1), pa.array(last.astype(np.int32))],
                    names=["key", "id", "vector", "last"],
                )

    return run


def _probes(tables: Tables, count: int, most: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                unit = tables.unit(_vectors(part.column(1)))
                for t in range(count):
                    codes, last = tables.probes(unit, t, most)
                    n = np.repeat(np.arange(len(codes)), codes.shape[1])
                    order = np.lexsort((codes.ravel(), n))
                    n, code, hashes = n[order], codes.ravel()[order], last.ravel()[order].astype(np.int32)
                    first = np.flatnonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (code[1:] != code[:-1])]))
                    lists = pa.ListArray.from_arrays(pa.array([*first.tolist(), len(n)], pa.int32()), pa.array(hashes))
                    own = pa.array(n[first])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(code[first] * count + t), part.column(0).take(own), part.column(1).take(own), lists], names=["key", "id", "vector", "probes"]
                    )

    return run


def _rank(nearest: int, hashes: int):
    def run(batches):
        # Rows come by key and share, queries first, so only a share's queries are held.
        now, held = None, []
        for batch in batches:
            keys, shares, roles, ids = (batch.column(i).to_numpy() for i in range(4))
            change = np.flatnonzero((keys[1:] != keys[:-1]) | (shares[1:] != shares[:-1]) | (roles[1:] != roles[:-1])) + 1
            edges = [0, *change.tolist(), len(keys)]
            for s, e in zip(edges[:-1], edges[1:]):
                if s == e:
                    continue
                if (keys[s], shares[s]) != now:
                    now, held = (keys[s], shares[s]), []
                part = batch.slice(s, e - s)
                x = _vectors(part.column(4))
                lists = part.column(5)
                if roles[s] == 0:
                    wanted = np.zeros((len(x), hashes), bool)
                    sizes = np.diff(lists.offsets.to_numpy())
                    wanted[np.repeat(np.arange(len(x)), sizes), lists.flatten().to_numpy()] = True
                    held.append((ids[s:e], x, wanted))
                    continue
                last = lists.flatten().to_numpy()
                for queries, y, wanted in held:
                    for at in range(0, len(x), 4096):
                        q, r = np.nonzero(wanted[:, last[at : at + 4096]])
                        if not len(q):
                            continue
                        r += at
                        d = np.concatenate([np.sqrt(((y[q[i : i + 16384]] - x[r[i : i + 16384]]) ** 2).sum(axis=1)) for i in range(0, len(q), 16384)])
                        order = np.lexsort((ids[s:e][r], d, q))
                        q, r, d = q[order], r[order], d[order]
                        start = np.searchsorted(q, q)
                        best = np.arange(len(q)) - start < nearest
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(queries[q[best]]), pa.array(ids[s:e][r[best]]), pa.array(d[best])], names=["query_id", "id", "score"]
                        )

    return run


def _compare(nearest: int):
    """Each query of a cell against each of its points, by products of blocks; the nearest get their exact distance."""

    def run(batches):
        # Rows come by cell, queries first, so only a cell's queries are held.
        now, held = None, []
        for batch in batches:
            cells, shares, roles, ids = (batch.column(i).to_numpy() for i in range(4))
            change = np.flatnonzero((cells[1:] != cells[:-1]) | (shares[1:] != shares[:-1]) | (roles[1:] != roles[:-1])) + 1
            edges = [0, *change.tolist(), len(cells)]
            for s, e in zip(edges[:-1], edges[1:]):
                if s == e:
                    continue
                if (cells[s], shares[s]) != now:
                    now, held = (cells[s], shares[s]), []
                x = _vectors(batch.slice(s, e - s).column(4))
                if roles[s] == 0:
                    held += [(ids[s + at : min(e, s + at + 256)], x[at : at + 256]) for at in range(0, len(x), 256)]
                    continue
                for queries, y in held:
                    # One scale for both, so that squares stay finite; what the products round is let in.
                    scale = max(np.abs(x).max(), np.abs(y).max())
                    a, b = y / scale, x / scale
                    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
                    near = aa[:, None] + bb - 2 * (a @ b.T)
                    k = min(nearest, len(x)) - 1
                    slack = 1e-13 * x.shape[1] * (aa + bb.max())
                    q, r = np.nonzero(near <= (np.partition(near, k, axis=1)[:, k] + slack)[:, None])
                    d = np.concatenate([np.sqrt(((y[q[i : i + 16384]] - x[r[i : i + 16384]]) ** 2).sum(axis=1)) for i in range(0, len(q), 16384)])
                    order = np.lexsort((ids[s:e][r], d, q))
                    q, r, d = q[order], r[order], d[order]
                    best = np.arange(len(q)) - np.searchsorted(q, q) < nearest
                    yield pa.RecordBatch.from_arrays([pa.array(queries[q[best]]), pa.array(ids[s:e][r[best]]), pa.array(d[best])], names=["query_id", "id", "score"])

    return run


def compared(points: DataFrame, asks: DataFrame, nearest: int, block: int) -> DataFrame:
    """query_id, id, score: from each cell of about ``block`` queries and ``8 * block`` points each query's nearest."""
    groups, shares = (math.ceil(df.count() / n) for df, n in ((asks, block), (points, 8 * block)))
    if not groups or not shares:
        return points.sparkSession.createDataFrame([], "query_id long, id long, score double")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    points = points.select(every(groups).alias("cell"), own(shares).alias("share"), F.lit(1).alias("role"), "id", "vector")
    asks = asks.select(own(groups).alias("cell"), every(shares).alias("share"), F.lit(0).alias("role"), "id", "vector")
    dealt = points.unionAll(asks).repartition("cell", "share").sortWithinPartitions("cell", "share", "role")
    return dealt.mapInArrow(_compare(nearest), "query_id long, id long, score double")


def search(
    vectors: DataFrame,
    queries: Column,
    nearest: int = 10,
    tables: int = 16,
    probes: int = 128,
    share: int = 8192,
    met: float = 0.1,
    like: float = 1.1,
    seed: int = 11,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Each query's ``nearest`` rows found: query_id, rank (from 1), vec_id, score (Euclidean distance in doubles).

    ``queries`` is a condition over the input's columns; every other row of another id is a candidate.
    Equal vectors are one node that carries its least ids, so that copies cost one comparison; a
    bucket of more than ``share`` vectors is split, and its queries go to every part. All probes of a
    query together reach at least ``met`` of the buckets of a table, whatever the number of vectors. A
    vector whose length is over ``like`` times, or less than one ``like``-th of, the median length is
    compared exactly with every query, and as a query with every vector.

    Vectors that are null, zero, or hold null or non-finite numbers take no part, nor do rows of null
    ids or of another length than the most common one. Ties go to the smaller id; fewer candidates
    give fewer rows; no query or an empty table gives none. Other columns play no part.
    """
    x = F.col(vector).cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.where(F.col(key).isNotNull() & fine).select(F.col(key).cast("long").alias("id"), x.alias("vector"), queries.alias("asks"))
    rows = written(rows, "ann-vectors")
    dimension = rows.agg(F.mode(F.size("vector"), deterministic=True)).first()[0]
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if dimension is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == dimension)
    # A rank filter that Spark applies before the shuffle too: no copy group reaches a task whole.
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    nodes = rows.select("id", "vector").withColumn("_r", rank).where(F.col("_r") <= nearest + 1)
    nodes = nodes.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "vector", "ids")
    nodes = written(nodes, "ann-nodes")
    middle = nodes.agg(F.percentile_approx(_length(F.col("vector")), 0.5, 10000)).first()[0]
    alike = _length(F.col("vector")).between(middle / like, middle * like)
    count = nodes.where(alike).count()
    hashed = Tables(int(dimension), min(count, math.ceil(2 * tables * probes / met)), tables, seed)
    width = 2 * hashed.axes[-1]
    asked = rows.where("asks").select("id", "vector")
    unlike = compared(nodes.where(~alike).select("id", "vector"), asked, nearest + 1, share)
    if count < nodes.count():
        unlike = unlike.unionAll(compared(nodes.where(alike).select("id", "vector"), asked.where(~alike), nearest + 1, share))
    points = nodes.where(alike).select("id", "vector").mapInArrow(_rows(hashed, tables), "key long, id long, vector array<double>, last int")
    asks = asked.where(alike).mapInArrow(_probes(hashed, tables, probes), "key long, id long, vector array<double>, probes array<int>")
    large = points.groupBy("key").count().where(F.col("count") > share).select(F.col("key").alias("_key"), F.ceil(F.col("count") / share).cast("int").alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(1))
    points = points.join(large, F.col("key") == F.col("_key"), "left").select(
        "key", F.pmod(F.xxhash64("id"), n).cast("int").alias("share"), F.lit(1).alias("role"), "id", "vector", F.array("last").alias("last")
    )
    asks = asks.join(large, F.col("key") == F.col("_key"), "left").select(
        "key", F.explode(F.sequence(F.lit(0), n - 1)).alias("share"), F.lit(0).alias("role"), "id", "vector", F.col("probes").alias("last")
    )
    dealt = points.unionAll(asks).repartition("key", "share").sortWithinPartitions("key", "share", "role")
    found = dealt.mapInArrow(_rank(nearest + 1, width), "query_id long, id long, score double").unionAll(unlike).distinct()
    # A query has at most (tables * probes * shares) * (nearest + 1) rows here; the filter applies before the shuffle too.
    order = Window.partitionBy("query_id").orderBy("score", "id")
    found = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= nearest + 1).drop("_r")
    members = nodes.select(F.col("id").alias("_id"), F.explode("ids").alias("vec_id"))
    found = found.join(members, F.col("id") == F.col("_id")).where(F.col("vec_id") != F.col("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
