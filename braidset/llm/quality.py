"""Quality by regularised quadratic discriminant analysis of document statistics.

Each class has a mean and a covariance of transformed statistics, shrunk towards the pooled
covariance and its diagonal. A text's score is the logistic of the difference of the classes'
log densities, Mahalanobis distances by Cholesky factors that are computed once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidset.llm.common import key_crc, worker_cache, written
from braidset.llm.units import UnitHasher

STATISTICS = (
    "log_words", "word_length", "word_spread", "distinct", "repeats", "twins", "letters", "capitals", "digits", "marks",
    "symbols", "breaks", "pipes", "stops", "long_run", "other", "common", "line_words", "duplicate_lines",
)
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>{}[]\\^~=_@", np.uint8))
_STOPS = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))


def _logit(share):
    return np.log((share + 0.002) / (1.002 - share))


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """A row of transformed statistics for each whole text; null and empty texts have those of no words."""
    hasher = worker_cache().setdefault("units", UnitHasher())
    out = np.zeros((len(texts), len(STATISTICS)))
    for i, text in enumerate(texts):
        text = text or b""
        raw = np.frombuffer(text or b" ", np.uint8)
        words = text.split()
        n, size = len(words), max(1, len(text))
        lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
        counts = np.bincount(raw, minlength=256)
        units = hasher.units(text + b" ")
        word = units.words()
        hashes = units.hashes()[word]
        _, seen = np.unique(hashes, return_counts=True) if len(hashes) else (None, np.zeros(1, np.int64))
        m = max(1, len(hashes))
        twins = float((hashes[1:] == hashes[:-1]).sum()) / m
        pairs = hashes[1:] * np.uint64(3) + hashes[:-1]
        repeats = 1 - len(np.unique(pairs)) / max(1, len(pairs)) if len(pairs) else 0.0
        lines = [x for x in text.split(b"\n") if x.strip()]
        capitals, letters = counts[65:91].sum(), counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
        out[i] = (
            np.log1p(n),
            np.log1p(lengths.mean()),
            np.log1p(lengths.std()),
            # Distinct words fall with length by themselves: against the square root of their number.
            _logit(min(1.0, (seen > 0).sum() / m)) if len(hashes) else 0.0,
            _logit(repeats),
            _logit(twins),
            _logit(letters / size),
            _logit(capitals / max(1, letters)),
            _logit(counts[48:58].sum() / size),
            np.log1p(100 * (len(units.starts) - word.sum()) / max(1, n)),
            _logit(counts[_SYMBOLS].sum() / size),
            _logit(counts[10] / size),
            np.log1p(100 * counts[124] / max(1, n)),
            _logit(min(1.0, counts[_STOPS].sum() / max(1, n) / 3)),
            np.log1p(lengths.max()),
            _logit(counts[128:].sum() / size),
            _logit(min(1.0, seen.max() / m)),
            np.log1p(n / max(1, len(lines))),
            _logit(1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0),
        )
    return out


@dataclass
class Discriminant:
    means: np.ndarray
    covariances: np.ndarray
    priors: np.ndarray

    @cached_property
    def factors(self) -> list[np.ndarray]:
        """Inverse Cholesky factors of the classes' covariances."""
        return [np.linalg.inv(np.linalg.cholesky(c)) for c in self.covariances]

    def scores(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for mean, factor, prior in zip(self.means, self.factors, self.priors):
            z = (x - mean) @ factor.T
            logs.append(np.log(prior) + np.log(np.diag(factor)).sum() - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -40, 40)))


def discriminant(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, shrink: float = 0.1, ridge: float = 0.02) -> Discriminant:
    """From each class's count, sums and sums of products. ``shrink`` is the share of the pooled covariance, ``ridge`` of its diagonal.

    A class of no rows takes the pooled mean and covariance; no rows at all give a score of one half.
    """
    d = sums.shape[1]
    total = max(counts.sum(), 1.0)
    means = np.array([s / c if c else sums.sum(axis=0) / total for s, c in zip(sums, counts)])
    scatter = np.array([p - c * np.outer(m, m) for p, c, m in zip(products, counts, means)])
    pooled = scatter.sum(axis=0) / total
    base = np.diag(np.diag(pooled) + 1e-3)
    covariances = []
    for s, c in zip(scatter, counts):
        # Few rows lean on the pooled covariance more.
        part = shrink + (1 - shrink) * d / (d + c)
        covariances.append((1 - ridge) * ((1 - part) * s / max(c, 1.0) + part * pooled) + ridge * base)
    return Discriminant(means, np.array(covariances), (counts + 1) / (total + 2))


def _measure(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            x = statistics(part.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and x, the statistics of every whole text, written once: the texts are read once and never shuffled.

    Null and empty texts have the statistics of no words; null and repeated keys keep a row each;
    an empty table gives no row; other columns play no part.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(_measure, "doc_id long, x array<double>"), "quality")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _moments(batches):
    d = len(STATISTICS)
    counts, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for batch in batches:
        labels, x = batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(0))
        for k in (0, 1):
            own = x[labels == k]
            counts[k] += len(own)
            sums[k] += own.sum(axis=0)
            products[k] += own.T @ own
    flat = np.concatenate([counts, sums.ravel(), products.ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["at", "value"])


def train(rows: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", key: str = "doc_id") -> Discriminant:
    """Fit on all labelled ``rows`` (of ``measured``) for which ``learn`` (over ``doc_id``) holds, from sums that tasks add up.

    Rows with a null or other label or a null id are left out; of repeated labels of one id the least counts.
    """
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("_label"))
    known = known.where(learn & F.col("_label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("_label").alias("_label"))
    joined = rows.join(known, F.col("doc_id") == F.col("_id")).select("x", "_label")
    parts = joined.mapInArrow(_moments, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    # As many rows as the classes have moments.
    d = len(STATISTICS)
    flat = np.zeros(2 + 2 * d + 2 * d * d)
    for at, value in parts.collect():
        flat[at] = value
    return discriminant(flat[:2], flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d))


def _score(model: Discriminant):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(_matrix(batch.column(1))))], names=["doc_id", "score"])

    return run


def score(rows: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (1 from ``threshold``) of ``rows`` (of ``measured``). Only the text entered the score."""
    scored = rows.mapInArrow(_score(model), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(key: Column) -> Column:
    """Fixed by the contract: rows whose crc32 of the id, modulo 5, is 0 are never learnt from."""
    return key_crc(key, 5) == 0
