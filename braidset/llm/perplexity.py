"""Quality rules: simple counts, then the perplexity of a modified Kneser-Ney model in bands of each language.

The model predicts each character of a word, and its end, from up to four characters before it.
Spark counts the n-grams of the whole corpus; the counts' discounts and interpolation weights are
aggregates too. A task holds them in sorted arrays keyed by 62-bit hashes, one entry for each n-gram
of the corpus. A document's verdict compares its log perplexity with the band of its language.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidset.llm.common import worker_cache, written

ORDER = 5
#: Primes and bases of the two halves of an n-gram's hash; each step fits into 63 bits.
HALVES = ((2_147_483_647, 1_000_003), (2_147_483_629, 1_618_033_989))
#: Marks before and after a word; neither occurs in a word.
BEGIN, END = "\x0a", "\x0d"
#: The limits of the bands, in robust deviations below and above the median of a language.
LOWER, UPPER = 3.8, 5.0
#: Words whose score a worker remembers.
WORDS = 400_000


def _grams(batches):
    """(gram, count) of a task's words, each character with up to four before it; counts are flushed in bounded parts."""

    def flush(words):
        grams: Counter = Counter()
        for word, n in words.items():
            x = BEGIN + word.decode("utf-8", "replace") + END
            for j in range(1, len(x)):
                grams[x[max(0, j - ORDER + 1) : j + 1]] += n
        return pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["gram", "n"])

    words: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            words.update((text.as_py() or b"").lower().split())
            if len(words) > WORDS:
                yield flush(words)
                words = Counter()
    if words:
        yield flush(words)


def _slot(gram: Column, length: int) -> Column:
    """The hash of a gram of known length, the same polynomials that tasks use."""
    halves = []
    for prime, base in HALVES:
        h = F.lit(0).cast("long")
        for i in range(1, length + 1):
            h = (h * base + F.ascii(F.substring(gram, i, 1))) % prime
        halves.append(h)
    return halves[0] * (1 << 31) + halves[1]


def _discounts(level: DataFrame) -> list[float]:
    """The three discounts of modified Kneser-Ney, from the number of n-grams that occur one to four times."""
    n1, n2, n3, n4 = (x or 0 for x in level.agg(*[F.count_if(F.col("a") == k) for k in (1, 2, 3, 4)]).first())
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    # Of few n-grams the estimates may leave their ranges.
    return [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]


@dataclass
class Model:
    """Per order, sorted hashes of n-grams with their discounted shares, and of contexts with their weights."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    vocabulary: int

    @staticmethod
    def _get(table, hashes, default):
        keys, values = table
        if not len(keys):
            return np.full(len(hashes), default)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, values[at], default)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The log probability of each word with its end, and the number of characters predicted."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        codes = np.frombuffer("".join(BEGIN + w + END for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        p = np.full(len(codes), 1.0 / (self.vocabulary + 1))
        for n in range(1, ORDER + 1):
            at = np.flatnonzero(place >= max(1, n - 1))
            contexts, grams = [], []
            for prime, base in HALVES:
                h = np.zeros(len(at), np.int64)
                for back in range(n - 1, 0, -1):
                    h = (h * base + codes[at - back]) % prime
                contexts.append(h)
                grams.append((h * base + codes[at]) % prime)
            share = self._get(self.grams[n - 1], grams[0] * (1 << 31) + grams[1], 0.0)
            p[at] = share + self._get(self.contexts[n - 1], contexts[0] * (1 << 31) + contexts[1], 1.0) * p[at]
        logs = np.where(place > 0, np.log(p), 0.0)
        return np.add.reduceat(logs, np.cumsum(sizes) - sizes), sizes - 1


def _array(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and values, one of each n-gram; a shared hash, of odds 2**-62 a pair, keeps the more frequent."""
    got = rows.groupBy("slot").agg(F.max_by("value", F.struct("weight", "value")).alias("value")).toArrow()
    keys, values = got.column("slot").to_numpy(), got.column("value").to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count the n-grams of all documents and derive the model.

    The n-grams are shuffled once, as one row for each task and n-gram. The driver and
    each task hold 16 bytes for every distinct n-gram and context of the corpus.
    """
    counts = docs.select(text).mapInArrow(_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("a"))
    counts = written(counts, "ngrams")
    grams, contexts = [], []
    level = None
    for n in range(ORDER, 0, -1):
        size = F.char_length("gram") == n
        if n == ORDER:
            level = counts.where(size)
        else:
            # Below the highest order an n-gram counts the characters that it follows, but a word's beginning as it occurs.
            followed = level.groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.count(F.lit(1)).alias("a"))
            level = followed.unionAll(counts.where(size & F.col("gram").startswith(BEGIN))) if n > 1 else followed
        level = written(level.where(F.col("gram") != BEGIN), f"ngrams-{n}")
        d = _discounts(level)
        cut = F.when(F.col("a") == 1, d[0]).when(F.col("a") == 2, d[1]).otherwise(d[2])
        per = level.groupBy(F.substring("gram", 1, n - 1).alias("context")).agg(F.sum("a").alias("total"), F.sum(cut).alias("left"))
        joined = level.join(per, F.substring("gram", 1, n - 1) == F.col("context"))
        grams.append(_array(joined.select(_slot(F.col("gram"), n).alias("slot"), ((F.col("a") - cut) / F.col("total")).alias("value"), F.col("a").alias("weight"))))
        contexts.append(_array(per.select(_slot(F.col("context"), n - 1).alias("slot"), (F.col("left") / F.col("total")).alias("value"), F.col("total").alias("weight"))))
    return Model(grams[::-1], contexts[::-1], len(grams[-1][0]))


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_LOW = np.arange(256).astype(np.uint8)
_LOW[65:91] += 32
_BYTE = np.random.default_rng(77).integers(1, 2**63, 256, np.uint64)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    cache = worker_cache()
    have = cache.get(("powers", base))
    if have is None or len(have) < n:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
        have = cache["powers", base] = out
    return have[:n]


def measure(texts: list[bytes], model: Model | None, scored: dict) -> np.ndarray:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log probability, characters predicted."""
    data = b" ".join(texts) + b" "
    raw = np.frombuffer(data, np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[raw]
    edge = np.diff(space.astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = ends[len(ends) - len(starts) :]
    owner = np.searchsorted(ends_of, starts, "right")
    n = len(texts)
    out = np.zeros((n, 7))
    out[:, 0] = np.bincount(owner, minlength=n)
    bounds = np.concatenate([[0], ends_of])

    def per_text(flags):
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])

    out[:, 1] = per_text(~space & ((raw & 0xC0) != 0x80))
    out[:, 2] = per_text(_SYMBOL[raw])
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        out[i, 3] = len(lines) - len(set(lines))
    if not len(starts):
        return out
    powers, backs = _powers(_STEP, len(raw)), _powers(_BACK, len(raw))

    def hashed(of):
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[of] * powers, dtype=np.uint64)])
        h = (prefix[ends] - prefix[starts]) * backs[starts]
        return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)

    exact = hashed(raw)
    if len(exact) > 2:
        inside = owner[2:] == owner[:-2]
        three = (exact[:-2] * np.uint64(0x9E3779B97F4A7C15) + exact[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + exact[2:]
        three = (three ^ (three >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + owner[2:].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        at = np.flatnonzero(inside)
        _, back, times = np.unique(three[at], return_inverse=True, return_counts=True)
        again = at[times[back] > 1]
        marked = np.zeros(len(exact), bool)
        for k in (0, 1, 2):
            marked[again + k] = True
        out[:, 4] = np.bincount(owner[marked], minlength=n)
    if model is not None:
        known, first, back = np.unique(hashed(_LOW[raw]), return_index=True, return_inverse=True)
        keys = known.tolist()
        got = [scored.get(k) for k in keys]
        new = [i for i, g in enumerate(got) if g is None]
        if new:
            if len(scored) + len(new) > WORDS:
                scored.clear()
            low = data.lower()
            for at in range(0, len(new), 20_000):
                part = new[at : at + 20_000]
                logs, chars = model.words([low[starts[first[i]] : ends[first[i]]].decode("utf-8", "replace") for i in part])
                for i, a, b in zip(part, logs.tolist(), chars.tolist()):
                    got[i] = scored[keys[i]] = (a, b)
        values = np.array(got)[back]
        out[:, 5] = np.bincount(owner, values[:, 0], n)
        out[:, 6] = np.bincount(owner, values[:, 1], n)
    return out


_MEASURED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"


def _measured(shared):
    def run(batches):
        # A broadcast value is pickled by reference: plain arrays need no copy of this package.
        model, scored = Model(*shared.value), {}
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, first, size = [], at, 0
                column = batch.column(2)
                while at < batch.num_rows and (not texts or size < 1 << 19):
                    texts.append((column[at].as_py() or "").encode("utf-8", "replace"))
                    size += len(texts[-1])
                    at += 1
                x = measure(texts, model, scored)
                part = batch.slice(first, len(texts))
                loss = np.where(x[:, 6] > 0, -x[:, 5] / np.maximum(x[:, 6], 1), np.nan)
                counts = [pa.array(c.astype(np.int64)) for c in x[:, :5].T]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *counts, pa.array(loss, from_pandas=True)],
                    names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity"],
                )

    return run


def judge(
    docs: DataFrame, lower: float = LOWER, upper: float = UPPER, floor: float = 0.02, key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_perplexity, base_failed, kept.

    ``base_failed``: fewer than 50 words, or over half of them in repeated windows of three words.
    ``kept``: not failed, and the log perplexity of a character neither more than ``lower`` robust deviations below the
    median of its language nor more than ``upper`` above it. Each side of a language has a deviation of its own (at least
    ``floor``), over all its documents that did not fail: text too plain and text too strange stray differently.

    Null and empty texts have no words, no perplexity, and fail; a null language is a language of
    its own; null and repeated keys keep a row each; an empty table gives no row. Other columns play
    no part.
    """
    spark = docs.sparkSession
    model = train(docs, text)
    model = spark.sparkContext.broadcast((model.grams, model.contexts, model.vocabulary))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = written(rows.mapInArrow(_measured(model), _MEASURED), "perplexity")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    rows = rows.withColumn("base_failed", failed)
    sound = rows.where(~F.col("base_failed"))
    middle = sound.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10000).alias("middle"))
    middle = middle.withColumnRenamed("lang", "_lang")
    off = F.col("log_perplexity") - F.col("middle")
    half = lambda side, name: (F.percentile_approx(F.when(side >= 0, side), 0.5, 10000) * 1.4826).alias(name)
    spread = sound.join(middle, F.col("lang").eqNullSafe(F.col("_lang"))).groupBy("_lang", "middle").agg(half(-off, "below"), half(off, "above"))
    out = rows.join(spread, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    reach = lambda name, width: F.greatest(F.col(name), F.lit(floor)) * width
    inside = (-off <= reach("below", lower)) & (off <= reach("above", upper))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity", "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
    )
