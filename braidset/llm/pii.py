"""Personal data by patterns and a skip-chain conditional random field.

The patterns' spans always stay. The field labels a document's tokens that hold a digit or an
at sign: each token has node potentials from its shape and neighbours, adjacent tokens share
chain potentials, and distant tokens that repeat or resemble each other share skip potentials, so
that a label found in one place is weighed in the others. Loopy message passing spreads them over
the document; tokens that are then surely personal, and that no pattern caught, become spans too.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidset.llm.common import written

#: Fixed values of the contract: the kinds in their order, and their patterns (below, in linear-time form).
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++){3,}+")
_NUMBER = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")

LABELS = 1 + len(KINDS)
FEATURES = 1 << 12
#: The bounds of what the field is fit on: documents, and their tokens together.
SAMPLE, TOKENS = 4000, 50_000
#: Rounds after which a text's messages stop if they still swing.
ROUNDS = 200
#: Features that tell of the words around a token, not of itself (after the bias); and the share of tokens that show only these while fitting.
CONTEXT, HIDE = (0, 4, 5), 0.3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: from each domain back over the local part, so no run is scanned twice."""
    out, last = [], 0
    if "@" not in text:
        return out
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            last = m.end()
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """A dotted chain of numbers gives its leftmost fours."""
    out = []
    for m in _DOTTED.finditer(text):
        numbers = list(_NUMBER.finditer(text, m.start(), m.end()))
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i : i + 4]
            if all(len(n[0].lstrip("0")) <= 3 and int(n[0].lstrip("0") or 0) <= 255 for n in four):
                out.append((four[0].start(), four[3].end()))
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' spans, by kind and start, in code points."""
    if not _HINT.search(text):
        return []
    return [(k, a, b) for k, find in enumerate((emails, addresses, cards, phones)) for a, b in find(text)]


def shape(token: str) -> str:
    """Runs of letters and digits as one sign each, marks as they are; at most 12 signs."""
    return re.sub(r"9+", "9", re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", token)))[:12]


@dataclass
class Tokens:
    """The labelled tokens of one text: core spans, features of each, edges, and whether each follows the last at once."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    joined: list[bool]


def _feature(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % FEATURES


def tokens(text: str) -> Tokens:
    """Tokens with a digit or an at sign, without marks around them.

    A skip edge ties a token to the first one of the same letters and digits, of the same last seven
    digits, or of the same at-sign domain: edges stay as many as tokens, and what one repeat
    knows reaches all others over that hub, however far they are apart.
    """
    out = Tokens([], [], [], [], [])
    hubs: dict[tuple, int] = {}
    previous = -2
    words = list(_TOKEN.finditer(text))
    for n, m in enumerate(words):
        raw = m[0]
        if not _HINT.search(raw):
            continue
        core = raw.strip(".,;:!?\"'()[]<>{}|*#%$&=")
        lead = raw.find(core) if core else 0
        core = core or raw
        start = m.start() + lead
        digits = "".join(c for c in core if c in "0123456789")
        before = words[n - 1][0][-12:].lower() if n else "^"
        after = words[n + 1][0][:12].lower() if n + 1 < len(words) else "$"
        marks = "".join(sorted({c for c in core if not c.isalnum()}))[:6]
        parts = core.split(".")
        quad = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
        names = ["bias", f"s{shape(core)}", f"d{min(len(digits), 20)}", f"m{marks}", f"b{shape(before)}", f"a{shape(after)}"]
        names += [f"l{luhn(digits) if len(digits) >= 13 else None}", f"q{quad}", f"@{'@' in core}{'.' in core.rpartition('@')[2]}", f"n{min(len(core), 24) // 3}"]
        names += [f"plus{raw.startswith('+')}{before.startswith('+')}"]
        i = len(out.spans)
        out.spans.append((start, start + len(core)))
        out.features.append([_feature(x) for x in names])
        out.joined.append(n - previous == 1)
        if i:
            out.chain.append((i - 1, i))
        previous = n
        keys = [("same", "".join(c for c in core.lower() if c.isalnum()))]
        if len(digits) >= 7:
            keys.append(("tail", digits[-7:]))
        if "@" in core:
            keys.append(("domain", core.rpartition("@")[2].lower()))
        for j in sorted({hubs[k] for k in keys if k in hubs}):
            out.skip.append((j, i))
        for k in keys:
            hubs.setdefault(k, i)
    return out


@dataclass
class Field:
    """Node weights by feature and label, and the log potentials of chain and skip edges."""

    nodes: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, all_tokens: list[Tokens], rounds: int = ROUNDS, damp: float = 0.3, near: float = 1e-4) -> np.ndarray:
        """Label probabilities of all tokens of many texts, by loopy message passing over all edges at once.

        A text's messages rest once none of them changes by ``near``, whatever the texts beside it do. Loops may keep
        some swinging: such texts stop after ``rounds``, each for itself.
        """
        bases = np.cumsum([0] + [len(t.spans) for t in all_tokens])
        n = int(bases[-1])
        flat = np.array([f for t in all_tokens for x in t.features for f in x], np.int64)
        owner = np.repeat(np.arange(n), [len(x) for t in all_tokens for x in t.features])
        node = np.stack([np.bincount(owner, self.nodes[flat, y], n) for y in range(LABELS)], axis=1)
        edges = [(b + i, b + j, s, d) for d, (t, b) in enumerate(zip(all_tokens, bases.tolist())) for s, some in ((0, t.chain), (1, t.skip)) for i, j in some]
        if edges:
            i, j, s, text = np.array(edges, np.int64).T
            pair = np.where(s[:, None, None] == 1, self.skip, self.chain)
            source, target, text = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([text, text])
            pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
            message = np.zeros((len(source), LABELS))
            moving = np.arange(len(source))
            for _ in range(rounds):
                belief = node.copy()
                np.add.at(belief, target[moving], message[moving])
                # Both directions of an edge are of one text, so they move or rest together.
                fresh = _logsum((belief[source[moving]] - message[back[moving]])[:, :, None] + pair[moving], axis=1)
                fresh -= _logsum(fresh, axis=1)[:, None]
                change = np.zeros(len(all_tokens))
                np.maximum.at(change, text[moving], np.abs(fresh - message[moving]).max(axis=1))
                message[moving] = damp * message[moving] + (1 - damp) * fresh
                moving = moving[change[text[moving]] >= near]
                if not len(moving):
                    break
            np.add.at(node, target, message)
        return np.exp(node - _logsum(node, axis=1)[:, None])


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _gold(found: Tokens, spans: list[tuple[int, int, int]]) -> np.ndarray:
    gold = np.zeros(len(found.spans), np.int64)
    for k, a, b in reversed(spans):
        for i, (s, e) in enumerate(found.spans):
            if s < b and e > a:
                gold[i] = k + 1
    return gold


@dataclass
class Sample:
    """Tokens of many texts: a row of features and a label each, and the edges between them."""

    features: np.ndarray
    gold: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _entities(text: str, found: Tokens, gold: np.ndarray) -> np.ndarray:
    """``gold`` with its labels on every repeat of a long number or an address that patterns caught somewhere in the text."""
    keys = ["".join(c for c in text[a:b].lower() if c.isalnum()) for a, b in found.spans]
    known = {k: y for k, y in zip(keys, gold.tolist()) if y}
    long = [sum(c.isdigit() for c in k) >= 7 or "@" in text[a:b] for k, (a, b) in zip(keys, found.spans)]
    return np.array([known.get(k, 0) if y == 0 and of else y for k, y, of in zip(keys, gold.tolist(), long)], np.int64)


def sampled(texts: list[str]) -> Sample:
    """The tokens of whole texts with the labels of the patterns, and these carried to the repeats of what they caught."""
    found = [t for t in ((tokens(x), x) for x in texts) if t[0].spans]
    bases = np.cumsum([0] + [len(t.spans) for t, _ in found])
    features = np.array([x for t, _ in found for x in t.features], np.int64).reshape(int(bases[-1]), -1)
    gold = np.concatenate([_entities(x, t, _gold(t, base_spans(x))) for t, x in found]) if found else np.zeros(0, np.int64)
    edges = [np.array([(b + i, b + j) for (t, _), b in zip(found, bases.tolist()) for i, j in getattr(t, kind)], np.int64).reshape(-1, 2) for kind in ("chain", "skip")]
    return Sample(features, gold, *edges)


def fit_sample(sample: Sample, epochs: int = 400, rate: float = 1.5, decay: float = 1e-3, hide: float = HIDE, seed: int = 11) -> Field:
    """Fit to the patterns' labels by pseudo-likelihood: each token given its neighbours' labels.

    Patterns see a token's own signs alone. So that the field learns what they can't, a share ``hide`` of the tokens, drawn anew each
    epoch, is shown without these: their neighbours' words and the tokens they are tied to have to do. A token without a
    label, tied to one with a label, is neither personal nor not: nothing is learnt of it.
    """
    field = Field(np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    n = len(sample.gold)
    if not n:
        field.nodes[_feature("bias"), 0] = 10.0
        return field
    gold, chain, skip = sample.gold, sample.chain, sample.skip
    doubtful = np.zeros(n, bool)
    for a, b in (skip.T, skip.T[::-1]):
        doubtful[a[(gold[a] == 0) & (gold[b] > 0)]] = True
    chain, skip = (e[~doubtful[e].any(axis=1)] for e in (chain, skip))
    counted = (~doubtful)[:, None] / max(1, int((~doubtful).sum()))
    width = sample.features.shape[1]
    own = np.array([k not in CONTEXT for k in range(width)])
    hot = np.eye(LABELS)[gold]
    rng = np.random.default_rng(seed)
    sums = [np.full_like(x, 1e-6) for x in (field.nodes, field.chain, field.skip)]
    for _ in range(epochs):
        shown = np.where((rng.random(n) < hide)[:, None] & own, 0.0, 1.0)
        score = (field.nodes[sample.features] * shown[:, :, None]).sum(axis=1)
        for edges, table in ((chain, field.chain), (skip, field.skip)):
            np.add.at(score, edges[:, 0], table[:, gold[edges[:, 1]]].T)
            np.add.at(score, edges[:, 1], table[gold[edges[:, 0]]])
        error = (np.exp(score - _logsum(score, axis=1)[:, None]) - hot) * counted
        pull, at = (error[:, None, :] * shown[:, :, None]).reshape(-1, LABELS), sample.features.reshape(-1)
        grad = np.stack([np.bincount(at, pull[:, y], FEATURES) for y in range(LABELS)], axis=1)
        grads = [grad]
        for edges in (chain, skip):
            g = np.zeros((LABELS, LABELS))
            np.add.at(g.T, gold[edges[:, 1]], error[edges[:, 0]])
            np.add.at(g, gold[edges[:, 0]], error[edges[:, 1]])
            grads.append(g)
        for x, g, s in zip((field.nodes, field.chain, field.skip), grads, sums):
            g = g + decay / n * x
            s += g * g
            x -= rate * g / np.sqrt(s)
    return field


def fit_field(texts: list[str], **options) -> Field:
    return fit_sample(sampled(texts), **options)


def _sampled(batches):
    """Each text's tokens as flat lists, and how many they are."""
    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            s = sampled([text or ""])
            rows.append((key, len(s.gold), s.features.ravel().tolist(), s.gold.tolist(), s.chain.ravel().tolist(), s.skip.ravel().tolist()))
        kinds = (pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 4)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["id", "n", "features", "gold", "chain", "skip"])


def train(docs: DataFrame, sample: int = SAMPLE, most: int = TOKENS, key: str = "doc_id", text: str = "text") -> Field:
    """A field fit on documents that hold a digit or an at sign: those of the least hashed ids, at most ``sample``, and of them, in that
    order, those whose tokens are together at most ``most``; a document is taken whole or not at all, and one of each id.

    Tasks find the tokens and their labels; no text leaves them.
    """
    pairs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    some = pairs.where(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]")).select(F.col("doc_id").alias("_id")).distinct()
    some = some.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = pairs.join(F.broadcast(some), F.col("doc_id") == F.col("_id"), "left_semi")
    found = rows.mapInArrow(_sampled, "id long, n long, features array<int>, gold array<int>, chain array<int>, skip array<int>")
    one = found.groupBy("id").agg(F.min(F.struct("n", "features", "gold", "chain", "skip")).alias("s")).select("id", "s.*")
    one = written(one.where("n > 0"), "pii-sample")
    # A row for each sampled document, at most.
    order = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = one.select("id", "n").withColumn("_upto", F.sum("n").over(order)).where(F.col("_upto") <= most).select(F.col("id").alias("_kept"))
    got = one.join(F.broadcast(within), F.col("id") == F.col("_kept")).orderBy(F.xxhash64("id"), "id").toArrow()
    width = len(tokens("0").features[0])
    bases = np.concatenate([[0], np.cumsum(got.column("n").to_numpy())]).astype(np.int64)
    flat = {c: [np.asarray(x.values, dtype=np.int64) for x in got.column(c)] for c in ("features", "gold", "chain", "skip")}
    whole = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
    shifted = lambda c: whole([x + b for x, b in zip(flat[c], bases)]).reshape(-1, 2)
    return fit_sample(Sample(whole(flat["features"]).reshape(-1, width), whole(flat["gold"]), shifted("chain"), shifted("skip")))


def find(texts: list[str], field: Field, sure: float = 0.9) -> list[tuple[list, list]]:
    """For every text its base spans and all spans, (kind, start, end) by kind and start."""
    base = [base_spans(t) for t in texts]
    some = [i for i, t in enumerate(texts) if _HINT.search(t)]
    parsed = [tokens(texts[i]) for i in some]
    added: list[list] = [[] for _ in texts]
    if parsed:
        p = field.marginals(parsed)
        at = 0
        for i, t in zip(some, parsed):
            best = p[at : at + len(t.spans)]
            at += len(t.spans)
            label = np.where(best.max(axis=1) >= sure, best.argmax(axis=1), 0).tolist()
            runs: list[list[int]] = []
            for n, (k, (s, e)) in enumerate(zip(label, t.spans)):
                if not k:
                    continue
                if runs and t.joined[n] and n and label[n - 1] == k and runs[-1][3] == n - 1:
                    runs[-1][2:] = [e, n]
                else:
                    runs.append([k - 1, s, e, n])
            covered = sorted((a, b) for _, a, b in base[i])
            reach = list(accumulate((b for _, b in covered), max))
            added[i] = [(k, s, e) for k, s, e, _ in runs if not _touched(covered, reach, s, e)]
    return [(b, sorted(b + a)) for b, a in zip(base, added)]


def _touched(covered, reach, s: int, e: int) -> bool:
    """Whether a span that starts before ``e`` ends after ``s``; ``reach`` has the greatest end up to each span."""
    last = bisect_left(covered, (e, 0))
    return last > 0 and reach[last - 1] > s


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _detect(field: Field, sure: float):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = find([t or "" for t in part.column(1).to_pylist()], field, sure)
                counts = [[sum(k == kind for k, _, _ in b) for b, _ in found] for kind in range(len(KINDS))]
                digests = [hashlib.sha256(_join(b).encode()).hexdigest() for b, _ in found]
                columns = [part.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array([_join(s) for _, s in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return run


def detect(docs: DataFrame, field: Field, sure: float = 0.9, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (all, ``kind:start:end``).

    Counts and hash are of the patterns' spans alone; positions are code points, ends exclusive.
    Null and empty texts have no spans; null and repeated keys keep a row each; an empty table
    gives no row; other columns play no part. One pass, no shuffle.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_detect(field, sure), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans by the first's."""
    out, last = [], 0
    for a, b, k in sorted((a, -b, k) for k, a, b in spans):
        if a >= last:
            out += [text[last:a], f"[{KINDS[k].upper()}]"]
        last = max(last, -b)
    return "".join(out) + text[last:]


def _redact(field: Field, sure: float, text: str):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                place = part.schema.get_field_index(text)
                texts = part.column(place).to_pylist()
                found = find([t or "" for t in texts], field, sure)
                fresh = [t if t is None else redacted(t, s) for t, (_, s) in zip(texts, found)]
                yield part.set_column(place, part.schema.field(place), pa.array(fresh, part.schema.field(place).type))

    return run


def redact(docs: DataFrame, field: Field, sure: float = 0.9, text: str = "text") -> DataFrame:
    """``docs`` with all spans of personal data replaced by their kinds. One pass, no shuffle.

    Null texts stay null and empty ones empty; texts without spans stay as they are. Keys play no part; all columns stay,
    whatever their names; an empty table gives no row.
    """
    return docs.mapInArrow(_redact(field, sure, text), docs.schema)
