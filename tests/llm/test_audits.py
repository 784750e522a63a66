"""Benchmark decontamination, the audit of filters, and the divergence of sources."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from braidset.llm import audit, decontaminate, divergence, queries, scan
from compare import connect, difference
from llm.helpers import docs, labels, rows, texts

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_filter_audit", "op13_divergence"])
def test_queries_equal_their_sql(spark, name):
    root = "/root/testdata/sf0.001"
    assert difference(queries.QUERIES[name](spark, root), connect(root), queries.SQL[name]) is None


def test_words_of_many_texts():
    some = [None, "", "  ", "a", "\x00b1 C\x7fd\x0be", "é-ü x", "日本 語"]
    found = scan.Texts(pa.array(["skip", *some, "skip"], pa.string()).slice(1, len(some)))
    for table, pattern in ((np.arange(256, dtype=np.uint8), r"[^\x20\x09-\x0D]+"), (decontaminate._WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (divergence._LETTERS, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")):
        low = (lambda t: t) if table[65] == 65 else (lambda t: t.translate(ASCII_LOWER))
        want = [re.findall(pattern, low(t or "")) for t in some]
        words, counts = found.words(table)
        assert words.to_pylist() == [w for ws in want for w in ws] and counts.tolist() == list(map(len, want))
    assert found.count(audit._CAPITALS).tolist() == [0, 0, 0, 0, 1, 0, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["t"])
    assert [x for p in scan.steps(batch, 0, 2) for x in p.column(0).to_pylist()] == some


# --- decontamination


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def brute_contamination(all_texts, items, size=10):
    windows = defaultdict(set)
    for key, text in items:
        w = words_of(text)
        n = min(len(w), size)
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(key or "")
    lengths = {len(w) for w in windows}
    out = []
    for text in all_texts:
        w, hit, held = words_of(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    held |= found
        out.append((len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return out


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id string, text string").withColumns({c: F.lit("clash") for c in ("words", "n", "keys", "key", "window", "doc_id")})


@pytest.mark.parametrize("most", [decontaminate.MOST_BITS, 64])
def test_contamination_edge_table(spark, most):
    r = random.Random(9)
    vocabulary = ["un", "deux", "3", "été", "日本", "it"]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(12)]
    items = [
        ("b1", base[0]), ("b2", base[1].upper()), ("b2", base[2] + " extra"), (None, base[3]), ("b3", "un"), ("b4", "deux 3 deux 3"), ("b5", None), ("b6", "--- !!"),
        ("b7", "a b c d e f g h i"), ("b8", "a b c d e f g h i j"), ("b9", "a b c d e f g h i j"), ("b10", "Shared passage of exactly ten words here it is now ok"), ("b11", texts()[30]),
    ]
    many = texts() + base + [b + ", x " + base[i - 1] for i, b in enumerate(base)] + ["a b c d e f g h", "A-b_c/d e f g h i", "x a b c d e f g h i j k", "i j a b c d e f g h", "un un-un", "un " * 500]
    got = rows(decontaminate.contamination(docs(spark, many).repartition(3), benchmark(spark, items), most=most), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert Counter(got) == Counter(brute_contamination(many, items))


def test_contamination_without_items_or_documents(spark):
    none = benchmark(spark, [("x", "no words of these")]).limit(0)
    got = rows(decontaminate.contamination(docs(spark, ["a b", None]), none), "n_hit", "contaminated")
    assert got == [(0, False), (0, False)]
    assert decontaminate.contamination(docs(spark).limit(0), benchmark(spark, [("x", "a b")])).count() == 0


def test_contamination_by_windows_of_long_items(spark):
    """A window counts only whole: nine of its words do not, ten across a line break and capitals do."""
    item = " ".join(f"w{i}" for i in range(30))
    some = [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 9), (0, 10), (11, 21), (5, 30))] + ["pre W3\nw4 w5 w6 w7 w8 w9 w10 w11 w12. post", " ".join(f"w{i}" for i in (*range(9), *range(10, 19)))]
    got = sorted(rows(decontaminate.contamination(docs(spark, some), benchmark(spark, [("q", item)])), "n_words", "n_hit", "n_items"))
    assert got == sorted([(9, 0, 0), (10, 10, 1), (10, 10, 1), (25, 25, 1), (12, 10, 1), (18, 0, 0)])


# --- audit of filters


def brute_masks(data):
    first = {}
    for key, text, _ in data:
        if key is not None:
            first[text or ""] = min(key, first.get(text or "", key))
    out = []
    for key, text, _ in data:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), key is not None and key > first[t])
        out.append(sum(f << i for i, f in enumerate(fails)))
    return out


def brute_audit(data, quality, toxic):
    masks = brute_masks(data)
    out = []
    for part in {s or "" for _, _, s in data}:
        own = [({f for f in range(5) if m >> f & 1}, k) for m, (k, _, s) in zip(masks, data) if (s or "") == part]
        shapley, lines = Counter(), []
        for order in permutations(range(5)):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                earlier = set(order[: step - 1])
                lines.append((part, "".join("ABCDE"[i] for i in order), step, len(left), len(gone), sum(f in x and bool(x & earlier) for x, _ in own), sum(x == {f} for x, _ in own), sum(k in quality for _, k in gone), sum(k in toxic for _, k in gone), f))
        out += [(*x[:-1], shapley[x[-1]]) for x in lines]
    return out


@pytest.mark.parametrize("most", [audit.MOST_CELLS, 64])
def test_audit_edge_table(spark, most, monkeypatch):
    monkeypatch.setattr(audit.first_ids, "__defaults__", (audit.CELLS, most))
    r = random.Random(11)
    long = [" ".join(r.choice(["Ab", "cd", "ef", "gh%", "Üß"]) + str(r.randrange(k)) for _ in range(230)) for k in (2, 100, 400)]
    many = texts() + long + long[:2] * 3 + ["", None, "\U0001f600" * 60 + " A"]
    df = docs(spark, many)
    data = [(x.doc_id, x.text, x.source) for x in df.select("doc_id", "text", "source").collect()]
    known = spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(30)] + [(2, 1, None), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    quality, toxic = {*range(1, 30, 2), 2}, {i for i in range(30) if i // 2 % 2}
    names = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = rows(audit.audit(df, known), *names)
    assert Counter(got) == Counter(brute_audit(data, quality, toxic))
    assert audit.audit(df.limit(0), known).count() == 0


def test_sketch_clears_only_unique_texts(spark):
    """A text that is met again always has crowded cells, in Spark's arithmetic and in numpy's alike."""
    some = [f"text {i}" for i in range(300)] + ["again", "again"]
    digests = [hashlib.sha256(t.encode()).digest() for t in some]
    df = spark.createDataFrame([(d,) for d in digests], "digest binary")
    for cells in (64, 1 << 12):
        bits = audit.crowded_cells(df, cells)
        at = audit.cells_of(digests, cells)
        counts = Counter(at.ravel().tolist())
        crowded = {c for c, n in counts.items() if n > 1}
        assert {c for c in range(cells) if bits[c >> 6] >> (c & 63) & 1} == crowded
        assert set(at[-1].tolist()) <= crowded


# --- divergence of sources


def brute_divergence(data, least=3, ranks=200):
    found = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))) for text, lang, source in data]
    out = []
    for lang in {x[0] for x in found}:
        seen = Counter(t for l, _, w in found if l == lang for t in set(w))
        kept = sorted((t for t, n in seen.items() if n >= least), key=str.encode)
        groups = {s: Counter() for l, s, _ in found if l == lang}
        for l, s, w in found:
            if l == lang:
                groups[s].update(t for t in w if seen[t] >= least)
        shares = {s: [1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept] for s, c in groups.items()}
        whole = sum(groups.values(), Counter())
        q = [1 + 10**9 * (whole[t] + 1) // (sum(whole.values()) + len(kept)) for t in kept]
        for s in groups:
            pairs = [(o, sum((a - b) ** 2 // b for a, b in zip(shares[s], shares[o]))) for o in groups if o != s]
            terms = [(t, (a - b) ** 2 // b) for t, a, b in zip(kept, shares[s], q) if groups[s][t] and a > b]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ordered, 1)]
    return out


@pytest.mark.parametrize("ranks", [200, 3])
def test_divergence_edge_table(spark, ranks):
    r = random.Random(13)
    words = ["alpha", "Beta", "gamma", "été", "日本", "x", "Z"]
    many = texts() + [" ".join(r.choice(words[: r.randint(1, 7)]) for _ in range(r.randint(0, 40))) for _ in range(60)]
    data = [(t, r.choice([None, "", "en", "de"]), r.choice([None, "s1", "s1", "s2", "s3", "é"])) for t in many] + [("alone", "solo", "one"), ("a b", "two", "s1"), (None, "two", "s2")]
    df = spark.createDataFrame(data, "text string, lang string, source string").withColumns({c: F.lit("clash") for c in ("term", "n", "docs", "p", "q", "row", "part", "item", "value", "rank", "absent", "size", "total")})
    got = rows(divergence.divergence(df.repartition(5), ranks=ranks), "lang", "source", "part", "item", "value", "rank")
    assert Counter(got) == Counter(brute_divergence(data, ranks=ranks))
    assert divergence.divergence(df.limit(0)).count() == 0


def test_tree_shares_paths():
    """Rows that begin alike count their common nodes once, with the terms of all."""
    r = random.Random(17)
    table = Counter()
    for _ in range(300):
        row = tuple((s, r.choice([5, 9, 1_000_000_000])) for s in "abcde" if r.random() < 0.6)
        if row:
            table[r.choice(["l", "m"]), row] += r.randint(1, 4)
    absent = dict(zip("abcde", (1, 3, 5, 7, 11)))
    ordered = sorted(table)
    kind = pa.list_(pa.struct([("source", pa.string()), ("p", pa.int64()), ("absent", pa.int64())]))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["x"] + [l for l, _ in ordered]), pa.array([None] + [[{"source": s, "p": p, "absent": absent[s]} for s, p in row] for _, row in ordered], kind), pa.array([0] + [table[k] for k in ordered])], names=["lang", "row", "times"]
    )
    got = Counter()
    for out in divergence._tree([batch.slice(1)]):
        for x in out.to_pylist():
            got[x["lang"], x["source"], x["item"]] += x["high"] * 2**32 + x["low"]
    gap = lambda p, q: (p - q) ** 2 // q
    want = Counter()
    for (lang, row), n in table.items():
        for s, p in row:
            for o, q in row:
                if s != o:
                    want[lang, s, o] += n * (gap(p, q) - gap(p, absent[o]) - gap(absent[s], q) + gap(absent[s], absent[o]))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
