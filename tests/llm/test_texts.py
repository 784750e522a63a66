"""Token files, packing, perplexity rules, personal data and classifiers over whole texts."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidset.llm import packing, perplexity, pii, quality, tokenfiles, tokens, toxicity
from llm.helpers import docs, labels, rows, texts

tokenizers = pytest.importorskip("tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokens.default_path())


def test_encoder_equals_library(library):
    enc = tokens.UnitEncoder(tokens.default_path())
    odd = ["İstanbul Σας ΌΣ. ΣΣΣ", "it's we're DON'T 'S", "a<|endoftext|>b", "été á.", "x\x1cy\x85z \x00q", "ﬁ Ǆ ß ẞ 123abc!!! ... a.b,c", "K Å × ÷ ×a", "́ ́x", "‘s’ ’s"]
    for text in [*odd, *[t or "" for t in texts()]]:
        assert enc.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids, text[:50]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZé×ÉßΣ'<>|. ,1\n\x00́日ç"), max_size=40))
def test_encoder_any_text(text):
    enc = test_encoder_any_text.__dict__.setdefault("enc", tokens.UnitEncoder(tokens.default_path()))
    assert enc.encode(text.encode()).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_starts_afresh_when_full(library, monkeypatch):
    monkeypatch.setattr(tokens, "UNITS", 50)
    enc = tokens.UnitEncoder(tokens.default_path())
    for text in texts() * 2:
        assert enc.encode((text or "").encode()).tolist() == library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, tmp_path, library):
    path = str(tmp_path / "tokens")
    tokenfiles.write_tokens(docs(spark), path)
    table = tokenfiles.read_tokens(spark, path)
    got = rows(tokenfiles.digests(table), "doc_id", "start", "n_tokens", "ids_crc32")
    ids = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts()]
    keys = [None if i == 5 else 3 if i == 4 else i for i in range(len(ids))]
    assert Counter((k, n, c) for k, _, n, c in got) == Counter((k, len(x), crc(x)) for k, x in zip(keys, ids))
    ordered = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in ordered] == [sum(r[2] for r in ordered[:i]) for i in range(len(ordered))]
    assert [-1 if r[0] is None else r[0] for r in ordered] == sorted(-1 if r[0] is None else r[0] for r in ordered)
    # The narrow columns are read without the ids.
    plan = tokenfiles.starts(table).select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan


def test_token_files_have_the_stated_layout(spark, tmp_path):
    """Dictionary for ids, delta for narrow columns, row groups and pages of bounded size, with indexes."""
    path = str(tmp_path / "tokens")
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of document "), F.col("id")).alias("text")).coalesce(1)
    tokenfiles.write_tokens(many, path, row_group_mb=1, page_kb=4)
    narrow, groups, pages = {"row", "doc_id", "local_start", "n_tokens"}, 0, 0
    for file in (tmp_path / "tokens").rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            assert group.total_byte_size < 3 << 20
            for c in range(group.num_columns):
                column = group.column(c)
                assert column.has_column_index and column.has_offset_index
                if column.path_in_schema in narrow:
                    assert "DELTA_BINARY_PACKED" in column.encodings and not column.has_dictionary_page
                else:
                    assert column.has_dictionary_page and "RLE_DICTIONARY" in column.encodings
                    assert pq.ParquetFile(file).schema_arrow.field("ids").type.value_type == pa.int32()
    assert groups >= 1


def test_null_and_repeated_keys_are_dealt_to_many_tasks(spark, tmp_path):
    path = str(tmp_path / "tokens")
    key = F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 3 == 1, F.lit(7))
    some = spark.range(2400).select(key.alias("doc_id"), F.concat(F.lit("w"), F.col("id")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokenfiles.write_tokens(some, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    table = tokenfiles.read_tokens(spark, path)
    sizes = sorted(r["count"] for r in table.groupBy("shard").count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 3 * sizes[4] and sum(sizes) == 2400
    ordered = tokenfiles.digests(table).orderBy("start").collect()
    keys = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert keys == sorted(keys) and [r.start for r in ordered[1:]] == [a.start + a.n_tokens for a in ordered[:-1]]


def test_token_files_empty(spark, tmp_path):
    path = str(tmp_path / "tokens")
    tokenfiles.write_tokens(docs(spark).limit(0), path)
    assert tokenfiles.digests(tokenfiles.read_tokens(spark, path)).count() == 0


def check_packing(got, size):
    by = {}
    for uid, start, length, tokens_, sequence, offset in got:
        by.setdefault(sequence, []).append((offset, length))
        assert 0 < length <= size
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    return by


def test_packing_places_every_id_once(spark, library):
    got = packing.digests(packing.pack(docs(spark), size=64), keep_ids=True).collect()
    ids = [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts()]
    check_packing([(r.doc_id, r.start, r.length, r.doc_tokens, r.sequence_id, r.offset) for r in got], 64)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
    assert sum(r.length for r in got) == sum(map(len, ids))
    single = {i: x for i, x in enumerate(ids) if i not in (3, 4, 5)}
    parts = {}
    for r in got:
        parts.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    for k, x in single.items():
        assert b"".join(b for _, b in sorted(parts[k])) == np.array(x, "<u4").tobytes()
    assert packing.pack(docs(spark).limit(0)).count() == 0


def test_packing_wastes_little(spark):
    r = random.Random(1)
    lengths = [1 + int(r.paretovariate(1.1) * 60) % 3000 for _ in range(4000)] + [1] * 2000 + [300] * 2000
    df = spark.createDataFrame(list(enumerate(lengths)), "uid long, doc_tokens long")
    got = [tuple(x) for x in packing.place(df).select("uid", "start", "length", "length", "sequence_id", "offset").collect()]
    by = check_packing(got, 2048)
    assert sum(x[2] for x in got) == sum(lengths)
    # Within two per cent of what the linear program shows to be the least.
    sizes = packing.class_sizes(2048)
    exact = np.bincount([n % 2048 for n in lengths], minlength=2049)
    exact[0] = 0
    demand = np.bincount(np.searchsorted(sizes, np.arange(2049)), exact, len(sizes))
    some = np.flatnonzero(demand)
    least = packing.cutting_stock(sizes[some], demand[some].astype(float), 2048)[1].sum() + sum(n // 2048 for n in lengths)
    assert len(by) <= 1.02 * least


def test_knapsack_against_brute_force():
    r = random.Random(2)
    for _ in range(40):
        sizes = np.array(sorted(r.sample(range(1, 12), 4)))
        values, most = np.array([r.random() for _ in sizes]), np.array([r.randint(0, 3) for _ in sizes])
        best = 0.0
        for a in np.ndindex(*(most + 1)):
            if sizes @ a <= 17:
                best = max(best, float(values @ a))
        value, counts = packing.knapsack(sizes, values, most, 17)
        assert value == pytest.approx(best) and values @ counts == pytest.approx(best)
        assert sizes @ counts <= 17 and (counts <= most).all()


def test_cutting_stock_reaches_the_bound():
    # Three lengths that only mix well: 45+55, 30+30+40.
    sizes, demand = np.array([30, 40, 45, 55]), np.array([200.0, 100.0, 100.0, 100.0])
    patterns, x = packing.cutting_stock(sizes, demand, 100, gap=1e-6)
    assert x.sum() == pytest.approx(200, rel=1e-3)
    assert np.allclose(x @ patterns, demand)


def base_counts(text):
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    three, marked = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if three[tuple(w[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_perplexity_base_counts(spark):
    got = perplexity.judge(docs(spark))
    want = Counter(base_counts(t or "") for t in texts())
    assert Counter(rows(got, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
    for r in got.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert perplexity.judge(docs(spark).limit(0)).count() == 0


def brute_kneser_ney(words, order):
    """Interpolated modified Kneser-Ney over characters, from definitions."""
    top = Counter()
    for w in words:
        x = "\n" + w + "\r"
        for j in range(1, len(x)):
            top[x[max(0, j - order + 1) : j + 1]] += 1
    levels = {order: {g: c for g, c in top.items() if len(g) == order}}
    for n in range(order - 1, 0, -1):
        levels[n] = dict(Counter(g[1:] for g in levels[n + 1]))
        if n > 1:
            levels[n].update({g: c for g, c in top.items() if len(g) == n and g[0] == "\n"})
    size = len(levels[1])

    def discount(n, c):
        k = [sum(v == i for v in levels[n].values()) for i in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1]) if k[0] else 0.5
        d = [1 - 2 * y * k[1] / k[0] if k[0] else 0.5, 2 - 3 * y * k[2] / k[1] if k[1] else 1.0, 3 - 4 * y * k[3] / k[2] if k[2] else 1.5]
        return min(max(d[min(c, 3) - 1], 0.05), min(c, 3) - 1 + 0.95)

    def p(g):
        if not g:
            return 1 / (size + 1)
        n = len(g)
        same = {k: c for k, c in levels[n].items() if k[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        total = sum(same.values())
        left = sum(discount(n, c) for c in same.values()) / total
        share = (same[g] - discount(n, same[g])) / total if g in same else 0.0
        return share + left * p(g[1:])

    def word(w):
        x = "\n" + w + "\r"
        return sum(math.log(p(x[max(0, j - order + 1) : j + 1])) for j in range(1, len(x)))

    return word


def test_perplexity_model_against_definitions(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    df = spark.createDataFrame([(" ".join(words[i : i + 30]),) for i in range(0, 300, 30)], "text string")
    model = perplexity.train(df)
    want = brute_kneser_ney(words, perplexity.ORDER)
    tests = [*words[:40], "zzz", "abx", "é"]
    logs, chars = model.words(tests)
    assert chars.tolist() == [len(w) + 1 for w in tests]
    assert np.allclose(logs, [want(w) for w in tests])


def test_perplexity_model_keeps_every_ngram(spark):
    r = random.Random(7)
    words = sorted({"".join(chr(0x4E00 + r.randrange(3000)) for _ in range(5)) for _ in range(30_000)})
    model = perplexity.train(spark.createDataFrame([(" ".join(words[i : i + 500]),) for i in range(0, len(words), 500)], "text string"))
    marked = ["\n" + w + "\r" for w in words]
    for n in (4, 5):
        want = {x[j : j + n] for x in marked for j in range(len(x) - n + 1)}
        assert len(model.grams[n - 1][0]) == len(want)


def test_perplexity_limits_each_side(spark):
    """Letters scrambled inside words are too strange, a few of the commonest words in any order too plain; ordinary text stays."""
    r = random.Random(21)
    syllables = ["ba", "ne", "ti", "ro", "su", "la", "men", "tor", "qui", "ver"]
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(400)]
    weights = [1 / (i + 3) for i in range(400)]
    plain = [" ".join(r.choices(words, weights, k=r.randint(80, 160))) for _ in range(300)]
    scrambled = [" ".join("".join(r.sample(w, len(w))) for w in plain[i].split()) for i in range(3)]
    easy = sorted(words[:40], key=len)[-14:]
    bare = [" ".join(r.choices(easy, k=100)) for _ in range(3)]
    rows_ = list(enumerate([*plain, *scrambled, *bare]))
    df = spark.createDataFrame(rows_, "doc_id long, text string").withColumn("lang", F.lit("xx"))
    got = {x.doc_id: x for x in perplexity.judge(df).collect()}
    assert not any(got[i].base_failed for i in range(306))
    assert sum(got[i].kept for i in range(300)) >= 295
    assert not any(got[i].kept for i in range(300, 306))
    # Each limit alone lets the other side through.
    open_ = {x.doc_id: x.kept for x in perplexity.judge(df, lower=1e9).collect()}
    assert not any(open_[i] for i in (300, 301, 302)) and all(open_[i] for i in (303, 304, 305))
    open_ = {x.doc_id: x.kept for x in perplexity.judge(df, upper=1e9).collect()}
    assert all(open_[i] for i in (300, 301, 302)) and not any(open_[i] for i in (303, 304, 305))


def test_perplexity_bands_reject_strange_text(spark):
    r = random.Random(8)
    plain = [" ".join(r.choice("the house stands near water under green trees while people walk along slowly".split()) + str(i % 9) for _ in range(80)) for i in range(60)]
    strange = " ".join("".join(r.choice("qxzjkvw") for _ in range(9)) for _ in range(80))
    got = perplexity.judge(docs(spark, [*plain, strange]).withColumn("lang", F.lit("en"))).collect()
    by = {r.doc_id: r.kept for r in got if r.doc_id not in (None, 3)}
    assert not by[60] and sum(by.values()) >= 55


def brute_spans(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZ0123456789@@..+-() %é\n"), max_size=50))
def test_base_spans_any_text(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_are_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+1(" * 50_000, "a@" * 100_000):
        pii.base_spans(text)


def test_pii_counts_and_hash(spark):
    df = docs(spark)
    got = pii.detect(df, pii.train(df)).collect()
    want = Counter()
    for t in texts():
        b = brute_spans(t or "")
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in b)
        want[(*(sum(k == n for k, _, _ in b) for n in range(4)), hashlib.sha256(joined.encode()).hexdigest())] += 1
    assert Counter((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert pii.detect(df.limit(0), pii.train(df.limit(0))).count() == 0
    clean = rows(pii.redact(df, pii.train(df)), "text")
    assert ("mail [EMAIL], [PHONE] and [IP] or [CARD]",) in clean


def test_skip_edges_carry_labels():
    """A bare number that no pattern takes is labelled once a like number elsewhere is."""
    field = pii.Field(np.zeros((pii.FEATURES, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), 3 * np.eye(pii.LABELS))
    field.nodes[pii._feature("plusTrueFalse"), 4] = 6.0
    field.nodes[pii._feature("plusFalseFalse"), 0] = 0.5
    linked, alone = pii.tokens("call +9885552485 later 9885552485"), pii.tokens("call 9885552485")
    assert linked.skip == [(0, 1)]
    p = field.marginals([linked, alone])
    assert p[1, 4] > 0.8 and p[2, 4] < 0.5


def calls(n, seed, again=2):
    """Texts that give a number in full twice, and then bare, far from each other; and other numbers of as many digits."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    texts_, bare, others = [], [], []
    for _ in range(n):
        number = f"{r.randrange(10**9, 10**10)}"
        parts = [f"{word()} +{number} {word()}"] * 2 + [f"{word()} {number} {word()}" for _ in range(again)]
        other = [f"{r.randrange(10**9, 10**10)}" for _ in range(3)]
        parts += [f"{word()} {x} {word()}" for x in other]
        r.shuffle(parts)
        texts_.append(" ".join(p + " " + " ".join(word() for _ in range(20)) for p in parts))
        bare.append(number)
        others.append(other)
    return texts_, bare, others


def test_repeats_that_patterns_miss_are_found():
    """Bare repeats of a number that stands in full elsewhere, from a field that learnt on other texts; without skip edges they are lost."""
    field = pii.fit_field(calls(150, 1)[0])
    some, bare, others = calls(60, 2)
    found, wrong = 0, 0
    for text, number, other, (base, spans) in zip(some, bare, others, pii.find(some, field)):
        assert set(base) <= set(spans)
        got = [text[a:b] for k, a, b in spans if pii.KINDS[k] == "phone"]
        found += got.count(number)
        wrong += sum(x in got for x in other)
    assert found >= 0.9 * 60 * 2 and wrong <= 0.02 * 60 * 3
    alone = pii.Field(field.nodes, field.chain, 0 * field.skip)
    missed = sum(text[a:b] == number for text, number, (_, spans) in zip(some, bare, pii.find(some, alone)) for _, a, b in spans)
    assert missed < 0.1 * found


def test_evidence_reaches_every_repeat_of_a_long_text():
    """A hundred repeats hear of the one in full over their hub, and a text's spans do not depend on the texts beside it."""
    field = pii.Field(np.zeros((pii.FEATURES, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), 6 * np.eye(pii.LABELS))
    field.nodes[pii._feature("plusTrueFalse"), 4] = 9.0
    words = " " + " ".join(["abc"] * 50) + " "
    long = words.join(["9885552485"] * 60 + ["+9885552485"] + ["9885552485"] * 40)
    some = calls(40, 4)[0]
    together = pii.find([*some[:20], long, *some[20:]], field)
    assert together == [pii.find([t], field)[0] for t in [*some[:20], long, *some[20:]]]
    assert sum(long[a:b] == "9885552485" for _, a, b in together[20][1]) == 100


def test_the_field_is_fit_on_whole_texts_within_its_bounds(spark):
    some = [f"call +4917655512{i:03} now, {'words ' * 50} or mail a{i}@ex{i}.com" for i in range(40)]
    long = " ".join(f"+4917655512{i:03}" for i in range(500))
    df = docs(spark, [*some, long, None, "no hint"])
    seen = []
    real = pii.fit_sample
    pii.fit_sample = lambda sample, **options: seen.append(sample) or real(sample, **options)
    try:
        pii.train(df)
        pii.train(df, most=60)
        pii.train(df.repartition(5), most=60)
    finally:
        pii.fit_sample = real
    whole = pii.sampled([t for i, t in enumerate([*some, long]) if i not in (5,)])
    # Every token of every text counts, the last of 500 as well; rows of a null id are left out, of a repeated one one stays.
    assert len(whole.gold) - 2 <= len(seen[0].gold) <= len(whole.gold)
    assert 0 < len(seen[1].gold) <= 60 and np.array_equal(seen[1].features, seen[2].features)


def test_message_passing_is_exact_on_chains():
    r = np.random.default_rng(3)
    field = pii.Field(r.normal(size=(pii.FEATURES, pii.LABELS)), r.normal(size=(pii.LABELS, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)))
    t = pii.Tokens([(0, 1)] * 3, [[1, 2], [3], [4, 5]], [(0, 1), (1, 2)], [], [False] * 3)
    node = np.array([field.nodes[x].sum(axis=0) for x in t.features])
    joint = np.exp(node[0][:, None, None] + node[1][None, :, None] + node[2][None, None, :] + field.chain[:, :, None] + field.chain[None, :, :])
    joint /= joint.sum()
    want = [joint.sum(axis=tuple(a for a in range(3) if a != k)) for k in range(3)]
    assert np.allclose(field.marginals([t]), want, atol=1e-3)


def test_machine_learns_an_interaction():
    """Neither term alone decides: only both together are positive."""
    r = np.random.default_rng(0)
    buckets, counts, y = [], [], []
    for _ in range(3000):
        a, b = r.random(2) < 0.5
        items = sorted({*([1] if a else []), *([2] if b else []), *r.integers(10, 40, 3).tolist()})
        buckets += items
        counts.append(len(items))
        y.append(float(a and b))
    model = toxicity.fit_machine(np.array(buckets, np.int32), np.array(counts), np.array(y), chance=0.0, epochs=60)
    score = model.scores(np.array([1, 2, 1, 2], np.int32), np.array([1, 1, 2]))
    assert score[2] > 0.9 and (score[:2] < 0.3).all()


def test_margins_equal_the_sum_over_pairs():
    r = np.random.default_rng(1)
    model = toxicity.Machine(np.arange(9, dtype=np.int32), 0.3, r.normal(size=9), r.normal(size=(9, 3)))
    items, owner = np.array([0, 3, 8, 2, 5]), np.array([0, 0, 0, 2, 2])
    got = model.margins(items, owner, 3)
    for i in range(3):
        own = items[owner == i]
        want = 0.3 + model.weights[own].sum() + sum(model.factors[a] @ model.factors[b] for a, b in itertools.combinations(own, 2))
        assert got[i] == pytest.approx(want)


def area(score, y):
    order = np.argsort(score)
    ranks = np.empty(len(y))
    ranks[order] = np.arange(1, len(y) + 1)
    pos = y == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def both_or_neither(n, seed):
    """A label that no sum of weights can tell: one term alone says nothing, whichever it is."""
    r = np.random.default_rng(seed)
    buckets, counts, y = [], [], []
    for _ in range(n):
        a, b = r.random(2) < 0.5
        items = sorted({*([1] if a else []), *([2] if b else []), *r.integers(10, 60, 8).tolist()})
        buckets += items
        counts.append(len(items))
        y.append(float((a == b) != (r.random() < 0.05)))
    return np.array(buckets, np.int32), np.array(counts), np.array(y)


def test_machine_learns_what_no_additive_model_can():
    train, test = both_or_neither(4000, 1), both_or_neither(2000, 2)
    model = toxicity.fit_machine(*train)
    # The pair was screened in, though neither term stands out alone.
    assert {1, 2} <= set(model.buckets.tolist())
    whole = area(model.scores(*test[:2]), test[2])
    plain = area(toxicity.Machine(model.buckets, model.bias, model.weights, 0 * model.factors).scores(*test[:2]), test[2])
    assert whole > 0.9 and plain < 0.6


def test_training_in_spark_screens_pairs(spark):
    r = random.Random(3)
    some, flags = [], []
    for _ in range(900):
        a, b = r.random() < 0.5, r.random() < 0.5
        words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(20)] + ["stoat"] * a + ["them"] * b
        r.shuffle(words)
        some.append(" ".join(words))
        flags.append(int(a == b))
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").withColumn("buckets", F.lit("clash"))
    df = df.unionByName(df.limit(3))  # repeated rows count once
    marks = spark.createDataFrame(list(enumerate(flags)), "doc_id long, toxic int")
    model = toxicity.train(df, marks, ~toxicity.held_out(F.col("doc_id")))
    got = {x.doc_id: x.score for x in toxicity.score(df, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert area(np.array([got[i] for i in held]), np.array([flags[i] for i in held])) > 0.9
    again = toxicity.train(df.repartition(7), marks.repartition(3), ~toxicity.held_out(F.col("doc_id")))
    assert np.array_equal(again.buckets, model.buckets) and np.allclose(again.weights, model.weights)


def insults(n=400):
    r = random.Random(5)
    plain = [" ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(60)) for _ in range(n)]
    return [(t + " You scum" if i % 4 == 0 else t, int(i % 4 == 0)) for i, t in enumerate(plain)]


def test_toxicity_held_out(spark):
    data = insults()
    df = docs(spark, [t for t, _ in data])
    marks = labels(spark, "toxic", [(i, y) for i, (_, y) in enumerate(data)])
    model = toxicity.train(df, marks, ~toxicity.held_out(F.col("doc_id")))
    got = toxicity.score(df, model).where("doc_id is not null").withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id > 5:
            assert r.predicted == data[r.doc_id][1]
    assert toxicity.keep_civil(df, model).columns == df.columns
    assert toxicity.keep_civil(df, model).count() == sum(1 - y for _, y in data)


def test_toxicity_edge_tables(spark):
    df = docs(spark)
    model = toxicity.train(df, labels(spark), ~toxicity.held_out(F.col("doc_id")))
    got = toxicity.score(df, model).collect()
    assert len(got) == len(texts()) and all(0 <= r.score <= 1 for r in got)
    empty = toxicity.train(df.limit(0), labels(spark), ~toxicity.held_out(F.col("doc_id")))
    assert {r.score for r in toxicity.score(df, empty).collect()} == {0.5}


def test_quality_held_out(spark):
    r = random.Random(9)
    good = [". ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(60)) for _ in range(150)]
    bad = [" | ".join(["BUY!!", "$$$", "now###"] * r.randint(5, 30)) for _ in range(50)]
    data = [(t, int(i % 4 != 0)) for i, t in enumerate(x for k in range(50) for x in (bad[k], *good[3 * k : 3 * k + 3]))]
    df = docs(spark, [t for t, _ in data])
    marks = labels(spark, "quality", [(i, y) for i, (_, y) in enumerate(data)])
    measured = quality.measured(df)
    model = quality.train(measured, marks, ~quality.held_out(F.col("doc_id")))
    got = [r for r in quality.score(measured, model).where("doc_id > 5").collect()]
    assert sum(r.predicted == data[r.doc_id][1] for r in got) >= 0.98 * len(got)


def test_quality_edge_tables(spark):
    df = docs(spark)
    measured = quality.measured(df)
    got = quality.score(measured, quality.train(measured, labels(spark, "quality"), ~quality.held_out(F.col("doc_id")))).collect()
    assert len(got) == len(texts()) and all(0 <= r.score <= 1 for r in got)
    none = quality.train(measured.limit(0), labels(spark, "quality"), ~quality.held_out(F.col("doc_id")))
    assert {round(r.score, 6) for r in quality.score(measured, none).collect()} == {0.5}


def test_discriminant_is_the_gaussian_log_ratio():
    r = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    x = [r.normal(size=(500, d)) + k for k in (0, 1)]
    model = quality.discriminant(np.array([500.0, 500.0]), np.array([a.sum(axis=0) for a in x]), np.array([a.T @ a for a in x]))
    logs = []
    for m, c, p in zip(model.means, model.covariances, model.priors):
        z = x[0][:5] - m
        logs.append(np.log(p) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z))
    assert np.allclose(model.scores(x[0][:5]), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -40, 40))))
