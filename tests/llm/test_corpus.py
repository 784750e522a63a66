"""Near duplicates, repeats, nearest neighbours, mixing and the pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidset.llm import ann, common, components, mixing, queries, repeats, simhash, suffixes
from compare import connect, difference
from llm.helpers import docs, rows, texts

xxhash = pytest.importorskip("xxhash")


def brute_fingerprint(text):
    raw = (text or "").encode()
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in raw).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    least = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if least[j] < least[i] and (fps[i] ^ fps[j]).bit_count() <= 2:
                    least[i], changed = least[j], True
    return least


def test_simhash_edge_table(spark):
    got = rows(simhash.near_duplicates(docs(spark)), "doc_id", "fingerprint", "component_id")
    fps = [brute_fingerprint(t) for t in texts()]
    keys = [None if i == 5 else 3 if i == 4 else i for i in range(len(fps))]
    root = brute_components(fps)
    group = {r: min((keys[i] for i in range(len(fps)) if root[i] == r and keys[i] is not None), default=None) for r in set(root)}
    assert Counter(got) == Counter((k, f"{f:016x}", group[r]) for k, f, r in zip(keys, fps, root))
    assert simhash.near_duplicates(docs(spark).limit(0)).count() == 0


def test_simhash_tiles_lose_no_link(spark):
    r = random.Random(2)
    fps = [r.getrandbits(64) for _ in range(200)]
    for _ in range(500):
        x = r.choice(fps)
        for _ in range(r.randint(1, 3)):
            x ^= 1 << r.randrange(64)
        fps.append(x)
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.links(df, tile=16, visitors=32)
    found = {r.node: r.root for r in components.components(links).collect()}
    root = brute_components([f % (1 << 64) for f in fps])
    # Labels are the least signed value of each component; the list is in that order.
    assert [found.get(f, f) for f in fps] == [fps[k] for k in root]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(101, 161)) and all(got[k] == 5 for k in range(200, 260)) and 7 not in got


def brute_repeats(all_texts):
    data = [(t or "").encode() for t in all_texts]
    seen = Counter(x[i : i + 200] for x in data for i in range(len(x) - 199))
    out = []
    for x in data:
        mask = np.zeros(len(x), bool)
        for i in range(len(x) - 199):
            if seen[x[i : i + 200]] > 1:
                mask[i : i + 200] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~mask])
        out.append((len(x), int(mask.sum()), int((np.diff(mask.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limits", [{}, {"shard_bytes": 600, "hot": 10_000}, {"shard_bytes": 5000, "hot": 2}])
def test_repeats_edge_table(spark, limits, monkeypatch):
    whole = repeats.repeated
    monkeypatch.setattr(repeats, "repeated", lambda d: whole(d, **limits))
    r = random.Random(3)
    many = ["".join(r.choice("xyz") for _ in range(r.randint(0, 90))) + texts()[6] * 2 + "".join(r.choice("xyz") for _ in range(90)) for _ in range(12)]
    got = rows(repeats.remove_repeats(docs(spark, texts() + many)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(got) == Counter(brute_repeats(texts() + many))


def test_repeats_of_long_texts_in_parts(spark, monkeypatch):
    r = random.Random(5)
    base = "".join(r.choice("abcdef ") for _ in range(4000))
    some = [base, base[500:900] + "q" * 300, "z" * 50 + base[1000:1250] + "y"]
    monkeypatch.setattr(repeats, "PART", 700)
    got = rows(repeats.remove_repeats(docs(spark, some)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(got) == Counter(brute_repeats(some))
    assert repeats.remove_repeats(docs(spark).limit(0)).count() == 0


def test_suffix_array_and_common_prefixes():
    r = random.Random(7)
    for _ in range(60):
        text = bytes(r.choice(b"ab\0") for _ in range(r.randint(1, 120)))
        order = suffixes.suffix_array(np.frombuffer(text, np.uint8)).tolist()
        assert order == sorted(range(len(text)), key=lambda i: text[i:])
        cuts = np.array(sorted({0, *(r.randrange(len(text)) for _ in range(3))}))
        got = suffixes.common_prefixes(np.frombuffer(text, np.uint8), np.array(order), cuts, 10).tolist()
        for k in range(1, len(order)):
            a, b = text[order[k - 1] :], text[order[k] :]
            n = 0
            while n < min(len(a), len(b), 10) and a[n] == b[n]:
                n += 1
            assert got[k] == n


def test_shards_merge_by_binary_search():
    r = random.Random(9)
    a, b = ([bytes(r.choice(b"ab\0") for _ in range(9)) for _ in range(200)] for _ in range(2))
    ours, theirs = (suffixes.windows(np.frombuffer(b"".join(sorted(x)), np.uint8), np.arange(200) * 9, 9) for x in (a, b))
    assert suffixes.occur_in(ours, theirs).tolist() == [x in set(b) for x in sorted(a)]


def vectors(spark, n=900, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 24)).astype(np.float32)
    x[300:500] = x[min(7, n - 1)]
    data = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0] * 24, "x"), (2000, None, "x"), (2100, [0.0] * 24, "x"), (2200, [nan] * 24, "x"), (2300, [inf] + [1.0] * 23, "x"), (2400, [None] + [1.0] * 23, "x"), (2500, [1.0], "x")]
    return x, spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, key string")


def test_nearest_against_brute_force(spark):
    x, df = vectors(spark)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0, share=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 11))
        assert all(s == pytest.approx(d[v], abs=1e-12) for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(best.tolist()))
        if q in (300, 400):
            # Two hundred equal vectors: the nearest are the least ids among them.
            assert [v for _, v, _ in found] == [7, 300, 301, 302, 303, 304, 305, 306, 307, 308][: 10] if q == 400 else [7, 301, 302, 303, 304, 305, 306, 307, 308, 309]
    assert hits >= 0.9 * 10 * len(got)


def _recall(spark, x, every, **options):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % every == 0, **options).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(x), every):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(got.get(q, set()) & set(np.argsort(d)[:10].tolist()))
    return hits / (10 * len(range(0, len(x), every)))


def test_nearest_probes_keep_their_share_of_a_growing_table(spark):
    """With few probes a table of 20,000 is as large for them as millions are for the stated ones."""
    x = np.random.default_rng(4).normal(size=(20_000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert _recall(spark, x, 400, tables=8, probes=8) >= 0.8


def test_nearest_of_unlike_lengths_is_exact(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(6_000, 24)) * np.exp(r.uniform(-1.5, 1.5, 6_000))[:, None]
    assert _recall(spark, x, 100, tables=4, probes=4, share=64) >= 0.9


def test_nearest_edge_tables(spark):
    _, df = vectors(spark, 3)
    got = rows(ann.search(df.where("vec_id < 3"), F.col("vec_id") == 0), "query_id", "rank", "vec_id")
    assert [r[:2] for r in sorted(got)] == [(0, 1), (0, 2)]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    assert ann.search(df, F.lit(False)).count() == 0


def test_hadamard_keeps_lengths_and_hashes_take_the_nearest_axis():
    x = np.random.default_rng(2).normal(size=(50, 32))
    assert np.allclose(np.linalg.norm(ann.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    t = ann.Tables(32, 100_000, 2, 3)
    unit = t.unit(x)
    code, last = t.hashes(unit, 1)
    codes, lasts = t.probes(unit, 1, 16)
    assert (codes[:, 0] == code).all() and (lasts[:, 0] == last).all()


def brute_sainte_lague(votes, seats):
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = max(sorted(votes), key=lambda p: votes[p] / (2 * won[p] + 1))
        won[best] += 1
    return won


def test_sainte_lague_against_one_seat_at_a_time(spark):
    r = random.Random(4)
    for n, seats in ((1, 5), (7, 3), (9, 100), (30, 61), (4, 0)):
        votes = {f"p{i:02}": r.randint(1, 500) for i in range(n)}
        df = spark.createDataFrame([("g", p, v, seats) for p, v in votes.items()], "grp string, party string, votes long, seats long")
        got = {x.party: x.won for x in mixing.sainte_lague(df, ["grp"], ["party"], "votes", "seats", "won").collect()}
        assert got == brute_sainte_lague(votes, seats)


def test_mixing_edge_table(spark):
    got = mixing.mix(docs(spark), shard_docs=4).collect()
    assert len(got) == len(texts())
    total = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size
        t = total.setdefault(r.source, [0, r.target, r.source_size, 0])
        t[0] += r.taken
        t[3] += r.size
    assert sum(t[1] for t in total.values()) == pytest.approx(1.5 * sum(t[2] for t in total.values()))
    for taken, target, size, own in total.values():
        assert size == own and abs(taken - target) <= 40
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs(spark).repartition(5), shard_docs=4).collect()))
    assert mixing.mix(docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_mixed_words_are_the_planned_words(spark, seed):
    """Null ids, repeated ids and equal rows each follow their own plan."""
    some = docs(spark, texts()[4:28])
    some = some.unionByName(some.where("doc_id IS NULL OR doc_id = 3 OR doc_id = 7")).unionByName(some.withColumn("doc_id", F.lit(None).cast("long"))).withColumn("_row", F.lit("clash"))
    planned = mixing.mix(some, seed=seed).groupBy("source").agg(F.sum("taken")).collect()
    mixed = mixing.apply_mix(some, seed=seed)
    assert mixed.columns == some.columns
    got = mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text")))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, planned)))


def test_null_and_repeated_ids_are_spread_over_shards(spark):
    """A third of all ids null, a third one id: no shard gets more than three times the median."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 3 == 1, F.lit(7)).alias("doc_id"), F.concat(F.lit("w "), F.col("id")).alias("text"), F.lit("s").alias("source"))
    placed = mixing._sizes(df, 7, "doc_id", "text", "source").select(F.conv(F.substring("_seeded", 1, 8), 16, 10).cast("long") % 30)
    sizes = sorted(r["count"] for r in placed.toDF("shard").groupBy("shard").count().collect())
    assert len(sizes) == 30 and sizes[-1] <= 3 * sizes[15]


def test_one_row_of_each_component_stays(spark):
    a, b = "one two three four five six seven", "an entirely different text of eight words here"
    some = spark.createDataFrame([(1, a), (1, b), (None, b), (None, b), (None, a + "!")], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("_row", "row", "fp", "root", "first")})
    kept = simhash.keep_one(some)
    assert kept.columns == some.columns
    assert sorted(map(str, rows(kept, "doc_id", "text"))) == sorted(map(str, [(1, a), (1, b), (None, a + "!")]))
    nothing = spark.createDataFrame([(None, b), (None, b), (None, None), (3, ""), (2, " ")], "doc_id long, text string")
    assert sorted(map(str, rows(simhash.keep_one(nothing), "doc_id", "text"))) == sorted(map(str, [(None, b), (2, " ")]))
    assert simhash.keep_one(some.limit(0)).count() == 0


def edge_docs(spark):
    return docs(spark).select("doc_id", "text", "lang", "source", "n_chars")


def test_rows_of_files(spark, tmp_path):
    """Rows just read are told apart by file and place; behind a join or an explode they are not."""
    edge_docs(spark).withColumn("_metadata", F.lit("clash")).repartition(3).write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    seen = read.select(common.file_rows(read).alias("r")).distinct().count()
    assert seen == read.count() == len(texts())
    assert common.file_rows(read.withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(2))))) is None
    assert common.file_rows(edge_docs(spark)) is None
    whole, row = common.identified(read.withColumn("_row", F.lit(1)), "t", None)
    assert row == "_row_" and whole.select(row).distinct().count() == len(texts())


def test_stages_on_edge_tables(spark, tmp_path):
    """Null ids and texts, repeats and long texts go through all stages; so does no document at all."""
    import corpus_pipeline

    root = "/root/testdata/sf0.001"
    for n, start in enumerate((edge_docs(spark).unionByName(edge_docs(spark).limit(9)), edge_docs(spark).limit(0))):
        kept = start
        for name, stage in corpus_pipeline.STAGES:
            before, path = kept, str(tmp_path / f"{name}{n}")
            stage(spark, kept, root).write.parquet(path)
            kept = spark.read.parquet(path)
            if name != "packing":
                assert kept.columns == start.columns, name
            if name == "near_copies":
                assert kept.count() == len(set(brute_components([brute_fingerprint(t) for (t,) in rows(before, "text")])))
        assert (kept.count() > 0) == (not start.isEmpty())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    root = "/root/testdata/sf0.001"
    assert difference(queries.QUERIES[name](spark, root), connect(root), queries.SQL[name]) is None


def test_pipeline(spark):
    import corpus_pipeline

    root = "/root/testdata/sf0.001"
    docs_ = spark.read.parquet(f"{root}/documents.parquet")
    kept = docs_
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, root)
        assert kept.columns == docs_.columns, name
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert 0.5 * docs_.count() < len(ids) <= docs_.count() and max(ids.values()) <= 3
    got = corpus_pipeline.run(spark, root)
    assert got.agg(F.sum("length")).first()[0] > 0
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == set(ids)
