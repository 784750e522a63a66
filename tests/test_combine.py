"""Generated cases against brute force on small pools."""

import math
import time
from collections import Counter
from itertools import combinations, product
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from braidset.operators import combine, unrank
from braidset.plans import staging
from braidset.schemas import LABELS


def pool(spark, sizes, chars=8):
    rows = [("train", f"m{t}{i}", "x" * chars + f"{t}{i}", f"{t}-{i}", t) for t, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "split string, message string, diff string, sha string, type string"), rows


@pytest.fixture(scope="module")
def made(spark):
    df, rows = pool(spark, {"feat": 12, "fix": 9, "docs": 7, "ci": 2, "test": 5})
    out = combine.combine_cases(df, oversample=3)
    return rows, out.cases.collect(), {r.concern_count: r for r in out.report.collect()}


def test_cases_keep_their_promises(made):
    rows, cases, report = made
    by_sha = {r[3]: r for r in rows}
    seen = set()
    for c in cases:
        assert len(c.types) == len(set(c.types)) == len(c.shas) == len(c.diff) == c.concern_count
        assert [by_sha[s][4] for s in c.shas] == c.types
        assert [by_sha[s][2] for s in c.shas] == c.diff
        assert ",".join(by_sha[s][1] for s in c.shas) == c.commit_message
        combo = (c.concern_count, frozenset(c.shas))
        assert combo not in seen
        seen.add(combo)
    counts = Counter(c.concern_count for c in cases)
    for k, r in report.items():
        assert counts[k] == min(r.target, r.distinct_cases) and r.target == len(rows)
        assert r.attempts == r.token_rejected + r.duplicate_rejected + r.distinct_cases
        assert r.shortfall == r.target - counts[k]
    assert counts[1] == len(rows)


def test_too_few_types_is_a_shortfall(spark):
    df, rows = pool(spark, {"feat": 3, "fix": 3})
    out = combine.combine_cases(df, counts=(1, 2, 3))
    report = {r.concern_count: r for r in out.report.collect()}
    assert report[3].attempts == 0 and report[3].shortfall == len(rows)
    assert report[1].shortfall == 0


def test_limit_and_target(spark):
    df, rows = pool(spark, {"feat": 6, "fix": 6, "docs": 6}, chars=40)
    out = combine.combine_cases(df, counts=(1, 2, 3), limit=25, target=5)
    report = {r.concern_count: r for r in out.report.collect()}
    assert report[3].distinct_cases == 0 and report[3].token_rejected == report[3].attempts
    assert Counter(c.concern_count for c in out.cases.collect()) == {1: 5, 2: 5}


def test_copies_count_once(spark):
    df, _ = pool(spark, {"feat": 4, "fix": 4})
    copies = df.where("sha = 'feat-0'").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("n")
    plain = combine.combine_cases(df, counts=(1, 2)).cases
    doubled = combine.combine_cases(df.unionByName(copies), counts=(1, 2)).cases
    key = lambda d: sorted((c.concern_count, tuple(c.shas), c.commit_message) for c in d.collect())
    assert key(plain) == key(doubled)


def test_rare_type_is_spread(spark, monkeypatch):
    """Draws of a rare record go to several copies and give the same cases."""
    df, _ = pool(spark, {"feat": 40, "fix": 40, "docs": 1})
    key = lambda d: sorted((tuple(c.shas), tuple(c.types)) for c in d.collect())
    plain = key(combine.combine_cases(df, counts=(2, 3)).cases)
    monkeypatch.setattr(combine, "DRAWS_PER_COPY", 5)
    assert key(combine.combine_cases(df, counts=(2, 3)).cases) == plain


def test_more_tries_reach_the_target(spark):
    df, rows = pool(spark, {"feat": 5, "fix": 5})
    out = combine.combine_to_target(df, oversample=1, counts=(2,), target=20)
    assert out.report.first().shortfall == 0 and out.cases.count() == 20
    full = combine.combine_to_target(df, oversample=1, counts=(2,), target=26)
    assert full.report.first().shortfall == 1 and full.cases.count() == 25


def test_same_result_on_any_partitioning(spark):
    df, _ = pool(spark, {"feat": 9, "fix": 9, "docs": 9})
    key = lambda d: sorted((c.concern_count, tuple(c.shas)) for c in combine.combine_cases(d, counts=(1, 3)).cases.collect())
    assert key(df.repartition(1)) == key(df.repartition(7))


def _shuffled(plan) -> int:
    """Bytes of rows that the exchanges of a plan that has run dealt out."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return _shuffled(plan.executedPlan())
    if "QueryStage" in name:
        return _shuffled(plan.plan())
    if name.startswith("ReusedExchange"):
        return 0
    own = plan.metrics().apply("dataSize").value() if name == "Exchange" else 0
    return own + sum(_shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_the_longest_text_of_a_case_stays_where_it_is(spark):
    """Texts of one label are some hundred times those of the others, and do not pack well."""
    long = {f"feat-{i}": "".join(chr(0x4E00 + (j * j * 31 + j * (i + 7) * 13) % 20_000) for j in range(12_000)) for i in range(20)}
    short = {f"{t}-{i}": f"{t}{i}" * 5 for t in LABELS if t != "feat" for i in range(20)}
    rows = [("train", f"m{s}", d, s, s.rpartition("-")[0]) for s, d in (long | short).items()]
    df = spark.createDataFrame(rows, "split string, message string, diff string, sha string, type string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cases = combine.combine_cases(df, counts=(2, 3, 4)).cases
        found = cases.collect()
        moved = _shuffled(cases._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_sha = {r[3]: r for r in rows}
    for c in found:
        assert c.diff == [by_sha[s][2] for s in c.shas] and c.commit_message == ",".join(by_sha[s][1] for s in c.shas)
        assert c.types == [by_sha[s][4] for s in c.shas] and len(c.types) == c.concern_count
    assert Counter(c.concern_count for c in found) == {k: len(rows) for k in (2, 3, 4)}
    assert moved < sum(len(d.encode()) for c in found for d in c.diff) / 2


def test_texts_that_are_missing_odd_or_under_a_missing_key(spark):
    rows = [
        ("train", None, None, "a", "feat"),
        ("train", "m", "", "b", "fix"),
        ("train", "é", "x\x00\U0001f600\n", "c", "docs"),
        ("train", "lost", "no key", None, "ci"),
        ("train", "long", "x" * 500, "d", "test"),
    ]
    df = spark.createDataFrame(rows, "split string, message string, diff string, sha string, type string")
    found = combine.combine_cases(df, counts=(1, 2, 3), limit=20, oversample=20).cases.collect()
    by_sha = {r[3]: r for r in rows}
    for c in found:
        assert "d" not in c.shas and None not in c.shas and c.shas
        assert c.diff == [by_sha[s][2] or "" for s in c.shas] and c.commit_message == ",".join(by_sha[s][1] or "" for s in c.shas)
    assert {("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c"), ("a", "b", "c")} == {tuple(sorted(c.shas)) for c in found}


def test_staged_tables_leave_no_shuffle_files(spark):
    disks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {str(p) for d in disks for p in Path(d).glob("*/shuffle_*")}
    before, drops = files(), spark.conf.get(staging.DROPS_SHUFFLES, None)
    made = staging.stage(spark.range(1000).repartition(4, "id").groupBy("id").count(), "few")
    deadline = time.monotonic() + 30
    while files() - before and time.monotonic() < deadline:
        time.sleep(0.2)
    assert not files() - before and made.count() == 1000 and spark.conf.get(staging.DROPS_SHUFFLES, None) == drops


# --- drawing to a target, without replacement


def test_target_is_met_or_every_set_is_drawn(spark):
    """Three records that fit among forty, in each of seven labels."""
    rows = [("train", f"m{t}{i}", "x" * (8 if i < 3 else 400), f"{t}-{i}", t) for t in LABELS for i in range(40)]
    df = spark.createDataFrame(rows, "split string, message string, diff string, sha string, type string")
    out = combine.combine_to_target(df, 280, limit=40)
    cases = out.cases.collect()
    report = {r.concern_count: r for r in out.report.collect()}
    exist = {k: sum(1 for _ in combinations(LABELS, k)) * 3**k for k in range(1, 6)}
    assert exist[2] == 189
    for k, r in report.items():
        assert Counter(c.concern_count for c in cases)[k] == min(280, exist[k])
        assert r.shortfall == max(0, 280 - exist[k]) and r.distinct_cases <= exist[k]
        assert r.exhausted == (r.distinct_cases == exist[k])
    assert len({(c.concern_count, frozenset(c.shas)) for c in cases}) == len(cases)
    by_sha = {r[3]: r for r in rows}
    for c in cases:
        assert [by_sha[s][4] for s in c.shas] == c.types and len(set(c.types)) == c.concern_count
        assert [by_sha[s][2] for s in c.shas] == c.diff and sum(map(len, c.diff)) // 4 <= 40


def test_numbers_are_permuted_one_to_one(spark):
    sizes = {"feat": 5, "fix": 3, "docs": 4, "ci": 1}
    df, _ = pool(spark, sizes)
    plan = unrank.numbered(combine.pool_of(df).drop("records"), (2, 3), 400, 7)
    whole = plan.combos.withColumns({"since": F.lit(0).cast("bigint"), "until": F.col("sets")})
    got = unrank.visits(whole, 7).groupBy("k", "combo", "number").agg(F.concat_ws(",", F.array_sort(F.collect_list(F.concat("type", F.lit(":"), "idx")))).alias("s")).collect()
    want = sum(math.prod(sizes[t] for t in c) for k in (2, 3) for c in combinations(sizes, k))
    assert len(got) == want and len({(r.k, r.s) for r in got}) == want
    first = {(r.k, r.combo): r.s for r in got if r.number == 0}
    again = unrank.visits(whole, 8).where("number = 0").groupBy("k", "combo").agg(F.concat_ws(",", F.array_sort(F.collect_list(F.concat("type", F.lit(":"), "idx")))).alias("s")).collect()
    assert any(first[r.k, r.combo] != r.s for r in again)


def test_sets_that_cannot_fit_are_not_numbered(spark):
    rows = [("train", "m", "x" * n, f"{t}{n}", t) for t, ns in {"feat": (10, 30, 90), "fix": (10, 95), "docs": (50,)}.items() for n in ns]
    df = spark.createDataFrame(rows, "split string, message string, diff string, sha string, type string")
    plan = unrank.numbered(combine.pool_of(df).drop("records"), (2, 3), combine.room_of(16), 1)
    kept = {k: sorted(r.sha for r in plan.records.where(F.col("k") == k).collect()) for k in (2, 3)}
    # 67 characters: beside the shortest of another type, or of both.
    assert kept == {2: ["docs50", "feat10", "feat30", "fix10"], 3: []}
    out = combine.combine_to_target(df, 50, counts=(2, 3), limit=16)
    assert sorted(tuple(sorted(c.shas)) for c in out.cases.collect()) == [("docs50", "feat10"), ("docs50", "fix10"), ("feat10", "fix10"), ("feat30", "fix10")]
    assert {(r.concern_count, r.shortfall, r.exhausted) for r in out.report.collect()} == {(2, 46, True), (3, 50, True)}


def test_hot_records_copies_and_shared_shas(spark, monkeypatch):
    """One record of a rare label is in a third of all sets; a sha under two types makes equal sets; copies count once."""
    monkeypatch.setattr(unrank, "DRAWS_PER_COPY", 5)
    monkeypatch.setattr(combine, "DRAWS_PER_COPY", 5)
    df, rows = pool(spark, {"feat": 10, "fix": 10, "ci": 1})
    same = spark.createDataFrame([("train", "mm", "xxxxxxxxxfeat0", "fix-3", "feat")] + [rows[0]] * 3, df.schema)
    out = combine.combine_to_target(df.unionByName(same), {"train": 10_000, "other": 3}, counts=(1, 2, 3), limit=100)
    cases = out.cases.collect()
    report = {r.concern_count: r for r in out.report.collect()}
    feat, fix = [f"feat-{i}" for i in range(10)] + ["fix-3"], [f"fix-{i}" for i in range(10)]
    want = {1: {(s,) for s in feat + fix + ["ci-0"]}, 2: {tuple(sorted(x)) for x in [*product(feat, fix), *product(feat + fix, ["ci-0"])]}, 3: {tuple(sorted(x)) for x in product(feat, fix, ["ci-0"])}}
    for k in want:
        got = [tuple(sorted(c.shas)) for c in cases if c.concern_count == k]
        assert len(got) == len(set(got)) and set(got) == want[k]
        r = report[k]
        assert r.exhausted and r.attempts == r.token_rejected + r.duplicate_rejected + r.distinct_cases and r.distinct_cases == len(want[k])
    assert combine.combine_to_target(df.limit(0), 5).cases.count() == 0


def test_very_many_sets_are_shared_out(spark):
    """Ten combinations at the bound of numbers: their sum is beyond a bigint."""
    rows = [("train", 5, i, ["feat"], [1], unrank.MOST) for i in range(10)]
    combos = spark.createDataFrame(rows, "split string, k int, combo int, types array<string>, radix array<bigint>, sets bigint")
    goal = spark.createDataFrame([("train", 280)], "split string, target bigint")
    assert {r.until for r in unrank.reach(combos, goal, 2).collect()} == {56}
