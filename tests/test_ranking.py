"""Counting-based ranks against brute force, with hot keys and copies."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from braidset.operators import curate, quantiles
from braidset.operators.ranking import dense_index, number_level, seeded_key, seeded_split


def key(v, seed=42):
    return hashlib.md5(f"{seed}|{v}".encode()).hexdigest()


numbers = st.lists(
    st.one_of(st.floats(-1e6, 1e6, allow_nan=False), st.integers(-5, 5).map(float), st.floats(100, 100.001)), min_size=1, max_size=60
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(xs=numbers)
def test_quantiles_match_interpolation(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = quantiles.exact_quantiles(df, "x", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}).first()
    want = np.quantile(np.array(xs), [0.0, 0.25, 0.5, 0.9, 1.0])
    assert np.allclose([got.a, got.b, got.c, got.d, got.e], want, rtol=1e-12, atol=1e-9)


def test_quantiles_by_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([7.0, rng.gauss(0, 1), rng.gauss(0, 1e-9)])) for _ in range(3000)]
    rows += [(f"g{i}", rng.random()) for i in range(50)] + [("hot", None), ("hot", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: r for r in quantiles.exact_quantiles(df, "x", {"q1": 0.25, "q3": 0.75}, ["g"]).collect()}
    hot = [x for g, x in rows if g == "hot" and x is not None and x == x]
    assert np.allclose([got["hot"].q1, got["hot"].q3], np.quantile(hot, [0.25, 0.75]))
    assert len(got) == 51 and got["hot"].n == len(hot)


def test_fences_split_the_rows(spark):
    rows = [(float(i),) for i in range(20)] + [(500.0,), (-500.0,)]
    df = spark.createDataFrame(rows, "x double")
    kept, out = quantiles.drop_outliers(df, "x"), quantiles.outlier_rows(df, "x")
    assert kept.count() + out.count() == len(rows)
    assert sorted(r.x for r in out.collect()) == [-500.0, 500.0]
    report = quantiles.outlier_report(quantiles.flag_outliers(df, "x"), "x").first()
    assert (report.outlier_count, report.removed, report.outlier_percent) == (2, True, 9.1)


@pytest.mark.parametrize("n,train", [(1, 0), (4, 3), (5, 4), (10, 8)])
def test_split_sizes(spark, n, train):
    df = spark.createDataFrame([("feat", f"s{i}") for i in range(n)], "type string, sha string")
    got = curate.split_by_type(df).where("split = 'train'")
    want = sorted((f"s{i}" for i in range(n)), key=key)[:train]
    assert sorted(r.sha for r in got.collect()) == sorted(want)


def test_copies_at_the_cut(spark):
    """One sha on a third of all rows: sizes stay exact and no row is lost."""
    rows = [("feat", f"s{i}", "d") for i in range(200)] + [("feat", "hot", "d")] * 100 + [("fix", "one", "d")]
    df = spark.createDataFrame(rows, "type string, sha string, diff string")
    for share in (0.1, 0.35, 0.5, 0.65, 0.8):
        got = curate.split_by_type(df, share)
        assert got.count() == len(rows)
        assert got.where("type = 'feat' AND split = 'train'").count() == int(300 * share)
        assert got.where("sha = 'hot'").count() == 100


def test_split_without_groups(spark):
    df = spark.range(50).withColumn("sha", F.col("id").cast("string"))
    got = seeded_split(df, seeded_key(F.col("sha")), lambda n: F.lit(7))
    assert sorted(r.sha for r in got.where("chosen").collect()) == sorted(sorted(map(str, range(50)), key=key)[:7])


def test_many_groups(spark):
    """Two hundred thousand groups of three rows: nothing depends on their number."""
    df = spark.range(600_000).select((F.col("id") % 200_000).alias("g"), (F.col("id") % 7 + 0.0).alias("x"), F.col("id").cast("string").alias("sha"))
    assert quantiles.drop_outliers(df, "x", by=["g"]).count() == 600_000
    assert quantiles.box_summary(df, "x", ["g"]).count() == 200_000
    got = curate.split_by_type(df.select(F.col("g").cast("string").alias("type"), "sha"), 0.5)
    assert got.where("split = 'train'").count() == 200_000


def test_nan_is_no_outlier(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(20)] + [("a", float("nan")), ("a", 900.0), ("b", None)], "g string, x double")
    assert [r.x for r in quantiles.outlier_rows(df, "x").collect()] == [900.0]
    box = {r.g: r for r in quantiles.box_summary(df, "x", ["g"]).collect()}
    assert box["a"].fliers == 1 and box["a"].whisker_high == 19.0


def test_infinite_values_have_a_place(spark):
    df = spark.createDataFrame([(x,) for x in (float("-inf"), -1e308, -5e-324, 0.0, 5e-324, 1e308, float("inf"))], "x double")
    levels = df.select("x", number_level(F.col("x"), 24).alias("l")).orderBy("l").collect()
    assert [r.x for r in levels] == [float("-inf"), -1e308, -5e-324, 0.0, 5e-324, 1e308, float("inf")]
    assert quantiles.exact_quantiles(df, "x", {"m": 0.5}).first().m == 0.0


def test_topup(spark):
    pool = spark.createDataFrame([("feat", f"a{i}") for i in range(30)] + [("fix", f"b{i}") for i in range(3)], "annotated_type string, sha string")
    have = spark.createDataFrame([("feat", 4), ("docs", 9)], "annotated_type string, count bigint")
    got = {r.annotated_type: r["count"] for r in curate.topup_sample(pool, have, 10).groupBy("annotated_type").count().collect()}
    assert got == {"feat": 6, "fix": 3}
    full = spark.createDataFrame([("feat", 10), ("fix", 50)], "annotated_type string, count bigint")
    assert curate.topup_sample(pool, full, 10).isEmpty()


def test_sample_needs_enough_rows(spark):
    df = spark.createDataFrame([(f"s{i}",) for i in range(5)], "sha string")
    assert sorted(r.row_idx for r in curate.sample_n(df, 5).collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="cannot sample"):
        curate.sample_n(df, 6).collect()


def test_dense_index(spark):
    values = [-7, 0, 1, 2, 3, 1000, 2**40, 2**52 + 1, 2**52 + 2]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(4)
    x = F.col("v")
    got = dense_index(df, [number_level(x, 10), number_level(x, 20)], ["v"], size="n")
    assert [(r.v, r.idx) for r in got.orderBy("v").collect()] == [(v, i) for i, v in enumerate(values)]
    assert {r.n for r in got.collect()} == {len(values)}


def test_valid_types_are_counted(spark):
    from pyspark.sql import Observation

    df = spark.createDataFrame([("feat",), ("style",), (None,)], "annotated_type string")
    seen = Observation("types")
    assert curate.valid_types(df, counts=seen).count() == 1
    assert seen.get == {"kept": 1, "dropped": 2}


def test_a_split_shuffles_no_texts(spark):
    """Seven groups are few cuts: rows are flagged where they lie, not dealt to a task for each group."""
    from braidset.operators.curate import split_by_type

    df = spark.range(0, 4000, 1, 6).select(F.col("id").cast("string").alias("sha"), F.concat(F.lit("t"), F.col("id") % 7).alias("type"), F.repeat(F.lit("x"), 50).alias("diff"))
    out = split_by_type(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert out.where("split = 'train'").count() == sum(len(range(t, 4000, 7)) * 8 // 10 for t in range(7))
    # No row was read from a shuffle.
    assert out.select("sha", F.spark_partition_id().alias("p")).groupBy("p").count().count() == 6
