import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidset.functions import distributions as D
from braidset.functions import effects
from braidset.operators import correlate, groups
from braidset.plans import reports


def test_pinned_distribution_values():
    assert D.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert D.t_two_sided(12.7062047364, 1) == pytest.approx(0.05, abs=1e-9)
    assert D.t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    assert D.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-9)
    assert D.t_quantile(0.975, 1e6) == pytest.approx(1.959966, abs=1e-5)
    assert D.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert D.t_two_sided(float("inf"), 5) == 0.0 and D.t_two_sided(1e200, 5) < 1e-300 * 1e300


def test_rank_sum_exact_by_counting():
    from itertools import combinations

    for n1, n2 in ((3, 3), (2, 5), (4, 3)):
        places = list(combinations(range(n1 + n2), n1))
        us = [sum(p) - n1 * (n1 - 1) // 2 for p in places]
        for u in range(n1 * n2 + 1):
            top = max(u, n1 * n2 - u)
            want = min(1.0, 2 * sum(x >= top for x in us) / len(us))
            assert D.rank_sum_exact(u, n1, n2) == pytest.approx(want)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        ctx, k, m = rng.choice([1024, 2048, 4096, 8192]), rng.randint(1, 5), rng.random() < 0.4
        t = round(2 + 0.001 * ctx + 0.7 * k + (0.5 if m else 0) + rng.gauss(0, 1) ** 2, 1)
        rows.append((i, ctx, k, m, t, rng.random(), rng.random(), rng.random()))
    schema = "row_id int, context_len int, concern_count int, with_message boolean, inference_time double, precision double, recall double, f1 double"
    return rows, spark.createDataFrame(rows, schema).repartition(4)


def column(rows, i):
    return np.array([float(r[i]) for r in rows])


def test_line_and_band(table):
    rows, df = table
    x, y = column(rows, 1), column(rows, 4)
    fit = correlate.simple_ols(df, "context_len", "inference_time")
    r = fit.first()
    slope, intercept = np.polyfit(x, y, 1)
    mse = np.sum((y - slope * x - intercept) ** 2) / (len(x) - 2)
    assert np.allclose([r.slope, r.intercept, r.mse, r.ss_x], [slope, intercept, mse, np.sum((x - x.mean()) ** 2)])
    band = correlate.ci_band(fit).orderBy("point").collect()
    assert len(band) == 100 and band[0].x == x.min() and band[-1].x == x.max()
    half = D.t_quantile(0.975, len(x) - 2) * math.sqrt(mse * (1 / len(x) + (x.min() - x.mean()) ** 2 / r.ss_x))
    assert band[0].ci_high - band[0].y == pytest.approx(half)


def test_ols_against_least_squares(table):
    rows, df = table
    clean = correlate.log_features(correlate.positive_domain(df))
    r = correlate.interaction_ols(clean).first()
    a, k, y = np.log(column(rows, 1) + 1e-6), column(rows, 2), np.log(column(rows, 4) + 1e-6)
    design = np.column_stack([np.ones_like(a), a, k, a * k])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    assert np.allclose([r.intercept, r.beta_log_tokens, r.beta_concern_count, r.beta_log_tokens_x_concern], beta, rtol=1e-7)
    res = y - design @ beta
    assert r.mse == pytest.approx(np.mean(res**2)) and r.r2 == pytest.approx(1 - np.mean(res**2) / y.var())
    grid = correlate.prediction_grid(clean, correlate.interaction_ols(clean))
    assert grid.count() == 20


def test_partial_table_against_residuals(table):
    rows, df = table
    x1, x2 = np.log2(column(rows, 1)), column(rows, 2)
    got = {r.metric: r for r in correlate.with_partial_p(correlate.partial_table(df)).collect()}
    for m, i in (("precision", 5), ("inference_time", 4)):
        y = column(rows, i)
        res = lambda v, z: v - np.polyval(np.polyfit(z, v, 1), z)
        r = got[m]
        assert r.partial_r_context_len == pytest.approx(np.corrcoef(res(x1, x2), res(y, x2))[0, 1])
        assert r.partial_r_concern_count == pytest.approx(np.corrcoef(res(x2, x1), res(y, x1))[0, 1])
        assert r.pearson_r_context_len == pytest.approx(np.corrcoef(column(rows, 1), y)[0, 1])
        beta, *_ = np.linalg.lstsq(np.column_stack([np.ones_like(y), x1, x2]), y, rcond=None)
        assert np.allclose([r.beta_context_len, r.beta_concern_count], beta[1:])
        assert r.std_beta_context_len == pytest.approx(beta[1] * x1.std() / y.std())
        assert r.vif_context_len == pytest.approx(1 / (1 - np.corrcoef(x1, x2)[0, 1] ** 2))
        t = r.partial_r_context_len * math.sqrt((r.n - 2) / (1 - r.partial_r_context_len**2))
        assert r.partial_p_context_len == pytest.approx(D.t_two_sided(t, r.n - 2))


def test_residual_line(table):
    rows, df = table
    out = correlate.residual_table(df, F.col("context_len"), F.col("f1"), F.col("concern_count"), ["row_id"]).collect()
    x, y = np.array([r.x_residual for r in out]), np.array([r.y_residual for r in out])
    slope, intercept = np.polyfit(x, y, 1)
    assert out[0].line_slope == pytest.approx(slope) and intercept == pytest.approx(0, abs=1e-12)


def _u(a, b):
    return sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def test_mann_whitney_against_pairs(table):
    rows, df = table
    a = [r[4] for r in rows if r[3]]
    b = [r[4] for r in rows if not r[3]]
    r = groups.with_u_p(groups.mann_whitney(df)).first()
    assert r.u_statistic == _u(a, b) and (r.n1, r.n0) == (len(a), len(b))
    counts = np.unique(np.array(a + b), return_counts=True)[1].astype(float)
    n = len(rows)
    tie = np.sum(counts**3 - counts)
    assert r.tie_term == tie
    sd = math.sqrt(len(a) * len(b) / 12 * (n + 1 - tie / (n * (n - 1))))
    z = (max(r.u_statistic, len(a) * len(b) - r.u_statistic) - len(a) * len(b) / 2 - 0.5) / sd
    assert r.u_p_value == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_mann_whitney_small_and_empty(spark):
    df = spark.createDataFrame([(True, 1.0), (True, 2.0), (True, 3.0), (False, 4.0), (False, 5.0), (False, -6.0)], "with_message boolean, inference_time double")
    r = groups.with_u_p(groups.mann_whitney(df)).first()
    assert r.u_statistic == 3.0 and r.u_p_value == pytest.approx(D.rank_sum_exact(3, 3, 3))
    one = groups.with_u_p(groups.mann_whitney(df.where("with_message"))).first()
    assert one.u_statistic is None and one.u_p_value is None


def test_two_sample(table):
    rows, df = table
    a, b = (np.array([r[4] for r in rows if r[3] == on]) for on in (True, False))
    pooled = math.sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2))
    r = groups.two_sample(df).first()
    assert r.cohens_d == pytest.approx((a.mean() - b.mean()) / pooled)
    assert r.t_statistic == pytest.approx(r.cohens_d / math.sqrt(1 / len(a) + 1 / len(b)))
    assert groups.two_sample(df.limit(1)).first().t_statistic is None


def test_constant_and_short_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert correlate.pearson(df, "x", "y").first().r is None
    assert correlate.simple_ols(df, "x", "y").first().slope is None
    r = correlate.with_p(correlate.pearson(df.limit(1), "x", "y")).first()
    assert (r.r, r.p) == (0.0, 1.0)
    line = spark.createDataFrame([(float(i), 2.0 * i) for i in range(5)], "x double, y double")
    r = correlate.with_p(correlate.pearson(line, "x", "y")).first()
    assert r.r == pytest.approx(1.0) and r.p == pytest.approx(0.0, abs=1e-6)


def test_labels(spark):
    def names(fn, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
        return [r.n for r in df.orderBy("i").select(fn(F.col("v")).alias("n")).collect()]

    assert names(effects.stars, [0.0009, 0.001, 0.01, 0.05]) == ["***", "**", "*", ""]
    assert names(effects.group_effect, [0.8, -0.5, 0.2, 0.19]) == ["Large", "Medium", "Small", "Negligible"]
    assert names(effects.fit_quality, [0.9, 0.7, 0.5, 0.3, 0.29]) == ["Excellent fit", "Good fit", "Moderate fit", "Weak fit", "Poor fit"]
    assert names(effects.correlation_size, [0.5, -0.3, 0.1, 0.0]) == ["large", "medium", "small", "negligible"]
    assert names(effects.correlation_direction, [0.6, 0.4, 0.2, 0.05, -0.2, -0.4]) == [
        "Strong positive", "Moderate positive", "Weak positive", "Weak negative", "Moderate negative", "Strong negative"]
    assert names(effects.correlation_sign, [0.05, -0.05]) == [1, -1]


def test_reports(table):
    _, df = table
    kept = reports.efficiency_report(df, "context_len", remove_outliers=False).first()
    cut = reports.efficiency_report(df, "context_len").first()
    assert kept.data_summary.total_samples == 400
    assert cut.data_summary.total_samples == 400 - cut.data_summary.outliers_detected
    assert cut.linear_regression.confidence_interval.t_value == pytest.approx(1.966, abs=2e-3)
    m = reports.message_report(df).first()
    n = m.group_comparison.with_message["count"] + m.group_comparison.without_message["count"]
    assert n == m.data_summary.total_samples and m.statistical_tests.t_test.p_value < 0.05
    report = {(r.factor, r.metric): r for r in reports.correlation_report(df).collect()}
    assert report["context_len", "inference_time"].stars == "***" and len(report) == 8


def test_exact_rank_sum_of_any_size():
    from itertools import combinations

    from braidset.functions.distributions import rank_sum_exact

    for n1, n2 in ((1, 5), (2, 3), (3, 6), (4, 4)):
        us = [sum(c) - n1 * (n1 - 1) // 2 for c in combinations(range(n1 + n2), n1)]
        for u in set(us):
            upper = max(u, n1 * n2 - u)
            assert abs(rank_sum_exact(u, n1, n2) - min(1, 2 * sum(x >= upper for x in us) / len(us))) < 1e-12
    n = 2_000_001
    assert abs(rank_sum_exact(n, 1, n) - 2 / (n + 1)) < 1e-18
    assert rank_sum_exact(0, 8, 250_001) == pytest.approx(5.284e-39, rel=1e-3)
