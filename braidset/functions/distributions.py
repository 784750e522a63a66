"""Student t and normal distribution functions for already aggregated rows.

Spark has no incomplete beta function, so these run as Arrow functions. They
see one row per statistic, never one row per record.
"""

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated by Lentz's method."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + step / c
            c = c if abs(c) > _TINY else _TINY
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b)
        - math.lgamma(a)
        - math.lgamma(b)
        + a * math.log(x)
        + b * math.log1p(-x)
    )
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom."""
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(q: float, df: float) -> float:
    """Value below which a share ``q`` of Student's t lies, by bisection on the tail."""
    if math.isnan(df) or df <= 0:
        return math.nan
    tail = 2.0 * min(q, 1.0 - q)
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > tail:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if t_two_sided(mid, df) > tail:
            low = mid
        else:
            high = mid
    return math.copysign((low + high) / 2.0, q - 0.5)


def normal_two_sided(z: float) -> float:
    return math.nan if math.isnan(z) else math.erfc(abs(z) / math.sqrt(2.0))


def _tail_count(excess: int, small: int, large: int) -> int:
    """Arrangements whose U is at most ``excess``: a coefficient of a generating function.

    It is prod(1 - q**(large + i)) / (prod(1 - q**i) * (1 - q)), i = 1..small, at q**excess. The
    numerator has at most 2**small terms. With step the least common multiple of 1..small, the
    denominator becomes (1 - q**step)**(small + 1) over a polynomial of fixed degree, so that the work
    does not depend on ``large``.
    """
    step = math.lcm(*range(1, small + 1))
    fixed = [1]
    for i in [*range(1, small + 1), 1]:
        repeated = [0] * (len(fixed) + step - i)
        for at, c in enumerate(fixed):
            for k in range(0, step, i):
                repeated[at + k] += c
        fixed = repeated
    numerator = {0: 1}
    for i in range(1, small + 1):
        for at, c in list(numerator.items()):
            numerator[at + large + i] = numerator.get(at + large + i, 0) - c
    total = 0
    for at, c in numerator.items():
        left = excess - at
        if c and left >= 0:
            first = left % step
            for d in range(first, min(left, len(fixed) - 1) + 1, step):
                total += c * fixed[d] * math.comb((left - d) // step + small, small)
    return total


def rank_sum_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of the U statistic without ties, in whole numbers, for any sizes."""
    small, large = sorted((int(n1), int(n2)))
    upper = max(u, n1 * n2 - u)
    tail = _tail_count(small * large - int(math.ceil(upper)), small, large)
    return float(min(Fraction(1), Fraction(2 * tail, math.comb(small + large, small))))


def _over_rows(fn, *series):
    return pd.Series(
        [
            math.nan if any(v is None or v != v for v in row) else fn(*map(float, row))
            for row in zip(*series)
        ],
        dtype="float64",
    ).replace({np.nan: None})


def t_p_value(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def p(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return _over_rows(t_two_sided, ts, dfs)

    return p(t.cast("double"), df.cast("double"))


def t_critical(df: Column, q: float = 0.975) -> Column:
    @F.pandas_udf("double")
    def value(dfs: pd.Series) -> pd.Series:
        return _over_rows(lambda d: t_quantile(q, d), dfs)

    return value(df.cast("double"))


def normal_p_value(z: Column) -> Column:
    @F.pandas_udf("double")
    def p(zs: pd.Series) -> pd.Series:
        return _over_rows(normal_two_sided, zs)

    return p(z.cast("double"))


def rank_sum_p_value(u: Column, n1: Column, n2: Column, z: Column, has_ties: Column) -> Column:
    """Exact when one sample has at most eight rows and nothing is tied, else normal."""

    @F.pandas_udf("double")
    def p(us: pd.Series, a: pd.Series, b: pd.Series, zs: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for u_, n1_, n2_, z_, t_ in zip(us, a, b, zs, ties):
            if u_ is None or u_ != u_ or not n1_ or not n2_:
                out.append(None)
            elif min(n1_, n2_) <= 8 and not t_:
                out.append(rank_sum_exact(u_, n1_, n2_))
            else:
                # z is signed: below the middle the two tails overlap and p is 1
                missing = z_ is None or z_ != z_
                out.append(None if missing else min(1.0, math.erfc(z_ / math.sqrt(2.0))))
        return pd.Series(out, dtype="float64")

    return p(u.cast("double"), n1.cast("long"), n2.cast("long"), z.cast("double"), has_ties)
