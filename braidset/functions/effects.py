"""Names for sizes and signs of statistics."""

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Published limits and the names they give, strictest first; the last name is for all the rest.
STARS = ((0.001, "***"), (0.01, "**"), (0.05, "*"), (None, ""))
CORRELATION_SIZES = ((0.5, "large"), (0.3, "medium"), (0.1, "small"), (None, "negligible"))
CORRELATION_DIRECTIONS = (
    (0.5, "Strong positive"),
    (0.3, "Moderate positive"),
    (0.1, "Weak positive"),
    (-0.1, "Weak negative"),
    (-0.3, "Moderate negative"),
    (None, "Strong negative"),
)
FIT_QUALITIES = ((0.9, "Excellent fit"), (0.7, "Good fit"), (0.5, "Moderate fit"), (0.3, "Weak fit"), (None, "Poor fit"))
GROUP_EFFECTS = ((0.8, "Large"), (0.5, "Medium"), (0.2, "Small"), (None, "Negligible"))


def _named(limits: Sequence[tuple[float | None, str]], meets) -> Column:
    """The first name whose limit ``meets`` holds for."""
    *limited, (_, rest) = limits
    out = F.lit(rest)
    for limit, name in reversed(limited):
        out = F.when(meets(limit), F.lit(name)).otherwise(out)
    return out


def stars(p: Column) -> Column:
    return _named(STARS, lambda limit: p < limit)


def correlation_size(r: Column) -> Column:
    return _named(CORRELATION_SIZES, lambda limit: F.abs(r) >= limit)


def correlation_direction(r: Column) -> Column:
    """The six published names; see ``correlation_sign`` for the true sign of a weak one."""
    return _named(CORRELATION_DIRECTIONS, lambda limit: r > limit)


def correlation_sign(r: Column) -> Column:
    return F.signum(r).cast("int")


def fit_quality(r2: Column) -> Column:
    return _named(FIT_QUALITIES, lambda limit: r2 >= limit)


def group_effect(d: Column) -> Column:
    return _named(GROUP_EFFECTS, lambda limit: F.abs(d) >= limit)
