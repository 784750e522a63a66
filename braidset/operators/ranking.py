"""Positions, cut-offs and order statistics that never sort a whole group in one task.

Every helper works on *levels*: columns that cut the value range ever finer, in
order, the last one being the value itself. A level-by-level histogram finds the
value at a rank by counting alone, so nothing but counts is shuffled, and one
group holding a third of all rows costs no more than many small ones.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from braidset.plans.staging import stage
from braidset.schemas import SEED

_PREFIX = 4
_OCTAVES = 1100


def number_level(x: Column, bits: int) -> Column:
    """An order-preserving bucket with ``2**bits`` steps for each doubling of ``|x|``."""
    x = x.cast("double")
    octave = F.least(F.log2(F.abs(x)), F.lit(float(_OCTAVES)))
    size = F.floor(octave * float(1 << bits)) + (_OCTAVES << bits)
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0).cast("bigint"))


def number_levels(x: Column) -> list[Column]:
    return [number_level(x, 10), number_level(x, 24), x]


def seeded_key(*cols: Column, seed: int = SEED) -> Column:
    """md5 text of the seed and the key: the same order on any cluster and in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_levels(key: Column) -> list[Column]:
    return [F.substring(key, 1, _PREFIX), key]


def hash_number(key: Column, start: int = 17, digits: int = 15) -> Column:
    """A non-negative bigint from ``digits`` hex digits of a md5 text."""
    return F.conv(F.substring(key, start, digits), 16, 10).cast("bigint")


def attach(df: DataFrame, small: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Add one row of ``small`` per group (or its only row) to every row of ``df``."""
    by = list(by)
    if by:
        return df.join(small, by, how)
    names = small.columns
    only = small.select(F.struct(*names).alias("s")).scalar()
    return df.withColumns({n: only[n] for n in names})


def order_statistics(
    df: DataFrame,
    levels: Sequence[Column],
    ranks: Callable[[Column], Column],
    by: Sequence[str] = (),
    extra: DataFrame | None = None,
) -> DataFrame:
    """Exact values at zero-based ``ranks(n)`` in each group.

    Returns ``by``, ``n``, ``rank``, ``value``, ``below`` (rows strictly less) and
    ``ties`` (rows equal). ``extra`` has one row per group; its columns can be
    used by ``ranks``. One narrow pass per level, each shuffling only counts. Without
    groups the buckets that hold a rank are no more than the ranks and are broadcast; with
    groups Spark chooses the join by their size.
    """
    by = list(by)
    names = [f"_l{i}" for i in range(len(levels))]
    leveled = df.select(*by, *[c.alias(n) for c, n in zip(levels, names)]).where(
        F.col(names[-1]).isNotNull()
    )
    group = Window.partitionBy(*by)
    top = leveled.groupBy(*by, names[0]).agg(F.count(F.lit(1)).alias("_c"))
    top = top.withColumns(
        {
            "n": F.sum("_c").over(group),
            "_below": _running(F.sum("_c"), by, names[0]),
        }
    )
    if extra is not None:
        top = top.join(extra, by, "left")
    inside = lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_c"))
    hits = top.withColumn("_ranks", F.filter(ranks(F.col("n")), inside)).where(F.size("_ranks") > 0)
    carried = ["n", "_below", "_ranks"]
    for depth in range(1, len(levels)):
        path, name = by + names[:depth], names[depth]
        hits = hits.select(*path, *carried)
        if not by:  # no more rows than ranks
            hits = F.broadcast(hits)
        fine = (
            leveled.join(hits, path)
            .groupBy(*path, name, *carried)
            .agg(F.count(F.lit(1)).alias("_c"))
        )
        earlier = _running(F.sum("_c"), path, name)
        hits = (
            fine.withColumn("_below", F.col("_below") + earlier)
            .withColumn("_ranks", F.filter("_ranks", inside))
            .where(F.size("_ranks") > 0)
        )
    return hits.select(
        *by,
        "n",
        F.explode("_ranks").alias("rank"),
        F.col(names[-1]).alias("value"),
        F.col("_below").alias("below"),
        F.col("_c").alias("ties"),
    )


def repeat_rows(df: DataFrame, times: str, chunk: int = 100_000) -> DataFrame:
    """Write each row ``times`` times, in chunks so that one long run is spread out."""
    parts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(times) - 1) / chunk))
    size = F.least(F.lit(chunk).cast("bigint"), F.col(times) - F.col("_part") * chunk)
    return (
        df.where(F.col(times) > 0)
        .withColumn("_part", F.explode(parts))
        .withColumn("_copies", size)
        .repartition("_part")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
        .drop("_part", "_copies", "_copy", times)
    )


def _cuts(df, key, want, by, extra):
    least = lambda n: F.least(want(n).cast("bigint"), n)
    none = F.array().cast("array<bigint>")
    return order_statistics(
        df,
        hash_levels(key),
        lambda n: F.when(least(n) > 0, F.array(least(n) - 1)).otherwise(none),
        by,
        extra,
    )


def seeded_split(
    df: DataFrame,
    key: Column,
    want: Callable[[Column], Column],
    by: Sequence[str] = (),
    extra: DataFrame | None = None,
    flag: str = "chosen",
    keys: DataFrame | None = None,
) -> DataFrame:
    """Flag the first ``want(n)`` rows of each group in the order of a md5 ``key``.

    The key at the cut is found from histograms; then every row is flagged where it
    lies, so the wide columns are not shuffled. Rows that share the key at the cut
    are told apart by count: identical ones are interchangeable.

    ``keys`` may hold the same rows with only ``by`` and the columns of ``key``, for
    when ``df`` is dear to compute more than once.
    """
    by = list(by)
    keyed = df.withColumn("_key", key)
    narrow = keyed if keys is None else keys.withColumn("_key", key)
    cuts = _cuts(narrow, F.col("_key"), want, by, extra).select(
        *by,
        F.col("value").alias("_cut"),
        (F.col("rank") + 1 - F.col("below")).alias("_take"),
        F.col("ties").alias("_ties"),
    )
    # As a table whose size Spark knows: few cuts are broadcast, and the rows are not dealt out by their groups.
    cuts = stage(cuts, "cuts")
    placed = attach(keyed, cuts, by)
    at_cut = F.col("_key") == F.col("_cut")
    torn = at_cut & (F.col("_take") < F.col("_ties"))
    whole = placed.where(~F.coalesce(torn, F.lit(False))).withColumn(
        flag, F.coalesce(F.col("_key") <= F.col("_cut"), F.lit(False))
    )
    columns = df.columns
    torn_cuts = cuts.where(F.col("_take") < F.col("_ties")).withColumnRenamed("_cut", "_key")
    copies = (
        keyed.join(torn_cuts, by + ["_key"])
        .groupBy(*columns, "_take")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    run = Window.partitionBy(*by).orderBy(*columns)
    before = F.coalesce(
        F.sum("_n").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")
    )
    zero = F.lit(0).cast("bigint")
    taken = F.greatest(zero, F.least(F.col("_n"), F.col("_take") - F.col("_before")))
    sides = F.array(
        F.struct(F.lit(True).alias(flag), taken.alias("_times")),
        F.struct(F.lit(False).alias(flag), (F.col("_n") - taken).alias("_times")),
    )
    told_apart = (
        copies.withColumn("_before", before)
        .select(*columns, F.explode(sides).alias("_side"))
        .select(*columns, "_side.*")
    )
    return whole.select(*columns, flag).unionByName(
        repeat_rows(told_apart, "_times").select(*columns, flag)
    )


def seeded_take(df, key, want, by=(), extra=None, keys=None) -> DataFrame:
    """Only the rows ``seeded_split`` flags."""
    return seeded_split(df, key, want, by, extra, "_chosen", keys).where("_chosen").drop("_chosen")


def dense_index(
    df: DataFrame,
    buckets: Sequence[Column],
    order: Sequence[str],
    by: Sequence[str] = (),
    name: str = "idx",
    size: str | None = None,
) -> DataFrame:
    """Zero-based position in each group by ``order``, without one task per group.

    ``buckets`` (one or two, coarse to fine) must rise with ``order``. A position is
    the rows in earlier buckets plus the row number inside the bucket; both use the
    same hash partitioning, so the rows are shuffled once. ``size`` names an
    optional column with the rows in the group.
    """
    by = list(by)
    names = [f"_b{i}" for i in range(len(buckets))]
    bucketed = df.withColumns(dict(zip(names, buckets)))
    keys = by + names
    counts = bucketed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    if len(names) == 1:
        offsets = counts
        offset = _running(F.sum("_c"), by, names[0])
    else:
        coarse = counts.groupBy(*by, names[0]).agg(F.sum("_c").alias("_cc"))
        coarse = coarse.withColumn("_co", _running(F.sum("_cc"), by, names[0]))
        if size:
            coarse = coarse.withColumn("_all", F.sum("_cc").over(Window.partitionBy(*by)))
        offsets = counts.join(coarse.drop("_cc"), by + names[:1])
        offset = F.col("_co") + _running(F.sum("_c"), by + names[:1], names[1])
    offsets = offsets.withColumn("_offset", offset)
    if size and len(names) == 1:
        offsets = offsets.withColumn("_all", F.sum("_c").over(Window.partitionBy(*by)))
    kept = keys + ["_offset"] + (["_all"] if size else [])
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    numbered = bucketed.withColumn("_rn", inside.cast("bigint")).join(offsets.select(*kept), keys)
    added = {name: F.col("_offset") + F.col("_rn") - 1}
    if size:
        added[size] = F.col("_all")
    return numbered.withColumns(added).select(*df.columns, *added)


def _running(total: Column, by, order) -> Column:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(total.over(w), F.lit(0).cast("bigint"))
