"""Sets of records by number: drawing without replacement, to a target or to the end.

All sets of k records of k distinct types are numbered: a combination of types, then a number in the
mixed radix of their sizes. Each combination visits its numbers in the order of a seeded permutation, so a
number comes up once and no set is drawn again; when the last number is used, no set is left.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from braidset.operators.ranking import dense_index, hash_number, seeded_key
from braidset.plans.staging import stage

# Numbers of a combination beyond this are never reached.
MOST = 10**18
# Rounds over all digits of the permutation.
MIXES = 2
TRY_CHUNK = 100_000
# A record drawn more often than this gets its draws spread over several copies.
DRAWS_PER_COPY = 10_000


@dataclass
class Numbered:
    """``records``: split, k, type, idx, sha, n_chars. ``combos``: split, k, combo, types, radix, sets."""

    records: DataFrame
    combos: DataFrame


def numbered(pool: DataFrame, counts: Sequence[int], room: int, seed: int) -> Numbered:
    """Records and combinations that some set of at most ``room`` (the sum of ``n_chars``) can hold.

    A record stays if it fits beside the shortest records of the k - 1 shortest other types; a
    combination if the shortest records of its types fit. What goes is in no set that fits.
    """
    least = pool.groupBy("split", "type").agg(F.min("n_chars").alias("least"))
    # A row per split, with an entry per label.
    shortest = least.groupBy("split").agg(F.map_from_entries(F.collect_list(F.struct("type", "least"))).alias("_least"))
    others = F.array_sort(F.map_values(F.map_filter("_least", lambda t, _: t != F.col("type"))))
    beside = F.aggregate(F.slice(others, F.lit(1), F.col("k") - 1), F.col("n_chars"), lambda a, b: a + b)
    fitting = (
        pool.join(shortest, "split")
        .withColumn("k", F.explode(F.array(*[F.lit(k) for k in counts if k > 1])))
        .where((F.size("_least") >= F.col("k")) & (beside <= room))
        .withColumn("_key", seeded_key(F.col("sha"), seed=seed))
        .select("split", "k", "type", "sha", "n_chars", "_key")
    )
    records = dense_index(fitting, [F.substring("_key", 1, 4)], ["_key", "sha"], ["split", "k", "type"], "idx")
    records = stage(records.drop("_key"), "numbered")
    per_type = records.groupBy("split", "k", "type").agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("least"))
    kinds = per_type.groupBy("split", "k").agg(F.array_sort(F.collect_list(F.struct("type", "n", "least"))).alias("_t"))
    bit = lambda i: F.getbit("combo", i)
    chosen = (
        kinds.withColumn("combo", F.explode(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("_t")) - 1)))
        .where(F.bit_count("combo") == F.col("k"))
        .withColumn("_t", F.filter("_t", lambda _, i: bit(i) == 1))
        .where(F.aggregate(F.col("_t.least"), F.lit(0).cast("bigint"), lambda a, b: a + b) <= room)
    )
    product = F.aggregate(F.col("_t.n"), F.lit(1.0), lambda a, b: a * b)
    combos = chosen.select(
        "split", "k", "combo", F.col("_t.type").alias("types"), F.col("_t.n").alias("radix"), F.least(product, F.lit(float(MOST))).cast("bigint").alias("sets")
    )
    return Numbered(records, stage(combos, "combos"))


def reach(combos: DataFrame, goal: DataFrame, draws: float) -> DataFrame:
    """``combos`` with ``until``: numbers visited once ``draws`` times the target are shared out by the combinations' sizes."""
    # Ten combinations of very many sets are more than a bigint holds.
    whole = combos.groupBy("split", "k").agg(F.sum(F.col("sets").cast("decimal(19,0)")).cast("double").alias("_all"))
    share = F.ceil(F.col("target") * F.lit(float(draws)) / F.col("_all") * F.col("sets")).cast("bigint")
    return combos.join(whole, ["split", "k"]).join(goal, "split").withColumn("until", F.least(share, F.col("sets"))).drop("_all", "target")


def _digits(number: str, radix: str) -> Column:
    """``number`` in the mixed radix, lowest digit first."""
    return F.expr(
        f"""aggregate({radix}, named_struct('rest', {number}, 'digits', CAST(array() AS ARRAY<BIGINT>)),
        (acc, n) -> named_struct('rest', acc.rest div n, 'digits', array_append(acc.digits, acc.rest % n)), acc -> acc.digits)"""
    )


def permuted(digits: Column, radix: Column, tag: Sequence[Column], seed: int) -> Column:
    """A seeded permutation of the numbers of ``radix``, digit by digit.

    A digit moves by a hash of the others, modulo its radix. Each such step can be undone, so that
    all of them together are one to one.
    """
    k = F.size(radix)

    def move(acc, step):
        at = step % k

        def one(d, i):
            rest = F.array_join(F.filter(acc, lambda _, j: j != i).cast("array<string>"), ",")
            by = hash_number(F.md5(F.concat_ws("|", F.lit(str(seed)), *tag, step.cast("string"), rest)))
            return F.when(i == at, (d + by) % F.get(radix, i)).otherwise(d)

        return F.transform(acc, one)

    return F.aggregate(F.sequence(F.lit(0), k * MIXES - 1), digits, move)


def visits(combos: DataFrame, seed: int) -> DataFrame:
    """``split, k, combo, number, pos, type, idx`` for the numbers from ``since`` to ``until`` of each combination."""
    spark = combos.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = (
        combos.where("since < until")
        # In chunks: no row holds the list of all its numbers.
        .withColumn("_from", F.explode(F.sequence("since", F.col("until") - 1, F.lit(TRY_CHUNK))))
        .repartition(parts, "split", "k", "combo", "_from")
        .withColumn("number", F.explode(F.sequence("_from", F.least(F.col("_from") + TRY_CHUNK, F.col("until")) - 1)))
    )
    tag = [F.col("split"), F.col("k").cast("string"), F.array_join("types", ",")]
    rows = rows.withColumn("_d", permuted(_digits("number", "radix"), F.col("radix"), tag, seed))
    member = F.transform("types", lambda t, i: F.struct(i.alias("pos"), t.alias("type"), F.get(F.col("_d"), i).alias("idx")))
    return rows.select("split", "k", "combo", "number", F.explode(member).alias("m")).select("split", "k", "combo", "number", "m.*")


def drawn_sets(records: DataFrame, combos: DataFrame, room: int, seed: int) -> DataFrame:
    """Each number's case: ``split, k, _set`` (its shas; NULL where it has no room), ``members``."""
    draws = combos.select("split", "k", F.explode("types").alias("type"), (F.col("until") - F.col("since")).alias("n"))
    sizes = records.groupBy("split", "k", "type").agg(F.count(F.lit(1)).alias("size"))
    often = draws.groupBy("split", "k", "type").agg(F.sum("n").alias("n")).join(sizes, ["split", "k", "type"])
    copies = often.select("split", "k", "type", F.ceil(F.col("n") / F.col("size") / DRAWS_PER_COPY).cast("int").alias("copies"))
    members = visits(combos, seed)
    on = ["split", "k", "type", "idx"]
    # One number decides whether any record needs copies.
    if (copies.agg(F.max("copies")).first()[0] or 1) > 1:
        some = F.greatest(F.col("copies"), F.lit(1))
        salted = records.join(copies, on[:3]).withColumn("salt", F.explode(F.sequence(F.lit(0), some - 1))).drop("copies")
        spread = members.join(copies, on[:3]).withColumn("salt", F.pmod(F.hash("combo", "number"), some)).drop("copies")
        joined = spread.join(salted, [*on, "salt"])
    else:
        joined = members.join(records, on)
    cases = joined.groupBy("split", "k", "combo", "number").agg(
        F.array_sort(F.collect_list(F.struct("pos", "type", "sha"))).alias("members"), F.sum("n_chars").alias("n_chars")
    )
    fits = F.col("n_chars") <= room
    shas = F.concat_ws(",", F.array_sort(F.col("members.sha")))
    return cases.select("split", "k", F.when(fits, shas).alias("_set"), F.when(fits, F.col("members")).alias("members"))
