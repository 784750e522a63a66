"""Combine single-label records into multi-label cases without repeats.

Candidates are derived from the pool itself, so their number follows the data.
Only keys and lengths travel until the cases are chosen; texts join last, packed, and go to the longest text of their case.
"""

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from braidset.functions.packing import packed, unpacked
from braidset.functions.tokens import CHARS_PER_TOKEN
from braidset.operators import unrank
from braidset.operators.curate import Counter
from braidset.operators.ranking import dense_index, hash_number, seeded_key, seeded_take
from braidset.plans.staging import stage
from braidset.schemas import CONCERN_COUNTS, LABELS, SEED, TOKEN_LIMIT

# A record drawn more often than this gets its draws spread over several copies.
TRY_CHUNK = 100_000
DRAWS_PER_COPY = 10_000
# Cases are put together in so many partitions that their texts have about as many characters in each.
PART_CHARS = 64 << 20


@dataclass
class Combined:
    cases: DataFrame
    report: DataFrame


@dataclass
class Chosen:
    """Cases by their keys, the report, the split sizes, whether any sha repeats, and the most characters of a text in a case.

    ``room`` is None where tokens are counted.
    """

    cases: DataFrame
    report: DataFrame
    sizes: DataFrame
    repeats: bool
    room: int | None


def pool_of(atomics: DataFrame, count: Counter | None = None) -> DataFrame:
    """One narrow row per record: copies of a sha within a type count once.

    ``n_chars`` is the length of the text, or its tokens where ``count`` counts them.
    """
    text = F.coalesce("diff", F.lit(""))
    return (
        atomics.where(F.col("type").isin(*LABELS))
        .select("split", "type", "sha", (F.length(text) if count is None else count(text)).alias("_n"))
        .groupBy("split", "type", "sha")
        .agg(
            F.min("_n").cast("bigint").alias("n_chars"),
            F.count(F.lit(1)).alias("records"),
        )
    )


def room_of(limit: int, count: Counter | None = None) -> int:
    """The most that the texts of a case within ``limit`` tokens have, in the unit of ``pool_of``."""
    return limit if count is not None else CHARS_PER_TOKEN * limit + CHARS_PER_TOKEN - 1


def _sizes(pool, counts, oversample, target):
    """Per split: records of each type, copies per record, and case target."""
    per_type = pool.groupBy("split", "type").agg(F.count(F.lit(1)).alias("n"))
    sizes = per_type.groupBy("split").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("sizes"),
        F.sum("n").alias("n_pool"),
    )
    goal = F.col("n_pool") if target is None else F.lit(target).cast("bigint")
    tries = F.ceil(goal * oversample / F.col("n_pool")).cast("bigint")
    draws = tries * F.col("n_pool") * sum(k for k in counts if k > 1) / F.size("sizes")
    copies = F.transform_values(
        "sizes", lambda _, n: F.ceil(draws / n / DRAWS_PER_COPY).cast("bigint")
    )
    return sizes.withColumns({"target": goal, "tries": tries, "copies": copies})


def _spread(df, sizes):
    """Repeat the records of rare types so that no single one draws everything."""
    last = F.greatest(F.col("copies")[F.col("type")], F.lit(1)) - 1
    return (
        df.join(sizes.select("split", "copies"), "split")
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .drop("copies")
    )


def _salt(case, type_, copies):
    return F.pmod(F.hash(case), F.greatest(copies[type_], F.lit(1)))


def draw_candidates(pool, sizes, counts: Sequence[int], seed: int) -> DataFrame:
    """``split, k, case, members, home, n_chars``: k records of k distinct types each; ``home`` is the longest one's place.

    ``case`` is a key's bytes: they sort as its text does and are half as long.
    """
    many = [k for k in counts if k > 1]
    # Narrow rows become many candidates: spread them first, over a stated number of
    # partitions, since by their size alone they would be drawn together into few.
    spark = pool.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    seeds = (
        pool.repartition(parts, "type", "sha")
        .join(sizes, "split")
        .withColumn("k", F.explode(F.array(*map(F.lit, many))))
        .where(F.col("k") <= F.size("sizes"))
        # In chunks: no row holds the list of all its tries.
        .withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tries") - 1, F.lit(TRY_CHUNK))))
        .withColumn("try", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + TRY_CHUNK, F.col("tries")) - 1)))
        .drop("_from")
        .withColumn("case", seeded_key(*map(F.col, ("k", "type", "sha", "try")), seed=seed))
    )
    order = F.transform(
        F.map_keys("sizes"),
        lambda t: F.struct(F.md5(F.concat_ws("|", F.col("case"), t)).alias("h"), t.alias("type")),
    )
    draws = F.transform(
        F.slice(F.array_sort(order), F.lit(1), F.col("k")),
        lambda d, i: F.struct(
            i.alias("pos"),
            d["type"].alias("type"),
            F.pmod(hash_number(d["h"]), F.col("sizes")[d["type"]]).alias("idx"),
        ),
    )
    drawn = seeds.select("split", "k", "case", "copies", F.explode(draws).alias("d")).select(
        "split", "k", F.unhex("case").alias("case"), "d.*", _salt(F.col("case"), F.col("d.type"), F.col("copies")).alias("salt")
    )
    keyed = pool.withColumn("_key", seeded_key(F.col("sha"), seed=seed))
    records = dense_index(
        keyed, [F.substring("_key", 1, 4)], ["_key", "sha"], ["split", "type"], "idx"
    ).drop("_key")
    places = F.col("members")
    # One with a sha, since texts are found by it.
    longest = F.array_max(F.transform(places, lambda m: F.struct(m["sha"].isNotNull().alias("named"), m["n_chars"].alias("n"), m["pos"].alias("pos"))))
    return (
        drawn.join(_spread(records, sizes), ["split", "type", "idx", "salt"])
        # Dealt out as they are: few of a case meet earlier, and sums begun for each draw would be wider than the draw.
        .select("split", "k", "case", "pos", "type", "sha", "n_chars")
        .repartition("split", "k", "case")
        .groupBy("split", "k", "case")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "type", "sha", "n_chars"))).alias("members"))
        .select(
            "split",
            "k",
            "case",
            F.transform(places, lambda m: F.struct(m["pos"].alias("pos"), m["type"].alias("type"), m["sha"].alias("sha"))).alias("members"),
            longest["pos"].alias("home"),
            F.aggregate(places, F.lit(0).cast("bigint"), lambda n, m: n + m["n_chars"]).alias("n_chars"),
        )
    )


def choose_cases(
    atomics: DataFrame,
    counts: Sequence[int] = CONCERN_COUNTS,
    limit: int = TOKEN_LIMIT,
    oversample: float = 2,
    target: int | None = None,
    seed: int = SEED,
    count: Counter | None = None,
) -> Chosen:
    """The chosen cases (keys only) and the report of rejections. ``count`` counts a text's tokens.

    Per split and k: cases over the token limit are dropped, each set of shas is
    kept once, then the first ``target`` by seeded order stay (default: as many as
    the split has records). A single-label case is drawn for every record.
    """
    pool = stage(pool_of(atomics, count), "pool")
    repeats = not pool.where("records > 1").isEmpty()
    pool = pool.drop("records")
    # As a table whose size Spark knows: few splits are broadcast, and nothing is dealt out by split.
    sizes = stage(_sizes(pool, counts, oversample, target), "sizes")
    drawn = draw_candidates(pool, sizes, counts, seed)
    if 1 in counts:
        single = pool.select(
            "split",
            F.lit(1).alias("k"),
            F.unhex(seeded_key(F.lit(1), F.col("type"), F.col("sha"), seed=seed)).alias("case"),
            F.array(F.struct(F.lit(0).alias("pos"), "type", "sha")).alias("members"),
            F.lit(0).alias("home"),
            "n_chars",
        )
        drawn = single.unionByName(drawn)
    fits = F.col("n_chars") <= room_of(limit, count)
    by_set = (
        drawn.withColumn("_fits", fits)
        .withColumn("_set", F.when(F.col("_fits"), F.concat_ws(",", F.array_sort(F.col("members.sha")))))
        .groupBy("split", "k", "_set")
        .agg(
            F.min("case").alias("case"),
            F.min_by(F.struct("members", "home", "n_chars"), "case").alias("_first"),
            F.count(F.lit(1)).alias("tries"),
        )
        .select("split", "k", F.col("_set").isNotNull().alias("fits"), F.lower(F.hex("case")).alias("case"), "_first.*", "tries")
    )
    by_set = stage(by_set, "cases")
    distinct = by_set.where("fits").select("split", "k", "case", "members", "home", "n_chars")
    goal = sizes.select("split", "target")
    per_k = distinct.select("split", "k").distinct().join(goal, "split")
    chosen = seeded_take(distinct, F.col("case"), lambda n: F.col("target"), ["split", "k"], per_k)
    wanted = goal.withColumn("k", F.explode(F.array(*map(F.lit, counts))))
    tally = by_set.groupBy("split", "k").agg(
        F.sum("tries").alias("attempts"),
        F.coalesce(F.sum(F.when(~F.col("fits"), F.col("tries"))), F.lit(0).cast("bigint")).alias("token_rejected"),
        F.coalesce(F.sum(F.when(F.col("fits"), F.col("tries") - 1)), F.lit(0).cast("bigint")).alias("duplicate_rejected"),
        F.count_if("fits").alias("distinct_cases"),
    )
    zero = F.lit(0).cast("bigint")
    numbers = ("attempts", "token_rejected", "duplicate_rejected", "distinct_cases")
    report = (
        wanted.join(tally, ["split", "k"], "left")
        .withColumns({c: F.coalesce(c, zero) for c in numbers})
        .select(
            "split",
            F.col("k").alias("concern_count"),
            *numbers,
            "target",
            F.greatest(zero, F.col("target") - F.col("distinct_cases")).alias("shortfall"),
        )
    )
    return Chosen(chosen, report, sizes, repeats, None if count else room_of(limit))


def with_texts(chosen: Chosen, atomics: DataFrame) -> DataFrame:
    """Bring the texts of the chosen members in: messages join with commas, the rest are lists.

    A case is put together where its longest text lies, so that only the others travel, packed. Texts that are
    longer than a case may be stay behind. Only when some sha repeats are its texts brought down to one, the shortest.
    """
    sizes = chosen.sizes.select("split", "copies")
    spark = atomics.sparkSession
    chars = chosen.cases.agg(F.sum("n_chars")).first()[0] or 0
    if chosen.room is None:
        chars *= CHARS_PER_TOKEN
    parts = max(spark.sparkContext.defaultParallelism, -(-chars // PART_CHARS))
    keys = ["split", "type", "sha", "salt"]
    records = atomics.where(F.col("type").isin(*LABELS))
    if chosen.room is not None:
        records = records.where(F.coalesce(F.length("diff"), F.lit(0)) <= chosen.room)
    if chosen.repeats:
        text = F.struct(F.length("diff").alias("n"), "diff", "message")
        records = records.groupBy("split", "type", "sha").agg(F.min(text).alias("_text"))
        records = records.select("split", "type", "sha", "_text.diff", "_text.message")
    texts = records.select("split", "type", "sha", "message", packed(F.coalesce("diff", F.lit(""))).alias("diff"))
    texts = _spread(texts, sizes).repartition(parts, *keys)

    def at(m: Column) -> Column:
        salt = _salt(F.hex("case"), m["type"], F.col("copies"))
        return F.struct(m["type"].alias("type"), m["sha"].alias("sha"), salt.alias("salt"))

    placed = chosen.cases.join(sizes, "split").select(
        "split", "k", F.unhex("case").alias("case"), "members", "home", at(F.get("members", "home")).alias("to"), "copies"
    )
    # The text at home has no row of its own: its place is held by one without a diff.
    holders = placed.select(
        "split", "to.*", "k", "case",
        F.struct(F.col("home").alias("pos"), "to.type", "to.sha", F.lit("").alias("message"), F.lit(None).cast("binary").alias("diff")).alias("m"),
    )
    others = (
        placed.select("split", "k", "case", "to", "copies", F.explode(F.filter("members", lambda m: m["pos"] != F.col("home"))).alias("m"))
        .select("split", at(F.col("m")).alias("from"), "k", "case", "to", "m.pos")
        .select("split", "from.*", "k", "case", "to", "pos")
        .repartition(parts, *keys)
    )
    arrivals = others.join(texts, keys).select(
        "split", "to.*", "k", "case", F.struct("pos", "type", "sha", F.coalesce("message", F.lit("")).alias("message"), "diff").alias("m")
    )
    gathered = (
        holders.unionByName(arrivals)
        .repartition(parts, *keys)
        .groupBy(*keys, "k", "case")
        .agg(F.array_sort(F.collect_list("m")).alias("p"))
        .join(texts.withColumnsRenamed({"message": "_message", "diff": "_diff"}), keys)
    )
    whole = F.transform(
        "p",
        lambda m: F.struct(
            F.when(m["diff"].isNull(), F.col("_message")).otherwise(m["message"]).alias("message"),
            F.coalesce(m["diff"], F.col("_diff")).alias("diff"),
            m["sha"].alias("sha"),
            m["type"].alias("type"),
        ),
    )
    return _stored(gathered.select("split", "k", whole.alias("p")), unpacked(F.col("p.diff")))


def _cases(joined: DataFrame) -> DataFrame:
    """The stored form of cases, from a row per member with its text."""
    part = F.struct("pos", F.col("_text.message").alias("message"), F.col("_text.diff").alias("diff"), "sha", "type")
    cases = joined.groupBy("split", "k", "case").agg(F.array_sort(F.collect_list(part)).alias("p"))
    return _stored(cases, F.transform("p.diff", lambda x: F.coalesce(x, F.lit(""))))


def _stored(cases: DataFrame, diffs: Column) -> DataFrame:
    messages = F.transform("p.message", lambda x: F.coalesce(x, F.lit("")))
    return cases.select(
        "split",
        F.array_join(messages, ",").alias("commit_message"),
        diffs.alias("diff"),
        F.col("k").alias("concern_count"),
        F.col("p.sha").alias("shas"),
        F.col("p.type").alias("types"),
    )


def combine_cases(atomics: DataFrame, **options) -> Combined:
    """Cases with texts, and the report. ``atomics``: split, type, sha, message, diff."""
    chosen = choose_cases(atomics, **options)
    return Combined(with_texts(chosen, atomics), chosen.report)


def _goals(pool: DataFrame, target: int | dict[str, int]) -> DataFrame:
    """``split, target``: one target for all splits of the pool, or one for each named split."""
    wanted = F.lit(target) if isinstance(target, int) else F.lit(0)
    for split, n in target.items() if isinstance(target, dict) else ():
        wanted = F.when(F.col("split") == split, n).otherwise(wanted)
    return pool.select("split").distinct().withColumn("target", wanted.cast("bigint"))


def _new_sets(found: DataFrame, lots: Sequence[DataFrame]) -> DataFrame:
    """One row per set of ``found`` and its tries; ``members`` is NULL where the set is over the limit or in an earlier lot.

    A number comes up once, but the same shas may stand under other types.
    """
    sets = found.groupBy("split", "k", "_set").agg(F.min("members").alias("members"), F.count(F.lit(1)).alias("tries"))
    for lot in lots:
        met = lot.where("_set IS NOT NULL").select("split", "k", "_set", F.lit(True).alias("_met"))
        sets = sets.join(met, ["split", "k", "_set"], "left")
        sets = sets.withColumn("members", F.when(F.col("_met").isNull(), F.col("members"))).drop("_met")
    return stage(sets, "drawn")


def draw_to_target(
    pool: DataFrame, goal: DataFrame, counts: Sequence[int], room: int, oversample: float, seed: int
) -> tuple[DataFrame, DataFrame]:
    """All sets drawn (``split, k, _set, members, tries``), and ``split, k, exhausted``.

    Each round doubles the draws of the splits and counts that lack cases. One ends when its target
    is met or its numbers are used up.
    """
    plan = unrank.numbered(pool, counts, room, seed)
    one = F.array(F.struct(F.lit(0).alias("pos"), "type", "sha"))
    fits = F.col("n_chars") <= room
    single = pool.select("split", F.lit(1).alias("k"), F.when(fits, F.col("sha")).alias("_set"), F.when(fits, one).alias("members"))
    lots = [_new_sets(single.where(F.lit(1 in counts)), [])]
    every = goal.select("split", F.explode(F.array(*map(F.lit, counts))).alias("k"), "target")
    left = plan.combos.withColumn("since", F.lit(0).cast("bigint"))
    unmet = [every.select("split", "k").limit(0)]
    while not left.isEmpty():
        part = stage(unrank.reach(left, goal, oversample * 2 ** (len(unmet) - 1)), "reach")
        lots.append(_new_sets(unrank.drawn_sets(plan.records, part, room, seed), lots))
        have = reduce(DataFrame.unionByName, lots).where("members IS NOT NULL").groupBy("split", "k").agg(F.count(F.lit(1)).alias("have"))
        short = every.join(have, ["split", "k"], "left").where(F.coalesce("have", F.lit(0)) < F.col("target")).select("split", "k")
        unused = part.where("until < sets").select("split", "k").distinct()
        unmet.append(unused.join(short, ["split", "k"], "left_anti"))
        left = part.join(short.join(unused, ["split", "k"]), ["split", "k"]).withColumn("since", F.col("until")).drop("until")
    # Not exhausted are those that met their target with numbers left.
    stopped = reduce(DataFrame.unionByName, unmet).withColumn("_open", F.lit(True))
    done = every.join(stopped, ["split", "k"], "left").select("split", "k", F.col("_open").isNull().alias("exhausted"))
    return reduce(DataFrame.unionByName, lots), done


def with_few_texts(cases: DataFrame, atomics: DataFrame, repeats: bool) -> DataFrame:
    """``with_texts`` for cases of few records: texts that are in no case go first, and copies follow a record's uses."""
    keys = ["split", "type", "sha"]
    members = cases.select("split", "k", "case", F.explode("members").alias("m")).select("split", "k", "case", "m.*")
    copies = F.ceil(F.count(F.lit(1)) / DRAWS_PER_COPY).cast("int").alias("copies")
    uses = stage(members.groupBy(*keys).agg(copies), "uses")
    text = F.struct(F.length("diff").alias("n"), "diff", "message").alias("_text")
    texts = atomics.where(F.col("type").isin(*LABELS)).select(*keys, text).join(uses, keys)
    if repeats:
        texts = texts.groupBy(*keys, "copies").agg(F.min("_text").alias("_text"))
    spread = texts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    salted = members.join(uses, keys).withColumn("salt", F.pmod(F.hash("case"), F.col("copies"))).drop("copies")
    return _cases(salted.join(spread, [*keys, "salt"]))


def combine_to_target(
    atomics: DataFrame,
    target: int | dict[str, int],
    counts: Sequence[int] = CONCERN_COUNTS,
    limit: int = TOKEN_LIMIT,
    oversample: float = 2,
    seed: int = SEED,
    count: Counter | None = None,
) -> Combined:
    """``target`` cases for every split and count, or all there are.

    Sets are drawn by number, without replacement (``unrank``), until a count has its cases or no set is
    left; there is no limit of rounds. Of more cases than the target the first by seeded order stay. The report
    has ``exhausted``: no other set exists. ``atomics`` as in ``combine_cases``; copies of a sha
    within a type count once, and sets of the same shas are one case.
    """
    pool = stage(pool_of(atomics, count), "pool")
    repeats = not pool.where("records > 1").isEmpty()
    pool = pool.drop("records")
    goal = _goals(pool, target)
    sets, done = draw_to_target(pool, goal, counts, room_of(limit, count), oversample, seed)
    kept = sets.where("members IS NOT NULL").withColumn("case", seeded_key(F.col("k"), F.col("_set"), seed=seed)).drop("_set", "tries")
    wanted = goal.withColumn("k", F.explode(F.array(*map(F.lit, counts))))
    chosen = seeded_take(kept, F.col("case"), lambda n: F.col("target"), ["split", "k"], wanted)
    tally = sets.groupBy("split", "k").agg(
        F.sum("tries").alias("attempts"),
        F.sum(F.when(F.col("_set").isNull(), F.col("tries")).otherwise(0)).alias("token_rejected"),
        F.count("members").alias("distinct_cases"),
    )
    zero = F.lit(0).cast("bigint")
    report = wanted.join(tally, ["split", "k"], "left").join(done, ["split", "k"])
    report = report.withColumns({c: F.coalesce(c, zero) for c in ("attempts", "token_rejected", "distinct_cases")})
    report = report.select(
        "split",
        F.col("k").alias("concern_count"),
        "attempts",
        "token_rejected",
        (F.col("attempts") - F.col("token_rejected") - F.col("distinct_cases")).alias("duplicate_rejected"),
        "distinct_cases",
        "target",
        F.greatest(zero, F.col("target") - F.col("distinct_cases")).alias("shortfall"),
        "exhausted",
    )
    return Combined(with_few_texts(stage(chosen, "chosen"), atomics, repeats), report)


def as_text_columns(cases: DataFrame) -> DataFrame:
    """Lists as JSON text: the stored form of a combined dataset."""
    return cases.withColumns({c: F.to_json(c) for c in ("diff", "shas", "types")})
