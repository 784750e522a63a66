"""The registered queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidset.llm import ann, audit, decontaminate, divergence, mixing, packing, perplexity, pii, quality, repeats, simhash, tokenfiles, toxicity
from braidset.llm.common import shared_path, table


def op1_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "op2-tokens")
    tokenfiles.write_tokens(table(spark, sf_dir, "documents"), path)
    return tokenfiles.digests(tokenfiles.read_tokens(spark, path))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.train(docs))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.measured(table(spark, sf_dir, "documents"))
    model = quality.train(rows, table(spark, sf_dir, "labels"), ~quality.held_out(F.col("doc_id")))
    return quality.score(rows, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_perplexity": op1_perplexity,
    "op2_token_files": op2_token_files,
    "op3_toxicity": op3_toxicity,
    "op4_nearest": op4_nearest,
    "op5_packing": op5_packing,
    "op6_pii": op6_pii,
    "op7_repeats": op7_repeats,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_mixing": op10_mixing,
    "op11_decontamination": op11_decontamination,
    "op12_filter_audit": op12_filter_audit,
    "op13_divergence": op13_divergence,
}

def _sainte_lague(name: str, rows: str, by: str, party: str, weight: str) -> str:
    """SQL tables: every quotient that could win, and the seats won."""
    group = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, {party}" if by else party
    return f"""{name}_a AS (
    SELECT *, sum({weight}) OVER ({group})::DOUBLE AS all_votes, count(*) OVER ({group}) AS parties FROM {rows}
), {name}_b AS (
    SELECT *, unnest(range(0, CASE WHEN all_votes > 0 THEN ceil({weight} * (seats + parties / 2) / all_votes)::BIGINT + 1 ELSE 0 END)) AS k FROM {name}_a
), {name}_c AS (
    SELECT *, row_number() OVER ({group} ORDER BY {weight}::DOUBLE / (2 * k + 1) DESC, {party} NULLS LAST, k) AS place FROM {name}_b WHERE {weight} > 0
), {name} AS (
    SELECT {keys}, count(*) AS won FROM {name}_c WHERE place <= seats GROUP BY {keys}
)"""


SQL: dict[str, str] = {
    "op10_mixing": rf"""WITH s AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS h
    FROM documents
), p AS (
    SELECT source, count(*) AS docs, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s GROUP BY source
), w AS (
    SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM p
), l AS (
    SELECT *, (sum(source_size) OVER ()::DOUBLE * 3 / 2 - coalesce(sum(cap) OVER b, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
    FROM w WINDOW b AS (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
    SELECT *, (SELECT level FROM l WHERE cap / weight >= level ORDER BY cap / weight, n LIMIT 1) AS common FROM l
), t AS (
    SELECT source, docs, source_size, CASE WHEN common IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, common * weight) END AS target,
        ((sum(source_size) OVER () * 6 + 16) // 32)::BIGINT AS seats, ceil(docs / 2048)::BIGINT AS shards
    FROM f
), {_sainte_lague("sources", "t", "", "source", "target")}, d AS (
    SELECT s.*, t.source_size, t.target, coalesce(o.won, 0) AS seats, ('0x' || substr(h, 1, 8))::BIGINT % t.shards AS shard
    FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN sources o ON t.source IS NOT DISTINCT FROM o.source
), q AS (
    SELECT source, shard, sum(size)::BIGINT AS words, any_value(seats) AS seats FROM d GROUP BY source, shard
), {_sainte_lague("quotas", "q", "source", "shard", "words")}, r AS (
    SELECT d.*, words, least(coalesce(u.won, 0) * 8, words * 2)::BIGINT AS budget,
        coalesce(sum(size) OVER (PARTITION BY d.source, d.shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source AND d.shard = q.shard
    LEFT JOIN quotas u ON d.source IS NOT DISTINCT FROM u.source AND d.shard = u.shard
)
SELECT doc_id, source, size, source_size, target,
    (CASE WHEN words > 0 THEN budget // words ELSE 0 END * size
        + least(greatest(budget - CASE WHEN words > 0 THEN budget // words ELSE 0 END * words - before, 0), size))::BIGINT AS taken
FROM r""",
    "op11_decontamination": r"""WITH d AS (
    SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), s AS (
    SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS pos FROM b WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item_id, n, array_to_string(w[pos:(pos + n - 1)], ' ') AS words FROM s
), sizes AS (
    SELECT DISTINCT n FROM windows
), places AS (
    SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, sizes WHERE len(w) >= n
), found AS (
    SELECT DISTINCT p.uid, p.n, p.pos, x.item_id FROM (SELECT uid, n, pos, array_to_string(w[pos:(pos + n - 1)], ' ') AS words FROM places) p JOIN windows x USING (n, words)
), hit AS (
    SELECT uid, count(*) AS n_hit FROM (SELECT DISTINCT uid, unnest(range(pos, pos + n)) AS place FROM (SELECT DISTINCT uid, n, pos FROM found)) GROUP BY uid
), items AS (
    SELECT uid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS list FROM (SELECT DISTINCT uid, item_id FROM found) GROUP BY uid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (uid) LEFT JOIN items USING (uid)""",
    "op12_filter_audit": r"""WITH w AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), m AS (
    SELECT t, min(doc_id) AS first FROM w GROUP BY t
), f AS (
    SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
        + 4 * (100 * len(regexp_extract_all(w.t, '[A-Z]')) > 2 * length(w.t))::INT + 8 * regexp_matches(w.t, '[#$%&*|]')::INT
        + 16 * coalesce(doc_id > first, FALSE)::INT AS mask
    FROM w JOIN m ON w.t = m.t
), l AS (
    SELECT doc_id, coalesce(bool_or(quality = 1), FALSE)::INT AS quality, coalesce(bool_or(toxic = 1), FALSE)::INT AS toxic FROM labels GROUP BY doc_id
), c AS (
    SELECT part, mask, count(*) AS n, coalesce(sum(quality), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask
), x AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), o AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), s AS (
    SELECT o, step, 1 << (position(substr(o, step, 1) IN 'ABCDE') - 1) AS bit,
        coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (position(substr(o, k, 1) IN 'ABCDE') - 1))), 0)::INT AS before
    FROM o, (SELECT unnest(range(1, 6))::INT AS step)
)
SELECT part, o AS filter_order, step,
    coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
    sum(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM c, s GROUP BY part, o, step, bit""",
    "op13_divergence": r"""WITH d AS (
    SELECT row_number() OVER () AS uid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
), t AS (
    SELECT uid, lang, source, unnest(w) AS term FROM d
), kept AS (
    SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT uid) >= 3
), n AS (
    SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term
), groups AS (
    SELECT DISTINCT lang, source FROM d
), v AS (
    SELECT lang, count(*) AS v, sum(total) AS total FROM kept GROUP BY lang
), p AS (
    SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
        1 + 1000000000::HUGEINT * (coalesce(n.n, 0) + 1) // (sum(coalesce(n.n, 0)) OVER (PARTITION BY g.lang, g.source) + v.v)::HUGEINT AS p,
        1 + 1000000000::HUGEINT * (k.total + 1) // (v.total + v.v)::HUGEINT AS q
    FROM groups g JOIN kept k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
    SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
QUALIFY part = 'pair' OR rank <= 200""",
}
