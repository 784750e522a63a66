"""The registered queries as plain SQL over the same tables, written independently."""

from braidset.plans.registry import CASE_LIMIT, CASE_TARGET, RECORD_LIMIT, REQUEST, SAMPLE, SYSTEM, T_95, TOP_UP

SQL: dict[str, str] = {}

L = "['docs','test','ci','build','refactor','feat','fix']"
CTX = "[1024,2048,4096,8192,12288]"
AB = "['ci','bu','do','te','fe','fi','re','st']"
FULL = "['cicd','build','docs','test','feat','fix','refactor','style']"


def label(n: str) -> str:
    return f"{L}[(({n}) % 7)::INT + 1]"


def key(*parts: str) -> str:
    return f"md5(concat_ws('|', '42', {', '.join(f'({p})::VARCHAR' for p in parts)}))"


def r6(*cols: str) -> str:
    """``expr AS name`` or a bare column, rounded."""
    out = []
    for c in cols:
        expr, name = c.rsplit(" AS ", 1) if " AS " in c else (c, c)
        out.append(f"round(({expr})::DOUBLE, 6) AS {name}")
    return ", ".join(out)


MESSAGE = "concat_ws(' ', source, lang, doc_id::VARCHAR)"

ATOMIC = f"""
atomic AS (
  SELECT md5(doc_id::VARCHAR) AS sha,
         CASE WHEN doc_id % 5 = 0 THEN ' ' || chr(9) || upper({label('doc_id')}) || ' ' || chr(10)
              ELSE {label('doc_id')} END AS raw_type,
         {label('doc_id')} AS annotated_type,
         {MESSAGE} AS masked_commit_message, text AS git_diff
  FROM documents),
excluded AS (SELECT md5(doc_id::VARCHAR) AS sha FROM labels WHERE toxic = 1),
existing AS (SELECT md5(doc_id::VARCHAR) AS sha, {label('doc_id')} AS annotated_type FROM labels WHERE quality = 0),
have AS (SELECT annotated_type, count(*) AS have FROM existing GROUP BY 1)"""

RECORDS = f"""
records AS (
  SELECT {MESSAGE} AS message, text AS diff, md5(doc_id::VARCHAR) AS sha, {label('doc_id')} AS type FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY type ORDER BY {key('sha')}, sha) AS rn, count(*) OVER (PARTITION BY type) AS n
  FROM records),
splits AS (
  SELECT message, diff, sha, type, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM ranked)"""

TANGLED = f"""
sized AS (
  SELECT *, (doc_id % 5 + 1)::INT AS c, greatest(ceil(length(text) / (doc_id % 5 + 1)), 1)::INT AS w FROM documents),
tangled AS (
  SELECT doc_id, text, {MESSAGE} AS commit_message, c AS concern_count,
         list_transform(range(c), lambda i: substr(text, (i * w + 1)::BIGINT, w)) AS diff,
         list_transform(range(c), lambda i: {L}[((doc_id + i) % 7)::INT + 1]) AS types,
         length(text) // 4 AS token_length
  FROM sized)"""


def results(predicted_by: str = "l_partkey", name: str = "results") -> str:
    return f"""
{name}_sets AS (
  SELECT l_orderkey, list_sort(list(DISTINCT {label('l_linenumber')})) AS actual,
         list_sort(list(DISTINCT {label(predicted_by)})) AS guess
  FROM lineitem GROUP BY l_orderkey),
{name} AS (
  SELECT o_orderkey AS row_id,
         CASE WHEN o_orderkey % 50 = 0 THEN []::VARCHAR[]
              WHEN o_orderkey % 53 = 0 THEN list_sort(list_append(guess, 'junk')) ELSE guess END AS predicted,
         actual, o_totalprice / 977.0::DOUBLE AS inference_time, {CTX}[(o_orderkey % 5)::INT + 1] AS context_len,
         o_orderkey % 2 = 0 AS with_message
  FROM {name}_sets JOIN orders ON l_orderkey = o_orderkey)"""


def scoring(source: str, name: str) -> str:
    return f"""
{name}_counts AS (
  SELECT *, len(list_filter({L}, lambda x: list_contains(predicted, x) AND list_contains(actual, x))) AS tp,
         len(list_filter({L}, lambda x: list_contains(predicted, x) AND NOT list_contains(actual, x))) AS fp,
         len(list_filter({L}, lambda x: NOT list_contains(predicted, x) AND list_contains(actual, x))) AS fn
  FROM {source}),
{name}_pr AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall
  FROM {name}_counts),
{name} AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
         (fp + fn) / 7 AS hamming_loss, list_sort(predicted) = list_sort(actual) AS exact_match,
         len(actual)::INT AS concern_count
  FROM {name}_pr)"""


RESULTS = results()
SCORED = results() + "," + scoring("results", "scored")
OTHER = results("l_suppkey", "results2") + "," + scoring("results2", "scored2")

MACRO = r6(
    "avg(precision) AS macro_precision",
    "avg(recall) AS macro_recall",
    "avg(f1) AS macro_f1",
    "avg(exact_match::INT) AS macro_accuracy",
    "avg(hamming_loss) AS macro_hamming_loss",
    "avg(inference_time) AS inference_time_avg",
) + ", count(*) AS num_samples"


def add(name: str, with_: str, select: str) -> None:
    SQL[name] = f"WITH {with_.strip()}\n{select.strip()}"


def text(col: str, name: str | None = None) -> str:
    return f"array_to_string({col}, ',') AS {name or col}"


# --- scoring and macro metrics

add("score_cases", SCORED, f"""
SELECT row_id, {text('predicted', 'predicted_types')}, {text('actual', 'actual_types')}, context_len, with_message,
       tp::INT AS tp, fp::INT AS fp, fn::INT AS fn, {r6('precision', 'recall', 'f1', 'hamming_loss')}, exact_match, concern_count
FROM scored""")
add("macro_metrics", SCORED, f"SELECT {MACRO} FROM scored")
add("macro_by_concern", SCORED, f"SELECT concern_count, {MACRO} FROM scored GROUP BY 1")
add("macro_by_setting", SCORED, f"SELECT context_len, with_message, {MACRO} FROM scored GROUP BY 1, 2")
RUN_ID = "|| '_' || context_len || CASE WHEN with_message THEN '_yes_' ELSE '_no_' END || '20240101' AS experiment_id"
WHOLE = """,
whole AS (
  SELECT experiment_id, count(*) AS num_samples, count(*) FILTER (len(predicted) > 0) AS num_scored,
         count(*) FILTER (len(predicted) = 0) AS outlier_count,
         avg(f1) FILTER (len(predicted) > 0) AS macro_f1, avg(exact_match::INT) FILTER (len(predicted) > 0) AS macro_accuracy
  FROM runs GROUP BY 1)"""
RUNS = SCORED + f""",
runs AS (SELECT 'alpha' {RUN_ID}, * FROM scored)""" + WHOLE
SUMMARY = f"""
SELECT experiment_id, any_value(num_samples) AS num_samples, any_value(num_scored) AS num_scored,
       any_value(outlier_count) AS outlier_count, {r6('any_value(macro_f1) AS macro_f1', 'any_value(macro_accuracy) AS macro_accuracy')},
       concern_count, count(*) AS concern_samples, {r6('avg(f1) AS concern_f1', 'avg(inference_time) AS concern_time')}
FROM runs JOIN whole USING (experiment_id) WHERE len(predicted) > 0 GROUP BY experiment_id, concern_count"""
add("run_summary", RUNS, SUMMARY)
add("write_summary", RUNS, f"SELECT experiment_id, num_samples, {r6('macro_f1 AS f1')} FROM whole")
add("drop_empty_predictions", RESULTS, f"SELECT row_id, {text('predicted', 'predicted_types')} FROM results WHERE len(predicted) > 0")
add("empty_predictions", RESULTS, "SELECT row_id FROM results WHERE len(predicted) = 0")
VIEW = SCORED + """,
shown AS (
  SELECT row_number() OVER (ORDER BY row_id) AS Test_Index,
         CASE WHEN len(predicted) = 0 THEN 'None' ELSE array_to_string(predicted, ', ') END AS Predicted_Types,
         CASE WHEN len(actual) = 0 THEN 'None' ELSE array_to_string(actual, ', ') END AS Actual_Types,
         CASE WHEN exact_match THEN 'Match' ELSE 'No Match' END AS Status,
         precision AS Case_Precision, recall AS Case_Recall, f1 AS Case_F1,
         array_to_string(list_transform(actual, lambda t: md5(row_id || '|' || t)), ', ') AS SHAs
  FROM scored)"""
add("evaluation_view", VIEW, f"SELECT Test_Index, Predicted_Types, Actual_Types, Status, SHAs, {r6('Case_Precision', 'Case_Recall', 'Case_F1')} FROM shown")
add("export_evaluation", VIEW, "SELECT Test_Index, Predicted_Types, Actual_Types, Status, SHAs FROM shown")
add("evaluation_metrics", VIEW, f"SELECT count(*) AS total, {r6('avg(Case_Precision) AS type_precision', 'avg(Case_Recall) AS type_recall', 'avg(Case_F1) AS type_f1_macro')} FROM shown")
add("recent_cases", VIEW, "SELECT Test_Index, Predicted_Types, Actual_Types, Status, SHAs FROM shown ORDER BY Test_Index DESC LIMIT 15")

# --- outliers and distributions

Q = "quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3"
FENCES = RESULTS + f""",
q AS (SELECT {Q.format(x='inference_time')} FROM results),
near AS (SELECT q1 - 0.4 * (q3 - q1) AS lo, q3 + 0.4 * (q3 - q1) AS hi FROM q),
flagged AS (SELECT *, inference_time < (SELECT lo FROM near) OR inference_time > (SELECT hi FROM near) AS is_out FROM results)"""
LIMITS = r6("q1", "q3", "q1 - 1.5 * (q3 - q1) AS low", "q3 + 1.5 * (q3 - q1) AS high")
add("iqr_fences", FENCES, f"SELECT {LIMITS} FROM q")
add("iqr_fences_by_context", RESULTS + f""",
q AS (SELECT context_len, {Q.format(x='inference_time')} FROM results GROUP BY 1)""", f"SELECT context_len, {LIMITS} FROM q")
add("iqr_filter", FENCES, f"SELECT row_id, context_len, {r6('inference_time')} FROM flagged WHERE NOT is_out")
add("outlier_rows", FENCES, f"SELECT row_id, {r6('inference_time')} FROM flagged WHERE is_out")
add("outlier_report", FENCES, f"""
SELECT count(*) AS n_before, count(*) FILTER (is_out) AS outlier_count, count(*) FILTER (is_out) > 0 AS removed,
       {r6('min(inference_time) FILTER (is_out) AS outlier_min', 'max(inference_time) FILTER (is_out) AS outlier_max')},
       round_even(count(*) FILTER (is_out) * 100.0 / count(*), 1)::DOUBLE AS outlier_percent
FROM flagged""")
for by, name in (("context_len", "context"), ("concern_count", "concern"), ("with_message", "message")):
    add(f"box_by_{name}", SCORED + f""",
q AS (SELECT {by}, count(*) AS n, {Q.format(x='inference_time')}, quantile_cont(inference_time, 0.5) AS median FROM scored GROUP BY 1),
placed AS (
  SELECT s.{by}, inference_time AS x, inference_time BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM scored s JOIN q ON s.{by} = q.{by}),
ends AS (SELECT {by}, min(x) FILTER (inside) AS whisker_low, max(x) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS fliers FROM placed GROUP BY 1)""",
        f"SELECT q.{by}, n, {r6('q1', 'median', 'q3', 'whisker_low', 'whisker_high')}, fliers FROM q JOIN ends ON q.{by} = ends.{by}")
SIX = ("context_len", "concern_count", "precision", "recall", "f1", "inference_time")
STATS = (
    ("count", "count({c})"), ("mean", "avg({c})"), ("std", "stddev_samp({c})"), ("min", "min({c})"),
    ("25%", "quantile_cont({c}::DOUBLE, 0.25)"), ("50%", "quantile_cont({c}::DOUBLE, 0.5)"),
    ("75%", "quantile_cont({c}::DOUBLE, 0.75)"), ("max", "max({c})"),
)
add("describe", SCORED, " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{s}' AS statistic, {r6(e.format(c=c) + ' AS value')} FROM scored""" for c in SIX for s, e in STATS))
add("descriptives", SCORED, " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {r6(f'avg({c}) AS mean', f'stddev_samp({c}) AS std', f'min({c}) AS min', f'max({c}) AS max')} FROM scored"""
    for c in ("context_len", "inference_time", "concern_count")))

add("box_many_groups", f"""
q AS (SELECT l_partkey, count(*) AS n, {Q.format(x='l_extendedprice')}, quantile_cont(l_extendedprice, 0.5) AS median FROM lineitem GROUP BY 1),
placed AS (
  SELECT s.l_partkey, l_extendedprice AS x, l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM lineitem s JOIN q ON s.l_partkey = q.l_partkey),
ends AS (SELECT l_partkey, min(x) FILTER (inside) AS whisker_low, max(x) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS fliers FROM placed GROUP BY 1)""",
    f"SELECT q.l_partkey, n, {r6('q1', 'median', 'q3', 'whisker_low', 'whisker_high')}, fliers FROM q JOIN ends ON q.l_partkey = ends.l_partkey")
add("iqr_with_nan", RESULTS + f""",
known AS (SELECT row_id, CASE WHEN row_id % 10 <> 0 AND row_id % 11 <> 0 THEN inference_time END AS x FROM results),
q AS (SELECT {Q.format(x='x')} FROM known)""", "SELECT row_id, coalesce(x < q1 - 0.4 * (q3 - q1) OR x > q3 + 0.4 * (q3 - q1), false) AS is_outlier FROM known CROSS JOIN q")
add("evaluation_view_by_sha", VIEW.replace("ORDER BY row_id", "ORDER BY md5(row_id::VARCHAR)"), f"SELECT Test_Index, Predicted_Types, Actual_Types, Status, SHAs, {r6('Case_Precision', 'Case_Recall', 'Case_F1')} FROM shown")

# --- curation

TOKENS = "length(coalesce(git_diff, '') || ' ' || coalesce(masked_commit_message, '')) // 4"
add("normalize_type", ATOMIC, "SELECT sha, annotated_type FROM atomic")
add("exclude_by_sha", ATOMIC, "SELECT sha, masked_commit_message FROM atomic WHERE sha NOT IN (SELECT sha FROM excluded)")
add("exclude_existing", ATOMIC, "SELECT sha, masked_commit_message FROM atomic WHERE sha NOT IN (SELECT sha FROM existing)")
add("within_token_limit", ATOMIC, f"SELECT sha, length(git_diff)::INT AS n_chars FROM atomic WHERE {TOKENS} <= {RECORD_LIMIT}")
add("valid_types", ATOMIC, f"SELECT sha, raw_type AS annotated_type FROM atomic WHERE list_contains({L}, raw_type)")
add("type_counts", ATOMIC, "SELECT annotated_type, count(*) AS count FROM atomic GROUP BY 1")
add("distinct_types", ATOMIC, "SELECT DISTINCT raw_type AS annotated_type FROM atomic")


def topped(source: str, target: int) -> str:
    return f"""
taken AS (
  SELECT p.*, row_number() OVER (PARTITION BY p.annotated_type ORDER BY {key('sha')}, sha) AS rn, {target} - coalesce(have, 0) AS need
  FROM {source} p LEFT JOIN have USING (annotated_type))"""


add("topup_sample", ATOMIC + "," + topped("atomic", TOP_UP), "SELECT annotated_type, sha, md5(git_diff) AS diff_md5 FROM taken WHERE rn <= need")
add("topup_large", ATOMIC + "," + topped("atomic", 5000), "SELECT annotated_type, sha FROM taken WHERE rn <= need")
add("curate_atomic", ATOMIC + f""",
clean AS (
  SELECT * FROM atomic WHERE sha NOT IN (SELECT sha FROM excluded) AND sha NOT IN (SELECT sha FROM existing) AND {TOKENS} <= {RECORD_LIMIT}),"""
    + topped("clean", TOP_UP), "SELECT annotated_type, masked_commit_message, sha, md5(git_diff) AS diff_md5 FROM taken WHERE rn <= need")
add("curation_counts", ATOMIC, f"""
SELECT CASE WHEN sha IN (SELECT sha FROM excluded) THEN 'excluded' WHEN sha IN (SELECT sha FROM existing) THEN 'existing'
            WHEN {TOKENS} > {RECORD_LIMIT} THEN 'over_limit' ELSE 'kept' END AS step, count(*) AS count
FROM atomic GROUP BY 1""")
add("split_by_type", RECORDS, "SELECT type, sha, split, md5(diff) AS diff_md5 FROM splits")
SAMPLED = TANGLED + f""",
sampled AS (
  SELECT row_number() OVER (ORDER BY {key('doc_id')}, doc_id) - 1 AS row_idx, doc_id, concern_count
  FROM tangled ORDER BY row_idx LIMIT {SAMPLE})"""
add("sample_n", SAMPLED, "SELECT row_idx, doc_id, concern_count FROM sampled")
add("sample_summary", SAMPLED, f"""
SELECT count(*) AS n, min(concern_count) AS min_concern, max(concern_count) AS max_concern,
       {r6('avg(concern_count) AS mean_concern')}, true AS has_types, true AS has_shas FROM sampled""")
DOCS = ATOMIC + f""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY annotated_type ORDER BY {key('sha')}, sha) AS ordinal FROM atomic),
docs AS (
  SELECT annotated_type AS type, annotated_type || '_' || ordinal || '_' || sha || '.diff' AS file_name,
         '# Type: ' || annotated_type || chr(10) || '# Commit Message: ' || masked_commit_message || chr(10) || '# SHA: ' || sha
         || chr(10) || chr(10) || '# === Git Diff Content ===' || chr(10) || chr(10) || git_diff AS content
  FROM numbered)"""
add("type_documents", DOCS, "SELECT type, file_name, md5(content) AS content_md5 FROM docs")
add("export_documents", DOCS, "SELECT type, count(*) AS n, sum(length(content))::BIGINT AS chars FROM docs GROUP BY 1")
add("rename_select", ATOMIC, "SELECT masked_commit_message AS message, md5(git_diff) AS diff_md5, sha, raw_type AS type FROM atomic")
add("read_atomic", ATOMIC, "SELECT sha, annotated_type, masked_commit_message, md5(git_diff) AS diff_md5 FROM atomic")

# --- combination

COMBINE = RECORDS + f""",
pool AS (SELECT split, type, sha, length(diff) AS n_chars FROM splits),
idx AS (
  SELECT *, row_number() OVER (PARTITION BY split, type ORDER BY {key('sha')}, sha) - 1 AS i, count(*) OVER (PARTITION BY split, type) AS n FROM pool),
goal AS (SELECT split, count(*) AS target FROM pool GROUP BY 1),
kinds AS (SELECT DISTINCT split, type, n FROM idx),
seeds AS (
  SELECT split, k, {key('k', 'type', 'sha', 't')} AS c
  FROM pool CROSS JOIN (SELECT unnest([2, 3, 4, 5]) AS k) CROSS JOIN (SELECT unnest([0, 1]) AS t)),
draws AS (
  SELECT s.split, k, c, kinds.type, kinds.n, md5(c || '|' || kinds.type) AS h,
         row_number() OVER (PARTITION BY s.split, k, c ORDER BY md5(c || '|' || kinds.type)) - 1 AS pos
  FROM seeds s JOIN kinds ON s.split = kinds.split),
picked AS (
  SELECT d.split, d.k, d.c, d.pos, idx.sha, idx.type, idx.n_chars
  FROM draws d JOIN idx ON d.split = idx.split AND d.type = idx.type AND idx.i = ('0x' || substr(d.h, 17, 15))::BIGINT % d.n
  WHERE d.pos < d.k
  UNION ALL
  SELECT split, 1, {key('1', 'type', 'sha')}, 0, sha, type, n_chars FROM pool),
drawn AS (
  SELECT split, k, c, sum(n_chars) // 4 <= {CASE_LIMIT} AS fits, array_to_string(list_sort(list(sha)), ',') AS set_key
  FROM picked GROUP BY 1, 2, 3),
sets AS (SELECT split, k, set_key, min(c) AS c FROM drawn WHERE fits GROUP BY 1, 2, 3),
chosen AS (
  SELECT * FROM (SELECT split, k, c, row_number() OVER (PARTITION BY split, k ORDER BY c) AS rn FROM sets) JOIN goal USING (split)
  WHERE rn <= target)"""
add("combine_cases", COMBINE, """
SELECT p.split, p.k::INT AS concern_count, string_agg(s.message, ',' ORDER BY pos) AS commit_message,
       string_agg(p.sha, ',' ORDER BY pos) AS shas, string_agg(p.type, ',' ORDER BY pos) AS types,
       md5(string_agg(s.diff, '|' ORDER BY pos)) AS diff_md5
FROM picked p JOIN chosen USING (split, k, c) JOIN splits s ON s.sha = p.sha GROUP BY p.split, p.k, p.c""")
add("rejection_counts", COMBINE, """
SELECT split, d.k::INT AS concern_count, count(*) AS attempts, count(*) FILTER (NOT fits) AS token_rejected,
       count(*) FILTER (fits) - count(DISTINCT set_key) FILTER (fits) AS duplicate_rejected,
       count(DISTINCT set_key) FILTER (fits) AS distinct_cases, any_value(target) AS target,
       greatest(0, any_value(target) - count(DISTINCT set_key) FILTER (fits)) AS shortfall
FROM drawn d JOIN goal USING (split) GROUP BY split, d.k""")
add("write_split", RECORDS, "SELECT split, message AS commit_message, 1 AS concern_count, sha AS shas, type AS types, md5(diff) AS diff_md5 FROM splits")

ROUNDS = 6
ROOM = 4 * CASE_LIMIT + 3


def visited(k: int) -> str:
    """Tables of the numbers of all k-sets, each digit moved in turn by a hash of the others."""
    digit = lambda j: f"(number // {' // '.join(f'radix[{i}]' for i in range(1, j)) or '1'}) % radix[{j}]"
    out = [f"v{k}_0 AS (SELECT *, {', '.join(f'{digit(j)} AS d{j}' for j in range(1, k + 1))} FROM numbers WHERE k = {k})"]
    for s in range(2 * k):
        j = s % k + 1
        rest = " || ',' || ".join(f"d{i}" for i in range(1, k + 1) if i != j)
        h = f"('0x' || substr({key('split', str(k), 'kinds', str(s), rest)}, 17, 15))::BIGINT"
        out.append(f"v{k}_{s + 1} AS (SELECT * REPLACE ((d{j} + {h}) % radix[{j}] AS d{j}) FROM v{k}_{s})")
    places = ", ".join(f"d{j}" for j in range(1, k + 1))
    out.append(f"m{k} AS (SELECT split, k, combo, number, round, unnest(range({k})) AS pos, unnest(types) AS type, unnest([{places}]) AS idx FROM v{k}_{2 * k})")
    return ",\n".join(out)


TARGETED = RECORDS + f""",
pool AS (SELECT split, type, sha, length(diff) AS n_chars FROM splits),
goal AS (SELECT DISTINCT split, CASE split {' '.join(f"WHEN '{s}' THEN {n}" for s, n in CASE_TARGET.items())} END AS target FROM pool),
least AS (SELECT split, type, min(n_chars) AS least FROM pool GROUP BY 1, 2),
others AS (SELECT a.split, a.type, list_sort(list(b.least)) AS o FROM least a JOIN least b ON a.split = b.split AND a.type <> b.type GROUP BY 1, 2),
fitting AS (
  SELECT p.*, k FROM pool p JOIN others USING (split, type) CROSS JOIN (SELECT unnest([2, 3, 4, 5]) AS k)
  WHERE len(o) >= k - 1 AND n_chars + list_sum(o[1:(k - 1)]) <= {ROOM}),
placed AS (SELECT *, row_number() OVER (PARTITION BY split, k, type ORDER BY {key('sha')}, sha) - 1 AS idx FROM fitting),
kinds AS (SELECT split, k, type, count(*) AS n, min(n_chars) AS least, row_number() OVER (PARTITION BY split, k ORDER BY type) - 1 AS i FROM placed GROUP BY 1, 2, 3),
combos AS (
  SELECT split, k, combo, list(type ORDER BY i) AS types, list(n ORDER BY i) AS radix, product(n)::BIGINT AS sets
  FROM kinds CROSS JOIN (SELECT unnest(range(1, 128)) AS combo) WHERE (combo >> i::INT) & 1 = 1 AND bit_count(combo) = k
  GROUP BY 1, 2, 3 HAVING count(*) = k AND sum(least) <= {ROOM}),
whole AS (SELECT split, k, sum(sets)::DOUBLE AS every FROM combos GROUP BY 1, 2),
reach AS (
  SELECT c.*, target, [{', '.join(f'least(sets, ceil(target * {2.0 * 2**r}::DOUBLE / every * sets)::BIGINT)' for r in range(ROUNDS))}] AS until
  FROM combos c JOIN whole USING (split, k) JOIN goal USING (split)),
numbers AS (
  SELECT split, k, combo, types, radix, array_to_string(types, ',') AS kinds, number, len(list_filter(until, lambda u: u <= number)) AS round
  FROM (SELECT *, unnest(range(0, until[{ROUNDS}])) AS number FROM reach)),
{(',' + chr(10)).join(visited(k) for k in (2, 3, 4, 5))},
members AS (
  SELECT m.*, sha, n_chars FROM ({' UNION ALL '.join(f'SELECT * FROM m{k}' for k in (2, 3, 4, 5))}) m
  JOIN placed USING (split, k, type, idx)
  UNION ALL SELECT split, 1, 0, row_number() OVER (), 0, 0, type, 0, sha, n_chars FROM pool),
tried AS (
  SELECT split, k, combo, number, any_value(round) AS round, sum(n_chars) <= {ROOM} AS fits, array_to_string(list_sort(list(sha)), ',') AS set_key
  FROM members GROUP BY 1, 2, 3, 4),
met AS (SELECT split, k, set_key, min(round) AS round, min({{'combo': combo, 'number': number}}) AS first FROM tried WHERE fits GROUP BY 1, 2, 3),
after AS (
  SELECT split, k, r, count(*) FILTER (round <= r) AS have, any_value(target) AS target
  FROM goal CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) CROSS JOIN (SELECT unnest(range({ROUNDS})) AS r) LEFT JOIN met USING (split, k) GROUP BY 1, 2, 3),
last AS (SELECT split, k, any_value(target) AS target, coalesce(min(r) FILTER (have >= target), {ROUNDS - 1}) AS r FROM after GROUP BY 1, 2),
chosen AS (
  SELECT * FROM (
    SELECT m.*, target, row_number() OVER (PARTITION BY m.split, m.k ORDER BY {key('m.k', 'set_key')}) AS rn FROM met m JOIN last l ON m.split = l.split AND m.k = l.k AND round <= r)
  WHERE rn <= target)"""
add("combine_to_target", TARGETED, """
SELECT m.split, m.k::INT AS concern_count, string_agg(s.message, ',' ORDER BY pos) AS commit_message,
       string_agg(m.sha, ',' ORDER BY pos) AS shas, string_agg(m.type, ',' ORDER BY pos) AS types,
       md5(string_agg(s.diff, '|' ORDER BY pos)) AS diff_md5
FROM chosen c JOIN members m ON m.split = c.split AND m.k = c.k AND m.combo = c.first.combo AND m.number = c.first.number
JOIN splits s ON s.sha = m.sha GROUP BY m.split, m.k, m.combo, m.number""")
add("target_report", TARGETED + """,
tally AS (
  SELECT split, k, count(*) AS attempts, count(*) FILTER (NOT fits) AS rejected, count(DISTINCT set_key) FILTER (fits) AS sets
  FROM tried JOIN last USING (split, k) WHERE round <= r GROUP BY 1, 2),
unused AS (SELECT DISTINCT c.split, c.k FROM reach c JOIN last l ON c.split = l.split AND c.k = l.k WHERE until[r + 1] < sets)""", """
SELECT l.split, l.k::INT AS concern_count, coalesce(attempts, 0)::BIGINT AS attempts, coalesce(rejected, 0)::BIGINT AS token_rejected,
       coalesce(attempts - rejected - sets, 0)::BIGINT AS duplicate_rejected, coalesce(sets, 0)::BIGINT AS distinct_cases, l.target::BIGINT AS target,
       greatest(0, l.target - coalesce(sets, 0))::BIGINT AS shortfall, u.split IS NULL AS exhausted
FROM last l LEFT JOIN tally t ON t.split = l.split AND t.k = l.k LEFT JOIN unused u ON u.split = l.split AND u.k = l.k""")

# --- model input

GRID = TANGLED + f""",
grid AS (
  SELECT t.*, context_len, with_message,
         CASE WHEN with_message THEN greatest(context_len - length(commit_message) // 4, 0) ELSE context_len END AS budget
  FROM tangled t CROSS JOIN (SELECT unnest({CTX}) AS context_len) CROSS JOIN (SELECT unnest([true, false]) AS with_message)),
cut AS (
  SELECT *, CASE WHEN budget <= 0 THEN '' ELSE
    array_to_string(list_transform(diff, lambda d: left(d, 4 * (budget // concern_count))), chr(10)) END AS body FROM grid),
ready AS (
  SELECT *, CASE WHEN with_message THEN '- given commit message:' || chr(10) || ' ' || commit_message || chr(10) || ' Diff: ' || body
                 ELSE '- given commit diff: ' || chr(10) || ' ' || body END AS truncated FROM cut)"""
add("truncate_grid", GRID, "SELECT doc_id, context_len, with_message, (length(truncated) // 4)::INT AS token_length, md5(truncated) AS text_md5 FROM ready")
add("experiment_grid", GRID, """
SELECT shot, context_len, with_message, count(*) AS cases, sum(length(truncated) // 4)::BIGINT AS tokens, max(length(truncated) // 4)::INT AS longest
FROM ready CROSS JOIN (SELECT unnest(['Zero-shot', 'One-shot', 'Two-shot']) AS shot) GROUP BY 1, 2, 3""")
TWO_1, TWO_2 = "<commit_diff id=1>a</commit_diff>", "<commit_diff id=2>b</commit_diff>"
add("prompt_stats", GRID + f""",
shots AS (SELECT unnest(['Zero-shot', 'One-shot', 'Two-shot', 'Other-shot']) AS shot),
texts AS (
  SELECT shot, with_message, CASE WHEN shot = 'Zero-shot' THEN '{SYSTEM}' ELSE
    '{SYSTEM}' || chr(10) || chr(10) || '# Examples' || chr(10)
    || CASE WHEN with_message THEN '<commit_message>first message</commit_message>' || chr(10) ELSE '' END || '{TWO_1}'
    || CASE WHEN shot = 'One-shot' THEN '' ELSE chr(10)
       || CASE WHEN with_message THEN '<commit_message>second message</commit_message>' || chr(10) ELSE '' END || '{TWO_2}' END END AS p
  FROM ready CROSS JOIN shots)""", """
SELECT shot, with_message, (len(string_split(p, '<commit_diff')) - 1)::INT AS examples_count, contains(p, '<commit_message>') AS has_message,
       count(*) AS cases, min(length(p))::INT AS prompt_chars FROM texts GROUP BY 1, 2, 3, 4""")
CHAT = TANGLED + f""",
chat AS (
  SELECT doc_id, '- given commit message:' || chr(10) || ' ' || commit_message || chr(10) || ' Diff: ' || array_to_string(diff, chr(10)) AS u,
         '{{"types":["' || array_to_string(types, '","') || '"]}}' AS a FROM tangled)"""
add("chat_messages", CHAT, f"SELECT doc_id, 3 AS turns, '{SYSTEM}' AS system, md5(u) AS user_md5, a AS assistant FROM chat")
add("render_chat", CHAT + f""",
rendered AS (
  SELECT doc_id, '<|im_start|>system<|im_sep|>{SYSTEM}<|im_end|><|im_start|>user<|im_sep|>' || u || '<|im_end|><|im_start|>assistant<|im_sep|>' || a || '<|im_end|>' AS t
  FROM chat)""", "SELECT doc_id, md5(t) AS text_md5, length(t)::INT AS chars FROM rendered")
add("reasoning_prompt", TANGLED, f"""
SELECT doc_id, md5('Commit Message: ' || commit_message || chr(10) || chr(10) || 'Assigned Types: '
  || CASE WHEN doc_id % 3 = 0 THEN array_to_string(types, '+') ELSE array_to_string(types, ', ') END || chr(10) || chr(10) || 'Git Diff:' || chr(10)
  || array_to_string(diff, chr(10)) || chr(10) || chr(10) || '{REQUEST}') AS prompt_md5
FROM tangled""")
# A tokenizer of three characters a token.
THREES = lambda t: f"ceil(length({t}) / 3.0)::BIGINT"
add("truncate_by_tokenizer", GRID.replace("length(commit_message) // 4", THREES("commit_message")).replace("left(d, 4 * (budget", "left(d, 3 * (budget"),
    f"SELECT doc_id, context_len, with_message, {THREES('truncated')}::INT AS token_length, md5(truncated) AS text_md5 FROM ready")
add("curate_by_tokenizer", ATOMIC + f""",
clean AS (
  SELECT * FROM atomic WHERE sha NOT IN (SELECT sha FROM excluded) AND sha NOT IN (SELECT sha FROM existing)
  AND {THREES("coalesce(git_diff, '') || ' ' || coalesce(masked_commit_message, '')")} <= {RECORD_LIMIT}),"""
    + topped("clean", TOP_UP), "SELECT annotated_type, masked_commit_message, sha, md5(git_diff) AS diff_md5 FROM taken WHERE rn <= need")
add("cases_by_tokenizer", COMBINE.replace("length(diff) AS n_chars", f"{THREES('diff')} AS n_chars").replace("sum(n_chars) // 4 <=", "sum(n_chars) <="), SQL["rejection_counts"][len(f"WITH {COMBINE.strip()}") :])
ANSWERS = f"""
answers AS (SELECT event_id, {label('event_id')} AS l1, {label('event_id + user_id')} AS l2 FROM events)"""
add("parse_responses", ANSWERS, """
SELECT event_id, CASE WHEN event_id % 4 < 2 THEN l1 || ',' || l2 ELSE '' END AS types,
       CASE WHEN event_id % 4 < 2 THEN 2 ELSE 0 END::INT AS n FROM answers""")
add("response_contract", ANSWERS, "SELECT event_id, event_id % 4 = 0 AS valid FROM answers")
add("strict_responses", ANSWERS, """
SELECT event_id, CASE WHEN event_id % 8 < 2 THEN l1 || ',' || l2 ELSE '' END AS types, event_id % 8 = 0 AS valid FROM answers""")
REASONS = """
reasons AS (
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || ' seen' WHEN 1 THEN 'No reasoning in response'
         WHEN 2 THEN 'not json ' || event_type ELSE 'No reasoning generated' END AS reason FROM events)"""
add("parse_reasoning", REASONS, "SELECT event_id, reason FROM reasons")
add("replace_reason", REASONS, "SELECT reason, count(*) AS count FROM reasons GROUP BY 1")
add("write_resumable", REASONS, "SELECT reason, count(*) AS n, count(DISTINCT event_id) AS ids FROM reasons GROUP BY 1")
add("predict_labels", RECORDS, f"""
SELECT sha, array_to_string(list_filter({L}, lambda x: contains(diff, x)), ',') AS predicted_types, true AS success FROM records""")

# --- tokens and labels

RANGES = ("≤1024", "1025-2048", "2049-4096", "4097-8192", "8193-16384", "16385-32768", ">32768")
TOPS = (1024, 2048, 4096, 8192, 16384, 32768)
IN_RANGE = "CASE " + " ".join(f"WHEN {{t}} <= {b} THEN '{n}'" for b, n in zip(TOPS, RANGES)) + f" ELSE '{RANGES[-1]}' END"
HIST = f"""
toks AS (SELECT doc_id AS row_idx, (length(text) // 4)::INT AS token_count FROM documents WHERE text IS NOT NULL),
ranged AS (SELECT *, {IN_RANGE.format(t='token_count')} AS token_range FROM toks),
names AS (SELECT unnest({list(RANGES)}) AS token_range, unnest(range(7))::INT AS position),
hist AS (
  SELECT position, token_range, count(row_idx) AS count, round_even(count(row_idx) * 100.0 / (SELECT count(*) FROM toks), 1)::DOUBLE AS percentage
  FROM names LEFT JOIN ranged USING (token_range) GROUP BY 1, 2)"""
add("token_table", HIST, "SELECT row_idx, token_count, token_range FROM ranged")
add("token_histogram", HIST, f"SELECT position, token_range, count, {r6('percentage')} FROM hist")
add("histogram_by_tokenizer", HIST.replace("(length(text) // 4)::INT", THREES("text")), f"SELECT position, token_range, count, {r6('percentage')} FROM hist")
add("token_thresholds", HIST, f"SELECT {r6(*[f'sum(percentage) FILTER (position <= {i}) AS le_{n}' for i, n in ((0, 1024), (2, 4096), (3, 8192))])} FROM hist")
add("token_stats", HIST, """
SELECT count(*) AS total_samples, trunc(quantile_cont(token_count::DOUBLE, 0.5))::INT AS median_tokens, trunc(avg(token_count))::INT AS mean_tokens,
       min(token_count) AS min_tokens, max(token_count) AS max_tokens FROM toks""")
add("tokens_by_concern", TANGLED + f""",
names AS (SELECT unnest({list(RANGES[:5])}) AS token_range, unnest(range(5))::INT AS position),
totals AS (SELECT concern_count, count(*) AS total FROM tangled GROUP BY 1),
hits AS (SELECT concern_count, {IN_RANGE.format(t='token_length')} AS token_range, count(*) AS count FROM tangled GROUP BY 1, 2)""", f"""
SELECT t.concern_count, total, position, n.token_range, coalesce(count, 0) AS count,
       {r6('round_even(coalesce(count, 0) * 100.0 / total, 1) AS percentage')}
FROM totals t CROSS JOIN names n LEFT JOIN hits h ON h.concern_count = t.concern_count AND h.token_range = n.token_range""")
add("dataset_basics", TANGLED, f"""
SELECT concern_count, count(*) AS count, (SELECT min(token_length)::INT FROM tangled) AS min_tokens, (SELECT max(token_length)::INT FROM tangled) AS max_tokens,
       {r6('(SELECT avg(token_length) FROM tangled) AS mean_tokens')} FROM tangled GROUP BY 1""")


def combinations(source: str, col: str) -> str:
    return f"""
SELECT combination, count, round_even(count * 100.0 / sum(count) OVER (), 1)::DOUBLE AS percentage, count(*) OVER () AS unique_combinations
FROM (SELECT array_to_string(list_sort({col}), ', ') AS combination, count(*) AS count FROM {source} GROUP BY 1)"""


add("label_combinations", TANGLED, combinations("tangled", "types"))
add("predicted_combinations", RESULTS, combinations("results", "predicted"))
add("parseable_types", ANSWERS, "SELECT event_id, 'feat,ci' AS types FROM answers WHERE event_id % 3 <> 0")
add("dataset_manifest", TANGLED, """
SELECT 'train' AS configuration, count(*) AS num_rows, 'doc_id, commit_message, diff, concern_count, shas, types' AS columns FROM tangled
UNION ALL SELECT 'original', count(*), 'annotated_type, masked_commit_message, git_diff, sha' FROM documents""")
add("manifest_with_files", RECORDS, """
SELECT split AS configuration, count(*) AS num_rows, 'commit_message, diff, concern_count, shas, types' AS columns, 1::BIGINT AS files, false AS missing, true AS sizes_agree FROM splits GROUP BY 1
UNION ALL SELECT 'original', count(*), 'annotated_type, masked_commit_message, git_diff, sha', 1, false, true FROM documents
UNION ALL SELECT 'extra', 0, NULL, 0, true, true""")
SQL["missing_files"] = "SELECT 'original.json' AS file UNION ALL SELECT 'dev.json'"
add("hub_split", TANGLED, """
SELECT doc_id, commit_message, concern_count, '["' || array_to_string(types, '","') || '"]' AS types,
       md5(to_json(diff)::VARCHAR) AS diff_md5 FROM tangled WHERE doc_id % 4 <> 0""")
add("level_table", SCORED, " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", row_number() OVER (ORDER BY level) - 1 AS position, {r6('level')} FROM (SELECT DISTINCT {c}::DOUBLE AS level FROM scored)"""
    for c in ("context_len", "concern_count", "inference_time")))
add("sorted_levels", SCORED, """
SELECT array_to_string(list_sort(list(DISTINCT context_len)), ',') AS context_len,
       array_to_string(list_sort(list(DISTINCT concern_count)), ',') AS concern_count FROM scored""")
add("dataset_names", "d AS (SELECT *, (doc_id % 8 + 1)::INT AS n FROM documents)", f"""
SELECT 'c' || (doc_id % 5 + 1) || '_t' || n || '_s' || n_chars || CASE WHEN doc_id % 2 = 0 THEN '_u_' ELSE '_m_' END
         || array_to_string({AB}[:n], '_') || '.json' AS name,
       (doc_id % 5 + 1)::INT AS concerns_per_case, n AS num_types, n_chars::INT AS num_samples, doc_id % 2 = 0 AS ensure_different_types,
       array_to_string({FULL}[:n], ',') AS types FROM d""")
add("run_names", RESULTS, """
SELECT row_id, model, context_len, shot, with_message,
       model || '_' || context_len || CASE WHEN with_message THEN '_yes_' ELSE '_no_' END || '20240101' AS experiment_id
FROM (SELECT *, ['alpha-4', 'beta', 'gamma_8b'][(row_id % 3)::INT + 1] AS model, ['Zero-shot', 'One-shot', 'Two-shot'][(row_id % 3)::INT + 1] AS shot FROM results)""")

# --- statistics

METRICS = ("precision", "recall", "f1", "inference_time")
PAIRS = [(f, m) for f in ("context_len", "concern_count") for m in METRICS]
TABLE = SCORED + ",\ntab AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS factor, '{m}' AS metric, count(*) AS n, corr({m}, {f}) AS r, regr_slope({m}, {f}) AS slope, regr_intercept({m}, {f}) AS intercept FROM scored"
    for f, m in PAIRS) + ")"
add("correlation_table", TABLE, f"SELECT factor, metric, n, {r6('r', 'abs(r) AS abs_r', 'slope', 'intercept')} FROM tab")
add("stronger_factor", TABLE, f"""
SELECT a.metric, {r6('abs(a.r) AS abs_r_context_len', 'abs(b.r) AS abs_r_concern_count')},
       CASE WHEN abs(a.r) > abs(b.r) THEN 'context_len' ELSE 'concern_count' END AS stronger
FROM tab a JOIN tab b ON a.metric = b.metric AND a.factor = 'context_len' AND b.factor = 'concern_count'""")
LOGS = SCORED + """,
logs AS (
  SELECT *, ln(context_len + 1e-6) AS a, concern_count AS b, ln(context_len + 1e-6) * concern_count AS c, ln(inference_time + 1e-6) AS y
  FROM scored WHERE context_len > 0 AND inference_time > 0 AND concern_count >= 0)"""
FIVE = ("corr(context_len, inference_time) AS tokens_time", "corr(concern_count, inference_time) AS concern_time",
        "corr(context_len, concern_count) AS tokens_concern", "corr(a, y) AS log_tokens_log_time", "corr(b, y) AS concern_log_time")
add("correlation_set", LOGS, f"SELECT {r6(*FIVE)} FROM logs")
add("log_features", LOGS, f"SELECT row_id, {r6('a AS log_tokens', 'y AS log_time', 'c AS log_tokens_x_concern')} FROM logs")
add("point_biserial", RESULTS, f"SELECT count(*) AS n, {r6('corr(with_message::INT, inference_time) AS r')} FROM results")
FIT = """
SELECT count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2,
       greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0) / (count(*) - 2) AS mse,
       avg(x) AS x_mean, regr_sxx(y, x) AS ss_x, min(x)::DOUBLE AS x_min, max(x)::DOUBLE AS x_max"""
# The t quantile from the normal one, by its series in the degrees of freedom (here over a thousand).
_Z = T_95
T_QUANTILE = (
    f"({_Z} + {_Z**3 + _Z} / (4.0::DOUBLE * v) + {5 * _Z**5 + 16 * _Z**3 + 3 * _Z} / (96.0::DOUBLE * v * v)"
    f" + {3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z} / (384.0::DOUBLE * v * v * v))"
)
add("ci_band", SCORED + f",\nxy AS (SELECT concern_count AS x, inference_time AS y FROM scored),\nfit AS ({FIT} FROM xy)" + """,
pts AS (SELECT i::INT AS point, x_min + (x_max - x_min) * (i / 99.0::DOUBLE) AS x, fit.* FROM fit CROSS JOIN (SELECT unnest(range(100)) AS i)),
line AS (SELECT point, x, slope * x + intercept AS y, sqrt(mse * (1.0::DOUBLE / n + (x - x_mean) ** 2 / ss_x)) AS se, (n - 2)::DOUBLE AS v FROM pts)""",
    f"SELECT point, {r6('x', 'y', f'y - {T_QUANTILE} * se AS ci_low', f'y + {T_QUANTILE} * se AS ci_high')} FROM line")


def two_factor(m: str) -> str:
    return f"""SELECT '{m}' AS metric, count(*) AS n, corr({m}, context_len) AS r_oy, corr({m}, lc) AS ray, corr({m}, concern_count) AS rby,
  corr(lc, concern_count) AS rab, covar_pop(lc, {m}) AS say, covar_pop(concern_count, {m}) AS sby, covar_pop(lc, concern_count) AS sab,
  var_pop(lc) AS saa, var_pop(concern_count) AS sbb, var_pop({m}) AS syy, avg(lc) AS ma, avg(concern_count) AS mb, avg({m}) AS my FROM lg"""


PARTIAL = SCORED + ",\nlg AS (SELECT *, log2(context_len) AS lc FROM scored),\nmom AS (" + " UNION ALL ".join(map(two_factor, METRICS)) + """),
fit AS (
  SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ba, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS bb FROM mom),
full_fit AS (SELECT *, (ba * say + bb * sby) / syy AS r2, ba * sqrt(saa / syy) AS sa, bb * sqrt(sbb / syy) AS sb FROM fit)"""
add("partial_table", PARTIAL, f"""
SELECT metric, n, {r6('r_oy AS pearson_r_context_len', 'rby AS pearson_r_concern_count',
  '(ray - rab * rby) / sqrt((1 - rab * rab) * (1 - rby * rby)) AS partial_r_context_len',
  '(rby - rab * ray) / sqrt((1 - rab * rab) * (1 - ray * ray)) AS partial_r_concern_count',
  'ba AS beta_context_len', 'bb AS beta_concern_count', 'r2', 'r2 - rby * rby AS delta_r2_context_len', 'r2 - ray * ray AS delta_r2_concern_count',
  '1 / (1 - rab * rab) AS vif_context_len', '1 / (1 - rab * rab) AS vif_concern_count', 'sa AS std_beta_context_len', 'sb AS std_beta_concern_count')},
  CASE WHEN abs(sa) > abs(sb) THEN 'log2_context_len' ELSE 'concern_count' END AS stronger FROM full_fit""")
add("two_factor_ols", PARTIAL, f"""
SELECT n, {r6('my - ba * ma - bb * mb AS intercept', 'ba AS beta_context', 'bb AS beta_concern', 'r2', '1 - (1 - r2) * (n - 1) / (n - 3) AS adj_r2',
  'syy * (1 - r2) AS mse', 'sqrt(syy * (1 - r2)) AS rmse')} FROM full_fit WHERE metric = 'f1'""")
add("residual_table", SCORED + """,
w AS (SELECT row_id, log2(context_len) AS x, f1 AS y, concern_count AS z FROM scored),
f AS (SELECT regr_slope(x, z) AS bx, regr_intercept(x, z) AS ax, regr_slope(y, z) AS by_, regr_intercept(y, z) AS ay FROM w),
res AS (SELECT row_id, x - ax - bx * z AS xr, y - ay - by_ * z AS yr FROM w CROSS JOIN f),
s AS (SELECT regr_slope(yr, xr) AS line_slope FROM res)""",
    f"SELECT row_id, {r6('xr AS x_residual', 'yr AS y_residual', 'line_slope')}, 0.0::DOUBLE AS line_intercept FROM res CROSS JOIN s")


def interaction(rows: str) -> str:
    names = "abc"
    cov = ", ".join(f"covar_pop({p}, {q}) AS s{p}{q}" for i, p in enumerate(names + "y") for q in (names + "y")[i:])

    def det(cells: str) -> str:
        a, b, c, d, e, f, g, h, i = (f"s{x}" for x in cells.split())
        return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"

    return f"""
m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my, {cov} FROM {rows}),
d AS (SELECT *, {det('aa ab ac ab bb bc ac bc cc')} AS d0,
  {det('ay ab ac by bb bc cy bc cc')} AS d1,
  {det('aa ay ac ab by bc ac cy cc')} AS d2,
  {det('aa ab ay ab bb by ac bc cy')} AS d3 FROM m),
beta AS (SELECT *, d1 / d0 AS b1, d2 / d0 AS b2, d3 / d0 AS b3 FROM d),
model AS (
  SELECT *, my - b1 * ma - b2 * mb - b3 * mc AS b0, (b1 * say + b2 * sby + b3 * scy) / syy AS r2, syy - (b1 * say + b2 * sby + b3 * scy) AS mse FROM beta)"""


INTER = LOGS + """,
lq AS (SELECT quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM logs),
out_log AS (SELECT logs.*, y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1) AS is_out FROM logs CROSS JOIN lq),
kept AS (SELECT * FROM out_log WHERE NOT is_out),""" + interaction("kept")
BETAS = ("b0 AS intercept", "b1 AS beta_log_tokens", "b2 AS beta_concern_count", "b3 AS beta_log_tokens_x_concern")
ADJ = "1 - (1 - r2) * (n - 1) / (n - 4)"
add("interaction_ols", INTER, f"SELECT n, {r6(*BETAS, 'r2', ADJ + ' AS adj_r2', 'mse', 'sqrt(mse) AS rmse')} FROM model")
add("prediction_grid", LOGS + "," + interaction("logs"), f"""
SELECT t.context_len, u.concern_count, {r6('exp(b0 + b1 * ln(t.context_len + 1e-6) + b2 * u.concern_count + b3 * ln(t.context_len + 1e-6) * u.concern_count) AS predicted_time')}
FROM (SELECT DISTINCT context_len FROM logs) t CROSS JOIN (SELECT DISTINCT concern_count FROM logs) u CROSS JOIN model""")
QUALITY = "CASE WHEN {r} >= 0.9 THEN 'Excellent fit' WHEN {r} >= 0.7 THEN 'Good fit' WHEN {r} >= 0.5 THEN 'Moderate fit' WHEN {r} >= 0.3 THEN 'Weak fit' ELSE 'Poor fit' END"
add("interaction_report", INTER + """,
outs AS (SELECT count(*) FILTER (is_out) AS k, count(*) AS total FROM out_log),
more AS (SELECT """ + ", ".join(FIVE) + """, avg(context_len) AS context_mean, stddev_samp(inference_time) AS time_std, max(concern_count) AS concern_max FROM kept)""", f"""
SELECT n AS total_samples, k AS outliers_detected, {r6('b0 AS intercept', 'b1 AS log_tokens', 'b2 AS concern_count', 'b3 AS interaction', 'r2 AS r_squared', ADJ + ' AS adjusted_r_squared', 'sqrt(mse) AS rmse')},
       {QUALITY.format(r='r2')} AS fit, {r6('tokens_time', 'concern_time', 'tokens_concern', 'log_tokens_log_time', 'concern_log_time', 'context_mean', 'time_std', 'concern_max')},
       {r6('round_even(k * 100.0 / total, 1) AS percentage_of_data')} FROM model CROSS JOIN outs CROSS JOIN more""")
add("group_stats", RESULTS, f"""
SELECT with_message, count(*) AS count, {r6('avg(inference_time) AS mean', 'stddev_samp(inference_time) AS std', 'min(inference_time) AS min', 'max(inference_time) AS max',
  'quantile_cont(inference_time, 0.5) AS median')} FROM results GROUP BY 1""")
add("t_statistic", RESULTS + """,
g AS (
  SELECT count(*) FILTER (with_message) AS n1, count(*) FILTER (NOT with_message) AS n0,
         avg(inference_time) FILTER (with_message) AS m1, avg(inference_time) FILTER (NOT with_message) AS m0,
         var_samp(inference_time) FILTER (with_message) AS v1, var_samp(inference_time) FILTER (NOT with_message) AS v0 FROM results),
d AS (SELECT *, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS d FROM g)""", f"""
SELECT n1, n0, {r6('d / sqrt(1.0::DOUBLE / n1 + 1.0::DOUBLE / n0) AS t_statistic')}, n1 + n0 - 2 AS df, {r6('d AS cohens_d')},
       CASE WHEN abs(d) >= 0.8 THEN 'Large' WHEN abs(d) >= 0.5 THEN 'Medium' WHEN abs(d) >= 0.2 THEN 'Small' ELSE 'Negligible' END AS effect FROM d""")
add("mann_whitney_u", RESULTS + """,
v AS (SELECT inference_time AS x, count(*) FILTER (with_message) AS k1, count(*) AS k FROM results GROUP BY 1),
ranks AS (SELECT *, coalesce(sum(k) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (k + 1) / 2.0::DOUBLE AS rk FROM v),
s AS (SELECT sum(k1)::BIGINT AS n1, (sum(k) - sum(k1))::BIGINT AS n0, sum(k1 * rk) AS rank_sum, sum(k::DOUBLE ** 3 - k) AS ties FROM ranks),
u AS (SELECT *, rank_sum - n1 * (n1 + 1) / 2.0::DOUBLE AS u FROM s)""", f"""
SELECT n1, n0, {r6('u AS u_statistic', 'ties AS tie_term',
  '(greatest(u, n1 * n0 - u) - n1 * n0 / 2.0::DOUBLE - 0.5) / sqrt(n1 * n0 / 12.0::DOUBLE * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS z')} FROM u""")


# --- p-values: the density integrated by Simpson's rule from 0 to the statistic


def area(top: str, density: str, scale: str) -> str:
    weight = "CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    x = f"(abs({top}) * i / 4000.0::DOUBLE)"
    return f"greatest(0, 1 - 2 * abs({top}) / 12000 * {scale} * (SELECT sum({weight} * {density.format(x=x)}) FROM range(4001) g(i)))"


def t_p(t: str, v: str) -> str:
    scale = f"exp(lgamma(({v} + 1) / 2.0::DOUBLE) - lgamma({v} / 2.0::DOUBLE)) / sqrt({v} * pi())"
    return area(t, f"exp(-({v} + 1) / 2.0::DOUBLE * ln(1 + {{x}} * {{x}} / {v}))", scale)


def z_p(z: str) -> str:
    return area(z, "exp(-{x} * {x} / 2)", "(1 / sqrt(2 * pi()))")


for x, name in (("context_len", "context"), ("concern_count", "concern"), ("with_message::INT", "message")):
    add(f"ols_by_{name}", SCORED + f",\nxy AS (SELECT {x} AS x, inference_time AS y FROM scored),\nfit AS ({FIT} FROM xy)" + f""",
more AS (SELECT *, sign(slope) * sqrt(r2) AS r, n - 2 AS v FROM fit),
tt AS (SELECT *, r * sqrt(v / (1 - r * r)) AS t, {T_QUANTILE} AS t_value FROM more),
tested AS (SELECT *, {t_p('t', 'v')} AS p, t_value * sqrt(mse / ss_x) AS reach FROM tt)""",
        f"SELECT n, {r6('slope', 'intercept', 'r2', 'sqrt(mse) AS standard_error', 'mse', 'x_mean', 'ss_x / n AS x_variance', 'x_min', 'x_max', 't_value', 'r', 'p', 'slope - reach AS slope_low', 'slope + reach AS slope_high')} FROM tested")
STARS = "CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' ELSE '' END"
add("correlation_report", TABLE + f""",
tt AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS v FROM tab),
pp AS (SELECT *, {t_p('t', 'v')} AS p FROM tt)""", f"""
SELECT a.metric, a.factor, a.n, {r6('a.r AS r', 'abs(a.r) AS abs_r', 'a.slope AS slope', 'a.intercept AS intercept', 'a.p AS p')}, a.p < 0.05 AS significant,
       {STARS.format(p='a.p')} AS stars, CASE WHEN abs(c.r) > abs(b.r) THEN 'context_len' ELSE 'concern_count' END AS stronger
FROM pp a JOIN pp c ON c.metric = a.metric AND c.factor = 'context_len' JOIN pp b ON b.metric = a.metric AND b.factor = 'concern_count'""")
RS = {
    "pearson_p_context_len": ("r_oy", 2), "pearson_p_concern_count": ("rby", 2),
    "partial_p_context_len": ("pa", 2), "partial_p_concern_count": ("pb", 2),
    "partial_p_df3_context_len": ("pa", 3), "partial_p_df3_concern_count": ("pb", 3),
}
add("partial_p_values", PARTIAL + """,
rs AS (SELECT *, (ray - rab * rby) / sqrt((1 - rab * rab) * (1 - rby * rby)) AS pa, (rby - rab * ray) / sqrt((1 - rab * rab) * (1 - ray * ray)) AS pb FROM full_fit),
ts AS (SELECT metric, n, n - 2 AS v2, n - 3 AS v3, """ + ", ".join(f"{r} * sqrt((n - {k}) / (1 - {r} * {r})) AS t_{name}" for name, (r, k) in RS.items()) + " FROM rs)",
    "SELECT metric, n, " + r6(*[f"{t_p('t_' + name, 'v' + str(k))} AS {name}" for name, (_, k) in RS.items()]) + " FROM ts")


def two_groups(source: str) -> str:
    """t and U of the rows with a message, with what their p-values need."""
    return f"""
g AS (
  SELECT count(*) FILTER (with_message) AS n1, count(*) FILTER (NOT with_message) AS n0,
         avg(inference_time) FILTER (with_message) AS m1, avg(inference_time) FILTER (NOT with_message) AS m0,
         var_samp(inference_time) FILTER (with_message) AS v1, var_samp(inference_time) FILTER (NOT with_message) AS v0,
         corr(with_message::INT, inference_time) AS r, count(*) AS n FROM {source}),
d AS (SELECT *, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS d FROM g),
vals AS (SELECT inference_time AS x, count(*) FILTER (with_message) AS k1, count(*) AS k FROM {source} GROUP BY 1),
ranks AS (SELECT *, coalesce(sum(k) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (k + 1) / 2.0::DOUBLE AS rk FROM vals),
s AS (SELECT sum(k1 * rk) AS rank_sum, sum(k::DOUBLE ** 3 - k) AS ties FROM ranks),
u AS (SELECT d.*, rank_sum - n1 * (n1 + 1) / 2.0::DOUBLE AS u, ties FROM s CROSS JOIN d),
st AS (
  SELECT *, d / sqrt(1.0::DOUBLE / n1 + 1.0::DOUBLE / n0) AS t, n - 2 AS v, r * sqrt((n - 2) / (1 - r * r)) AS tr,
         (greatest(u, n1 * n0 - u) - n1 * n0 / 2.0::DOUBLE - 0.5) / sqrt(n1 * n0 / 12.0::DOUBLE * (n + 1 - ties / (n * (n - 1)))) AS z FROM u),
st_p AS (SELECT *, {t_p('t', 'v')} AS tp, {z_p('z')} AS zp, {t_p('tr', 'v')} AS rp FROM st)"""


add("u_exact_small", """
ranked AS (SELECT s_suppkey < 4 AS first, row_number() OVER (ORDER BY s_acctbal) AS r FROM supplier),
seen AS (SELECT count(*) FILTER (first) AS n1, count(*) FILTER (NOT first) AS n0, sum(r) FILTER (first) - 10 AS u FROM ranked),
every AS (SELECT a.r + b.r + c.r + d.r - 10 AS u FROM ranked a JOIN ranked b ON a.r < b.r JOIN ranked c ON b.r < c.r JOIN ranked d ON c.r < d.r)""",
    f"""SELECT n1, n0, {r6('s.u AS u_statistic')}, 0.0::DOUBLE AS tie_term,
  {r6('least(1, 2 * least(count(*) FILTER (e.u <= s.u), count(*) FILTER (e.u >= s.u)) / count(*)) AS u_p_value')} FROM every e CROSS JOIN seen s GROUP BY n1, n0, s.u""")
add("p_values", RESULTS + "," + two_groups("results"), " UNION ALL ".join(
    f"SELECT '{n}' AS test, {r6(s + ' AS statistic', p + ' AS p')} FROM st_p" for n, s, p in (("t", "t", "tp"), ("u", "u", "zp"), ("r", "r", "rp"))))
SIDES = ", ".join(
    f"count(*) FILTER ({c}) AS {g}_count, avg(inference_time) FILTER ({c}) AS {g}_mean, stddev_samp(inference_time) FILTER ({c}) AS {g}_std, quantile_cont(inference_time, 0.5) FILTER ({c}) AS {g}_median"
    for g, c in (("with_message", "with_message"), ("without_message", "NOT with_message")))
EVEN4 = lambda *cs: ", ".join(f"round_even({c.rsplit(' AS ', 1)[0]}, 4)::DOUBLE AS {c.rsplit(' AS ', 1)[-1]}" for c in cs)
add("message_report", RESULTS + f""",
q AS (SELECT {Q.format(x='inference_time')} FROM results),
fl AS (SELECT results.*, inference_time < q1 - 1.5 * (q3 - q1) OR inference_time > q3 + 1.5 * (q3 - q1) AS is_out FROM results CROSS JOIN q),
clean AS (SELECT * FROM fl WHERE NOT is_out),
o AS (SELECT count(*) FILTER (is_out) AS k FROM fl),
sides AS (SELECT {SIDES} FROM clean),""" + two_groups("clean"), f"""
SELECT n AS total_samples, k AS outliers_detected, {EVEN4('r AS coefficient')}, {r6('rp AS p_value')}, rp < 0.05 AS significant,
       with_message_count, {EVEN4('with_message_mean', 'with_message_std', 'with_message_median')},
       without_message_count, {EVEN4('without_message_mean', 'without_message_std', 'without_message_median')},
       {r6('t AS t_statistic', 'tp AS t_p_value', 'u AS u_statistic', 'zp AS u_p_value', 'd AS cohens_d')},
       CASE WHEN abs(d) >= 0.8 THEN 'Large' WHEN abs(d) >= 0.5 THEN 'Medium' WHEN abs(d) >= 0.2 THEN 'Small' ELSE 'Negligible' END AS effect
FROM st_p CROSS JOIN o CROSS JOIN sides""")

def efficiency(x: str, digits: int) -> str:
    even = lambda e, n, name: f"round_even(({e})::DOUBLE, {n})::DOUBLE AS {name}"
    return f"""
q AS (SELECT {Q.format(x='inference_time')} FROM scored),
fl AS (SELECT {x} AS x, inference_time AS y, inference_time < q1 - 1.5 * (q3 - q1) OR inference_time > q3 + 1.5 * (q3 - q1) AS is_out FROM scored CROSS JOIN q),
o AS (SELECT count(*) FILTER (is_out) AS k, count(*) AS total FROM fl),
st AS (SELECT corr(x, y) AS r, avg(x) AS xm, stddev_samp(x) AS xs, avg(y) AS ym, stddev_samp(y) AS ys FROM fl WHERE NOT is_out),
fit AS ({FIT} FROM fl WHERE NOT is_out),
tt AS (SELECT *, n - 2 AS v, {T_QUANTILE.replace('v', '(n - 2)')} AS t_value, r * sqrt((n - 2) / (1 - r * r)) AS t FROM fit CROSS JOIN st),
tested AS (SELECT *, {t_p('t', 'v')} AS p FROM tt)
SELECT {r6('p AS p_value')}, p < 0.05 AS significant, 95 AS level, {even('t_value', 4, 't_value')}, n AS total_samples, k AS outliers_detected, k > 0 AS outliers_removed, x_min, x_max, {even('r', 4, 'coefficient')},
       CASE WHEN abs(r) >= 0.5 THEN 'large' WHEN abs(r) >= 0.3 THEN 'medium' WHEN abs(r) >= 0.1 THEN 'small' ELSE 'negligible' END AS effect_size,
       sign(r)::INT AS sign,
       CASE WHEN r > 0.5 THEN 'Strong positive' WHEN r > 0.3 THEN 'Moderate positive' WHEN r > 0.1 THEN 'Weak positive'
            WHEN r > -0.1 THEN 'Weak negative' WHEN r > -0.3 THEN 'Moderate negative' ELSE 'Strong negative' END AS direction,
       {even('slope', digits, 'slope')}, {even('intercept', 4, 'intercept')}, {even('r2', 4, 'r_squared')}, {even('sqrt(mse)', 4, 'standard_error')},
       {QUALITY.format(r='r2')} AS fit, {even('xm', 2, 'x_mean')}, {even('xs', 2, 'x_std')}, {even('ym', 4, 'y_mean')}, {even('ys', 4, 'y_std')},
       {even('k * 100.0 / total', 1, 'percentage_of_data')}
FROM tested CROSS JOIN o"""


for x, name, digits in (("context_len", "context", 6), ("concern_count", "concern", 4), ("with_message::INT", "message", 4)):
    SQL[f"efficiency_by_{name}"] = f"WITH {SCORED.strip()},{efficiency(x, digits)}"

# --- comparison of two models

FOUR = ("precision", "recall", "f1", "exact_match")
PAIRED = SCORED + "," + OTHER + ",\npairs AS (SELECT a.row_id, " + ", ".join(
    f"a.{m}::DOUBLE AS {m}_SLM, b.{m}::DOUBLE AS {m}_LLM, CASE WHEN b.{m}::DOUBLE > a.{m}::DOUBLE THEN 'LLM>SLM' WHEN b.{m}::DOUBLE = a.{m}::DOUBLE THEN 'Equal' ELSE 'SLM>LLM' END AS relation_{m}"
    for m in FOUR) + " FROM scored a JOIN scored2 b ON a.row_id = b.row_id)"
add("compare_models", PAIRED, "SELECT row_id, " + ", ".join(f"{r6(m + '_SLM', m + '_LLM')}, relation_{m}" for m in FOUR) + " FROM pairs")
TEXTUAL = {"f1": "CASE WHEN a.row_id % 7 > 1 THEN a.f1 END"}
add("compare_text_metrics", SCORED + "," + OTHER + ",\npairs AS (SELECT a.row_id, " + ", ".join(
    f"{TEXTUAL.get(m, 'a.' + m)}::DOUBLE AS {m}_SLM, b.{m}::DOUBLE AS {m}_LLM" for m in FOUR) + " FROM scored a JOIN scored2 b ON a.row_id = b.row_id)",
    "SELECT row_id, " + ", ".join(f"{r6(m + '_SLM', m + '_LLM')}, CASE WHEN {m}_SLM IS NULL OR {m}_LLM IS NULL THEN 'Unknown' WHEN {m}_LLM > {m}_SLM THEN 'LLM>SLM' WHEN {m}_LLM = {m}_SLM THEN 'Equal' ELSE 'SLM>LLM' END AS relation_{m}" for m in FOUR) + " FROM pairs")
add("metric_table", PAIRED, " UNION ALL ".join(
    f"SELECT row_id, '{m}' AS metric, {r6(m + '_SLM AS slm', m + '_LLM AS llm')}, relation_{m} AS relation FROM pairs" for m in FOUR))
WINS = lambda v: " + ".join(f"(relation_{m} = '{v}')::INT" for m in FOUR)
add("comparison_summary", PAIRED + f""",
won AS (SELECT *, {WINS('LLM>SLM')} AS llm_wins_count, {WINS('Equal')} AS equal_count, {WINS('SLM>LLM')} AS slm_wins_count FROM pairs)""",
    "SELECT row_id, " + ", ".join(f"relation_{m}" for m in FOUR) + """, llm_wins_count, equal_count, slm_wins_count,
  'LLM_' || llm_wins_count || '_Equal_' || equal_count || '_SLM_' || slm_wins_count AS overall_pattern FROM won""")
add("relation_distribution", PAIRED, " UNION ALL ".join(
    f"SELECT '{m}' AS metric, {i} AS position, '{v}' AS comparison_type, count(*) FILTER (relation_{m} = '{v}') AS count FROM pairs"
    for m in FOUR for i, v in enumerate(("LLM>SLM", "Equal", "SLM>LLM", "Unknown"))))
add("accuracy_breakdown", PAIRED, """
SELECT count(*) FILTER (exact_match_SLM = 1 AND exact_match_LLM = 1) AS both_correct, count(*) FILTER (exact_match_SLM = 0 AND exact_match_LLM = 1) AS only_llm_correct,
       count(*) FILTER (exact_match_SLM = 1 AND exact_match_LLM = 0) AS only_slm_correct, count(*) FILTER (exact_match_SLM = 0 AND exact_match_LLM = 0) AS both_wrong FROM pairs""")
for tag, other, source in (("SLM", "LLM", "scored"), ("LLM", "SLM", "scored2")):
    add(f"rows_won_only_by_{tag.lower()}", PAIRED, f"""
SELECT s.row_id, {text('predicted', 'predicted_types')}, {r6('inference_time')} FROM {source} s
WHERE row_id IN (SELECT row_id FROM pairs WHERE exact_match_{tag} = 1 AND exact_match_{other} = 0)""")

# --- sources, sinks, streams

add("read_results", SCORED, f"""
SELECT 'with_message_dir=' || with_message || '/context_len_dir=' || context_len AS setting, context_len, with_message, count(*) AS n,
       {r6('avg(f1) AS macro_f1')}, sum(len(predicted))::BIGINT AS labels, sum(concern_count)::BIGINT AS concerns
FROM scored GROUP BY 1, 2, 3""")
add("read_results_parquet", SCORED, f"""
SELECT context_len, with_message, count(*) AS n, {r6('avg(f1) AS macro_f1')}, sum(len(predicted))::BIGINT AS labels, sum(len(actual))::BIGINT AS shas, 0 AS skipped
FROM scored GROUP BY 1, 2""")
add("skipped_files", SCORED, """
SELECT 'precision,exact_match,hamming_loss,inference_time,concern_count' AS missing, 1::BIGINT AS files, count(*) AS rows_read FROM scored""")
add("union_with_lineage", SCORED, f"""
SELECT with_message, count(*) AS n, {r6('avg(f1) AS f1', 'avg(inference_time) AS inference_time')}, sum(len(predicted))::BIGINT AS labels FROM scored GROUP BY 1""")
add("concat_results", SCORED, f"SELECT concern_count, exact_match, count(*) AS n, {r6('avg(hamming_loss) AS hamming_loss')} FROM scored GROUP BY 1, 2")
add("summary_from_files", SCORED + "," + OTHER + f""",
runs AS (SELECT 'alpha' {RUN_ID}, * FROM scored UNION ALL SELECT 'beta' {RUN_ID}, * FROM scored2)""" + WHOLE, SUMMARY)
add("compare_from_files", PAIRED, "SELECT context_len, with_message, array_to_string(list_transform(actual, lambda t: md5(p.row_id || '|' || t)), ',') AS shas, unnest(range(CASE WHEN p.row_id % 10 = 0 THEN 2 ELSE 1 END)) AS copy, "
    + ", ".join(f"{r6(m + '_SLM', m + '_LLM')}, relation_{m}" for m in FOUR) + " FROM pairs p JOIN scored s ON s.row_id = p.row_id")
add("read_two_layouts", ATOMIC, "SELECT sha, annotated_type, masked_commit_message, md5(git_diff) AS diff_md5 FROM atomic")
add("existing_samples", ATOMIC, "SELECT sha, raw_type AS annotated_type FROM atomic WHERE raw_type = 'fix'")
add("live_macro", f"""
cases AS (
  SELECT list_filter({L}, lambda x, i: ((l_suppkey % 128) >> (i - 1)::INT) & 1 = 1) AS predicted,
         list_filter({L}, lambda x, i: ((l_partkey % 127 + 1) >> (i - 1)::INT) & 1 = 1) AS actual, l_extendedprice / 977.0::DOUBLE AS inference_time
  FROM lineitem),""" + scoring("cases", "scored"), f"SELECT concern_count, {MACRO} FROM scored GROUP BY 1")
