import tiktoken
from pyspark.sql import functions as F

from braidset.functions import tokens as tok
from braidset.operators import aggregate, combine, curate, prepare


def byte_encoder_factory():
    """A tokenizer with one token per byte; local, so that it travels with the task."""

    def byte_encoder():
        ranks = {bytes([i]): i for i in range(256)}
        return tiktoken.Encoding("bytes", pat_str=r"[\s\S]", mergeable_ranks=ranks, special_tokens={})

    return byte_encoder


def test_range_edges(spark):
    edges = [1024, 1025, 2048, 2049, 4096, 4097, 8192, 8193, 16384, 16385, 32768, 32769]
    names = ["≤1024", "1025-2048", "2049-4096", "4097-8192", "8193-16384", "16385-32768", ">32768"]
    want = [names[(i + 1) // 2] for i in range(len(edges))]
    df = spark.createDataFrame([(e,) for e in edges], "n int")
    assert [r.v for r in df.orderBy("n").select(tok.token_range(F.col("n")).alias("v")).collect()] == want


def _cut(spark, diffs, context, message, flag):
    df = spark.createDataFrame([(message, diffs)], "commit_message string, diff array<string>")
    return prepare.add_truncated(df, context, flag).first()


def test_truncation_cases(spark):
    head = "- given commit diff: \n "
    assert _cut(spark, ["abcdefgh", "xy"], 2, "", False).truncated_commit == head + "abcd\nxy"
    row = _cut(spark, ["abcdefgh"], 2, "m" * 12, True)
    assert row.truncated_commit == "- given commit message:\n " + "m" * 12 + "\n Diff: "
    assert row.token_length == len(row.truncated_commit) // 4 > 2
    assert _cut(spark, [], 100, "", False).truncated_commit == head
    assert _cut(spark, None, 100, None, True).truncated_commit == "- given commit message:\n \n Diff: "


def test_truncation_reads_text_lists(spark):
    df = spark.createDataFrame([("m", '["abcdefgh", "xy"]')], "commit_message string, diff string")
    assert prepare.add_truncated(df, 2, False).first().truncated_commit.endswith("abcd\nxy")


def test_encoder(spark):
    byte_encoder = byte_encoder_factory()
    df = spark.createDataFrame([(1, "mm", ["abcdef", "xy"]), (2, "m" * 9, ["abc"])], "id int, commit_message string, diff array<string>")
    got = {r.id: r for r in prepare.add_truncated_by_encoder(df, 8, True, byte_encoder).collect()}
    assert got[1].truncated_commit == "- given commit message:\n mm\n Diff: abc\nxy"
    assert got[2].truncated_commit == "- given commit message:\n " + "m" * 9 + "\n Diff: "
    assert got[1].token_length == len(got[1].truncated_commit)
    counts = spark.createDataFrame([("é",), (None,)], "t string").select(tok.encoder_count(F.col("t"), byte_encoder).alias("n"))
    assert [r.n for r in counts.collect()] == [2, None]


def threes():
    """Three characters a token, and some texts are refused; local, so that it travels with the task."""

    class Threes:
        def encode(self, text):
            if "\x00" in text:
                raise ValueError("refused")
            return [text[i : i + 3] for i in range(0, len(text), 3)]

        def decode(self, ids):
            return "".join(ids)

    return lambda: Threes()


def test_grid_by_a_tokenizer(spark):
    """Every setting against one at a time; no text is shuffled; refused texts count by characters."""
    rows = [(1, "mm", ["abcdefgh" * 9, None, "xy"]), (2, None, []), (3, "m" * 90, None), (4, "a", ["\x00" * 40, "q" * 40]), (5, "", [""])]
    df = spark.createDataFrame(rows, "id int, commit_message string, diff array<string>")
    grid = prepare.truncated_grid(df, (4, 20, 1000), (True, False), threes())
    assert "Exchange" not in grid._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.context_len, r.with_message): (r.truncated_commit, r.token_length) for r in grid.collect()}
    assert len(got) == 30

    def first(text, n):
        return text[: 4 * n] if "\x00" in text else text[: 3 * n]

    for id_, message, diffs in rows:
        for context in (4, 20, 1000):
            for flag in (True, False):
                left = max(0, context - -(-len(message or "") // 3)) if flag else context
                cut = "\n".join(first(d, left // len(diffs)) for d in diffs if d is not None) if diffs and left else ""
                want = f"- given commit message:\n {message or ''}\n Diff: {cut}" if flag else f"- given commit diff: \n {cut}"
                n = len(want) // 4 if "\x00" in want else -(-len(want) // 3)
                assert got[id_, context, flag] == (want, n), (id_, context, flag)
    one = prepare.add_truncated_by_encoder(df, 20, True, threes())
    assert one.columns == [*df.columns, "truncated_commit", "token_length"]
    assert {r.id: r.truncated_commit for r in one.collect()} == {k[0]: v[0] for k, v in got.items() if k[1:] == (20, True)}


def test_operators_take_a_tokenizer(spark):
    count = tok.encoder_counter(threes())
    pool = spark.createDataFrame([(f"m{i}", "x" * i, f"s{i}", "feat" if i % 2 else "fix") for i in range(12)], "masked_commit_message string, git_diff string, sha string, annotated_type string")
    kept = curate.within_token_limit(pool, 3, count=count)
    assert sorted(r.git_diff for r in kept.collect()) == ["x" * i for i in range(7)]
    none = pool.select("sha").limit(0)
    taken = curate.curate(pool, none, pool.limit(0), target=3, limit=3, count=count)
    assert taken.count() == 6 and taken.agg(F.max(F.length("git_diff"))).first()[0] <= 6
    counts = {r.step: r["count"] for r in curate.curation_counts(pool, none, none, 3, count).collect()}
    assert counts == {"kept": 7, "over_limit": 5}
    table = aggregate.token_table(pool, "git_diff", "sha", count)
    assert {r.row_idx: r.token_count for r in table.collect()} == {f"s{i}": -(-i // 3) for i in range(12)}
    records = curate.rename_select(pool).withColumn("split", F.lit("train"))
    cases = combine.combine_to_target(records, 100, counts=(2,), limit=2, count=count).cases.collect()
    want = {(i, j) for i in range(0, 12, 2) for j in range(1, 12, 2) if -(-i // 3) + -(-j // 3) <= 2}
    assert {tuple(sorted((int(s[1:]) for s in c.shas), key=lambda n: (n % 2, n))) for c in cases} == want
    assert combine.choose_cases(records, counts=(1,), limit=2, count=count).report.first().token_rejected == 5


def test_grid_size_and_single_truncation(spark):
    df = spark.createDataFrame([("m", ["abc"])], "commit_message string, diff array<string>")
    grid = prepare.experiment_grid(df)
    assert grid.count() == 30
    assert grid.select("shot", "context_len", "with_message").distinct().count() == 30


def test_prompts(spark):
    p = prepare.Prompts("S", [("m1", "<commit_diff>1"), ("m2", "<commit_diff>2")])
    assert p.text("Zero-shot", True) == "S"
    assert p.text("One-shot", False) == "S\n\n# Examples\n<commit_diff>1"
    assert p.text("odd", True) == p.text("Two-shot", True)
    assert p.text("Two-shot", True).count("<commit_message>") == 2
    df = spark.createDataFrame([("Two-shot", False), ("Zero-shot", True)], "shot string, with_message boolean")
    got = {r.shot: (r.examples_count, r.has_message) for r in prepare.prompt_stats(prepare.with_prompt(df, p)).collect()}
    assert got == {"Two-shot": (2, False), "Zero-shot": (0, False)}


def test_chat(spark):
    df = spark.createDataFrame([("msg", '["d"]', '["feat"]')], "commit_message string, diff string, types string")
    row = prepare.render_chat(prepare.chat_messages(df, "sys")).first()
    assert [m.role for m in row.messages] == ["system", "user", "assistant"]
    assert row.messages[1].content == '- given commit message:\n msg\n Diff: ["d"]'
    assert row.messages[2].content == '{"types":["feat"]}'
    assert row.text.startswith("<|im_start|>system<|im_sep|>sys<|im_end|><|im_start|>user")


def test_histogram_of_nothing(spark):
    empty = spark.createDataFrame([], "row_idx bigint, token_count int, token_range string")
    rows = aggregate.token_histogram(empty).collect()
    assert len(rows) == 7 and {(r["count"], r.percentage) for r in rows} == {(0, 0.0)}


def test_published_histogram(spark):
    """210 counts with the published shares per range."""
    counts = [500] * 103 + [1500] * 51 + [3000] * 32 + [5000] * 22 + [9000] * 2
    df = spark.createDataFrame(list(enumerate(counts)), "row_idx bigint, token_count int")
    hist = aggregate.token_histogram(df.withColumn("token_range", tok.token_range(F.col("token_count"))))
    assert [r.percentage for r in hist.orderBy("position").collect()] == [49.0, 24.3, 15.2, 10.5, 1.0, 0.0, 0.0]


def test_token_stats(spark):
    counts = [5, 1, 9, 4, 1000, 4]
    stats = aggregate.token_stats(spark.createDataFrame([(c,) for c in counts], "token_count int")).first()
    assert tuple(stats) == (6, 4, 170, 1, 1000)
    assert tuple(aggregate.token_stats(spark.createDataFrame([], "token_count int")).first()) == (0, None, None, None, None)


def test_levels_as_rows(spark):
    """A product of a thousand levels with three, in rows, none of them in one list."""
    df = spark.range(3000).select((F.col("id") % 1000).cast("int").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    grid = aggregate.level_product(df.unionByName(spark.createDataFrame([(None, None)], df.schema)), "a", "b")
    assert grid.dtypes == [("a", "int"), ("b", "double")] and grid.distinct().count() == grid.count() == 3000
    table = aggregate.level_table(df, ("b", "a")).where("column = 'a'").orderBy("position").collect()
    assert [(r.position, r.level) for r in table] == [(i, float(i)) for i in range(1000)]
    assert aggregate.level_product(df.limit(0), "a", "b").isEmpty()


def test_cuts_leave_the_worker_in_steps(spark, monkeypatch):
    """A batch's cuts, many times its texts, are never one array."""
    monkeypatch.setattr(tok, "STEP_CHARS", 100)
    sent = list(tok.in_steps(iter([["x" * 60] * 2] * 5 + [["y"]] * 3)))
    assert [len(a) for a in sent] == [1, 1, 1, 1, 1, 3] and [len(a) for a in tok.in_steps(iter([]))] == [0]
    df = spark.range(50).select("id", F.lit("m").alias("commit_message"), F.array(F.lit("q" * 40)).alias("diff")).coalesce(1)
    grid = prepare.truncated_grid(df, (4, 20), (True, False), threes())
    assert grid.count() == 200 and grid.select("id").distinct().count() == 50
