"""Headers as a table, committed runs of logs, and pairing of logs without row ids."""

import gzip
import io
import random
import shutil
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Observation, functions as F

from braidset import schemas
from braidset.operators import compare
from braidset.plans import reports
from braidset.sources import headers, logs, readers, sinks
from test_tables import HEADER, scored, write


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def test_a_header_costs_one_block():
    stream = Counting(b'a,"b\n, c"\n' + b"1,2\n" * 10_000_000)
    assert headers.record_names(headers.first_record(stream)) == ["a", "b\n, c"]
    assert stream.taken == headers.BLOCK
    wide = ",".join(f"c{i}" for i in range(40_000))
    assert len(headers.record_names(headers.first_record(io.BytesIO(wide.encode() + b"\r\nx")))) == 40_000
    assert headers.first_record(io.BytesIO(b"")) is None and headers.record_names(None) == []
    assert headers.record_names(headers.first_record(io.BytesIO(b"\xef\xbb\xbfa , b"))) == ["a", "b"]


def test_header_table(spark, tmp_path):
    root = tmp_path / "odd dir%20 é"
    write(str(root / "one.csv"), 'x,"y, z"\n1,2\n')
    write(str(root / "sub" / "empty.csv"), "")  # Spark lists no files without bytes
    with gzip.open(root / "sub" / "packed.csv.gz", "wt") as f:
        f.write("p,q\n1,2\n")
    files = headers.listed(spark, str(root), recursive=True)
    got = {r.path.rsplit("/", 1)[1]: r.columns for r in headers.header_table(files, str(root), recursive=True).collect()}
    assert got == {"one.csv": ["x", "y, z"], "packed.csv.gz": ["p", "q"]}
    slow = {r.path.rsplit("/", 1)[1]: r.columns for r in headers._through_spark(spark, files, str(root), True).collect()}
    assert got == slow
    spark.range(3).withColumn("b c", F.lit(1)).coalesce(1).write.parquet(str(root / "t"))
    files = headers.listed(spark, str(root / "t"))
    assert [r.columns for r in headers.header_table(files, str(root / "t"), "parquet").collect()] == [["id", "b c"]]


def test_many_layouts_of_logs(spark, tmp_path):
    """Columns by name and type whatever their order and number; texts with breaks and quotes stay whole."""
    root = tmp_path / "logs"
    names = schemas.RESULTS.fieldNames()
    value = dict(predicted_types='["feat"]', actual_types='["feat","ci"]', inference_time="1.5", shas='["a","b"]', precision="1.0", recall="0.5", f1="0.66", exact_match="False", hamming_loss="0.14", context_len="1024", with_message="true", concern_count="2", note='line\n"two"')
    quote = lambda x: '"' + x.replace('"', '""') + '"'
    r = random.Random(1)
    for i in range(6):
        order = names + ["note"] * (i % 2)
        r.shuffle(order)
        write(str(root / f"d{i}" / f"m{i}_x.csv"), ",".join(order) + "\n" + (",".join(quote(value[c]) for c in order) + "\n") * (i + 1))
    rows, skipped = readers.read_results(spark, str(root))
    assert skipped.isEmpty() and Counter(x.source_file for x in rows.collect()) == {f"m{i}_x.csv": i + 1 for i in range(6)}
    (one,) = rows.select(*names).distinct().collect()
    assert one.asDict() == dict(predicted_types=["feat"], actual_types=["feat", "ci"], inference_time=1.5, shas=["a", "b"], precision=1.0, recall=0.5, f1=0.66, exact_match=False, hamming_loss=0.14, context_len=1024, with_message=True, concern_count=2)
    assert {x.model for x in reports.with_model(rows, str(root)).collect()} == {f"d{i}" for i in range(6)}


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_runs_count_once(spark, tmp_path, fmt):
    root = str(tmp_path / "runs")
    df = scored(spark)
    read = lambda: sorted((r.inference_time, r.predicted_types) for r in readers.read_results(spark, root, fmt=fmt)[0].collect())
    sinks.append_results(df, root, fmt, by=["context_len"], run="a")
    once = read()
    assert len(once) == 3
    sinks.append_results(df, root, fmt, run="a")
    assert read() == once
    # A try that broke off after writing files, before its line in the manifest.
    sinks.append_results(df, str(tmp_path / "other"), fmt, run="a")
    shutil.copytree(tmp_path / "other" / "run=a" / "attempt=0", f"{root}/run=a/attempt=2")
    assert read() == once
    sinks.append_results(df.limit(1), root, fmt, run="a")
    assert len(read()) == 1
    sinks.append_results(df, root, fmt, run="b.2")
    assert len(read()) == 4
    with pytest.raises(ValueError, match="named"):
        sinks.append_results(df, root, fmt, run="../up")
    assert logs.committed(spark, str(tmp_path / "none")) is None


def test_parquet_logs_need_no_manifest(spark, tmp_path):
    root = str(tmp_path / "plain")
    sinks.append_results(scored(spark), f"{root}/x", "parquet")
    sinks.append_results(scored(spark), f"{root}/x", "parquet")
    spark.range(2).write.parquet(f"{root}/y")
    rows, skipped = readers.read_results(spark, f"{root}/x", fmt="parquet")
    assert rows.count() == 6 and skipped.isEmpty()
    with pytest.raises(ValueError, match="required"):
        readers.read_results(spark, f"{root}/y", fmt="parquet")


def test_logs_pair_one_to_one(spark):
    """Against numbering each key's rows in the order of their metrics; one key holds a third of all rows."""
    r = random.Random(5)
    make = lambda n: [(r.choice([1024, 1024, None, 2048]), r.random() < 0.5, [f"s{min(r.randrange(9), 3)}"], r.choice([0.0, 0.5, 1.0]), 0.5, r.choice([None, 0.5]), r.random() < 0.5) for _ in range(n)]
    schema = "context_len int, with_message boolean, shas array<string>, precision double, recall double, f1 double, exact_match boolean"
    a, b = make(300), make(260)
    counts = Observation()
    got = compare.pair_logs(spark.createDataFrame(a, schema).repartition(4), spark.createDataFrame(b, schema), counts=counts).collect()
    groups = defaultdict(lambda: ([], []))
    for side, rows in enumerate((a, b)):
        for c, m, s, *metrics in rows:
            groups[c, m, tuple(s)][side].append(tuple(-1.0 if x is None else float(x) for x in metrics))
    want = Counter()
    for key, (x, y) in groups.items():
        for i, (p, q) in enumerate(zip(sorted(x), sorted(y))):
            want[(*key, i, *p, *q)] += 1
    flat = Counter((x.context_len, x.with_message, tuple(x.shas), x.copy, *(-1.0 if v is None else v for v in x[4:])) for x in got)
    assert flat == want and max(want.values()) == 1
    assert counts.get == {"pairs": len(got), "repeats": sum(x.copy > 0 for x in got)}
    assert compare.compare_models(compare.pair_logs(spark.createDataFrame(a, schema).limit(0), spark.createDataFrame(b, schema))).isEmpty()


def test_log_files_are_told_without_a_pattern(spark):
    """The test runs on every row of a log: it is two suffixes, and the folder if one is named."""
    names = ["/r/a.csv", "/r/a_macro.csv", "/r/a_macro_by_concern.csv", "/r/_macro.csv", "/r/a_macro.csv.gz", "/r/analysis/b.csv", "/r/analysis.csv"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    kept = df.where(readers._log_files(F.col("path"), "csv", "analysis"))
    assert [r.path for r in kept.collect()] == ["/r/a.csv", "/r/a_macro.csv.gz", "/r/analysis.csv"]
    assert "regexp" not in kept._jdf.queryExecution().executedPlan().toString().lower()


def test_written_files_are_bounded(spark, tmp_path, monkeypatch):
    """A file with line breaks is one task's work, so that sinks cut what one task writes into files."""
    monkeypatch.setattr(sinks, "LOG_ROWS", 40)
    monkeypatch.setattr(sinks, "TEXT_ROWS", 30)
    one = scored(spark).where("row_id = 1").withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(100)))).drop("_i").coalesce(1)
    sinks.append_results(one, str(tmp_path / "logs"))
    texts = spark.range(100).coalesce(1).select(F.lit("feat").alias("annotated_type"), F.lit("m").alias("masked_commit_message"), F.lit("a\nb").alias("git_diff"), F.col("id").cast("string").alias("sha"))
    sinks.append_samples(texts, str(tmp_path / "texts"))
    cases = texts.select(F.lit("train").alias("split"), F.lit("m").alias("commit_message"), F.array("git_diff").alias("diff"), F.lit(1).alias("concern_count"), F.array("sha").alias("shas"), F.array("annotated_type").alias("types"))
    sinks.write_split(cases, str(tmp_path / "split"))
    found = readers.discover(spark, str(tmp_path))
    tables = {r.path.rsplit("/", 2)[1]: (r.n, r.bytes) for r in found.groupBy(readers.folder_of(F.col("path")).alias("path")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()}
    assert {k: n for k, (n, _) in tables.items()} == {"logs": 3, "texts": 4, "split=train": 4}
    assert {r.path.rsplit("/", 2)[1]: r.bytes for r in readers.written_tables(found).collect()} == {k: b for k, (_, b) in tables.items()}
    assert readers.read_results(spark, str(tmp_path / "logs"))[0].count() == 100
    assert readers.read_atomic(spark, str(tmp_path / "texts")).select("sha").distinct().count() == 100
    assert readers.read_tangled(spark, str(tmp_path / "split")).select("shas").distinct().count() == 100


def test_tables_in_parts(spark, monkeypatch):
    """Queries that write and read files write no table as one file, and count the parts of one folder as one."""
    from braidset.plans import registry

    root = "/root/testdata/sf0.001"
    monkeypatch.setattr(sinks, "LOG_ROWS", 20)
    monkeypatch.setattr(sinks, "TEXT_ROWS", 20)
    assert len(registry._two_files(spark, root)) > 2
    assert registry.union_with_lineage(spark, root).count() == 2
    assert [r.files for r in registry.skipped_files(spark, root).collect()] == [1]
    assert {r.configuration: (r.files, r.sizes_agree) for r in registry.manifest_with_files(spark, root).collect()} == {"train": (1, True), "test": (1, True), "original": (1, True), "extra": (0, True)}


def test_logs_pair_in_the_partitions_of_their_keys(spark):
    """One shuffle to count and one to number each side; the join needs none of its own. NULLs in a key are equal."""
    rows = [("s", 1024, None, ["a"], 0.5, 0.5, 0.5, True), ("t", None, True, None, 0.1, 0.2, 0.3, False)]
    df = spark.createDataFrame(rows, "x string, context_len int, with_message boolean, shas array<string>, precision double, recall double, f1 double, exact_match boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pairs = compare.pair_logs(df, df)
        assert pairs._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert pairs.columns[:4] == ["context_len", "with_message", "shas", "copy"] and pairs.count() == 2
