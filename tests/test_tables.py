"""Sources, sinks, names, streams, predictions and comparison."""

import math
import os

import pytest
from pyspark.sql import Row, functions as F

from braidset import schemas
from braidset.operators import compare, prepare, score
from braidset.operators.aggregate import macro_by_concern
from braidset.operators.predict import predict
from braidset.sources import names, readers, sinks
from braidset.streaming import live

HEADER = ",".join(schemas.RESULTS.fieldNames())


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def atomic_rows(spark):
    rows = [
        (" FEAT ", 'say "hi", ok', 'a\n"b",c\n\nd', "s1"),
        ("fix", None, "-x\r\n+y", "s2"),
        ("docs", "ünï", "é {\"k\": [1]}", "s3"),
    ]
    return spark.createDataFrame(rows, schemas.ATOMIC)


def test_atomic_round_trip(spark, tmp_path):
    path = str(tmp_path / "atomic")
    df = atomic_rows(spark)
    assert readers.existing_samples(spark, path).isEmpty()
    sinks.append_samples(df, path)
    sinks.append_samples(df.limit(0), path)
    back = readers.read_atomic(spark, path)
    assert sorted(map(tuple, back.collect()), key=lambda r: r[3]) == sorted(map(tuple, df.collect()), key=lambda r: r[3])
    assert readers.existing_samples(spark, path).count() == 3


def test_reader_contracts(spark, tmp_path):
    bad, empty = str(tmp_path / "bad.csv"), str(tmp_path / "empty.csv")
    write(bad, "sha,git_diff\n1,x\n")
    write(empty, "annotated_type,masked_commit_message,git_diff,sha\n")
    with pytest.raises(ValueError, match="annotated_type.*masked_commit_message"):
        readers.read_atomic(spark, bad)
    with pytest.raises(ValueError, match="empty"):
        readers.read_atomic(spark, empty)
    with pytest.raises(ValueError, match="diff"):
        readers.read_tangled(spark, bad)
    with pytest.raises(ValueError, match="contract"):
        schemas.assert_schema(spark.range(1), schemas.EXCLUDED)
    assert schemas.assert_schema(atomic_rows(spark), schemas.ATOMIC) is not None


def test_columns_are_found_by_name(spark, tmp_path):
    path = str(tmp_path / "mixed order.csv")
    write(path, 'extra,types,commit_message,shas,diff,concern_count\nz,"[""feat""]",m,"[\'a\']","[""d1\\nd2""]",1\n')
    row = readers.read_tangled(spark, path).first()
    assert (row.types, row.shas, row.diff) == (["feat"], ["a"], ["d1\nd2"])


def scored(spark):
    rows = [(1, ["feat"], ["feat"], 1.5, ["a"], 1024, True), (2, [], ["fix", "ci"], 2.5, ["b", "c"], 1024, False), (3, ["ci"], ["fix"], 0.5, ["d"], 2048, True)]
    return score.score(
        spark.createDataFrame(rows, "row_id int, predicted_types array<string>, actual_types array<string>, inference_time double, shas array<string>, context_len int, with_message boolean")
    )


def test_results_scan(spark, tmp_path):
    root = str(tmp_path / "runs")
    sinks.append_results(scored(spark), f"{root}/good")
    write(f"{root}/py/model_1024_zs_msg1.csv", HEADER + "\n\"['feat', 'fix']\",\"['feat']\",1.0,\"['s']\",0.5,1.0,0.66,False,0.14,1024,True,1\n")
    write(f"{root}/other/reordered.csv", "f1,precision,recall,exact_match,hamming_loss,inference_time,concern_count,note\n0.5,0.5,0.5,true,0.1,2.0,3,hello\n")
    write(f"{root}/bad/none.csv", "a,b\n1,2\n")
    write(f"{root}/sum/x_macro.csv", HEADER + "\n")
    write(f"{root}/sum/x_macro_by_concern.csv", HEADER + "\n")
    write(f"{root}/analysis/y.csv", HEADER + "\n")
    df, skipped = readers.read_results(spark, root, "analysis")
    rows = df.collect()
    assert len(rows) == 5
    by_file = {r.source_file: r for r in rows}
    assert by_file["model_1024_zs_msg1.csv"].predicted_types == ["feat", "fix"]
    assert by_file["model_1024_zs_msg1.csv"].exact_match is False
    assert by_file["reordered.csv"].concern_count == 3 and by_file["reordered.csv"].context_len is None
    (bad,) = skipped.collect()
    assert bad.path.endswith("none.csv") and "precision" in bad.missing
    with pytest.raises(FileNotFoundError):
        readers.read_results(spark, str(tmp_path / "runs" / "bad" / ".."), "runs")


def test_lineage_and_concat(spark, tmp_path):
    a, b = str(tmp_path / "a.csv"), str(tmp_path / "b.csv")
    line = "[],[],{},[],0,0,0,true,0,1024,true,2\n"
    write(a, HEADER + "\n" + line.format(1.0))
    write(b, HEADER + "\n" + line.format(2.0) + line.format(3.0))
    u = readers.union_with_lineage(spark, [a, b], ["context_len", "inference_time"])
    assert u.columns == ["context_len", "inference_time", "source_file"]
    assert sorted((r.source_file, r.inference_time) for r in u.collect()) == [("a.csv", 1.0), ("b.csv", 2.0), ("b.csv", 3.0)]
    assert readers.concat_results(spark, [a, b]).count() == 3
    write(str(tmp_path / "c.csv"), "x\n1\n")
    with pytest.raises(ValueError, match="context_len"):
        readers.union_with_lineage(spark, [a, str(tmp_path / "c.csv")], ["context_len"])
    with pytest.raises(ValueError, match="no files"):
        readers.concat_results(spark, [])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.concat_results(spark, [str(tmp_path / "absent.csv")])


def test_discover(spark, tmp_path):
    for n in ("b/x.csv", "a/y.csv", "a/z.txt"):
        write(str(tmp_path / n), "12345")
    found = readers.discover(spark, str(tmp_path))
    assert [(r.path.rsplit("/", 2)[-2:], r.bytes) for r in found.collect()] == [(["a", "y.csv"], 5), (["b", "x.csv"], 5)]
    assert [r.file for r in readers.missing_files(found, ["x.csv", "w.csv"]).collect()] == ["w.csv"]


def test_split_round_trip(spark, tmp_path):
    cases = spark.createDataFrame(
        [("train", "m", ['d"1\n', "é"], 2, ["a", "b"], ["feat", "ci"]), ("test", "n", ["z"], 1, ["c"], ["fix"])],
        "split string, commit_message string, diff array<string>, concern_count int, shas array<string>, types array<string>",
    )
    path = str(tmp_path / "split")
    sinks.write_split(cases, path)
    back = readers.read_tangled(spark, path)
    got = {r.commit_message: (r.diff, r.concern_count, r.shas, r.types) for r in back.collect()}
    assert got == {"m": (['d"1\n', "é"], 2, ["a", "b"], ["feat", "ci"]), "n": (["z"], 1, ["c"], ["fix"])}
    assert readers.read_tangled(spark, path + "/split=test").count() == 1
    cases.write.partitionBy("split").parquet(str(tmp_path / "hub"))
    assert readers.read_parquet_split(spark, str(tmp_path / "hub"), "split=train").count() == 1


def test_document_files(spark, tmp_path):
    path = str(tmp_path / "docs")
    sinks.export_type_documents(atomic_rows(spark).where("annotated_type <> ' FEAT '"), path, "files")
    (folder,) = [d for d in os.listdir(f"{path}/type=docs")]
    assert folder == "file_name=docs_1_s3.diff"
    (part,) = [f for f in os.listdir(f"{path}/type=docs/{folder}") if f.endswith(".txt")]
    with open(f"{path}/type=docs/{folder}/{part}", encoding="utf-8") as f:
        assert f.read().startswith("# Type: docs\n# Commit Message: ünï\n# SHA: s3\n\n# === Git Diff Content ===\n\né {")


def test_resumable(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(10).withColumn("v", F.col("id") * 2)
    sinks.write_resumable(rows.where("id < 4"), path, ["id"])
    sinks.write_resumable(rows, path, ["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(10))


def test_stream_follows_new_files(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = scored(spark)
    with pytest.raises(FileNotFoundError):
        live.read_latest(spark, out)
    df.limit(2).write.mode("append").parquet(src)
    stream = live.result_stream(spark, src, df.schema, max_files=1)
    run = live.start(live.live_macro(stream), out, str(tmp_path / "ck"))
    run.processAllAvailable()
    early = live.read_latest(spark, out)
    before = early.collect()
    df.exceptAll(df.limit(2)).write.mode("append").parquet(src)
    run.processAllAvailable()
    run.stop()
    assert sorted(map(str, live.read_latest(spark, out).collect())) == sorted(map(str, macro_by_concern(df).collect()))
    # A table that a reader holds stays as it was.
    assert early.collect() == before
    again = live.start(live.live_macro(stream), out, str(tmp_path / "ck"), once=True)
    again.awaitTermination()
    assert live.read_latest(spark, out).count() == 2


def test_replayed_batches_change_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    write_ = live.publish(out)
    write_(spark.range(3), 0)
    write_(spark.range(5), 1)
    files = sorted(str(p) for p in (tmp_path / "out").rglob("*"))
    write_(spark.range(9), 1)
    write_(spark.range(9), 0)
    assert sorted(str(p) for p in (tmp_path / "out").rglob("*")) == files
    assert live.read_latest(spark, out).count() == 5
    # A version whose pointer was not written yet is not read, and is replaced by the batch that comes again.
    spark.range(1).write.parquet(f"{out}/version=2")
    assert live.read_latest(spark, out).count() == 5
    write_(spark.range(7), 2)
    assert live.read_latest(spark, out).count() == 7


def test_predict(spark):
    df = spark.createDataFrame([(i, None if i == 3 else f"t{i}") for i in range(7)], "row_id int, text string").coalesce(1)

    def classify(texts):
        if "t5" in texts:
            raise RuntimeError("refused")
        return [["feat"] if t else [] for t in texts]

    got = {r.row_id: r for r in predict(df, "text", classify, batch=4).collect()}
    assert got[5].success is False and got[5].predicted_types == [] and got[5].inference_time is None
    assert all(got[i].success and got[i].inference_time >= 0 for i in got if i != 5)
    assert got[3].predicted_types == [] and got[6].predicted_types == ["feat"]


def test_comparison(spark):
    schema = "row_id int, precision string, recall double, f1 double, exact_match boolean"
    slm = spark.createDataFrame([(1, "0.5", 0.1, 0.3, True), (2, "bad", float("nan"), 0.2, False), (3, "1", 1.0, 1.0, True)], schema)
    llm = spark.createDataFrame([(1, "0.5", 0.2, 0.1, False), (2, "0.4", 0.5, 0.2, True), (4, "1", 1.0, 1.0, True)], schema)
    pairs = compare.pair_models(slm, llm)
    got = {r.row_id: r for r in compare.compare_models(pairs).collect()}
    assert set(got) == {1, 2}
    assert (got[1].relation_precision, got[1].relation_recall, got[1].relation_f1, got[1].relation_exact_match) == ("Equal", "LLM>SLM", "SLM>LLM", "SLM>LLM")
    assert (got[2].relation_precision, got[2].relation_recall) == ("Unknown", "Unknown")
    patterns = {r.row_id: r.overall_pattern for r in compare.comparison_summary(compare.compare_models(pairs)).collect()}
    assert patterns == {1: "LLM_1_Equal_1_SLM_2", 2: "LLM_1_Equal_1_SLM_0"}
    assert tuple(compare.accuracy_breakdown(pairs).first()) == (0, 1, 1, 0)
    assert [r.row_id for r in compare.rows_won_only_by(slm, pairs, "SLM").collect()] == [1]
    none = compare.rows_won_only_by(slm, pairs.where("row_id = 2"), "SLM")
    assert none.columns == slm.columns and none.isEmpty()


def test_names(spark):
    files = ["c2_t2_s10_u_ci_bu.json", "c3_t5_s10_m_ci_bu_do_te_st.json", "other.json"]
    df = spark.createDataFrame([(f,) for f in files], "f string")
    got = {r.f: r.p for r in df.select("f", names.parse_dataset_name(F.col("f")).alias("p")).collect()}
    assert got[files[0]] == Row(concerns_per_case=2, num_types=2, num_samples=10, ensure_different_types=True, types=["cicd", "build"])
    assert got[files[1]].types[-1] == "style" and got[files[1]].ensure_different_types is False
    assert got[files[2]] is None
    runs = {
        "/r/alpha_zero/alpha-4_12288_zs_msg1.csv": ("alpha-4", 12288, "Zero-shot", True),
        "/r/beta/run7/msg0/2048_os.csv": ("run7", 2048, "One-shot", False),
        "results/diff_only/a_b_Two_shot_1024.csv": ("a_b", 1024, "Two-shot", False),
    }
    df = spark.createDataFrame([(p,) for p in [*runs, "x.csv"]], "p string")
    got = {r.p: r.n for r in df.select("p", names.parse_run_name(F.col("p")).alias("n")).collect()}
    assert {p: tuple(got[p]) for p in runs} == runs and got["x.csv"] is None


def test_small_columns(spark):
    df = spark.createDataFrame([(1, "old")], "id int, reason string")
    assert prepare.replace_column(df, "reason", F.lit("new")).first().reason == "new"
    shown = score.evaluation_view(scored(spark))
    first = shown.where("Test_Index = 2").first()
    assert (first.Predicted_Types, first.Actual_Types, first.Status, first.SHAs) == ("None", "ci, fix", "No Match", "b, c")
    assert math.isclose(score.evaluation_metrics(shown).first().type_f1_macro, 1 / 3)
    assert [r.Test_Index for r in score.recent_cases(shown, 2).collect()] == [2, 3]


def test_files_of_two_layouts_are_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("annotated_type,masked_commit_message,git_diff,sha\nfeat,m1,d1,s1\n")
    (tmp_path / "b.csv").write_text("sha,git_diff,annotated_type,masked_commit_message\ns2,d2,fix,m2\n")
    got = sorted(tuple(r) for r in readers.read_atomic(spark, str(tmp_path)).select("sha", "annotated_type", "git_diff").collect())
    assert got == [("s1", "feat", "d1"), ("s2", "fix", "d2")]
    assert readers.existing_samples(spark, str(tmp_path)).where("sha = 's2'").first().annotated_type == "fix"
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "skip.csv").write_text("id,sha\n1,s1\n2,s2\n")
    assert sorted(r.sha for r in readers.read_excluded(spark, str(tmp_path / "x")).collect()) == ["s1", "s2"]


def test_evaluation_view_by_text_key(spark):
    from braidset.operators.score import evaluation_view

    df = spark.createDataFrame([(f"k{i:03}", ["feat"], ["feat"], True, 1.0, 1.0, 1.0, ["s"]) for i in range(30)],
        "sha string, predicted_types array<string>, actual_types array<string>, exact_match boolean, precision double, recall double, f1 double, shas array<string>")
    assert sorted(r.Test_Index for r in evaluation_view(df, "sha").collect()) == list(range(1, 31))
