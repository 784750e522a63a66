import pytest
from pyspark.sql import functions as F

from braidset.functions import labels as L
from braidset.operators import aggregate, score

CASES = [
    (["feat", "fix"], ["feat", "fix"], 1.0, 1.0, 1.0, True, 0.0),
    (["fix", "feat"], ["feat", "fix"], 1.0, 1.0, 1.0, True, 0.0),
    (["feat", "test"], ["feat", "fix"], 0.5, 0.5, 0.5, False, 2 / 7),
    (["docs", "test"], ["feat", "fix"], 0.0, 0.0, 0.0, False, 4 / 7),
    ([], ["feat", "fix"], 0.0, 0.0, 0.0, False, 2 / 7),
    ([], [], 0.0, 0.0, 0.0, True, 0.0),
    (["feat", "junk"], ["feat"], 1.0, 1.0, 1.0, False, 0.0),
    (["feat", "feat"], ["feat"], 1.0, 1.0, 1.0, False, 0.0),
    (None, ["feat"], 0.0, 0.0, 0.0, False, 1 / 7),
    (["feat"], ["feat", "feat", "fix"], 1.0, 0.5, 2 / 3, False, 1 / 7),
]


def test_metric_cases(spark):
    rows = [(i, p, a) for i, (p, a, *_) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "row_id int, predicted_types array<string>, actual_types array<string>")
    got = {r.row_id: r for r in score.score(df).collect()}
    for i, (p, a, precision, recall, f1, exact, hamming) in enumerate(CASES):
        r = got[i]
        assert (r.precision, r.recall, r.exact_match) == (precision, recall, exact), CASES[i]
        assert r.f1 == pytest.approx(f1) and r.hamming_loss == pytest.approx(hamming)
        assert r.concern_count == len(a)
        known = set(a) & set(L.LABELS)
        assert r.tp + r.fn == len(known)


def test_macro_needs_its_columns(spark):
    with pytest.raises(ValueError, match="missing columns"):
        aggregate.macro_metrics(spark.range(1))


def test_evaluation_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "Case_Precision double, Case_Recall double, Case_F1 double")
    assert tuple(score.evaluation_metrics(empty).first()) == (0, 0.0, 0.0, 0.0)


RESPONSES = [
    ('{"types":["feat","fix"]}', ["feat", "fix"]),
    ('Sure: {"types":["ci"]} done', ["ci"]),
    ('{"types":"feat"}', []),
    ('{"other":1}', []),
    ("junk {", []),
    ("", []),
    (None, []),
    ("{'types': ['feat']}", []),
    ('{"types":["feat", 3]}', ["feat", "3"]),
    # the outer object is not one object
    ('{"types":["a"]} {"types":["b"]}', []),
    # read more leniently than a strict parser would
    ('{"types":[null,"x"]}', ["x"]),
]


def test_responses(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(RESPONSES)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", L.parse_type_response(F.col("t")).alias("p")).collect()}
    assert [got[i] for i in range(len(RESPONSES))] == [w for _, w in RESPONSES]


def test_contract(spark):
    texts = ['{"types":["feat"]}', '{"types":["junk"]}', '{"types":["feat"],"x":1}', "no", '{"types":"feat"}', None, '{"types":[]}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in df.orderBy("i").select(L.valid_response(F.col("t")).alias("v")).collect()]
    assert got == [True, False, False, False, False, False, True]


def test_reasoning(spark):
    texts = ['{"reasoning": " a "}', "{}", " plain ", "", None]
    want = ["a", L.NO_REASONING_KEY, "plain", L.NO_REASONING, L.NO_REASONING]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.v for r in df.orderBy("i").select(L.parse_reasoning_response(F.col("t")).alias("v")).collect()] == want


def test_label_texts(spark):
    texts = ['["feat"]', "['feat', 'ci']", "[]", None, "broken", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in df.orderBy("i").select(L.parse_labels(F.col("t")).alias("v")).collect()]
    assert got == [["feat"], ["feat", "ci"], [], [], [], []]


def test_normalize(spark):
    df = spark.createDataFrame([("\t FEAT\n",), (" Docs ",)], "t string")
    assert [r.v for r in df.select(L.normalize_type(F.col("t")).alias("v")).collect()] == ["feat", "docs"]


def test_answers_are_one_object(spark):
    texts = ['{"types":["a"]} {"types":["b"]}', '{"types":["feat"]} junk', ' {"types":["feat"]} ', 'Sure: {"types":["ci"]} done', '{"types":["feat"]},{"types":["fix"]}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    got = [(r.p, r.v) for r in df.select(L.parse_type_response(F.col("t")).alias("p"), L.valid_response(F.col("t")).alias("v")).collect()]
    assert got == [([], False), (["feat"], False), (["feat"], True), (["ci"], False), ([], False)]
