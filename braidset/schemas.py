"""Declared schemas and label domain. Readers use these instead of inference."""

from pyspark.sql import types as T

# The seven labels a record can carry, in their canonical order.
LABELS = ("docs", "test", "ci", "build", "refactor", "feat", "fix")

# Abbreviations used in dataset file names.
LABEL_ABBREVIATIONS = {
    "ci": "cicd",
    "bu": "build",
    "do": "docs",
    "te": "test",
    "fe": "feat",
    "fi": "fix",
    "re": "refactor",
    "st": "style",
}

# Grid of experiment settings and budgets.
CONTEXT_WINDOWS = (1024, 2048, 4096, 8192, 12288)
SHOTS = ("Zero-shot", "One-shot", "Two-shot")
SHOT_ABBREVIATIONS = {"zs": "Zero-shot", "os": "One-shot", "ts": "Two-shot"}
CONCERN_COUNTS = (1, 2, 3, 4, 5)
TOKEN_LIMIT = 12288
SAMPLES_PER_TYPE = 50
TRAIN_SHARE = 0.8
SEED = 42

# Closed upper bounds of the token ranges and their names.
TOKEN_RANGES = (
    (1024, "≤1024"),
    (2048, "1025-2048"),
    (4096, "2049-4096"),
    (8192, "4097-8192"),
    (16384, "8193-16384"),
    (32768, "16385-32768"),
    (None, ">32768"),
)


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


ATOMIC = _strings("annotated_type", "masked_commit_message", "git_diff", "sha")
EXCLUDED = _strings("sha")
TANGLED = T.StructType(
    [
        T.StructField("commit_message", T.StringType()),
        T.StructField("diff", T.StringType()),
        T.StructField("concern_count", T.IntegerType()),
        T.StructField("shas", T.StringType()),
        T.StructField("types", T.StringType()),
    ]
)
RESULTS = T.StructType(
    [
        T.StructField("predicted_types", T.StringType()),
        T.StructField("actual_types", T.StringType()),
        T.StructField("inference_time", T.DoubleType()),
        T.StructField("shas", T.StringType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("exact_match", T.BooleanType()),
        T.StructField("hamming_loss", T.DoubleType()),
        T.StructField("context_len", T.IntegerType()),
        T.StructField("with_message", T.BooleanType()),
        T.StructField("concern_count", T.IntegerType()),
    ]
)
RESULT_METRICS = ("precision", "recall", "f1", "exact_match", "hamming_loss", "inference_time")
CONFIGURATIONS = {"train": TANGLED, "test": TANGLED, "original": ATOMIC}


def assert_schema(df, expected: T.StructType):
    """Return ``df`` when it has every declared column with its declared type, else raise."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name}: wanted {f.dataType.simpleString()}, got "
        f"{have[f.name].simpleString() if f.name in have else 'nothing'}"
        for f in expected.fields
        if have.get(f.name) != f.dataType
    ]
    if wrong:
        raise ValueError("schema contract broken: " + "; ".join(wrong))
    return df
