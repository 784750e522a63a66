"""Small tables with nulls, empty and long texts, ties, repeated rows, and columns of clashing names."""

import random

from pyspark.sql import functions as F

CLASHES = ("hash", "bytes", "fp", "size", "label", "key", "count", "rank", "start", "ids", "score", "anchor", "gram", "_id", "kind", "node", "uid")


def texts():
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "Éclair", "fünf", "the", "of", "and", "x1", "7", "it's", "日本語", "."]
    some = [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(24)]
    passage = " ".join(r.choice(words) for _ in range(70))
    return [
        None, "", "   \n\t ", "one", "a b", "a b c", *some, some[0], some[0], some[1] + " tail", passage, "head " + passage, passage + " end\n" + passage,
        "mail jo.x@ex.com, +1 (988) 555-2485 and 10.0.0.255 or 4111 1111 1111 1111", "aaaa" * 2000, " ".join(some) * 3, "line\nline\n\nline two\nline", "<|endoftext|> \x00\x01 é́",
    ]


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    source = [None, "s1", "s1", "s2", "s1", "s3"]
    data = [(None if i == 5 else 3 if i == 4 else i, t, [None, "en", "de"][i % 3], source[i % 6], None if t is None else len(t)) for i, t in enumerate(rows)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def labels(spark, name="toxic", flags=None):
    flags = [(i, i % 2) for i in range(30)] if flags is None else flags
    return spark.createDataFrame([*flags, (None, 1), (4, None)], f"doc_id long, {name} int")


def rows(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]
