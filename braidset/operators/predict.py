"""Run a user's batch classifier over a table of texts."""

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, types as T


def predict(
    df: DataFrame, text: str, fn: Callable[[list[str]], list[list[str]]], batch: int = 64
) -> DataFrame:
    """Add ``predicted_types``, ``inference_time`` (seconds per row) and ``success``.

    ``fn`` gets up to ``batch`` texts and returns a label list for each. When it
    raises, the batch is tried again row by row, so one bad row fails alone: it
    gets no labels, no time and ``success`` false.
    """
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("predicted_types", T.ArrayType(T.StringType())),
            T.StructField("inference_time", T.DoubleType()),
            T.StructField("success", T.BooleanType()),
        ]
    )

    def timed(texts):
        start = time.perf_counter()
        labels = [list(map(str, one)) for one in fn(texts)]
        if len(labels) != len(texts):
            raise ValueError("classifier returned a different number of rows")
        return labels, (time.perf_counter() - start) / len(texts)

    def one_by_one(texts):
        for t in texts:
            try:
                (labels,), seconds = timed([t])
                yield labels, seconds, True
            except Exception:
                yield [], None, False

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            texts = ["" if t is None else t for t in frame[text]]
            for i in range(0, len(texts), batch):
                some = texts[i : i + batch]
                try:
                    labels, seconds = timed(some)
                    out += [(one, seconds, True) for one in labels]
                except Exception:
                    out += one_by_one(some)
            frame["predicted_types"] = pd.Series([o[0] for o in out], index=frame.index, dtype=object)
            frame["inference_time"] = pd.Series([o[1] for o in out], index=frame.index, dtype="float64")
            frame["success"] = pd.Series([o[2] for o in out], index=frame.index, dtype=bool)
            yield frame

    return df.mapInPandas(run, schema)
