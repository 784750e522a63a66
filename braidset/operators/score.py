"""Score predicted label lists and shape the scored rows for reading."""

from pyspark.sql import Column, DataFrame, functions as F

from braidset.functions.labels import empty_labels, joined
from braidset.functions.scoring import confusion, exact_match, label_bits, metrics_from
from braidset.operators.ranking import dense_index, number_level


def score(df: DataFrame, bits: tuple[str, str] | None = None) -> DataFrame:
    """Add ``tp, fp, fn``, the metrics and ``concern_count`` to predicted and actual arrays.

    ``bits`` names columns that already hold both sets of known labels as bits; they are dropped.
    """
    p = F.coalesce("predicted_types", empty_labels())
    a = F.coalesce("actual_types", empty_labels())
    # Each set becomes bits once a row; all that follows is arithmetic on them.
    sets = {"_p": F.col(bits[0]), "_a": F.col(bits[1])} if bits else {"_p": label_bits(p), "_a": label_bits(a)}
    counted = df.withColumns(sets).withColumns(confusion(F.col("_p"), F.col("_a"))).drop("_p", "_a", *(bits or ()))
    metrics = metrics_from(F.col("tp"), F.col("fp"), F.col("fn"))
    return counted.withColumns(
        {**metrics, "exact_match": exact_match(p, a), "concern_count": F.size(a)}
    )


def is_empty_prediction(col: Column) -> Column:
    return F.coalesce(F.size(col) == 0, F.lit(True))


def drop_empty_predictions(df: DataFrame) -> DataFrame:
    return df.where(~is_empty_prediction(F.col("predicted_types")))


def empty_predictions(df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Ids of the rows without a prediction, as rows."""
    return df.where(is_empty_prediction(F.col("predicted_types"))).select(id_col)


def evaluation_view(df: DataFrame, key: str = "row_id") -> DataFrame:
    """One line per case for people to read; ``Test_Index`` counts from 1 by ``key``."""
    shown = lambda c: F.when(F.size(c) == 0, F.lit("None")).otherwise(joined(F.col(c)))
    if dict(df.dtypes)[key] == "string":
        levels = [F.substring(key, 1, 3), F.substring(key, 1, 12)]
    else:
        levels = [number_level(F.col(key), 10), number_level(F.col(key), 20)]
    indexed = dense_index(df, levels, [key], name="_at")
    return indexed.select(
        (F.col("_at") + 1).alias("Test_Index"),
        shown("predicted_types").alias("Predicted_Types"),
        shown("actual_types").alias("Actual_Types"),
        F.when(F.col("exact_match"), F.lit("Match")).otherwise(F.lit("No Match")).alias("Status"),
        F.col("precision").alias("Case_Precision"),
        F.col("recall").alias("Case_Recall"),
        F.col("f1").alias("Case_F1"),
        F.when(F.size("shas") == 0, F.lit("None")).otherwise(F.array_join("shas", ", ")).alias("SHAs"),
    )


def export_view(view: DataFrame) -> DataFrame:
    return view.drop("Case_Precision", "Case_Recall", "Case_F1")


def recent_cases(view: DataFrame, n: int = 15) -> DataFrame:
    """The last ``n`` cases that have a status, in index order."""
    last = view.dropna(subset=["Status"]).orderBy(F.desc("Test_Index")).limit(n)
    return last.select("Test_Index", "Predicted_Types", "Actual_Types", "Status", "SHAs").orderBy("Test_Index")


def evaluation_metrics(view: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return view.agg(
        F.count(F.lit(1)).alias("total"),
        zero("Case_Precision").alias("type_precision"),
        zero("Case_Recall").alias("type_recall"),
        zero("Case_F1").alias("type_f1_macro"),
    )
