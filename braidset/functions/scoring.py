"""Multi-label metrics as column expressions over two label arrays."""

from pyspark.sql import Column, functions as F

from braidset.schemas import LABELS


def label_bits(labels: Column) -> Column:
    """A bit for each known label in the list; NULL for a NULL list."""
    bits = [F.when(F.array_contains(labels, x), 1 << i).otherwise(0) for i, x in enumerate(LABELS)]
    return F.when(labels.isNotNull(), sum(bits[1:], bits[0]))


def confusion(predicted_bits: Column, actual_bits: Column) -> dict[str, Column]:
    """Sizes over two sets of known labels as bits; unknown labels and repeats do not count."""
    tp = F.bit_count(predicted_bits.bitwiseAND(actual_bits))
    return {"tp": tp, "fp": F.bit_count(predicted_bits) - tp, "fn": F.bit_count(actual_bits) - tp}


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def exact_match(predicted: Column, actual: Column) -> Column:
    """Equality as multisets, over the lists as they are; sizes settle most rows."""
    return (F.size(predicted) == F.size(actual)) & (F.sort_array(predicted) == F.sort_array(actual))


def metrics_from(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    precision = ratio(tp, tp + fp)
    recall = ratio(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * precision * recall, precision + recall),
        "hamming_loss": (fp + fn) / len(LABELS),
    }
