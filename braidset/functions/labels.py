"""Label lists: normalising, parsing, and reading a model's answer."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from braidset.schemas import LABELS

# What Unicode counts as white space around a label.
WHITESPACE = "".join(
    map(chr, (*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
)

# Texts that stand in for a missing explanation.
NO_REASONING = "No reasoning generated"
NO_REASONING_KEY = "No reasoning in response"

# White space between JSON tokens.
JSON_SPACE = " \t\n\r"

_STRICT_JSON = {"allowSingleQuotes": "false"}


def label_array() -> Column:
    return F.array(*[F.lit(x) for x in LABELS])


def empty_labels() -> Column:
    return F.array().cast("array<string>")


def normalize_type(col: Column) -> Column:
    return F.btrim(F.lower(col), F.lit(WHITESPACE))


def parse_labels(col: Column) -> Column:
    """JSON or Python list text to an array; NULL, empty and broken text give ``[]``."""
    return F.coalesce(F.from_json(col, "array<string>"), empty_labels())


def parseable_labels(col: Column) -> Column:
    return F.from_json(col, "array<string>").isNotNull()


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` worked out once a row, however often ``of`` uses it, in conditions too."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _sole_types(text: Column) -> Column:
    """``types`` of a text that starts and ends with braces and is one object; NULL if it is not.

    The reader stops behind the first complete value. A text with no other brace can hold no second object. As
    the only entry of a list, an object with more behind it is either broken or not the only one.
    """
    plain = (F.locate("{", text, 2) == 0) & (F.locate("}", text) == F.length(text))
    at_once = F.from_json(text, "struct<types:array<string>>", _STRICT_JSON)["types"]
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<struct<types:array<string>>>", _STRICT_JSON)
    return F.when(plain, at_once).otherwise(once(listed, lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0))["types"])))


def _types_of(text: Column) -> Column:
    return F.filter(_sole_types(text), lambda x: x.isNotNull())


def outer_object(text: Column) -> Column:
    """The text from the first ``{`` to the last ``}``, NULL when there is none."""
    start = F.locate("{", text)
    tail = F.locate("}", F.reverse(text))
    end = F.length(text) - tail + 1
    return F.when(
        (start > 0) & (tail > 0) & (end > start), F.substring(text, start, end - start + 1)
    )


def parse_type_response(text: Column) -> Column:
    """Labels of the answer's object, which may stand in prose; anything else gives ``[]``.

    A text that is an object is its own outer object, so one parse serves both.
    """
    return once(outer_object(text), lambda x: F.coalesce(_types_of(x), empty_labels()))


def valid_response(text: Column) -> Column:
    """True when the answer is one object that holds only ``types``, all of them known."""
    trimmed = F.btrim(text, F.lit(JSON_SPACE))

    def valid(x: Column) -> Column:
        known = F.size(F.array_except(_sole_types(x), label_array())) == 0
        # Most answers that are no object at all are told by their first sign.
        return F.when(x.startswith("{"), (F.json_object_keys(x) == F.array(F.lit("types"))) & known)

    return F.coalesce(once(trimmed, valid), F.lit(False))


def parse_reasoning_response(text: Column) -> Column:
    parsed = F.try_parse_json(text)
    reasoning = F.try_variant_get(parsed, "$.reasoning", "string")
    strip = lambda c: F.btrim(c, F.lit(WHITESPACE))
    return (
        F.when(text.isNull() | (text == ""), F.lit(NO_REASONING))
        .when(parsed.isNull(), strip(text))
        .when(reasoning.isNull(), F.lit(NO_REASONING_KEY))
        .otherwise(strip(reasoning))
    )


def joined(col: Column, sep: str = ", ") -> Column:
    return F.array_join(F.array_sort(col), sep)
