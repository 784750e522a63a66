"""Compressed texts, for those that are carried to many places."""

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F

from braidset.functions.tokens import in_steps

# Higher levels take twice the time for some two hundredths less.
LEVEL = 3


def packed(text: Column) -> Column:
    """Each text compressed by itself."""

    @F.arrow_udf("binary")
    def pack(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else zlib.compress(t.as_py(), LEVEL) for t in texts], pa.binary())

    return pack(text.cast("binary"))


def unpacked(texts: Column) -> Column:
    """The texts of a list of ``packed`` ones. A batch's, several times as long, leave the worker in steps."""

    @F.arrow_udf("array<binary>")
    def unpack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield from in_steps(([zlib.decompress(t) for t in row.as_py()] for row in lists), pa.binary())

    return unpack(texts).cast("array<string>")
