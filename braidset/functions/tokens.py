"""Token counts, ranges and budget truncation.

The native counter is four characters to a token, which stays inside code
generation. A real tokenizer can be plugged in through ``encoder_count`` and
``encoder_cuts`` (Arrow batches, one encoder per Python worker).
"""

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from braidset.schemas import TOKEN_RANGES

CHARS_PER_TOKEN = 4
# Cuts go back to Spark once their texts hold about as many characters together.
STEP_CHARS = 4 << 20


def tokens_of(chars: Column) -> Column:
    return F.floor(chars / CHARS_PER_TOKEN).cast("int")


def token_count(text: Column) -> Column:
    return tokens_of(F.length(text))


def first_tokens(text: Column, n: Column) -> Column:
    return F.left(text, n * CHARS_PER_TOKEN)


def token_range(count: Column) -> Column:
    (top, name), *rest = TOKEN_RANGES
    chain = F.when(count <= top, F.lit(name))
    for top, name in rest:
        chain = chain.otherwise(F.lit(name)) if top is None else chain.when(count <= top, F.lit(name))
    return chain


def truncate_equally(diffs: Column, budget: Column) -> Column:
    """Give each text the same share of ``budget`` tokens, cut it there, join with newlines."""
    n = F.size(diffs)
    share = F.floor(budget / F.greatest(n, F.lit(1))).cast("int")
    cut = F.array_join(F.transform(diffs, lambda d: first_tokens(d, share)), "\n")
    return F.when((budget <= 0) | diffs.isNull() | (n == 0), F.lit("")).otherwise(cut)


_ENCODERS: dict = {}


def _encoder(factory: Callable):
    # Closures of one function share its name: what they hold tells them apart.
    key = cloudpickle.dumps(factory)
    if key not in _ENCODERS:
        _ENCODERS[key] = factory()
    return _ENCODERS[key]


def _count(encoder, text: str) -> int:
    """Tokens of ``text``; one the encoder rejects falls back to characters."""
    try:
        return len(encoder.encode(text))
    except Exception:
        return len(text) // CHARS_PER_TOKEN


def encoder_count(text: Column, factory: Callable) -> Column:
    """Tokens by ``factory().encode``; a row the encoder rejects falls back to characters."""

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        encoder = _encoder(factory)
        return pa.array([None if t is None else _count(encoder, t) for t in texts.to_pylist()], pa.int32())

    return count(text)


def encoder_counter(factory: Callable) -> Callable[[Column], Column]:
    """A counter for the operators that take one, instead of ``token_count``."""
    return lambda text: encoder_count(text, factory)


class _Cutter:
    """A text's first tokens at many lengths, from encoding it once."""

    def __init__(self, encoder, text: str):
        self.encoder, self.text = encoder, text
        try:
            self.ids = encoder.encode(text)
        except Exception:
            self.ids = None

    def first(self, n: int) -> str:
        if self.ids is None:
            return self.text[: n * CHARS_PER_TOKEN]
        return self.text if n >= len(self.ids) else self.encoder.decode(self.ids[:n])


def encoder_cuts(message: Column, diffs: Column, settings: Sequence[tuple[int, bool]], factory: Callable) -> Column:
    """For each (context, include message) of ``settings`` the diffs cut to equal shares of the budget, joined with newlines.

    One pass over the row's texts: each diff is encoded once, however many settings there are, and a cut that
    several settings share is made once. The message's tokens come off the budget where it is included. A batch's
    cuts, many times its texts, leave the worker in steps of ``STEP_CHARS``.
    """
    settings = list(settings)

    def cut_row(encoder, message, texts) -> list[str]:
        taken = _count(encoder, message or "") if any(flag for _, flag in settings) else 0
        cutters = [_Cutter(encoder, t) for t in texts or [] if t is not None]
        made: dict[int, str] = {}
        row = []
        for context, flag in settings:
            budget = max(context - taken, 0) if flag else context
            share = budget // len(texts) if texts else 0
            if budget <= 0 or not texts:
                row.append("")
                continue
            if share not in made:
                made[share] = "\n".join(c.first(share) for c in cutters)
            row.append(made[share])
        return row

    @F.arrow_udf("array<string>")
    def cuts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encoder = _encoder(factory)
        for messages, lists in batches:
            yield from in_steps(cut_row(encoder, m.as_py(), t.as_py()) for m, t in zip(messages, lists))

    return cuts(message, diffs)


def in_steps(rows: Iterator[list], kind: pa.DataType = pa.string()) -> Iterator[pa.Array]:
    """The rows as arrays whose texts hold about ``STEP_CHARS`` together, one row at least; one empty array for no rows."""
    out, chars, sent = [], 0, False
    for row in rows:
        out.append(row)
        chars += sum(map(len, row))
        if chars >= STEP_CHARS:
            yield pa.array(out, pa.list_(kind))
            out, chars, sent = [], 0, True
    if out or not sent:
        yield pa.array(out, pa.list_(kind))
