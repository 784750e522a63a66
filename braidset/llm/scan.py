"""Words of many texts at once, by Arrow and numpy over their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts of one step hold about as many bytes together; a longer text is a step of its own.
STEP = 8 << 20


def gaps(words: str) -> np.ndarray:
    """A table over bytes: those matched by the character class ``words`` stay (A-Z as they are), others turn into spaces."""
    table = np.full(256, 0x20, np.uint8)
    for b in range(256):
        if b >= 0x80 or chr(b) in words:
            table[b] = b
    return table


def lowered(table: np.ndarray) -> np.ndarray:
    out = table.copy()
    out[(table >= 65) & (table <= 90)] += 32
    return out


class Texts:
    """The bytes of a column of texts: ``raw``, with text i from ``offsets[i]`` to ``offsets[i + 1]``. Nulls are empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.string()).fill_null("")
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        self.raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def count(self, marked: np.ndarray) -> np.ndarray:
        """How many bytes of each text the table ``marked`` holds."""
        return np.diff(np.searchsorted(np.flatnonzero(marked[self.raw]), self.offsets))

    def words(self, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The words, after each byte is looked up in ``table`` and split at white space; and the number of each text's words."""
        raw = table[self.raw]
        strings = pa.StringArray.from_buffers(len(self), pa.py_buffer(self.offsets), pa.py_buffer(raw))
        split = pc.ascii_split_whitespace(strings)
        flat = split.flatten()
        full = np.asarray(pc.not_equal(pc.binary_length(flat), 0))
        counts = np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(full)])[np.asarray(split.offsets)])
        return (flat if full.all() else flat.filter(pa.array(full))), counts


def steps(batch: pa.RecordBatch, column: int, size: int = STEP) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts in ``column`` hold about ``size`` bytes together, one row at least."""
    if not batch.num_rows:
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, end - at)
        at = end


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's place among the distinct words, and these."""
    found = words.dictionary_encode()
    return np.asarray(found.indices).astype(np.int64), found.dictionary
