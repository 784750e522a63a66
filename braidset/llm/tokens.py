"""Token ids of whole texts through the tokenizers library, each distinct unit of text once a worker.

The word tokenizer composes characters, drops white space, lowers case, and then merges inside
single runs of letters, single digits or runs of marks. A text's ids are therefore those of its
units in turn. Here a unit is a run of basic or Latin-1 letters, an ASCII digit, a run of ASCII
marks, or, in a word that holds anything else (other scripts, apostrophes, angle brackets,
control characters), that whole word. Units are found and looked up by hash in numpy;
only those that the worker has not met go to the library.
"""

from __future__ import annotations

import os

import numpy as np

from braidset.llm.common import worker_cache
from braidset.llm.units import UnitHasher

#: Units that a worker remembers (about 40 bytes each); on overflow it starts afresh.
UNITS = 4_000_000
#: Bytes of text that are worked on at once; a longer text is one piece of its own.
CHUNK = 1 << 19

def default_path() -> str:
    """The public word tokenizer of the contracts."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class UnitEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.hasher = UnitHasher()
        self._fresh()

    def _fresh(self):
        empty = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        # Sorted hashes with the place and number of each unit's ids: a large level and a small, recent one.
        self.levels = [empty, empty]
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def known(self) -> int:
        return sum(len(level[0]) for level in self.levels)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the (sorted) hashes are known, and the place and number of their ids."""
        found, starts, sizes = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int32)
        for keys, places, numbers in self.levels:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                same = keys[at] == hashes
                found |= same
                starts[same], sizes[same] = places[at[same]], numbers[at[same]]
        return found, starts, sizes

    def _learn(self, hashes, units: list[bytes], whole: np.ndarray) -> None:
        """Ids of units that are new, found by the library."""
        texts = [u.decode("utf-8", "replace") for u in units]
        ids: list = [None] * len(texts)
        plain = np.flatnonzero(~whole).tolist()
        rest = np.flatnonzero(whole).tolist()
        groups = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        found = self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in g]) for g in groups], add_special_tokens=False)
        for g, e in zip(groups, found):
            got = e.ids
            # Each plain unit is merged by itself, so its ids stop at the first that ends a word.
            stops = (np.flatnonzero(self.ends[np.array(got, np.int64)]) + 1).tolist()
            if len(stops) != len(g):
                rest += g
                continue
            for i, a, b in zip(g, [0, *stops], stops):
                ids[i] = got[a:b]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            ids[i] = e.ids
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        end = self.used + int(sizes.sum())
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(end, len(self.flat)) // 2 + end - len(self.flat), np.int32)])
        self.flat[self.used : end] = np.fromiter((x for t in ids for x in t), np.int32, end - self.used)
        starts = self.used + np.cumsum(sizes) - sizes
        self.used = end
        self.levels[1] = self._merged(self.levels[1], (hashes, starts, sizes))
        if len(self.levels[1][0]) * 8 > len(self.levels[0][0]):
            self.levels = [self._merged(*self.levels), tuple(x[:0] for x in self.levels[1])]

    @staticmethod
    def _merged(a, b):
        joined = [np.concatenate(pair) for pair in zip(a, b)]
        order = np.argsort(joined[0], kind="stable")
        return tuple(x[order] for x in joined)

    def _chunk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = b" ".join(texts) + b" "
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        units = self.hasher.units(data)
        starts, ends, whole, low = units.starts, units.ends, units.whole, units.low
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        hashes = units.hashes() + whole
        known, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if self.known() + len(known) > UNITS:
            self._fresh()
        have, places, sizes = self._find(known)
        if not have.all():
            new = first[~have]
            lowered = low.tobytes()
            self._learn(known[~have], [lowered[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())], whole[new])
            have, places, sizes = self._find(known)
        sizes, places = sizes[back], places[back]
        stops = np.cumsum(sizes, dtype=np.int64)
        shift = np.repeat(places - (stops - sizes), sizes)
        out = self.flat[shift + np.arange(int(stops[-1]))]
        text_ends = np.searchsorted(starts, np.cumsum(lengths))
        total = np.concatenate([np.zeros(1, np.int64), stops])[text_ends]
        return out, np.diff(total, prepend=0)

    def encode_all(self, texts: list[bytes | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32), one text after the other, and the number of each; ``end`` closes every text. None is empty."""
        parts, counts, at = [], [], 0
        while at < len(texts):
            take, size = [], 0
            while at < len(texts) and (not take or size < CHUNK):
                take.append(texts[at] or b"")
                size += len(take[-1])
                at += 1
            ids, n = self._chunk(take)
            parts.append(ids)
            counts.append(n)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        if end is not None:
            ids = np.insert(ids, np.cumsum(n), np.int32(end))
            n = n + 1
        return ids, n

    def encode(self, text: bytes) -> np.ndarray:
        return self.encode_all([text])[0]


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder of this tokenizer file."""
    cache = worker_cache()
    if ("tokens", path) not in cache:
        cache["tokens", path] = UnitEncoder(path)
    return cache["tokens", path]
