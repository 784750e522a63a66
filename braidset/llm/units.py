"""Units of text, found and hashed in numpy over the bytes of many texts at once.

A unit is a run of basic or Latin-1 letters (lower-cased), an ASCII digit, a run of ASCII marks,
or, in a word that holds anything else (other scripts, apostrophes, angle brackets, control
characters), that whole word as it is. Words end at ASCII white space.
"""

from __future__ import annotations

import numpy as np

SPACE, LETTER, DIGIT, MARK, LATIN, OTHER = range(6)


def _classes() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[0x21:0x7F] = MARK
    kind[ord("0") : ord("9") + 1] = DIGIT
    for a, z in ("az", "AZ"):
        kind[ord(a) : ord(z) + 1] = LETTER
    kind[[ord("'"), ord("<")]] = OTHER
    kind[[0x20, *range(0x09, 0x0E)]] = SPACE
    kind[0xC3] = LATIN
    return kind


class Units:
    """Units of one buffer: ``starts``, ``ends``, ``whole`` (a whole word), and ``low`` (its bytes, lower-cased in runs of letters)."""

    def __init__(self, hasher: "UnitHasher", raw: np.ndarray):
        self.starts, self.ends, self.whole, self.low = hasher._units(raw)
        powers, self._inverses = hasher._powers(len(raw) + 1)
        self._prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hasher.byte[self.low] * powers[: len(raw)], dtype=np.uint64)])

    def hashes(self, starts=None, ends=None) -> np.ndarray:
        """64-bit hashes of byte ranges, by default of the units; equal bytes have equal hashes."""
        starts, ends = (self.starts, self.ends) if starts is None else (starts, ends)
        out = (self._prefix[ends] - self._prefix[starts]) * self._inverses[starts]
        out ^= out >> np.uint64(29)
        return out * np.uint64(0xBF58476D1CE4E5B9)

    def words(self) -> np.ndarray:
        """Which units are runs of letters or whole words."""
        first = self.low[self.starts]
        return self.whole | ((first >= 97) & (first <= 122)) | (first == 0xC3)


class UnitHasher:
    def __init__(self):
        self.kind = _classes()
        rng = np.random.default_rng(20240)
        self.byte = rng.integers(1, 2**63, 256, np.uint64)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def units(self, data: bytes) -> Units:
        return Units(self, np.frombuffer(data, np.uint8))

    def _units(self, raw: np.ndarray):
        """Starts, ends, whole-word flags and lowered bytes of a buffer's units."""
        kind = self.kind[raw]
        lead = np.flatnonzero(kind == LATIN)
        low = raw.copy()
        upper = (raw >= 65) & (raw <= 90)
        low[upper] += 32
        if len(lead):
            # 0xC3 and its second byte are a Latin-1 letter, but for the signs of times and division.
            second = raw[lead + 1]
            good = (second != 0x97) & (second != 0xB7)
            kind[lead] = np.where(good, LETTER, OTHER)
            kind[lead + 1] = kind[lead]
            capital = lead[good & (second >= 0x80) & (second <= 0x9E)] + 1
            low[capital] += 32
        space = kind == SPACE
        odd = np.flatnonzero(kind == OTHER)
        change = np.empty(len(raw) + 1, bool)
        change[0] = change[-1] = True
        change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        if len(odd):
            # Words with anything else in them are one unit: no edge inside them.
            edges = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1, append=1))
            word = np.unique(np.searchsorted(edges[0::2], odd, "right") - 1)
            a, b = edges[0::2][word], edges[1::2][word]
            size = len(raw) + 1
            inner = np.cumsum(np.bincount(a + 1, minlength=size) - np.bincount(b, minlength=size)) > 0
            change &= ~inner
            covered = inner[:-1]
            covered[a] = True
            low[covered] = raw[covered]
        cuts = np.flatnonzero(change)
        starts, ends = cuts[:-1], cuts[1:]
        keep = ~space[starts]
        starts, ends = starts[keep], ends[keep]
        whole = np.zeros(len(starts), bool)
        if len(odd):
            whole[np.unique(np.searchsorted(starts, odd, "right") - 1)] = True
        return starts, ends, whole, low

    def _powers(self, n: int):
        while len(self.powers) < n:
            # Doubled up to the longest buffer met.
            k = np.uint64(pow(int(self.base), len(self.powers), 1 << 64))
            j = np.uint64(pow(int(self.inverse), len(self.powers), 1 << 64))
            self.powers = np.concatenate([self.powers, self.powers * k])
            self.inverses = np.concatenate([self.inverses, self.inverses * j])
        return self.powers[:n], self.inverses
