"""Suffix arrays of one shard in numpy: Larsson-Sadakane refinement, Kasai common prefixes, merging by binary search."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` (bytes) in the order of their suffixes.

    Suffixes are first sorted by as many bytes as fit into 63 bits. Then each group of equal ones, and no others, is
    refined by the rank of the suffix behind what is already compared, which doubles that length.
    """
    n = len(text)
    # Bytes by their rank among those that occur, from one: the end of the text is less than any.
    occurs = np.bincount(text, minlength=256) > 0
    code = np.cumsum(occurs).astype(np.uint64)
    bits = int(code[-1]).bit_length()
    first = 63 // bits
    padded = np.concatenate([code[text], np.zeros(first, np.uint64)])
    keys = np.zeros(n, np.uint64)
    for i in range(first):
        keys = (keys << np.uint64(bits)) | padded[i : i + n]
    order = np.argsort(keys)
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    # ``head``: where the group of each place in the order begins; a suffix's rank is that and one.
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[order] = head + 1
    at, h = np.arange(n), first
    while True:
        # Only members of groups of more than one are still to be placed.
        group = head[at]
        alone = np.concatenate([[True], group[1:] != group[:-1]]) & np.concatenate([group[1:] != group[:-1], [True]])
        at = at[~alone]
        if not len(at):
            return order
        own, group = order[at], head[at]
        behind = rank[np.minimum(own + h, n)]
        # One key for both: places are below 2**31.
        sub = np.argsort((group << 32) | behind)
        own, behind = own[sub], behind[sub]
        order[at] = own
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])])
        head[at] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        rank[own] = head[at] + 1
        h *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """Kasai's common prefix of each suffix in ``order`` with the one before it, up to ``most``.

    Kasai walks a text from left to right: the prefix shrinks by one at most from a position to the
    next. Here the pieces that begin at ``starts`` are walked side by side.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(most + 8, np.uint8)])
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    ends = np.concatenate([starts[1:], [n]])
    out = np.zeros(n, np.int64)
    length = np.zeros(len(starts), np.int64)
    for j in range(int((ends - starts).max(initial=0))):
        here = starts + j
        active = np.flatnonzero(here < ends)
        p = here[active]
        q = before[p]
        known = np.where(q >= 0, np.maximum(length[active] - 1, 0), 0)
        grow = np.flatnonzero(q >= 0)
        while len(grow):
            a, b, k = p[grow], q[grow], known[grow]
            # Eight bytes a step; the first difference ends the walk.
            equal = padded[(a + k)[:, None] + np.arange(8)] == padded[(b + k)[:, None] + np.arange(8)]
            inside = np.minimum(n - np.maximum(a, b) - k, most - k)
            step = np.where(equal.all(axis=1), 8, equal.argmin(axis=1))
            step = np.minimum(step, np.maximum(inside, 0))
            known[grow] += step
            grow = grow[step == 8]
        length[active] = known
        out[p] = known
    return out[order]


def windows(text: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes from each position as rows of big-endian words, which compare as bytes do."""
    width = -(-size // 8) * 8
    rows = np.zeros((len(at), width), np.uint8)
    rows[:, :size] = np.lib.stride_tricks.sliding_window_view(text, size)[at]
    return rows.view(">u8").astype(np.uint64)


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = a != b
    first = differ.argmax(axis=1)
    rows = np.arange(len(a))
    return differ.any(axis=1) & (a[rows, first] < b[rows, first])


def occur_in(ours: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Which of ``ours`` occur in ``theirs`` (both rows of words in suffix order), by binary search: a mask."""
    low, high = np.zeros(len(ours), np.int64), np.full(len(ours), len(theirs), np.int64)
    while True:
        open_rows = np.flatnonzero(low < high)
        if not len(open_rows):
            break
        middle = (low[open_rows] + high[open_rows]) // 2
        less = _less(theirs[middle], ours[open_rows])
        low[open_rows[less]] = middle[less] + 1
        high[open_rows[~less]] = middle[~less]
    found = low < len(theirs)
    out = np.zeros(len(ours), bool)
    out[found] = (theirs[low[found]] == ours[found]).all(axis=1)
    return out


def repeated_windows(segments: list[bytes], counts: list[int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ``counts[k]`` window starts at the head of each segment: whether the ``size`` bytes there start elsewhere too.

    Returns the mask over all window starts in segment order, and their words in suffix order with
    the starts they belong to, for merging with other shards.
    """
    text = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    starts = np.cumsum(sizes) - sizes
    many = np.array(counts, np.int64)
    first = np.cumsum(many) - many
    at = np.repeat(starts - first, many) + np.arange(int(many.sum()))
    index = np.full(len(text), -1, np.int64)
    index[at] = np.arange(len(at))
    order = suffix_array(text)
    shared = common_prefixes(text, order, starts, size)
    own = np.flatnonzero(index[order] >= 0)
    mask = np.zeros(len(at), bool)
    places = index[order[own]]
    if len(own) > 1:
        # Between two window starts in the order, the least of the common prefixes passed is theirs.
        least = np.minimum.reduceat(shared[: own[-1] + 1], own[:-1] + 1)
        same = least >= size
        mask[places[1:][same]] = True
        mask[places[:-1][same]] = True
    return mask, at[places], places
