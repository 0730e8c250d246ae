"""Repeated strings of one block, by expansion of intervals on its Burrows-Wheeler transform.

Breadth-first backward extension finds the longest common prefixes of
neighbouring suffixes in increasing order: round l takes the suffix-array
intervals of strings of length l, extends each by the characters before it,
and the right ends that appear for the first time are places where neighbours
share exactly l characters.  Stopping after round ``length - 1`` leaves
undecided just the places where neighbours share ``length`` characters or
more, which is all that deduplication asks.
"""

from __future__ import annotations

import numpy as np

#: Ends each string of a block. It occurs in no UTF-8 text and sorts last.
SEPARATOR = 0xFF


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of ``text`` ordered by their first ``depth`` bytes or more; order among equals is free.

    Ranks by 8 bytes are joined, three at a time while they fit a word together, to ranks by 24, 72, 216."""
    n = len(text)
    wrapped = np.concatenate([text, np.resize(text, 8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | wrapped[j : j + n]
    order = np.argsort(key, kind="stable")
    head = np.ones(n, bool)
    sorted_key = key[order]
    head[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n, np.int64)
    known, three = 8, n < 1 << 21
    while True:
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, n))
        rank[order] = np.repeat(first, size)
        if known >= depth:
            return order
        slots = np.flatnonzero(np.repeat(size > 1, size))
        if not len(slots):
            return order
        at = order[slots]
        joined = rank[at]
        for k in range(1, 3 if three else 2):
            then = at + k * known
            then[then >= n] %= n
            joined = (joined << (21 if three else 32)) | rank[then]
        by = np.argsort(joined, kind="stable")
        order[slots] = at[by]
        joined = joined[by]
        head[slots[1:]] = joined[1:] != joined[:-1]
        known *= 3 if three else 2


def common_prefixes_below(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place i of the order, whether suffixes i - 1 and i share fewer than ``length`` bytes (True at 0)."""
    n = len(text)
    before = text[order - 1]
    # Where a suffix's extension by the byte before it stands; -1 at separators, which nothing is extended by.
    extended = np.empty(n, np.int32)
    extended[np.argsort(before, kind="stable")] = np.arange(n, dtype=np.int32)
    extended[before == SEPARATOR] = -1
    decided = np.zeros(n + 1, bool)
    decided[0] = True
    lo, hi = np.zeros(1, np.int32), np.full(1, n, np.int32)
    for _ in range(length):
        size = hi - lo
        one = size == 1
        single = extended[lo[one]]
        single = single[single >= 0]
        single = single[~decided[single + 1]]
        new_lo, new_hi = [single], [single + 1]
        many = ~one
        lo, size = lo[many], size[many]
        if len(lo):
            ends = np.cumsum(size)
            which = np.repeat(np.arange(len(lo), dtype=np.int64), size)
            at = np.arange(len(which)) + np.repeat(lo - (ends - size), size)
            to = extended[at]
            keep = to >= 0
            to, tag = to[keep], which[keep] * 256 + before[at[keep]]
            by = np.argsort(to)
            to, tag = to[by], tag[by]
            last = np.ones(len(to), bool)
            last[:-1] = tag[1:] != tag[:-1]
            end = np.flatnonzero(last)
            begin = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
            fresh = ~decided[to[end] + 1]
            new_lo.append(to[begin[fresh]])
            new_hi.append(to[end[fresh]] + 1)
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
        if not len(lo):
            break
        decided[hi] = True
    return decided[:n]


def repeats(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over the strings joined by separators: where each byte's string starts (offsets), which
    positions start a ``length``-byte string that another position starts too, and a class number
    for each position, equal just for positions that start the same ``length`` bytes."""
    sep = bytes([SEPARATOR])
    text = np.frombuffer(sep.join(strings) + sep, np.uint8)
    sizes = np.fromiter((len(s) + 1 for s in strings), np.int64, len(strings))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    order = suffix_order(text, length)
    below = common_prefixes_below(text, order, length)
    shared = np.zeros(len(text), bool)
    shared[order[1:]] |= ~below[1:]
    shared[order[:-1]] |= ~below[1:]
    classes = np.empty(len(text), np.int64)
    classes[order] = np.cumsum(below)
    return offsets, shared, classes
