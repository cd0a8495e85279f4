"""Repeated strings of a block of bytes, by threshold-bounded interval expansion.

The block's suffixes are sorted as far as the threshold asks; their Burrows-
Wheeler transform is extended backwards breadth first: the intervals of all
strings of length 0, then 1, 2, ... are split by the preceding byte.  The right
end of a new interval that was not reached before is a place where neighbouring
suffixes share exactly as many bytes as the level says, so common prefixes are
derived by increasing value.  An interval whose right end was reached before is
not followed, hence every place costs one step.  At the threshold the expansion
stops: places not reached separate suffixes that share at least so many bytes.

Runs of equal bytes in the transform are opened as one, so that copies of a
passage cost little more than the passage.  Helper for one bounded block.
"""

from __future__ import annotations

import numpy as np


def sorted_suffixes(data: np.ndarray, depth: int) -> np.ndarray:
    """Start positions in the order of the first ``depth`` bytes (or more); ends of data count as zero bytes."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, dtype="uint8")])
    key = np.zeros(n, dtype="uint64")
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i:i + n]
    reach = 8
    while True:
        order = np.argsort(key, kind="stable" if reach > 8 else None)
        ordered = key[order]
        rank = np.empty(n, dtype="int64")
        rank[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        if reach >= depth or rank.max() == n:
            return order
        further = np.zeros(n, dtype="int64")
        if reach < n:
            further[:n - reach] = rank[reach:]
        key = rank * (n + 1) + further
        reach *= 2


def shared_at_least(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix in order but the first: does it share ``length`` bytes with the one before?"""
    n = len(data) + 1
    # row 0 is the empty suffix; -1 stands before the whole data and sorts below all bytes
    transform = np.concatenate([data[-1:], data[order - 1]]).astype("int16")
    transform[1:][order == 0] = -1
    front = np.empty(n, dtype="int64")     # row of the suffix that is longer by the preceding byte
    front[np.argsort(transform, kind="stable")] = np.arange(n)
    change = np.flatnonzero(transform[1:] != transform[:-1]) + 1
    run_start = np.concatenate([[0], change])
    run_end = np.concatenate([change, [n]])
    run_of = np.zeros(n, dtype="int64")
    run_of[change] = 1
    run_of = np.cumsum(run_of)
    run_byte = transform[run_start].astype("int64")
    reached = np.zeros(n + 1, dtype=bool)
    reached[0] = reached[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        first, last = run_of[low], run_of[high - 1]
        single = first == last
        new_low, new_high = [front[low[single]]], [front[high[single] - 1] + 1]
        low, high, first, last = low[~single], high[~single], first[~single], last[~single]
        if len(low):
            count = last - first + 1
            owner = np.repeat(np.arange(len(low)), count)
            run = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
            left, right = np.maximum(run_start[run], low[owner]), np.minimum(run_end[run], high[owner])
            key = owner * 512 + run_byte[run]
            by_byte = np.argsort(key, kind="stable")
            key = key[by_byte]
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            tails = np.concatenate([heads[1:], [len(key)]]) - 1
            new_low.append(front[left[by_byte[heads]]])
            new_high.append(front[right[by_byte[tails]] - 1] + 1)
        low, high = np.concatenate(new_low), np.concatenate(new_high)
        new = ~reached[high]
        low, high = low[new], high[new]
        if not len(low):
            break
        reached[high] = True
    return ~reached[2:n]


def repeated_starts(data: np.ndarray, usable: np.ndarray, identity: np.ndarray, length: int) -> np.ndarray:
    """Marks usable positions whose string of ``length`` bytes also starts at a position of another identity."""
    marks = np.zeros(len(data), dtype=bool)
    if len(data) < length:
        return marks
    order = sorted_suffixes(data, length)
    group = np.cumsum(np.concatenate([[True], ~shared_at_least(data, order, length)])) - 1
    kept = usable[order]
    order, group = order[kept], group[kept]
    if not len(order):
        return marks
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    own = identity[order]
    several = np.minimum.reduceat(own, heads) != np.maximum.reduceat(own, heads)
    marks[order[np.repeat(several, np.diff(np.concatenate([heads, [len(order)]])))]] = True
    return marks
