"""Suffix arrays and common prefixes of integer sequences, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative codes by Larsson-Sadakane refinement.

    The first sort packs as many codes as fit into one key beside the position.
    Later rounds double the sorted depth and touch only groups that are still
    tied. The end of the sequence sorts before every code."""
    n = len(codes)
    if n < 2:
        return np.arange(n, dtype=np.int64)
    present = np.zeros(int(codes.max()) + 1, np.int64)
    present[codes] = 1
    one = np.cumsum(present)[codes]  # 1, 2, ... in the order of the codes; 0 is the end
    bits, room = int(one.max()).bit_length(), n.bit_length()
    depth = max(1, (63 - room) // bits)
    key = one.copy()
    for d in range(1, depth):
        key <<= bits
        if d < n:
            key[:-d] |= one[d:]
    where = np.arange(n, dtype=np.int64)
    rank = np.zeros(n + 1, np.int64)  # from 1; the end has 0
    sa, key = _ordered(key, where, room)
    tied = _regroup(sa, key, where, rank)
    while len(tied):
        pos = sa[tied]
        pos, pair = _ordered(rank[pos] << room | rank[np.minimum(pos + depth, n)], pos, room)
        sa[tied] = pos
        tied = _regroup(pos, pair, tied, rank)
        depth *= 2
    return sa


def _ordered(key: np.ndarray, pos: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions by key, and the sorted keys; both travel in one word where `room` bits for the position are left."""
    if int(key.max()).bit_length() + room < 64:
        both = key << room | pos
        both.sort()
        return both & ((1 << room) - 1), both >> room
    by = np.argsort(key)
    return pos[by], key[by]


def _regroup(pos: np.ndarray, key: np.ndarray, where: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Set the ranks of suffixes sorted by `key`; return the places that are still tied."""
    first = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=first[1:])
    start = np.flatnonzero(first)
    size = np.diff(start, append=len(key))
    rank[pos] = np.repeat(where[start] + 1, size)
    return where[np.repeat(size > 1, size)]


def common_prefixes(codes: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix with its predecessor in `sa`, in text order.

    Kasai's lemma in array form: where the codes before a suffix and before its
    predecessor agree, the value is one less than that of the suffix before it.
    Only the other positions are compared code by code."""
    n = len(codes)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    here = np.arange(n)
    fresh = (before <= 0) | (here == 0)
    rest = np.flatnonzero(~fresh)
    fresh[rest] = codes[rest - 1] != codes[before[rest] - 1]
    at = np.flatnonzero(fresh & (before >= 0))
    other, length = before[at], np.zeros(len(at), np.int64)
    padded = np.concatenate([codes.astype(np.int64), np.full(1, -1, np.int64)])
    live, step = np.arange(len(at)), 1
    while len(live):
        look = np.arange(step)
        a = (at[live] + length[live])[:, None] + look
        b = (other[live] + length[live])[:, None] + look
        same = (padded[np.minimum(a, n)] == padded[np.minimum(b, n)]) & (a < n) & (b < n)
        run = np.where(same.all(axis=1), step, same.argmin(axis=1))
        length[live] += run
        live = live[run == step]
        step = min(2 * step, 32)
    out[at] = length
    source = np.maximum.accumulate(np.where(fresh, here, 0))
    return np.where(fresh, out, np.maximum(out[source] - (here - source), 0))


def longest_repeats(codes: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest sequence starting there that also starts elsewhere.

    It is the larger of the common prefixes with both neighbours in suffix
    order, the depth of the innermost LCP interval that holds the suffix."""
    sa = suffix_array(codes)
    back = common_prefixes(codes, sa)
    longest = back.copy()
    if len(sa) > 1:
        longest[sa[:-1]] = np.maximum(back[sa[:-1]], back[sa[1:]])
    return longest
