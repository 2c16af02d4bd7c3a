"""Suffix arrays and common prefixes of many short strings at once, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All suffixes text[i:end[i]] in order, by Larsson-Sadakane refinement.

    end[i] is the end of the string that holds byte i. A string's end sorts before any byte,
    an earlier string's end before a later one's. The first order is by seven bytes; each
    round then sorts the groups that are still tied by the rank of what follows, and so
    doubles the depth. Sorted groups are not touched again.
    """
    n = len(text)
    left = end - np.arange(n)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    key &= ~np.uint64(255)
    short = np.flatnonzero(left < 7)  # bytes behind the end go; the lowest byte puts an end before a zero byte
    key[short] &= ~np.uint64(0) << (np.uint64(8) * (np.uint64(8) - left[short].astype(np.uint64)))
    key |= np.minimum(left, 7).astype(np.uint64)
    sa = np.argsort(key)
    key = key[sa]
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth = 7
    tied = np.flatnonzero(~new | ~np.append(new[1:], True))
    ended = []
    while len(tied):
        some = sa[tied]
        more = left[some] > depth
        behind = np.where(more, rank[np.minimum(some + depth, n - 1)] + 1, 0)
        group = rank[some]
        order = np.argsort(group * (n + 1) + behind)
        some, behind, group, more = some[order], behind[order], group[order], more[order]
        sa[tied] = some
        new = np.empty(len(tied), bool)
        new[0] = True
        new[1:] = (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])
        rank[some] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        depth *= 2
        open_ = ~new | ~np.append(new[1:], True)
        ended.append(tied[open_ & ~more])
        tied = tied[open_ & more]
    if ended:  # equal to their ends: in text order
        tied = np.sort(np.concatenate(ended))
        some = sa[tied]
        sa[tied] = some[np.lexsort((some, rank[some]))]
    return sa


def common_prefixes(text: np.ndarray, end: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place in sa, the bytes its suffix shares with the one before (0 for the first).

    Kasai's inequality in text order: a suffix shares at least one byte less with its
    neighbour than the suffix one byte before it did, and exactly one less where both
    neighbours have the same byte before them. Only the others are compared, all at once,
    eight bytes a step; the rest follows by counting down.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = end[1:] != end[:-1]
    known = (before < 0) | start | start[np.maximum(before, 0)]
    known |= text[at - 1] != text[np.maximum(before, 1) - 1]
    a = np.flatnonzero(known & (before >= 0))
    b = before[a]
    most = np.minimum(end[a] - a, end[b] - b)
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    word = np.ndarray((n + 8,), "<u8", padded, strides=(1,))
    same = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        differ = word[a[live] + same[live]] ^ word[b[live] + same[live]]
        equal = differ == 0
        lowest = differ & (~differ + np.uint64(1))
        same[live] += np.where(equal, 8, np.bitwise_count(lowest - np.uint64(1)) // 8)
        live = live[equal & (same[live] < most[live])]
    same = np.minimum(same, most)
    own = np.zeros(n, np.int64)
    own[a] = same
    last = np.maximum.accumulate(np.where(known, at, 0))
    return np.maximum(own[last] - (at - last), 0)[sa]
