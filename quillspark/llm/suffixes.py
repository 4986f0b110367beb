"""Suffix array and longest common prefixes of many token streams at once, by prefix doubling. Runs on the workers."""

from __future__ import annotations

import numpy as np


def suffix_array(tokens: np.ndarray, group: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, lcp): lcp[r] is the common prefix, in tokens, of suffixes sa[r - 1] and sa[r].

    tokens are small integers; suffixes of different groups share nothing; end[i] is where the stream that
    holds position i ends, and no common prefix reaches past it. Each round doubles the compared length
    and sorts only the suffixes that are still tied; equal suffixes stay tied. A round keeps the ranks that it changes,
    so that the prefixes are found by undoing the rounds: memory grows with the ties, not with the number of rounds.
    """
    n = len(tokens)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key = group.astype(np.int64) * (int(tokens.max()) + 1) + tokens
    sa = np.argsort(key, kind="stable")
    new = np.r_[True, key[sa[1:]] != key[sa[:-1]]]
    rank = np.full(n + 1, -1, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    undo: list[tuple[np.ndarray, np.ndarray]] = []  # the positions whose rank a round changed, and their ranks before
    slots = np.flatnonzero(~(new & np.r_[new[1:], True]))  # places in sa of tied suffixes
    h = 1
    while len(slots):
        at = sa[slots]
        ahead = at + h
        second = np.where(ahead < end[at], rank[np.minimum(ahead, n)], -1)
        first = rank[at]
        order = np.lexsort((second, first))
        at, first, second = at[order], first[order], second[order]
        sa[slots] = at
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        undo.append((at, first))
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        tied = ~(new & np.r_[new[1:], True]) & (second >= 0)
        slots = slots[tied]
        h *= 2
    lcp = np.zeros(n, np.int64)
    pair = np.flatnonzero(key[sa[1:]] == key[sa[:-1]]) + 1
    a, b = sa[pair - 1], sa[pair]
    length = np.zeros(len(pair), np.int64)
    for k in range(len(undo), -1, -1):
        x, y = np.minimum(a + length, n), np.minimum(b + length, n)
        length += np.where((rank[x] == rank[y]) & (x < n) & (y < n), 1 << k, 0)
        if k:
            at, before = undo.pop()
            rank[at] = before
    lcp[pair] = np.minimum(length, np.minimum(end[a] - a, end[b] - b))
    return sa, lcp


def longest_repeats(sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each position the longest prefix of its suffix that occurs elsewhere too: the value of its deepest lcp interval."""
    out = np.zeros(len(sa), np.int64)
    out[sa] = np.maximum(lcp, np.r_[lcp[1:], 0]) if len(sa) else 0
    return out


def covered(length: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in [i, i + length[i]) for some i with length[i] >= least."""
    at = np.flatnonzero(length >= least)
    edge = np.zeros(len(length) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length[at], -1)
    return np.cumsum(edge[:-1]) > 0
