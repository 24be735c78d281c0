"""Run-length index: a run-compressed Burrows-Wheeler transform with sampled run ends.

Built in numpy over the concatenation of many short strings, each closed by a
separator of its own. Only where the transform changes its symbol does the index
keep a text position and the common prefix with the neighbouring suffix; the
matching statistics of every position follow from these in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_PACK = 7


@dataclass
class RunIndex:
    """heads and tails: text positions of the first and last suffix of each run of the transform,
    with the length of the prefix each shares with the suffix before (after) it."""

    size: int
    symbols: np.ndarray
    heads: np.ndarray
    head_match: np.ndarray
    tails: np.ndarray
    tail_match: np.ndarray

    def matching_statistics(self) -> np.ndarray:
        """For each position, the longest string starting there that starts elsewhere too.

        Within a run the match of a position is that of the position before, less one.
        """
        out = np.zeros(self.size, np.int64)
        index = np.arange(self.size)
        for at, match in ((self.heads, self.head_match), (self.tails, self.tail_match)):
            last, value = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
            last[at], value[at] = at, match
            last = np.maximum.accumulate(last)
            np.maximum(out, value[last] - (index - last), out=out)
        return out


def _suffix_ranks(data: np.ndarray, closed: np.ndarray, longest: int) -> list[tuple[int, np.ndarray]]:
    """(depth, ranks of all suffixes by their first ``depth`` symbols), until all differ; closed: separators."""
    n = len(data)
    symbols = np.where(closed, 0, data.astype(np.int64) + 1)
    key, live = np.zeros(n, np.int64), np.ones(n, bool)
    padded = np.r_[symbols, np.zeros(_PACK, np.int64)]
    for i in range(_PACK):
        s = padded[i : i + n] * live
        key = key << 9 | s
        live &= s > 0
    out, depth = [], _PACK
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    ended = ranked & 511 == 0  # a separator among the first symbols: differs from all others, in text order
    while True:
        new = np.r_[True, (ranked[1:] != ranked[:-1]) | ended[1:]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        out.append((depth, rank))
        if new.all() or depth > longest:
            return out
        beyond = np.zeros(n, np.int64)
        beyond[: n - depth] = rank[depth:] + 1 if n > depth else 0
        key = rank * (n + 1) + beyond
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        ended = np.zeros(n, bool)
        depth *= 2


def build(strings: list[bytes]) -> RunIndex:
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    n = len(data)
    ends = np.cumsum([len(s) + 1 for s in strings]) - 1
    closed = np.zeros(n, bool)
    closed[ends] = True
    ranks = _suffix_ranks(data, closed, max(map(len, strings)))
    suffixes = np.empty(n, np.int64)
    suffixes[ranks[-1][1]] = np.arange(n)
    symbol = data.astype(np.int64)
    symbol[ends] = -1 - np.arange(len(ends))  # every separator is a symbol of its own
    transform = symbol[suffixes - 1]
    change = np.flatnonzero(transform[1:] != transform[:-1]) + 1
    head_rows, tail_rows = np.r_[0, change], np.r_[change - 1, n - 1]

    def shared(rows: np.ndarray, other: np.ndarray) -> np.ndarray:
        ok = (other >= 0) & (other < n)
        a, b = suffixes[rows], suffixes[np.clip(other, 0, n - 1)]
        length = np.zeros(len(rows), np.int64)
        for depth, rank in reversed(ranks):
            i, j = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
            length += depth * ((rank[i] == rank[j]) & ok & (a + length < n) & (b + length < n) & (i != j))
        for _ in range(_PACK - 1):
            i, j = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
            length += (symbol[i] == symbol[j]) & ok & (i != j)
        return length

    return RunIndex(n, transform[head_rows], suffixes[head_rows], shared(head_rows, head_rows - 1), suffixes[tail_rows], shared(tail_rows, tail_rows + 1))


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """Per string, where strings of ``length`` bytes start that also start somewhere else in the collection."""
    long = build(strings).matching_statistics() >= length
    out, at = [], 0
    for s in strings:
        out.append(np.flatnonzero(long[at : at + len(s)]))
        at += len(s) + 1
    return out
