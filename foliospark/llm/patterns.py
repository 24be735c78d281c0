"""Where the word n-grams of a small set of patterns occur in texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from foliospark.llm.words import grams_of, groups_of, words_of

_MASK = np.uint64((1 << 20) - 1)


class GramIndex:
    """An inverted index: n-gram hash -> (pattern, place in it), for any n that the patterns need."""

    def __init__(self, entries: list[tuple[int, int, int, int]]) -> None:
        """entries: (n, hash, pattern, place)."""
        self.tables = {}
        for n in sorted({e[0] for e in entries}):
            rows = sorted((h, p, q) for m, h, p, q in entries if m == n)
            keys = np.array([r[0] for r in rows], np.uint64)
            maybe = np.zeros(1 << 20, bool)
            maybe[(keys & _MASK).astype(np.int64)] = True
            self.tables[n] = (keys, np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), maybe)

    def find(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, pattern, place) of every hit; hashes: the words of all texts; first: where each begins."""
        found: list[list[np.ndarray]] = [[], [], [], []]
        for n, (keys, patterns, places, maybe) in self.tables.items():
            grams = grams_of(hashes, n)
            at = np.flatnonzero(maybe[(grams & _MASK).astype(np.int64)])
            lo, hi = np.searchsorted(keys, grams[at], "left"), np.searchsorted(keys, grams[at], "right")
            text = np.searchsorted(first, at, "right") - 1
            some = (hi > lo) & (at + n <= first[text + 1])
            at, lo, hi, text = at[some], lo[some], hi[some], text[some]
            times = hi - lo
            row = np.repeat(lo, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            for column, value in zip(found, (np.repeat(text, times), np.repeat(at - first[text], times), patterns[row], places[row]), strict=True):
                column.append(value)
        return tuple(np.concatenate(c) if c else np.empty(0, np.int64) for c in found)


def candidates(texts: list[str], index: GramIndex, slack: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, int, list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(text, pattern, starts, word hashes, word byte starts, word byte ends) of every text and pattern
    with hits for at least ``least[pattern]`` different places of the pattern.

    starts: words at which the pattern would begin, one for hits whose starts are
    less than ``slack[pattern]`` apart.
    """
    raw = [t.lower().encode() for t in texts]
    for lo, hi in groups_of(raw):
        words = words_of(raw[lo:hi], letters_only=True)
        text, word, pattern, place = index.find(words.hashes, words.first)
        if not len(text):
            continue
        pair = text * len(least) + pattern
        distinct = np.unique(np.stack([pair, place], 1), axis=0)[:, 0]
        pairs, counts = np.unique(distinct, return_counts=True)
        enough = pairs[counts >= least[pairs % len(least)]]
        some = np.isin(pair, enough)
        text, pattern, start = text[some], pattern[some], (word - place)[some]
        if not len(text):
            continue
        order = np.lexsort((start, pattern, text))
        text, pattern, start = text[order], pattern[order], start[order]
        edges = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (pattern[1:] != pattern[:-1]), True])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            t, p = int(text[a]), int(pattern[a])
            kept: list[int] = []
            for s in start[a:b].tolist():
                if not kept or s - kept[-1] >= max(1, slack[p]):
                    kept.append(s)
            i, j = words.first[t], words.first[t + 1]
            yield lo + t, p, kept, words.hashes[i:j], words.starts[i:j], words.ends[i:j]


def pattern_words(text: str) -> np.ndarray:
    return words_of([text.lower().encode()], letters_only=True).hashes
