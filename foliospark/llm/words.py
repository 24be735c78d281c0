"""Hashes of words and word shingles, whole batches at a time in numpy.

A word is a run of bytes other than space and \\t\\n\\v\\f\\r, with A-Z lower-cased.
Its 64-bit hash is a polynomial over random byte values, taken from prefix sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_COEFFICIENT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
#: Bytes of text hashed at a time.
GROUP_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Powers of the base and of its inverse that a worker keeps: the most asked for so far, and at most so many.
KEPT_POWERS = 1 << 21
_kept = [np.empty(0, np.uint64)] * 2


def _powers(least: int) -> tuple[np.ndarray, np.ndarray]:
    """``least`` powers or more."""
    if len(_kept[0]) >= least:
        return _kept[0], _kept[1]
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(-(-least // 65536) * 65536, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p, out=p))
    if len(out[0]) <= KEPT_POWERS:
        _kept[:] = out
    return out[0], out[1]


#: Of each byte as it is.
_RAW = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


class Hashed:
    """A byte string with the 64-bit polynomial hash of any of its substrings."""

    def __init__(self, data: bytes) -> None:
        self.bytes = np.frombuffer(data, np.uint8)
        powers, self.inverse = _powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_RAW[self.bytes] * powers[: len(data)], out=self.total[1:])

    def substrings(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.inverse[starts])

    def every(self, length: int) -> np.ndarray:
        n = len(self.bytes) - length + 1
        return mix((self.total[length:] - self.total[:n]) * self.inverse[:n])


@dataclass
class Words:
    """hashes, and the byte spans, of the words of some texts; first[i]: where text i's words begin."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def words_of(texts: list[bytes], letters_only: bool = False) -> Words:
    """letters_only: ASCII other than letters and digits also separates words."""
    space = _SPACE
    if letters_only:
        space = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = space[data]
    edge = np.flatnonzero(np.diff(np.r_[True, blank].view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    powers, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    begins = np.cumsum(np.r_[0, [len(t) + 1 for t in texts]])
    first = np.searchsorted(starts, begins)
    own = np.repeat(begins[:-1], np.diff(first))
    return Words(hashes, starts - own, ends - own, first)


def grams_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` words (across texts too; see ``first``)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out += hashes[j : count + j] * _COEFFICIENT[j]
    return mix(out ^ U(n))


def groups_of(texts: list[bytes], most: int = GROUP_BYTES):
    """(from, to) of runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of ``n`` words; of all words where there are fewer; none without words."""
    out = []
    for lo, hi in groups_of(texts):
        words = words_of(texts[lo:hi])
        grams = grams_of(words.hashes, n)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= n:
                x = np.sort(grams[a : b - n + 1])
                out.append(x[np.r_[True, x[1:] != x[:-1]]])
            else:
                out.append(grams_of(words.hashes[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out
