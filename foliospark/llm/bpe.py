"""Byte-pair merging with a heap over a linked list, and tables of encoded chunks.

Both tokenizer files cut a text where white space begins, so what they make of a
text is what they make of its blank-delimited chunks, one after the other. Each
worker therefore keeps the result for every chunk it has met, up to a bound,
and looks up the chunks of many texts at a time in numpy.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from operator import attrgetter

import numpy as np
import regex

from foliospark.llm.common import KEPT
from foliospark.llm.words import Hashed, groups_of

U = np.uint64

#: The white space of Unicode's White_Space property beyond ASCII, and all of it (str.split also takes \\x1c-\\x1f).
OTHER_SPACE = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = "\t-\r " + OTHER_SPACE
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_ODD = re.compile(f"[{OTHER_SPACE}]")
_CHUNK = re.compile(f"[^{SPACE}]+")
_CUT = re.compile(rb"[^\t-\r ][\t-\r ]")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: What plain bytes are (0: a chunk with such a byte is not plain), and each with A-Z as small letters.
_LETTER, _DIGIT, _OTHER = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _OTHER
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[[39, 60]] = 0  # ' begins words of its own, < special strings
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
#: How words with ends are cut; white space between them is dropped.
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
#: Slots of a worker's table of chunks, of which half are used; numbers that these may have together before a new one is begun.
SLOTS, KEPT_NUMBERS = 1 << 21, 1 << 22
#: UTF-8 bytes of text whose chunks are looked up together.
LOOKUP_BYTES = 1 << 20
#: Words that a worker keeps the ids of, and the longest of these.
CACHED_WORDS, CACHED_LENGTH = 200_000, 64
#: What closes each chunk where many are cut into words together.
MARK = "\0"


def chunks_of(text: str) -> list[str]:
    """The runs between white space."""
    return _CHUNK.findall(text) if _ODD_SPACE.search(text) else text.split()


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class HeapBpe:
    """Counts the tokens of words by merging alone; no vocabulary ids are looked up or emitted."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        number: dict[str, int] = {}  # a symbol's number stands for it in the heap
        self.rules: dict[int, tuple[int, int]] = {}  # left << 32 | right -> rank, merged symbol
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            i, j, k = (number.setdefault(x, len(number)) for x in (a, b, a + b))
            self.rules[i << 32 | j] = (rank, k)
        chars = byte_alphabet()
        self.inner = [number.setdefault(c, len(number)) if c in model["vocab"] else -1 for c in chars]
        self.last = [number.setdefault(c + self.suffix, len(number)) if c + self.suffix in model["vocab"] else -1 for c in chars]
        special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special_re = re.compile("|".join(map(re.escape, special))) if special else None
        self.word_re = regex.compile(WORD)

    def symbols(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        out = [self.inner[b] for b in raw[:-1]]
        out.append(self.last[raw[-1]])
        return [s for s in out if s >= 0] if -1 in out else out

    def merges(self, symbols: list[int]) -> int:
        """How often the lowest-ranked adjacent pair can be merged, leftmost first among equals."""
        n, find = len(symbols), self.rules.get
        heap = [(rule[0], i, symbols[i], symbols[i + 1], rule[1]) for i in range(n - 1) if (rule := find(symbols[i] << 32 | symbols[i + 1]))]
        if not heap:
            return 0
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heapq.heapify(heap)
        pop, push, done = heapq.heappop, heapq.heappush, 0
        while heap:
            _, i, a, b, c = pop(heap)
            j = right[i]
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue  # one of them has been merged meanwhile
            done += 1
            symbols[i], symbols[j] = c, -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if rule := find(c << 32 | symbols[k]):
                    push(heap, (rule[0], i, c, symbols[k], rule[1]))
            h = left[i]
            if h >= 0 and (rule := find(symbols[h] << 32 | c)):
                push(heap, (rule[0], h, symbols[h], c, rule[1]))
        return done

    def count_word(self, word: str) -> int:
        symbols = self.symbols(word)
        return len(symbols) - self.merges(symbols)

    def count_chunk(self, chunk: str) -> int:
        """Tokens of a chunk without white space; special strings count one each."""
        total, pieces = 0, [chunk]
        if "<" in chunk and self.special_re and self.special_re.search(chunk):
            pieces = self.special_re.split(chunk)
            total = len(pieces) - 1
        return total + sum(self.count_word(w) for p in pieces for w in self.word_re.findall(folded(p)))


def folded(text: str) -> str:
    """NFC, then each character's lower case, whatever stands beside it."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "".join([c.lower() for c in text]) if "\u03a3" in text else text.lower()


class Table:
    """Hash -> number, open-addressed; whole arrays are looked up and added at a time. 0 is no hash."""

    def __init__(self, slots: int) -> None:
        self.last, self.keys, self.values, self.size = slots - 1, np.zeros(slots, np.uint64), np.zeros(slots, np.int64), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for one that is not there."""
        at = (hashes >> U(20)).astype(np.int64) & self.last
        there = self.keys[at]
        out = np.where(there == hashes, self.values[at], -1)
        other = np.flatnonzero((there != hashes) & (there != 0))
        while len(other):
            at[other] = (at[other] + 1) & self.last
            there = self.keys[at[other]]
            same = there == hashes[other]
            out[other[same]] = self.values[at[other[same]]]
            other = other[~same & (there != 0)]
        return out

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Distinct hashes that are not there, fewer than there is room for."""
        at, left = (hashes >> U(20)).astype(np.int64) & self.last, np.arange(len(hashes))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = hashes[free]  # of several for one slot the last stays
            won = self.keys[at[left]] == hashes[left]
            self.values[at[left[won]]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & self.last
        self.size += len(hashes)


def pieces_of(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about LOOKUP_BYTES, cut where white space begins."""
    at = 0
    while len(raw) - at > 2 * LOOKUP_BYTES and (m := _CUT.search(raw, at + LOOKUP_BYTES)):
        yield raw[at : m.start() + 1]
        at = m.start() + 1
    yield raw[at:]


def chunk_spans(raw: list[bytes], spaced: bool) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, starts, ends, first): the chunks of some texts, and where in them each text's begin.

    Chunks are parted by ASCII white space; spaced: each has what stands before it.
    """
    joined = b"".join(raw) if spaced else b"\n".join(raw) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    begins = np.cumsum([0, *(len(r) + (not spaced) for r in raw)])
    blank = _BLANK[data]
    if spaced:
        begin = np.zeros(len(data) + 1, bool)
        begin[1:-1] = blank[1:] & ~blank[:-1]
        begin[begins] = True
        edges = np.flatnonzero(begin)
        starts, ends = edges[:-1], edges[1:]
    else:
        edges = np.flatnonzero(np.diff(np.r_[True, blank].view(np.int8)))
        starts, ends = edges[0::2], edges[1::2]
    return joined, starts, ends, np.searchsorted(starts, begins)


class WordMaker:
    """The numbers of chunks from those of their words; all the chunks that are new are cut together.

    Where words are folded, chunks of plain ASCII are cut in numpy, and their words
    told apart by 64-bit hashes; the others are cut by the pattern.
    words: the numbers of each of some words, as bytes; whole: those of a chunk that may hold a special string, or MARK.
    """

    def __init__(self, pattern: str, fold: bool, words: Callable[[list[str]], list[bytes]], whole: Callable[[str], bytes]) -> None:
        self.pattern, self.fold, self.words, self.whole = regex.compile(rf"{MARK}|" + pattern.replace("[^", f"[^{MARK}")), fold, words, whole
        self.kept: dict[str, bytes] = {}
        self.known = Known(SLOTS // 2)  # of plain words

    def of(self, joined: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many numbers each chunk has, and all of these."""
        sizes, plain = ends - starts, np.zeros(len(starts), bool)
        if self.fold:
            data = np.frombuffer(joined, np.uint8)[_places(starts, sizes)]
            plain = np.logical_and.reduceat(_KIND[data] > 0, np.cumsum(sizes) - sizes)
        lengths = np.empty(len(starts), np.int64)
        rest = np.flatnonzero(~plain)
        made = self([joined[a:b].decode() for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]) if len(rest) else []
        lengths[rest] = np.fromiter(map(len, made), np.int64, len(made)) >> 2
        numbers = np.frombuffer(b"".join(made), "<u4")
        if not plain.any():
            return lengths, numbers
        lengths[plain], of_plain = self._plain(data[np.repeat(plain, sizes)], sizes[plain])
        out, begins = np.empty(int(lengths.sum()), np.uint32), np.cumsum(lengths) - lengths
        out[_places(begins[plain], lengths[plain])] = of_plain
        out[_places(begins[rest], lengths[rest])] = numbers
        return lengths, out

    def _plain(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``of`` for chunks of these sizes that stand one behind the other: runs of letters, single digits, runs of others."""
        kind, begins = _KIND[data], np.cumsum(sizes) - sizes
        begin = kind == _DIGIT
        begin[1:] |= kind[1:] != kind[:-1]
        begin[begins] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))
        small = _SMALL[data].tobytes()

        def make(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            made = self.words([small[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            return np.fromiter(map(len, made), np.int64, len(made)) >> 2, np.frombuffer(b"".join(made), "<u4")

        lengths, numbers = self.known.of(Hashed(small).substrings(starts, ends) | U(1), make)
        return np.add.reduceat(lengths, np.searchsorted(starts, begins)), numbers

    def __call__(self, chunks: list[str]) -> list[bytes]:
        joined = MARK.join(chunks) + MARK
        if "<|" in joined or joined.count(MARK) > len(chunks) or any(map(str.isspace, chunks)):
            odd = [i for i, c in enumerate(chunks) if "<|" in c or MARK in c or c.isspace()]
            common = [c for c in chunks if not ("<|" in c or MARK in c or c.isspace())]
            out = self(common) if common else []
            for i in odd:
                out.insert(i, self.whole(chunks[i]))
            return out
        if len(self.kept) > CACHED_WORDS:
            self.kept = {}
        words = self.pattern.findall(folded(joined) if self.fold else joined)
        distinct = set(words)
        distinct.discard(MARK)
        numbers = {w: self.kept[w] for w in distinct & self.kept.keys()}
        new = list(distinct - numbers.keys())
        made_new = dict(zip(new, self.words(new), strict=True))
        numbers.update(made_new)
        for w in [w for w in new if len(w) > CACHED_LENGTH]:
            del made_new[w]
        self.kept.update(made_new)
        numbers[MARK] = b"\0"  # one byte, and so no number
        made = list(map(numbers.__getitem__, words))
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        marks = np.cumsum(sizes)[sizes == 1].tolist()
        all_of = b"".join(made)
        return [all_of[a : b - 1] for a, b in itertools.pairwise([0, *marks])]


def _places(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs, one run after the other."""
    out = np.repeat(begins - (np.cumsum(lengths) - lengths), lengths)
    out += np.arange(len(out))
    return out


class Known:
    """The 32-bit numbers that belong to 64-bit hashes, in a table and a store.

    A table that is half full is put aside for the one before it; what it has is
    taken over when it is met again, and so what is frequent stays.
    """

    def __init__(self, slots: int) -> None:
        self.slots, self.aside = slots, None
        self._begin()

    def _begin(self) -> None:
        self.table, self.store, self.used = Table(self.slots), np.empty(1 << 16, np.uint32), 0

    def of(self, hashes: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """How many numbers each hash has, and all of these; make: the same of the hashes at some places, each of them new."""
        lengths, numbers = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        for i in range(0, len(hashes), self.slots // 4):
            values = self._values(hashes[i : i + self.slots // 4], lambda at, i=i: make(at + i))
            lengths.append(values & 0xFFFFFFFF)
            numbers.append(self.store[_places(values >> 32, lengths[-1])])
        return np.concatenate(lengths), np.concatenate(numbers)

    def _values(self, hashes: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Place << 32 | length in the store, of every hash."""
        found = self.table.find(hashes)
        lacking = np.flatnonzero(found < 0)
        if not len(lacking):
            return found
        new, first, number = np.unique(hashes[lacking], return_index=True, return_inverse=True)
        if self.table.size and (self.table.size + len(new) > self.slots // 2 or self.used > KEPT_NUMBERS):
            self.aside = self.table, self.store
            self._begin()
            return self._values(hashes, make)
        before = self.aside[0].find(new) if self.aside else np.full(len(new), -1)
        met = before >= 0
        lengths, more = before[met] & 0xFFFFFFFF, np.empty(0, np.uint32)
        if len(lengths):
            more = self.aside[1][_places(before[met] >> 32, lengths)]
        if not met.all():
            made = make(lacking[first[~met]])
            lengths, more = np.concatenate([lengths, made[0]]), np.concatenate([more, made[1]])
        if self.used + len(more) > len(self.store):
            self.store = np.concatenate([self.store[: self.used], np.empty(max(len(more), len(self.store)), np.uint32)])
        self.store[self.used : self.used + len(more)] = more
        values = np.empty(len(new), np.int64)
        values[np.concatenate([np.flatnonzero(met), np.flatnonzero(~met)])] = (self.used + np.cumsum(lengths) - lengths) << 32 | lengths
        self.used += len(more)
        self.table.add(new, values)
        found[lacking] = values[number]
        return found


class Chunks:
    """The 32-bit numbers that a function makes of each chunk, looked up for whole groups of texts.

    Chunks are told apart by 64-bit hashes. Those of a group are hashed and looked
    up together; only the ones that are not known are made, once each.
    make: from bytes, and where chunks start and end in them; slow: the numbers of a whole text, for texts with other white space.
    """

    def __init__(self, make: WordMaker, slow: Callable[[str], bytes], spaced: bool) -> None:
        self.make, self.slow, self.spaced = make, slow, spaced
        self.clear()

    def clear(self) -> None:
        self.known, self.make.known = Known(SLOTS), Known(SLOTS // 2)

    def _group(self, raw: list[bytes]) -> list[np.ndarray]:
        joined, starts, ends, first = chunk_spans(raw, self.spaced)
        hashes = Hashed(joined).substrings(starts, ends) | U(1)
        lengths, numbers = self.known.of(hashes, lambda at: self.make.of(joined, starts[at], ends[at]))
        edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])[first].tolist()
        return [numbers[a:b] for a, b in itertools.pairwise(edges)]

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The numbers of each text, in order."""
        held: list[np.ndarray] = []
        parts: list[bytes] = []
        owners: list[int] = []
        slow: dict[int, np.ndarray] = {}
        for i, t in enumerate(texts):
            if not t.isascii() and _ODD.search(t):
                slow[i] = np.frombuffer(self.slow(t), "<u4")
                continue
            for p in pieces_of(t.encode()):
                parts.append(p)
                owners.append(i)
        at = 0
        for lo, hi in groups_of(parts, LOOKUP_BYTES):
            for owner, numbers in zip(owners[lo:hi], self._group(parts[lo:hi]), strict=True):
                while at < owner:
                    yield slow[at] if at in slow else np.concatenate(held)
                    at, held = at + 1, []
                held.append(numbers)
        while at < len(texts):
            yield slow[at] if at in slow else np.concatenate(held)
            at, held = at + 1, []


class IdEncoder:
    """Ids of the tokenizers library, for whole texts at a time.

    A chunk that the table lacks is cut into the vocabulary's words here, and each
    new word is given to the library's model; a chunk that may hold a special
    string goes through the whole library.
    """

    def __init__(self, path: str, spaced: bool) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.spaced = self.tokenizer.model, spaced
        self.symbols = np.array([ord(c) for c in byte_alphabet()], "<u2")
        self.symbols[0] = ord("\n")  # closes a word
        pattern = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+" if spaced else WORD
        make = WordMaker(pattern, not spaced, self.of_words, self.text)
        self.chunks = Chunks(make, self.text, spaced)

    def of_words(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        raw = np.frombuffer(MARK.join(words).encode("utf-8"), np.uint8)
        symbols = self.symbols[raw].tobytes().decode("utf-16-le").split("\n")
        ids: list[int] = []
        ends, tokenize, number = [0], self.model.tokenize, attrgetter("id")
        for s in symbols:
            ids += map(number, tokenize(s))
            ends.append(4 * len(ids))
        all_of = as_bytes(ids)
        return [all_of[a:b] for a, b in itertools.pairwise(ends)]

    def text(self, text: str) -> bytes:
        """By the whole library."""
        return as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        return self.chunks.of(texts)

    def encode(self, text: str) -> bytes:
        return next(self.ids([text])).tobytes()


def as_bytes(numbers: list[int]) -> bytes:
    return array("I", numbers).tobytes()


#: Name under which a worker keeps its tokenizers and their tables.
OWNER = "tokens"


def token_counter(path: str) -> Chunks:
    """Numbers whose sum is the tokens of a text: one for each word."""
    kept = KEPT.setdefault(OWNER, {})
    if path not in kept:
        counter = HeapBpe(path)
        make = WordMaker(WORD, True, lambda words: [as_bytes([counter.count_word(w)]) for w in words], lambda c: as_bytes([counter.count_chunk(c)]))
        kept[path] = Chunks(make, lambda t: as_bytes([counter.count_chunk(c) for c in chunks_of(t)]), False)
    return kept[path]


def id_encoder(path: str, spaced: bool) -> IdEncoder:
    """spaced: whether the vocabulary keeps white space, so that a chunk has what stands before it."""
    kept = KEPT.setdefault(OWNER, {})
    if (path, spaced) not in kept:
        kept[path, spaced] = IdEncoder(path, spaced)
    return kept[path, spaced]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
