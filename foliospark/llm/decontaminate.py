"""Benchmark decontamination: CGK embeddings, bit-sampling LSH, exact edit distances.

The Chakraborty-Goldenberg-Koucky random walk maps sequences so that few edits
become few differing places. Item-sized windows are embedded by several walks and
looked up in the buckets of all items of that size, by a number of random samples
of places; what shares a bucket is verified by the exact word edit distance. The
number of samples is set from the target recall and from the agreement that the
items themselves show after as many random edits as are allowed.

Windows are taken where as many n-grams of items occur as must remain whatever
the allowed edits do; elsewhere nothing can be close to an item.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import map_batches, texts_of
from foliospark.llm.patterns import GramIndex, candidates, pattern_words
from foliospark.llm.words import grams_of, mix

#: UTF-8 bytes of items that are sent to the workers at a time.
ITEM_BLOCK_BYTES = 8 << 20
WALKS, PLACES = 4, 2


def edits_allowed(words: int, similarity: float) -> int:
    return int(words * (1 - similarity) + 1e-9)


def gram_size(words: int, edits: int) -> int:
    """Words that some run of the item must keep whatever ``edits`` do: (words - edits) matches in edits + 1 runs."""
    return max(1, min(3, -(-(words - edits) // (edits + 1))))


def embed(sequences: np.ndarray, walk: int) -> np.ndarray:
    """CGK: each output place copies the current word; a random bit of place and word says whether to go on.

    sequences: rows of word hashes, 0 beyond the end. Three places for each word.
    """
    n, m = sequences.shape
    padded = np.concatenate([sequences, np.zeros((n, 1), np.uint64)], 1)
    at, row = np.zeros(n, np.int64), np.arange(n)
    out = np.empty((n, 3 * m), np.uint64)
    salts = mix(np.arange(1, 3 * m + 1, dtype=np.uint64) * np.uint64(2654435761) + np.uint64(walk << 40))
    for j in range(3 * m):
        word = padded[row, at]
        out[:, j] = word
        at = np.minimum(at + (mix(word ^ salts[j]) >> np.uint64(63)).astype(np.int64), m)
    return out


def best_match(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """(edit distance, end) of the substring of ``region`` closest to ``item``; the first end among equals."""
    n = len(region)
    steps = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    for w in item:
        new = np.r_[row[0] + 1, np.minimum(row[:-1] + (region != w), row[1:] + 1)]
        row = np.minimum.accumulate(new - steps) + steps
    end = int(np.argmin(row))
    return int(row[end]), end


def grams_kept(words: int, edits: int) -> int:
    """How many of the item's n-grams at least remain: an edit destroys n of them."""
    n = gram_size(words, edits)
    return max(1, words - n + 1 - n * edits)


@dataclass
class Buckets:
    """The items of one size. samples[r]: places of walk r, two a sample; keys, items: what the items' samples hold, by key."""

    samples: list[np.ndarray]
    keys: np.ndarray
    items: np.ndarray

    def find(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of every two that agree in a sample."""
        found: list[list[np.ndarray]] = [[], []]
        for r in range(WALKS):
            keys = sample_keys(embed(windows, r), self.samples[r], r)
            lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
            window, sample = np.nonzero(hi > lo)
            times = (hi - lo)[window, sample]
            row = np.repeat(lo[window, sample], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            found[0].append(np.repeat(window, times))
            found[1].append(self.items[row])
        pairs = np.unique(np.stack([np.concatenate(x) for x in found], 1), axis=0)
        return pairs[:, 0], pairs[:, 1]


def sample_keys(embedded: np.ndarray, samples: np.ndarray, walk: int) -> np.ndarray:
    """A hash of walk, sample and what stands in its places, for each row and sample."""
    out = mix(np.arange(len(samples), dtype=np.uint64) + np.uint64(walk << 32))[None, :]
    for column in samples.T:
        out = mix(out + embedded[:, column])
    return out


@dataclass
class Items:
    ids: list[int]
    words: list[np.ndarray]
    edits: list[int]
    buckets: dict[int, Buckets]
    index: GramIndex


def _rows(sequences: list[np.ndarray], size: int) -> np.ndarray:
    out = np.zeros((len(sequences), size), np.uint64)
    for row, s in zip(out, sequences, strict=True):
        row[: min(size, len(s))] = s[:size]
    return out


def samples_needed(recall: float, chance: float) -> float:
    """How many samples, of which each agrees with this chance, until one does with the target recall."""
    return float("inf") if chance <= 0 else 1 if chance >= 1 else float(np.ceil(np.log(1 - recall) / np.log(1 - chance)))


def prepare(ids: list[int], texts: list[str], similarity: float, recall: float, trials: int = 3) -> Items:
    """Embeds the items and draws, for those of each size, as many samples as the target recall needs.

    Samples are of places at which no item's walk has ended. The chance that one
    agrees is taken from the worst of some trials in which an item gets as many
    random edits as are allowed. Where that asks for more samples than there are
    pairs of places, all pairs are taken.
    """
    rng = np.random.default_rng(11)
    found = [(i, w) for i, w in zip(ids, map(pattern_words, texts), strict=True) if len(w)]
    words, edits = [w for _, w in found], [edits_allowed(len(w), similarity) for _, w in found]
    by_size: dict[int, list[int]] = {}
    for p, w in enumerate(words):
        by_size.setdefault(len(w), []).append(p)
    buckets = {}
    for m, items in by_size.items():
        edited = []
        for p in items:
            for _ in range(trials):
                new = list(words[p])
                for _ in range(edits[p]):
                    at, kind = int(rng.integers(len(new))), int(rng.integers(3))
                    new[at : at + (kind != 1)] = [] if kind == 2 and len(new) > 1 else [rng.integers(1, 2**63, dtype=np.uint64)]
                edited.append(np.array(new[:m], np.uint64))
        walks = [embed(_rows([words[p] for p in items], m), r) for r in range(WALKS)]
        live = max(1, min(int((walk != 0).sum(1).min()) for walk in walks))
        same = np.mean([(embed(_rows(edited, m), r)[:, :live] == np.repeat(walks[r][:, :live], trials, 0)).mean(1) for r in range(WALKS)], axis=0)
        every = np.stack(np.triu_indices(live, 0 if live == 1 else 1), 1)
        number = samples_needed(recall, float(same.min()) ** PLACES)
        samples = [every if number >= WALKS * len(every) else rng.integers(0, live, (int(number) // WALKS + 1, PLACES)) for _ in range(WALKS)]
        keys = np.concatenate([sample_keys(walks[r], samples[r], r).ravel() for r in range(WALKS)])
        owners = np.concatenate([np.repeat(np.array(items), len(samples[r])) for r in range(WALKS)])
        order = np.argsort(keys, kind="stable")
        buckets[m] = Buckets(samples, keys[order], owners[order])
    entries = [(n, h, p, i) for p, w in enumerate(words) for n in [gram_size(len(w), edits[p])] for i, h in enumerate(grams_of(w, n).tolist())]
    return Items([i for i, _ in found], words, edits, buckets, GramIndex(entries))


def windows_of(hashes: np.ndarray, starts: list[int], size: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, windows): item-sized windows at the starts and at places within the slack to either side."""
    at = np.unique(np.array([s + d for s in starts for d in range(-slack, slack + 1, max(1, slack // 2))], np.int64))
    at = at[(at > -size) & (at < len(hashes))]
    place = at[:, None] + np.arange(size)
    ok = (place >= 0) & (place < len(hashes))
    return at, np.where(ok, hashes[np.clip(place, 0, len(hashes) - 1)], np.uint64(0))


MATCH = "doc_id long, item_id long, distance int, item_words int, similarity double, start int, stop int"


def apart(starts: list[int], gap: int) -> list[int]:
    """Of ascending starts, those at least ``gap`` after the last one taken."""
    out: list[int] = []
    for s in starts:
        if not out or s - out[-1] >= gap:
            out.append(s)
    return out


def find_leaks(docs: DataFrame, items: Items) -> DataFrame:
    slack = np.array([max(1, k) for k in items.edits], np.int64)
    edits_of = {len(w): k for w, k in zip(items.words, items.edits, strict=True)}
    least = np.array([grams_kept(len(w), k) for w, k in zip(items.words, items.edits, strict=True)], np.int64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        rows = []
        # where items of one size may be, in one text
        places: dict[tuple[int, int], list] = {}
        for t, p, starts, hashes, begin, end in candidates(batch.column(1).to_pylist(), items.index, slack, least):
            held = places.setdefault((t, len(items.words[p])), [set(), hashes, begin, end])
            held[0].update(starts)
        for (t, m), (starts, hashes, begin, end) in places.items():
            k = edits_of[m]
            at, windows = windows_of(hashes, sorted(starts), m, k)
            window, found = items.buckets[m].find(windows)
            for p in np.unique(found).tolist():
                item, best = items.words[p], None
                for s in apart(at[window[found == p]].tolist(), max(1, k)):
                    lo, hi = max(0, s - 2 * k), min(len(hashes), s + m + 3 * k)
                    distance, stop = best_match(item, hashes[lo:hi])
                    if distance <= k and (best is None or distance < best[0]):
                        back = best_match(item[::-1], hashes[lo : lo + stop][::-1])[1]
                        best = (distance, lo + stop - back, lo + stop)
                if best:
                    rows.append((ids[t], items.ids[p], best[0], m, 1 - best[0] / m, int(begin[best[1]]), int(end[best[2] - 1])))
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types, strict=True)], names=[x.strip().split(" ")[0] for x in MATCH.split(",")])

    return map_batches(docs, run, MATCH)


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, similarity: float = 0.75, recall: float = 0.99, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, distance, item_words, similarity, start, stop: documents with a passage close to an item.

    Close: the word edit distance (words lower-cased, punctuation aside) is at most
    (1 - similarity) of the item's words. start, stop: its span in bytes of the
    lower-cased text. One row, the best and first, for each row of ``docs`` and
    item. Items are sent to the workers in blocks of a fixed size. Items without
    words match nothing; null texts are empty; no items or no documents: no rows.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, texts, out = max(1, -(-size // ITEM_BLOCK_BYTES)), texts_of(docs, id_col, text_col), None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).distinct().orderBy("item_id", "text").collect()
        found = find_leaks(texts, prepare([r[0] for r in rows], [r[1] for r in rows], similarity, recall))
        out = found if out is None else out.unionByName(found)
    return out
