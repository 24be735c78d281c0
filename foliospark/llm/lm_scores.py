"""Cross-entropy difference of matched n-gram models of a target and of all documents.

Texts are packed into row blocks. Each row block sends the counts of its distinct
words and bigrams to blocks of n-grams, by hash; those add them up and send each
row block the totals of its own, in its order. So the models are spread over the
workers and grow with the corpus, and an n-gram that is everywhere costs a value
for each row block, not for each document.

The models are matched: of the background, which is all documents, each count is
taken as what is expected in a sample of the target's size. No sample is drawn.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import map_batches, materialize, release, texts_of
from foliospark.llm.words import groups_of, mix, words_of

U = np.uint64
#: UTF-8 bytes of text in a row block, and of the text whose n-grams make one block of n-grams.
ROW_BLOCK_BYTES, GRAM_BLOCK_BYTES = 4 << 20, 12 << 20
#: Bits that tell n-grams of one block apart, and of any n-gram at most.
LOCAL_BITS, MOST_BITS = 40, 62
#: Weight of the word probabilities in a bigram's, in tokens.
PRIOR = 4.0
STATS = ("target_kinds", "background_kinds", "vocabulary")
#: What stands before a first word, as a hash, and the last bit of an n-gram.
_START = U(0x5851F42D4C957F2D)
WORD, BIGRAM = 0, 1


def hash_bits(blocks: int) -> int:
    return min(MOST_BITS, LOCAL_BITS + (blocks - 1).bit_length())


def text_grams(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, bigram, n): the n-grams of every word, and the words of each text; a last word is the start's.

    A bigram is the word with the one before it; a first word's is with a start that is no word.
    """
    parts, pairs, n = [], [], []
    for lo, hi in groups_of(texts):
        words = words_of(texts[lo:hi])
        before = np.r_[U(0), words.hashes][: len(words.hashes)]
        before[words.first[:-1][np.diff(words.first) > 0]] = 0
        parts.append(words.hashes)
        pairs.append(mix(mix(before + U(1)) + words.hashes))
        n.append(np.diff(words.first))
    word, pair = np.concatenate([*parts, [_START]]), np.concatenate([np.empty(0, U), *pairs])
    drop = U(64 - bits)
    return word >> drop << U(1), pair >> drop << U(1) | U(BIGRAM), np.concatenate(n) if n else np.empty(0, np.int64)


def context_places(n: np.ndarray) -> np.ndarray:
    """Of every word, the place of the word before it; of first ones that of the start, behind all words."""
    total = int(n.sum())
    out = np.arange(total) - 1
    out[(np.cumsum(n) - n)[n > 0]] = total
    return out


def block_edges(grams: np.ndarray, blocks: int, bits: int) -> np.ndarray:
    """Where in sorted n-grams each block begins, and the end."""
    block = ((grams >> U(bits + 1 - 32)) * U(blocks)) >> U(32)
    return np.searchsorted(block, np.arange(blocks + 1, dtype=np.uint64))


def pack(values: np.ndarray) -> bytes:
    """Numbers under 2 ** 63, compressed byte place by byte place."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes, "zstd", asbytes=True) if len(values) else b""


def unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * n, "zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").ravel()


ROWS = "rows long, ids binary, known binary, words binary, ends binary, body binary, all_words long, size long"


def row_blocks(texts: DataFrame) -> DataFrame:
    """rows, ids, known, words, ends, body, all_words, size: the texts of a block of rows, compressed; texts: doc_id, text."""
    made = [0]  # in this task

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.encode() for t in batch.column(1).to_pylist()]
        ids, known = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        out = []
        for lo, hi in groups_of(texts, ROW_BLOCK_BYTES):
            body = b"".join(texts[lo:hi])
            packed = len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)
            ends = np.cumsum([len(t) for t in texts[lo:hi]]).astype("<i8")
            words = np.concatenate([np.diff(words_of(texts[lo + i : lo + j]).first) for i, j in groups_of(texts[lo:hi])]).astype("<i8")
            out.append((TaskContext.get().partitionId() << 32 | made[0], ids[lo:hi].tobytes(), known[lo:hi].tobytes(), words.tobytes(), ends.tobytes(), packed, int(words.sum()), len(body)))
            made[0] += 1
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:6]), *(pa.array(c, pa.int64()) for c in columns[6:])], names=[x.split(" ")[0] for x in ROWS.split(", ")])

    return map_batches(texts, run, ROWS, ROW_BLOCK_BYTES)


def places(packed: DataFrame) -> DataFrame:
    """rows, at, doc_id, words of every row that has an id."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = [np.flatnonzero(np.frombuffer(x, bool)) for x in batch.column(2).to_pylist()]
        ids, words = ([np.frombuffer(x, "<i8")[k] for x, k in zip(batch.column(c).to_pylist(), known, strict=True)] for c in (1, 3))
        rows = np.repeat(batch.column(0).to_numpy(), [len(k) for k in known])
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.concatenate(known).astype(np.int32)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(words))], names=["rows", "at", "doc_id", "words"])

    return map_batches(packed.select("rows", "ids", "known", "words"), run, "rows long, at int, doc_id long, words long")


def texts_in(ends: bytes, body: bytes) -> list[bytes]:
    data, at = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True), np.r_[0, np.frombuffer(ends, "<i8")].tolist()
    return [data[a:b] for a, b in itertools.pairwise(at)]


def totals(marked: DataFrame, blocks: int, share: float) -> DataFrame:
    """block, rows, n, target, background: the totals of the n-grams of each row block, in their sorted order; and STATS.

    STATS, to be added up, stand in one row of each block: the kinds of words of the
    target, those expected in a ``share`` of all words, and those there are.
    """
    bits = hash_bits(blocks)

    def cells(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(6)]
        for rows, targets, ends, body in zip(*(batch.column(c).to_pylist() for c in ("rows", "targets", "ends", "body")), strict=True):
            word, pair, n = text_grams(texts_in(ends, body), bits)
            if not len(pair):
                continue
            chosen = np.zeros(len(n), bool)
            chosen[targets or []] = True
            inside = np.repeat(chosen, n)
            # starts count once for each text with words
            grams = np.concatenate([word[:-1], pair, np.repeat(word[-1], int((n > 0).sum()))])
            distinct, all_of = np.unique(grams, return_counts=True)
            target = np.zeros(len(distinct), np.int64)
            found, counts = np.unique(np.concatenate([word[:-1][inside], pair[inside], np.repeat(word[-1], int((n[chosen] > 0).sum()))]), return_counts=True)
            target[np.searchsorted(distinct, found)] = counts
            for b, (i, j) in enumerate(itertools.pairwise(block_edges(distinct, blocks, bits).tolist())):
                if i < j:
                    row = (b, rows, j - i, pack(np.diff(distinct[i:j], prepend=U(0))), pack(target[i:j]), pack(all_of[i:j]))
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[3:])], names=["block", "rows", "n", "grams", "target", "background"])

    def add(table: pa.Table) -> pa.Table:
        release()
        sizes = table.column("n").to_pylist()
        grams = [np.cumsum(unpack(x, k)) for x, k in zip(table.column("grams").to_pylist(), sizes, strict=True)]
        distinct, number = np.unique(np.concatenate(grams), return_inverse=True)
        sums = []
        for c in ("target", "background"):
            each = np.concatenate([unpack(x, k) for x, k in zip(table.column(c).to_pylist(), sizes, strict=True)])
            sums.append(np.bincount(number, weights=each, minlength=len(distinct)).astype(np.int64))
        back = [[pack(s[number[i:j]]) for s in sums] for i, j in itertools.pairwise(np.cumsum([0, *sizes]).tolist())]
        word = (distinct & 1 == WORD) & (distinct != int(_START >> U(64 - bits) << U(1)))
        n = len(grams)
        expected = word.sum() if share >= 1 else -np.expm1(sums[1][word] * np.log1p(-share)).sum()
        stats = [float((sums[0][word] > 0).sum()), float(expected), float(word.sum())]
        first = [pa.array([s] + [0.0] * (n - 1), pa.float64()) for s in stats]  # once for each block
        return pa.table([table.column("block"), table.column("rows"), table.column("n"), *(pa.array([x[k] for x in back], pa.binary()) for k in (0, 1)), *first], names=["block", "rows", "n", "target", "background", *STATS])

    cut = map_batches(marked.select("rows", "targets", "ends", "body"), cells, "block int, rows long, n int, grams binary, target binary, background binary", ROW_BLOCK_BYTES)
    return cut.groupBy("block").applyInArrow(add, "block int, rows long, n int, target binary, background binary, " + ", ".join(f"{s} double" for s in STATS))


SCORES = "doc_id long, n_tokens long, target_bits double, background_bits double, difference double, prefers_target boolean"


def word_cross_entropy_difference(spark: SparkSession, docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_bits, background_bits, difference, prefers_target.

    The target is the rows whose id is in ``target_ids`` (one id column), the
    background all rows, at the target's size: with f = target words / all words,
    its counts are f times those of all rows, and its kinds of words those that a
    share f of them is expected to have. Both are bigram models over words (white
    space apart, A-Z lower-cased) with one smoothing, and share the words of all
    rows as vocabulary:
    p(word | before) = (pairs + PRIOR * p(word)) / (count of before + PRIOR), where
    a start stands before each first word, and p(word) is Witten-Bell interpolation
    with uniform. bits: mean loss of a token; difference: target less background,
    lower is closer to the target.

    Empty and null texts have 0 tokens and 0 bits, and do not prefer the target.
    Without any target text both models are uniform. Null ids are no targets; of
    equal ids all rows are; repeated rows count each; an empty table gives no rows.
    Words and pairs are told apart by hashes of LOCAL_BITS within a block.
    """
    texts = texts_of(docs, id_col, text_col)
    wanted = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("wanted")).where("wanted IS NOT NULL").distinct()
    packed = materialize(spark, row_blocks(texts), "lm-rows")
    found = places(packed).join(wanted.hint("merge"), F.col("doc_id") == F.col("wanted"))
    chosen = materialize(spark, found.groupBy(F.col("rows").alias("of")).agg(F.collect_list("at").alias("targets"), F.sum("words").alias("of_target")), "lm-targets")
    target_words = chosen.agg(F.sum("of_target")).first()[0] or 0
    all_words, size = (x or 0 for x in packed.agg(F.sum("all_words"), F.sum("size")).first())
    share = target_words / all_words if all_words else 0.0
    marked = packed.join(chosen.hint("merge"), F.col("rows") == F.col("of"), "left")
    blocks = max(1, -(-size // GRAM_BLOCK_BYTES))
    bits = hash_bits(blocks)
    back = materialize(spark, totals(marked, blocks, share), "lm-totals")
    kinds = [x or 0.0 for x in back.agg(*(F.sum(s) for s in STATS)).first()]
    vocabulary = max(1.0, kinds[2])

    def loss(sums: np.ndarray, scale: float, kinds: float, word: np.ndarray, before: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """-log2 p of every word; word, before, pair: the places of their n-grams in the sums."""
        p = (scale * sums[word] + kinds / vocabulary) / (target_words + kinds) if target_words else np.full(len(word), 1 / vocabulary)
        return -np.log2((scale * sums[pair] + PRIOR * p) / (scale * sums[before] + PRIOR))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        out = []
        order = np.argsort(right.column("block").to_numpy())
        right = right.take(pa.array(order))
        sizes = right.column("n").to_pylist()
        sums = [np.concatenate([np.empty(0, np.int64), *(unpack(x, k) for x, k in zip(right.column(c).to_pylist(), sizes, strict=True))]) for c in ("target", "background")]
        for ids, known, ends, body in zip(*(left.column(c).to_pylist() for c in ("ids", "known", "ends", "body")), strict=True):
            word, pair, n = text_grams(texts_in(ends, body), bits)
            total = len(pair)
            number = np.unique(np.concatenate([word, pair]) if total else np.empty(0, U), return_inverse=True)[1]
            at = number[:total], number[context_places(n)], number[total + 1 :]
            owner, least = np.repeat(np.arange(len(n)), n), np.maximum(n, 1)
            t, b = (np.bincount(owner, weights=loss(s, f, k, *at), minlength=len(n)) / least for s, f, k in zip(sums, (1.0, share), kinds[:2], strict=True))
            doc_id = pa.array(np.frombuffer(ids, "<i8"), mask=~np.frombuffer(known, bool))
            out.append(pa.table([doc_id, pa.array(n, pa.int64()), pa.array(t), pa.array(b), pa.array(t - b), pa.array(t < b)], names=[x.split(" ")[0] for x in SCORES.split(", ")]))
        return pa.concat_tables(out)

    rows = packed.select("rows", "ids", "known", "ends", "body").groupBy("rows")
    return rows.cogroup(back.select("rows", "block", "n", "target", "background").groupBy("rows")).applyInArrow(score, SCORES)
