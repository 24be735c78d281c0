"""Token-id shards in a Re-Pair grammar format, written and read as Parquet blocks.

A block holds the ids of some documents, in order. Frequent adjacent pairs are
replaced by new symbols, round after round, until none is left that is frequent;
no pair starts at an end id, so no symbol reaches over the end of a document and
each can be decoded alone, by the number of its symbols.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm import bpe
from foliospark.llm.common import map_batches, new_path, release, texts_of

#: UTF-8 bytes for each sorted partition, and ids for each block within.
SHARD_BYTES, BLOCK_IDS = 8 << 20, 1 << 20
#: Shards whose blocks are numbered together.
RUN_SHARDS = 1024
#: Occurrences in a block that make a pair frequent.
LEAST_COUNT = 8
_U = np.uint64

BLOCK = "shard int, block int, doc_ids binary, doc_tokens binary, doc_symbols binary, first_rule long, rules binary, lengths binary, symbols binary"
DOCS = "doc_id long, n_tokens long, ids_crc32 long, inside long, shard int, block int"


@dataclass
class Grammar:
    """symbols: what is left of the ids; rules[i]: the two symbols that ``first_rule + i`` stands for; lengths[i]: the ids it expands to."""

    symbols: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    first_rule: int

    def symbol_lengths(self) -> np.ndarray:
        out = np.ones(len(self.symbols), "int64")
        new = self.symbols >= self.first_rule
        out[new] = self.lengths[self.symbols[new] - self.first_rule]
        return out

    @cached_property
    def ends(self) -> np.ndarray:
        """Ids up to the end of each symbol."""
        return np.cumsum(self.symbol_lengths())

    @cached_property
    def _opened(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids that the rules stand for, one rule after the other, and where each one's begin."""
        out = self.rules.ravel()
        while (new := out >= self.first_rule).any():
            at = np.cumsum(1 + new) - (1 + new)
            opened = np.empty(len(out) + int(new.sum()), "int64")
            opened[at[~new]] = out[~new]
            pair = self.rules[out[new] - self.first_rule]
            opened[at[new]], opened[at[new] + 1] = pair[:, 0], pair[:, 1]
            out = opened
        return out, np.cumsum(self.lengths) - self.lengths

    def expand(self, lo: int, hi: int) -> np.ndarray:
        """The ids of the symbols from lo to hi."""
        symbols = self.symbols[lo:hi]
        new = np.flatnonzero(symbols >= self.first_rule)
        opened, starts = self._opened
        rule = symbols[new] - self.first_rule
        lengths = np.ones(len(symbols), "int64")
        lengths[new] = self.lengths[rule]
        begins = np.cumsum(lengths) - lengths
        source = np.arange(len(symbols)) + len(opened)  # symbols that are ids stand behind what the rules stand for
        source[new] = starts[rule]
        at = np.repeat(source - begins, lengths)
        at += np.arange(len(at))
        return np.concatenate([opened, symbols]).astype(np.uint32).take(at)

    def decode(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, by the expansion lengths, without the rest."""
        lo, hi = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left") + 1
        before = int(self.ends[lo - 1]) if lo else 0
        return self.expand(lo, hi)[start - before : stop - before]


def compress(ids: np.ndarray, end_id: int) -> Grammar:
    """Re-Pair by rounds: every pair that is frequent gets a nonterminal, until none is.

    After a round no pair of older symbols is frequent, so that only pairs with
    one of its new symbols have to be counted for the next. Where occurrences
    overlap, the first of a run is replaced and then every other.
    """
    seq = ids.astype(np.uint64)
    first = int(ids.max(initial=end_id)) + 1
    place = _U(max(1, len(seq).bit_length()))
    half = (_U(64) - place) // _U(2)
    rules, lengths, known = [], [], np.ones(first, "int64")
    base, at = first, np.flatnonzero(seq[:-1] != _U(end_id)).astype(np.uint64)
    while len(at) >= LEAST_COUNT:
        here = at.view(np.int64)
        keys = seq.take(here)
        keys <<= half
        keys |= seq[1:].take(here)
        keys <<= place
        keys |= at
        keys.sort()
        pairs = keys >> place
        starts, counts = _runs(pairs)
        often = counts >= LEAST_COUNT
        if not often.any() or base + int(often.sum()) >= 1 << int(half):
            break
        inside = np.repeat(often, counts)
        place_of = (keys[inside] & ((_U(1) << place) - _U(1))).view(np.int64)
        number = np.repeat(np.arange(int(often.sum()), dtype=np.int32), counts[often])
        if len(number) > len(seq) >> 5:  # in the order of places, without a sort
            rule_at = np.full(len(seq), -1, np.int32)
            rule_at[place_of] = number
            where = np.flatnonzero(rule_at >= 0)
            number = rule_at.take(where)
        else:
            order = np.argsort(place_of)
            where, number = place_of.take(order), number.take(order)
        first_of_run = np.ones(len(where), bool)
        np.not_equal(where[1:], where[:-1] + 1, out=first_of_run[1:])
        heads = np.flatnonzero(first_of_run)
        odd_head = np.repeat(heads & 1, np.diff(heads, append=len(where))).astype(bool)
        alternate = np.flatnonzero(odd_head == (np.arange(len(where), dtype=np.int32) & 1).astype(bool))
        where, rule = where.take(alternate), number.take(alternate)
        pair = pairs[starts[often]]
        new = np.stack([pair >> half, pair & ((_U(1) << half) - _U(1))], 1).astype("int64")
        rules.append(new)
        lengths.append(known[new[:, 0]] + known[new[:, 1]])
        known = np.concatenate([known, lengths[-1]])
        seq[where] = rule + base
        base += len(new)
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        seq = seq[keep]
        made = where - np.arange(len(where))
        beside = np.zeros(len(seq), bool)
        beside[made] = True
        beside[made[made > 0] - 1] = True
        beside[-1] = False
        at = np.flatnonzero(beside & (seq != _U(end_id))).astype(np.uint64)
    rules = np.concatenate(rules) if rules else np.empty((0, 2), "int64")
    return Grammar(seq.astype("int64"), rules, np.concatenate([np.empty(0, "int64"), *lengths]), first)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts, and how long it is."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    return starts, np.diff(starts, append=len(values))


def _narrow(a: np.ndarray) -> bytes:
    """As little-endian numbers of 2, 3 or 4 bytes, as told by a first byte; the third byte of 3 follows the others."""
    most = int(a.max(initial=0))
    if most < 1 << 16:
        return b"\2" + a.astype("<u2").tobytes()
    if most < 1 << 24:
        return b"\3" + (a & 0xFFFF).astype("<u2").tobytes() + (a >> 16).astype(np.uint8).tobytes()
    return b"\4" + a.astype("<u4").tobytes()


def _wide(b: bytes) -> np.ndarray:
    if b[0] == 3:
        n = len(b) // 3
        return np.frombuffer(b, "<u2", n, 1).astype("int64") | np.frombuffer(b, np.uint8, n, 1 + 2 * n).astype("int64") << 16
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype("int64")


def encode_block(shard: int, block: int, docs: list[int | None], ids: list[np.ndarray], end_id: int) -> list:
    """A row of BLOCK, of documents' ids with the end id. A null doc id is kept as the least 64-bit number."""
    tokens = np.array([len(x) for x in ids], "int64")
    grammar = compress(np.concatenate(ids), end_id)
    ends = np.searchsorted(grammar.ends, np.cumsum(tokens)) + 1
    doc_ids = np.array([-(2**63) if d is None else d for d in docs], "<i8").tobytes()
    return [shard, block, doc_ids, _narrow(tokens), _narrow(np.diff(np.r_[0, ends])), grammar.first_rule, _narrow(grammar.rules.ravel()), _narrow(grammar.lengths), _narrow(grammar.symbols)]


def grammar_of(row: dict) -> Grammar:
    return Grammar(_wide(row["symbols"]), _wide(row["rules"]).reshape(-1, 2), _wide(row["lengths"]), row["first_rule"])


def write_shards(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes all documents and writes their blocks, in ascending id order, to ``path``.

    The table is range-partitioned by id, so each shard is sorted and encoded by
    itself; a task holds one block of ids at a time. Equal ids are ordered by a hash
    of their texts, by which rows of one id or without one are parted too.
    """
    texts = texts_of(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    names = [c.split(" ")[0] for c in BLOCK.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release(bpe.OWNER)
        encoder = bpe.id_encoder(bpe.tokenizer_path(tokenizer), False)
        end = np.array([end_id], np.uint32)
        shard, block, held = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        owners: list[int | None] = []

        def flush() -> pa.RecordBatch:
            row = encode_block(shard, block, owners, ids, end_id)
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            for doc, found in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1).to_pylist()), strict=True):
                ids.append(np.concatenate([found, end]))
                owners.append(doc)
                held += len(ids[-1])
                if held >= BLOCK_IDS:
                    yield flush()
                    ids, owners, held, block = [], [], 0, block + 1
        if ids:
            yield flush()

    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = texts.repartitionByRange(shards, *order[:2]).sortWithinPartitions(*order)
    ordered.mapInArrow(encode, BLOCK).write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Decodes every block: doc_id, n_tokens, ids_crc32, the ids before it in its block, and the block."""
    blocks = spark.read.parquet(path)

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], [], []]
        for row in batch.to_pylist():
            grammar = grammar_of(row)
            ids = grammar.expand(0, len(grammar.symbols)).astype("<u4").tobytes()
            at = 0
            owners = np.frombuffer(row["doc_ids"], "<i8").tolist()
            for doc, n in zip(owners, _wide(row["doc_tokens"]).tolist(), strict=True):
                values = (None if doc == -(2**63) else doc, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), at, row["shard"], row["block"])
                for column, value in zip(out, values, strict=True):
                    column.append(value)
                at += n
        types = [pa.int64()] * 4 + [pa.int32()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "n_tokens", "ids_crc32", "inside", "shard", "block"])

    return map_batches(blocks, decode, DOCS)


def read_documents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, ids (array) of the documents whose id is in ``wanted`` (one id column); the rest is not expanded.

    A block's documents are found by their ids, and their symbols by the numbers
    of symbols before them. An id that several rows have gives a row for each.
    """
    blocks = spark.read.parquet(path)
    kind = pa.list_(pa.int64())

    def places(batch: pa.RecordBatch) -> pa.RecordBatch:
        owners = [np.frombuffer(x, "<i8") for x in batch.column(2).to_pylist()]
        sizes = [len(x) for x in owners]
        columns = [np.repeat(batch.column(k).to_numpy(), sizes) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(np.concatenate([np.empty(0, "<i8"), *owners])), pa.array(np.concatenate([np.empty(0, np.int64), *map(np.arange, sizes)]), pa.int64())], names=["shard", "block", "doc_id", "at"])

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, found = [], []
        for row in batch.to_pylist():
            grammar, owners, ends = grammar_of(row), np.frombuffer(row["doc_ids"], "<i8"), np.cumsum(_wide(row["doc_symbols"]))
            for k in row["at"]:
                ids.append(int(owners[k]))
                found.append(grammar.expand(int(ends[k - 1]) if k else 0, int(ends[k])))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, kind)], names=["doc_id", "ids"])

    owned = map_batches(blocks.select("shard", "block", "doc_ids"), places, "shard int, block int, doc_id long, at long")
    asked = wanted.select(F.col(wanted.columns[0]).cast("long").alias("doc_id")).distinct()
    chosen = owned.join(asked, "doc_id").groupBy("shard", "block").agg(F.sort_array(F.collect_list("at")).alias("at"))
    return map_batches(blocks.join(chosen, ["shard", "block"]), decode, "doc_id long, ids array<long>")


def shard_index(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards, reads them back, and gives doc_id, start, n_tokens and ids_crc32 of each document.

    A null or empty text is the end id alone; null ids come first; an empty table
    gives no rows; rows that repeat are stored each.
    """
    path = path or new_path(spark, "token-shards")
    write_shards(spark, docs, path, tokenizer, end_id, id_col, text_col)
    found = read_shards(spark, path)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        totals = [int(_wide(x).sum()) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(totals, pa.int64())], names=["shard", "block", "n"])

    totals = map_batches(spark.read.parquet(path).select("shard", "block", "doc_tokens"), count, "shard int, block int, n long")
    # a sum for each run of shards, of which there are few; then one for each block within its run
    totals = totals.withColumn("run", F.expr(f"shard div {RUN_SHARDS}"))
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    runs = totals.groupBy("run").agg(F.sum("n").alias("n")).select("run", F.coalesce(F.sum("n").over(ahead.orderBy("run")), F.lit(0)).alias("of_run"))
    inside = F.coalesce(F.sum("n").over(ahead.partitionBy("run").orderBy("shard", "block")), F.lit(0))
    starts = totals.select("run", "shard", "block", inside.alias("inside_run")).join(runs, "run").select("shard", "block", (F.col("of_run") + F.col("inside_run")).alias("before"))
    return found.join(starts.hint("shuffle_hash"), ["shard", "block"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
