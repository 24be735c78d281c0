"""Harmonic packing of tokenized documents into fixed-size sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm import bpe
from foliospark.llm.common import map_batches, materialize, texts_of

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Pieces of one class that one worker packs by itself.
GROUP_PIECES = 100_000
#: Groups whose unfilled bins are packed together at the next level.
FAN_IN = 32


def cut_lengths(n: int, capacity: int, smallest: int) -> list[int]:
    """``n`` as full sequences, then capacity / 2, / 4 ... down to ``smallest``, then what is left.

    Each of these but the last fills a whole number of bins of its class without padding.
    """
    out, size = [capacity] * (n // capacity), capacity // 2
    n %= capacity
    while size >= smallest:
        if n >= size:
            out.append(size)
            n -= size
        size //= 2
    return [*out, n] if n else out


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, smallest: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document, with the checksum of their ids; a null or empty text is the end id alone."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = bpe.id_encoder(bpe.tokenizer_path(tokenizer), True)
        end = np.array([end_id], np.uint32)
        out: list[list] = [[], [], [], [], []]
        for doc, found in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1).to_pylist()), strict=True):
            ids = np.concatenate([found, end])
            start = 0
            for n in cut_lengths(len(ids), capacity, smallest):
                for column, value in zip(out, (doc, start, n, zlib.crc32(ids[start : start + n]), len(ids)), strict=True):
                    column.append(value)
                start += n
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_batches(texts_of(docs, id_col, text_col), cut, PIECES, keeps=bpe.OWNER)


def _fill(rows: DataFrame, level: int, salts: int, capacity: int) -> DataFrame:
    """Numbers the bins of each (class, salt); ``full`` says whether a bin has its fixed count."""
    group = Window.partitionBy("class", "salt")
    one_bin = Window.partitionBy("class", "salt", "bin").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.lit(level)), F.lit(salts)))
        .withColumn("rn", F.row_number().over(group.orderBy("doc_id", "start", "ids_crc32", "length", "doc_tokens")) - 1)
        .withColumn("n", F.count(F.lit(1)).over(group))
        .withColumn("bin", F.expr("rn div class"))
        .withColumn("full", F.expr("bin < n div class"))
        .withColumn("offset", F.coalesce(F.sum("length").over(one_bin), F.lit(0)))
    )


def pack_pieces(spark: SparkSession, cut: DataFrame, capacity: int) -> DataFrame:
    """Assigns a sequence and an offset to each piece of a stored table.

    Class k holds the lengths in (capacity / (k + 1), capacity / k], and k of them
    make a bin. Groups of pieces, by hash, fill their classes' bins without a word
    to each other. What stays in unfilled bins goes to a level with fewer groups,
    and so on; the last few pieces, under one bin a class, go first-fit. Ties are
    broken by the pieces' columns, so equal pieces may change places; null ids are
    ids like others; rows that repeat are packed each; an empty table gives no rows.
    """
    n = cut.count()
    salts, level, first = max(1, -(-n // GROUP_PIECES)), 0, 0
    rest = cut.withColumn("class", F.expr(f"{capacity} div length"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    done = []
    while True:
        filled = _fill(rest, level, salts, capacity)
        # 24 bits for level and group, 11 for the class, 28 for the bin
        number = (F.lit(first) + F.col("salt")).cast("long")
        sequence = F.shiftleft(number, 39) + F.shiftleft(F.col("class").cast("long"), 28) + F.col("bin").cast("long")
        done.append(filled.where("full").select(*columns, sequence.alias("sequence_id"), "offset"))
        rest = materialize(spark, filled.where("NOT full").select(*columns, "class"), "pack-rest")
        first += salts
        level += 1
        if salts == 1:
            break
        salts = max(1, salts // FAN_IN)

    def first_fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        used: list[int] = []
        bins, offsets = [], []
        for n in rows["length"].tolist():
            at = next((i for i, u in enumerate(used) if u + n <= capacity), len(used))
            if at == len(used):
                used.append(0)
            bins.append(at)
            offsets.append(used[at])
            used[at] += n
        rows["sequence_id"] = np.int64(first << 39) + np.array(bins, "int64")
        rows["offset"] = np.array(offsets, "int64")
        return rows[[*columns, "sequence_id", "offset"]]

    last = rest.groupBy(F.lit(0).alias("one")).applyInPandas(lambda rows: first_fit(rows[columns]), PIECES + ", sequence_id long, offset long")
    out = last
    for part in done:
        out = out.unionByName(part)
    return out


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, smallest: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document gets ``end_id`` after its ids, so a null or empty text is one
    piece of one token; an empty table gives no rows; rows that repeat are packed
    each. Documents are tokenized once and only lengths and checksums are kept.
    """
    cut = materialize(spark, pieces(docs, tokenizer, end_id, capacity, smallest, id_col, text_col), "pack-pieces")
    return pack_pieces(spark, cut, capacity)
