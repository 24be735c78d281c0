"""Exact removal of long repeats across documents, by windows' minimizers and run-length indexes.

Every window of ``length`` bytes belongs to its minimizer, the leftmost of its
``SEED``-byte strings with the least hash; equal windows have equal minimizers.
Consecutive windows with one minimizer make a stretch. Stretches that are equal
as a whole are found by hash and need no index. The others of a minimizer, those
at the edges of repeats, are gathered from the texts and given to run-length
indexes, whose matching statistics say which of their windows start elsewhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import map_batches, map_further, materialize, release
from foliospark.llm.run_index import repeated_starts
from foliospark.llm.words import Hashed, mix

U = np.uint64
#: Bytes of text looked at together, and of stretches that one index holds.
GROUP_BYTES, INDEX_BYTES = 1 << 19, 1 << 19
#: More different stretches of one minimizer than this are compared window by window.
INDEXED_STRETCHES = 2_000
#: Tasks at most that the indexes are dealt to.
INDEX_TASKS = 8_192
_POSITION_BITS = U(22)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` neighbours, from running minima of blocks in both directions."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    table = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def stretches(texts: list[bytes], length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, minimizer's hash, hash of the whole stretch) of every stretch of some texts."""
    long = [i for i, t in enumerate(texts) if len(t) >= length]
    if not long:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, empty
    data = b"".join(texts[i] for i in long)
    sizes = np.array([len(texts[i]) for i in long], np.int64)
    begins = np.cumsum(sizes) - sizes
    h = Hashed(data)
    seeds = h.every(seed)
    keyed = (seeds >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(seeds), dtype=np.uint64)
    best = (sliding_min(keyed, length - seed + 1) & U((1 << 22) - 1)).astype(np.int64)
    inside = np.ones(len(data) - length + 1, bool)  # windows that do not reach into the next text
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, np.maximum(begins[1:] - length + 1, 0), 1)
    np.add.at(edge, begins[1:], -1)
    inside &= np.cumsum(edge)[: len(inside)] == 0
    at = np.flatnonzero(inside)
    new = np.r_[True, (best[at[1:]] != best[at[:-1]]) | (at[1:] != at[:-1] + 1)]
    start, end = at[new], at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]]
    minimizer = best[start]
    shape = (minimizer - start).astype(np.uint64) << U(32) | (end - start).astype(np.uint64)
    whole = mix(h.substrings(start, end + length) ^ mix(shape))
    own = np.searchsorted(begins, start, "right") - 1
    return np.array(long)[own], start - begins[own], end - begins[own], seeds[minimizer].view(np.int64), whole.view(np.int64)


def pieces_of(texts: list[bytes], length: int):
    """(text, offset, bytes) groups of at most about GROUP_BYTES; longer texts are cut where windows overlap."""
    group: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), GROUP_BYTES):
            piece = t[at : at + GROUP_BYTES + length - 1]
            if group and size + len(piece) > GROUP_BYTES:
                yield group
                group, size = [], 0
            group.append((i, at, piece))
            size += len(piece)
    if group:
        yield group


#: Not null, lest a filter on one branch of the plan keep the other from sharing its shuffle.
STRETCH = ", ".join(f"{c} not null" for c in ("kind int", "key long", "first int", "last int", "seed long", "whole long", "weight long"))


def all_stretches(keyed: DataFrame, length: int, seed: int) -> DataFrame:
    """kind 0: a stretch, with how many equal ones its batch has; kind 1: one whose equal is known already."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, keys = [t.encode() for t in batch.column(1).to_pylist()], batch.column(0).to_numpy()
        found: list[list[np.ndarray]] = [[] for _ in range(5)]
        for group in pieces_of(texts, length):
            own, first, last, h, whole = stretches([p for *_, p in group], length, seed)
            owner, offset = np.array([i for i, *_ in group], np.int64), np.array([o for _, o, _ in group], np.int64)
            for column, value in zip(found, (keys[owner[own]], first + offset[own], last + offset[own], h, whole), strict=True):
                column.append(value)
        key, first, last, h, whole = (np.concatenate(c) if c else np.empty(0, np.int64) for c in found)
        order = np.lexsort((whole, h))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (whole[order][1:] != whole[order][:-1])] if len(h) else np.empty(0, bool)
        heads = np.flatnonzero(new)
        counts = np.diff(np.r_[heads, len(h)])
        several = np.repeat(counts > 1, counts)
        one, more = order[new], order[several]
        kind = np.r_[np.zeros(len(one), np.int32), np.ones(len(more), np.int32)]
        pick = np.r_[one, more]
        spread = np.r_[h[one], mix(key[more].view(np.uint64)).view(np.int64)]
        weight = np.r_[counts, np.zeros(len(more), np.int64)]
        columns = (kind, key[pick], first[pick].astype(np.int32), last[pick].astype(np.int32), spread, whole[pick], weight)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.strip().split(" ")[0] for x in STRETCH.split(",")])

    return map_batches(keyed, run, STRETCH)


def spans_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The byte spans that windows at these ascending starts cover, by runs of neighbours."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    a, b = starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]]
    return list(zip(a.tolist(), (b + length).tolist(), strict=True))


def repeat_spans(spark: SparkSession, keyed: DataFrame, length: int, seed: int) -> DataFrame:
    """key, start, stop: byte spans of the texts that repeated windows cover, overlapping as they may; keyed: key, text."""
    rows = all_stretches(keyed, length, seed)
    # equal stretches: one row for each slice of text that has them
    same = Window.partitionBy("kind", "seed", "whole")
    counted = rows.withColumn("rn", F.row_number().over(same.orderBy("key", "first", "last", "weight"))).withColumn("n", F.sum("weight").over(same))
    # different stretches of a minimizer may be as many as the documents: they are counted in part before they are
    # sent, and joined with the counts by a merge, of which a hot partition is split (a window's could not be)
    seeds = counted.where("weight > 0").groupBy("kind", "seed").agg(F.sum((F.col("rn") == 1).cast("long")).alias("kinds")).where("kinds > 1").select("seed", "kinds")
    known, one = (F.col("kind") == 1) | (F.col("n") > 1), (F.col("weight") > 0) & (F.col("rn") == 1)
    found = counted.select("key", "first", "last", "seed", known.alias("known"), one.alias("one")).join(seeds.hint("merge"), "seed", "left")
    found = found.withColumn("asked", F.col("one") & F.col("kinds").isNotNull()).where("known OR asked")
    stretch = materialize(spark, found.select("key", "first", "last", "seed", "known", "asked", (F.col("asked") & (F.col("kinds") > INDEXED_STRETCHES)).alias("many")), "stretches")
    size = stretch.where("asked AND NOT many").agg(F.sum(F.col("last") - F.col("first") + length)).first()[0] or 0
    shards = max(1, -(-size // INDEX_BYTES))

    lists = stretch.where("asked").groupBy("key").agg(F.collect_list(F.struct("first", "last", F.pmod(F.xxhash64("seed"), F.lit(shards)).cast("int").alias("shard"), "many")).alias("asked"))
    parts = keyed.join(lists, "key")

    def gather(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        shard, key, first, body, window = [], [], [], [], []
        for k, text, asked in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "asked")), strict=True):
            raw = text.encode()
            for x in asked:
                piece = raw[x["first"] : x["last"] + length]
                if x["many"]:
                    hashes = Hashed(piece).every(length).view(np.int64).tolist()
                    n = len(hashes)
                    shard += [None] * n
                    key += [k] * n
                    first += range(x["first"], x["last"] + 1)
                    body += [None] * n
                    window += hashes
                else:
                    for column, value in zip((shard, key, first, body, window), (x["shard"], k, x["first"], piece, None), strict=True):
                        column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(key, pa.int64()), pa.array(first, pa.int32()), pa.array(body, pa.binary()), pa.array(window, pa.int64())], names=["shard", "key", "first", "body", "window"])

    gathered = materialize(spark, map_batches(parts, gather, "shard int, key long, first int, body binary, window long"), "gathered")

    def index(table: pa.Table) -> pa.Table:
        release()
        key, start, stop = [], [], []
        bodies = table.column("body").to_pylist()
        for k, first, starts in zip(table.column("key").to_pylist(), table.column("first").to_pylist(), repeated_starts(bodies, length), strict=True):
            for a, b in spans_of(starts, length):
                key.append(k)
                start.append(first + a)
                stop.append(first + b)
        return pa.table({"key": pa.array(key, pa.int64()), "start": pa.array(start, pa.int32()), "stop": pa.array(stop, pa.int32())})

    # a number of its own, so that small partitions with much to compute are not put together
    spread = gathered.where("shard IS NOT NULL").select("shard", "key", "first", "body").repartition(min(shards, INDEX_TASKS), "shard")
    indexed = spread.groupBy("shard").applyInArrow(index, "key long, start int, stop int")
    windows = gathered.where("window IS NOT NULL").select("window", "key", "first")
    often = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    single = windows.join(often, "window").select("key", F.col("first").alias("start"), (F.col("first") + length).alias("stop"))
    whole = stretch.where("known").select("key", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    return whole.unionByName(indexed).unionByName(single)


def removed_spans(spark: SparkSession, docs: DataFrame, length: int = 200, seed: int | None = None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, spans: for each row the maximal byte spans, in order, to remove.

    A byte goes if a string of ``length`` bytes that covers it also starts
    anywhere else, in its own text or another, in the input as it is; both or all
    occurrences go. A null text is empty; texts under ``length`` bytes have no
    spans; rows that repeat are each other's repeats; an empty table gives no rows.
    carry: further columns to keep, in a struct ``carried``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # rows that are the same in id and text share a key, and what is removed
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col).cast("long"), text).alias("key"), F.struct(F.lit(0).alias("none"), *carry).alias("carried"))
    spans = repeat_spans(spark, keyed.select("key", "text"), length, seed or length // 2)
    lists = spans.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("found"))
    rows = keyed.join(lists, "key", "left").select("doc_id", "text", "carried", "found")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for found in batch.column(3).to_pylist():
            merged: list[list[int]] = []
            for x in found or ():
                if merged and x["start"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x["stop"])
                else:
                    merged.append([x["start"], x["stop"]])
            out.append([{"start": a, "stop": b} for a, b in merged])
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, kind)], names=["doc_id", "text", "carried", "spans"])

    carried = rows.schema["carried"].dataType.simpleString()
    return map_batches(rows, merge, f"doc_id long, text string, carried {carried}, spans array<struct<start:int,stop:int>>")


def kept_bytes(raw: bytes, spans: list[dict]) -> bytes:
    at, out = 0, []
    for x in spans:
        out.append(raw[at : x["start"]])
        at = x["stop"]
    out.append(raw[at:])
    return b"".join(out)


def dedup_report(spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row that ``removed_spans`` gives; an empty text has 0, 0, 0 and the hash of nothing."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw = text.encode()
            rows.append((len(raw), sum(x["stop"] - x["start"] for x in found), len(found), hashlib.sha256(kept_bytes(raw, found)).hexdigest()))
        n, r, s, h = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(h)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_further(spans, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_texts(spans: DataFrame) -> DataFrame:
    """doc_id, text with the spans taken out (a character cut in two by a span goes whole), and the carried columns."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [kept_bytes(t.encode(), s).decode("utf-8", "ignore") for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), batch.column("carried")], names=["doc_id", "text", "carried"])

    carried = spans.schema["carried"].dataType
    kept = map_further(spans, run, f"doc_id long, text string, carried {carried.simpleString()}")
    return kept.select("doc_id", "text", *(F.col("carried").getField(f.name).alias(f.name) for f in carried.fields if f.name != "none"))
