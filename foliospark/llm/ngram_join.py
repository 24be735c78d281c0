"""Exact Jaccard self-join of documents on word n-grams, and its components.

The document by n-gram incidence matrix is cut into blocks of n-gram columns.
Each block's product with its transpose tells how many of a document's n-grams
any other document has; a document in which that sum stays under
ceil(t * size) has no partner and leaves. What stays is few. By their sizes, a pair
at t or more must share one of the rarest n-grams of each; documents connected
by those are a family. A family's incidence rows are multiplied in tiles, column
block by column block, and give the links that connect them.
"""

from __future__ import annotations

import itertools
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import discard, map_batches, materialize, maybe_in, release, texts_of
from foliospark.llm.components import components
from foliospark.llm.words import groups_of, shingle_sets

#: UTF-8 bytes of text whose n-grams make one column block, and of one row block.
COLUMN_BLOCK_BYTES, ROW_BLOCK_BYTES = 12 << 20, 6 << 20
#: Documents whose product is one dense matrix, and n-gram columns multiplied at a time.
TILE, COLUMNS = 512, 4096
#: Bytes of sets, and sets, in a part of a family.
PART_BYTES, PART_ROWS = 16 << 20, 4096


def set_key(s: np.ndarray) -> int:
    """64 bits of a set; equal sets are one class."""
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_overlap(size: Column, percent: int) -> Column:
    return F.ceil(size * percent / 100.0).cast("int")


def row_key(doc_id: Column, text: Column) -> Column:
    """64 bits of id and text; rows that are the same in both share it."""
    return F.xxhash64(doc_id.cast("long"), F.coalesce(text, F.lit("")))


def doc_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, the row's key, the set's size and the set's key."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets([t.encode() for t in batch.column(1).to_pylist()], n)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64())], names=["doc_id", "row_key", "n", "key"])

    return map_batches(docs.withColumn("row_key", row_key(F.col("doc_id"), F.col("text"))), run, "doc_id long, row_key long, n long, key long")


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts, and how long it is."""
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.empty(0, "int64")
    return starts, np.diff(np.r_[starts, len(sorted_values)])


def shared_counts(docs: DataFrame, n: int, blocks: int) -> DataFrame:
    """key, shared: at least how many of a class's n-grams another row has too, never less than is so.

    A row block sends each column block that it has n-grams of 32 further bits of
    these and the numbers of their owners, and gets back for each owner how many
    are shared. What two of its own classes share it counts itself and sends once,
    so an n-gram that is everywhere costs a value for each row block, not for each
    document. Equal sets in two row blocks share all, and drop out later.
    """
    made = [0]  # in this task
    names = ["block", "rows", "keys", "single", "owner", "multi", "multi_owner", "multi_count"]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]

    def cells(batch: pa.RecordBatch):
        texts = [t.encode() for t in batch.column(1).to_pylist()]
        columns: list[list] = [[] for _ in names]
        for lo, hi in groups_of(texts, ROW_BLOCK_BYTES):
            distinct = {set_key(s): s for s in shingle_sets(texts[lo:hi], n) if len(s)}
            if not distinct:
                continue
            keys = np.fromiter(distinct.keys(), "int64").tobytes()
            grams = np.concatenate(list(distinct.values()))
            owners = np.repeat(np.arange(len(distinct), dtype=np.uint32), [len(s) for s in distinct.values()])
            order = np.argsort(grams, kind="stable")
            grams, owners = grams[order], owners[order]
            starts, lengths = _runs(grams)
            alone = np.repeat(lengths == 1, lengths)
            block = (((grams >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)
            low = (grams & np.uint64(0xFFFFFFFF)).astype("<u4")
            edges, sizes = _runs(block)
            rows = TaskContext.get().partitionId() << 32 | made[0]
            made[0] += 1
            for i, j in zip(edges.tolist(), (edges + sizes).tolist(), strict=True):
                one, o = alone[i:j], owners[i:j]
                several = low[i:j][~one]
                several = several[_runs(several)[0]]
                who, count = np.unique(o[~one], return_counts=True)
                row = (int(block[i]), rows, keys, low[i:j][one].tobytes(), _small(o[one]), several.tobytes(), _small(who), count.astype("<u4").tobytes())
                keys = None  # once for each row block
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names) if columns[0] else None

    def product(table: pa.Table) -> pa.Table:
        release()
        single = [np.frombuffer(x, "<u4") for x in table.column("single").to_pylist()]
        values = np.concatenate(single + [np.frombuffer(x, "<u4") for x in table.column("multi").to_pylist()])
        several = np.sort(values)
        several = np.unique(several[1:][several[1:] == several[:-1]])
        # n-grams of one row block alone that two of its classes share are no row's besides
        found: list[list] = [[], []]
        for mine, owner, who, count in zip(single, *(table.column(c).to_pylist() for c in ("owner", "multi_owner", "multi_count")), strict=True):
            hit = _wide(owner)[several[np.minimum(np.searchsorted(several, mine), len(several) - 1)] == mine] if len(several) else np.empty(0, np.int64)
            number, where = np.unique(np.concatenate([hit, _wide(who)]), return_inverse=True)
            each = np.concatenate([np.ones(len(hit), np.int64), np.frombuffer(count, "<u4").astype(np.int64)])
            found[0].append(_small(number))
            found[1].append(np.bincount(where, weights=each, minlength=len(number)).astype("<u4").tobytes())
        return pa.table({"rows": table.column("rows"), "keys": table.column("keys"), "owner": pa.array(found[0], pa.binary()), "count": pa.array(found[1], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(next(k for k in table.column("keys").to_pylist() if k is not None), "<i8")
        owners = np.concatenate([_wide(x) for x in table.column("owner").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("count").to_pylist()])
        shared = np.bincount(owners, weights=counts, minlength=len(keys)).astype(np.int64)
        some = shared > 0
        return pa.table({"key": pa.array(keys[some]), "shared": pa.array(shared[some])})

    cut = map_batches(docs, cells, "block int, rows long, keys binary, single binary, owner binary, multi binary, multi_owner binary, multi_count binary", ROW_BLOCK_BYTES)
    back = cut.groupBy("block").applyInArrow(product, "rows long, keys binary, owner binary, count binary")
    # of a class in several row blocks, the most
    return back.groupBy("rows").applyInArrow(add, "key long, shared long").groupBy("key").agg(F.max("shared").alias("shared"))


def _small(numbers: np.ndarray) -> bytes:
    """Ascending or not, as 16-bit numbers where they fit, told by a first byte."""
    kind = "<u2" if int(numbers.max(initial=0)) < 1 << 16 else "<u4"
    return bytes([int(kind[2])]) + numbers.astype(kind).tobytes()


def _wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def candidate_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The n-grams of the wanted classes (key, row: a row that has the set): cls, the set's key; n, grams."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets([t.encode() for t in batch.column(1).to_pylist()], n)
        right = [set_key(s) == k for s, k in zip(sets, batch.column(2).to_pylist(), strict=True)]
        sets = [s for s, r in zip(sets, right, strict=True) if r]
        grams = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.empty(0, "int64"), *(s.view("int64") for s in sets)])))
        return pa.RecordBatch.from_arrays([batch.column(2).filter(pa.array(right, pa.bool_())), pa.array([len(s) for s in sets], pa.int64()), grams], names=["cls", "n", "grams"])

    maybe = maybe_in(docs.withColumn("row_key", row_key(F.col("doc_id"), F.col("text"))), "row_key", wanted.select("row"))
    found = maybe.join(wanted, F.col("row_key") == F.col("row")).select("doc_id", "text", "key")
    return map_batches(found, run, "cls long, n long, grams array<long>").dropDuplicates(["cls"])


def links_of(own: np.ndarray, other: np.ndarray, n: np.ndarray, grams: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the rows ``own`` and ``other`` are linked, as a matrix.

    The product of incidence rows is accumulated over blocks of columns; columns
    that one row alone has are left out.
    """
    rows = np.concatenate([own, other])
    flat = np.concatenate([grams[i] for i in rows])
    place = np.repeat(np.arange(len(rows)), [len(grams[i]) for i in rows])
    order = np.argsort(flat, kind="stable")
    starts, lengths = _runs(flat[order])
    column = np.repeat(np.cumsum(lengths > 1) - 1, lengths)
    shared = np.repeat(lengths > 1, lengths)
    column, place = column[shared], place[order][shared]
    half = len(own)
    overlap = np.zeros((half, len(other)), np.float32)
    edges = np.searchsorted(column, np.arange(0, int(column[-1]) + 1 + COLUMNS, COLUMNS)) if len(column) else np.zeros(1, np.int64)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        block = np.zeros((len(rows), COLUMNS), np.float32)
        block[place[lo:hi], column[lo:hi] % COLUMNS] = 1
        overlap += block[:half] @ block[half:].T
    sizes = n.astype(np.float64)
    return 100 * overlap >= percent * (sizes[own][:, None] + sizes[other][None, :] - overlap)


def spanning_links(own: np.ndarray, other: np.ndarray | None, n: np.ndarray, grams: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among the rows ``own``, or between ``own`` and ``other``, as a spanning forest of row numbers.

    Products are made for ``TILE`` rows at a time, and only of rows not yet connected.
    """
    label = {int(i): int(i) for i in (own if other is None else np.concatenate([own, other]))}

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = i = label[label[i]]
        return i

    found = []
    for i in range(0, len(own), TILE):
        left = own[i : i + TILE]
        right_of = own[i:] if other is None else other
        for j in range(0, len(right_of), TILE):
            right = right_of[j : j + TILE]
            if len({root(int(k)) for k in left} | {root(int(k)) for k in right}) == 1:
                continue
            for a, b in np.argwhere(links_of(left, right, n, grams, percent)):
                a, b = root(int(left[a])), root(int(right[b]))
                if a != b:
                    label[max(a, b)] = min(a, b)
                    found.append((a, b))
    return found


def family_links(spark: SparkSession, sets: DataFrame, families: DataFrame, percent: int, buckets: int) -> DataFrame:
    """a, b: links that connect what is connected within each family (node, component) of candidates.

    A family is cut into parts of at most about ``PART_BYTES``. The first part is
    compared with every part, so that each set is sent once, and those of the first
    once for each part. What is still apart from the largest group then is compared
    with all: two members of that group need no comparison. Families of one part
    share groups, by hash.
    """
    # narrow tables say where the sets go; each comparison joins the sets once
    found = families.join(sets.select("cls", (F.size("grams").cast("long") * 8).alias("bytes")), F.col("node") == F.col("cls"))
    parts = F.greatest(F.ceil(F.sum("bytes") / PART_BYTES), F.ceil(F.count(F.lit(1)) / PART_ROWS)).cast("int")
    sized = found.groupBy(F.col("component").alias("family")).agg(parts.alias("parts"))
    placed = found.join(sized, F.col("component") == F.col("family")).select("cls", "family", "parts", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part"))
    placed = materialize(spark, placed, "family-parts")

    def product(table: pa.Table) -> pa.Table:
        release()
        n, cls, second = (table.column(c).to_numpy() for c in ("n", "cls", "second"))
        column = table.column("grams").combine_chunks()
        ends, values = column.offsets.to_numpy(), column.values.to_numpy()
        grams = [values[i:j] for i, j in itertools.pairwise(ends)]
        keys = np.stack([table.column(c).to_numpy() for c in ("family", "lo", "hi")], 1)
        order = np.lexsort(keys.T[::-1])
        cut = np.flatnonzero(np.r_[True, (keys[order][1:] != keys[order][:-1]).any(1), True])
        found = []
        for i, j in itertools.pairwise(cut.tolist()):
            rows = order[i:j]
            own, other = rows[~second[rows]], rows[second[rows]]
            if keys[rows[0], 1] == keys[rows[0], 2]:
                found += spanning_links(rows, None, n, grams, percent)
            elif len(own) and len(other):
                found += spanning_links(own, other, n, grams, percent)
        a, b = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        return pa.table({"a": pa.array(cls[a]), "b": pa.array(cls[b])})

    def products(rows: DataFrame) -> DataFrame:
        """rows: cls, family, parts, lo, hi, second; own rows are compared with the second ones, those of lo = hi with each other."""
        group = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("family"), F.lit(buckets))).otherwise(F.xxhash64("family", "lo", "hi"))
        return sets.join(rows, "cls").select(group.alias("group"), "family", "lo", "hi", "second", "cls", "n", "grams").groupBy("group").applyInArrow(product, "a long, b long")

    of_first = F.when(F.col("part") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
    star = placed.withColumn("lo", F.lit(0)).withColumn("hi", F.explode(of_first)).withColumn("second", F.col("part") > 0)
    links = materialize(spark, products(star), "first-links")

    # the groups so far of families of several parts, and of each family the largest
    large = placed.where("parts > 1")
    labels = components(spark, links.join(large.select("cls"), F.col("a") == F.col("cls"), "left_semi"))
    grouped = large.join(labels, F.col("cls") == F.col("node"), "left").select("cls", "family", "part", F.coalesce("component", "cls").alias("so_far"))
    largest = grouped.groupBy("family", "so_far").agg(F.count(F.lit(1)).alias("size")).groupBy("family").agg(F.max_by("so_far", F.struct("size", "so_far")).alias("largest"))
    apart = materialize(spark, grouped.join(largest, "family").where("so_far != largest AND part > 0").select("cls", "family"), "apart")
    left = apart.groupBy("family").agg(F.count(F.lit(1)).alias("left"))
    own_parts = F.least("parts", F.ceil(F.col("left") / PART_ROWS * F.col("parts")).cast("int"))
    again = large.join(left, "family").withColumn("own_parts", own_parts)
    own = again.join(apart.select("cls"), "cls", "left_semi").withColumn("lo", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("own_parts")).cast("int")).withColumn("hi", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    other = again.withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("own_parts") - 1))).withColumn("hi", F.col("part"))
    columns = ["cls", "family", "parts", "lo", F.expr("hi + 1000000000").alias("hi")]  # never the same as lo
    rest = own.select(*columns).withColumn("second", F.lit(False)).unionByName(other.select(*columns).withColumn("second", F.lit(True)))
    if apart.isEmpty():
        return links
    return links.unionByName(products(rest))


def jaccard_rows(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``jaccard_components``, with row_key and component: the component by the keys of its sets, null for no words."""
    docs = texts_of(docs, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = materialize(spark, doc_sets(docs, n), "sets")
    classes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least_id"), F.min("row_key").alias("row"), F.min("n").alias("n"))
    counts = shared_counts(docs, n, max(1, -(-size // COLUMN_BLOCK_BYTES)))
    wanted = materialize(spark, classes.join(counts, "key").where(F.col("shared") >= least_overlap(F.col("n"), percent)).select("key", "row"), "wanted")
    full = materialize(spark, candidate_sets(docs, wanted, n), "full-sets")

    discard(spark, wanted)
    # n-grams that only one of them has cannot count; the others, rarest first
    flat = full.select("cls", F.explode("grams").alias("gram"))
    often = flat.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    kept = flat.join(often, "gram").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("by_df"))
    kept = kept.join(full.select("cls", "n"), "cls").where(F.size("by_df") >= least_overlap(F.col("n"), percent))
    sets = materialize(spark, kept.select("cls", "n", F.col("by_df.gram").alias("grams")), "kept-sets")
    discard(spark, full)
    # of the n - least + 1 rarest, those that are in one set alone come first and drop out
    prefix = F.slice("grams", 1, F.greatest(F.lit(0), F.size("grams") - least_overlap(F.col("n"), percent) + 1))
    postings = materialize(spark, sets.select("cls", F.explode(prefix).alias("gram")), "postings")
    first = postings.groupBy("gram").agg(F.min("cls").alias("first"))
    families = components(spark, postings.join(first, "gram").select(F.col("cls").alias("a"), F.col("first").alias("b")))
    discard(spark, postings)
    buckets = max(1, -(-size // COLUMN_BLOCK_BYTES))
    labels = components(spark, family_links(spark, sets, families, percent, buckets))
    discard(spark, sets)

    least = classes.join(labels, classes["key"] == labels["node"]).groupBy("component").agg(F.min("least_id").alias("component_id"))
    linked = labels.join(least, "component")
    of_class = classes.join(linked, classes["key"] == linked["node"], "left").select("key", F.coalesce("component", "key").alias("component"), F.coalesce("component_id", "least_id").alias("component_id"))
    return rows.join(of_class, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "row_key", "component")


def jaccard_components(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``.

    Two documents are linked when 100 * overlap >= percent * union of their sets
    of ``n``-word shingles (fewer words: all words as one shingle; none: linked
    with nothing, a component alone). component_id: its least id, null if none of
    its rows has one. Rows with equal sets are one class, stand for each other,
    and are never paired. A null text is empty; of equal ids with different texts
    each row keeps its own set and component. An empty table gives no rows.

    Every pair of different sets that could be linked is counted, in tiles, unless
    they are connected already; of the links, those that connect are kept.
    """
    found = jaccard_rows(spark, docs, n, percent, id_col, text_col)
    return found.select("doc_id", "n_shingles", "component_id")
