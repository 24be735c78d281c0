"""Connected components of a link table: parts are solved in memory, then large-star and small-star rounds join them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import discard, materialize

#: Links that one task solves together.
PART_LINKS = 1 << 20


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that it can reach), of all nodes but the least ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        while ((further := new[new]) != new).any():
            new = further
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def contract(links: DataFrame) -> DataFrame:
    """a, b: each node with the least that it reaches by the links of its task, of PART_LINKS links at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve() -> pa.RecordBatch:
            a, b = least_nodes(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= PART_LINKS:
                yield solve()
                held, n = [], 0
        if n:
            yield solve()

    return links.mapInArrow(run, "a long, b long")


def star_round(edges: DataFrame) -> DataFrame:
    """Joins each node's neighbours to the least of them; edges: a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    return large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links: long columns a, b. Returns node, component: the least node that can be reached.

    Nodes without a link to another node are not in the result; null ends link
    nothing; links that repeat count once; without links there are no rows. Links
    are dealt to tasks of about PART_LINKS. What one task has is solved there.
    Where there are more, rounds of stars join the tasks' results, and each is
    solved in parts again, until a round changes nothing. A node's links are never
    gathered: its least neighbour is an aggregate, joined back.
    """
    edges = materialize(spark, contract(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "links")
    while (n := edges.count()) > PART_LINKS:
        after = materialize(spark, contract(star_round(edges).repartition(-(-n // PART_LINKS), "b")), "links")
        sides = after.distinct().withColumn("side", F.lit(1)).unionByName(edges.distinct().withColumn("side", F.lit(2)))
        same = sides.groupBy("a", "b").agg(F.sum("side").alias("side")).where("side != 3").isEmpty()
        discard(spark, edges)
        edges = after
        if same:
            break
    else:
        after = materialize(spark, contract(edges.repartition(1)), "links")
        discard(spark, edges)
        edges = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
