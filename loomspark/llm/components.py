"""Connected components of an undirected graph, as DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import connected
from .common import materialise, scratch

#: Distinct edges (2 MB) up to which the driver joins them itself: a round takes many Spark stages.
AT_ONCE = 1 << 17


def components(edges: DataFrame) -> DataFrame:
    """node, label (least node of its component) for every node of ``edges`` (a, b: long).

    Up to ``AT_ONCE`` edges are joined at once.  Of more there are rounds of hooking each node's neighbours to its least neighbour, then each node to
    its least one (large-star, small-star), until nothing changes.  Labels only move
    within a component; rounds grow with the logarithm of its size.  Each round is a
    written table, and so is the result.  Repeated edges, loops and edges without one end
    add nothing; without edges there are no rows.
    """
    with scratch():
        pairs = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
        return materialise((_joined if pairs.count() <= AT_ONCE else _rounds)(pairs), keep=True)


def _joined(pairs: DataFrame) -> DataFrame:
    t = pairs.toArrow()
    a, b = t["a"].to_numpy(), t["b"].to_numpy()
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = nodes[connected(at[: len(a)], at[len(a) :], len(nodes))]
    return pairs.sparkSession.createDataFrame(pa.table({"node": nodes, "label": label}), "node long, label long")


def _rounds(pairs: DataFrame) -> DataFrame:
    seen = _fingerprint(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: every greater neighbour of a node is linked to the node's least neighbour.
        big = pairs.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b")).filter("a != b").distinct()
        # Small star: a node and its lesser neighbours are linked to the least of them.
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        pairs, before = materialise(small.select("e.a", "e.b").filter("a != b").distinct()), seen
        seen = _fingerprint(pairs)
        if seen == before:
            break
    return pairs.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )


def _fingerprint(pairs: DataFrame) -> tuple:
    """Number of distinct edges and two sums over 64-bit hashes of them: alike if and only if the edges are, but for chance."""
    h = F.xxhash64("a", "b")
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.bitwiseAND(F.lit((1 << 31) - 1)))).first())
