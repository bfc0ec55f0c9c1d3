"""Connected components of an edge table, by alternating large-star and small-star steps.

A table of at most ``FEW`` edges, also one that the steps have made, is solved by one task that holds it whole (tens of MB); its size
says so, not the input's, and the result is the same. Beyond that, every step is an aggregate and an equi-join; edges never leave the executors. Each round is a written table, so
the lineage stays short. Rounds grow with the logarithm of the longest path; the loop ends when a round changes
nothing.

A hub (a node with more than one in ``HUBS`` of all edge ends) does not bring its edges to one task: there are fewer than
``HUBS`` hubs, so their leasts are broadcast and their edges stay where they are. That is needed in the large step, whose
centres keep all of their neighbours; the small step moves a node's edges to its least neighbour, by an aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import drop_written, written

#: A node with more than this share of all edge ends is a hub, so there are fewer hubs than that.
HUBS = 400
#: Up to so many distinct edges one task takes them all.
FEW = 2_000_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """``edges`` (u, v) with the column m of ``least`` (u, m, n: how many edge ends u has) for its u."""
    most = max(200, ends // HUBS)
    if (least.agg(F.max("n")).first()[0] or 0) <= most:
        return edges.join(least.select("u", "m"), "u").select("u", "v", "m")
    hubs = F.broadcast(least.where(F.col("n") > most).select("u", "m"))  # fewer than HUBS rows
    others = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= most).select("u", "m"), "u")
    return others.select("u", "v", "m").unionByName(edges.join(hubs, "u").select("u", "v", "m"))


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of edges u-v: roots hook on to the least root beside them until no edge joins two."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    up, a, b = np.arange(len(nodes)), at[: len(u)], at[len(u) :]
    while True:
        a, b = up[a], up[b]
        apart = a != b
        if not apart.any():
            return nodes, nodes[up]
        a, b = a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up, up[up]):
            up = up[up]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        nodes, roots = least_reached(*(np.concatenate(x) for x in zip(*held)))
        for i in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)], pa.int64()), pa.array(roots[i : i + (1 << 16)], pa.int64())], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v long): root is the least node that it reaches.

    Loops, repeated edges and either direction are fine; an empty table gives an empty one.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(now)
    while before[0] > FEW:
        ends = 2 * before[0]
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both.where("v > u"), least, ends).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(pairs.union(low.select("u", "m")).toDF("u", "v").where("u <> v").distinct(), "edges")
        after = _state(new)
        drop_written(now)
        now = new
        if after == before:
            break
        before = after
    if before[0] <= FEW:
        return now.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_solved, "node long, root long")
    # At the fixed point each non-root points at its root.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
