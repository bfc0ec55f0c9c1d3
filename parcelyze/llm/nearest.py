"""Approximate nearest neighbours by a permutation index.

A bounded sample of ``pivots`` vectors is the only thing fitted. Each vector is represented by the order of its
``prefix`` nearest pivots. Rows are dealt to blocks of about ``block_rows``; a block holds inverted files: each pivot's
list has the vectors that name it, with the rank they give it. A query adds up, over the lists of its own pivots,
what their ranks have in common: the footrule distance of the two prefixes, up to a constant, where a pivot outside
a prefix has the rank ``prefix``. The ``share`` nearest by footrule of each block (at least ``k``) are reranked by
the true measure, and the best ``k`` of all blocks are the answer. Every row is indexed; the query set meets the
blocks of rows as packed blocks, joined by their numbers, so no pair of vectors is ever a row.

Inner products are compared, not angles: vectors are taken to the unit sphere with one more component,
sqrt(1 - (norm / largest norm)^2), which makes the nearest there the largest inner product (a query has 0 there).

Defined results. Vectors that are null, zero, of another length than the most frequent one, or hold null or non-finite components
take no part, as query or candidate, nor do rows without an id. A query's own row (its id) is no candidate; ids
that repeat are separate candidates. Ties go to the smaller id. With fewer candidates than ``k`` all are returned.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_written, small_batches, written


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(vectors: np.ndarray, largest: float, query: bool) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    if query:
        return np.hstack([vectors / norms, np.zeros((len(vectors), 1))])
    scaled = vectors / largest
    return np.hstack([scaled, np.sqrt(np.maximum(0.0, 1.0 - (norms / largest) ** 2))])


def prefixes(points: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each point's nearest pivots, nearest first."""
    near = points @ pivots.T
    if prefix >= len(pivots):
        return np.argsort(-near, axis=1, kind="stable").astype(np.int32)
    some = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix]
    order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1).astype(np.int32)


class Block:
    """Inverted files over one block of vectors, which are in ascending order of id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, largest: float, prefix: int):
        self.ids, self.vectors, self.prefix = ids, vectors, min(prefix, len(pivots))
        named = np.concatenate([prefixes(unit(vectors[i : i + 4096], largest, False), pivots, self.prefix) for i in range(0, len(ids), 4096)])
        flat = named.ravel()
        order = np.argsort(flat, kind="stable")
        self.rows = (order // self.prefix).astype(np.int64)
        self.weight = (self.prefix - order % self.prefix).astype(np.int64)  # prefix - rank
        self.bounds = np.searchsorted(flat[order], np.arange(len(pivots) + 1))

    def search(self, own_id: int, vector: np.ndarray, named: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best ``k`` after reranking."""
        a, b = self.bounds[named], self.bounds[named + 1]
        at = np.concatenate([np.arange(x, y) for x, y in zip(a, b)])
        mine = np.repeat(self.prefix - np.arange(len(named)), b - a)
        common = np.bincount(self.rows[at], np.minimum(self.weight[at], mine), len(self.ids))
        n = len(self.ids)
        take = max(k + 1, math.ceil(share * n))  # the query itself may be among them
        if take < n:
            key = common * n + np.arange(n, 0, -1)  # among equals the smaller id
            rows = np.sort(np.argpartition(-key, take - 1)[:take])
        else:
            rows = np.arange(n)
        rows = rows[self.ids[rows] != own_id]
        score = (self.vectors[rows] * vector).sum(axis=1)
        if len(rows) > k:
            cut = np.partition(-score, k - 1)[k - 1]
            keep = -score <= cut
            rows, score = rows[keep], score[keep]
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, vec_id, vector), sorted by block and id -> one row a block."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    now = None

    def flush():
        ids = np.concatenate([h[0] for h in held])
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([np.concatenate([h[1] for h in held]).tobytes()], pa.binary())], ["block", "ids", "vectors"])

    for batch in batches:
        blocks = batch.column(0).to_numpy()
        for b in np.unique(blocks):
            rows = np.flatnonzero(blocks == b)
            if now is not None and b != now:
                yield flush()
                held = []
            now = int(b)
            part = batch.slice(rows[0], len(rows))
            held.append((part.column(1).to_numpy().astype(np.int64), _matrix(part.column(2))))
    if held:
        yield flush()


def _search(held, k: int, share: float, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, largest = held.value
        width = pivots.shape[1] - 1
        for batch in batches:
            for ids, vectors, qids, queries in zip(*(c.to_pylist() for c in batch.columns)):
                block = Block(np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, width), pivots, largest, prefix)
                qids, queries = np.frombuffer(qids, np.int64), np.frombuffer(queries, np.float64).reshape(-1, width)
                named = prefixes(unit(queries, largest, True), pivots, block.prefix)
                found = [block.search(i, v, p, k, share) for i, v, p in zip(qids.tolist(), queries, named)]
                row = [[{"vec_id": int(i), "score": float(s)} for i, s in zip(*f)] for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(qids), pa.array(row, pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))], ["query_id", "found"])

    return run


def nearest_neighbours(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 20, pivots: int = 1024, prefix: int = 64, share: float = 0.15, block_rows: int = 16384, query_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the largest inner product with each query.

    rows, queries: tables with the id and vector columns; see the module's text for the other parameters.
    """
    spark = rows.sparkSession
    small_batches(spark)

    def taken(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))

    data, asked = taken(rows), taken(queries)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    widths = data.groupBy(F.size("vector").alias("w")).agg(F.count("*").alias("n"), F.max(norm).alias("top")).orderBy(F.col("n").desc(), "w").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not widths:
        return spark.createDataFrame([], schema)
    width, total, largest = widths[0]
    data, asked = data.where(F.size("vector") == width), asked.where(F.size("vector") == width)
    # Pivots: the least hashes of as many cells as there are pivots.
    cell = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(pivots))
    chosen = data.groupBy(cell.alias("cell")).agg(F.min_by("vector", F.struct(F.xxhash64("vec_id", F.lit(6)), "vec_id")).alias("vector")).orderBy("cell").collect()
    held = spark.sparkContext.broadcast((unit(np.array([r[1] for r in chosen], np.float64), float(largest), False), float(largest)))

    def packed(df: DataFrame, n: int, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(n)).cast("long")
        dealt = df.select(block.alias("block"), "vec_id", "vector").repartition(n, "block").sortWithinPartitions("block", "vec_id")
        return written(dealt.mapInArrow(_pack, "block long, ids binary, vectors binary"), name)

    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], schema)
    data_blocks, asked_blocks = math.ceil(total / block_rows), math.ceil(n_asked / query_rows)
    left = packed(data, data_blocks, "blocks")
    right = packed(asked, asked_blocks, "queries").toDF("q", "qids", "queries")
    pairs = left.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asked_blocks - 1).cast("long"))).alias("q"), "block", "ids", "vectors").join(right, "q")
    pairs = pairs.repartition(data_blocks * asked_blocks, "block", "q").select("ids", "vectors", "qids", "queries")
    found = written(pairs.mapInArrow(_search(held, k, share, prefix), "query_id long, found array<struct<vec_id:long,score:double>>"), "found")
    drop_written(left)
    each = found.select("query_id", F.inline("found"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
