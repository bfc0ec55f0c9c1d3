"""The spatial range join: pairs of boxes that meet, by a grid of several levels instead of a nested loop.

A box belongs to the level whose cells are at least as large as it, so it touches at most four cells there. The finer
box of a pair looks at the cells of each coarser level that occurs; the coarser one is posted in its own level's cells.
That is an equi-join on (keys, level, cell) whose fan-out is bounded for boxes of any size. A pair is reported in one
cell only: the one that holds the lower left corner of the two boxes' common part; so no ``distinct`` is needed.
Null-safe on the keys. The finest cells fit the smaller boxes (the lower quartile of the extents), so that a dense place under
large boxes does not fill a cell; levels are the logarithm of the largest extent over that. Either side is read several times, so it
is written first; the size and the levels are one row of an aggregate over what is written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written

BOX = ("minx", "miny", "maxx", "maxy")


_FINEST = 1e-6


def _extent() -> Column:
    return F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))


def _grid(left: DataFrame, right: DataFrame) -> tuple[float, list[int]]:
    """The finest cell's size, and the levels that occur."""
    extents = left.select(_extent().alias("extent")).union(right.select(_extent()))
    cell = max(extents.agg(F.percentile_approx("extent", 0.25, 100)).first()[0] or 0.0, _FINEST)
    levels = extents.select(_level(F.col("extent"), cell).alias("level")).agg(F.collect_set("level")).first()[0]
    return cell, sorted(levels)


def _level(extent: Column, cell: float) -> Column:
    return F.when(extent <= cell, F.lit(0)).otherwise(F.ceil(F.log2(extent / cell)).cast("int"))


def _cells(df: DataFrame, cell: float) -> DataFrame:
    size = F.lit(cell) * F.pow(F.lit(2.0), F.col("_at"))
    at = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    return df.withColumn("_cx", F.explode(at("minx", "maxx"))).withColumn("_cy", F.explode(at("miny", "maxy")))


def box_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All pairs of rows whose boxes (minx, miny, maxx, maxy) meet and whose keys are equal (null equals null).

    left and right carry a box, the keys and other columns; names other than the keys and the box must differ. The result has
    all columns of both sides, the right box as r_minx and so on.
    """
    left, right = written(left, "probes"), written(right, "boxes")
    cell, levels = _grid(left, right)
    known = F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")
    own = left.withColumn("_level", _level(_extent(), cell))
    other = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys]).withColumn("_level", _level(_extent(), cell))
    renamed = {b: f"r_{b}" for b in BOX}

    def side(probe: DataFrame, posted: DataFrame, finer: bool) -> tuple[DataFrame, DataFrame]:
        later = F.filter(known, (lambda v: v > F.col("_level")) if finer else (lambda v: v >= F.col("_level")))
        p = _cells(probe.withColumn("_at", F.explode(later)), cell).drop("_level")
        q = _cells(posted.withColumn("_at", F.col("_level")), cell).drop("_level")
        return p, q

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = a.alias("a"), b.withColumnsRenamed(renamed).alias("b")
        on = (F.col("a._at") == F.col("b._at")) & (F.col("a._cx") == F.col("b._cx")) & (F.col("a._cy") == F.col("b._cy"))
        for i, k in enumerate(keys):
            on &= F.col(f"a.{k}").eqNullSafe(F.col(f"b._k{i}"))
        size = F.lit(cell) * F.pow(F.lit(2.0), F.col("a._at"))
        on &= (F.col("minx") <= F.col("r_maxx")) & (F.col("r_minx") <= F.col("maxx")) & (F.col("miny") <= F.col("r_maxy")) & (F.col("r_miny") <= F.col("maxy"))
        on &= (F.floor(F.greatest("minx", "r_minx") / size) == F.col("a._cx")) & (F.floor(F.greatest("miny", "r_miny") / size) == F.col("a._cy"))
        drop = ("_at", "_cx", "_cy")
        return a.join(b, on).select(*[F.col(f"a.{c}") for c in a.columns if c not in drop], *[F.col(f"b.{c}") for c in b.columns if c not in drop and not c.startswith("_k")])

    fine_left = met(*side(own, other, False))
    if len(levels) < 2:
        return fine_left
    q, p = side(other, own, True)
    return fine_left.unionByName(met(p, q))
