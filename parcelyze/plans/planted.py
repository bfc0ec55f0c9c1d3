"""Features with planted defects, one kind for each remainder of a part's number, and what each check has to find in them.

Coordinates are whole micro-degrees about a place of each part's own, far from the others'.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Micro-degrees between places.
STEP = 20_000


class _At(tuple):
    """A position: micro-degrees east and north of the place, digits after those of the first ordinate, and a height."""


def at(x: int, y: int, more: str = "", z: int | None = None) -> _At:
    return _At((x, y, more, z))


def _box(x: int, y: int, w: int, h: int | None = None) -> list[_At]:
    h = w if h is None else h
    return [at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h), at(x, y)]


def _g(kind: str, coordinates: Any, **more: Any) -> dict:
    return {"type": kind, "coordinates": coordinates, **more}


AUTO, MANUAL = "AutoRepairAvailable", "ManualReview"
_A, _B, _C, _D = at(0, 0), at(1000, 0), at(1000, 1000), at(0, 1000)

#: (geometry, or a whole feature; [(check, code, path, disposition)]) of each kind. A sliver's disposition is that before
#: its neighbours are known.
KINDS: list[tuple[Any, list[tuple[str, str, str | None, str]]]] = [
    (_g("Polygon", [_box(0, 0, 1000)]), []),
    ({"feature": {"type": "Feature", "properties": {}}}, [("geometryTypes", "INVALID_GEOMETRY_OBJECT", None, MANUAL)]),
    ({"coordinates": [_A]}, [("geometryTypes", "MISSING_GEOMETRY_TYPE", None, MANUAL)]),
    (_g("CircularString", [_A, _B]), [("geometryTypes", "UNSUPPORTED_GEOMETRY_TYPE", None, MANUAL)]),
    ({"type": "GeometryCollection"}, [("geometryTypes", "INVALID_GEOMETRY_COLLECTION", None, MANUAL)]),
    ({"feature": 7}, [("geometryTypes", "INVALID_FEATURE_OBJECT", None, MANUAL)]),
    (_g("LineString", [_A, at(500, 0, z=1), [1], _C]), [("geometryDimensions", "INCONSISTENT_POSITION_DIMENSION", "1", MANUAL), ("geometryDimensions", "INVALID_POSITION_DIMENSION", "2", MANUAL)]),
    (_g("LineString", [_A, [1, None], _C]), [("geometryDimensions", "INVALID_COORDINATE_VALUE", "1", MANUAL)]),
    (_g("MultiPolygon", []), [("multipartIntegrity", "EMPTY_MULTIPOLYGON", None, MANUAL)]),
    (_g("MultiPolygon", [[_box(0, 0, 500)], [[_A, _B, _C]]]), [("multipartIntegrity", "INVALID_POLYGON_COMPONENT", None, MANUAL)]),
    (_g("MultiPolygon", [[_box(0, 0, 500)], [_box(0, 0, 500)[1:] + [at(500, 0)]]]), [("multipartIntegrity", "DUPLICATE_POLYGON_COMPONENT", None, MANUAL)]),
    (_g("MultiPolygon", [[_box(0, 0, 500)], [_box(300, 300, 500)]]), [("multipartIntegrity", "OVERLAPPING_POLYGON_COMPONENTS", None, MANUAL)]),
    (_g("Point", at(0, 0, "12345")), [("coordinatePrecision", "EXCESSIVE_COORDINATE_PRECISION", "", AUTO)]),
    (_g("LineString", [_A, at(0, 0, "0004"), _C]), [("coordinatePrecision", "EXCESSIVE_COORDINATE_PRECISION", "1", MANUAL), ("coordinatePrecision", "ROUNDING_COLLISION", "1", MANUAL)]),
    (_g("Point", [10000000.5, 1]), [("coordinatePrecision", "UNSAFE_COORDINATE_MAGNITUDE", "", MANUAL)]),
    (_g("Polygon", [[_A, _B, _C, _D]]), [("invalidRings", "UNCLOSED_RING", "0", AUTO), ("ringClosure", "OPEN_RING", "0", AUTO)]),
    (_g("Polygon", [[]]), [("invalidRings", "CORRUPTED_RING", "0", MANUAL), ("invalidRings", "INSUFFICIENT_RING_VERTICES", "0", MANUAL)]),
    (_g("Polygon", [[_A, _B, _B, _C, _D, _A]]), [("duplicateVertices", "DUPLICATE_VERTEX", "0,2", AUTO)]),
    (_g("Polygon", [[at(0, 0), at(1000, 800), at(1000, 0), at(0, 900), at(0, 0)]]), [("selfIntersections", "SELF_INTERSECTION", "0,0", AUTO), ("slivers", "SLIVER_POLYGON", None, MANUAL)]),
    (_g("Polygon", [_box(0, 0, 1000)[::-1]]), [("ringOrientation", "INCORRECT_RING_ORIENTATION", "0", AUTO)]),
    (_g("Polygon", [_box(0, 0, 1000), _box(2000, 0, 500)[::-1]]), [("invalidHoles", "HOLE_OUTSIDE_POLYGON", "1", AUTO)]),
    (_g("Polygon", [_box(0, 0, 1000), _box(0, 200, 500)[::-1]]), [("invalidHoles", "HOLE_TOUCHING_BOUNDARY", "1", MANUAL)]),
    (_g("Polygon", [_box(0, 0, 1000), _box(200, 200, 1)[::-1]]), [("invalidHoles", "TINY_HOLE", "1", AUTO)]),
    (_g("Polygon", [_box(0, 0, 1000), _box(200, 200, 300)[::-1], _box(200, 200, 300)[::-1]]), [("invalidHoles", "DUPLICATE_HOLE", "2", MANUAL)]),
    (_g("Polygon", [_box(0, 0, 1000), _box(200, 200, 600)[::-1], _box(300, 300, 100)[::-1]]), [("invalidHoles", "NESTED_HOLE", "2", MANUAL)]),
    (_g("Polygon", [_box(0, 0, 1000), _box(-500, -500, 3000)[::-1]]), [("invalidHoles", "HOLE_OUTSIDE_POLYGON", "1", AUTO), ("invalidHoles", "HOLE_LARGER_THAN_POLYGON", "1", MANUAL)]),
    (_g("Polygon", [_box(0, 0, 1000), [at(200, 200), at(600, 600), at(600, 200), at(200, 700), at(200, 200)]]), [("ringOrientation", "INCORRECT_RING_ORIENTATION", "1", AUTO), ("invalidHoles", "SELF_INTERSECTING_HOLE", "1", MANUAL)]),
    (_g("Polygon", [[_A, _B, _C, at(500, 1000), at(499, 1800), at(498, 1000), _D, _A]]), [("spikes", "SPIKE", "0,4", AUTO)]),
    (_g("Polygon", [_box(0, 0, 2)]), [("tinyPolygons", "TINY_POLYGON", None, MANUAL), ("slivers", "SLIVER_POLYGON", None, MANUAL)]),
    (_g("Polygon", [_box(0, 0, 4, 1500)]), [("slivers", "SLIVER_POLYGON", None, MANUAL)]),
    (_g("Polygon", [[_A, _D, at(0, 500), _A]]), [("ringOrientation", "INDETERMINATE_RING_ORIENTATION", "0", MANUAL), ("zeroAreaPolygons", "ZERO_AREA_POLYGON", None, MANUAL)]),
]


def _text(value: Any, px: int, py: int) -> str:
    """JSON of a value with positions about a place."""
    if isinstance(value, _At):
        x, y, more, z = value
        ordinates = ["%d.%06d" % divmod(px + x, 1_000_000) + more, "%d.%06d" % divmod(py + y, 1_000_000), *([] if z is None else [str(z)])]
        return f"[{', '.join(ordinates)}]"
    if isinstance(value, list):
        return f"[{', '.join(_text(v, px, py) for v in value)}]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{json.dumps(k)}: {_text(v, px, py)}" for k, v in value.items()) + "}"
    return json.dumps(value)


def feature_text(kind: Any, n: int) -> str:
    """The feature of a kind at a part's place."""
    whole = kind["feature"] if "feature" in kind else {"type": "Feature", "properties": {}, "geometry": kind}
    return _text(whole, 10_000_000 + n % 1000 * STEP, 10_000_000 + n // 1000 * STEP)


def planted(spark: SparkSession, sf_dir: str, kinds: list[Any]) -> DataFrame:
    """(feature_index, feature): for each part, a feature of the kind of its number's remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([feature_text(kinds[n % len(kinds)], n) for n in batch.column(0).to_pylist()], pa.string())], ["feature_index", "feature"])

    tasks = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("feature_index")).repartition(tasks, "feature_index")
    return parts.mapInArrow(run, "feature_index long, feature string")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir, [k for k, _ in KINDS])


def expected_sql(*checks: str) -> str:
    """SQL for the findings of some checks: (feature_index, code, path, disposition)."""
    rows = [(n, code, path, disposition) for n, (_, found) in enumerate(KINDS) for check, code, path, disposition in found if check in checks]
    quoted = lambda v: "NULL" if v is None else f"'{v}'"
    values = ", ".join(f"({n}, {quoted(c)}, CAST({quoted(p)} AS VARCHAR), {quoted(d)})" for n, c, p, d in rows)
    return f"SELECT p_partkey AS feature_index, code, path, disposition FROM part JOIN (VALUES {values}) v(kind, code, path, disposition) ON p_partkey % {len(KINDS)} = kind"
