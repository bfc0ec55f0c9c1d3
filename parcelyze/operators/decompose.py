"""Geometry taken apart: leaves, positions, sequences, rings, components and holes, each with its address.

A feature is GeoJSON text, schema on read: malformed content is data to report. An address is the feature's index, the
path through geometry collections, and the path inside the coordinates. Nothing here looks at other features.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

# How deep positions lie in the coordinates of each type.
DEPTH = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}
TYPES = (*DEPTH, "GeometryCollection")
Path = tuple[int, ...]


def finite(p: Any) -> bool:
    """A position: two or more finite numbers."""
    if not isinstance(p, list) or len(p) < 2:
        return False
    for v in p:
        if type(v) is not float and (not isinstance(v, (int, float)) or isinstance(v, bool)) or not math.isfinite(v):
            return False
    return True


def key(p: list) -> tuple:
    """Equal for equal positions (-0 equals 0)."""
    return (p[0] + 0.0, p[1] + 0.0) if len(p) == 2 else tuple([v + 0.0 for v in p])


def closed_ring(ring: Any) -> bool:
    return isinstance(ring, list) and len(ring) >= 4 and all(map(finite, ring)) and key(ring[0]) == key(ring[-1])


def feature_id(feature: Any) -> Any:
    """The id if there is one (null counts), else a string or number ``id`` among the properties."""
    if not isinstance(feature, dict):
        return None
    if "id" in feature:
        return feature["id"]
    own = feature.get("properties")
    own = own.get("id") if isinstance(own, dict) else None
    return own if isinstance(own, (str, int, float)) and not isinstance(own, bool) else None


def layer_of(feature: Any) -> str | None:
    """The drawing layer: the normalised one, else from the import's metadata and properties; null without metadata."""
    if not isinstance(feature, dict):
        return None
    if isinstance(feature.get("cadLayer"), str):
        return feature["cadLayer"]
    meta = feature.get("cadImport")
    if not isinstance(meta, dict) or "layer" not in meta:
        return None
    own = feature.get("properties") if isinstance(feature.get("properties"), dict) else {}
    if isinstance(own.get("Layer"), str) and own["Layer"]:
        return own["Layer"]
    level = own.get("Level")
    if isinstance(level, (int, float)) and not isinstance(level, bool) or isinstance(level, str) and level:
        return str(level) if meta["layer"] == "elements" else f"{meta['layer']}${level}"
    return meta["layer"] if isinstance(meta["layer"], str) else None


def leaves(geometry: Any, at: Path = ()) -> Iterator[tuple[Path, str, Any]]:
    """(collection path, type, coordinates) of the geometries that are no collections."""
    stack = [(geometry, at)]
    while stack:
        g, path = stack.pop()
        if not isinstance(g, dict) or not g.get("type"):
            continue
        if g["type"] == "GeometryCollection":
            if isinstance(g.get("geometries"), list):
                stack += [(c, (*path, i)) for i, c in reversed(list(enumerate(g["geometries"])))]
        else:
            yield path, g["type"], g.get("coordinates")


def _at_depth(value: Any, depth: int, path: Path) -> Iterator[tuple[Path, Any]]:
    if depth == 0:
        yield path, value
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _at_depth(v, depth - 1, (*path, i))


def positions(geometry: Any) -> Iterator[tuple[Path, str, Path, Any]]:
    """(collection path, type, coordinate path, value) at the depth where the type has positions, good or bad."""
    for gc, kind, c in leaves(geometry):
        if kind in DEPTH:
            for path, v in _at_depth(c, DEPTH[kind], ()):
                yield gc, kind, path, v


def sequences(geometry: Any) -> Iterator[tuple[Path, str, str, Path, list]]:
    """(collection path, type, 'line' or 'ring', root path, positions) of lines and rings that are all finite."""
    for gc, kind, c in leaves(geometry):
        if kind in ("LineString", "MultiLineString", "Polygon", "MultiPolygon"):
            for path, s in _at_depth(c, DEPTH[kind] - 1, ()):
                if isinstance(s, list) and s and all(map(finite, s)):
                    yield gc, kind, "line" if "Line" in kind else "ring", path, s


def rings(geometry: Any) -> Iterator[tuple[Path, str, Path, Any]]:
    """(collection path, type, coordinate path, ring) of all rings; empty polygons and parts have one stand-in."""
    for gc, kind, c in leaves(geometry):
        if kind not in ("Polygon", "MultiPolygon"):
            continue
        if not isinstance(c, list) or not c:
            yield gc, kind, (0,) if kind == "Polygon" else (0, 0), c
            continue
        for i, part in enumerate(c):
            if kind == "Polygon":
                yield gc, kind, (i,), part
            elif not isinstance(part, list) or not part:
                yield gc, kind, (i, 0), part
            else:
                for k, ring in enumerate(part):
                    yield gc, kind, (i, k), ring


def components(geometry: Any) -> Iterator[tuple[Path, str, Path, list]]:
    """(collection path, type, polygon path, rings) of polygons whose rings are all closed and finite."""
    for gc, kind, c in leaves(geometry):
        parts = [((), c)] if kind == "Polygon" else [((i,), p) for i, p in enumerate(c)] if kind == "MultiPolygon" and isinstance(c, list) else []
        for path, p in parts:
            if isinstance(p, list) and p and all(map(closed_ring, p)):
                yield gc, kind, path, p


def holes(geometry: Any) -> Iterator[tuple[Path, str, Path, list, list[tuple[int, list]]]]:
    """(collection path, type, polygon path, exterior, [(index, hole)]) where the exterior is a closed ring."""
    for gc, kind, c in leaves(geometry):
        parts = [((), c)] if kind == "Polygon" else [((i,), p) for i, p in enumerate(c)] if kind == "MultiPolygon" and isinstance(c, list) else []
        for path, p in parts:
            if isinstance(p, list) and len(p) > 1 and closed_ring(p[0]):
                yield gc, kind, path, p[0], [(i, r) for i, r in enumerate(p) if i and closed_ring(r)]


def updated(geometry: dict, gc: Path, path: Path, value: Any) -> dict:
    """A copy of a geometry with another value at an address."""
    if gc:
        children = list(geometry["geometries"])
        children[gc[0]] = updated(children[gc[0]], gc[1:], path, value)
        return {**geometry, "geometries": children}

    def put(node: Any, rest: Path) -> Any:
        if not rest:
            return value
        out = list(node)
        out[rest[0]] = put(out[rest[0]], rest[1:])
        return out

    return {**geometry, "coordinates": put(geometry.get("coordinates"), path)}


def at_address(geometry: Any, gc: Path, path: Path) -> Any:
    """What stands at an address, or None."""
    try:
        for i in gc:
            geometry = geometry["geometries"][i]
        node = geometry["coordinates"]
        for i in path:
            node = node[i]
        return node
    except (KeyError, IndexError, TypeError):
        return None


# ---- tables ---------------------------------------------------------------------------------------------------

COMPONENTS = "feature_index long, feature_id string, layer string, component long, gc_path array<int>, geometry_type string, polygon_path array<int>, rings array<array<array<double>>>, minx double, miny double, maxx double, maxy double"
LINES = "feature_index long, feature_id string, layer string, part long, gc_path array<int>, geometry_type string, root_path array<int>, line array<array<double>>"
#: Components and parts are numbered in order over all features: index * PARTS + number within the feature. More are an error.
PARTS = 1 << 20


def _number(index: int, n: int) -> int:
    if n >= PARTS or not -(1 << 43) <= index < 1 << 43:
        raise ValueError(f"feature {index} has more than {PARTS} parts, or its index is out of range")
    return index * PARTS + n


def _id_text(feature: Any) -> str | None:
    """The id as JSON text, so that 1 and "1" differ; null for none."""
    own = feature_id(feature)
    return None if own is None else json.dumps(own, ensure_ascii=False)


def _arrow(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


_INTS, _POINTS = pa.list_(pa.int32()), pa.list_(pa.list_(pa.float64()))


def component_table(features: DataFrame) -> DataFrame:
    """(feature_index, feature) -> one row for each polygon component."""

    def run(batches):
        names = [c.split(" ")[0] for c in COMPONENTS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), _INTS, pa.string(), _INTS, pa.list_(_POINTS), *[pa.float64()] * 4]
        for batch in batches:
            out = []
            for index, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = json.loads(text)
                if not isinstance(f, dict):
                    continue
                for n, (gc, kind, path, r) in enumerate(components(f.get("geometry"))):
                    xs, ys = [p[0] for ring in r for p in ring], [p[1] for ring in r for p in ring]
                    out.append((index, _id_text(f), layer_of(f), _number(index, n), list(gc), kind, list(path), [[[float(v) + 0.0 for v in p] for p in ring] for ring in r], min(xs), min(ys), max(xs), max(ys)))
            yield _arrow(out, names, kinds)

    return features.select("feature_index", "feature").mapInArrow(run, COMPONENTS)


def line_table(features: DataFrame) -> DataFrame:
    """(feature_index, feature) -> one row for each line of two or more positions."""

    def run(batches):
        names = [c.split(" ")[0] for c in LINES.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), _INTS, pa.string(), _INTS, _POINTS]
        for batch in batches:
            out = []
            for index, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = json.loads(text)
                if not isinstance(f, dict):
                    continue
                found = [s for s in sequences(f.get("geometry")) if s[2] == "line" and len(s[4]) > 1]
                for n, (gc, kind, _, path, line) in enumerate(found):
                    out.append((index, _id_text(f), layer_of(f), _number(index, n), list(gc), kind, list(path), [[float(v) + 0.0 for v in p] for p in line]))
            yield _arrow(out, names, kinds)

    return features.select("feature_index", "feature").mapInArrow(run, LINES)
