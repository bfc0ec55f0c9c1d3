"""Checks of single features, all in one pass: what is wrong with a feature is decided from that feature alone.

``check_feature`` runs the checks in report order. A feature with unresolved structural findings is left out of the later checks, as
if its geometry were null: first by type and dimension, then also by multipart integrity, then by ring validity. So
the quarantine needs no join; the flags of a feature say from which pairwise checks it is kept.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal, localcontext
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import MAX_SAFE_INTEGER, OVERLAP_M2, SLIVER_COMPACTNESS, SPIKE_ANGLE_DEG, SPIKE_LEG_RATIO, SPIKE_STRONG_RATIO, Options
from ..functions import planar
from . import decompose as d
from .repairs import repair_self_intersection, repair_spikes

Finding = dict[str, Any]

#: Report order of the checks.
CHECKS = (
    "geometryTypes", "geometryDimensions", "multipartIntegrity", "coordinatePrecision", "invalidRings", "ringClosure", "duplicateVertices", "undershoots", "overshoots",
    "selfIntersections", "ringOrientation", "invalidHoles", "spikes", "zeroAreaPolygons", "tinyPolygons", "slivers", "overlaps", "gaps", "neighborConsistency",
)


def _finding(code: str, gc=(), kind: str | None = None, path=None, related=None, polygon=None, repairable: bool = False, **details: Any) -> Finding:
    return {"code": code, "gc_path": list(gc), "geometry_type": kind, "coordinate_path": None if path is None else list(path), "related_coordinate_path": None if related is None else list(related), "polygon_path": None if polygon is None else list(polygon), "repairable": repairable, "failure": None, "details": details}


def geometry_types(feature: Any) -> list[Finding]:
    if not isinstance(feature, dict):
        return [_finding("INVALID_FEATURE_OBJECT")]
    out: list[Finding] = []

    def visit(g: Any, gc: tuple, nullable: bool) -> None:
        if g is None and nullable and "geometry" in feature:
            return
        if not isinstance(g, dict):
            out.append(_finding("INVALID_GEOMETRY_OBJECT", gc))
        elif not isinstance(g.get("type"), str):
            out.append(_finding("MISSING_GEOMETRY_TYPE", gc))
        elif g["type"] not in d.TYPES:
            out.append(_finding("UNSUPPORTED_GEOMETRY_TYPE", gc, receivedType=g["type"]))
        elif g["type"] == "GeometryCollection":
            if not isinstance(g.get("geometries"), list):
                out.append(_finding("INVALID_GEOMETRY_COLLECTION", gc, receivedType=g["type"]))
            else:
                for i, child in enumerate(g["geometries"]):
                    visit(child, (*gc, i), False)

    visit(feature.get("geometry"), (), True)
    return out


def geometry_dimensions(geometry: Any) -> list[Finding]:
    out, expected = [], {}
    for gc, kind, path, v in d.positions(geometry):
        size, want = len(v) if isinstance(v, list) else None, expected.get(gc)
        details = {"expectedDimension": want, "actualDimension": size}
        if size is None or size < 2:
            out.append(_finding("INVALID_POSITION_DIMENSION", gc, kind, path, **details))
        elif not d.finite(v):
            out.append(_finding("INVALID_COORDINATE_VALUE", gc, kind, path, **details))
        elif want is None:
            expected[gc] = size
        elif size != want:
            out.append(_finding("INCONSISTENT_POSITION_DIMENSION", gc, kind, path, **details))
    return out


def multipart_integrity(geometry: Any) -> list[Finding]:
    out = []
    for gc, kind, parts in d.leaves(geometry):
        if kind != "MultiPolygon":
            continue
        if not isinstance(parts, list) or not parts:
            out.append(_finding("EMPTY_MULTIPOLYGON", gc))
            continue
        good = []
        for i, p in enumerate(parts):
            if not (isinstance(p, list) and p and all(map(d.closed_ring, p))):
                out.append(_finding("INVALID_POLYGON_COMPONENT", gc, polygon=(i,)))
                continue
            xs, ys = [q[0] for r in p for q in r], [q[1] for r in p for q in r]
            good.append((min(xs), i, (min(xs), min(ys), max(xs), max(ys)), (planar.signature(p[0]), *sorted(planar.signature(r) for r in p[1:])), p))
        pairs = []
        line = sorted(good)
        for n, (_, i, box, sig, p) in enumerate(line):  # a sweep over x
            for x, j, box2, sig2, q in line[n + 1 :]:
                if x > box[2]:
                    break
                if box2[1] <= box[3] and box2[3] >= box[1]:
                    pairs.append((min(i, j), max(i, j), sig == sig2, (p, q) if i < j else (q, p)))
        for i, j, same, (p, q) in sorted(pairs, key=lambda x: x[:2]):
            if same:
                out.append(_finding("DUPLICATE_POLYGON_COMPONENT", gc, polygon=(j,), relatedPolygonPath=[i]))
            elif (area := planar.intersection_area(p, q)) > 0:
                out.append(_finding("OVERLAPPING_POLYGON_COMPONENTS", gc, polygon=(j,), relatedPolygonPath=[i], overlapAreaM2=area))
    return out


def to_places(value: float, places: int) -> float:
    """The nearest decimal of the exact binary value, halves away from zero; never -0."""
    if abs(value) >= 1e21:
        return float(value)
    if type(value) is float and round(value, places) == value:  # a tie that this hides has the same nearest number either way
        return value + 0.0
    with localcontext() as ctx:
        ctx.prec = 80
        return float(Decimal(value).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP)) + 0.0


def decimal_places(value: float) -> int:
    """Of the shortest decimal that stands for the number."""
    return max(0, -Decimal(repr(float(value))).normalize().as_tuple().exponent)


def coordinate_precision(geometry: Any, places: int) -> list[Finding]:
    out, seen = [], {}
    most = MAX_SAFE_INTEGER / 10**places
    parents = {"MultiPoint": 0, "LineString": 0, "MultiLineString": 1, "Polygon": 1, "MultiPolygon": 2}
    for gc, kind, path, p in d.positions(geometry):
        if not d.finite(p):
            continue
        rounded = [to_places(v, places) for v in p]
        for i, (v, r) in enumerate(zip(p, rounded)):
            if r == v and abs(r) <= most:
                continue
            details = {"ordinateIndex": i, "value": v, "roundedValue": r, "decimalPlaces": decimal_places(v)}
            if r != v:
                out.append(_finding("EXCESSIVE_COORDINATE_PRECISION", gc, kind, path, repairable=True, **details))
            if abs(r) > most:
                out.append(_finding("UNSAFE_COORDINATE_MAGNITUDE", gc, kind, path, **details))
        if kind in parents:
            exact, first = d.key(p[:2]), seen.setdefault((gc, kind, path[: parents[kind]], tuple(rounded[:2])), (d.key(p[:2]), path))
            if first[0] != exact:
                out.append(_finding("ROUNDING_COLLISION", gc, kind, path, first[1]))
    if any(f["code"] != "EXCESSIVE_COORDINATE_PRECISION" for f in out):
        out = [{**f, "repairable": False} for f in out]
    return out


def invalid_rings(geometry: Any) -> list[Finding]:
    out = []
    for gc, kind, path, ring in d.rings(geometry):
        listed = isinstance(ring, list)
        good = [p for p in ring if d.finite(p)] if listed else []
        bad = [i for i, p in enumerate(ring) if not d.finite(p)] if listed else []
        reason = "RING_NOT_ARRAY" if not listed else "EMPTY_RING" if not ring else "INVALID_POSITION" if bad else None
        closed = reason is None and d.key(good[0]) == d.key(good[-1])
        distinct = len({d.key(p) for p in (good[:-1] if closed else good)})
        details = {"role": "interior" if path[-1] else "exterior", "positionCount": len(ring) if listed else 0, "distinctVertexCount": distinct, "invalidCoordinateIndices": bad, "corruptionReason": reason}
        if reason:
            out.append(_finding("CORRUPTED_RING", gc, kind, path, **details))
        elif not closed:
            out.append(_finding("UNCLOSED_RING", gc, kind, path, repairable=distinct >= 3, **details))
        if distinct < 3:
            out.append(_finding("INSUFFICIENT_RING_VERTICES", gc, kind, path, **details))
    return out


def ring_closure(geometry: Any) -> list[Finding]:
    out = []
    for gc, kind, path, ring in d.rings(geometry):
        if not isinstance(ring, list) or not ring or not d.finite(ring[0]) or not d.finite(ring[-1]) or d.key(ring[0]) == d.key(ring[-1]):
            continue
        distinct = len({d.key(p) for p in ring if d.finite(p)})
        blocked = "CORRUPTED_RING" if not all(map(d.finite, ring)) else "INSUFFICIENT_VERTICES" if distinct < 3 else None
        out.append(_finding("OPEN_RING", gc, kind, path, repairable=blocked is None, positionCount=len(ring), distinctVertexCount=distinct, blockedReason=blocked))
    return out


def _collapsible(line: list, kind: str) -> bool:
    """Whether a sequence stands without its consecutive repeats."""
    kept = [p for i, p in enumerate(line) if i == 0 or d.key(p) != d.key(line[i - 1])]
    if kind == "line":
        return len(kept) >= 2
    return len(kept) >= 4 and d.key(kept[0]) == d.key(kept[-1]) and len({d.key(p) for p in kept[:-1]}) >= 3


def duplicate_vertices(geometry: Any) -> list[Finding]:
    out = []
    for gc, kind, shape, root, line in d.sequences(geometry):
        keys = [d.key(p) for p in line]
        closed = shape == "ring" and len(line) > 1 and keys[0] == keys[-1]
        safe = _collapsible(line, shape)
        tail = len(line) - 1  # copies of the closing vertex right before it
        while closed and tail > 1 and keys[tail - 1] == keys[0]:
            tail -= 1
        last: dict[tuple, int] = {}
        for i, k in enumerate(keys):
            if closed and i == len(line) - 1:
                continue
            if closed and i >= tail:
                out.append(_finding("DUPLICATE_VERTEX", gc, kind, (*root, i), (*root, i + 1), repairable=safe, duplicateKind="consecutive"))
                continue
            if k in last:
                near = last[k] == i - 1
                out.append(_finding("DUPLICATE_VERTEX", gc, kind, (*root, i), (*root, last[k]), repairable=near and safe, duplicateKind="consecutive" if near else "non-consecutive"))
            last[k] = i
    return out


def self_intersections(geometry: Any) -> list[Finding]:
    out = []
    for gc, kind, path, ring in d.rings(geometry):
        if path[-1] or not d.closed_ring(ring):
            continue
        for i, j, how, where in planar.ring_crossings(ring):
            out.append(_finding("SELF_INTERSECTION", gc, kind, (*path, i), (*path, j), polygon=path[:-1], intersectionKind=how, intersection=where))
    if len(out) == 1 and out[0]["details"]["intersectionKind"] == "Crossing" and not out[0]["gc_path"]:
        part = d.at_address(geometry, (), tuple(out[0]["polygon_path"]))
        flat = len(part) == 1 and all(len(p) == 2 for p in part[0]) and len({d.key(p) for p in part[0][:-1]}) == len(part[0]) - 1
        out[0]["repairable"] = flat
    return out


def ring_orientation(geometry: Any) -> list[Finding]:
    out = []
    for gc, kind, path, ring in d.rings(geometry):
        if not d.closed_ring(ring):
            continue
        turn, want = planar.orientation(ring), "cw" if path[-1] else "ccw"
        if turn == "indeterminate":
            out.append(_finding("INDETERMINATE_RING_ORIENTATION", gc, kind, path))
        elif turn != want:
            out.append(_finding("INCORRECT_RING_ORIENTATION", gc, kind, path, repairable=True, expected=want, actual=turn))
    return out


def invalid_holes(geometry: Any, tiny_m2: float) -> list[Finding]:
    out = []
    for gc, kind, path, outer, found in d.holes(geometry):
        outer_m2 = planar.ring_area(outer)
        seen: dict[tuple, int] = {}
        twins, inner = set(), {}
        for i, ring in found:
            at = (*path, i)
            if not planar.simple(ring):
                out.append(_finding("SELF_INTERSECTING_HOLE", gc, kind, at, polygon=path))
                continue
            area, sig, where = planar.ring_area(ring), planar.signature(ring), planar.containment(ring, outer)
            details = {"holeAreaM2": area, "exteriorAreaM2": outer_m2}
            if where == "outside":
                out.append(_finding("HOLE_OUTSIDE_POLYGON", gc, kind, at, polygon=path, repairable=True, **details))
            elif where == "touching":
                out.append(_finding("HOLE_TOUCHING_BOUNDARY", gc, kind, at, polygon=path, **details))
            else:
                inner[i] = (area, ring)
            if area < tiny_m2:
                out.append(_finding("TINY_HOLE", gc, kind, at, polygon=path, repairable=True, **details))
            if area > outer_m2:
                out.append(_finding("HOLE_LARGER_THAN_POLYGON", gc, kind, at, polygon=path, **details))
            if sig in seen:
                twins |= {i, seen[sig]}
                out.append(_finding("DUPLICATE_HOLE", gc, kind, at, (*path, seen[sig]), polygon=path, **details))
            else:
                seen[sig] = i
        inner = {i: v for i, v in inner.items() if i not in twins}
        by_area = sorted(inner, key=lambda i: inner[i][0])
        for i in inner:
            x = [p[0] for p in inner[i][1]]
            for j in by_area:  # the smallest hole around it
                o = [p[0] for p in inner[j][1]]
                if j != i and inner[j][0] >= inner[i][0] and min(o) <= min(x) and max(x) <= max(o) and planar.containment(inner[i][1], inner[j][1]) == "inside":
                    out.append(_finding("NESTED_HOLE", gc, kind, (*path, i), (*path, j), polygon=path, holeAreaM2=inner[i][0], exteriorAreaM2=outer_m2))
                    break
    return out


def _blunt(p: list, t: list, n: list) -> bool:
    """Whether a corner is far from a spike's leg ratio, by a rough measure with a wide margin; most corners are."""
    (px, py), (tx, ty), (nx, ny) = p[:2], t[:2], n[:2]
    if max(abs(px), abs(tx), abs(nx)) > 360 or max(abs(py), abs(ty), abs(ny)) > 85:
        return False
    most = max(px, tx, nx) - min(px, tx, nx), max(py, ty, ny) - min(py, ty, ny)
    if not 1e-7 < max(most) < 0.1:  # shorter ones are lost in rounding, longer ones bend
        return False
    east = math.cos(math.radians(ty))
    before, after, base = (math.hypot((a - c) * east, b - e) for (a, b), (c, e) in (((px, py), (tx, ty)), ((tx, ty), (nx, ny)), ((px, py), (nx, ny))))
    return min(before, after) > 1e-8 and min(before, after) < base * SPIKE_LEG_RATIO / 2


def spikes(geometry: Any, base_m: float) -> list[Finding]:
    out = []
    for gc, kind, shape, root, line in d.sequences(geometry):
        if shape == "ring":
            body = line[:-1] if d.key(line[0]) == d.key(line[-1]) else []
            turn = planar.orientation(line) if body and root[-1] == 0 else "indeterminate"
            tips = range(len(body)) if len(body) >= 3 else ()
        else:
            body, turn, tips = line, "indeterminate", range(1, len(line) - 1)
        for i in tips:
            p, t, n = body[i - 1], body[i], body[(i + 1) % len(body)]
            if _blunt(p, t, n):
                continue
            before, after, base = (float(planar.haversine(a[:2], b[:2])) for a, b in ((p, t), (t, n), (p, n)))
            if not before or not after:
                continue
            angle = math.degrees(math.acos(max(-1.0, min(1.0, (before**2 + after**2 - base**2) / (2 * before * after)))))
            ratio = math.inf if base == 0 else min(before, after) / base
            if angle > SPIKE_ANGLE_DEG or ratio < SPIKE_LEG_RATIO:
                continue
            cross = (t[0] - p[0]) * (n[1] - t[1]) - (t[1] - p[1]) * (n[0] - t[0])
            outward = None if turn == "indeterminate" else (cross > 0) == (turn == "ccw") and cross != 0
            near, strong = base <= base_m, outward is True and ratio >= SPIKE_STRONG_RATIO
            evidence = "WithinTolerance" if near else "StrongRingBacktrack" if strong else "None"
            out.append(_finding("SPIKE", gc, kind, (*root, i), repairable=near or strong, sequenceKind=shape, baseWidthMeters=base, tipAngleDegrees=angle, legToBaseRatio=ratio if math.isfinite(ratio) else None, outwardRingSpike=outward, repairEvidence=evidence))
    return out


def areas(geometry: Any, threshold_m2: float) -> tuple[list[Finding], list[Finding], list[Finding]]:
    """(zero areas, tiny polygons, slivers without their neighbours)."""
    zero, tiny, thin = [], [], []
    for gc, kind, path, r in d.components(geometry):
        area = planar.polygon_area(r)
        if area == 0:
            zero.append(_finding("ZERO_AREA_POLYGON", gc, kind, polygon=path, areaM2=area))
        if not area > 0:
            continue
        if area < threshold_m2:
            tiny.append(_finding("TINY_POLYGON", gc, kind, polygon=path, areaM2=area, thresholdM2=threshold_m2))
        around = planar.perimeter(r)
        compact = 4 * math.pi * area / around**2 if around else None
        reasons = ["Area"] * (area < threshold_m2) + ["Compactness"] * (compact is not None and compact < SLIVER_COMPACTNESS)
        if reasons:
            thin.append(_finding("SLIVER_POLYGON", gc, kind, polygon=path, areaM2=area, perimeterMeters=around, compactness=compact, detectionReasons=reasons))
    return zero, tiny, thin


def check_feature(feature: Any, options: Options) -> tuple[list[tuple[str, Finding]], dict[str, bool]]:
    """([(check, finding)], flags): flags say whether the feature is structurally invalid, unsafe for polygon checks, or
    unsafe for relations between polygons."""
    found: list[tuple[str, Finding]] = []

    def add(check: str, items: list[Finding]) -> bool:
        found.extend((check, f) for f in items)
        return any(not (f["repairable"] and f["failure"] is None) for f in items)

    flags = {"structural": False, "polygon_unsafe": True, "relation_unsafe": True}
    flags["structural"] = add("geometryTypes", geometry_types(feature))
    geometry = feature.get("geometry") if isinstance(feature, dict) else None
    if flags["structural"] or geometry is None:
        flags["polygon_unsafe"] = flags["relation_unsafe"] = flags["structural"]
        return found, flags
    if add("geometryDimensions", geometry_dimensions(geometry)):
        flags["structural"] = True
        return found, flags
    flags["structural"] = add("multipartIntegrity", multipart_integrity(geometry))
    add("coordinatePrecision", coordinate_precision(geometry, options.places))
    if flags["structural"]:
        return found, flags
    # A dry run changes nothing, so every open ring stays unresolved.
    rings = invalid_rings(geometry)
    add("invalidRings", rings)
    add("ringClosure", ring_closure(geometry))
    add("duplicateVertices", duplicate_vertices(geometry))
    if rings:
        return found, flags
    crossing, pointed = self_intersections(geometry), spikes(geometry, options.tolerance_m)
    for items, attempt in ((crossing, repair_self_intersection), (pointed, repair_spikes)):
        if any(f["repairable"] for f in items):  # a dry run tries the repair to learn why it would fail
            _, failures = attempt(geometry, items)
            for i, why in failures.items():
                items[i]["failure"] = why
    add("selfIntersections", crossing)
    add("ringOrientation", ring_orientation(geometry))
    holes = invalid_holes(geometry, options.area_m2)
    add("invalidHoles", holes)
    add("spikes", pointed)
    zero, tiny, thin = areas(geometry, options.area_m2)
    add("zeroAreaPolygons", zero)
    add("tinyPolygons", tiny)
    add("slivers", thin)
    flags["polygon_unsafe"] = False
    flags["relation_unsafe"] = bool(crossing or holes or pointed or zero)
    return found, flags


def check_slivers(feature: Any, options: Options) -> tuple[list[tuple[str, Finding]], dict[str, bool]]:
    """The slivers that ``check_feature`` finds, without the checks that have no say in that; its flags are not told."""
    flags = dict.fromkeys(("structural", "polygon_unsafe", "relation_unsafe"))
    geometry = feature.get("geometry") if isinstance(feature, dict) else None
    if geometry is None or any(not (f["repairable"] and f["failure"] is None) for f in geometry_types(feature)):
        return [], flags
    if any(not (f["repairable"] and f["failure"] is None) for f in [*geometry_dimensions(geometry), *multipart_integrity(geometry)]) or invalid_rings(geometry):
        return [], flags
    return [("slivers", f) for f in areas(geometry, options.area_m2)[2]], flags


FINDINGS = (
    "check string, code string, feature_index long, feature_id string, related_feature_index long, related_feature_id string, geometry_type string, gc_path array<int>, related_gc_path array<int>, "
    "coordinate_path array<int>, related_coordinate_path array<int>, polygon_path array<int>, related_polygon_path array<int>, repairable boolean, failure string, details string, ord long"
)
_I = pa.list_(pa.int32())
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), _I, _I, _I, _I, _I, _I, pa.bool_(), pa.string(), pa.string(), pa.int64()]
_NAMES = [c.split(" ")[0] for c in FINDINGS.split(", ")]
CHECKED = f"feature_index long, structural boolean, polygon_unsafe boolean, relation_unsafe boolean, findings array<struct<{', '.join(c.replace(' ', ': ', 1) for c in FINDINGS.split(', '))}>>"


def check_features(features: DataFrame, options: Options, check_one: Callable = check_feature) -> DataFrame:
    """(feature_index, feature) -> one row for each feature: its flags and findings. One narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct(list(zip(_NAMES, _KINDS)))
        for batch in batches:
            index, flags, every = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                feature = json.loads(text)
                found, flag = check_one(feature, options)
                own = None if d.feature_id(feature) is None else json.dumps(d.feature_id(feature), ensure_ascii=False)
                rows = []
                for n, (check, f) in enumerate(found):
                    related = f["details"].pop("relatedPolygonPath", None)
                    values = (check, f["code"], i, own, None, None, f["geometry_type"], f["gc_path"], [], f["coordinate_path"], f["related_coordinate_path"], f["polygon_path"], related, f["repairable"], f["failure"], json.dumps(f["details"]), n)
                    rows.append(dict(zip(_NAMES, values)))
                index.append(i)
                flags.append(flag)
                every.append(rows)
            cols = [pa.array(index, pa.int64()), *(pa.array([f[k] for f in flags], pa.bool_()) for k in ("structural", "polygon_unsafe", "relation_unsafe")), pa.array(every, pa.list_(kind))]
            yield pa.RecordBatch.from_arrays(cols, ["feature_index", "structural", "polygon_unsafe", "relation_unsafe", "findings"])

    return features.select("feature_index", "feature").mapInArrow(run, CHECKED)


__all__ = ["CHECKS", "FINDINGS", "OVERLAP_M2", "check_feature", "check_features", "check_slivers"]
