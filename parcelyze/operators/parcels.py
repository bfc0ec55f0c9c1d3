"""Parcels edited by hand, drawings and drawing imports: validation of what people and other programs send, and the match of
parcels to a healed output.

Validators give a reason or None; a table of them is one narrow pass.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import planar
from . import decompose as d
from . import feature_checks as checks
from .repairs import orient_rings

# Limits of drawings and of import reports.
DRAWING_SHAPES, SHAPE_VERTICES, DRAWING_VERTICES = 500, 1000, 8000
MERCATOR_LATITUDE = 85.051129
WARNING_CODES = ("CAD_POLYGON_FALLBACK", "CAD_MISSING_BLOCK")
MOST_WARNINGS, WARNING_LENGTH = 100, 512
POLYGON_FALLBACK = (
    "organizePolygons() received an unexpected geometry.  Either a polygon with interior rings, or a polygon with less than 4 points, or a non-Polygon "
    "geometry.  Return arguments as a collection."
)
POLYGON_FALLBACK_NOTE = "Some polygon boundaries were read using a geometry fallback; review their topology."
MISSING_BLOCK_NOTE = "; its contents could not be imported."
CRS_CODE = r"EPSG:[1-9]\d{3,5}"


# ---- parcels ----------------------------------------------------------------------------------------------------


def _apart(rings: list) -> bool:
    """Whether no two rings meet, taken as areas."""
    for i, r in enumerate(rings):
        x, y = np.array([p[:2] for p in r], float).min(axis=0), np.array([p[:2] for p in r], float).max(axis=0)
        for s in rings[:i]:
            q = np.array([p[:2] for p in s], float)
            if (q.min(axis=0) <= y).all() and (q.max(axis=0) >= x).all() and planar.polygons_meet([r], [s]):
                return False
    return True


def parcel_fault(geometry: Any, kind: str) -> str | None:
    """Why a geometry is no valid parcel of a kind (Polygon or MultiPolygon), or None."""
    if not isinstance(geometry, dict) or geometry.get("type") != kind or kind not in ("Polygon", "MultiPolygon"):
        return "type"
    parts = geometry.get("coordinates")
    parts = [parts] if kind == "Polygon" else parts
    if not isinstance(parts, list) or not parts or not all(isinstance(p, list) and p and all(isinstance(r, list) and len(r) >= 4 for r in p) for p in parts):
        return "rings"
    every = [p for part in parts for r in part for p in r]
    if not all(d.finite(p) and abs(p[0]) <= 180 and abs(p[1]) <= 90 for p in every):
        return "positions"
    if len({len(p) for p in every}) > 1:
        return "dimension"
    for ring in (r for part in parts for r in part):
        if d.key(ring[0]) != d.key(ring[-1]):
            return "open"
        if any(d.key(p[:2]) == d.key(q[:2]) for p, q in zip(ring, ring[1:])):
            return "repeated"
        if planar.orientation(ring) == "indeterminate":
            return "flat"
    if checks.invalid_rings(geometry) or checks.self_intersections(geometry):
        return "crossing"
    if checks.multipart_integrity(geometry) or checks.invalid_holes(geometry, 0.0) or not all(_apart(p[1:]) for p in parts):
        return "parts"
    return None


def checked_parcel(geometry: Any, kind: str) -> dict | None:
    """A valid parcel with its rings turned the right way, or None."""
    return None if parcel_fault(geometry, kind) else orient_rings({"type": kind, "coordinates": geometry["coordinates"]})[0]


def checked_parcels(edits: DataFrame) -> DataFrame:
    """edits (parcel, kind, geometry as JSON) -> (parcel, fault, geometry): the fault, or the geometry turned right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                try:
                    geometry = json.loads(text) if text is not None else None
                except ValueError:
                    geometry = None
                fault = parcel_fault(geometry, kind)
                out.append((fault, None if fault else json.dumps(checked_parcel(geometry, kind))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], pa.string()) for k in (0, 1))], ["parcel", "fault", "geometry"])

    return edits.select("parcel", "kind", "geometry").mapInArrow(run, f"parcel {dict(edits.dtypes)['parcel']}, fault string, geometry string")


def parcel_signature(geometry: Any) -> str:
    """Equal for geometries with the same rings to nine places, wherever rings start, whichever way they run and parts stand."""
    parts = geometry.get("coordinates") if isinstance(geometry, dict) else None
    if not isinstance(parts, list):
        return json.dumps(parts)
    polygons = [parts] if geometry.get("type") == "Polygon" else parts
    if not all(isinstance(p, list) and all(isinstance(r, list) and all(map(d.finite, r)) for r in p) for p in polygons):
        return json.dumps(parts)
    named = [(planar.signature(p[0], 9) if p else (), *sorted(planar.signature(r, 9) for r in p[1:])) for p in polygons]
    return json.dumps(sorted(named))


def _signed(features: DataFrame) -> DataFrame:
    """(feature_index, kind, own_id, mark): a hash of the signature stands for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                f = json.loads(text)
                g = f.get("geometry") if isinstance(f, dict) else None
                own = d.feature_id(f)
                out.append((g.get("type") if isinstance(g, dict) else None, None if own is None else json.dumps(own, ensure_ascii=False), parcel_signature(g)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], pa.string()) for k in range(3))], ["feature_index", "kind", "own_id", "mark"])

    return features.select("feature_index", "feature").mapInArrow(run, "feature_index long, kind string, own_id string, mark string").withColumn("mark", F.sha2("mark", 256))


def matched_parcels(source: DataFrame, output: DataFrame) -> DataFrame:
    """(feature_index, out_index): source parcels that can be told in an output by their shape: with their id, if that and the shape
    are unique on both sides, else by a shape that is unique on both sides and whose ids do not contradict."""
    s, o = _signed(source), _signed(output).withColumnRenamed("feature_index", "out_index")
    shape, whole = Window.partitionBy("kind", "mark"), Window.partitionBy("kind", "mark", "own_id")
    s, o = (t.where("kind in ('Polygon', 'MultiPolygon')").withColumn("alike", F.count("*").over(shape)).withColumn("twins", F.count("*").over(whole)) for t in (s, o))
    by_id = s.where("own_id is not null and twins = 1").join(o.where("own_id is not null and twins = 1").select("kind", "mark", "own_id", "out_index"), ["kind", "mark", "own_id"]).select("feature_index", "out_index")
    lone = s.where("alike = 1").join(o.where("alike = 1").select("kind", "mark", F.col("own_id").alias("other_id"), "out_index"), ["kind", "mark"])
    lone = lone.where("own_id is null or other_id is null or own_id = other_id").select("feature_index", "out_index")
    return by_id.union(lone).distinct()


# ---- drawings ----------------------------------------------------------------------------------------------------


def _shape_fault(shape: Any) -> str | None:
    points = shape["vertices"]
    for p in points:
        if not (isinstance(p, list) and len(p) == 2 and d.finite(p) and abs(p[0]) <= 180 and abs(p[1]) <= MERCATOR_LATITUDE):
            return "vertex"
    if len({d.key(p) for p in points}) < len(points):
        return "repeated"
    if shape["kind"] == "parcel":
        ring = [*points, points[0]]
        if planar.orientation(ring) == "indeterminate" or not planar.simple(ring):
            return "ring"
    return None


def drawing_fault(drawing: Any) -> str | None:
    """Why a drawing (revision, features: id, kind, vertices) is invalid, or None."""
    if not isinstance(drawing, dict):
        return "drawing"
    revision, shapes = drawing.get("revision"), drawing.get("features")
    if isinstance(revision, bool) or not isinstance(revision, (int, float)) or not math.isfinite(revision) or revision != int(revision) or not 0 <= revision < 2**31 - 1:
        return "revision"
    if not isinstance(shapes, list) or len(shapes) > DRAWING_SHAPES:
        return "features"
    names, total = set(), 0
    for s in shapes:
        if not isinstance(s, dict) or not isinstance(s.get("id"), str) or not re.fullmatch(r"[A-Za-z0-9-]{1,64}", s["id"]) or s["id"] in names:
            return "id"
        least = {"line": 2, "parcel": 3}.get(s.get("kind") if isinstance(s.get("kind"), str) else "")
        if least is None:
            return "kind"
        if not isinstance(s.get("vertices"), list) or not least <= len(s["vertices"]) <= SHAPE_VERTICES:
            return "vertices"
        names.add(s["id"])
        total += len(s["vertices"])
        if total > DRAWING_VERTICES:
            return "vertices"
        if fault := _shape_fault(s):
            return fault
    return None


def drawing_faults(drawings: DataFrame) -> DataFrame:
    """drawings (drawing, body as JSON) -> (drawing, fault)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                try:
                    out.append(drawing_fault(json.loads(text)) if text is not None else "drawing")
                except ValueError:
                    out.append("drawing")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["drawing", "fault"])

    return drawings.select("drawing", "body").mapInArrow(run, f"drawing {dict(drawings.dtypes)['drawing']}, fault string")


# ---- imports of drawings -------------------------------------------------------------------------------------------


def import_report(text: Column) -> Column:
    """The import metadata of a foreign file as struct(sourceCrs, targetCrs, partial, warnings), or null if it is malformed."""
    r = F.from_json(text, "sourceCrs string, targetCrs string, warnings array<struct<code: string, message: string, occurrences: bigint>>")
    w = r["warnings"]
    good = F.forall(w, lambda x: F.coalesce(x["code"].isin(*WARNING_CODES) & (F.length(x["message"]) <= WARNING_LENGTH) & (x["occurrences"] > 0) & (x["occurrences"] <= 9007199254740991), F.lit(False)))
    valid = r["sourceCrs"].rlike(f"^{CRS_CODE}$") & (r["targetCrs"] == "EPSG:4326") & w.isNotNull() & (F.size(w) <= MOST_WARNINGS) & good
    partial = F.exists(w, lambda x: x["code"] == "CAD_MISSING_BLOCK")
    return F.when(F.coalesce(valid, F.lit(False)), F.struct(r["sourceCrs"].alias("sourceCrs"), F.lit("EPSG:4326").alias("targetCrs"), partial.alias("partial"), w.alias("warnings")))


def import_warnings(messages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, message, occurrences) of what a reader said: messages (keys, category, message).

    A message that is not a runtime warning, or not one of the two known, has the code UNSUPPORTED, as have those beyond the
    first ``MOST_WARNINGS`` different ones of a file, in the order of their texts.
    """
    text = F.trim("message")
    known = F.when(F.col("category") == "RuntimeWarning", F.when(text == POLYGON_FALLBACK, F.lit(WARNING_CODES[0])).when(text.rlike(r"^Block [^\r\n]{1,255} does not exist$"), F.lit(WARNING_CODES[1])))
    said = F.when(known == WARNING_CODES[0], F.lit(POLYGON_FALLBACK_NOTE)).when(known == WARNING_CODES[1], F.concat(text, F.lit(MISSING_BLOCK_NOTE)))
    n = messages.select(*keys, F.coalesce(known, F.lit("UNSUPPORTED")).alias("code"), said.alias("message")).groupBy(*keys, "code", "message").agg(F.count("*").alias("occurrences"))
    place = F.row_number().over(Window.partitionBy(*keys, F.col("code") == "UNSUPPORTED").orderBy("code", "message"))
    beyond = (place > MOST_WARNINGS) & (F.col("code") != "UNSUPPORTED")
    n = n.withColumn("_beyond", beyond)
    code, message = F.when(F.col("_beyond"), F.lit("UNSUPPORTED")).otherwise(F.col("code")), F.when(~F.col("_beyond"), F.col("message"))
    return n.select(*keys, code.alias("code"), message.alias("message"), "occurrences").groupBy(*keys, "code", "message").agg(F.sum("occurrences").alias("occurrences"))
