"""Readers: GeoJSON, KML, KMZ, Shapefile (zipped or bare) and DXF text to a table of features.

A file is one parallel unit (listed by Spark's ``binaryFile`` source, so any store works); newline-delimited GeoJSON is
split like text. Rows: (path, feature_index, feature), feature as GeoJSON text in WGS 84.
"""

from __future__ import annotations

import io
import json
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import planar
from . import crs

FORMATS = ("geojson", "json", "kml", "kmz", "shp", "zip", "dxf")
MOST_BYTES = 250 << 20
# Limits of an archive.
ZIP_ENTRIES, ZIP_RATIO = 32, 1000


def extension(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""


# ---- formats ----------------------------------------------------------------------------------------------------


def geojson_features(data: bytes) -> list[Any]:
    """The root's features; a root that is no feature collection is an error."""
    root = json.loads(data.decode("utf-8-sig"))
    if not isinstance(root, dict) or root.get("type") != "FeatureCollection":
        raise ValueError("the root type must be FeatureCollection")
    if not isinstance(root.get("features"), list):
        raise ValueError("the features must be an array")
    return root["features"]


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _kml_positions(node: ET.Element) -> list[list[float]]:
    text = next((c.text or "" for c in node.iter() if _local(c.tag) == "coordinates"), "")
    return [[float(v) for v in t.split(",") if v] for t in text.split()]


def _kml_geometry(node: ET.Element) -> dict | None:
    kind = _local(node.tag)
    if kind == "Point":
        p = _kml_positions(node)
        return {"type": "Point", "coordinates": p[0]} if p else None
    if kind in ("LineString", "LinearRing"):
        return {"type": "LineString", "coordinates": _kml_positions(node)}
    if kind == "Polygon":
        sides = {"outerBoundaryIs": [], "innerBoundaryIs": []}
        for c in node:
            if _local(c.tag) in sides:
                sides[_local(c.tag)] += [_kml_positions(r) for r in c if _local(r.tag) == "LinearRing"]
        return {"type": "Polygon", "coordinates": sides["outerBoundaryIs"] + sides["innerBoundaryIs"]}
    if kind == "MultiGeometry":
        parts = [g for c in node if (g := _kml_geometry(c))]
        kinds = {g["type"] for g in parts}
        if len(kinds) == 1 and (one := kinds.pop()) in ("Point", "LineString", "Polygon"):
            return {"type": f"Multi{one}", "coordinates": [g["coordinates"] for g in parts]}
        return {"type": "GeometryCollection", "geometries": parts}
    return None


def kml_features(data: bytes) -> list[dict]:
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
        raise ValueError("KML with a document type is not read")
    out = []
    for mark in ET.fromstring(data).iter():
        if _local(mark.tag) != "Placemark":
            continue
        own: dict[str, Any] = {}
        for c in mark:
            if _local(c.tag) in ("name", "description", "styleUrl") and c.text:
                own[_local(c.tag)] = c.text.strip()
            if _local(c.tag) == "ExtendedData":
                for x in c.iter():
                    if _local(x.tag) == "SimpleData":
                        own[x.get("name", "")] = x.text
                    elif _local(x.tag) == "Data":
                        own[x.get("name", "")] = next((v.text for v in x if _local(v.tag) == "value"), None)
        geometry = next((g for c in mark if (g := _kml_geometry(c))), None)
        feature: dict[str, Any] = {"type": "Feature", "properties": own, "geometry": geometry}
        if mark.get("id"):
            feature["id"] = mark.get("id")
        out.append(feature)
    return out


def kmz_features(data: bytes) -> list[dict]:
    with safe_zip(data) as z:
        first = next((n for n in z.namelist() if n.lower().endswith(".kml")), None)
        if first is None:
            raise ValueError("the archive holds no KML")
        return kml_features(z.read(first))


def safe_zip(data: bytes) -> zipfile.ZipFile:
    """An archive with few entries, no paths upwards, no duplicates and no bombs."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = [i.filename for i in z.infolist()]
    if len(names) > ZIP_ENTRIES or len({n.lower() for n in names}) < len(names):
        raise ValueError("too many or repeated archive entries")
    for i in z.infolist():
        if i.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", i.filename) or ":" in i.filename:
            raise ValueError("an archive entry leaves the archive")
        if i.file_size > MOST_BYTES or i.file_size > ZIP_RATIO * max(1, i.compress_size):
            raise ValueError("an archive entry is too large")
    return z


def shp_geometries(data: bytes) -> list[dict | None]:
    """The shapes of a .shp file: points, multipoints, lines and polygons, with heights where they have them."""
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    out, at = [], 100
    while at + 8 <= len(data):
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        out.append(_shape(data[at + 8 : at + 8 + size]))
        at += 8 + size
    return out


def _shape(r: bytes) -> dict | None:
    kind = struct.unpack("<i", r[:4])[0]
    if kind == 0:
        return None
    base, high = kind % 10, 10 < kind < 20
    if base == 1:
        return {"type": "Point", "coordinates": list(struct.unpack("<3d" if high else "<2d", r[4 : 28 if high else 20]))}
    if base == 8:
        n = struct.unpack("<i", r[36:40])[0]
        starts, at = [0], 40
    elif base in (3, 5):
        parts, n = struct.unpack("<2i", r[36:44])
        starts, at = list(struct.unpack(f"<{parts}i", r[44 : 44 + 4 * parts])), 44 + 4 * parts
    else:
        raise ValueError(f"shape type {kind} is not read")
    xy = struct.unpack(f"<{2 * n}d", r[at : at + 16 * n])
    points = [[xy[2 * i], xy[2 * i + 1]] for i in range(n)]
    if high:
        z = struct.unpack(f"<{n}d", r[at + 16 * n + 16 : at + 24 * n + 16])
        points = [[*p, h] for p, h in zip(points, z)]
    if base == 8:
        return {"type": "MultiPoint", "coordinates": points}
    lines = [points[a:b] for a, b in zip(starts, [*starts[1:], n])]
    if base == 3:
        return {"type": "LineString", "coordinates": lines[0]} if len(lines) == 1 else {"type": "MultiLineString", "coordinates": lines}
    return polygons_of_rings(lines)


def polygons_of_rings(rings: list[list]) -> dict:
    """Clockwise rings are exteriors, the others holes of the smallest exterior around them."""
    import numpy as np

    outer = [[r] for r in rings if planar.orientation(r) != "ccw"]
    for h in (r for r in rings if planar.orientation(r) == "ccw"):
        around = [p for p in outer if planar.inside_ring(np.array([h[0][:2]], float), p[0])[0] >= 0]
        if around:
            min(around, key=lambda p: abs(planar.signed_area2(p[0]))).append(h)
        else:
            outer.append([h])
    return {"type": "Polygon", "coordinates": outer[0]} if len(outer) == 1 else {"type": "MultiPolygon", "coordinates": outer}


def dbf_rows(data: bytes, encoding: str = "utf-8") -> list[dict]:
    count, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), chr(data[at + 11]), data[at + 16]))
        at += 32
    out = []
    for i in range(count):
        r = data[head + i * size : head + (i + 1) * size]
        row, p = {}, 1
        for name, kind, width in fields:
            text = r[p : p + width].decode(encoding, "replace").strip().strip("\0")
            p += width
            if not text or set(text) == {"*"}:
                row[name] = None
            elif kind in "NF":
                number = float(text)
                row[name] = int(number) if number.is_integer() and "." not in text else number
            elif kind == "L":
                row[name] = text in "TtYy" if text in "TtYyFfNn" else None
            elif kind == "D":
                row[name] = f"{text[:4]}-{text[4:6]}-{text[6:8]}"
            else:
                row[name] = text
        out.append(row)
    return out


def reprojected(geometry: dict | None, source: str, target: str = "EPSG:4326") -> dict | None:
    if geometry is None or source == target:
        return geometry
    if geometry["type"] == "GeometryCollection":
        return {**geometry, "geometries": [reprojected(g, source, target) for g in geometry["geometries"]]}
    move = lambda c: crs.transform(c, source, target) if c and isinstance(c[0], (int, float)) else [move(x) for x in c]
    return {**geometry, "coordinates": move(geometry["coordinates"])}


def shapefile_features(shp: bytes, dbf: bytes | None = None, prj: str | None = None, cpg: str | None = None) -> list[dict]:
    geometries = shp_geometries(shp)
    rows = dbf_rows(dbf, cpg or "utf-8") if dbf else [{}] * len(geometries)
    source = "EPSG:4326"
    if prj:
        if (source := crs.of_wkt(prj) or "") == "":
            raise ValueError("the coordinate system of the shapefile is not supported")
    return [{"type": "Feature", "properties": r, "geometry": reprojected(g, source)} for g, r in zip(geometries, rows)]


def zipped_shapefile_features(data: bytes) -> list[dict]:
    """All layers of the archive, one after another."""
    with safe_zip(data) as z:
        names = {n.lower(): n for n in z.namelist()}
        layers = sorted(n for n in names if n.endswith(".shp"))
        if not layers:
            raise ValueError("the archive holds no shapefile")
        out = []
        for n in layers:
            part = lambda e, n=n: z.read(names[n[:-3] + e]) if n[:-3] + e in names else None
            text = lambda e, part=part: part(e).decode("utf-8", "replace").strip() if part(e) else None
            out += shapefile_features(part("shp"), part("dbf"), text("prj"), text("cpg"))
        return out


def dxf_pairs(data: bytes) -> Iterator[tuple[int, str]]:
    """Group codes and values of a text drawing; escapes of the form \\U+0041 are decoded."""
    head = data[:4096]
    page = re.search(rb"\$DWGCODEPAGE\s+3\s+(\S+)", head)
    name = (page[1].decode("ascii", "replace").lower() if page else "utf-8").replace("ansi_", "cp")
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        try:
            text = data.decode(name)
        except (LookupError, UnicodeDecodeError):
            text = data.decode("latin-1")
    lines = text.splitlines()
    for i in range(0, len(lines) - 1, 2):
        if lines[i].strip().lstrip("-").isdigit():
            yield int(lines[i]), re.sub(r"\\U\+([0-9A-Fa-f]{4})", lambda m: chr(int(m[1], 16)), lines[i + 1].strip())


def dxf_layers(data: bytes) -> list[str]:
    """The names of the layer table, in order, without repeats."""
    out: dict[str, None] = {}
    inside = False
    for code, value in dxf_pairs(data):
        if code == 2 and value == "ENTITIES":
            break
        if code == 0:
            inside = value == "LAYER"
        elif code == 2 and inside and value:
            out.setdefault(value)
            inside = False
    return list(out)


def dxf_features(data: bytes, source_crs: str) -> list[dict]:
    """POINT, LINE, LWPOLYLINE and POLYLINE entities; closed polylines are polygons."""
    entities: list[tuple[str, list[tuple[int, str]]]] = []
    section = ""
    for code, value in dxf_pairs(data):
        if code == 0:
            section = "" if value == "ENDSEC" else section
            if section == "ENTITIES":
                entities.append((value, []))
        elif code == 2 and not section:
            section = value
        elif section == "ENTITIES" and entities:
            entities[-1][1].append((code, value))
    out = []

    def add(layer: str, line: list, closed: bool) -> None:
        if closed and len(line) >= 3:
            ring = line if line[0] == line[-1] else [*line, list(line[0])]
            geometry: dict = {"type": "Polygon", "coordinates": [ring]}
        else:
            geometry = {"type": "LineString", "coordinates": line} if len(line) > 1 else {"type": "Point", "coordinates": line[0]}
        out.append({"type": "Feature", "id": f"{layer}:{len(out)}", "cadLayer": layer, "properties": {"Layer": layer}, "geometry": reprojected(geometry, source_crs)})

    i = 0
    while i < len(entities):
        kind, pairs = entities[i]
        layer = next((v for c, v in pairs if c == 8), "0")
        number = lambda code, pairs=pairs: [float(v) for c, v in pairs if c == code]
        flag = int(next((v for c, v in pairs if c == 70), "0"))
        if kind == "POINT":
            add(layer, [[x[0] for x in map(number, (10, 20, 30)) if x]], False)
        elif kind == "LINE":
            add(layer, [[x[0] for x in map(number, (10, 20, 30)) if x], [x[0] for x in map(number, (11, 21, 31)) if x]], False)
        elif kind == "LWPOLYLINE":
            add(layer, [list(p) for p in zip(number(10), number(20))], bool(flag & 1))
        elif kind == "POLYLINE":
            line = []
            while i + 1 < len(entities) and entities[i + 1][0] in ("VERTEX", "SEQEND"):
                i += 1
                if entities[i][0] == "SEQEND":
                    break
                line.append([float(next(v for c, v in entities[i][1] if c == k)) for k in (10, 20, 30) if any(c == k for c, _ in entities[i][1])])
            if line:
                add(layer, line, bool(flag & 1))
        i += 1
    return out


def features_of(name: str, data: bytes, source_crs: str | None = None) -> list[Any]:
    """Chooses the reader by extension."""
    kind = extension(name)
    if len(data) > MOST_BYTES:
        raise ValueError("the file is too large")
    if kind in ("geojson", "json"):
        return geojson_features(data)
    if kind == "kml":
        return kml_features(data)
    if kind == "kmz":
        return kmz_features(data)
    if kind == "zip":
        return zipped_shapefile_features(data)
    if kind == "shp":
        return shapefile_features(data)
    if kind == "dxf":
        if not source_crs:
            raise ValueError("a drawing needs its coordinate system")
        crs.parse(source_crs)
        return dxf_features(data, source_crs)
    raise TypeError(f"unsupported file type {kind!r}")


# ---- tables -------------------------------------------------------------------------------------------------------


def read_gis(spark: SparkSession, path: str, source_crs: str | None = None) -> DataFrame:
    """(path, feature_index, feature) of a file or of all files below a folder."""
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(" + "|".join(FORMATS) + r")$")).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = features_of(name, data, source_crs)
                for i in range(0, len(found), 5000):
                    part = found[i : i + 5000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(range(i, i + len(part)), pa.int64()), pa.array([json.dumps(f, ensure_ascii=False) for f in part], pa.string())], ["path", "feature_index", "feature"])

    return files.mapInArrow(run, "path string, feature_index long, feature string")


def read_dataset(spark: SparkSession, path: str, source_crs: str | None = None) -> DataFrame:
    """(feature_index, path, file_index, feature) of all files below a folder as one dataset.

    feature_index runs over all files in order of their paths; file_index is the place in the file.
    """
    from ..tables import numbered

    found = read_gis(spark, path, source_crs).withColumnRenamed("feature_index", "file_index")
    return numbered(found, ["path", "file_index"], "feature_index").select("feature_index", "path", "file_index", "feature")


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, feature_index, feature) of newline-delimited features, one a line: split and numbered in parallel."""
    from ..tables import numbered

    lines = spark.read.text(path).select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_n")).where(F.length(F.trim("value")) > 0)
    return numbered(lines, ["path", "_at", "_n"], "feature_index").select("path", "feature_index", F.col("value").alias("feature"))
