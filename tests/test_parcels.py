"""Parcels edited by hand, drawings, conversions and versioned tables."""

import json

import pytest
from parcelyze.operators import parcels
from parcelyze.sources import readers, store, writers


def box(x, y, w, h):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]


def polygon(*rings):
    return {"type": "Polygon", "coordinates": list(rings)}


@pytest.mark.parametrize(
    "geometry,fault",
    [
        (polygon(box(0, 0, 1, 1)), None), (polygon(box(0, 0, 1, 1)[::-1], box(0.2, 0.2, 0.1, 0.1)), None), ({"type": "Point", "coordinates": [0, 0]}, "type"), (polygon(), "rings"), (polygon(box(0, 0, 1, 1)[:3]), "rings"),
        (polygon(box(0, 89, 1, 2)), "positions"), (polygon([*box(0, 0, 1, 1)[:4], [0, float("nan")]]), "positions"), (polygon(box(0, 0, 4, 4), box(1, 1, 1, 1), box(1.5, 1.5, 1, 1)), "parts"), (polygon(box(0, 0, 4, 4), box(5, 5, 1, 1)), "parts"),
        (None, "type"), (7, "type"),
    ],
)
def test_parcel_faults(geometry, fault):
    assert parcels.parcel_fault(geometry, "Polygon") == fault


def test_checked_parcels_turn_rings(spark):
    hole = box(0.2, 0.2, 0.1, 0.1)
    assert parcels.checked_parcel(polygon(box(0, 0, 1, 1)[::-1], hole), "Polygon") == polygon(box(0, 0, 1, 1), hole[::-1])
    rows = spark.createDataFrame([(1, "Polygon", json.dumps(polygon(box(0, 0, 1, 1)))), (2, "MultiPolygon", "{"), (3, "Polygon", None)], "parcel int, kind string, geometry string")
    assert {r.parcel: r.fault for r in parcels.checked_parcels(rows).collect()} == {1: None, 2: "type", 3: "type"}


def test_drawing_limits():
    shape = lambda i, n=2: {"id": f"s{i}", "kind": "line", "vertices": [[x / 1000, i / 1000] for x in range(n)]}
    drawing = lambda shapes: {"revision": 0, "features": shapes}
    assert parcels.drawing_fault(drawing([shape(i) for i in range(500)])) is None
    assert parcels.drawing_fault(drawing([shape(i) for i in range(501)])) == "features"
    assert parcels.drawing_fault(drawing([shape(0, 1001)])) == "vertices" and parcels.drawing_fault(drawing([shape(i, 1000) for i in range(9)])) == "vertices"
    assert parcels.drawing_fault({"revision": True, "features": []}) == "revision" and parcels.drawing_fault([]) == "drawing"
    assert parcels.drawing_fault(drawing([{**shape(0), "kind": ["line"]}])) == "kind"


def test_conversion_options_and_limits():
    ok = writers.conversion_options("a.GeoJSON", "shapefile", split="true")
    assert (ok.source, ok.target, ok.split) == ("geojson", "shapefile", True)
    for args, fault in (
        (("a.kml",), "UNSUPPORTED_CONVERSION_FORMAT"), (("a.dxf",), "SOURCE_CRS_REQUIRED"), (("a.zip", "dxf", "EPSG:12"), "INVALID_SOURCE_CRS"), (("a.zip", "dxf", None, "32639"), "INVALID_TARGET_CRS"), (("a.zip", "shapefile", None, None, "true"), "UNSUPPORTED_CONVERSION_FORMAT"),
    ):
        with pytest.raises(ValueError, match=fault):
            writers.conversion_options(*args)
    one = {"type": "Feature", "properties": {}, "geometry": polygon(box(51, 35, 1, 1))}
    with pytest.raises(ValueError, match="LIMIT"):
        writers.checked_for_conversion([one] * 3, most_features=2)
    with pytest.raises(ValueError, match="LIMIT"):
        writers.checked_for_conversion([one] * 3, most_vertices=14)
    with pytest.raises(ValueError, match="INVALID_CONVERSION_FILE"):
        writers.checked_for_conversion([{**one, "geometry": polygon(box(51, 35, 1, 1)[:4])}])
    with pytest.raises(ValueError, match="NO_GEOMETRY"):
        writers.checked_for_conversion([])
    data = json.dumps({"type": "FeatureCollection", "features": [one]}).encode()
    back = readers.features_of("x.dxf", writers.convert_file("a.geojson", data, writers.conversion_options("a.geojson", "dxf", None, "EPSG:32639")), "EPSG:32639")
    assert back[0]["geometry"]["coordinates"][0][2] == pytest.approx([52.0, 36.0])


def test_versions_and_expired_imports(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert store.latest(spark, path) is None
    with pytest.raises(store.SourceExpired):
        store.cached_features(spark, path)
    rows = lambda *r: spark.createDataFrame(list(r), "id long, v string, at int")
    assert [store.upsert(rows((1, "a", 1), (2, "b", 1)), path, ["id"], "at"), store.upsert(rows((2, "c", 2), (2, "d", 3), (3, "e", 1)), path, ["id"], "at"), store.upsert(rows((1, "f", 9)), path, ["id"], "at")] == [1, 2, 3]
    assert {tuple(r) for r in store.latest(spark, path).select("id", "v").collect()} == {(1, "f"), (2, "d"), (3, "e")}
    assert store._versions(spark, path) == [2, 3]
    with pytest.raises(ValueError):
        store.cache_features(rows().limit(0), f"{path}2")
    assert store.cache_features(rows((1, "a", 1)), f"{path}2").count() == 1


def test_written_drawings_and_archives_in_parts(spark, tmp_path):
    features = [{"type": "Feature", "cadLayer": "ab"[i % 2], "properties": {"n": i}, "geometry": polygon(box(51 + i, 35, 0.5, 0.5))} for i in range(7)]
    df = spark.createDataFrame([(i, json.dumps(f)) for i, f in enumerate(features)], "feature_index long, feature string")
    writers.write_dxf(df, f"file://{tmp_path}/d", "EPSG:4326")
    text = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "d").glob("part-*.txt")))
    back = readers.features_of("x.dxf", text.encode(), "EPSG:4326")
    assert [f["geometry"]["coordinates"] for f in back] == [f["geometry"]["coordinates"] for f in features] and readers.dxf_layers(text.encode()) == ["a", "b"]
    writers.write_shapefiles(df, f"file://{tmp_path}/s", 3)
    found = spark.read.parquet(f"file://{tmp_path}/s").orderBy("family", "part").collect()
    assert [len(readers.features_of("x.zip", r.data)) for r in found] and sum(len(readers.features_of("x.zip", r.data)) for r in found) == 7 and len(found) == 3
    writers.write_dxf(df.limit(0), f"file://{tmp_path}/e", "EPSG:4326")
    assert readers.dxf_features("\n".join(p.read_text() for p in (tmp_path / "e").glob("part-*.txt")).encode(), "EPSG:4326") == []


def test_numbers_run_over_all_files_of_a_folder(spark, tmp_path):
    for name, n in (("a", 3), ("b", 2)):
        (tmp_path / f"{name}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "id": f"{name}{i}", "geometry": None} for i in range(n)]}))
    got = [(r.feature_index, r.file_index, json.loads(r.feature)["id"]) for r in readers.read_dataset(spark, f"file://{tmp_path}").orderBy("feature_index").collect()]
    assert got == [(0, 0, "a0"), (1, 1, "a1"), (2, 2, "a2"), (3, 0, "b0"), (4, 1, "b1")]
