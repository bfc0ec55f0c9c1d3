"""Readers and writers."""

import io
import json
import zipfile

import pytest
from parcelyze.sources import readers as r
from parcelyze.sources import writers as w

SQUARE = [[51.0, 35.0], [51.1, 35.0], [51.1, 35.1], [51.0, 35.1], [51.0, 35.0]]
HOLE = [[51.02, 35.02], [51.02, 35.04], [51.04, 35.04], [51.04, 35.02], [51.02, 35.02]]
FEATURES = [
    {"type": "Feature", "properties": {"name": "a", "n": 1.5, "a long attribute": {"x": 1}}, "geometry": {"type": "Polygon", "coordinates": [SQUARE, HOLE]}},
    {"type": "Feature", "properties": {"name": "b"}, "geometry": {"type": "LineString", "coordinates": [[51.0, 35.0], [51.5, 35.5]]}},
    {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [51.0, 35.0]}},
]


def test_geojson(spark, tmp_path):
    (tmp_path / "in.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": FEATURES}))
    (tmp_path / "other.txt").write_text("x")
    table = r.read_gis(spark, str(tmp_path))
    got = [json.loads(x.feature) for x in table.orderBy("feature_index").collect()]
    assert got == FEATURES
    w.write_geojson(table, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert json.loads(text)["features"] == FEATURES
    w.write_geojson(table.limit(0), str(tmp_path / "none"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "none").glob("part-*")))["features"] == []


def test_lines_are_numbered_in_order(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text("\n".join(json.dumps({"id": i}) for i in range(500)) + "\n\n")
    got = r.read_geojson_lines(spark, str(tmp_path)).collect()
    assert sorted((x.feature_index, json.loads(x.feature)["id"]) for x in got) == [(i, i) for i in range(500)]


def test_bad_roots():
    for bad in (b"[]", b'{"type": "Feature"}', b'{"type": "FeatureCollection", "features": 3}'):
        with pytest.raises(ValueError):
            r.features_of("x.json", bad)
    with pytest.raises(TypeError):
        r.features_of("x.dwg", b"")


def test_shapefile_round_trip():
    back = r.features_of("x.zip", w.convert(FEATURES, "shapefile"))
    by = {f["geometry"]["type"]: f for f in back}
    assert set(by) == {"Polygon", "LineString", "Point"}
    rings = by["Polygon"]["geometry"]["coordinates"]
    assert sorted(rings[0]) == sorted(SQUARE) and sorted(rings[1]) == sorted(HOLE)
    assert by["Polygon"]["properties"] == {"name": "a", "n": 1.5, "a_long_att": '{"x": 1}'}


def test_projected_shapefile():
    utm = [{"type": "Feature", "properties": {"k": 1}, "geometry": {"type": "Point", "coordinates": [500000.0, 0.0]}}]
    parts = w.shapefile_parts(utm)
    got = r.shapefile_features(parts["shp"], parts["dbf"], 'PROJCS["WGS_1984_UTM_Zone_39N",GEOGCS["x"]]')
    assert got[0]["geometry"]["coordinates"] == pytest.approx([51.0, 0.0]) and got[0]["properties"] == {"k": 1.0}
    with pytest.raises(ValueError):
        r.shapefile_features(parts["shp"], None, 'PROJCS["Lambert_93"]')


def test_field_names():
    assert list(w.field_names(["attribute one", "attribute two", "né", "A"]).values()) == ["attribute_", "attribut_1", "n_", "A"]
    with pytest.raises(ValueError):
        w.field_names([str(i) for i in range(256)])


def test_dxf_round_trip():
    tall = {"type": "Feature", "cadLayer": "Wände", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[51.0, 35.0, 5.0], [51.1, 35.1, 6.0]]}}
    data = w.convert([*FEATURES, tall], "dxf", "EPSG:32639")
    back = r.features_of("x.dxf", data, "EPSG:32639")
    assert [f["geometry"]["type"] for f in back] == ["Polygon", "Polygon", "LineString", "Point", "LineString"]
    assert back[0]["geometry"]["coordinates"][0][2] == pytest.approx([51.1, 35.1])
    assert back[-1]["cadLayer"] == "Wände" and back[-1]["geometry"]["coordinates"][1][2] == 6.0
    assert r.dxf_layers(data) == ["0", "Wände"]
    with pytest.raises(ValueError):
        r.features_of("x.dxf", data)
    assert next(r.dxf_pairs(b"  2\nA\\U+00E9\n")) == (2, "Aé")


KML = """<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark id="p"><name>x</name><ExtendedData><Data name="k"><value>3</value></Data></ExtendedData>
<MultiGeometry><Point><coordinates>51,35,1</coordinates></Point><Point><coordinates>52,36</coordinates></Point></MultiGeometry></Placemark></Document></kml>"""


def test_kml_and_kmz():
    got = r.features_of("a.kml", KML.encode())
    assert got == [{"type": "Feature", "id": "p", "properties": {"name": "x", "k": "3"}, "geometry": {"type": "MultiPoint", "coordinates": [[51.0, 35.0, 1.0], [52.0, 36.0]]}}]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("doc.kml", KML)
    assert r.features_of("a.kmz", out.getvalue()) == got
    with pytest.raises(ValueError):
        r.features_of("a.kml", b"<!DOCTYPE x>" + KML.encode())


def test_unsafe_archives():
    for names in (["../a.shp"], ["a.shp", "A.SHP"], [f"{i}.txt" for i in range(33)]):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, "x")
        with pytest.raises(ValueError):
            r.safe_zip(out.getvalue())


def test_linework_and_rounding():
    many = {"type": "MultiPolygon", "coordinates": [[SQUARE, HOLE], [SQUARE]]}
    assert w.linework(many) == {"type": "MultiLineString", "coordinates": [SQUARE, HOLE, SQUARE]}
    assert w.linework({"type": "LineString", "coordinates": SQUARE}) == {"type": "MultiLineString", "coordinates": [SQUARE]}
    assert w.rounded({"type": "Point", "coordinates": [1.00000000049, 2.0, 3.1234567896]})["coordinates"] == [1.0, 2.0, 3.12345679]
    with pytest.raises(ValueError):
        w.convert([{"type": "Feature", "geometry": None}], "geojson")


def _no_rows_to_the_driver(monkeypatch, most):
    """Lets the driver collect at most so many rows at once."""
    from pyspark.sql.classic.dataframe import DataFrame

    whole = DataFrame.collect

    def collect(self):
        got = whole(self)
        assert len(got) <= most
        return got

    monkeypatch.setattr(DataFrame, "collect", collect)


def _boxes_of(rows):
    return sorted((r.feature_index, r.minx, r.miny, r.maxx, r.maxy) for r in rows)


def test_drawings_do_not_go_through_the_driver(spark, tiny, monkeypatch):
    from parcelyze.plans import catalogue

    want = _boxes_of(catalogue.shapefile_roundtrip(spark, tiny).toPandas().itertuples())
    with monkeypatch.context() as m:
        _no_rows_to_the_driver(m, 50)
        back = catalogue.dxf_roundtrip(spark, tiny)
    assert len(want) > 100 and _boxes_of(back.toPandas().itertuples()) == want


def test_drawings_of_a_dataset_hold_it_in_order(spark, tmp_path):
    rows = [(i, json.dumps({"type": "Feature", "properties": {"Layer": f"l{i % 3}"}, "geometry": {"type": "Point", "coordinates": [51.0, i / 10]}})) for i in range(25)]
    path = f"file://{tmp_path}/d"
    w.write_drawings(spark.createDataFrame(rows, "feature_index long, feature string").repartition(3), path, "EPSG:4326", 10)
    assert sorted(p.name for p in (tmp_path / "d").glob("*.dxf")) == [f"{i:08d}.dxf" for i in range(3)]
    got = [json.loads(x.feature)["geometry"]["coordinates"][1] for x in r.read_dataset(spark, path, "EPSG:4326").orderBy("feature_index").collect()]
    assert got == [i / 10 for i in range(25)]


def test_kml_does_not_go_through_the_driver(spark, tiny, monkeypatch):
    from parcelyze.plans import catalogue

    want = _boxes_of(catalogue.geojson_roundtrip(spark, tiny).toPandas().itertuples())
    with monkeypatch.context() as m:
        _no_rows_to_the_driver(m, 50)
        back = catalogue.kml_scan(spark, tiny)
    got = _boxes_of(back.toPandas().itertuples())
    assert len(got) > 100 and set(got) <= set(want)
