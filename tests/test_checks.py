"""Checks of single features, repairs, and checks between features through the dry run."""

import json

import pytest
from parcelyze.config import Options
from parcelyze.operators import decompose as d
from parcelyze.operators import feature_checks as c
from parcelyze.operators import pair_checks, repairs
from parcelyze.plans.dry_run import AUTO, check_reports, code_counts, dry_run, group_members, issue_groups, summary, unresolved_features
from parcelyze.plans.heal import heal, heal_feature, reviewed

O = Options(25.0)


def box(x, y, w, h):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]


def polygon(*rings):
    return {"type": "Polygon", "coordinates": list(rings)}


def feature(geometry, **extra):
    return {"type": "Feature", "properties": {}, "geometry": geometry, **extra}


def codes(found):
    return [f["code"] for f in found]


def table(spark, features):
    return spark.createDataFrame([(i, json.dumps(f)) for i, f in enumerate(features)], "feature_index long, feature string")


def test_types():
    assert codes(c.geometry_types(7)) == ["INVALID_FEATURE_OBJECT"]
    assert codes(c.geometry_types(feature(None))) == []
    assert codes(c.geometry_types({"type": "Feature"})) == ["INVALID_GEOMETRY_OBJECT"]
    assert codes(c.geometry_types(feature({"coordinates": []}))) == ["MISSING_GEOMETRY_TYPE"]
    assert codes(c.geometry_types(feature({"type": "CircularString"}))) == ["UNSUPPORTED_GEOMETRY_TYPE"]
    nested = feature({"type": "GeometryCollection", "geometries": [None, {"type": "GeometryCollection"}, {"type": "Point", "coordinates": [0, 0]}]})
    assert [(f["code"], f["gc_path"]) for f in c.geometry_types(nested)] == [("INVALID_GEOMETRY_OBJECT", [0]), ("INVALID_GEOMETRY_COLLECTION", [1])]


def test_dimensions():
    found = c.geometry_dimensions({"type": "LineString", "coordinates": [[1], [1, 2], [1, 2, 3], ["a", 2], [3, 4]]})
    assert [(f["code"], f["details"]["expectedDimension"]) for f in found] == [("INVALID_POSITION_DIMENSION", None), ("INCONSISTENT_POSITION_DIMENSION", 2), ("INVALID_COORDINATE_VALUE", 2)]


def test_multipart():
    many = {"type": "MultiPolygon", "coordinates": [[box(0, 0, 2, 2)], [box(1, 1, 2, 2)], [box(0, 0, 2, 2)[1:] + [[2, 0]]], [], [box(9, 9, 1, 1)]]}
    found = c.multipart_integrity(many)
    assert sorted(codes(found)) == ["DUPLICATE_POLYGON_COMPONENT", "INVALID_POLYGON_COMPONENT", "OVERLAPPING_POLYGON_COMPONENTS", "OVERLAPPING_POLYGON_COMPONENTS"]
    assert codes(c.multipart_integrity({"type": "MultiPolygon", "coordinates": []})) == ["EMPTY_MULTIPOLYGON"]


def test_precision():
    found = c.coordinate_precision({"type": "LineString", "coordinates": [[51.00000000012, 35.0], [51.0, 35.0], [51.5, 35.5]]}, 9)
    assert codes(found) == ["EXCESSIVE_COORDINATE_PRECISION", "ROUNDING_COLLISION"] and not found[0]["repairable"]
    assert c.coordinate_precision({"type": "Point", "coordinates": [51.1234567891, 1]}, 9)[0]["repairable"]
    assert codes(c.coordinate_precision({"type": "Point", "coordinates": [1e8, 1]}, 9)) == ["UNSAFE_COORDINATE_MAGNITUDE"]


def test_rings():
    open_ring = box(0, 0, 1, 1)[:-1]
    assert [(f["code"], f["repairable"]) for f in c.invalid_rings(polygon(open_ring))] == [("UNCLOSED_RING", True)]
    assert codes(c.invalid_rings(polygon([[0, 0], [1, 1], [0, 0]]))) == ["INSUFFICIENT_RING_VERTICES"]
    assert codes(c.invalid_rings(polygon([[0, 0], None, [1, 1], [1, 0], [0, 0]]))) == ["CORRUPTED_RING"]
    assert codes(c.invalid_rings(polygon())) == ["CORRUPTED_RING", "INSUFFICIENT_RING_VERTICES"]
    assert [(f["code"], f["details"]["blockedReason"]) for f in c.ring_closure(polygon(open_ring, [[0, 0], [1, 1]]))] == [("OPEN_RING", None), ("OPEN_RING", "INSUFFICIENT_VERTICES")]


def test_duplicate_vertices():
    ring = [[0, 0], [1, 0], [1, 0], [1, 1], [0, 0], [0, 0]]
    found = c.duplicate_vertices(polygon(ring))
    assert [(f["coordinate_path"], f["related_coordinate_path"], f["repairable"]) for f in found] == [([0, 2], [0, 1], True), ([0, 4], [0, 5], True)]
    geometry, n = repairs.drop_duplicate_vertices(polygon(ring))
    assert n == 2 and geometry["coordinates"][0] == [[0, 0], [1, 0], [1, 1], [0, 0]]
    back = c.duplicate_vertices({"type": "LineString", "coordinates": [[0, 0], [1, 1], [0, 0]]})
    assert [(f["details"]["duplicateKind"], f["repairable"]) for f in back] == [("non-consecutive", False)]
    assert not c.duplicate_vertices({"type": "LineString", "coordinates": [[1, 1], [1, 1]]})[0]["repairable"]


def test_self_intersection_and_unkink():
    tie = polygon([[51, 35], [51.001, 35.001], [51.001, 35], [51, 35.0011], [51, 35]])
    found = c.self_intersections(tie)
    assert len(found) == 1 and found[0]["repairable"]
    fixed, failed = repairs.repair_self_intersection(tie, found)
    assert not failed and fixed["type"] == "MultiPolygon" and len(fixed["coordinates"]) == 2 and repairs.valid_polygons(fixed)
    assert tie["type"] == "Polygon"  # the input is as it was
    holed = polygon(tie["coordinates"][0], box(51.0001, 35.0005, 0.00001, 0.00001))
    assert not c.self_intersections(holed)[0]["repairable"]


def test_orientation():
    bad = polygon(box(0, 0, 4, 4)[::-1], box(1, 1, 1, 1))
    assert codes(c.ring_orientation(bad)) == ["INCORRECT_RING_ORIENTATION"] * 2
    assert c.ring_orientation(repairs.orient_rings(bad)[0]) == []
    assert codes(c.ring_orientation(polygon([[0, 0], [1, 1], [2, 2], [0, 0]]))) == ["INDETERMINATE_RING_ORIENTATION"]


def test_holes():
    hole = lambda x, y, w: box(x, y, w, w)[::-1]
    found = c.invalid_holes(polygon(box(0, 0, 1, 1), hole(2, 2, 0.1), hole(0, 0.2, 0.1), hole(0.4, 0.4, 0.4), hole(0.5, 0.5, 0.1), hole(0.1, 0.8, 1e-8)), 1.0)
    assert sorted(codes(found)) == ["HOLE_OUTSIDE_POLYGON", "HOLE_TOUCHING_BOUNDARY", "NESTED_HOLE", "TINY_HOLE"]
    twin = hole(0.2, 0.2, 0.1)
    assert codes(c.invalid_holes(polygon(box(0, 0, 1, 1), twin, twin[1:] + [twin[1]]), 0)) == ["DUPLICATE_HOLE"]
    assert codes(c.invalid_holes(polygon(box(0, 0, 1, 1), hole(-1, -1, 5)), 0)) == ["HOLE_OUTSIDE_POLYGON", "HOLE_LARGER_THAN_POLYGON"]
    kept, n = repairs.drop_holes(polygon(box(0, 0, 1, 1), hole(2, 2, 0.1), box(0.2, 0.2, 0.1, 0.1)), 0)
    assert n == 1 and c.ring_orientation(kept) == [] and len(kept["coordinates"]) == 2


def test_spikes():
    ring = [[0, 0], [0.001, 0], [0.001, 0.001], [0.0005, 0.001], [0.00049999, 0.003], [0.00049998, 0.001], [0, 0.001], [0, 0]]
    found = c.spikes(polygon(ring), 0.025)
    assert [(f["coordinate_path"], f["repairable"]) for f in found] == [([0, 4], True)]
    fixed, failed = repairs.repair_spikes(polygon(ring), found)
    assert not failed and [0.00049999, 0.003] not in fixed["coordinates"][0] and not c.spikes(fixed, 0.025)
    assert not c.spikes(polygon(box(0, 0, 1, 1)), 0.025)


def test_quarantine_stops_later_checks():
    found, flags = c.check_feature(feature(polygon(box(51, 35, 0.001, 0.001)[:-1])), O)
    assert {k for k, _ in found} == {"invalidRings", "ringClosure"} and flags == {"structural": False, "polygon_unsafe": True, "relation_unsafe": True}
    assert c.check_feature(feature(None), O)[0] == []


def test_paths():
    g = {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [0, 0]}, {"type": "GeometryCollection", "geometries": [polygon(box(0, 0, 1, 1))]}]}
    assert [(gc, path) for gc, _, path, _ in d.rings(g)] == [((1, 0), (0,))]
    new = d.updated(g, (1, 0), (0, 1), [9, 9])
    assert d.at_address(new, (1, 0), (0, 1)) == [9, 9] and d.at_address(g, (1, 0), (0, 1)) == [1, 0] and d.at_address(g, (5,), ()) is None


def test_options():
    assert O.area_m2 == pytest.approx(0.0625) and O.gap_m == pytest.approx(0.075)
    for bad in (0, -1, float("nan"), 1e6):
        with pytest.raises(ValueError):
            Options(bad)


LINE = lambda *p: {"type": "LineString", "coordinates": [list(x) for x in p]}
SCENE = [
    feature(polygon(box(51, 35, 0.001, 0.001)), id=1),  # 4.6 cm gap to the next
    feature(polygon(box(51.0010005, 35, 0.001, 0.001)), id=2),
    feature(polygon(box(51.1, 35, 0.001, 0.001)), id=3),  # half over the next
    feature(polygon(box(51.1005, 35, 0.001, 0.001)), id=4),
    feature(LINE((51.2, 35), (51.21, 35)), id=5),  # misses the next line by 1.2 cm
    feature(LINE((51.21000005, 35.01), (51.21000005, 35.0000001)), id=6),
    feature(polygon(box(51.3, 35, 0.001, 0.001)), id=7),
    feature(LINE((51.2995, 35.0005), (51.29995, 35.0005)), id=8),  # 4.6 m before the parcel
    feature(LINE((51.3005, 35.0015), (51.3005, 35.0009)), id=9),  # 11 m into the parcel
    feature(polygon([[51.4, 35], [51.401, 35], [51.401, 35.0005], [51.401, 35.001], [51.4, 35.001], [51.4, 35]]), id=10),
    feature(polygon(box(51.401, 35, 0.001, 0.001)), id=11),  # lacks the neighbour's vertex
    feature(polygon(box(51.5, 35, 0.001, 0.000002)), id="s"),  # a sliver on the next one's south side
    feature(polygon(box(51.5, 35.000002, 0.001, 0.001)), id=12),
    feature({"type": "Point", "coordinates": [0, "x"]}, id=13),
    feature(polygon(box(51, 35, 0.001, 0.001)), id=1, cadLayer="other"),  # another layer: meets none
]


@pytest.fixture(scope="module")
def scene(spark):
    return dry_run(table(spark, SCENE), O)


def test_dry_run_finds_each_relation(scene):
    got = {(r.check, r.feature_index, r.related_feature_index): r for r in scene.issues.collect() if r.check != "coordinatePrecision"}
    want = {("undershoots", 4, 5), ("undershoots", 7, 6), ("overshoots", 8, 6), ("slivers", 11, 12), ("overlaps", 2, 3), ("gaps", 0, 1), ("neighborConsistency", 9, 10), ("geometryDimensions", 13, None)}
    assert set(got) == want
    assert all(r.disposition == AUTO for k, r in got.items() if k[0] != "geometryDimensions")
    gap = json.loads(got["gaps", 0, 1].details)
    assert 0.04 < gap["distanceMeters"] < 0.05 and gap["detectionMode"] == "Tolerance"
    assert 4 < json.loads(got["undershoots", 7, 6].details)["distanceMeters"] < 5
    assert json.loads(got["undershoots", 7, 6].details)["detectionMode"] == "DirectionalBoundaryPattern"


def test_report(scene):
    issues = scene.issues.orderBy("issue_index").collect()
    assert [r.issue_index for r in issues] == list(range(len(issues)))
    order = [c.CHECKS.index(r.check) for r in issues]
    assert order == sorted(order)
    groups = {r.code: r for r in issue_groups(scene.issues).collect()}
    assert groups["POLYGON_GAP"].affected_feature_count == 2
    assert {r.feature_index for r in group_members(scene.issues).where("code = 'POLYGON_GAP'").collect()} == {0, 1}
    reports = {r.check: r for r in check_reports(scene).collect()}
    assert len(reports) == 19 and reports["gaps"].issues == 1 and not reports["gaps"].valid and reports["spikes"].valid
    assert {r.n for r in code_counts(scene.issues).where("code = 'POLYGON_GAP'").collect()} == {1}
    assert {r.feature_index for r in unresolved_features(scene.issues).where("check = 'overlaps'").collect()} == {2}
    one = summary(scene).first()
    assert one.checks == 19 and one.features == len(SCENE) and one.issues == len(issues) and not one.valid


def test_clean_data_has_no_issues(spark):
    run = dry_run(table(spark, [feature(polygon(box(51, 35, 0.5, 0.5))), feature(polygon(box(51.5, 35, 0.5, 0.5)))]), O)
    assert run.issues.count() == 0 and summary(run).first().valid


def test_heal(spark):
    out = heal(table(spark, SCENE), O, withhold_reviewed=False)
    counts = {r.counter: r.n for r in out.counts.collect()}
    assert counts["gapsClosed"] == 1 and counts["overlapsHealed"] == 1 and counts["sliversRemovedCount"] == 1 and counts["neighborVerticesInserted"] == 1 and counts["lineEndsRepaired"] == 3
    rows = {r.source_index: json.loads(r.feature) for r in out.features.collect()}
    assert 11 not in rows and rows[13] == SCENE[13]
    assert rows[0]["geometry"]["coordinates"][0][1][0] == rows[1]["geometry"]["coordinates"][0][0][0]
    assert [51.401, 35.0005] in rows[10]["geometry"]["coordinates"][0]
    again = dry_run(spark.createDataFrame([(i, json.dumps(f)) for i, f in rows.items()], "feature_index long, feature string"), O)
    left = {(r.check, r.feature_index) for r in again.issues.collect()}
    assert not {k for k in left if k[0] in ("undershoots", "overshoots", "slivers", "overlaps", "neighborConsistency") or k == ("gaps", 0)}
    edits = spark.createDataFrame([(6, json.dumps(polygon(box(1, 1, 1, 1))))], "source_index long, geometry string")
    assert json.loads(reviewed(out.features, edits).where("source_index = 6").first().feature)["geometry"]["coordinates"] == [box(1, 1, 1, 1)]


def test_heal_feature_quarantines_what_it_cannot_repair():
    assert heal_feature(feature(polygon([[0, 0], [1, 0], [2, 0], [0, 0]])), O)[1] == "zeroAreaPolygons"
    assert heal_feature(feature({"type": "Nope"}), O)[1] == "geometryTypes"
    fixed, why, n = heal_feature(feature(polygon(box(51, 35, 0.001, 0.001)[:-1][::-1])), O)
    assert why is None and n["ringsAutoClosed"] == 1 and n["ringOrientationsNormalized"] == 1 and c.check_feature(fixed, O)[0] == []


def test_withheld_parcels_lose_overlaps_only_and_come_last(spark):
    """A thin parcel needs a review, so its group is withheld; it overlaps a sound one. A confirmed parcel keeps all of its area."""
    micro = lambda x, y, w, h: box(51 + x / 1e6, 35 + y / 1e6, w / 1e6, h / 1e6)
    line = feature({"type": "LineString", "coordinates": [[52.0, 36.0], [52.0012345678912, 36.0]]})
    features = [feature(polygon(micro(0, 0, 1003, 1000))), feature(polygon(micro(1000, 0, 30, 1000))), line, feature(polygon(micro(9000, 0, 1003, 1000))), feature(polygon(micro(10000, 0, 500, 1000)))]
    out = heal(table(spark, features), O, confirmed=spark.createDataFrame([(4,)], "feature_index long"))
    rows = [(r.source_index, json.loads(r.feature)["geometry"]["coordinates"]) for r in out.features.orderBy("out_index").collect()]
    assert [i for i, _ in rows] == [2, 0, 3, 1, 4]
    x = {i: sorted({round((p[0] - 51) * 1e6) for p in c[0]}) for i, c in rows if i != 2}
    assert x == {0: [0, 1000], 1: [1003, 1030], 3: [9000, 10003], 4: [10000, 10500]}
    assert dict(rows)[2][1] == [52.001234568, 36.0]


def test_many_rings_keep_their_own_targets(spark):
    """A line that ends short of a hole's side far beyond the sixteen-thousandth ring names that ring."""
    n = 140
    holes = [[[51 + i / 1000, 35 + j / 1000], [51 + i / 1000, 35 + (j + 0.4) / 1000], [51 + (i + 0.4) / 1000, 35 + (j + 0.4) / 1000], [51 + (i + 0.4) / 1000, 35 + j / 1000], [51 + i / 1000, 35 + j / 1000]] for i in range(n) for j in range(n)]
    assert len(holes) > 1 << 14
    parts = component_rows = [(0, None, None, 0, [], "Polygon", [], [box(50.9, 34.9, 0.5, 0.5), *holes], 50.9, 34.9, 51.4, 35.4)]
    components = spark.createDataFrame(component_rows, d.COMPONENTS)
    last = holes[-1][0]
    lines = spark.createDataFrame([(1, None, None, d.PARTS, [], "LineString", [], [[last[0] - 0.0001, last[1] + 0.0002], [last[0] - 1e-7, last[1] + 0.0002]])], d.LINES)
    _, under = pair_checks.line_ends(lines, components, O)
    assert [(r.target_part, r.target_ring) for r in under.collect()] == [(0, len(holes))] and parts
    with pytest.raises(ValueError):
        d._number(1, d.PARTS)


def test_slivers_are_found_without_the_checks_that_have_no_say(monkeypatch):
    thin, wide = feature(polygon(box(51, 35, 0.000002, 0.001))), feature(polygon(box(51, 35, 0.001, 0.001)))
    odd = [feature(None), {"type": "Feature"}, feature(polygon(box(51, 35, 0.001, 0.001)[:2])), feature({"type": "Point", "coordinates": [51, 35]})]
    want = [[x for x in c.check_feature(f, O)[0] if x[0] == "slivers"] for f in [thin, wide, *odd]]

    def fail(*_):
        raise AssertionError("not needed for slivers")

    for name in ("self_intersections", "spikes", "coordinate_precision", "duplicate_vertices", "invalid_holes"):
        monkeypatch.setattr(c, name, fail)
    assert [c.check_slivers(f, O)[0] for f in [thin, wide, *odd]] == want and len(want[0]) == 1 and want[1] == []


def test_line_ends_are_solved_on_plain_rows():
    from parcelyze.operators.pair_checks import _line_end

    row = {"part": 1, "endpoint": "end", "probe": "point", "target_part": 7, "target_ring": 0, "is_line": False, "r_segment": 2, "source_segment": None, "length_m": 40.0, "reach_m": 1.0, "distance_m": O.tolerance_m / 2, "tx": 51.0, "ty": 35.0, "fraction": 0.5}
    line = row | {"is_line": True, "target_part": 9, "target_ring": -1}
    found = _line_end(O)([row, line])
    assert [(f["code"], f["target_part"], f["mode"], f["sure"], f["source_segment"]) for f in found] == [("LINE_UNDERSHOOT", 9, "Tolerance", True, None)]
    assert _line_end(O)([row, row | {"distance_m": 0.0}]) == []
