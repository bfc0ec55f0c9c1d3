"""Polygons of several parts are compared like others."""

import json

from parcelyze.config import Options
from parcelyze.operators import decompose, pair_checks
from parcelyze.plans.heal import heal


def box(x, y, w, h):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]


def feature(*boxes):
    return {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[b] for b in boxes]}}


A, B, C = box(51, 35, 0.001, 0.001), box(51.01, 35, 0.001, 0.002), box(51.02, 35, 0.001, 0.001)
FEATURES = [feature(A, B), feature(A, B), feature(A, [B[2], B[3], B[0], B[1], B[2]]), feature(A, C), feature(A, box(51.01, 35, 0.001, 0.00200005))]


def table(spark, features):
    return spark.createDataFrame([(i, json.dumps(f)) for i, f in enumerate(features)], "feature_index long, feature string")


def test_parts_are_compared_together(spark):
    found = pair_checks.duplicate_polygons(decompose.component_table(table(spark, FEATURES)))
    got = {(r.feature_index, r.r_feature_index): r.kind for r in found.collect()}
    assert got[0, 1] == "Exact" and got[0, 2] == got[1, 2] == "Topological" and got[0, 4] == "Near"
    assert not [k for k in got if 3 in k]


def test_healing_removes_the_copy(spark):
    out = heal(table(spark, FEATURES[:2]), Options(), withhold_reviewed=False)
    assert [r.source_index for r in out.features.collect()] == [0]


def test_numbers_of_copies_may_be_those_of_parcels(spark, tmp_path):
    import duckdb
    from parcelyze.plans import catalogue

    parts = [*range(100), *range(1000000, 1000100)]
    spark.createDataFrame([(i,) for i in parts], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(con.sql(catalogue.SQL["duplicate_polygons"]).fetchall())
    assert len(want) > 6 and sorted(map(tuple, catalogue.duplicate_polygons(spark, str(tmp_path)).collect())) == want
