"""All queries of the engine by name, with SQL that gives the same rows.

The lattice of ``lattice.py`` stands for a parcel dataset, ``events`` for upload activity and job events, ``documents`` and
``orders`` for files and articles, ``customer`` for users.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Callable
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Options
from ..functions import geometry as g
from ..functions import text as t
from ..operators import pair_checks, parcels
from ..operators.components import components as connected
from ..operators.feature_checks import check_features
from ..sources import readers, store, writers
from ..streaming import events as ev
from ..tables import numbered, session_dir, written
from . import lattice, planted, reports
from .dry_run import AUTO, MANUAL, DryRun, check_reports, compact, dry_run, issue_groups, summary
from .heal import Healed, heal, heal_features
from .lattice import PARCELS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str | None] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue groups of a dry run over the lattice."""
    run = dry_run(lattice.features_json(spark, sf_dir), Options())
    return issue_groups(run.issues).select("check", "code", "issue_count", "affected_feature_count", "disposition")


_P = "WITH " + PARCELS_SQL
_R = "6371008.8"
_AREA = f"({_R} * {_R} * abs(radians(x1 / 1e6) - radians(x0 / 1e6)) * abs(sin(radians(y1 / 1e6)) - sin(radians(y0 / 1e6))))"


def _hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    lon1, lat1, lon2, lat2 = (f"({x})" for x in (lon1, lat1, lon2, lat2))
    return f"(2 * {_R} * asin(least(1.0, sqrt(power(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2)))))"


_PERIMETER = f"(2 * {_hav('0.0', 'y0 / 1e6', '0.0', 'y1 / 1e6')} + {_hav('x0 / 1e6', 'y0 / 1e6', 'x1 / 1e6', 'y0 / 1e6')} + {_hav('x0 / 1e6', 'y1 / 1e6', 'x1 / 1e6', 'y1 / 1e6')})"


_COARSE = Options(tolerance_mm=1000)
#: Line items as the vertices of their order's sequence; line numbers repeat.
_POSITION = "(l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey % 1000)"


# ---- scalar geometry --------------------------------------------------------------------------------------------


@query(_P + f" SELECT parcel_id AS feature_index, round({_AREA}, 3) AS area_m2 FROM parcels")
def parcel_area(spark, sf_dir):
    return lattice.features(spark, sf_dir).select("feature_index", F.round("area_m2", 3).alias("area_m2"))


@query(_P + f" SELECT parcel_id AS feature_index, round({_PERIMETER}, 3) AS perimeter_m, round(4 * pi() * {_AREA} / power({_PERIMETER}, 2), 6) AS compactness FROM parcels")
def parcel_perimeter_compactness(spark, sf_dir):
    around = g.perimeter(F.col("rings"))
    return lattice.features(spark, sf_dir).select("feature_index", F.round(around, 3).alias("perimeter_m"), F.round(g.compactness(F.col("area_m2"), around), 6).alias("compactness"))


@query(f"SELECT c_custkey, round({_hav('51.0 + (c_custkey % 100) * 0.01', '35.0 + (c_custkey % 77) * 0.01', '51.0 + n_nationkey * 0.03', '35.0 + n_regionkey * 0.05')}, 3) AS distance_m FROM customer JOIN nation ON c_nationkey = n_nationkey")
def haversine_distance(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    here = g.haversine(51.0 + (F.col("c_custkey") % 100) * 0.01, 35.0 + (F.col("c_custkey") % 77) * 0.01, 51.0 + F.col("n_nationkey") * 0.03, 35.0 + F.col("n_regionkey") * 0.05)
    return c.select("c_custkey", F.round(here, 3).alias("distance_m"))


@query(
    _P
    + """ SELECT parcel_id AS feature_index, round(x0 / 1e6 - 5.0 / (111320.0 * greatest(0.01, cos(radians(y1 / 1e6)))), 9) AS minx, round(y0 / 1e6 - 5.0 / 110574.0, 9) AS miny,
  round(x1 / 1e6 + 5.0 / (111320.0 * greatest(0.01, cos(radians(y1 / 1e6)))), 9) AS maxx, round(y1 / 1e6 + 5.0 / 110574.0, 9) AS maxy FROM parcels"""
)
def expand_bounds(spark, sf_dir):
    f = lattice.features(spark, sf_dir)
    wide = g.expand(*map(F.col, ("minx", "miny", "maxx", "maxy")), F.lit(5.0))
    return f.select("feature_index", *[F.round(c, 9).alias(n) for c, n in zip(wide, ("minx", "miny", "maxx", "maxy"))])


# ---- checks of single features: all go through the pass that the dry run takes ----------------------------------------


def _own_findings(spark, sf_dir, features: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    found = check_features(lattice.features_json(spark, sf_dir) if features is None else features, options)
    return found.select(F.inline("findings"))


def _planted_check(check: str) -> None:
    """Registers a query for the findings of one check over features with planted defects."""

    def run(spark, sf_dir):
        f = _own_findings(spark, sf_dir, planted.features(spark, sf_dir)).where(F.col("check") == check)
        disposition = F.when(F.col("repairable") & F.col("failure").isNull(), AUTO).otherwise(MANUAL)
        return f.select("feature_index", "code", F.array_join("coordinate_path", ",").alias("path"), disposition.alias("disposition"))

    name = "check_" + "".join("_" + c.lower() if c.isupper() else c for c in check)
    run.__name__ = name
    run.__doc__ = f"Findings of {check} over features with planted defects."
    QUERIES[name], SQL[name] = run, planted.expected_sql(check)


for _check in (
    "geometryTypes", "geometryDimensions", "multipartIntegrity", "coordinatePrecision", "invalidRings", "ringClosure", "duplicateVertices", "selfIntersections", "ringOrientation", "invalidHoles", "spikes",
    "zeroAreaPolygons", "tinyPolygons", "slivers",
):
    _planted_check(_check)


@query(_P + f" SELECT parcel_id AS feature_index, round({_AREA}, 3) AS area_m2, 100.0 AS threshold_m2 FROM parcels WHERE y1 > y0 AND {_AREA} < 100".replace("100.0 AS", "CAST(100 AS DOUBLE) AS"))
def tiny_polygons(spark, sf_dir):
    f = _own_findings(spark, sf_dir, options=_COARSE).where("code = 'TINY_POLYGON'").withColumn("d", F.from_json("details", "areaM2 double, thresholdM2 double"))
    return f.select("feature_index", F.round("d.areaM2", 3).alias("area_m2"), F.col("d.thresholdM2").alias("threshold_m2"))


@query(
    _P
    + f""", m AS (SELECT parcel_id, {_AREA} AS a, {_PERIMETER} AS p FROM parcels WHERE y1 > y0)
SELECT parcel_id AS feature_index, round(a, 3) AS area_m2, round(p, 3) AS perimeter_m, round(4 * pi() * a / (p * p), 6) AS compactness,
  CASE WHEN a < 100 AND 4 * pi() * a / (p * p) < 0.1 THEN 'Area,Compactness' WHEN a < 100 THEN 'Area' ELSE 'Compactness' END AS reasons FROM m WHERE a < 100 OR 4 * pi() * a / (p * p) < 0.1"""
)
def sliver_detection(spark, sf_dir):
    f = _own_findings(spark, sf_dir, options=_COARSE).where("code = 'SLIVER_POLYGON'").withColumn("d", F.from_json("details", "areaM2 double, perimeterMeters double, compactness double, detectionReasons array<string>"))
    return f.select("feature_index", F.round("d.areaM2", 3).alias("area_m2"), F.round("d.perimeterMeters", 3).alias("perimeter_m"), F.round("d.compactness", 6).alias("compactness"), F.array_join("d.detectionReasons", ",").alias("reasons"))


@query(
    f"""SELECT p_partkey AS feature_index, k IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11) AS structural, k IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 15, 16) AS polygon_unsafe,
  k IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 15, 16, 18, 20, 21, 22, 23, 24, 25, 26, 27, 30) AS relation_unsafe FROM (SELECT p_partkey, p_partkey % {len(planted.KINDS)} AS k FROM part)"""
)
def quarantine_view(spark, sf_dir):
    """Which features stay out of which of the later checks."""
    return check_features(planted.features(spark, sf_dir), Options()).drop("findings")


# ---- checks between features --------------------------------------------------------------------------------------


def _components(spark, sf_dir) -> DataFrame:
    """The lattice's sound parcels as a component table."""
    f = lattice.features(spark, sf_dir).where("area_m2 > 0")
    none = F.array().cast("array<int>")
    f = f.select("feature_index", F.col("feature_index").cast("string").alias("feature_id"), "layer", F.col("feature_index").alias("component"), none.alias("gc_path"), F.lit("Polygon").alias("geometry_type"), none.alias("polygon_path"), "rings", "minx", "miny", "maxx", "maxy")
    return written(f, "components")


_BOTH = "p.layer IS NOT DISTINCT FROM q.layer AND p.y1 > p.y0 AND q.y1 > q.y0"
_SHARED = "least(p.x1, q.x1) - greatest(p.x0, q.x0)"


@query(
    _P
    + f""" SELECT p.parcel_id AS feature_index, q.parcel_id AS related_feature_index,
  round({_R} * {_R} * (radians(least(p.x1, q.x1) / 1e6) - radians(greatest(p.x0, q.x0) / 1e6)) * (sin(radians(p.y1 / 1e6)) - sin(radians(p.y0 / 1e6))), 2) AS overlap_m2
  FROM parcels p JOIN parcels q ON p.r = q.r AND p.parcel_id < q.parcel_id AND {_BOTH} AND {_SHARED} > 0"""
)
def polygon_overlaps(spark, sf_dir):
    o = pair_checks.overlaps(_components(spark, sf_dir))
    return o.select("feature_index", F.col("r_feature_index").alias("related_feature_index"), F.round("overlap_m2", 2).alias("overlap_m2"))


@query(
    _P
    + f""" SELECT p.parcel_id AS feature_index, q.parcel_id AS related_feature_index, round({_hav("p.x1 / 1e6", "(p.y0 + 500) / 1e6", "q.x0 / 1e6", "(q.y0 + 500) / 1e6")}, 3) AS distance_m,
  'SharedBoundaryPattern' AS detection_mode FROM parcels p JOIN parcels q ON q.parcel_id = p.parcel_id + 1 AND q.r = p.r AND {_BOTH} AND q.x0 - p.x1 = 2"""
)
def polygon_gaps(spark, sf_dir):
    found = pair_checks.gaps(_components(spark, sf_dir), Options())
    return found.select("feature_index", F.col("r_feature_index").alias("related_feature_index"), F.round("distance_m", 3).alias("distance_m"), F.col("mode").alias("detection_mode"))


@query(
    _P
    + f""" SELECT p.parcel_id AS feature_index, 2 AS vertex, q.parcel_id AS related_feature_index, 0.5 AS fraction, true AS repairable
  FROM parcels p JOIN parcels q ON q.parcel_id = p.parcel_id + 1 AND q.r = p.r AND {_BOTH} AND q.x0 = p.x1 WHERE p.parcel_id % 5 = 0""".replace("0.5 AS", "CAST(0.5 AS DOUBLE) AS")
)
def neighbor_vertices(spark, sf_dir):
    """A vertex in the middle of the east side of every fifth parcel, whose neighbour lacks it."""
    c = _components(spark, sf_dir)
    ring = F.get("rings", F.lit(0))
    ring = F.when(g.orientation(ring) == "cw", F.reverse(ring)).otherwise(ring)
    middle = F.array(F.col("maxx"), (F.col("miny") + F.col("maxy")) / 2)
    c = c.withColumn("rings", F.array(F.when(F.col("feature_index") % 5 == 0, F.concat(F.slice(ring, 1, 2), F.array(middle), F.slice(ring, 3, 10))).otherwise(ring)))
    v = pair_checks.neighbour_vertices(written(c, "components"))
    return v.select("feature_index", "vertex", F.col("r_feature_index").alias("related_feature_index"), F.round("fraction", 6).alias("fraction"), "repairable")


@query(_P + " SELECT parcel_id AS feature_index, parcel_id + 1000000 AS related_feature_index, CASE parcel_id % 3 WHEN 0 THEN 'Topological' WHEN 1 THEN 'Exact' ELSE 'Near' END AS kind FROM parcels WHERE parcel_id % 19 = 0 AND y1 > y0 AND parcel_id % 13 <> 0")
def duplicate_polygons(spark, sf_dir):
    """Copies of every nineteenth parcel: the same, with another first vertex, or with a corner moved by a nanodegree and a half."""
    c = _components(spark, sf_dir)
    ring = F.get("rings", F.lit(0))
    turned = F.concat(F.slice(ring, 2, 10), F.slice(ring, 2, 1))
    moved = F.transform(ring, lambda p, i: F.when(i == 2, F.array(F.get(p, F.lit(0)) + 1.5e-9, F.get(p, F.lit(1)))).otherwise(p))
    copy = F.when(F.col("feature_index") % 3 == 0, F.array(turned)).when(F.col("feature_index") % 3 == 1, F.col("rings")).otherwise(F.array(moved))
    copies = c.where("feature_index % 19 = 0 and feature_index % 13 <> 0").withColumn("rings", copy)
    # Numbers of copies may be those of other parcels: parcels take the even ones here and copies the odd ones, in the order of the results' numbers.
    own = c.withColumn("feature_index", 2 * F.col("feature_index")).withColumn("component", 2 * F.col("component"))
    copies = copies.withColumn("feature_index", 2 * (F.col("feature_index") + 1000000) + 1).withColumn("component", 2 * (F.col("component") + 1000000) + 1)
    number = lambda c: F.shiftright(F.col(c), 1)
    return pair_checks.duplicate_polygons(own.unionByName(copies)).select(number("feature_index").alias("feature_index"), number("r_feature_index").alias("related_feature_index"), "kind")


@query(
    _P
    + f""", m AS (SELECT p.parcel_id AS component, q.parcel_id AS target, {_PERIMETER.replace("x0", "p.x0").replace("x1", "p.x1").replace("y0", "p.y0").replace("y1", "p.y1")} AS around,
  {_R} * radians((p.y1 - p.y0) / 1e6) AS shared FROM parcels p JOIN parcels q ON q.parcel_id = p.parcel_id - 1 AND q.r = p.r AND {_BOTH} AND q.x1 = p.x0 WHERE p.parcel_id % 13 = 0)
SELECT component, target, round(shared, 3) AS shared_m, round(shared / around, 6) AS shared_ratio, true AS absorb FROM m"""
)
def sliver_adjacency(spark, sf_dir):
    c = _components(spark, sf_dir)
    f = _own_findings(spark, sf_dir).where("code = 'SLIVER_POLYGON'").withColumn("d", F.from_json("details", "areaM2 double, perimeterMeters double"))
    s = f.select(F.col("feature_index").alias("component"), "feature_index", F.col("d.areaM2").alias("area_m2"), F.col("d.perimeterMeters").alias("perimeter_m"))
    return pair_checks.sliver_neighbours(s, c).select("component", "target", F.round("shared_m", 3).alias("shared_m"), F.round("shared_ratio", 6).alias("shared_ratio"), "absorb")


def _lines(spark, sf_dir) -> DataFrame:
    """A line in every seventh parcel, eastwards, that ends 0 to 4 micro-degrees before, on or beyond the east side."""
    p = lattice.parcels(spark, sf_dir).where("parcel_id % 7 = 3 and y1 > y0 and x1 - x0 > 10")
    y = (F.col("y0") + 500) / 1e6
    end = (F.col("x1") + F.col("parcel_id") % 9 - 4) / 1e6
    none = F.array().cast("array<int>")
    line = F.array(F.array((F.col("x0") + 400) / 1e6, y), F.array(end, y))
    return p.select((F.col("parcel_id") + 2000000).alias("feature_index"), F.lit(None).cast("string").alias("feature_id"), "layer", (F.col("parcel_id") + 2000000).alias("part"), none.alias("gc_path"), F.lit("LineString").alias("geometry_type"), none.alias("root_path"), line.alias("line"))


_LINES = f""", k AS (SELECT parcel_id + 2000000 AS part, layer, r, x0 + 400 AS a, x1 + parcel_id % 9 - 4 AS e, x1, y0 + 500 AS y FROM parcels WHERE parcel_id % 7 = 3 AND y1 > y0 AND x1 - x0 > 10),
b AS (SELECT parcel_id, layer, r, x0 AS x FROM parcels WHERE y1 > y0 UNION SELECT parcel_id, layer, r, x1 FROM parcels WHERE y1 > y0),
over AS (SELECT k.part, max(b.x) AS x FROM k JOIN b ON b.r = k.r AND b.x < k.e AND b.x > k.a AND k.e - b.x <= 200 AND {_hav("b.x / 1e6", "y / 1e6", "e / 1e6", "y / 1e6")} <= greatest(0.025, least(100, 0.25 * {_hav("a / 1e6", "y / 1e6", "e / 1e6", "y / 1e6")})) GROUP BY k.part)"""


@query(_P + _LINES + f" SELECT part, 'end' AS endpoint, round({_hav('x / 1e6', 'y / 1e6', 'e / 1e6', 'y / 1e6')}, 4) AS overrun_m FROM over JOIN k USING (part)")
def overshoots(spark, sf_dir):
    over, _ = pair_checks.line_ends(_lines(spark, sf_dir), _components(spark, sf_dir), Options())
    return over.select("part", "endpoint", F.round("distance_m", 4).alias("overrun_m"))


@query(
    _P
    + _LINES
    + f""", under AS (SELECT k.part, min(b.x) AS x FROM k JOIN b ON b.r = k.r AND b.x >= k.e AND {_hav("b.x / 1e6", "y / 1e6", "e / 1e6", "y / 1e6")} <= greatest(0.025, least(100, 0.25 * {_hav("a / 1e6", "y / 1e6", "e / 1e6", "y / 1e6")}))
  WHERE k.part NOT IN (SELECT part FROM over) GROUP BY k.part)
SELECT part, 'end' AS endpoint, round({_hav("x / 1e6", "y / 1e6", "e / 1e6", "y / 1e6")}, 4) AS distance_m, 'DirectionalBoundaryPattern' AS mode, true AS repairable FROM under JOIN k USING (part) WHERE x > e"""
)
def undershoots(spark, sf_dir):
    _, under = pair_checks.line_ends(_lines(spark, sf_dir), _components(spark, sf_dir), Options())
    return under.select("part", "endpoint", F.round("distance_m", 4).alias("distance_m"), "mode", "repairable")


@query(
    _P
    + f""", RECURSIVE_EDGES AS (SELECT p.parcel_id AS u, q.parcel_id AS v FROM parcels p JOIN parcels q ON p.r = q.r AND p.parcel_id < q.parcel_id AND {_BOTH} AND {_SHARED} > 0),
both_ways AS (SELECT u, v FROM RECURSIVE_EDGES UNION SELECT v, u FROM RECURSIVE_EDGES),
reach(node, other) AS (SELECT u, u FROM both_ways UNION SELECT reach.node, both_ways.v FROM reach JOIN both_ways ON both_ways.u = reach.other)
SELECT node AS feature_index, min(other) AS component FROM reach GROUP BY node""".replace("RECURSIVE_EDGES", "e")
)
def overlap_components(spark, sf_dir):
    o = pair_checks.overlaps(_components(spark, sf_dir)).select(F.col("feature_index").alias("u"), F.col("r_feature_index").alias("v"))
    return connected(o).select(F.col("node").alias("feature_index"), F.col("root").alias("component"))


SQL["overlap_components"] = SQL["overlap_components"].replace("WITH ", "WITH RECURSIVE ", 1)


# ---- dry run ------------------------------------------------------------------------------------------------------

_THIN = f"4 * pi() * {_AREA} / power({_PERIMETER}, 2) < 0.1 OR {_AREA} < 0.0625"
#: All issues of a dry run over the lattice, in report order: k is the check's place, o the order within a feature.
_ISSUES = (
    _P
    + f""", thin AS (SELECT * FROM parcels WHERE y1 > y0 AND ({_THIN})),
absorbed AS (SELECT t.parcel_id, q.parcel_id AS target FROM thin t JOIN parcels q ON q.parcel_id = t.parcel_id - 1 AND q.r = t.r AND q.y1 > q.y0 AND q.x1 = t.x0),
found AS (
  SELECT 5 AS k, 'invalidRings' AS "check", 'INSUFFICIENT_RING_VERTICES' AS code, parcel_id AS f, CAST(NULL AS BIGINT) AS rf, false AS auto, 0 AS o FROM parcels WHERE y0 = y1
  UNION ALL SELECT 7, 'duplicateVertices', 'DUPLICATE_VERTEX', parcel_id, NULL, false, o FROM parcels, (VALUES (0), (1)) v(o) WHERE y0 = y1
  UNION ALL SELECT 11, 'ringOrientation', 'INCORRECT_RING_ORIENTATION', parcel_id, NULL, true, 0 FROM parcels WHERE y1 > y0 AND winding = 'cw'
  UNION ALL SELECT 16, 'slivers', 'SLIVER_POLYGON', thin.parcel_id, target, target IS NOT NULL, 0 FROM thin LEFT JOIN absorbed USING (parcel_id)
  UNION ALL SELECT 17, 'overlaps', 'POLYGON_OVERLAP', p.parcel_id, q.parcel_id, true, q.parcel_id FROM parcels p JOIN parcels q ON p.r = q.r AND p.parcel_id < q.parcel_id AND {_BOTH} AND {_SHARED} > 0
  UNION ALL SELECT 18, 'gaps', 'POLYGON_GAP', p.parcel_id, q.parcel_id, true, q.parcel_id FROM parcels p JOIN parcels q ON q.parcel_id = p.parcel_id + 1 AND q.r = p.r AND {_BOTH} AND q.x0 - p.x1 = 2),
issues AS (SELECT row_number() OVER (ORDER BY k, f, o) - 1 AS issue_index, "check", code, f, rf, CASE WHEN auto THEN 'AutoRepairAvailable' ELSE 'ManualReview' END AS disposition FROM found),
members AS (SELECT DISTINCT "check", code, m FROM (SELECT "check", code, f AS m FROM issues UNION ALL SELECT "check", code, rf FROM issues) WHERE m IS NOT NULL)
"""
)


#: The written reports of a session: what a job has found is read again, not found again, by the queries around it.
_kept: dict[tuple[str, str, str], DryRun | Healed] = {}


def _lattice_run(spark, sf_dir, again: bool = False) -> DryRun:
    key = ("dry run", spark.sparkContext.applicationId, sf_dir)
    if again or key not in _kept:
        _kept[key] = dry_run(lattice.features_json(spark, sf_dir), Options())
    return _kept[key]


def _lattice_healed(spark, sf_dir, again: bool = False) -> Healed:
    key = ("healed", spark.sparkContext.applicationId, sf_dir)
    if again or key not in _kept:
        report = _lattice_run(spark, sf_dir, again=True)  # made anew, and kept: the queries around it need not make it again
        _kept[key] = heal(lattice.features_json(spark, sf_dir), Options(), report=report)
    return _kept[key]


@query(
    _ISSUES
    + """SELECT "check", code, count(*) AS issue_count, (SELECT count(*) FROM members m WHERE m."check" = i."check" AND m.code = i.code) AS affected_feature_count,
  CASE WHEN min(disposition) = max(disposition) THEN min(disposition) ELSE 'Mixed' END AS disposition, min(issue_index) AS first_issue FROM issues i GROUP BY "check", code"""
)
def issue_group_report(spark, sf_dir):
    run = _lattice_run(spark, sf_dir, again=True)
    return issue_groups(run.issues).select("check", "code", "issue_count", "affected_feature_count", "disposition", "first_issue")


@query(
    _ISSUES
    + """SELECT count(*) AS issues, count(*) FILTER (WHERE disposition = 'AutoRepairAvailable') AS auto_repairable, count(*) FILTER (WHERE disposition = 'ManualReview') AS manual_review,
  count(DISTINCT code) AS groups, count(DISTINCT "check") AS failed_checks, (SELECT count(DISTINCT m) FROM members) AS affected_features, (SELECT count(*) FROM parcels) AS features, 19 AS checks, false AS valid FROM issues"""
)
def report_summary(spark, sf_dir):
    return summary(_lattice_run(spark, sf_dir))


@query(
    _ISSUES
    + """, c AS (SELECT unnest(['geometryTypes', 'geometryDimensions', 'multipartIntegrity', 'coordinatePrecision', 'invalidRings', 'ringClosure', 'duplicateVertices', 'undershoots', 'overshoots', 'selfIntersections',
  'ringOrientation', 'invalidHoles', 'spikes', 'zeroAreaPolygons', 'tinyPolygons', 'slivers', 'overlaps', 'gaps', 'neighborConsistency']) AS "check")
SELECT c."check", count(f) AS issues, count(DISTINCT f) AS features, count(f) FILTER (WHERE disposition = 'AutoRepairAvailable') AS auto_repairable, count(f) = 0 AS valid FROM c LEFT JOIN issues ON issues."check" = c."check" GROUP BY c."check" """
)
def per_check_reports(spark, sf_dir):
    return check_reports(_lattice_run(spark, sf_dir)).select("check", "issues", "features", "auto_repairable", "valid")


@query(_ISSUES + """SELECT issue_index, "check", code, f AS feature_index, rf AS related_feature_index, disposition, '{}' AS details FROM issues WHERE disposition = 'ManualReview'""")
def compact_report(spark, sf_dir):
    return compact(_lattice_run(spark, sf_dir).issues).select("issue_index", "check", "code", "feature_index", "related_feature_index", "disposition", "details")


@query(
    _ISSUES
    + f""", page AS (SELECT issue_index, code, f FROM issues WHERE code = 'SLIVER_POLYGON' ORDER BY issue_index LIMIT 10 OFFSET 5)
SELECT issue_index, code, f AS feature_index, round({_AREA}, 3) AS area_m2, round({_PERIMETER}, 3) AS perimeter_m FROM page JOIN parcels ON parcel_id = f"""
)
def issue_details_page(spark, sf_dir):
    page = reports.issue_page(_lattice_run(spark, sf_dir).issues, "SLIVER_POLYGON", 5, 10).withColumn("d", F.from_json("details", "areaM2 double, perimeterMeters double"))
    return page.select("issue_index", "code", "feature_index", F.round("d.areaM2", 3).alias("area_m2"), F.round("d.perimeterMeters", 3).alias("perimeter_m"))


# ---- repair, files ---------------------------------------------------------------------------------------------------


def _measures(features: DataFrame, *keys: str) -> DataFrame:
    """keys, type, the box in micro-degrees and the number of positions of healed features."""
    shape = F.from_json("feature", "geometry struct<type: string, coordinates: string>")["geometry"]
    numbers = F.transform(F.regexp_extract_all(shape["coordinates"], F.lit(r"-?[0-9]+\.?[0-9]*(?:[eE]-?[0-9]+)?"), F.lit(0)), lambda v: v.cast("double"))
    f = features.select(*keys, shape["type"].alias("type"), numbers.alias("v"))
    of = lambda odd: F.filter("v", lambda x, i: i % 2 == odd)
    micro = lambda c: F.round(c * 1000000).cast("long")
    f = f.withColumn("x", of(0)).withColumn("y", of(1))
    return f.select(*keys, "type", micro(F.array_min("x")).alias("minx"), micro(F.array_min("y")).alias("miny"), micro(F.array_max("x")).alias("maxx"), micro(F.array_max("y")).alias("maxy"), F.size("x").alias("positions"))


#: The lattice after healing: review groups (slivers and what would absorb them) are withheld from all but subtraction.
_HEALED = (
    _ISSUES
    + f""", held AS (SELECT DISTINCT m FROM members WHERE code = 'SLIVER_POLYGON'),
closed AS (SELECT p.parcel_id AS a, q.parcel_id AS b FROM parcels p JOIN parcels q ON q.parcel_id = p.parcel_id + 1 AND q.r = p.r AND {_BOTH} AND q.x0 - p.x1 = 2 WHERE p.parcel_id NOT IN (SELECT m FROM held) AND q.parcel_id NOT IN (SELECT m FROM held)),
cut AS (SELECT p.parcel_id AS a, q.parcel_id AS b, greatest(p.x0, q.x0) AS s, least(p.x1, q.x1) AS e, q.x1 <= p.x1 AS swallowed FROM parcels p JOIN parcels q ON p.r = q.r AND p.parcel_id < q.parcel_id AND {_BOTH} AND {_SHARED} > 0),
h AS (
  SELECT p.parcel_id, y0 = y1 OR p.parcel_id IN (SELECT m FROM held) AS behind, coalesce(l.swallowed, false) AS gone, coalesce(r.swallowed, false) AS apart,
    x0 + CASE WHEN gl.b IS NOT NULL THEN -1 WHEN l.b IS NOT NULL THEN l.e - x0 ELSE 0 END AS minx, x1 + CASE WHEN gr.a IS NOT NULL THEN 1 WHEN r.a IS NOT NULL AND NOT r.swallowed THEN r.s - x1 ELSE 0 END AS maxx, y0, y1
  FROM parcels p LEFT JOIN closed gl ON gl.b = p.parcel_id LEFT JOIN closed gr ON gr.a = p.parcel_id LEFT JOIN cut l ON l.b = p.parcel_id LEFT JOIN cut r ON r.a = p.parcel_id)
"""
)


@query(
    _HEALED
    + """SELECT row_number() OVER (ORDER BY behind, parcel_id) - 1 AS out_index, parcel_id AS source_index, CASE WHEN apart THEN 'MultiPolygon' ELSE 'Polygon' END AS type, minx, y0 AS miny, maxx, y1 AS maxy,
  CAST(CASE WHEN apart THEN 10 ELSE 5 END AS INTEGER) AS positions FROM h WHERE NOT gone"""
)
def heal_pipeline(spark, sf_dir):
    return _measures(_lattice_healed(spark, sf_dir, again=True).features, "out_index", "source_index")


@query(
    _HEALED
    + """SELECT * FROM (SELECT 'overlapsHealed' AS counter, count(*) AS n FROM cut UNION ALL SELECT 'gapsClosed', count(*) FROM closed UNION ALL SELECT 'ringOrientationsNormalized', count(*) FROM parcels WHERE y1 > y0 AND winding = 'cw') WHERE n > 0"""
)
def heal_counters(spark, sf_dir):
    return _lattice_healed(spark, sf_dir).counts.where("n > 0")


#: Scenes far from each other, by a part's number: two parcels with a gap; a sliver beside a parcel; parcels that overlap; a vertex
#: that the neighbour lacks; a line that ends short of a parcel, and one that ends inside.
_SCENES: list[list[tuple[dict, tuple[str, int, int, int, int, int]]]] = [
    [
        ({"type": "Polygon", "coordinates": [planted._box(0, 0, 500)]}, ("Polygon", 0, 0, 501, 500, 5)),
        ({"type": "Polygon", "coordinates": [planted._box(502, 0, 500)]}, ("Polygon", 501, 0, 1002, 500, 5)),
    ],
    [
        ({"type": "Polygon", "coordinates": [planted._box(0, 0, 500)]}, ("Polygon", 0, 0, 503, 500, 7)),
        ({"type": "Polygon", "coordinates": [planted._box(500, 0, 3, 500)]}, ("", 0, 0, 0, 0, 0)),
    ],
    [
        ({"type": "Polygon", "coordinates": [planted._box(0, 0, 500)]}, ("Polygon", 0, 0, 400, 500, 5)),
        ({"type": "Polygon", "coordinates": [planted._box(400, 0, 500)]}, ("Polygon", 500, 0, 900, 500, 5)),
    ],
    [
        ({"type": "Polygon", "coordinates": [[planted.at(0, 0), planted.at(500, 0), planted.at(500, 200), planted.at(500, 500), planted.at(0, 500), planted.at(0, 0)]]}, ("Polygon", 0, 0, 500, 500, 6)),
        ({"type": "Polygon", "coordinates": [planted._box(500, 0, 500)]}, ("Polygon", 500, 0, 1000, 500, 6)),
    ],
    [
        ({"type": "Polygon", "coordinates": [planted._box(500, 0, 500)]}, ("Polygon", 500, 0, 1000, 500, 5)),
        ({"type": "LineString", "coordinates": [planted.at(0, 250), planted.at(490, 250)]}, ("LineString", 0, 250, 500, 250, 2)),
    ],
    [
        ({"type": "Polygon", "coordinates": [planted._box(500, 0, 500)]}, ("Polygon", 500, 0, 1000, 500, 5)),
        ({"type": "LineString", "coordinates": [planted.at(0, 250), planted.at(507, 250)]}, ("LineString", 0, 250, 500, 250, 2)),
    ],
]
_SCENE_ROWS = ", ".join(f"({2 * s + k}, '{t}', {a}, {b}, {c}, {d}, {n})" for s, scene in enumerate(_SCENES) for k, (_, (t, a, b, c, d, n)) in enumerate(scene) if t)
_PLACE = f"10000000 + %s * {planted.STEP}"


def _scenes(spark, sf_dir) -> DataFrame:
    """Two features for each part: the scene of its number's remainder, at its place."""

    def run(batches):
        for batch in batches:
            index, texts = [], []
            for n in batch.column(0).to_pylist():
                for k, (geometry, _) in enumerate(_SCENES[n % len(_SCENES)]):
                    index.append(2 * n + k)
                    texts.append(planted.feature_text(geometry, n))
            yield pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array(texts, pa.string())], ["feature_index", "feature"])

    parts = _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long")).repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return parts.mapInArrow(run, "feature_index long, feature string")


@query(
    f"""WITH p AS (SELECT p_partkey AS n, {_PLACE % '(p_partkey % 1000)'} AS px, {_PLACE % '(p_partkey // 1000)'} AS py FROM part)
SELECT 2 * n + k % 2 AS source_index, type, px + a AS minx, py + b AS miny, px + c AS maxx, py + d AS maxy, CAST(positions AS INTEGER) AS positions
FROM p JOIN (VALUES {_SCENE_ROWS}) v(k, type, a, b, c, d, positions) ON n % {len(_SCENES)} = k // 2"""
)
def heal_scenes(spark, sf_dir):
    """Every repair between features, each in scenes of its own."""
    return _measures(heal(_scenes(spark, sf_dir), Options(), withhold_reviewed=False).features, "source_index")


def _planted(spark, sf_dir, geometry: Callable[[float, float], dict]) -> DataFrame:
    """A feature for each part with a geometry about its lattice corner."""

    def run(batches):
        for batch in batches:
            texts = [json.dumps({"type": "Feature", "properties": {}, "geometry": geometry(x / 1e6, y / 1e6)}) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["feature_index", "feature"])

    return lattice.parcels(spark, sf_dir).select(F.col("parcel_id").alias("feature_index"), "x0", "y0").mapInArrow(run, "feature_index long, feature string")


def _healed_counts(spark, sf_dir, geometry: Callable[[float, float], dict]) -> DataFrame:
    return heal_features(_planted(spark, sf_dir, geometry), Options()).select("feature_index", "quarantined", F.explode("counts").alias("counter", "n")).where("n > 0")


@query(_P + " SELECT parcel_id AS feature_index, false AS quarantined, counter, CAST(1 AS BIGINT) AS n FROM parcels, (VALUES ('selfIntersectionsRepaired')) v(counter)")
def unkink(spark, sf_dir):
    """A bow tie in each place."""
    return _healed_counts(spark, sf_dir, lambda x, y: {"type": "Polygon", "coordinates": [[[x, y], [x + 0.0005, y + 0.0004], [x + 0.0005, y], [x, y + 0.0006], [x, y]]]})


@query(_P + " SELECT parcel_id AS feature_index, false AS quarantined, counter, CAST(n AS BIGINT) AS n FROM parcels, (VALUES ('holesRemoved', 2)) v(counter, n)")
def hole_repair(spark, sf_dir):
    """A square with a sound hole, one outside, and a tiny one."""

    def box(x: float, y: float, w: float) -> list:
        return [[x, y], [x, y + w], [x + w, y + w], [x + w, y], [x, y]]

    return _healed_counts(spark, sf_dir, lambda x, y: {"type": "Polygon", "coordinates": [box(x, y, 0.0008)[::-1], box(x + 0.0001, y + 0.0001, 0.0001), box(x + 0.001, y, 0.0001), box(x + 0.0004, y + 0.0004, 1e-7)]})


@query(_P + " SELECT parcel_id AS feature_index, false AS quarantined, 'spikesRemoved' AS counter, CAST(1 AS BIGINT) AS n FROM parcels")
def spike_repair(spark, sf_dir):
    """A square with a needle on its north side."""

    def ring(x: float, y: float) -> list:
        return [[x, y], [x + 0.0005, y], [x + 0.0005, y + 0.0005], [x + 0.00025, y + 0.0005], [x + 0.0002499, y + 0.0009], [x + 0.0002498, y + 0.0005], [x, y + 0.0005], [x, y]]

    return _healed_counts(spark, sf_dir, lambda x, y: {"type": "Polygon", "coordinates": [ring(x, y)]})


@query(_P + " SELECT parcel_id AS feature_index, round(x0 / 1e6, 6) AS minx, round(y0 / 1e6, 6) AS miny, round(x1 / 1e6, 6) AS maxx, round(y1 / 1e6, 6) AS maxy FROM parcels")
def geojson_roundtrip(spark, sf_dir):
    """Written as newline-delimited GeoJSON, read again."""
    out = f"{session_dir(spark)}/geojson-{uuid.uuid4().hex}"
    lattice.features_json(spark, sf_dir).select(F.col("feature").alias("value")).write.text(out)
    f = readers.read_geojson_lines(spark, out).select(F.from_json("feature", "id long, geometry struct<coordinates: array<array<array<double>>>>").alias("f"))
    box = g.bounds(F.get("f.geometry.coordinates", F.lit(0)))
    return f.select(F.col("f.id").alias("feature_index"), *[F.round(box[b], 6).alias(b) for b in ("minx", "miny", "maxx", "maxy")])


@query(_P + " SELECT parcel_id AS feature_index, 'MultiLineString' AS geometry_type, CAST(1 AS INTEGER) AS lines, round(x0 / 1e6, 6) AS minx, round(y0 / 1e6, 6) AS miny, round(x1 / 1e6, 6) AS maxx, round(y1 / 1e6, 6) AS maxy FROM parcels")
def linework(spark, sf_dir):
    lines = writers._texts(lattice.features_json(spark, sf_dir), lambda f: json.dumps(writers.linework(f["geometry"])))
    f = lines.select("feature_index", F.from_json("feature", "type string, coordinates array<array<array<double>>>").alias("l"))
    box = g.bounds(F.flatten("l.coordinates"))
    return f.select("feature_index", F.col("l.type").alias("geometry_type"), F.size("l.coordinates").alias("lines"), *[F.round(box[b], 6).alias(b) for b in ("minx", "miny", "maxx", "maxy")])


_N, _K0 = 0.0016792203863837047, 0.9996  # the third flattening of WGS 84, the scale on the meridian
_double = "{:.17e}".format
_RECTIFYING = 6378137 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_SERIES = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_ECCENTRIC = 0.08181919084262149


@query(
    _P
    + f""", d AS (SELECT parcel_id, radians(x0 / 1e6) - radians(51.0) AS l, sin(radians(y0 / 1e6)) AS s FROM parcels),
t AS (SELECT parcel_id, l, sinh(atanh(s) - {_double(_ECCENTRIC)} * atanh({_double(_ECCENTRIC)} * s)) AS tau FROM d),
x AS (SELECT parcel_id, atan2(tau, cos(l)) AS xi, asinh(sin(l) / sqrt(tau * tau + cos(l) * cos(l))) AS eta FROM t)
SELECT parcel_id AS feature_index, round(500000 + {_double(_K0 * _RECTIFYING)} * (eta + {" + ".join(f"{_double(a)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(_SERIES, 1))}), 3) AS east_m,
  round({_double(_K0 * _RECTIFYING)} * (xi + {" + ".join(f"{_double(a)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(_SERIES, 1))}), 3) AS north_m FROM x"""
)
def crs_projection(spark, sf_dir):
    """The lattice's corners in UTM zone 39 north."""

    def run(batches):
        for batch in batches:
            x, y = readers.crs.from_wgs84(batch.column(1).to_numpy(), batch.column(2).to_numpy(), "EPSG:32639")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x), pa.array(y)], ["feature_index", "x", "y"])

    c = lattice.features(spark, sf_dir).select("feature_index", "minx", "miny").mapInArrow(run, "feature_index long, x double, y double")
    return c.select("feature_index", F.round("x", 3).alias("east_m"), F.round("y", 3).alias("north_m"))


_BOXES = _P + " SELECT parcel_id AS feature_index, round(x0 / 1e6, 6) AS minx, round(y0 / 1e6, 6) AS miny, round(x1 / 1e6, 6) AS maxx, round(y1 / 1e6, 6) AS maxy FROM parcels WHERE y1 > y0"


def _back(spark, sf_dir, write: Callable[[DataFrame, str], None], name: str, source_crs: str | None = None) -> DataFrame:
    """The lattice's sound parcels written as files of a format and read again, with the parcel that each stands for."""
    sound = lattice.features_json(spark, sf_dir).join(lattice.features(spark, sf_dir).where("area_m2 > 0").select("feature_index"), "feature_index", "left_semi")
    out = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write(sound, out)
    return readers.read_dataset(spark, out, source_crs)


def _boxed(found: DataFrame, key) -> DataFrame:
    shape = F.from_json("feature", "properties string, geometry struct<coordinates: array<array<array<double>>>>")
    f = found.select("*", shape.alias("f"))
    box = g.bounds(F.get("f.geometry.coordinates", F.lit(0)))
    return f.select(key.alias("feature_index"), *[F.round(box[b], 6).alias(b) for b in ("minx", "miny", "maxx", "maxy")])


def _put(spark, path: str, name: str, data: bytes) -> None:
    """One file in the session's folder, by the Hadoop file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(data))
    out.close()


@query(_BOXES)
def shapefile_roundtrip(spark, sf_dir):
    """Zipped shapefiles of at most 500 parcels each, written and read again."""

    def write(features, path):
        writers.write_shapefiles(features, f"{path}-rows", 500)
        for r in spark.read.parquet(f"{path}-rows").select("family", "part", "data").collect():  # files of 500 parcels
            _put(spark, path, f"{r.family}-{r.part:05d}.zip", bytes(r.data))

    found = _back(spark, sf_dir, write, "shapefile")
    return _boxed(found, F.from_json("f.properties", "parcel double")["parcel"].cast("long"))


@query(_BOXES)
def dxf_roundtrip(spark, sf_dir):
    """Drawings in UTM zone 39 north, of at most 5,000 parcels each, written and read again; entities are in the order of the parcels."""
    found = _back(spark, sf_dir, lambda features, path: writers.write_drawings(features, path, "EPSG:32639"), "dxf", "EPSG:32639")
    order = numbered(lattice.features(spark, sf_dir).where("area_m2 > 0").select(F.col("feature_index").alias("own")), ["own"], "feature_index")
    return _boxed(found.join(order, "feature_index"), F.col("own"))


@query(_BOXES)
def kml_scan(spark, sf_dir):
    """KML files and KMZ archives with half of the parcels each, at most 5,000 a file, read as one dataset."""

    def pack(pdf) -> bytes:
        rows = pdf.sort_values("parcel_id").itertuples()
        mark = lambda r: f"<Placemark><name>{r.parcel_id}</name><Polygon><outerBoundaryIs><LinearRing><coordinates>" + " ".join(f"{x / 1e6},{y / 1e6}" for x, y in ((r.x0, r.y0), (r.x1, r.y0), (r.x1, r.y1), (r.x0, r.y1), (r.x0, r.y0))) + "</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"
        document = ('<kml xmlns="http://www.opengis.net/kml/2.2"><Document>' + "".join(map(mark, rows)) + "</Document></kml>\n").encode()
        if pdf["part"].iloc[0] % 2 == 0:
            return document
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:  # stored as they are: what repeats would look like an archive bomb
            z.writestr("doc.kml", document)
            z.comment = b"\n"  # an archive ends with its comment
        return packed.getvalue()

    sound = lattice.parcels(spark, sf_dir).where("y1 > y0").select("parcel_id", "x0", "y0", "x1", "y1")
    out = f"{session_dir(spark)}/kml-{uuid.uuid4().hex}"
    dealt = numbered(sound, ["parcel_id"], "at").withColumn("part", F.expr(f"2 * (at div {2 * writers.FILE_FEATURES}) + at % 2"))
    writers.write_files(dealt, out, pack, lambda part: "kmz" if part % 2 else "kml")
    return _boxed(readers.read_dataset(spark, out), F.from_json("f.properties", "name string")["name"].cast("long"))


# ---- parcels by hand, drawings, imports -------------------------------------------------------------------------------

_EDITS = [planted._box(0, 0, 500), planted._box(0, 0, 500)[::-1], planted._box(0, 0, 500)[:-1], [planted.at(0, 0), planted.at(500, 500), planted.at(500, 0), planted.at(0, 700), planted.at(0, 0)], [planted.at(0, 0), planted.at(0, 0), planted.at(500, 0), planted.at(500, 500), planted.at(0, 0)], [planted.at(0, 0), planted.at(500, 0), planted.at(900, 0), planted.at(0, 0)], [planted.at(0, 0), planted.at(500, 0, z=1), planted.at(500, 500), planted.at(0, 0)]]
_FAULTS = (None, None, "open", "crossing", "repeated", "flat", "dimension")


@query(
    "SELECT p_partkey AS parcel, fault, CASE WHEN fault IS NULL THEN true END AS counter_clockwise FROM part JOIN (VALUES "
    + ", ".join(f"({k}, CAST({'NULL' if f is None else repr(f)} AS VARCHAR))" for k, f in enumerate(_FAULTS))
    + f") v(kind, fault) ON p_partkey % {len(_FAULTS)} = kind"
)
def parcel_validation(spark, sf_dir):
    """Edited parcels: two sound ones, the second turned round, and five faults."""
    edits = planted.planted(spark, sf_dir, [{"feature": {"type": "Polygon", "coordinates": [r]}} for r in _EDITS])
    found = parcels.checked_parcels(edits.select(F.col("feature_index").alias("parcel"), F.lit("Polygon").alias("kind"), F.col("feature").alias("geometry")))
    ring = F.get(F.from_json("geometry", "coordinates array<array<array<double>>>")["coordinates"], F.lit(0))
    return found.select("parcel", "fault", F.when(F.col("geometry").isNotNull(), g.orientation(ring) == "ccw").alias("counter_clockwise"))


@query("SELECT p_partkey AS drawing, CASE p_partkey % 6 WHEN 1 THEN 'revision' WHEN 2 THEN 'id' WHEN 3 THEN 'vertices' WHEN 4 THEN 'vertex' WHEN 5 THEN 'ring' END AS fault FROM part")
def drawing_validation(spark, sf_dir):
    shape = lambda vertices, name="a", kind="parcel": {"id": name, "kind": kind, "vertices": vertices}
    square = [[51, 35], [52, 35], [52, 36], [51, 36]]
    bodies = [
        {"revision": 3, "features": [shape(square), shape(square[:2], "b", "line")]}, {"revision": 1.5, "features": []}, {"revision": 0, "features": [shape(square), shape(square)]},
        {"revision": 0, "features": [shape(square[:2])]}, {"revision": 0, "features": [shape([*square[:3], [51, 88]])]}, {"revision": 0, "features": [shape([square[0], square[2], square[1], square[3]])]},
    ]
    body = F.element_at(F.array(*[F.lit(json.dumps(b)) for b in bodies]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return parcels.drawing_faults(_read(spark, sf_dir, "part").select(F.col("p_partkey").alias("drawing"), body.alias("body")))


@query("SELECT p_partkey AS feature_index, p_partkey AS out_index FROM part WHERE p_partkey % 5 NOT IN (3, 4)")
def parcel_match(spark, sf_dir):
    """Source parcels in an output that has them turned round: with their ids, or without; every fifth is reshaped, every fifth has another id."""
    box = {"type": "Polygon", "coordinates": [planted._box(0, 0, 500)]}
    source = planted.planted(spark, sf_dir, [{"feature": {"type": "Feature", "id": "own", "properties": {}, "geometry": box}}])
    turned = {"type": "Polygon", "coordinates": [planted._box(0, 0, 500)[::-1]]}
    wider = {"type": "Polygon", "coordinates": [planted._box(0, 0, 501)]}
    ids = [{"id": "own"}, {"id": "own"}, {}, {"id": "own"}, {"id": "other"}]
    output = planted.planted(spark, sf_dir, [{"feature": {"type": "Feature", **own, "properties": {}, "geometry": wider if k == 3 else turned}} for k, own in enumerate(ids)])
    return parcels.matched_parcels(source, output)


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'EPSG:32639' WHEN 1 THEN 'EPSG:32639' END AS source_crs, CASE c_custkey % 4 WHEN 0 THEN false WHEN 1 THEN true END AS partial,
  CASE c_custkey % 4 WHEN 0 THEN CAST(2 AS BIGINT) WHEN 1 THEN CAST(5 AS BIGINT) END AS occurrences FROM customer"""
)
def import_report_check(spark, sf_dir):
    """Import metadata: with one warning, with two, with a code of another system, and with no count."""
    w = lambda code, n: {"code": code, "message": "m", "occurrences": n}
    report = lambda crs, *warnings: json.dumps({"sourceCrs": crs, "targetCrs": "EPSG:4326", "warnings": list(warnings)})
    texts = [report("EPSG:32639", w("CAD_POLYGON_FALLBACK", 2)), report("EPSG:32639", w("CAD_MISSING_BLOCK", 1), w("CAD_POLYGON_FALLBACK", 4)), report("EPSG:0639", w("CAD_MISSING_BLOCK", 1)), report("EPSG:32639", w("CAD_MISSING_BLOCK", 0))]
    r = parcels.import_report(F.element_at(F.array(*map(F.lit, texts)), (F.col("c_custkey") % 4 + 1).cast("int")))
    c = _read(spark, sf_dir, "customer").select("c_custkey", r.alias("r"))
    total = F.aggregate("r.warnings", F.lit(0).cast("long"), lambda a, x: a + x["occurrences"])
    return c.select("c_custkey", F.col("r.sourceCrs").alias("source_crs"), F.col("r.partial").alias("partial"), total.alias("occurrences"))


@query(
    """WITH m AS (SELECT user_id % 7 AS file, CASE WHEN event_id % 5 = 0 THEN 'CAD_POLYGON_FALLBACK' WHEN event_id % 5 = 1 THEN 'CAD_MISSING_BLOCK' ELSE 'UNSUPPORTED' END AS code,
  CASE WHEN event_id % 5 = 0 THEN 'Some polygon boundaries were read using a geometry fallback; review their topology.'
    WHEN event_id % 5 = 1 THEN 'Block B' || (event_id % 3) || ' does not exist; its contents could not be imported.' END AS message FROM events)
SELECT file, code, message, count(*) AS occurrences FROM m GROUP BY 1, 2, 3"""
)
def import_warning_counts(spark, sf_dir):
    said = F.when(F.col("event_id") % 5 == 0, F.lit(parcels.POLYGON_FALLBACK)).when(F.col("event_id") % 5 == 1, F.concat(F.lit(" Block B"), (F.col("event_id") % 3).cast("string"), F.lit(" does not exist"))).otherwise(F.lit("odd"))
    m = _read(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("file"), F.when(F.col("event_id") % 5 == 4, "UserWarning").otherwise("RuntimeWarning").alias("category"), said.alias("message"))
    return parcels.import_warnings(m, ["file"])


# ---- reports --------------------------------------------------------------------------------------------------------

_STATUS = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'processing' WHEN 'signup' THEN 'queued' ELSE 'dry-run-complete' END"
_ACTIVITY = f"""WITH activity AS (SELECT event_id, user_id, user_id % 7 AS company_id, CAST(event_id % 1000 AS BIGINT) AS size_in_bytes, CAST(event_id % 11 AS BIGINT) AS identified_issues,
  CAST(event_id % 5 AS BIGINT) AS healed_issues, {_STATUS} AS heal_status, ts AS created_at, CASE WHEN event_id % 10 = 0 THEN ts END AS deleted_at FROM events)"""
_SUMS = "CAST(coalesce(sum(size_in_bytes), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(identified_issues), 0) AS BIGINT) AS identified_issues, CAST(coalesce(sum(healed_issues), 0) AS BIGINT) AS healed_issues"
_FROM, _TO = date(2024, 1, 5), date(2024, 2, 10)
_WITHIN = "created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-02-10'"


def _activity(spark, sf_dir) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "signup", "queued").otherwise("dry-run-complete")
    return e.select("event_id", "user_id", (F.col("user_id") % 7).alias("company_id"), (F.col("event_id") % 1000).alias("size_in_bytes"), (F.col("event_id") % 11).alias("identified_issues"), (F.col("event_id") % 5).alias("healed_issues"), status.alias("heal_status"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 10 == 0, F.col("ts")).alias("deleted_at"))


_DAILY = f"SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS uploads, count(*) FILTER (WHERE heal_status = 'completed') AS completed, count(*) FILTER (WHERE heal_status = 'failed') AS failed, {_SUMS} FROM activity WHERE {_WITHIN} GROUP BY 1"


@query(_ACTIVITY + _DAILY)
def daily_report(spark, sf_dir):
    return reports.daily(reports.within(_activity(spark, sf_dir), _FROM, _TO))


@query(_ACTIVITY + f", d AS ({_DAILY}), c AS (SELECT strftime(unnest(range(DATE '2024-01-05', DATE '2024-02-10', INTERVAL 1 DAY)), '%Y-%m-%d') AS date) SELECT date, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("uploads", "completed", "failed", "bytes", "identified_issues", "healed_issues")) + " FROM c LEFT JOIN d USING (date)")
def zero_filled_calendar(spark, sf_dir):
    return reports.zero_filled(reports.calendar(spark, _FROM, _TO), reports.daily(reports.within(_activity(spark, sf_dir), _FROM, _TO)))


@query(_ACTIVITY + f" SELECT heal_status AS status, count(*) AS count FROM activity WHERE {_WITHIN} GROUP BY 1")
def status_counts(spark, sf_dir):
    return reports.status_counts(reports.within(_activity(spark, sf_dir), _FROM, _TO))


@query(_ACTIVITY + f" SELECT count(*) AS uploads, {_SUMS}, count(*) FILTER (WHERE heal_status = 'completed') AS completed, count(*) FILTER (WHERE heal_status = 'failed') AS failed, count(*) FILTER (WHERE heal_status IN ('processing', 'queued')) AS processing, count(deleted_at) AS deleted_files FROM activity WHERE {_WITHIN}")
def global_usage(spark, sf_dir):
    return reports.summary(reports.within(_activity(spark, sf_dir), _FROM, _TO))


@query(_ACTIVITY + f", u AS (SELECT user_id, count(*) AS uploads, {_SUMS} FROM activity GROUP BY 1), f AS (SELECT user_id, count(*) AS stored_files FROM activity WHERE deleted_at IS NULL GROUP BY 1) SELECT c_custkey AS user_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("uploads", "bytes", "identified_issues", "healed_issues", "stored_files")) + " FROM customer LEFT JOIN u ON u.user_id = c_custkey LEFT JOIN f ON f.user_id = c_custkey")
def per_user_usage(spark, sf_dir):
    a = _activity(spark, sf_dir)
    users = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return reports.with_usage(users, a, a.where("deleted_at is null"))


@query(_ACTIVITY + f" SELECT company_id, user_id, count(*) AS uploads, {_SUMS} FROM activity GROUP BY 1, 2")
def company_usage(spark, sf_dir):
    return reports.usage(_activity(spark, sf_dir), "company_id", "user_id")


@query(_ACTIVITY + f" SELECT user_id, count(*) AS uploads, {_SUMS} FROM activity GROUP BY 1")
def upload_summary(spark, sf_dir):
    return reports.usage(_activity(spark, sf_dir), "user_id")


@query("SELECT source AS name, count(*) AS count FROM documents WHERE n_chars > 0 GROUP BY 1")
def category_facet(spark, sf_dir):
    return reports.facet(_read(spark, sf_dir, "documents").where("n_chars > 0"), "source")


_PLAN = "CASE c_mktsegment WHEN 'BUILDING' THEN 'free' WHEN 'MACHINERY' THEN 'advanced' ELSE 'other' END"


def _users(spark, sf_dir) -> DataFrame:
    plan = F.when(F.col("c_mktsegment") == "BUILDING", "free").when(F.col("c_mktsegment") == "MACHINERY", "advanced").otherwise("other")
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), plan.alias("plan_code"))


@query(f"WITH u AS (SELECT {_PLAN} AS code FROM customer) SELECT p.code, count(u.code) AS count FROM (VALUES ('free'), ('pro'), ('advanced')) p(code) LEFT JOIN u USING (code) GROUP BY 1")
def plan_distribution(spark, sf_dir):
    return reports.plan_distribution(spark, _users(spark, sf_dir))


@query("SELECT doc_id, source FROM documents WHERE (lower(source) LIKE '%rc1%' OR lower(lang) LIKE '%rc1%') AND n_chars > 0")
def file_list_filter(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", "source", F.col("source").alias("name"), F.col("lang").alias("original_name"), F.col("n_chars").alias("identified_issues"), F.lit(None).cast("timestamp").alias("created_at"))
    return d.where(reports.file_filters(" RC1 ", has_issues=True)).select("doc_id", "source")


@query("SELECT doc_id, source, lang FROM documents WHERE lower(source) = 'src3' AND (lower(lang) LIKE '%e%')")
def article_filter(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("source").alias("category"), F.col("lang").alias("title"), F.lit("").alias("excerpt"), F.array("lang").alias("keywords"))
    return d.where(reports.article_filters(search="E", category="SRC3")).select("doc_id", "source", "lang")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50")
def offset_page(spark, sf_dir):
    return reports.page(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 50, 25)


@query("SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50")
def offset_page_with_total(spark, sf_dir):
    return reports.page_with_total(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 50, 25)


@query(
    """SELECT o_orderkey AS file_id, 'f' || o_orderkey AS name, CASE WHEN l_orderkey IS NULL THEN 'unavailable' ELSE 'completed' END AS status, l_orderkey IS NOT NULL AS is_healed, n AS issues_found
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_custkey % 10 = 4"""
)
def file_list_with_analysis(spark, sf_dir):
    """Files of one user; every third has an analysis, and analyses of others do not count."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), (F.col("o_custkey") % 10).alias("owner_id"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"), F.lit("x").alias("original_name"), F.lit(1).alias("size_in_bytes"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))
    n = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file_id")).agg(F.count("*").alias("issues_found"))
    owner = F.when(F.col("file_id") % 3 == 0, F.lit(4)).otherwise(F.lit(5))
    return reports.file_summaries(o, n.select("file_id", owner.alias("owner_id"), F.lit("completed").alias("heal_status"), "issues_found"), F.lit(4)).select("file_id", "name", "status", "is_healed", "issues_found")


@query(
    f"""SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM customer WHERE c_custkey % 40 >= 5) AS new_users, (SELECT count(*) FROM supplier) AS companies,
  (SELECT count(*) FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')) AS active_companies,
  (SELECT count(*) FROM events WHERE event_id % 10 <> 0) AS stored_files, (SELECT count(*) FROM events WHERE event_id % 10 = 0) AS deleted_files"""
)
def admin_counts(spark, sf_dir):
    day = F.expr("timestamp_seconds(1704067200 + 86400 * cast(user_id % 40 as bigint))")  # the first forty days of 2024
    users = _users(spark, sf_dir).withColumn("created_at", day)
    companies = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"), F.col("s_suppkey").alias("owner_id"))
    a = _activity(spark, sf_dir)
    return reports.admin_counts(users, companies, a, a.where("deleted_at is null"), date(2024, 1, 6), date(2024, 3, 1))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY")
def retention(spark, sf_dir):
    return reports.live(_read(spark, sf_dir, "events"), "ts", F.lit("2024-01-20").cast(dict(_read(spark, sf_dir, "events").dtypes)["ts"]), "7 days").select("event_id")


@query("SELECT o_orderkey, greatest(o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 1000000 ELSE 0 END) AS owner FROM orders UNION ALL SELECT -1, -1")
def store_upsert(spark, sf_dir):
    """A versioned table: every fourth row is written again, twice, and one row is new."""
    path = f"{session_dir(spark)}/store-{uuid.uuid4().hex}"
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("owner"), F.lit(1).alias("at"))
    store.upsert(o, path, ["o_orderkey"], "at")
    again = o.where("o_orderkey % 4 = 0")
    newer = again.withColumn("owner", F.lit(1000000).cast(dict(o.dtypes)["owner"])).withColumn("at", F.lit(3)).unionByName(again.withColumn("owner", -F.col("owner")).withColumn("at", F.lit(2)))
    extra = spark.createDataFrame([(-1, -1, 9)], "o_orderkey long, owner long, at int").select(*[F.col(c).cast(t) for c, t in o.dtypes])
    store.upsert(newer.unionByName(extra), path, ["o_orderkey"], "at")
    return store.latest(spark, path).select("o_orderkey", "owner")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' OR (o_orderdate = TIMESTAMP '1996-01-01' AND o_orderkey < 5000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 9")
def keyset_page(spark, sf_dir):
    return reports.keyset_page(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 8, ("1996-01-01 00:00:00", 5000))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def topk_recent(spark, sf_dir):
    return reports.latest(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query(f"SELECT s_suppkey AS company_id, s_name FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer WHERE {_PLAN} = 'advanced')")
def semi_join_active(spark, sf_dir):
    companies = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"), F.col("s_suppkey").alias("owner_id"), "s_name")
    return reports.active_companies(companies, _users(spark, sf_dir)).select("company_id", "s_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 8 = 1)")
def anti_join_quarantine(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select("c_custkey")
    return c.join(_read(spark, sf_dir, "orders").where("o_orderkey % 8 = 1").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(f"SELECT c_custkey AS user_id, CASE WHEN {_PLAN} = 'advanced' AND s_suppkey IS NOT NULL THEN s_suppkey END AS company_id FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def attributed_company(spark, sf_dir):
    companies = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"), F.col("s_suppkey").alias("owner_id"))
    members = spark.createDataFrame([], "user_id long, company_id long")
    return reports.attributed_company(_users(spark, sf_dir), companies, members)


# ---- scalar functions -----------------------------------------------------------------------------------------------


@query("SELECT c_custkey, '+98' || CAST(9000000000 + c_custkey AS VARCHAR) AS phone FROM customer")
def phone_normalize(spark, sf_dir):
    digits = F.translate((9000000000 + F.col("c_custkey")).cast("string"), t.ASCII_DIGITS, t.PERSIAN_DIGITS)
    raw = F.concat(F.lit("+98 ("), F.substring(digits, 1, 3), F.lit(") "), F.substring(digits, 4, 3), F.lit("-"), F.substring(digits, 7, 4))
    return _read(spark, sf_dir, "customer").select("c_custkey", t.normalize_phone(raw).alias("phone"))


@query("SELECT DISTINCT lower(trim(p_name)) AS keyword FROM part")
def keyword_normalize(spark, sf_dir):
    return _read(spark, sf_dir, "part").select(t.normalize_keyword(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))).alias("keyword")).distinct()


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slugify(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", t.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


@query("SELECT c_custkey, sha256(c_name) AS digest FROM customer")
def sha256_token(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select("c_custkey", t.token_digest(F.col("c_name")).alias("digest"))


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS id, o_orderdate AS published_at FROM orders")
def cursor_roundtrip(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").withColumn("c", t.parse_cursor(t.cursor(F.col("o_orderkey").cast("string"), F.col("o_orderdate"))))
    return o.select("o_orderkey", F.col("c.id").alias("id"), F.col("c.publishedAt").alias("published_at"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


# ---- event log --------------------------------------------------------------------------------------------------------


@query("WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, count(*) OVER (PARTITION BY user_id) AS c FROM events) SELECT user_id, event_id, CAST(seq AS INTEGER) AS seq FROM n WHERE c - seq < 100")
def event_log_last(spark, sf_dir):
    return ev.last_events(_read(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "seq")


@query("WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) SELECT user_id, event_id, CAST(seq AS INTEGER) AS seq FROM n WHERE seq > 5 + user_id % 3")
def event_replay_after(spark, sf_dir):
    log = ev.numbered(_read(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    return ev.replay(log, 5 + F.col("user_id") % 3).select("user_id", "event_id", "seq")


def _job_events(spark, sf_dir) -> DataFrame:
    """Jobs of ten events each; the kinds of event cycle with the event's number."""
    kinds = ["queued", "processing", "progress", "failed", "progress", "queued", "reset", "completed", "cancelled"]
    e = _read(spark, sf_dir, "events")
    return e.select(F.floor(F.col("event_id") / 10).alias("job"), "event_id", "ts", F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") * 7 % 9 + 1).cast("int")).alias("event"), "value")


@query(
    """WITH e AS (SELECT CAST(floor(event_id / 10.0) AS BIGINT) AS job, event_id, ['queued', 'processing', 'progress', 'failed', 'progress', 'queued', 'reset', 'completed', 'cancelled'][event_id * 7 % 9 + 1] AS event,
  row_number() OVER (PARTITION BY CAST(floor(event_id / 10.0) AS BIGINT) ORDER BY ts, event_id) AS seq FROM events)
SELECT job, event_id, CAST(seq AS INTEGER) AS seq, event FROM e WHERE seq <= coalesce((SELECT min(seq) FROM e t WHERE t.job = e.job AND t.event IN ('completed', 'cancelled', 'failed')), 1000)"""
)
def terminal_close(spark, sf_dir):
    log = ev.numbered(_job_events(spark, sf_dir), "job", "ts", "event_id")
    return ev.until_terminal(log, "job", "event").select("job", "event_id", "seq", "event")


_FOLD = """WITH RECURSIVE e AS (
  SELECT CAST(floor(event_id / 10.0) AS BIGINT) AS job, value, ['queued', 'processing', 'progress', 'failed', 'progress', 'queued', 'reset', 'completed', 'cancelled'][event_id * 7 % 9 + 1] AS event,
    row_number() OVER (PARTITION BY CAST(floor(event_id / 10.0) AS BIGINT) ORDER BY ts, event_id) AS seq FROM events),
f AS (
  SELECT DISTINCT job, CAST(0 AS BIGINT) AS seq, 'dry-run-complete' AS s, CAST(0 AS DOUBLE) AS p FROM e
  UNION ALL
  SELECT e.job, e.seq,
    CASE event WHEN 'queued' THEN CASE WHEN s = 'dry-run-complete' THEN 'queued' ELSE s END
      WHEN 'progress' THEN CASE WHEN s IN ('completed', 'cancelled', 'failed') THEN s ELSE 'processing' END
      WHEN 'completed' THEN CASE WHEN s = 'cancelled' THEN s ELSE event END WHEN 'cancelled' THEN CASE WHEN s = 'completed' THEN s ELSE event END
      WHEN 'reset' THEN CASE WHEN s IN ('queued', 'failed', 'cancelled') THEN 'dry-run-complete' ELSE s END
      ELSE CASE WHEN s IN ('completed', 'cancelled') THEN s ELSE event END END,
    CASE WHEN event = 'reset' AND s IN ('queued', 'failed', 'cancelled') THEN 0 WHEN event = 'completed' AND s <> 'cancelled' THEN 100
      WHEN event = 'processing' AND s NOT IN ('completed', 'cancelled') THEN greatest(p, 1)
      WHEN event = 'progress' AND s NOT IN ('completed', 'cancelled', 'failed') THEN greatest(p, least(100, greatest(0, value))) ELSE p END
  FROM f JOIN e ON e.job = f.job AND e.seq = f.seq + 1)
SELECT f.job, s AS status, p AS progress, n AS events FROM f JOIN (SELECT job, count(*) AS n FROM e GROUP BY job) c ON c.job = f.job AND c.n = f.seq"""


@query(_FOLD)
def status_fold(spark, sf_dir):
    return ev.folded(_job_events(spark, sf_dir), "job", "ts", "event_id", "event", "value")


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def rate_windows(spark, sf_dir):
    return ev.windowed_counts(_read(spark, sf_dir, "events"), "ts", "event_type", "1 hour").select("event_type", F.col("window.start").alias("start"), "n")

