"""The dry run: nineteen checks over a dataset of features, one table of issues, groups and a summary.

Features: (feature_index, feature), feature as GeoJSON text. One pass checks single features and says which are kept
from the checks between features; those run as spatial joins over the components and lines of the rest. Nothing is changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Options
from ..operators import pair_checks
from ..operators.decompose import component_table, line_table
from ..operators.feature_checks import CHECKS, FINDINGS, check_features
from ..tables import numbered, written

AUTO, MANUAL = "AutoRepairAvailable", "ManualReview"


@dataclass
class DryRun:
    """issues: findings with issue_index, disposition; flags: of each feature; components and lines: the geometry tables."""

    issues: DataFrame
    flags: DataFrame
    components: DataFrame
    lines: DataFrame
    options: Options


def _row(check: str, code, related_index, related_id, path, related_path, polygon, related_polygon, details: list[Column], **given) -> list[Column]:
    """The columns of a finding in order."""
    values = {
        "check": F.lit(check), "code": code if isinstance(code, Column) else F.lit(code), "related_feature_index": related_index, "related_feature_id": related_id, "coordinate_path": path,
        "related_coordinate_path": related_path, "polygon_path": polygon, "related_polygon_path": related_polygon, "failure": F.lit(None).cast("string"), "details": F.to_json(F.struct(*details)), **given,
    }
    names = [c.split(" ")[0] for c in FINDINGS.split(", ")]
    kinds = dict(c.split(" ", 1) for c in FINDINGS.split(", "))
    return [(values[n] if n in values else F.col(n)).cast(kinds[n]).alias(n) for n in names]


def overlap_findings(components: DataFrame) -> DataFrame:
    o = pair_checks.overlaps(components)
    none = F.lit(None)
    return o.select(*_row("overlaps", "POLYGON_OVERLAP", F.col("r_feature_index"), F.col("r_feature_id"), none, none, F.col("polygon_path"), F.col("r_polygon_path"), [F.col("overlap_m2").alias("overlapAreaM2"), F.col("ratio").alias("overlapRatio")], related_gc_path=F.col("r_gc_path"), ord=F.col("r_component")))


def gap_findings(components: DataFrame, options: Options) -> DataFrame:
    g = pair_checks.gaps(components, options)
    path = lambda p, r, s: F.concat(F.col(p), F.array(F.col(r).cast("int"), F.col(s).cast("int")))
    details = [F.col("distance_m").alias("distanceMeters"), F.col("mode").alias("detectionMode"), F.col("shared_m").alias("sharedBoundaryLengthMeters"), F.col("shared_ratio").alias("sharedBoundaryRatio"), F.col("slim").alias("gapWidthToSharedBoundaryRatio"), F.col("limit_m").alias("repairDistanceLimitMeters"), F.array("px", "py").alias("nearestPosition"), F.array("qx", "qy").alias("relatedNearestPosition")]
    return g.select(*_row("gaps", "POLYGON_GAP", F.col("r_feature_index"), F.col("r_feature_id"), path("polygon_path", "ring", "segment"), path("r_polygon_path", "r_ring", "r_segment"), F.col("polygon_path"), F.col("r_polygon_path"), details, related_gc_path=F.col("r_gc_path"), ord=F.col("r_component")))


def neighbour_findings(components: DataFrame) -> DataFrame:
    v = pair_checks.neighbour_vertices(components)
    path = lambda p, s: F.concat(F.col(p), F.array(F.lit(0), F.col(s).cast("int")))
    details = [F.col("offset_m").alias("offsetMeters"), F.col("fraction").alias("targetSegmentFraction"), F.array("ix", "iy").alias("insertionPosition"), F.array("vx", "vy").alias("vertexPosition"), F.array("r_sx", "r_sy").alias("targetSegmentStart"), F.array("r_ex", "r_ey").alias("targetSegmentEnd"), F.col("targets").alias("candidateTargetCount")]
    return v.select(*_row("neighborConsistency", "NEIGHBOR_VERTEX_MISMATCH", F.col("r_feature_index"), F.col("r_feature_id"), path("polygon_path", "vertex"), path("r_polygon_path", "r_segment"), F.col("polygon_path"), F.col("r_polygon_path"), details, related_gc_path=F.col("r_gc_path"), ord=F.col("vertex")))


def line_findings(lines: DataFrame, components: DataFrame, options: Options) -> DataFrame:
    over, under = pair_checks.line_ends(lines, components, options)
    own = lines.select("part", "feature_index", "feature_id", "geometry_type", "gc_path", "root_path", "line")
    other = lines.select(F.col("part").alias("target_part"), F.lit(pair_checks.LINE).alias("target_ring"), F.col("feature_index").alias("ri"), F.col("feature_id").alias("rid"), F.col("gc_path").alias("rgc"), F.col("root_path").alias("rpath"), F.lit("Line").alias("rkind"))
    ring = components.select("*", F.posexplode("rings").alias("ring", "_r"))
    other = other.union(ring.select("component", "ring", "feature_index", "feature_id", "gc_path", F.concat("polygon_path", F.array("ring")), F.lit("PolygonBoundary")))
    out = None
    for check, found in (("undershoots", under), ("overshoots", over)):
        f = found.join(own, "part").join(other, ["target_part", "target_ring"])
        end = F.when(F.col("endpoint") == "start", F.lit(0)).otherwise(F.size("line") - 1)
        here = F.when(F.col("endpoint") == "start", F.get("line", F.lit(0))).otherwise(F.element_at("line", -1))
        details = [F.col("endpoint"), here.alias("endpointPosition"), F.array("tx", "ty").alias("targetPosition"), F.col("distance_m").alias("distanceMeters"), F.col("mode").alias("detectionMode"), F.col("rkind").alias("relatedTargetKind"), F.col("source_segment").alias("sourceSegmentIndex"), F.col("r_segment").alias("relatedSegmentIndex")]
        rows = f.select(*_row(check, F.col("code"), F.col("ri"), F.col("rid"), F.concat("root_path", F.array(end)), F.concat("rpath", F.array("r_segment")), F.lit(None), F.lit(None), details, related_gc_path=F.col("rgc"), ord=F.col("part") * 2 + (F.col("endpoint") == "end").cast("int")))
        out = rows if out is None else out.unionByName(rows)
    return out


def with_sliver_neighbours(findings: DataFrame, components: DataFrame) -> DataFrame:
    """Sliver findings with their dominant neighbour; repairable if small or if one neighbour can take them."""
    thin = findings.where("check = 'slivers'")
    number = F.from_json("details", "areaM2 double, perimeterMeters double, detectionReasons array<string>")
    thin = thin.withColumn("_d", number).join(components.select("feature_index", "gc_path", "polygon_path", "component"), ["feature_index", "gc_path", "polygon_path"])
    near = pair_checks.sliver_neighbours(thin.select("component", "feature_index", F.col("_d.areaM2").alias("area_m2"), F.col("_d.perimeterMeters").alias("perimeter_m")), components)
    t = thin.join(near, "component", "left")
    absorb = F.coalesce("absorb", F.lit(False))
    extra = F.to_json(F.struct(F.col("shared_m").alias("dominantSharedBoundaryLengthMeters"), F.col("shared_ratio").alias("dominantSharedBoundaryRatio"), F.col("dominance").alias("sharedBoundaryDominanceRatio"), F.col("area_ratio").alias("absorptionTargetAreaRatio")))
    merged = F.when(extra == "{}", F.col("details")).otherwise(F.concat(F.expr("substr(details, 1, length(details) - 1)"), F.lit(", "), F.substring(extra, 2, 1 << 30)))
    t = t.withColumn("related_feature_index", F.when(absorb, F.col("target"))).withColumn("details", merged)
    t = t.withColumn("repairable", (F.size("gc_path") == 0) & (F.array_contains("_d.detectionReasons", "Area") | absorb))
    return t.select([c.split(" ")[0] for c in FINDINGS.split(", ")])


def dry_run(features: DataFrame, options: Options = Options()) -> DryRun:
    """Runs all checks."""
    checked = written(check_features(features, options), "checked")
    flags = checked.drop("findings")
    own = checked.select(F.inline("findings"))
    components = written(component_table(features), "components")
    lines = written(line_table(features), "lines")
    sound = flags.where("not structural").select("feature_index")
    polygons = flags.where("not polygon_unsafe").select("feature_index")
    related = flags.where("not relation_unsafe").select("feature_index")
    kept = lambda t, which: t.join(which, "feature_index", "left_semi")
    # Each check's findings are written: one plan of all would be planned anew, as a whole, after each of its stages.
    every = own.where("check <> 'slivers'")
    every = every.unionByName(written(with_sliver_neighbours(own, kept(components, polygons)), "findings"))
    relations = written(kept(components, related), "related")
    for part in (overlap_findings, lambda c: gap_findings(c, options), neighbour_findings):
        every = every.unionByName(written(part(relations), "findings"))
    if lines.first() is not None:
        every = every.unionByName(written(line_findings(written(kept(lines, sound), "lines"), kept(components, sound), options), "findings"))
    place = F.array_position(F.array(*map(F.lit, CHECKS)), F.col("check"))
    every = every.withColumn("disposition", F.when(F.col("repairable") & F.col("failure").isNull(), AUTO).otherwise(MANUAL)).withColumn("_check", place)
    issues = numbered(every, ["_check", "feature_index", F.coalesce("gc_path", F.array().cast("array<int>")), F.coalesce("polygon_path", F.array().cast("array<int>")), "ord", "code"], "issue_index").drop("_check", "ord")
    return DryRun(written(issues, "issues"), flags, components, lines, options)


def group_members(issues: DataFrame) -> DataFrame:
    """(check, code, feature_index): the features of each issue group, related ones included."""
    return issues.select("check", "code", F.explode(F.array_compact(F.array("feature_index", "related_feature_index"))).alias("feature_index")).distinct()


def issue_groups(issues: DataFrame) -> DataFrame:
    """By check and code: counts, affected features, types, disposition ('Mixed' if there are both), first issue.

    Features are counted, not listed: ``group_members`` has them, a row each, as a group may hold the whole dataset.
    """
    keys = ["check", "code"]
    g = issues.groupBy(*keys).agg(F.count("*").alias("issue_count"), F.array_sort(F.collect_set("geometry_type")).alias("geometry_types"), F.min("disposition").alias("_a"), F.max("disposition").alias("_b"), F.min("issue_index").alias("first_issue"))
    members = group_members(issues).groupBy(*keys).agg(F.count("*").alias("affected_feature_count"))
    return g.join(members, keys).withColumn("disposition", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise("Mixed")).drop("_a", "_b")


def check_reports(run: DryRun) -> DataFrame:
    """One row a check: valid, issues, places (distinct rings, holes or parts that have issues), features, unresolved ones."""
    place = F.struct("feature_index", "gc_path", "coordinate_path", "polygon_path")
    own = run.issues.groupBy("check").agg(F.count("*").alias("issues"), F.countDistinct(place).alias("places"), F.countDistinct("feature_index").alias("features"), F.count_if(F.col("disposition") == AUTO).alias("auto_repairable"))
    known = run.issues.sparkSession.createDataFrame([(c, i) for i, c in enumerate(CHECKS)], "check string, position int")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("issues", "places", "features", "auto_repairable")}
    return known.join(F.broadcast(own), "check", "left").withColumns(zero).withColumn("valid", F.col("issues") == 0)


def code_counts(issues: DataFrame) -> DataFrame:
    """(check, code, n): findings of each code."""
    return issues.groupBy("check", "code").agg(F.count("*").alias("n"))


def unresolved_features(issues: DataFrame) -> DataFrame:
    """(check, feature_index): the features that each check leaves unresolved; a dry run resolves none."""
    return issues.select("check", "feature_index").distinct()


def summary(run: DryRun) -> DataFrame:
    """One row of counters; valid if there are no issues."""
    i = run.issues.agg(F.count("*").alias("issues"), F.count_if(F.col("disposition") == AUTO).alias("auto_repairable"), F.count_if(F.col("disposition") == MANUAL).alias("manual_review"), F.countDistinct("check", "code").alias("groups"), F.countDistinct("check").alias("failed_checks"))
    hit = run.issues.select("feature_index").union(run.issues.select("related_feature_index")).where("feature_index is not null").distinct().agg(F.count("*").alias("affected_features"))
    size = run.flags.agg(F.count("*").alias("features"))
    out = i.join(hit).join(size)  # one row each
    return out.withColumn("checks", F.lit(len(CHECKS))).withColumn("valid", F.col("issues") == 0)


def compact(issues: DataFrame) -> DataFrame:
    """Only what needs review, with the issues' own numbers and without details."""
    return issues.where(F.col("disposition") == MANUAL).withColumn("details", F.lit("{}"))

