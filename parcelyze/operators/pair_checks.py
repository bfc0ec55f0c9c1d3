"""Checks between features: overlaps, gaps, sliver neighbours, vertices of neighbours, line ends.

Candidates come from the spatial range join on (layer, box); exact geometry runs on candidate pairs only, in Arrow batches
(numpy over all pairs of a batch where it can be). What belongs to one pair, vertex or line end is then brought together
by an aggregate or a window. Null layers equal each other. Findings are in order of (component, ring, segment).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as k
from ..config import Options
from ..functions import planar
from ..functions.geometry import expand, haversine, line_length
from ..functions.geometry import segments as ring_segments
from ..tables import written
from .spatial_join import BOX, box_pairs

#: The ring number that stands for a line among targets.
LINE = -1


def _right(table: DataFrame) -> DataFrame:
    return table.select([F.col(c) if c in (*BOX, "layer") else F.col(c).alias(f"r_{c}") for c in table.columns])


def _with_box(df: DataFrame, box: list[Column]) -> DataFrame:
    return df.withColumns(dict(zip(BOX, box)))


def segment_table(components: DataFrame, exterior_only: bool = False) -> DataFrame:
    """One row for each segment of some length: component, ring, segment, ends and box."""
    c = components.select("feature_index", "feature_id", "layer", "component", "geometry_type", "gc_path", "polygon_path", F.posexplode(F.slice("rings", 1, 1) if exterior_only else F.col("rings")).alias("ring", "points"))
    s = c.select("*", F.inline(ring_segments(F.col("points")))).drop("points")
    return _with_box(s, [F.least("sx", "ex"), F.least("sy", "ey"), F.greatest("sx", "ex"), F.greatest("sy", "ey")])


def _schema(df: DataFrame, extra: str) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", " + extra


def _map(df: DataFrame, fn: Callable[[pd.DataFrame], dict], extra: str) -> DataFrame:
    """Adds computed columns; ``fn`` gives them for a batch."""
    names = [c.strip().split(" ")[0] for c in extra.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(**dict(zip(names, fn(pdf))))

    return df.mapInPandas(run, _schema(df, extra))


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals the few rows that need exact geometry over all tasks: their cost is CPU, not bytes."""
    return df.repartition(max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _point(pdf: pd.DataFrame, x: str, y: str) -> np.ndarray:
    return pdf[[x, y]].to_numpy(float)


def _lists(value) -> list:
    return [[list(p) for p in r] for r in value]


# ---- overlaps -------------------------------------------------------------------------------------------------


def overlaps(components: DataFrame) -> DataFrame:
    """(feature_index, r_feature_index, ..., overlap_m2, ratio, repairable): components of different features that share an area."""
    one = components.select("feature_index", "feature_id", "layer", "component", "geometry_type", "gc_path", "polygon_path", *BOX)
    pairs = box_pairs(one, _right(one), ["layer"]).where("component < r_component and feature_index <> r_feature_index")
    # Boxes that only touch hold no common area. Geometry is fetched for what is left.
    wide = F.least("maxx", "r_maxx") > F.greatest("minx", "r_minx")
    pairs = pairs.where(wide & (F.least("maxy", "r_maxy") > F.greatest("miny", "r_miny")))
    shape = components.select("component", "rings")
    pairs = pairs.join(shape, "component").join(shape.toDF("r_component", "r_rings"), "r_component")
    pairs = _spread(pairs, "component", "r_component")

    def measure(pdf: pd.DataFrame) -> list:
        out = [[], [], []]
        for a, b in zip(pdf["rings"], pdf["r_rings"]):
            a, b = _lists(a), _lists(b)
            area, one, two = planar.intersection_area(a, b), planar.polygon_area(a), planar.polygon_area(b)
            heights = {tuple(p[2:]) for rings in (a, b) for r in rings for p in r}
            out[0].append(area)
            out[1].append(area / min(one, two) if min(one, two) > 0 else None)
            out[2].append(len(heights) == 1 and area < max(one, two) * (1 - 1e-9))
        return out

    found = _map(pairs, measure, "overlap_m2 double, ratio double, flat boolean").where(F.col("overlap_m2") > k.OVERLAP_M2)
    top = (F.size("gc_path") == 0) & (F.size("r_gc_path") == 0)
    return found.withColumn("repairable", top & F.col("flat")).drop("rings", "r_rings", "flat")


# ---- gaps -----------------------------------------------------------------------------------------------------


def _frame(a: np.ndarray, b: np.ndarray, *points: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(length, [(along, across), ...]): metres of segments a-b, and of points about them."""
    every = np.stack([a, b, *points], axis=1)
    m = planar._local(every, every[:, :, 1].mean(axis=1))
    m = m - m[:, :1]
    length = np.hypot(m[:, 1, 0], m[:, 1, 1])
    x, y = (m[:, 1] / np.maximum(length, 1e-300)[:, None]).T
    return length, [(m[:, k, 0] * x + m[:, k, 1] * y, m[:, k, 1] * x - m[:, k, 0] * y) for k in range(2, m.shape[1])]


def _covered(length: np.ndarray, s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(middle, length) of what the interval between s and t covers of a segment; no length below 0."""
    begin, end = np.maximum(0.0, np.minimum(s, t)), np.minimum(length, np.maximum(s, t))
    return (begin + end) / 2, np.maximum(0.0, end - begin)


def _between(a: np.ndarray, b: np.ndarray, fraction: np.ndarray) -> np.ndarray:
    return a + (b - a) * np.clip(fraction, 0.0, 1.0)[:, None]


def _gap_numbers(gap_m: float) -> Callable[[pd.DataFrame], list]:
    """Distances between two segments, and evidence that they are one boundary: nearly parallel, long together, narrow apart."""

    def measure(pdf: pd.DataFrame) -> list:
        own, other = (_point(pdf, "sx", "sy"), _point(pdf, "ex", "ey")), (_point(pdf, "r_sx", "r_sy"), _point(pdf, "r_ex", "r_ey"))
        near, r_near, dist = planar.closest_between(*own, *other)
        length, ((s, off_s), (t, off_t)) = _frame(*own, *other)
        size = np.hypot(t - s, off_t - off_s)
        middle, shared = _covered(length, s, t)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = shared / np.minimum(length, size)
            tilt = np.degrees(np.arcsin(np.minimum(1.0, np.abs(off_t - off_s) / size)))
            here, there = _between(*own, middle / length), _between(*other, (middle - s) / (t - s))
            width = planar.haversine(here, there)
            slim = width / shared
            evidence = (np.minimum(length, size) > k.EPSILON) & (tilt <= k.GAP_MAX_ANGLE_DEG) & (shared > k.EPSILON) & (ratio >= k.GAP_MIN_SHARED_RATIO) & (width <= k.GAP_MAX_WIDTH_M) & (slim <= k.GAP_MAX_WIDTH_RATIO)
        # How far the ends are apart, in the better of the two ways to pair them.
        apart = [np.maximum(planar.haversine(own[0], x), planar.haversine(own[1], y)) for x, y in (other, other[::-1])]
        only = lambda x: np.where(evidence, x, np.nan)
        first, second = (np.where(evidence[:, None], x, y) for x, y in ((here, near), (there, r_near)))
        return [dist <= k.CONTACT_M, dist <= gap_m, evidence, np.where(evidence, width, dist), only(shared), only(ratio), only(slim), np.minimum(*apart), *first.T, *second.T]

    return measure


_GAP = "contact boolean, near boolean, evidence boolean, distance_m double, shared_m double, shared_ratio double, slim double, ends_m double, px double, py double, qx double, qy double"


def gaps(components: DataFrame, options: Options) -> DataFrame:
    """One row for each pair of components with a gap: the best place, its evidence, and whether it can be closed.

    A pair that touches anywhere has none. Evidence of a common boundary beats none, then the smaller distance.
    """
    seg = segment_table(components).withColumn("length_m", haversine(F.col("sx"), F.col("sy"), F.col("ex"), F.col("ey")))
    radius = F.greatest(F.lit(options.gap_m), F.least(F.lit(k.GAP_MAX_WIDTH_M), F.col("length_m") * k.GAP_MAX_WIDTH_RATIO))
    # The reach is that of the segment of the lower component.
    left = _with_box(seg, expand(*map(F.col, BOX), radius))
    right = _right(seg.select("feature_index", "layer", "component", "ring", "segment", "sx", "sy", "ex", "ey", *BOX))
    pairs = box_pairs(left.select("feature_index", "layer", "component", "ring", "segment", "sx", "sy", "ex", "ey", *BOX), right, ["layer"])
    pairs = pairs.where("component < r_component and feature_index <> r_feature_index").drop(*BOX, *[f"r_{b}" for b in BOX])
    # Touching pairs count whatever their evidence; others need a distance or evidence, above the least width.
    m = _map(pairs, _gap_numbers(options.gap_m), _GAP)
    kept = (F.col("near") | F.col("evidence")) & (F.col("distance_m") > options.tolerance_m + k.CONTACT_M)
    m = m.where(F.col("contact") | kept)
    order = F.struct(F.col("evidence").cast("int") * -1, "distance_m", "ring", "segment", "r_ring", "r_segment")
    value = F.struct("feature_index", "r_feature_index", "layer", "ring", "segment", "r_ring", "r_segment", "near", "evidence", "distance_m", "shared_m", "shared_ratio", "slim", "ends_m", "px", "py", "qx", "qy")
    best = m.groupBy("component", "r_component").agg(F.bool_or("contact").alias("touch"), F.min_by(value, order).alias("v")).where("not touch").select("component", "r_component", "v.*")
    shape = components.select("component", "feature_id", "geometry_type", "gc_path", "polygon_path", "rings")
    other = shape.select(*[F.col(c).alias(f"r_{c}") for c in shape.columns])
    best = best.join(shape, "component").join(other, "r_component")
    meet = lambda pdf: [[planar.polygons_meet(_lists(a), _lists(b)) for a, b in zip(pdf["rings"], pdf["r_rings"])]]
    best = _map(_spread(best, "component", "r_component"), meet, "meets boolean").where("not meets").drop("rings", "r_rings", "meets")
    best = written(best, "gaps")  # read again below, to count what edges are used for
    full = (F.col("ring") == 0) & (F.col("r_ring") == 0) & F.coalesce(F.col("shared_ratio") >= k.GAP_FULL_EDGE_RATIO, F.lit(False))
    close = (F.col("distance_m") <= options.gap_m) & (F.col("ends_m") <= options.gap_m)
    inferred = F.col("evidence") & (F.col("ends_m") <= k.GAP_MAX_WIDTH_M) & (F.col("ends_m") / F.col("shared_m") <= k.GAP_MAX_WIDTH_RATIO)
    best = best.withColumn("could", full & (close | F.coalesce(inferred, F.lit(False))))
    # An edge that could be moved to two places is moved to none.
    a = best.select(F.col("component").alias("c"), F.col("ring").alias("g"), F.col("segment").alias("s"))
    b = best.select(F.col("r_component").alias("c"), F.col("r_ring").alias("g"), F.col("r_segment").alias("s"))
    uses = a.union(b).groupBy("c", "g", "s").agg(F.count("*").alias("uses"))
    for side, name in (("", "uses_a"), ("r_", "uses_b")):
        u = uses.select(F.col("c").alias(f"{side}component"), F.col("g").alias(f"{side}ring"), F.col("s").alias(f"{side}segment"), F.col("uses").alias(name))
        best = best.join(u, [f"{side}component", f"{side}ring", f"{side}segment"])
    mode = F.when(F.col("near"), "Tolerance").otherwise("SharedBoundaryPattern")
    limit = F.when(close, F.lit(options.gap_m)).otherwise(F.lit(k.GAP_MAX_WIDTH_M))
    return best.withColumn("repairable", F.col("could") & (F.col("uses_a") == 1) & (F.col("uses_b") == 1)).withColumn("mode", mode).withColumn("limit_m", limit).drop("could", "uses_a", "uses_b")


# ---- slivers --------------------------------------------------------------------------------------------------


def _shared_edge(pdf: pd.DataFrame) -> list:
    """Metres of a segment along which another one runs, if both of its ends lie on the segment's line."""
    length, ((s, off_s), (t, off_t)) = _frame(_point(pdf, "sx", "sy"), _point(pdf, "ex", "ey"), _point(pdf, "r_sx", "r_sy"), _point(pdf, "r_ex", "r_ey"))
    on_line = (length > k.EPSILON) & (np.maximum(np.abs(off_s), np.abs(off_t)) <= k.NEIGHBOUR_M)
    return [np.where(on_line, _covered(length, s, t)[1], 0.0)]


def sliver_neighbours(slivers: DataFrame, components: DataFrame, min_shared: float = 0.4, dominance: float = 2.0, area_ratio: float = 10.0) -> DataFrame:
    """(component, target, shared_m, shared_ratio, dominance, area_ratio, absorb): each sliver's dominant neighbour.

    slivers: (component, feature_index, area_m2, perimeter_m); components: those that are safe for polygon checks.
    """
    seg = segment_table(components, exterior_only=True).select("feature_index", "layer", "component", "sx", "sy", "ex", "ey", *BOX)
    left = seg.join(slivers.select("component", "perimeter_m", "area_m2"), "component")
    left = _with_box(left, expand(*map(F.col, BOX), F.lit(k.NEIGHBOUR_M)))
    pairs = box_pairs(left, _right(seg), ["layer"]).where("feature_index <> r_feature_index").drop(*BOX, *[f"r_{b}" for b in BOX])
    edges = _map(pairs, _shared_edge, "shared double").where(F.col("shared") > k.NEIGHBOUR_M)
    near = edges.groupBy("component", "feature_index", F.col("r_feature_index").alias("target")).agg(F.sum("shared").alias("shared_m"), F.first("perimeter_m").alias("perimeter_m"), F.first("area_m2").alias("area_m2"))
    near = written(near.withColumn("shared_m", F.least("shared_m", "perimeter_m")), "near")
    whole = components.select("feature_index", "component", "rings").join(near.select(F.col("target").alias("feature_index")).distinct(), "feature_index", "left_semi")
    whole = whole.groupBy("feature_index").agg(F.collect_list("rings").alias("target_rings")).withColumnRenamed("feature_index", "target")
    near = near.join(components.select("component", "rings"), "component").join(whole, "target")

    def contact(pdf: pd.DataFrame) -> list:
        out = [[], []]
        for a, t in zip(pdf["rings"], pdf["target_rings"]):
            a, t = _lists(a), [_lists(p) for p in t]
            out[0].append(any(planar.polygons_meet(a, p) for p in t) and planar.shared_area([a], t) <= k.OVERLAP_M2)
            out[1].append(planar.area_of(t))
        return out

    near = _map(_spread(near, "component", "target"), contact, "edge_only boolean, target_m2 double").where("edge_only").drop("rings", "target_rings")
    order = Window.partitionBy("component").orderBy(F.col("shared_m").desc(), "target")
    ranked = near.withColumn("place", F.row_number().over(order)).withColumn("second_m", F.lead("shared_m").over(order)).where("place = 1")
    thin = slivers.select(F.col("feature_index").alias("target"), F.lit(True).alias("target_thin")).distinct()
    ranked = ranked.join(thin, "target", "left").withColumn("dominance", F.when(F.col("second_m") > 0, F.col("shared_m") / F.col("second_m")))
    ranked = ranked.withColumn("shared_ratio", F.col("shared_m") / F.col("perimeter_m")).withColumn("area_ratio", F.col("target_m2") / F.col("area_m2"))
    strong = F.col("target_thin").isNull() & (F.col("shared_ratio") >= min_shared) & (F.col("dominance").isNull() | (F.col("dominance") >= dominance)) & (F.col("area_ratio") >= area_ratio)
    return ranked.select("component", "target", "shared_m", "shared_ratio", "dominance", "area_ratio", strong.alias("absorb"))


# ---- neighbours' vertices ---------------------------------------------------------------------------------------


def _straight(pdf: pd.DataFrame) -> list:
    p, v, n = _point(pdf, "px", "py"), _point(pdf, "vx", "vy"), _point(pdf, "nx", "ny")
    _, t, off = planar.closest_on_segment(v, p, n)
    tol = k.NEIGHBOUR_M
    return [(off <= tol) & (planar.haversine(p, v) > tol) & (planar.haversine(v, n) > tol) & (t > 0) & (t < 1)]


def _on_edge(pdf: pd.DataFrame) -> list:
    p, v, n = _point(pdf, "px", "py"), _point(pdf, "vx", "vy"), _point(pdf, "nx", "ny")
    s, e = _point(pdf, "r_sx", "r_sy"), _point(pdf, "r_ex", "r_ey")
    tol = k.NEIGHBOUR_M
    near, t, off = planar.closest_on_segment(v, s, e)
    scale = np.stack([k.METRES_PER_DEGREE_LON * np.maximum(k.MIN_COSINE, np.cos(np.radians(v[:, 1]))), np.full(len(v), k.METRES_PER_DEGREE_LAT)], axis=1)
    a, b = (n - p) * scale, (e - s) * scale
    la, lb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        sine = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) / (la * lb)
        same = (la > tol) & (lb > tol) & (sine <= np.minimum(1.0, tol / np.minimum(la, lb)))
        size = planar.haversine(s, e)
        inner = (size > tol) & (t > tol / size) & (t < 1 - tol / size)
    return [(off <= tol) & same & inner, off, t, near[:, 0], near[:, 1]]


def neighbour_vertices(components: DataFrame) -> DataFrame:
    """One row for each straight vertex that lies on the inside of another feature's edge without a vertex there.

    The nearest edge is named; it can be repaired if it is the only one.
    """
    at = lambda i, c: F.get(F.get("ring", i), F.lit(c))
    c = components.select("feature_index", "feature_id", "layer", "component", "geometry_type", "gc_path", "polygon_path", F.get("rings", F.lit(0)).alias("ring"))
    n = F.size("ring") - 1
    corner = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("vertex"), at(F.pmod(i - 1, n), 0).alias("px"), at(F.pmod(i - 1, n), 1).alias("py"), at(i, 0).alias("vx"), at(i, 1).alias("vy"), at(F.pmod(i + 1, n), 0).alias("nx"), at(F.pmod(i + 1, n), 1).alias("ny")))
    v = c.where(n >= 3).select("feature_index", "feature_id", "layer", "component", "geometry_type", "gc_path", "polygon_path", F.inline(corner))
    v = _map(v, _straight, "straight boolean").where("straight").drop("straight")
    v = _with_box(v, expand(F.col("vx"), F.col("vy"), F.col("vx"), F.col("vy"), F.lit(k.NEIGHBOUR_M)))
    seg = segment_table(components, exterior_only=True)
    pairs = box_pairs(v, _right(seg.drop("ring")), ["layer"]).where("feature_index <> r_feature_index").drop(*BOX, *[f"r_{b}" for b in BOX])
    hit = _map(pairs, _on_edge, "hit boolean, offset_m double, fraction double, ix double, iy double").where("hit").drop("hit")
    order = Window.partitionBy("component", "vertex").orderBy("offset_m", "r_feature_index", "r_component", "r_segment")
    every = Window.partitionBy("component", "vertex")
    hit = hit.withColumn("place", F.row_number().over(order)).withColumn("targets", F.count("*").over(every)).where("place = 1").drop("place")
    return hit.withColumn("repairable", F.col("targets") == 1)


# ---- lines ----------------------------------------------------------------------------------------------------


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def _grouped(df: DataFrame, keys: list[str], fn: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """One call of ``fn`` for each group of rows with equal keys, streamed from sorted partitions. Groups are small and many:
    rows are plain dicts, as a table for each group would cost far more than what is done with it."""
    kinds = pa.schema([(n, _ARROW[t]) for n, t in (c.strip().split(" ") for c in schema.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        at = None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                key = [row[k] for k in keys]
                if key != at and held:
                    out += fn(held)
                    held = []
                at = key
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
        if held and (out := fn(held)):
            yield pa.RecordBatch.from_pylist(out, kinds)

    return _spread(df, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


_END = "part long, endpoint string, code string, target_part long, target_ring int, is_line boolean, r_segment int, source_segment int, tx double, ty double, fraction double, distance_m double, mode string, sure boolean"


def _line_end(options: Options) -> Callable[[list[dict]], list[dict]]:
    tol, contact = options.tolerance_m, k.CONTACT_M

    def order(c: dict) -> tuple:  # lines before boundaries
        return c["distance_m"], not c["is_line"], c["target_part"], c["target_ring"], c["r_segment"]

    def within(cand: list[dict]) -> list[float]:
        return [c["distance_m"] for c in cand if c["is_line"] and c["distance_m"] <= c["reach_m"]]

    def sure(cand: list[dict], best: dict, lines: list[float]) -> bool:
        apart = planar.haversine(np.array([[c["tx"], c["ty"]] for c in cand], float), np.array([best["tx"], best["ty"]], float))
        return all(far <= contact or c["distance_m"] - best["distance_m"] > tol for far, c in zip(apart.tolist(), cand)) and all(x >= best["distance_m"] - contact for x in lines)

    def result(c: dict, code: str, mode: str, ok: bool) -> list[dict]:
        names = ("part", "endpoint", "target_part", "target_ring", "is_line", "r_segment", "source_segment", "tx", "ty", "fraction", "distance_m")
        return [{n: c[n] for n in names} | {"code": code, "mode": mode, "sure": ok}]

    def solve(g: list[dict]) -> list[dict]:
        over, near, ray = ([c for c in g if c["probe"] == p] for p in ("terminal", "point", "ray"))
        lines = within(over)
        over = [c for c in over if contact < c["distance_m"] <= (tol if c["is_line"] else c["reach_m"]) and c["distance_m"] < c["length_m"] - c["distance_m"]]
        if over:
            best = min(over, key=lambda c: (*order(c), c["source_segment"]))
            near_enough = best["distance_m"] <= tol
            return result(best, "LINE_OVERSHOOT", "Tolerance" if near_enough else "DirectionalBoundaryPattern", near_enough or sure(over, best, lines))
        if any(c["distance_m"] <= contact for c in near):
            return []
        near = [c for c in near if c["distance_m"] <= tol]
        if near:
            return result(min(near, key=order), "LINE_UNDERSHOOT", "Tolerance", True)
        lines = within(ray)
        ray = [c for c in ray if not c["is_line"] and contact < c["distance_m"] <= c["reach_m"]]
        if not ray:
            return []
        best = min(ray, key=order)
        return result(best, "LINE_UNDERSHOOT", "DirectionalBoundaryPattern", sure(ray, best, lines))

    return solve


def _probe_numbers(pdf: pd.DataFrame) -> list:
    a, b, c, e = _point(pdf, "ax", "ay"), _point(pdf, "bx", "by"), _point(pdf, "r_sx", "r_sy"), _point(pdf, "r_ex", "r_ey")
    is_point = (pdf["probe"] == "point").to_numpy()
    near, t, dist = planar.closest_on_segment(a, c, e)
    at, u, w = planar.crossing(a, b, c, e)
    terminal = (pdf["probe"] == "terminal").to_numpy()
    # A terminal segment runs from the line's end inwards: what lies before the crossing is the overrun.
    run = np.where(terminal, pdf["before_m"].to_numpy() + planar.haversine(a, b) * u, planar.haversine(a, at))
    pos = np.where(is_point[:, None], near, at)
    return [np.where(is_point, dist, run), pos[:, 0], pos[:, 1], np.where(is_point, t, w)]


def line_ends(lines: DataFrame, components: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """(overshoots, undershoots) of lines against other lines and polygon boundaries of their layer.

    lines, components: those that are structurally sound. Each end gets at most one finding; an overshoot goes before an undershoot;
    two ends that miss each other are one finding, that of the first.
    """
    at = lambda i, c: F.get(F.get("line", i), F.lit(c))
    n = F.size("line")
    parts = lines.withColumn("length_m", line_length(F.col("line")))
    reach = F.greatest(F.lit(options.tolerance_m), F.least(F.lit(k.LINE_MAX_ERROR_M), F.col("length_m") * k.LINE_MAX_ERROR_RATIO))
    parts = parts.withColumn("reach_m", reach).select("part", "layer", "line", "length_m", "reach_m")
    both = parts.withColumn("endpoint", F.explode(F.array(F.lit("end"), F.lit("start"))))
    both = both.withColumn("line", F.when(F.col("endpoint") == "end", F.reverse("line")).otherwise(F.col("line")))
    # From the end inwards: segments that begin within reach, with the distance before each.
    step = lambda i: haversine(at(i, 0), at(i, 1), at(i + 1, 0), at(i + 1, 1))
    walk = F.aggregate(F.sequence(F.lit(0), n - 2), F.array(F.lit(0.0)), lambda acc, i: F.concat(acc, F.array(F.element_at(acc, -1) + step(i))))
    term = both.withColumn("walk", walk).select("part", "layer", "endpoint", "length_m", "reach_m", "line", F.posexplode("walk").alias("i", "before_m")).where((F.col("i") < n - 1) & (F.col("before_m") <= F.col("reach_m")))
    source = F.when(F.col("endpoint") == "start", F.col("i")).otherwise(n - 2 - F.col("i"))
    base = ["part", "layer", "endpoint", "length_m", "reach_m"]
    ends = [at(F.col("i"), 0).alias("ax"), at(F.col("i"), 1).alias("ay"), at(F.col("i") + 1, 0).alias("bx"), at(F.col("i") + 1, 1).alias("by")]
    term = term.select(*base, F.lit("terminal").alias("probe"), source.cast("int").alias("source_segment"), "before_m", *ends)
    tip = both.withColumn("i", F.lit(0)).select(*base, *ends).withColumn("last_m", haversine(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    zero = [F.lit(None).cast("int").alias("source_segment"), F.lit(0.0).alias("before_m")]
    point = tip.select(*base, F.lit("point").alias("probe"), *zero, "ax", "ay", F.col("ax").alias("bx"), F.col("ay").alias("by"))
    out = lambda a, b: (F.col(a) + (F.col(a) - F.col(b)) * F.col("reach_m") / F.col("last_m")).alias(b)
    ray = tip.where(F.col("last_m") > k.EPSILON).select(*base, F.lit("ray").alias("probe"), *zero, "ax", "ay", out("ax", "bx"), out("ay", "by"))
    probes = term.unionByName(point).unionByName(ray)
    probes = _with_box(probes, [F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by")])
    wide = expand(*map(F.col, BOX), F.lit(options.tolerance_m))
    probes = _with_box(probes, [F.when(F.col("probe") == "point", w).otherwise(F.col(b)) for w, b in zip(wide, BOX)])

    line_seg = lines.select("feature_index", "layer", F.col("part").alias("target_part"), F.lit(LINE).alias("target_ring"), F.lit(True).alias("is_line"), F.inline(ring_segments(F.col("line"))))
    poly = segment_table(components).select("feature_index", "layer", F.col("component").alias("target_part"), F.col("ring").alias("target_ring"), F.lit(False).alias("is_line"), "segment", "sx", "sy", "ex", "ey")
    targets = line_seg.unionByName(poly)
    targets = _with_box(targets, [F.least("sx", "ex"), F.least("sy", "ey"), F.greatest("sx", "ex"), F.greatest("sy", "ey")])
    keep = {"target_part", "target_ring", "is_line"}
    right = targets.select([F.col(c) if c in (*BOX, "layer", *keep) else F.col(c).alias(f"r_{c}") for c in targets.columns])
    pairs = box_pairs(probes, right, ["layer"]).where("not (is_line and target_part = part)").drop(*BOX, *[f"r_{b}" for b in BOX])
    met = _map(pairs, _probe_numbers, "distance_m double, tx double, ty double, fraction double").where("distance_m is not null and not isnan(distance_m)")
    found = _grouped(met.drop("layer", "ax", "ay", "bx", "by", "before_m", "r_feature_index"), ["part", "endpoint"], _line_end(options), _END)
    found = written(found, "ends")  # both results read it
    is_line = F.col("is_line")
    over = found.where("code = 'LINE_OVERSHOOT'")
    over = over.withColumn("repairable", (F.col("distance_m") <= options.tolerance_m) | (~is_line & F.col("sure")))
    under = found.where("code = 'LINE_UNDERSHOOT'").join(lines.select("part", "line"), "part")
    # The same two ends may name each other.
    mine = F.when(F.col("endpoint") == "start", F.lit(0)).otherwise(n - 1)
    theirs = F.when(F.col("fraction") <= k.ENDPOINT_FRACTION, F.col("r_segment")).when(F.col("fraction") >= 1 - k.ENDPOINT_FRACTION, F.col("r_segment") + 1)
    under = under.withColumn("a", F.struct(F.col("part").alias("p"), mine.alias("v"))).withColumn("b", F.when(is_line & theirs.isNotNull(), F.struct(F.col("target_part").alias("p"), theirs.alias("v"))))
    pair = F.when(F.col("b").isNotNull(), F.struct(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")))
    first = Window.partitionBy("pair").orderBy("part", F.col("endpoint").desc())
    under = under.withColumn("pair", pair).withColumn("place", F.when(F.col("pair").isNull(), 1).otherwise(F.row_number().over(first))).where("place = 1")
    inner = F.when(F.col("endpoint") == "start", F.lit(1)).otherwise(n - 2)
    stays = (at(inner, 0) != F.col("tx")) | (at(inner, 1) != F.col("ty"))
    under = under.withColumn("repairable", ((F.col("distance_m") <= options.tolerance_m) | (~is_line & F.col("sure"))) & stays)
    return over, under.drop("line", "a", "b", "pair", "place")


# ---- duplicates -------------------------------------------------------------------------------------------------


def duplicate_polygons(components: DataFrame, max_offset_m: float = 0.01, min_iou: float = 0.9, margin: float = 2.0) -> DataFrame:
    """(feature_index, r_feature_index, kind, offset_m): equal, rearranged or nearly equal polygons of one layer.

    Features are compared with all their components; a collection only if it has just one. Exact: the same positions in
    the same order within 1e-9 degrees.
    """
    one = components.groupBy("feature_index").agg(
        F.first("layer").alias("layer"), F.array_sort(F.collect_list(F.struct("component", "rings"))).alias("parts"), F.max(F.size("gc_path")).alias("gc"),
        *(f(b).alias(b) for f, b in zip((F.min, F.min, F.max, F.max), BOX)),
    ).where("size(parts) = 1 or gc <= 0").select("feature_index", "layer", F.col("parts.rings").alias("polygons"), *BOX)
    one = written(one, "polygons")
    grow = max_offset_m / k.METRES_PER_DEGREE_LON * margin
    boxes = one.drop("polygons")
    left = _with_box(boxes, [F.col(b) + (grow if i > 1 else -grow) for i, b in enumerate(BOX)])
    pairs = box_pairs(left, _right(boxes), ["layer"]).where("feature_index < r_feature_index")
    close = [F.abs(F.col(b) - F.col(f"r_{b}")) <= 2 * grow for b in BOX]
    shape = one.select("feature_index", "polygons")
    pairs = pairs.where(close[0] & close[1] & close[2] & close[3]).join(shape, "feature_index").join(shape.toDF("r_feature_index", "r_polygons"), "r_feature_index")

    def compare(pdf: pd.DataFrame) -> list:
        kinds, offsets = [], []
        for first, second in zip(pdf["polygons"], pdf["r_polygons"]):
            first, second = [_lists(x) for x in first], [_lists(x) for x in second]
            one, two = sum(map(planar.polygon_area, first)), sum(map(planar.polygon_area, second))
            a, b = [r for x in first for r in x], [r for x in second for r in x]
            kind, off = None, None
            if one > 0 and two > 0:
                same = len(a) == len(b) and abs(one - two) / max(one, two) <= 1e-9
                if same and all(len(r) == len(s) and np.abs(np.array([p[:2] for p in r]) - np.array([p[:2] for p in s])).max() <= 1e-9 for r, s in zip(a, b)):
                    kind = "Exact"
                elif same and all(planar.signature(r, 9) == planar.signature(s, 9) for r, s in zip(a, b)):
                    kind = "Topological"
                else:
                    common = planar.shared_area(first, second)
                    every = one + two - common
                    around = (planar.perimeter(a) + planar.perimeter(b)) / 2
                    off = (every - common) / around if around else 0.0
                    if common / every >= min_iou and off <= max_offset_m:
                        kind = "Near"
            kinds.append(kind)
            offsets.append(off if kind == "Near" else None)
        return [kinds, offsets]

    return _map(_spread(pairs, "feature_index", "r_feature_index"), compare, "kind string, offset_m double").where("kind is not null").select("feature_index", "r_feature_index", "kind", "offset_m")

