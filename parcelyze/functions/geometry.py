"""Geometry as column expressions: positions are arrays of doubles, rings arrays of positions.

All of it stays in the JVM (higher-order functions), so scans, filters and aggregates around it keep their plans.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EARTH_RADIUS_M, MAX_LATITUDE, METRES_PER_DEGREE_LAT, METRES_PER_DEGREE_LON, MIN_COSINE


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two positions in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    dlat, dlon = F.sin((b - a) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = dlat * dlat + F.cos(a) * F.cos(b) * dlon * dlon
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def normal_position(position: Column) -> Column:
    """A position as a join or grouping key: -0 becomes 0."""
    return F.transform(position, lambda v: v + F.lit(0.0))


def ring_area(ring: Column) -> Column:
    """Square metres on the sphere inside a closed ring, unsigned."""
    n = F.size(ring) - 1
    lon = lambda i: F.radians(F.get(F.get(ring, F.pmod(i, n)), F.lit(0)))
    lat = lambda i: F.radians(F.get(F.get(ring, F.pmod(i, n)), F.lit(1)))
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + (lon(i + 1) - lon(i - 1)) * F.sin(lat(i)))
    return F.when(n > 2, F.abs(total) * (EARTH_RADIUS_M * EARTH_RADIUS_M / 2)).otherwise(F.lit(0.0))


def polygon_area(rings: Column) -> Column:
    """The exterior's area without its holes'."""
    holes = F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), F.lit(0.0), lambda acc, r: acc + ring_area(r))
    return ring_area(F.get(rings, F.lit(0))) - holes


def line_length(line: Column) -> Column:
    """Metres along a line or ring."""
    at = lambda i, k: F.get(F.get(line, i), F.lit(k))
    steps = F.when(F.size(line) > 1, F.sequence(F.lit(1), F.size(line) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + haversine(at(i - 1, 0), at(i - 1, 1), at(i, 0), at(i, 1)))


def perimeter(rings: Column) -> Column:
    """Metres along all rings."""
    return F.aggregate(rings, F.lit(0.0), lambda acc, r: acc + line_length(r))


def compactness(area: Column, around: Column) -> Column:
    """1 for a circle, near 0 for slivers; null for a perimeter of 0."""
    return F.when(around > 0, F.lit(4 * 3.141592653589793) * area / (around * around))


def signed_area2(ring: Column) -> Column:
    """Twice the planar signed area relative to the first vertex, by compensated summation."""
    x0, y0 = F.get(F.get(ring, F.lit(0)), F.lit(0)), F.get(F.get(ring, F.lit(0)), F.lit(1))
    at = lambda i, k, o: F.get(F.get(ring, i), F.lit(k)) - o
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("lost"))

    def add(acc: Column, i: Column) -> Column:
        term = at(i - 1, 0, x0) * at(i, 1, y0) - at(i, 0, x0) * at(i - 1, 1, y0)
        y = term - acc["lost"]
        t = acc["total"] + y
        return F.struct(t.alias("total"), ((t - acc["total"]) - y).alias("lost"))

    steps = F.when(F.size(ring) > 1, F.sequence(F.lit(1), F.size(ring) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, add, lambda acc: acc["total"])


def orientation(ring: Column) -> Column:
    """'ccw', 'cw' or 'indeterminate'."""
    area = signed_area2(ring)
    return F.when(F.isnan(area) | (F.abs(area) == float("inf")) | (area == 0), "indeterminate").when(area > 0, "ccw").otherwise("cw")


def bounds(positions: Column) -> Column:
    """struct(minx, miny, maxx, maxy) of an array of positions."""
    xs, ys = F.transform(positions, lambda p: F.get(p, F.lit(0))), F.transform(positions, lambda p: F.get(p, F.lit(1)))
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def expand(minx: Column, miny: Column, maxx: Column, maxy: Column, metres: Column) -> list[Column]:
    """Bounds that are wider by so many metres on each side."""
    lat = F.least(F.greatest(F.abs(miny), F.abs(maxy)), F.lit(MAX_LATITUDE))
    dx = metres / (METRES_PER_DEGREE_LON * F.greatest(F.lit(MIN_COSINE), F.cos(F.radians(lat))))
    dy = metres / METRES_PER_DEGREE_LAT
    return [minx - dx, miny - dy, maxx + dx, maxy + dy]


def is_closed_ring(ring: Column) -> Column:
    """At least four finite positions, the first equal to the last."""
    finite = F.forall(ring, lambda p: (F.size(p) >= 2) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    return (F.size(ring) >= 4) & finite & (normal_position(F.get(ring, F.lit(0))) == normal_position(F.element_at(ring, -1)))


def segments(ring: Column) -> Column:
    """array of struct(segment, sx, sy, ex, ey) between consecutive vertices, without those of length 0."""
    at = lambda i, k: F.get(F.get(ring, i), F.lit(k))
    every = F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.struct(i.alias("segment"), at(i, 0).alias("sx"), at(i, 1).alias("sy"), at(i + 1, 0).alias("ex"), at(i + 1, 1).alias("ey")))
    return F.filter(every, lambda s: (s["sx"] != s["ex"]) | (s["sy"] != s["ey"]))
