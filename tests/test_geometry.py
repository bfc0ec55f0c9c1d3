"""Geometry kernels and column expressions."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from parcelyze.functions import geometry as g
from parcelyze.functions import planar as p
from parcelyze.operators.feature_checks import decimal_places, to_places
from parcelyze.sources import crs
from pyspark.sql import functions as F


def box(x, y, w, h):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]


def flat(polygons):
    return sum((1 if i == 0 else -1) * abs(p.signed_area2(r)) / 2 for poly in polygons for i, r in enumerate(poly))


@pytest.mark.parametrize("op,area", [("intersection", 1), ("union", 7), ("difference", 3), ("xor", 6)])
def test_overlay_of_squares(op, area):
    assert math.isclose(flat(p.overlay([[box(0, 0, 2, 2)]], [[box(1, 1, 2, 2)]], op)), area)


def test_overlay_makes_and_fills_holes():
    a, b = [box(0, 0, 2, 2)], [box(0.5, 0.5, 1, 1)]
    ring = p.overlay([a], [b], "difference")
    assert len(ring) == 1 and len(ring[0]) == 2 and math.isclose(flat(ring), 3)
    assert p.overlay(ring, [b], "union") == p.overlay([a], [a], "union")


def test_neighbours_share_no_area_and_join_to_one():
    a, b = [box(0, 0, 2, 2)], [box(2, 0, 1, 2)]
    assert flat(p.overlay([a], [b], "intersection")) == 0
    joined = p.overlay([a], [b], "union")
    assert len(joined) == 1 and len(joined[0]) == 1 and math.isclose(flat(joined), 6)
    assert p.polygons_meet(a, b) and not p.polygons_meet(a, [box(5, 5, 1, 1)])


def test_overlays_add_up_on_random_polygons():
    rng = random.Random(0)

    def blob(cx, cy):
        angles = sorted(rng.random() * 2 * math.pi for _ in range(rng.randint(3, 20)))
        ring = [[51 + cx + 0.001 * (0.3 + rng.random()) * math.cos(a), 35 + cy + 0.001 * (0.3 + rng.random()) * math.sin(a)] for a in angles]
        return [[*ring, ring[0]]]

    for _ in range(60):
        a, b = blob(0, 0), blob(0.0005, 0.0003)
        if not (p.simple(a[0]) and p.simple(b[0])):
            continue
        both, either, one, rest = (flat(p.overlay([a], [b], op)) for op in ("intersection", "union", "xor", "difference"))
        size_a, size_b = flat([a]), flat([b])
        assert abs(both + either - size_a - size_b) < 1e-12 and abs(one - (either - both)) < 1e-12 and abs(rest - (size_a - both)) < 1e-12


def test_ring_crossings():
    assert [x[:3] for x in p.ring_crossings([[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]])] == [(0, 2, "Crossing")]
    assert p.ring_crossings([[0, 0], [4, 0], [4, 4], [2, 0], [0, 4], [0, 0]])[0][2] == "Touching"
    assert p.ring_crossings([[0, 0], [4, 0], [4, 2], [3, 0], [1, 0], [0, 2], [0, 0]])[0][2] in ("Touching", "Overlapping")
    assert p.simple(box(0, 0, 1, 1))


def test_containment():
    outer = box(0, 0, 4, 4)
    assert [p.containment(box(*b), outer) for b in ((1, 1, 1, 1), (0, 1, 1, 1), (3, 1, 2, 1), (5, 5, 1, 1))] == ["inside", "touching", "outside", "outside"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=9), st.integers(0, 8), st.booleans())
def test_signature_ignores_start_and_direction(ring, k, turn):
    k %= len(ring)
    other = ring[k:] + ring[:k]
    assert p.signature([*map(list, ring), list(ring[0])]) == p.signature([*map(list, other[::-1] if turn else other), list((other[::-1] if turn else other)[0])])


def test_segment_distances():
    a, b, c, d = (np.array([v], float) for v in ([51, 35], [51.001, 35], [51.0005, 35.001], [51.0005, 35.002]))
    u, w, m = p.closest_between(a, b, c, d)
    assert np.allclose(u, [[51.0005, 35]]) and np.allclose(w, c) and math.isclose(m[0], float(p.haversine(u[0], w[0])))
    assert p.closest_between(a, b, np.array([[51.0005, 34.9]]), d)[2][0] == 0


def test_columns_agree_with_kernels(spark):
    rings = [box(51, 35, 0.001, 0.002), box(51, 35, 0.003, 0.0001)[::-1], [[51, 35], [51.1, 35.02], [51.03, 35.09], [51, 35]]]
    df = spark.createDataFrame([(i, [[[float(v) for v in q] for q in r]]) for i, r in enumerate(rings)], "i long, rings array<array<array<double>>>")
    ring = F.get("rings", F.lit(0))
    got = df.select("i", g.polygon_area(F.col("rings")), g.perimeter(F.col("rings")), g.orientation(ring), g.is_closed_ring(ring), F.size(g.segments(ring))).orderBy("i").collect()
    for r, (_, area, around, turn, closed, n) in zip(rings, got):
        assert math.isclose(area, p.ring_area(r), rel_tol=1e-9) and math.isclose(around, p.perimeter([r]), rel_tol=1e-12) and turn == p.orientation(r) and closed and n == len(r) - 1


def test_rounding_is_of_the_exact_value():
    assert to_places(1.005, 2) == 1.0 and to_places(2.5, 0) == 3.0 and to_places(-0.0001, 2) == 0.0 and to_places(1e22, 3) == 1e22
    assert decimal_places(1e-10) == 10 and decimal_places(51.5) == 1 and decimal_places(100.0) == 0


def test_coordinate_systems():
    assert np.allclose(crs.to_wgs84(500000, 0, "EPSG:32639"), (51, 0))
    for lon, lat, code in ((51.3, 35.7, "EPSG:32639"), (151.2, -33.8, "EPSG:32756"), (51.3, 35.7, "EPSG:3857")):
        assert np.allclose(crs.to_wgs84(*crs.from_wgs84(lon, lat, code), code), (lon, lat), atol=1e-11)
    for bad in ("EPSG:2154", "WGS84", "", None):
        with pytest.raises(ValueError):
            crs.parse(bad)


def test_segments_meet_as_plain_fractions_say():
    """Against exact rational arithmetic on small whole coordinates."""
    from fractions import Fraction

    rng = random.Random(3)

    def plain(a, b, c, d):
        cross = lambda u, v: u[0] * v[1] - u[1] * v[0]
        sub = lambda u, v: (u[0] - v[0], u[1] - v[1])
        r, s, q = sub(b, a), sub(d, c), sub(c, a)
        if cross(r, s):
            t, u = Fraction(cross(q, s), cross(r, s)), Fraction(cross(q, r), cross(r, s))
            return None if not (0 <= t <= 1 and 0 <= u <= 1) else "Crossing" if 0 < t < 1 and 0 < u < 1 else "Touching"
        if cross(q, r):
            return None
        k = 0 if r[0] else 1
        lo, hi = max(min(a[k], b[k]), min(c[k], d[k])), min(max(a[k], b[k]), max(c[k], d[k]))
        return None if hi < lo else "Touching" if hi == lo else "Overlapping"

    pairs = []
    while len(pairs) < 4000:
        v = [(rng.randint(0, 4), rng.randint(0, 4)) for _ in range(4)]
        if v[0] != v[1] and v[2] != v[3]:
            pairs.append(v)
    kind, at, to = p.meetings(*(np.array([v[k] for v in pairs], float) for k in range(4)))
    assert [p.MEETINGS[k] for k in kind] == [plain(*v) for v in pairs]
    for v, k, x, y in zip(pairs, kind, at, to):
        if k:
            assert p.closest_on_segment(np.array([x]), np.array([v[0]], float), np.array([v[1]], float))[2][0] < 1e-6
            assert p.closest_on_segment(np.array([x]), np.array([v[2]], float), np.array([v[3]], float))[2][0] < 1e-6
        if k == p.OVERLAPPING:
            assert (x != y).any() and ((y - x) @ (np.array(v[1]) - v[0])) > 0
