"""Geometry kernels in numpy: what column expressions cannot say about rings, segments and polygons.

Positions are (lon, lat, ...) in degrees. Distances and areas are on the sphere; overlays and contacts are planar in
degrees.
"""

from __future__ import annotations

import math

import numpy as np

from ..config import EARTH_RADIUS_M, EPSILON, MAX_LATITUDE, METRES_PER_DEGREE_LAT, METRES_PER_DEGREE_LON, MIN_COSINE

_TOL = EPSILON * 64


# ---- distances and areas --------------------------------------------------------------------------------------


def haversine(a, b) -> np.ndarray:
    """Metres between positions (arrays of lon, lat in the last axis)."""
    a, b = np.radians(np.asarray(a, float)[..., :2]), np.radians(np.asarray(b, float)[..., :2])
    h = np.sin((b[..., 1] - a[..., 1]) / 2) ** 2 + np.cos(a[..., 1]) * np.cos(b[..., 1]) * np.sin((b[..., 0] - a[..., 0]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def ring_area(ring) -> float:
    """Square metres inside a closed ring."""
    p = np.radians(np.asarray([q[:2] for q in ring[:-1]], float))
    if len(p) < 3:
        return 0.0
    lon, lat = p[:, 0], p[:, 1]
    around = np.concatenate((lon[-1:], lon, lon[:1]))
    return float(abs(np.sum((around[2:] - around[:-2]) * np.sin(lat))) * EARTH_RADIUS_M**2 / 2)


def polygon_area(rings) -> float:
    return ring_area(rings[0]) - sum(map(ring_area, rings[1:]))


def perimeter(rings) -> float:
    return float(sum(haversine([q[:2] for q in r[:-1]], [q[:2] for q in r[1:]]).sum() for r in rings if len(r) > 1))


def line_length(line) -> float:
    return perimeter([line])


def signed_area2(ring) -> float:
    """Twice the planar signed area about the first vertex; exactly rounded sums."""
    x0, y0 = ring[0][:2]
    terms = []
    for p, q in zip(ring, ring[1:]):
        terms.append((p[0] - x0) * (q[1] - y0))
        terms.append(-(q[0] - x0) * (p[1] - y0))
    return math.fsum(terms)


def orientation(ring) -> str:
    area = signed_area2(ring)
    return "indeterminate" if area == 0 or not math.isfinite(area) else "ccw" if area > 0 else "cw"


def expand(box: np.ndarray, metres) -> np.ndarray:
    """Boxes (..., 4) wider by metres on each side."""
    lat = np.minimum(np.maximum(np.abs(box[..., 1]), np.abs(box[..., 3])), MAX_LATITUDE)
    dx = metres / (METRES_PER_DEGREE_LON * np.maximum(MIN_COSINE, np.cos(np.radians(lat))))
    dy = metres / METRES_PER_DEGREE_LAT
    return np.stack([box[..., 0] - dx, box[..., 1] - dy, box[..., 2] + dx, box[..., 3] + dy], axis=-1)


def _local(points: np.ndarray, origin_lat: np.ndarray) -> np.ndarray:
    """(n, k, 2) degrees -> metres about the first point of each row, at one latitude a row."""
    scale = np.radians(1.0) * EARTH_RADIUS_M
    x = (points[:, :, 0] - points[:, :1, 0]) * scale * np.cos(np.radians(origin_lat))[:, None]
    return np.stack([x, (points[:, :, 1] - origin_lat[:, None]) * scale], axis=-1)


def closest_on_segment(p, a, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, fraction, metres) of the points of segments a-b nearest to p; all (n, 2)."""
    pts = np.stack([p, a, b], axis=1).astype(float)
    m = _local(pts, pts[:, :, 1].mean(axis=1))
    d = m[:, 2] - m[:, 1]
    size = (d * d).sum(axis=1)
    t = np.where(size <= EPSILON, 0.0, np.clip(((m[:, 0] - m[:, 1]) * d).sum(axis=1) / np.maximum(size, EPSILON), 0, 1))
    near = pts[:, 1] + (pts[:, 2] - pts[:, 1]) * t[:, None]
    return near, t, haversine(pts[:, 0], near)


def closest_between(a, b, c, d) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point on a-b, point on c-d, metres): nearest points of segment pairs; all (n, 2).

    The nearest pair of two segments that do not cross has an end of one of them; crossing ones meet.
    """
    a, b, c, d = (np.asarray(v, float) for v in (a, b, c, d))
    best, u, w = np.full(len(a), np.inf), a.copy(), c.copy()
    for flip, (p, s, e) in ((False, (a, c, d)), (False, (b, c, d)), (True, (c, a, b)), (True, (d, a, b))):
        near, _, dist = closest_on_segment(p, s, e)
        better = dist < best
        best = np.where(better, dist, best)
        mine, other = (near, p) if flip else (p, near)
        u, w = np.where(better[:, None], mine, u), np.where(better[:, None], other, w)
    at, t, s = crossing(a, b, c, d)
    hit = ~np.isnan(t)
    u, w = np.where(hit[:, None], at, u), np.where(hit[:, None], at, w)
    return u, w, np.where(hit, 0.0, best)


def crossing(a, b, c, d) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, fraction on a-b, fraction on c-d) where segments that are not parallel meet; NaN elsewhere."""
    a, b, c, d = (np.asarray(v, float) for v in (a, b, c, d))
    r, s, q = b - a, d - c, c - a
    den = r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]
    scale = np.maximum(np.abs(r[:, 0] * s[:, 1]), np.abs(r[:, 1] * s[:, 0]))
    ok = np.abs(den) > _TOL * np.maximum(scale, 5e-324)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(ok, (q[:, 0] * s[:, 1] - q[:, 1] * s[:, 0]) / den, np.nan)
        u = np.where(ok, (q[:, 0] * r[:, 1] - q[:, 1] * r[:, 0]) / den, np.nan)
        inside = (t >= -2 * _TOL) & (t <= 1 + 2 * _TOL) & (u >= -2 * _TOL) & (u <= 1 + 2 * _TOL)
    t, u = np.where(inside, np.clip(t, 0, 1), np.nan), np.where(inside, np.clip(u, 0, 1), np.nan)
    return a + r * t[:, None], t, u


# ---- rings ----------------------------------------------------------------------------------------------------


_FEW = 24


def _far_boxes_meet(ring) -> bool:
    """Whether segments of a short ring that are no neighbours have boxes that meet, as in ``ring_crossings``."""
    line = [(float(q[0]), float(q[1])) for q in ring]
    box = [(min(a, c), min(b, d), max(a, c), max(b, d)) for (a, b), (c, d) in zip(line, line[1:]) if a != c or b != d]
    last = len(box) - 1
    for i in range(last - 1):
        x0, y0, x1, y1 = box[i]
        for j in range(i + 2, last if i == 0 else last + 1):
            u0, v0, u1, v1 = box[j]
            if u0 <= x1 and x0 <= u1 and v0 <= y1 and y0 <= v1:
                return True
    return False


def ring_crossings(ring) -> list[tuple[int, int, str, list]]:
    """(first segment, second segment, kind, where) of segments that meet without being neighbours.

    kind: Crossing, Touching or Overlapping; where: a point, or the two ends of the common part.
    """
    if len(ring) <= _FEW and not _far_boxes_meet(ring):
        return []
    p = np.array([q[:2] for q in ring], float)
    keep = np.flatnonzero((p[1:] != p[:-1]).any(axis=1))
    n = len(keep)
    if n < 3:
        return []
    a, b = p[keep], p[keep + 1]
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(lo[:, 0], kind="stable")
    end = np.searchsorted(lo[order, 0], hi[order, 0], "right")
    pairs = []
    for k in range(n):  # a sweep over x gives the pairs whose boxes meet
        i = order[k]
        j = order[k + 1 : end[k]]
        j = j[(lo[j, 1] <= hi[i, 1]) & (hi[j, 1] >= lo[i, 1])]
        if len(j):
            pairs.append(np.stack([np.minimum(i, j), np.maximum(i, j)]))
    if not pairs:
        return []
    first, second = np.concatenate(pairs, axis=1)
    far = (second - first != 1) & ~((first == 0) & (second == n - 1))
    if not far.any():
        return []
    first, second = first[far], second[far]
    kind, at, to = meetings(a[first], b[first], a[second], b[second])
    found = []
    for k in np.flatnonzero(kind).tolist():
        where = [at[k].tolist()] + ([to[k].tolist()] if kind[k] == OVERLAPPING else [])
        found.append((int(keep[first[k]]), int(keep[second[k]]), MEETINGS[kind[k]], where))
    return sorted(found, key=lambda x: x[:2])


MEETINGS = (None, "Crossing", "Touching", "Overlapping")
CROSSING, TOUCHING, OVERLAPPING = 1, 2, 3


def _side(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The sign of where points lie about the lines a-b: 1 left, -1 right, 0 on it up to rounding."""
    u, v = b - a, p - a
    left, right = u[:, 0] * v[:, 1], u[:, 1] * v[:, 0]
    turn = left - right
    return np.where(np.abs(turn) <= _TOL * np.maximum(np.abs(left), np.abs(right)), 0.0, turn)


def _foot(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The fraction of a-b at which points have their foot; segments of no length have one at their point only."""
    u, v = b - a, p - a
    size = (u * u).sum(axis=1)
    return np.where(size > 0, (u * v).sum(axis=1) / np.where(size > 0, size, 1.0), np.where((v == 0).all(axis=1), 0.0, np.inf))


def meetings(a, b, c, d) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How segments a-b and c-d meet, for (n, 2) ends: (kind, point, second point).

    By orientation: ends strictly on either side of each other's line cross; an end on the other segment touches; segments on
    one line overlap in an interval, or touch where it has no length. kind: an index into MEETINGS; the second point is
    that of an overlap's other end, in the direction of a-b.
    """
    a, b, c, d = (np.asarray(v, float) for v in (a, b, c, d))
    ends = ((c, _side(a, b, c), a, b), (d, _side(a, b, d), a, b), (a, _side(c, d, a), c, d), (b, _side(c, d, b), c, d))
    (_, sc, _, _), (_, sd, _, _), (_, sa, _, _), (_, sb, _, _) = ends
    kind, at, to = np.zeros(len(a), np.int8), np.full((len(a), 2), np.nan), np.full((len(a), 2), np.nan)
    slack = 2 * _TOL
    one_line = (sa == 0) & (sb == 0) & (sc == 0) & (sd == 0) & (a != b).any(axis=1) & (c != d).any(axis=1)
    for point, side, s, e in ends:
        foot = _foot(s, e, point)
        hit = ~one_line & (kind == 0) & (side == 0) & (foot >= -slack) & (foot <= 1 + slack)
        kind[hit], at[hit] = TOUCHING, point[hit]
    proper = (kind == 0) & (np.sign(sa) * np.sign(sb) < 0) & (np.sign(sc) * np.sign(sd) < 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = np.where(proper[:, None], a + (b - a) * (sa / (sa - sb))[:, None] + 0.0, at)
    kind[proper] = CROSSING
    if one_line.any():
        k = np.flatnonzero(one_line)
        s, e = a[k], b[k]
        f, g = _foot(s, e, c[k]), _foot(s, e, d[k])
        lo, hi = np.clip(np.minimum(f, g), 0, None), np.clip(np.maximum(f, g), None, 1)
        kind[k] = np.where(hi - lo > slack, OVERLAPPING, np.where(hi - lo >= -slack, TOUCHING, 0))
        near, far = s + (e - s) * lo[:, None], s + (e - s) * hi[:, None]
        at[k], to[k] = np.where((kind[k] == TOUCHING)[:, None], (near + far) / 2, near), far
    return kind, at, to


def simple(ring) -> bool:
    return not ring_crossings(ring)


def signature(ring, places: int | None = None) -> tuple:
    """The same for rings with the same vertices in either direction and from any start."""
    v = [tuple(round(c, places) + 0.0 if places is not None else c + 0.0 for c in q[:2]) for q in ring]
    if len(v) > 1 and v[0] == v[-1]:
        v = v[:-1]
    return min(_least_rotation(v), _least_rotation(v[::-1]))


def _least_rotation(v: list[tuple]) -> tuple:
    """The lexicographically least rotation, in linear time (two candidate starts that skip what they have compared)."""
    n, i, j, k = len(v), 0, 1, 0
    while i < n and j < n and k < n:
        a, b = v[(i + k) % n], v[(j + k) % n]
        if a == b:
            k += 1
            continue
        if a > b:
            i += k + 1
        else:
            j += k + 1
        if i == j:
            j += 1
        k = 0
    i = min(i, j)
    return tuple(v[i:] + v[:i])


def inside_ring(points: np.ndarray, ring) -> np.ndarray:
    """1 inside, 0 on the boundary, -1 outside, for (n, 2) points."""
    p = np.array([q[:2] for q in ring], float)
    a, b = p[:-1], p[1:]
    x, y = points[:, :1], points[:, 1:2]
    cross = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])
    box = (np.minimum(a[:, 0], b[:, 0]) <= x) & (x <= np.maximum(a[:, 0], b[:, 0])) & (np.minimum(a[:, 1], b[:, 1]) <= y) & (y <= np.maximum(a[:, 1], b[:, 1]))
    scale = np.maximum(np.abs((b[:, 0] - a[:, 0]) * (y - a[:, 1])), np.abs((b[:, 1] - a[:, 1]) * (x - a[:, 0])))
    edge = (box & (np.abs(cross) <= _TOL * scale)).any(axis=1)
    up = (a[:, 1] <= y) & (y < b[:, 1]) & (cross > 0)
    down = (b[:, 1] <= y) & (y < a[:, 1]) & (cross < 0)
    odd = (up | down).sum(axis=1) % 2 == 1
    return np.where(edge, 0, np.where(odd, 1, -1))


def containment(inner, outer) -> str:
    """Of a ring against another: 'outside', 'touching' or 'inside'."""
    v = np.array([q[:2] for q in inner], float)
    o = np.array([q[:2] for q in outer], float)
    where = inside_ring(v[:-1], outer)
    if (where < 0).any():
        return "outside"
    contact = bool((where == 0).any())
    for a, b in zip(v[:-1], v[1:]):
        n = len(o) - 1
        _, t, _ = crossing(np.tile(a, (n, 1)), np.tile(b, (n, 1)), o[:-1], o[1:])
        cuts = np.unique(np.concatenate([[0.0, 1.0], t[~np.isnan(t)]]))
        contact |= bool((~np.isnan(t)).any())
        mids = (cuts[1:] + cuts[:-1])[np.diff(cuts) > _TOL] / 2
        if len(cuts) > 2 and (inside_ring(a + (b - a) * mids[:, None], outer) < 0).any():
            return "outside"
    return "touching" if contact else "inside"


# ---- overlay --------------------------------------------------------------------------------------------------

_GRID = 12  # decimal places at which nodes of an overlay are one


def _edges(polygons) -> np.ndarray:
    out = [np.hstack([p[:-1], p[1:]]) for rings in polygons for r in rings if len(p := np.array([q[:2] for q in r], float)) > 1]
    e = np.round(np.concatenate(out), _GRID) + 0.0 if out else np.zeros((0, 4))
    return e[(e[:, :2] != e[:, 2:]).any(axis=1)]


#: Up to so many edges an overlay works on plain numbers: calls of numpy cost more than what they compute there.
_PLAIN = 48


def _on_grid(x: float) -> float:
    """As ``np.round`` does it."""
    y = x * 10.0**_GRID
    return (round(y) if abs(y) < 2.0**52 else y) / 10.0**_GRID + 0.0


def _noded_few(e: list[list[float]]) -> list[tuple[int, tuple, tuple]]:
    """As ``_noded``, for few edges, with the same arithmetic."""
    box = [(min(a, c), min(b, d), max(a, c), max(b, d)) for a, b, c, d in e]
    nodes = {(a, b) for a, b, _, _ in e} | {(c, d) for _, _, c, d in e}
    order = sorted(range(len(e)), key=lambda i: box[i][0])
    for k, i in enumerate(order):
        _, v0, u1, v1 = box[i]
        ax, ay, bx, by = e[i]
        rx, ry = bx - ax, by - ay
        for j in order[k + 1 :]:
            x0, y0, _, y1 = box[j]
            if x0 > u1:
                break
            if y0 > v1 or y1 < v0:
                continue
            cx, cy, dx, dy = e[j]
            sx, sy, qx, qy = dx - cx, dy - cy, cx - ax, cy - ay
            left, right = rx * sy, ry * sx
            den = left - right
            if abs(den) > _TOL * max(abs(left), abs(right), 5e-324):
                t, u = (qx * sy - qy * sx) / den, (qx * ry - qy * rx) / den
                if -2 * _TOL <= t <= 1 + 2 * _TOL and -2 * _TOL <= u <= 1 + 2 * _TOL:
                    t = min(max(t, 0.0), 1.0)
                    nodes.add((_on_grid(ax + rx * t), _on_grid(ay + ry * t)))
    every = sorted(nodes)
    out = []
    for i, (ax, ay, bx, by) in enumerate(e):
        x0, y0, x1, y1 = box[i]
        x0, y0, x1, y1 = x0 - 1e-11, y0 - 1e-11, x1 + 1e-11, y1 + 1e-11
        dx, dy = bx - ax, by - ay
        size = dx * dx + dy * dy
        line = []
        for node in every:
            x, y = node
            if x0 <= x <= x1 and y0 <= y <= y1:
                t = min(max(((x - ax) * dx + (y - ay) * dy) / size, 0.0), 1.0) if size else 0.0
                if abs(x - (ax + dx * t)) <= 2e-12 and abs(y - (ay + dy * t)) <= 2e-12:
                    line.append((t, node))
        line.sort(key=lambda v: v[0])
        out += [(i, p, q) for (_, p), (_, q) in zip(line, line[1:])]
    return out


def _beyond_few(keys: list[tuple], own: list[tuple[bool, bool]], flat: list[bool]) -> list[tuple[bool, bool]]:
    """As ``_beyond``, for few edges, with the same arithmetic."""
    out = []
    for k, (s, t) in enumerate(keys):
        ax = 1 if flat[k] else 0
        other = 1 - ax
        c, here = (s[other] + t[other]) / 2, (s[ax] + t[ax]) / 2
        first = second = False
        for h, (p, q) in enumerate(keys):
            lo, hi = p[other], q[other]
            if h != k and (lo <= c < hi or hi <= c < lo) and p[ax] + (q[ax] - p[ax]) * (c - lo) / (hi - lo) > here:
                first ^= own[h][0]
                second ^= own[h][1]
        out.append((first, second))
    return out


def _noded(e: np.ndarray) -> list[tuple[int, tuple, tuple]]:
    """Sub-edges (edge, from, to) of edges cut wherever they meet."""
    if len(e) <= _PLAIN:
        return _noded_few(e.tolist())
    lo, hi = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
    nodes = np.unique(np.concatenate([e[:, :2], e[:, 2:]]), axis=0)
    order = np.argsort(lo[:, 0], kind="stable")
    crossings: dict[int, list] = {}
    starts = lo[order, 0]
    for k in range(len(e)):
        i = order[k]
        j = order[k + 1 : np.searchsorted(starts, hi[i, 0], "right")]
        j = j[(lo[j, 1] <= hi[i, 1]) & (hi[j, 1] >= lo[i, 1])]
        if not len(j):
            continue
        at, t, _ = crossing(np.tile(e[i, :2], (len(j), 1)), np.tile(e[i, 2:], (len(j), 1)), e[j, :2], e[j, 2:])
        for q, x in zip(j[~np.isnan(t)].tolist(), np.round(at[~np.isnan(t)], _GRID) + 0.0):
            crossings.setdefault(int(i), []).append(x)
            crossings.setdefault(q, []).append(x)
    if crossings:
        nodes = np.unique(np.concatenate([nodes, np.array([x for v in crossings.values() for x in v])]), axis=0)
    out = []
    for i in range(len(e)):
        a, b = e[i, :2], e[i, 2:]
        m = nodes[(nodes[:, 0] >= lo[i, 0] - 1e-11) & (nodes[:, 0] <= hi[i, 0] + 1e-11)]
        m = m[(m[:, 1] >= lo[i, 1] - 1e-11) & (m[:, 1] <= hi[i, 1] + 1e-11)]
        d = b - a
        t = np.clip(((m - a) @ d) / (d @ d), 0, 1)
        on = np.abs(m - (a + d * t[:, None])).max(axis=1) <= 2e-12
        m, t = m[on], t[on]
        line = [tuple(x) for x in m[np.argsort(t, kind="stable")].tolist()]
        out += [(i, p, q) for p, q in zip(line, line[1:]) if p != q]
    return out


def _beyond(keys: list[tuple], own: list[tuple[bool, bool]], flat: list[bool]) -> list[tuple[bool, bool]]:
    """Whether each input holds what lies just beyond each edge: a ray goes up the edge's axis (y for flat ones) from its middle."""
    ends, mine = np.array(keys, float).reshape(-1, 4), np.array(own, bool)
    p, q = ends[:, :2], ends[:, 2:]
    mid = (p + q) / 2
    out = []
    for k in range(len(keys)):
        ax = 1 if flat[k] else 0
        other = 1 - ax
        lo, hi = np.minimum(p[:, other], q[:, other]), np.maximum(p[:, other], q[:, other])
        c = mid[k, other]
        hit = (lo <= c) & (c < hi)
        hit[k] = False
        h = np.flatnonzero(hit)
        at = p[h, ax] + (q[h, ax] - p[h, ax]) * (c - p[h, other]) / (q[h, other] - p[h, other])
        first, second = mine[h[at > mid[k, ax]]].sum(axis=0) % 2 == 1
        out.append((bool(first), bool(second)))
    return out


def overlay(first, second, op: str) -> list[list[list[list[float]]]]:
    """The polygons of 'intersection', 'union', 'difference' or 'xor' of two lists of polygons (even-odd inside)."""
    a, b = _edges(first), _edges(second)
    e = np.concatenate([a, b])
    if not len(e):
        return []
    owner = np.repeat([0, 1], [len(a), len(b)])
    odd: dict[tuple, list[int]] = {}
    for i, p, q in _noded(e):
        odd.setdefault((p, q) if p < q else (q, p), [0, 0])[owner[i]] ^= 1
    keys = [k for k, v in odd.items() if v[0] or v[1]]
    if not keys:
        return []
    own = [(v[0] == 1, v[1] == 1) for v in map(odd.get, keys)]
    flat = [abs(t[1] - s[1]) < abs(t[0] - s[0]) for s, t in keys]  # cast along the axis that the edge crosses best
    keep: list[tuple[tuple, tuple]] = []
    test = {"intersection": lambda x, y: x and y, "union": lambda x, y: x or y, "difference": lambda x, y: x and not y, "xor": lambda x, y: x != y}[op]
    for (s, t), mine, far, across in zip(keys, own, (_beyond_few if len(keys) <= 2 * _PLAIN else _beyond)(keys, own, flat), flat):
        rf, rn = test(*far), test(far[0] ^ mine[0], far[1] ^ mine[1])
        if rf == rn:
            continue
        # Which way has the far side (greater x, or greater y for flat edges) on its left?
        forward = (t[0] > s[0]) if across else (t[1] < s[1])
        keep.append((s, t) if forward == rf else (t, s))
    return _polygons(keep, {tuple(x) for x in e[:, :2].tolist()})


def _polygons(edges: list[tuple[tuple, tuple]], corners: set) -> list[list[list[list[float]]]]:
    """Directed edges with the inside on their left -> polygons, exteriors counter-clockwise."""
    out: dict[tuple, list[tuple]] = {}
    for s, t in edges:
        out.setdefault(s, []).append(t)
    shells, holes = [], []
    for start in sorted(out):
        while out.get(start):
            ring, here, before = [start], out[start].pop(), start
            while here != start:
                ring.append(here)
                ways = out.get(here)
                if not ways:
                    ring = []
                    break
                back = math.atan2(before[1] - here[1], before[0] - here[0])
                # The sharpest left turn keeps rings that touch in a vertex apart.
                pick = min(range(len(ways)), key=lambda w: (back - math.atan2(ways[w][1] - here[1], ways[w][0] - here[0])) % (2 * math.pi) or 2 * math.pi)
                before, here = here, ways.pop(pick)
            ring = _without_straight(ring, corners)
            if len(ring) >= 3:
                closed = [list(v) for v in ring] + [list(ring[0])]
                area = signed_area2(closed)
                if area:
                    (shells if area > 0 else holes).append(closed)
    shells.sort(key=lambda r: abs(signed_area2(r)))
    result = [[s] for s in shells]
    for h in holes:
        probe = np.array([h[0]])
        mid = np.array([[(h[0][0] + h[1][0]) / 2, (h[0][1] + h[1][1]) / 2]])
        for poly in result:
            w = inside_ring(probe, poly[0])[0]
            if w > 0 or w == 0 and inside_ring(mid, poly[0])[0] >= 0 and abs(signed_area2(h)) < abs(signed_area2(poly[0])):
                poly.append(h)
                break
    return sorted(result)


def _without_straight(ring: list[tuple], corners: set) -> list[tuple]:
    """Drops nodes that only noding made."""
    n = len(ring)
    out = []
    for i, v in enumerate(ring):
        u, w = ring[i - 1], ring[(i + 1) % n]
        bend = abs((v[0] - u[0]) * (w[1] - v[1]) - (v[1] - u[1]) * (w[0] - v[0]))
        if v in corners or bend > 1e-11 * (abs(w[0] - u[0]) + abs(w[1] - u[1])):
            out.append(v)
    return out


def area_of(polygons) -> float:
    return sum(map(polygon_area, polygons))


def shared_area(first, second) -> float:
    """Square metres that two lists of polygons share; boxes without a common inside share none."""
    if not first or not second:
        return 0.0
    (a, b), (c, d) = ((np.min(q, axis=0), np.max(q, axis=0)) for q in (np.array([v[:2] for p in ps for r in p for v in r], float) for ps in (first, second)))
    if (np.minimum(b, d) <= np.maximum(a, c)).any():
        return 0.0
    return area_of(overlay(first, second, "intersection"))


def intersection_area(first, second) -> float:
    """Square metres that two polygons share."""
    return shared_area([first], [second])


def polygons_meet(first, second) -> bool:
    """Whether two polygons share any point."""
    for r in first:
        a = np.array([q[:2] for q in r], float)
        for s in second:
            b = np.array([q[:2] for q in s], float)
            for i in range(len(a) - 1):
                lo, hi = np.minimum(a[i], a[i + 1]), np.maximum(a[i], a[i + 1])
                near = np.flatnonzero((np.minimum(b[:-1], b[1:]) <= hi).all(axis=1) & (np.maximum(b[:-1], b[1:]) >= lo).all(axis=1))
                if len(near) and meetings(np.repeat(a[i : i + 1], len(near), axis=0), np.repeat(a[i + 1 : i + 2], len(near), axis=0), b[near], b[near + 1])[0].any():
                    return True

    def holds(rings, point) -> bool:
        return inside_ring(point, rings[0])[0] >= 0 and all(inside_ring(point, h)[0] <= 0 for h in rings[1:])

    return holds(first, np.array([second[0][0][:2]], float)) or holds(second, np.array([first[0][0][:2]], float))
