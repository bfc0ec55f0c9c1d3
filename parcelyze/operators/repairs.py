"""Repairs. Each detects, builds a candidate, validates it, and keeps the original where the candidate fails.

Repairs of one feature take its geometry and findings. Repairs between features take a group: the features of one
connected component of the relation, as a dict of index to geometry, so that nothing outside the group is touched.
Reasons for failures are data.
"""

from __future__ import annotations

from typing import Any

import numpy as np

from ..config import CONTACT_M, OVERLAP_M2
from ..functions import planar
from . import decompose as d

Geometry = dict[str, Any]
Group = dict[int, Geometry | None]

STALE, INVALID, COLLAPSE, CROSSES, OVERLAPS, CHANGED = "StaleTarget", "InvalidRepairOutput", "WouldCollapseLine", "WouldCreateSelfIntersection", "WouldCreateOverlap", "TargetChangedDuringRepair"


def valid_polygons(geometry: Any) -> bool:
    """Polygons only, each with an area, simple rings, sound holes, and parts that do not overlap."""
    from .feature_checks import invalid_holes, multipart_integrity

    parts = list(d.components(geometry))
    every = [r for _, _, _, r in d.rings(geometry)]
    if not parts or sum(len(p[3]) for p in parts) != len(every):
        return False
    if any(planar.polygon_area(p[3]) <= 0 or not all(map(planar.simple, p[3])) for p in parts):
        return False
    return not invalid_holes(geometry, 0.0) and not multipart_integrity(geometry)


# ---- one feature ----------------------------------------------------------------------------------------------


def close_rings(geometry: Geometry) -> tuple[Geometry, int]:
    """Appends the first position to open rings with three or more distinct ones."""
    n = 0
    for gc, _, path, ring in list(d.rings(geometry)):
        if isinstance(ring, list) and ring and all(map(d.finite, ring)) and d.key(ring[0]) != d.key(ring[-1]) and len({d.key(p) for p in ring}) >= 3:
            geometry = d.updated(geometry, gc, path, [*ring, list(ring[0])])
            n += 1
    return geometry, n


def drop_duplicate_vertices(geometry: Geometry) -> tuple[Geometry, int]:
    """Drops consecutive repeats where the sequence stands without them."""
    from .feature_checks import duplicate_vertices

    gone: dict[tuple, set[int]] = {}
    for f in duplicate_vertices(geometry):
        if f["repairable"]:
            gone.setdefault((tuple(f["gc_path"]), tuple(f["coordinate_path"][:-1])), set()).add(f["coordinate_path"][-1])
    for (gc, path), idx in gone.items():
        line = d.at_address(geometry, gc, path)
        geometry = d.updated(geometry, gc, path, [p for i, p in enumerate(line) if i not in idx])
    return geometry, sum(map(len, gone.values()))


def orient_rings(geometry: Geometry, interiors_only: bool = False) -> tuple[Geometry, int]:
    """Exteriors counter-clockwise, holes clockwise."""
    n = 0
    for gc, _, path, ring in list(d.rings(geometry)):
        if d.closed_ring(ring) and not (interiors_only and path[-1] == 0):
            turn = planar.orientation(ring)
            if turn != "indeterminate" and turn != ("cw" if path[-1] else "ccw"):
                geometry = d.updated(geometry, gc, path, ring[::-1])
                n += 1
    return geometry, n


def drop_holes(geometry: Geometry, tiny_m2: float) -> tuple[Geometry, int]:
    """Drops holes that lie outside or are tiny, then turns the rest clockwise."""
    from .feature_checks import invalid_holes

    gone: dict[tuple, set[int]] = {}
    for f in invalid_holes(geometry, tiny_m2):
        if f["repairable"]:
            gone.setdefault((tuple(f["gc_path"]), tuple(f["polygon_path"])), set()).add(f["coordinate_path"][-1])
    for (gc, path), idx in gone.items():
        part = d.at_address(geometry, gc, path)
        geometry = d.updated(geometry, gc, path, [r for i, r in enumerate(part) if i not in idx])
    if gone:
        geometry, _ = orient_rings(geometry, interiors_only=True)
    return geometry, sum(map(len, gone.values()))


def repair_spikes(geometry: Geometry, findings: list[dict]) -> tuple[Geometry, dict[int, str]]:
    """Drops the tips of repairable spikes; a ring keeps three vertices, its turn and its simplicity."""
    by_line: dict[tuple, list[int]] = {}
    for i, f in enumerate(findings):
        if f["repairable"]:
            by_line.setdefault((tuple(f["gc_path"]), tuple(f["coordinate_path"][:-1])), []).append(i)
    failures: dict[int, str] = {}
    result, done = geometry, []
    for (gc, path), items in by_line.items():
        line = d.at_address(geometry, gc, path)
        tips = {findings[i]["coordinate_path"][-1] for i in items}
        if not isinstance(line, list) or max(tips) >= len(line):
            failures |= dict.fromkeys(items, STALE)
            continue
        if findings[items[0]]["details"]["sequenceKind"] == "ring":
            body = [p for i, p in enumerate(line[:-1]) if i not in tips]
            new = [*body, list(body[0])] if body else []
            good = len({d.key(p) for p in body}) >= 3 and planar.orientation(new) == planar.orientation(line) != "indeterminate" and planar.simple(new)
        else:
            new = [p for i, p in enumerate(line) if i not in tips]
            good = len({d.key(p) for p in new}) >= 2
        if not good:
            failures |= dict.fromkeys(items, INVALID)
            continue
        result = d.updated(result, gc, path, new)
        done += items
    if done and any(True for _ in d.components(geometry)) and not valid_polygons_if_before(geometry, result):
        return geometry, failures | dict.fromkeys(done, INVALID)
    return result, failures


def valid_polygons_if_before(before: Geometry, after: Geometry) -> bool:
    """No polygon check fails after that did not fail before (collections hold lines and points too)."""
    from .feature_checks import invalid_holes, multipart_integrity

    for gc, kind, c in d.leaves(after):
        if kind in ("Polygon", "MultiPolygon"):
            g = {"type": kind, "coordinates": c}
            if invalid_holes(g, 0.0) or multipart_integrity(g) or any(planar.polygon_area(p[3]) <= 0 or not planar.simple(p[3][0]) for p in d.components(g)):
                return False
    return True


def repair_self_intersection(geometry: Geometry, findings: list[dict]) -> tuple[Geometry, dict[int, str]]:
    """Splits a ring at its one crossing to two polygons."""
    target = [i for i, f in enumerate(findings) if f["repairable"]]
    if not target:
        return geometry, {}
    f = findings[target[0]]
    part_path = tuple(f["polygon_path"])
    part = d.at_address(geometry, (), part_path)
    i, j = f["coordinate_path"][-1], f["related_coordinate_path"][-1]
    if not isinstance(part, list) or len(part) != 1 or not i < j < len(part[0]) - 1:
        return geometry, {target[0]: STALE}
    ring, x = part[0], list(f["details"]["intersection"][0])
    faces = [[x, *ring[i + 1 : j + 1], x], [*ring[: i + 1], x, *ring[j + 1 :]]]
    faces = [r if planar.orientation(r) == "ccw" else r[::-1] for r in faces]
    parts = [[[list(p) for p in r]] for r in faces]
    if geometry["type"] == "Polygon":
        new = {**geometry, "type": "MultiPolygon", "coordinates": parts}
    else:
        k = part_path[0]
        new = {**geometry, "coordinates": [*geometry["coordinates"][:k], *parts, *geometry["coordinates"][k + 1 :]]}
    if any(len({d.key(p) for p in r}) < 3 or planar.ring_area(r) <= 0 or not planar.simple(r) for r in faces) or not valid_polygons(new):
        return geometry, {target[0]: INVALID}
    return new, {}


# ---- groups of features -----------------------------------------------------------------------------------------


def _rings_of(geometry: Any) -> list[list]:
    return [p[3] for p in d.components(geometry)]


def shared_area(a: Any, b: Any) -> float:
    return planar.shared_area(_rings_of(a), _rings_of(b))


def _as_geometry(polygons: list, like: Geometry) -> Geometry | None:
    if not polygons:
        return None
    rest = {k: v for k, v in like.items() if k not in ("type", "coordinates", "bbox")}
    return {**rest, "type": "Polygon", "coordinates": polygons[0]} if len(polygons) == 1 else {**rest, "type": "MultiPolygon", "coordinates": polygons}


def _mid(a: list, b: list) -> list:
    return [(x + y) / 2 for x, y in zip(a, b)]


def _moved(geometry: Geometry, gc: tuple, path: tuple, ends: list[list]) -> Geometry | None:
    """The geometry with both ends of a ring's segment elsewhere, wherever the ring has these vertices."""
    ring = d.at_address(geometry, gc, path[:-1])
    k = path[-1]
    if not isinstance(ring, list) or k + 1 >= len(ring):
        return None
    change = {d.key(ring[k]): ends[0], d.key(ring[k + 1]): ends[1]}
    return d.updated(geometry, gc, path[:-1], [[*change[d.key(p)], *p[len(change[d.key(p)]) :]] if d.key(p) in change else p for p in ring])


def close_gaps(group: Group, findings: list[dict], limit: dict[int, float], layers: dict[int, str | None]) -> tuple[Group, dict[int, str | None]]:
    """Moves both edges of each gap to the line between them, one finding after another.

    Returns the group and, for each finding tried, None or why it failed. limit: how far a finding's ends may be apart.
    """
    group, outcome = dict(group), {}
    for n, f in enumerate(findings):
        if not f["repairable"]:
            continue
        i, j = f["feature_index"], f["related_feature_index"]
        gi, gj, pi, pj = (tuple(f[k] or ()) for k in ("gc_path", "related_gc_path", "coordinate_path", "related_coordinate_path"))
        ri, rj = (d.at_address(group[k], g, p[:-1]) if group.get(k) else None for k, g, p in ((i, gi, pi), (j, gj, pj)))
        if not isinstance(ri, list) or not isinstance(rj, list) or pi[-1] + 1 >= len(ri) or pj[-1] + 1 >= len(rj):
            outcome[n] = STALE
            continue
        a, b, c, e = ri[pi[-1]], ri[pi[-1] + 1], rj[pj[-1]], rj[pj[-1] + 1]
        direct, turned = (max(float(planar.haversine(a[:2], x[:2])), float(planar.haversine(b[:2], y[:2]))) for x, y in ((c, e), (e, c)))
        if min(direct, turned) > limit[n]:
            outcome[n] = STALE
            continue
        x, y = (c, e) if direct <= turned else (e, c)
        s, t = _mid(a, x), _mid(b, y)
        first = _moved(group[i], gi, pi, [s, t])
        second = _moved(group[j], gj, pj, [s, t] if direct <= turned else [t, s])
        turns = lambda g: [planar.orientation(r) for p in _rings_of(g) for r in p]
        if first is None or second is None or not valid_polygons(first) or not valid_polygons(second) or turns(first) != turns(group[i]) or turns(second) != turns(group[j]) or shared_area(first, second) > OVERLAP_M2:
            outcome[n] = INVALID
            continue
        new = {i: first, j: second}

        def grows(k: int, g: Geometry) -> bool:
            return any(o not in new and h and layers.get(o) == layers.get(k) and (after := shared_area(g, h)) > OVERLAP_M2 and after > shared_area(group[k], h) + OVERLAP_M2 for o, h in group.items())

        if any(grows(k, g) for k, g in new.items()):
            outcome[n] = OVERLAPS
            continue
        group.update(new)
        outcome[n] = None
    return group, outcome


def absorb_slivers(group: Group, findings: list[dict]) -> tuple[Group, dict[int, str | None]]:
    """Joins slivers to their dominant neighbour, or drops those that are small; areas are conserved."""
    group, outcome = dict(group), {}
    drop: dict[int, set[int]] = {}
    for n, f in enumerate(findings):
        if not f["repairable"] or f["gc_path"]:
            continue
        i, j = f["feature_index"], f["related_feature_index"]
        source = group.get(i)
        part = d.at_address(source, (), tuple(f["polygon_path"])) if source else None
        if not isinstance(part, list):
            outcome[n] = STALE
            continue
        if j is not None:
            target = group.get(j)
            if not target or target["type"] not in ("Polygon", "MultiPolygon") or not valid_polygons(source) or not valid_polygons(target):
                outcome[n] = INVALID
                continue
            before = _rings_of(target)
            joined = planar.overlay(before, [part], "union")
            want = planar.area_of(before) + planar.polygon_area(part)
            new = _as_geometry(joined, target)
            if planar.area_of(planar.overlay(before, [part], "intersection")) > OVERLAP_M2 or abs(planar.area_of(joined) - want) > max(OVERLAP_M2, want * 1e-9) or len(joined) > len(before) or not valid_polygons(new):
                outcome[n] = INVALID
                continue
            group[j] = new
        elif "Area" not in f["details"]["detectionReasons"]:
            continue
        drop.setdefault(i, set()).add(f["polygon_path"][0] if f["polygon_path"] else 0)
        outcome[n] = None
    for i, parts in drop.items():
        g = group[i]
        left = [] if g["type"] == "Polygon" else [p for k, p in enumerate(g["coordinates"]) if k not in parts]
        group[i] = {**g, "coordinates": left} if left else None
    return group, outcome


def subtract_overlaps(group: Group, pairs: list[tuple[int, int]]) -> tuple[Group, bool]:
    """Takes shared areas away from both sides, from the originals; all of the group or none of it. None: nothing is left."""
    near: dict[int, set[int]] = {}
    for i, j in pairs:
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)
    new: Group = {}
    for i, others in near.items():
        left = _rings_of(group[i])
        for j in sorted(others):
            left = planar.overlay(left, _rings_of(group[j]), "difference") if left else left
        if left and planar.area_of(left) <= OVERLAP_M2:
            return group, False
        extra = {tuple(p[2:]) for r in _rings_of(group[i]) for q in r for p in q}
        plane = list(extra.pop()) if len(extra) == 1 else []  # a constant height comes back
        new[i] = _as_geometry([[[[*p, *plane] for p in r] for r in poly] for poly in left], group[i])
    return {**group, **new}, True


def insert_neighbour_vertices(geometry: Geometry, findings: list[dict]) -> tuple[Geometry, dict[int, str | None]]:
    """Inserts the vertices that neighbours have on this feature's edges."""
    outcome: dict[int, str | None] = {}
    by_ring: dict[tuple, list[int]] = {}
    for n, f in enumerate(findings):
        if f["repairable"]:
            by_ring.setdefault((tuple(f["related_gc_path"]), tuple(f["related_coordinate_path"][:-1])), []).append(n)
    result = geometry
    for (gc, path), items in by_ring.items():
        ring = d.at_address(geometry, gc, path)
        extra: dict[int, list[tuple[float, list]]] = {}
        for n in items:
            k, x = findings[n]["related_coordinate_path"][-1], findings[n]["details"]
            if not isinstance(ring, list) or k + 1 >= len(ring) or d.key(ring[k][:2]) != d.key(x["targetSegmentStart"][:2]) or d.key(ring[k + 1][:2]) != d.key(x["targetSegmentEnd"][:2]):
                outcome[n] = STALE
                continue
            extra.setdefault(k, []).append((x["targetSegmentFraction"], x["insertionPosition"]))
            outcome[n] = None
        if extra:
            new = []
            for k, p in enumerate(ring):
                new.append(p)
                new += [list(q) for _, q in sorted(extra.get(k, []))]
            candidate = d.updated(result, gc, path, new)
            if valid_polygons_if_before(result, candidate):
                result = candidate
            else:
                outcome |= {n: INVALID for n in items if outcome[n] is None}
    return result, outcome


def _simple_line(line: list) -> bool:
    """No two segments overlap, and none meet but neighbours and the ends of a closed line."""
    p = np.array([q[:2] for q in line], float)
    n = len(p) - 1
    i, j = np.triu_indices(n, 1)
    kind, _, _ = planar.meetings(p[i], p[i + 1], p[j], p[j + 1])
    beside = (j == i + 1) | ((i == 0) & (j == n - 1) & bool((p[0] == p[-1]).all()))
    return not ((kind == planar.OVERLAPPING) | ((kind > 0) & ~beside)).any()


def _line_target_current(group: Group, f: dict) -> bool:
    """Whether the target of a line's finding still has the position that the line is to reach."""
    g = group.get(f["related_feature_index"])
    path = tuple(f["related_coordinate_path"])
    line = d.at_address(g, tuple(f["related_gc_path"]), path[:-1]) if g else None
    if not isinstance(line, list) or path[-1] + 1 >= len(line):
        return False
    at = np.array([f["details"]["targetPosition"][:2]], float)
    a, b = (np.array([line[path[-1] + k][:2]], float) for k in (0, 1))
    return bool(planar.closest_on_segment(at, a, b)[2][0] <= CONTACT_M)


def snap_lines(group: Group, findings: list[dict]) -> tuple[Group, dict[int, str | None]]:
    """Moves or trims line ends to their targets; undone, again and again, where another repair moved the target."""
    outcome: dict[int, str | None] = {}
    lines: dict[tuple, list[int]] = {}
    for n, f in enumerate(findings):
        if not f["repairable"]:
            continue
        if not _line_target_current(group, f):
            outcome[n] = STALE
            continue
        lines.setdefault((f["feature_index"], tuple(f["gc_path"]), tuple(f["coordinate_path"][:-1])), []).append(n)
    new = dict(group)
    for (i, gc, path), items in lines.items():
        line = d.at_address(group.get(i), gc, path)
        ends: dict[str, int] = {}
        for n in items:
            f = findings[n]
            here = line[0 if f["details"]["endpoint"] == "start" else -1] if isinstance(line, list) and line else None
            if here is None or d.key(here) != d.key(f["details"]["endpointPosition"]):
                outcome[n] = STALE
            else:
                ends.setdefault(f["details"]["endpoint"], n)
        live = [n for n in items if n not in outcome]
        if not live:
            continue
        cut = {e: findings[n]["details"]["sourceSegmentIndex"] if findings[n]["code"] == "LINE_OVERSHOOT" else None for e, n in ends.items()}
        lo = cut["start"] + 1 if cut.get("start") is not None else 0
        hi = cut["end"] if cut.get("end") is not None else len(line) - 1
        body = [list(p) for p in line[lo : hi + 1]]
        if body:
            for e, k in (("start", 0), ("end", -1)):
                if e in ends:
                    to = [*findings[ends[e]]["details"]["targetPosition"][:2], *line[k][2:]]
                    if cut[e] is not None and body[k][:2] != to[:2]:
                        body.insert(0 if k == 0 else len(body), to)
                    else:
                        body[k] = to
        flat = [tuple(p[:2]) for p in body]
        if len(set(flat)) < 2 or any(a == b for a, b in zip(flat, flat[1:])) or planar.line_length(body) <= CONTACT_M:
            outcome |= dict.fromkeys(live, COLLAPSE)
        elif not _simple_line(body):
            outcome |= dict.fromkeys(live, CROSSES)
        else:
            new[i] = d.updated(new[i], gc, path, body)
            outcome |= dict.fromkeys(live)
    while True:
        lost = {findings[n]["feature_index"] for n, why in outcome.items() if why is None and not _line_target_current(new, findings[n])}
        if not lost:
            return new, outcome
        for i in lost:
            new[i] = group[i]
        outcome = {n: CHANGED if why is None and findings[n]["feature_index"] in lost else why for n, why in outcome.items()}
