"""Planar polygon kernels in numpy: repair, union, relations, buffers.

Everything is one arrangement. All edges are cut at their intersections; a
piece is on the boundary of a region if a point just left of it is inside and
one just right is outside, or the other way round. The kept pieces, turned so
that the inside is on the left, are chained into rings: counter-clockwise ones
are exteriors, clockwise ones holes. Which region is meant (even-odd repair,
union, intersection, offset) is only a matter of the inside test.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence

import numpy as np

Ring = np.ndarray
Polygon = list[tuple[Ring, list[Ring]]]  # parts: exterior, holes

#: Relative size under which two places are one.
_SNAP = 1e-9
_ARC = 16  # segments of a quarter circle


def as_ring(points: Sequence) -> Ring:
    """An open ring of distinct neighbouring points."""
    r = np.asarray(points, dtype=float).reshape(-1, 2)
    if len(r):
        r = r[np.any(r != np.roll(r, 1, axis=0), axis=1)] if len(r) > 1 else r
    return r


def signed_area(ring: Ring) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def polygon_area(polygon: Polygon) -> float:
    return sum(abs(signed_area(e)) - sum(abs(signed_area(h)) for h in holes) for e, holes in polygon)


def in_ring(ring: Ring, points: np.ndarray) -> np.ndarray:
    """Even-odd test of many points."""
    if len(ring) < 3:
        return np.zeros(len(points), bool)
    a, b = ring, np.roll(ring, -1, axis=0)
    x, y = points[:, :1], points[:, 1:]
    spans = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return (np.sum(spans & (x < at), axis=1) % 2).astype(bool)


def in_polygon(polygon: Polygon, points: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(points), bool)
    for exterior, holes in polygon:
        part = in_ring(exterior, points)
        for h in holes:
            part &= ~in_ring(h, points)
        inside |= part
    return inside


def _pieces(rings: Sequence[Ring]) -> tuple[np.ndarray, float]:
    """All edges, cut where they meet, each once; and the snapping distance."""
    rings = [r for r in rings if len(r) > 1]
    if not rings:
        return np.empty((0, 4)), 1.0
    a = np.concatenate(rings)
    b = np.concatenate([np.roll(r, -1, axis=0) for r in rings])
    span = max(float(np.ptp(a, axis=0).max()), 1e-12)
    snap = span * _SNAP
    # A sweep along x: an edge is compared with those that begin before it ends.
    order = np.argsort(np.minimum(a[:, 0], b[:, 0]), kind="stable")
    a, b = a[order], b[order]
    d = b - a
    n = len(a)
    lo, hi = np.minimum(a, b) - snap, np.maximum(a, b) + snap
    until = np.searchsorted(lo[:, 0], hi[:, 0], side="right")
    cuts: list[list[float]] = [[0.0, 1.0] for _ in range(n)]
    length = np.maximum(np.hypot(d[:, 0], d[:, 1]), 1e-300)
    for i in range(n):
        near = np.flatnonzero((lo[i, 1] <= hi[i + 1 : until[i], 1]) & (hi[i, 1] >= lo[i + 1 : until[i], 1])) + i + 1
        if not len(near):
            continue
        dj, w = d[near], a[near] - a[i]
        den = d[i, 0] * dj[:, 1] - d[i, 1] * dj[:, 0]
        skew = np.abs(den) > 1e-12 * length[i] * length[near]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (w[:, 0] * dj[:, 1] - w[:, 1] * dj[:, 0]) / den
            u = (w[:, 0] * d[i, 1] - w[:, 1] * d[i, 0]) / den
        ti, tj = snap / length[i], snap / length[near]
        meets = skew & (t >= -ti) & (t <= 1 + ti) & (u >= -tj) & (u <= 1 + tj)
        for k in np.flatnonzero(meets):
            cuts[i].append(float(min(max(t[k], 0), 1)))
            cuts[near[k]].append(float(min(max(u[k], 0), 1)))
        for k in np.flatnonzero(~skew):
            if abs(w[k, 0] * d[i, 1] - w[k, 1] * d[i, 0]) > snap * length[i]:
                continue
            j = near[k]
            for p in (a[j], b[j]):
                t1 = float(np.dot(p - a[i], d[i]) / length[i] ** 2)
                if 0 < t1 < 1:
                    cuts[i].append(t1)
            for p in (a[i], b[i]):
                t1 = float(np.dot(p - a[j], d[j]) / length[j] ** 2)
                if 0 < t1 < 1:
                    cuts[j].append(t1)
    merge = _Merger(snap * 8)
    ends = [merge(p) for p in a]
    seen, pieces = set(), []
    for i, own in enumerate(cuts):
        inner = [merge(p) for p in a[i] + np.outer(sorted(set(own) - {0.0, 1.0}), d[i])]
        line = [ends[i], *inner, merge(b[i])]
        for p, q in zip(line, line[1:]):
            if p != q and (min(p, q), max(p, q)) not in seen:
                seen.add((min(p, q), max(p, q)))
                pieces.append((*p, *q))
    return np.array(pieces).reshape(-1, 4), snap * 16


class _Merger:
    """The first point seen within a distance stands for all near it, so that
    points equal but for rounding are the same place."""

    def __init__(self, distance: float):
        self.distance = distance
        self.cells: dict[tuple[int, int], list[tuple[float, float]]] = defaultdict(list)

    def __call__(self, point: np.ndarray) -> tuple[float, float]:
        x, y = float(point[0]), float(point[1])
        cx, cy = int(np.floor(x / self.distance)), int(np.floor(y / self.distance))
        for i in (cx, cx - 1, cx + 1):
            for j in (cy, cy - 1, cy + 1):
                for p in self.cells.get((i, j), ()):
                    if abs(p[0] - x) <= self.distance and abs(p[1] - y) <= self.distance:
                        return p
        self.cells[cx, cy].append((x, y))
        return x, y


def arrange(rings: Sequence[Ring], inside: Callable[[np.ndarray], np.ndarray]) -> Polygon:
    """The region of the plane where ``inside`` holds, whose boundary lies on ``rings``."""
    pieces, snap = _pieces(rings)
    if not len(pieces):
        return []
    p, q = pieces[:, :2], pieces[:, 2:]
    d = q - p
    length = np.hypot(d[:, 0], d[:, 1])[:, None]
    left = np.column_stack((-d[:, 1], d[:, 0])) / length * np.minimum(snap * 4, length / 8)
    middle = (p + q) / 2
    l, r = inside(middle + left), inside(middle - left)  # noqa: E741
    keep = l != r
    start, end = np.where(l[:, None], p, q)[keep], np.where(l[:, None], q, p)[keep]
    return _nest(_chain(start, end, snap))


def _chain(start: np.ndarray, end: np.ndarray, snap: float) -> list[Ring]:
    """Rings of directed pieces with the inside on the left; where several go
    on from a place, the sharpest turn to the left keeps rings simple."""
    key = lambda v: (float(v[0]), float(v[1]))
    out: dict[tuple, list[int]] = defaultdict(list)
    for i, s in enumerate(start):
        out[key(s)].append(i)
    unused, rings = set(range(len(start))), []
    while unused:
        i = min(unused)
        first, ring = key(start[i]), []
        while True:
            unused.discard(i)
            ring.append(start[i])
            at = key(end[i])
            if at == first:
                break
            ahead = end[i] - start[i]
            options = [k for k in out[at] if k in unused]
            if not options:
                break
            def turn(k: int) -> float:
                v = end[k] - start[k]
                return float(np.arctan2(ahead[0] * v[1] - ahead[1] * v[0], np.dot(ahead, v)))

            i = max(options, key=turn)
        ring = _simplified(np.array(ring), snap)
        if len(ring) >= 3:
            rings.append(ring)
    return rings


def _simplified(ring: Ring, snap: float) -> Ring:
    """Without points on the line between their neighbours."""
    if len(ring) < 4:
        return ring
    before, after = ring - np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0) - ring
    cross = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0])
    forward = np.sum(before * after, axis=1) > 0
    keep = ~(forward & (cross <= snap * np.hypot(after[:, 0], after[:, 1])))
    return ring[keep]


def _nest(rings: list[Ring]) -> Polygon:
    areas = [signed_area(r) for r in rings]
    parts: Polygon = [(r, []) for r, a in zip(rings, areas) if a > 0]
    for r, a in zip(rings, areas):
        if a < 0:
            middle = (r[:1] + r[1:2]) / 2
            holders = [p for p in parts if abs(signed_area(p[0])) > -a and (in_ring(p[0], middle)[0] or in_ring(p[0], r)[0])]
            if holders:
                min(holders, key=lambda p: abs(signed_area(p[0])))[1].append(r)
    return parts


def _edges_of(rings: Sequence[Ring]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(rings), np.concatenate([np.roll(r, -1, axis=0) for r in rings])


#: Pairs of edges looked at in one array.
_PAIRS = 4_000_000


def edges_meet(rings: Sequence[Ring], others: Sequence[Ring] | None = None) -> bool:
    """Whether any edge of ``rings`` meets one of ``others`` (or, without these,
    another of their own but for the shared ends of neighbours), touching or
    nearly touching included. Blocks of bounded size are compared at once."""
    a, b = _edges_of(rings)
    c, d = (a, b) if others is None else _edges_of(others)
    slack = max(float(np.ptp(np.concatenate((a, c)), axis=0).max()), 1e-12) * _SNAP * 64
    after = before = None
    if others is None:
        after, at = np.empty(len(a), int), 0  # each edge's neighbours in its ring
        for r in rings:
            m = len(r)
            i, nxt = np.arange(m), (np.arange(m) + 1) % m
            # Neighbours share an end; they only meet elsewhere if one folds back on the other.
            u, v = b[at + i] - a[at + i], b[at + nxt] - a[at + nxt]
            back = (np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) <= slack * np.hypot(v[:, 0], v[:, 1])) & (np.sum(u * v, axis=1) < 0)
            if back.any():
                return True
            after[at + i] = at + nxt
            at += m
        before = np.empty(len(a), int)
        before[after] = np.arange(len(a))

    def side(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        v = (q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0])
        return np.where(np.abs(v) <= slack * np.hypot(q[:, 0] - p[:, 0], q[:, 1] - p[:, 1]), 0, np.sign(v))

    lo, hi = np.minimum(a, b) - slack, np.maximum(a, b) + slack
    least, most = np.minimum(c, d), np.maximum(c, d)
    step = max(1, _PAIRS // max(1, len(c)))
    for top in range(0, len(a), step):
        rows = slice(top, top + step)
        close = np.ones((len(a[rows]), len(c)), bool)
        for k in (0, 1):
            close &= (lo[rows, k, None] <= most[None, :, k]) & (hi[rows, k, None] >= least[None, :, k])
        i, j = np.nonzero(close)
        i += top
        if others is None:
            own = (i < j) & (after[i] != j) & (before[i] != j)
            i, j = i[own], j[own]
        if len(i) and np.any((side(a[i], b[i], c[j]) * side(a[i], b[i], d[j]) <= 0) & (side(c[j], d[j], a[i]) * side(c[j], d[j], b[i]) <= 0)):
            return True
    return False


def make_valid(exterior: Sequence, holes: Sequence = ()) -> Polygon:
    """A polygon's parts without self-crossings: inside is what an odd number of
    the exterior's turns hold, less its holes. No area gives no part. Rings that
    meet nowhere are only turned and sorted; others are arranged."""
    e, hs = as_ring(exterior), [h for h in map(as_ring, holes) if len(h) >= 3]
    if len(e) < 3:
        return []
    if not edges_meet([e, *hs]):
        own = [h for h in hs if in_ring(e, h[:1])[0]]
        if any(in_ring(h, e[:1])[0] for h in hs):
            return []
        outer = [h for h in own if not any(g is not h and in_ring(g, h[:1])[0] for g in own)]
        turned = lambda r, left: r if (signed_area(r) > 0) == left else r[::-1]
        return [(turned(e, True), [turned(h, False) for h in outer])] if signed_area(e) else []

    def inside(points: np.ndarray) -> np.ndarray:
        found = in_ring(e, points)
        for h in hs:
            found &= ~in_ring(h, points)
        return found

    return arrange([e, *hs], inside)


def _rings(polygons: Sequence[Polygon]) -> list[Ring]:
    return [r for polygon in polygons for e, holes in polygon for r in (e, *holes)]


def union(polygons: Sequence[Polygon]) -> Polygon:
    return arrange(_rings(polygons), lambda points: np.any([in_polygon(p, points) for p in polygons], axis=0) if polygons else np.zeros(len(points), bool))


def intersection(a: Polygon, b: Polygon) -> Polygon:
    return arrange(_rings([a, b]), lambda points: in_polygon(a, points) & in_polygon(b, points))


def outlines(polygon: Polygon) -> list[Ring]:
    """Exteriors alone."""
    return [e for e, _ in polygon]


def filled(polygon: Polygon) -> Polygon:
    return [(e, []) for e, _ in polygon]


def union_outlines(rings: Sequence[Sequence]) -> list[Ring]:
    """Exteriors of the union of rings; what the union encloses is filled."""
    return outlines(union([make_valid(r) for r in rings]))


def relation(a: Polygon, b: Polygon) -> tuple[str, float]:
    """("contains" | "within" | "overlaps" | "apart", shared area) of two
    polygons' exteriors. Equal ones contain each other: "contains". Single parts
    whose edges don't meet need no arrangement: one point tells."""
    a, b = filled(a), filled(b)
    if not a or not b:
        return "apart", 0.0
    area_a, area_b = polygon_area(a), polygon_area(b)
    if len(a) == len(b) == 1 and not edges_meet(outlines(a), outlines(b)):
        if in_polygon(a, b[0][0][:1])[0]:
            return "contains", area_b
        return ("within", area_a) if in_polygon(b, a[0][0][:1])[0] else ("apart", 0.0)
    shared = polygon_area(intersection(a, b))
    slack = 1e-7 * max(area_a, area_b, 1e-300)
    if shared <= slack:
        return "apart", 0.0
    if shared >= area_b - slack:
        return "contains", shared
    return ("within", shared) if shared >= area_a - slack else ("overlaps", shared)


def _disc(centre: np.ndarray, radius: float) -> Ring:
    t = np.arange(4 * _ARC) * np.pi / (2 * _ARC)
    return centre + radius * np.column_stack((np.cos(t), np.sin(t)))


def buffer(polygon: Polygon, distance: float) -> Polygon:
    """Grown (or, with a negative distance, shrunk) with round joins."""
    if not distance or not polygon:
        return polygon
    r = abs(distance)
    bands: list[Ring] = []
    for ring in _rings([polygon]):
        following = np.roll(ring, -1, axis=0)
        d = following - ring
        length = np.hypot(d[:, 0], d[:, 1])[:, None]
        side = np.column_stack((-d[:, 1], d[:, 0])) / length * r
        bands += [np.array([p + s, p - s, q - s, q + s]) for p, q, s in zip(ring, following, side)]
        bands += [_disc(p, r) for p in ring]

    def near(points: np.ndarray) -> np.ndarray:
        found = np.zeros(len(points), bool)
        for band in bands:
            lo, hi = band.min(axis=0), band.max(axis=0)
            box = np.flatnonzero(~found & np.all((points >= lo) & (points <= hi), axis=1))
            if len(box):
                found[box] = in_ring(band, points[box])
        return found

    edge = _rings([polygon])
    if distance > 0:
        return arrange([*edge, *bands], lambda points: in_polygon(polygon, points) | near(points))
    return arrange([*edge, *bands], lambda points: in_polygon(polygon, points) & ~near(points))


def with_holes(polygon: Polygon, inner: Sequence[Polygon]) -> Polygon:
    """``polygon`` with the contained polygons' exteriors as holes, merged with
    its own; a part gets those that lie in it."""
    parts = []
    for exterior, holes in polygon:
        own = [(exterior, [])]
        rings = list(holes)
        for p in inner:
            if len(polygon) == 1 or relation(own, p)[0] == "contains":
                rings += outlines(p)
        merged = union_outlines(rings) if len(rings) > 1 else rings
        parts.append((exterior, merged))
    return make_valid_parts(parts)


def make_valid_parts(parts: Polygon) -> Polygon:
    return arrange(_rings([parts]), lambda points: in_polygon(parts, points))
