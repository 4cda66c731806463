"""Geometry on ARRAY<STRUCT<x DOUBLE, y DOUBLE>> rings as column expressions.

The area that an axis-aligned window shares with a polygon is a sum over the
polygon's edges of a closed form, so it needs no geometry library and no row an
edge: an ``aggregate`` over the ring keeps one row a window.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A slope with less change than this is flat.
_FLAT = 1e-12
#: Segments of a discretised quarter ellipse.
_QUARTER = 16


def ring(*points: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def box_ring(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return ring((x1, y1), (x1, y2), (x2, y2), (x2, y1))


def scaled(points: Column, factor: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] / factor).alias("x"), (p["y"] / factor).alias("y")))


def bounds(points: Column, places: int | None = None) -> Column:
    """STRUCT<x1, y1, x2, y2> of a ring, rounded if asked."""
    f = (lambda c: c) if places is None else (lambda c: F.bround(c, places))
    return F.struct(
        f(F.array_min(points["x"])).alias("x1"), f(F.array_min(points["y"])).alias("y1"), f(F.array_max(points["x"])).alias("x2"), f(F.array_max(points["y"])).alias("y2")
    )


def edges(points: Column) -> Column:
    """ARRAY<STRUCT<px, py, qx, qy>> of a ring taken as closed."""
    def edge(p: Column, i: Column) -> Column:
        q = F.element_at(points, (i + 1) % F.size(points) + 1)
        return F.struct(p["x"].alias("px"), p["y"].alias("py"), q["x"].alias("qx"), q["y"].alias("qy"))

    return F.transform(points, edge)


def area(ring_edges: Column) -> Column:
    """Of the ring with these edges, by the shoelace formula."""
    return F.abs(F.aggregate(ring_edges, F.lit(0.0), lambda s, e: s + e["px"] * e["qy"] - e["qx"] * e["py"])) / 2


def window_area(ring_edges: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Area that the ring shares with the window [x1, x2] x [y1, y2].

    Each edge adds, over the stretch of x it has in the window, the integral of
    its height above y1, cut off at y2, signed by its direction. Edges without
    such a stretch are dropped by two comparisons; the others' values are bound
    once, in two steps, before they are added up.
    """
    def meets(e: Column) -> Column:
        return (F.least(e["px"], e["qx"]) < x2) & (F.greatest(e["px"], e["qx"]) > x1) & (e["px"] != e["qx"])

    def stretch(e: Column) -> Column:
        lo, hi = F.greatest(F.least(e["px"], e["qx"]), x1), F.least(F.greatest(e["px"], e["qx"]), x2)
        return F.struct(e["px"].alias("px"), e["py"].alias("py"), F.signum(e["qx"] - e["px"]).alias("d"), lo.alias("lo"), hi.alias("hi"), ((e["qy"] - e["py"]) / (e["qx"] - e["px"])).alias("m"))

    def heights(e: Column) -> Column:
        at = lambda c: e["py"] + e["m"] * (e[c] - e["px"])
        return F.struct(e["d"].alias("d"), (e["hi"] - e["lo"]).alias("w"), e["m"].alias("m"), at("lo").alias("a"), at("hi").alias("b"))

    def above(u: Column) -> Column:
        p, q = F.greatest(u - y1, F.lit(0.0)), F.greatest(u - y2, F.lit(0.0))
        return (p * p - q * q) / 2

    def term(e: Column) -> Column:
        flat = (F.greatest(y1, F.least(y2, e["a"])) - y1) * e["w"]
        sloped = (above(e["b"]) - above(e["a"])) / e["m"]
        return e["d"] * F.when(F.abs(e["b"] - e["a"]) < _FLAT, flat).otherwise(sloped)

    bound = F.transform(F.transform(F.filter(ring_edges, meets), stretch), heights)
    return F.abs(F.aggregate(bound, F.lit(0.0), lambda s, e: s + term(e)))


def boxed_edges(points: Column) -> Column:
    """STRUCT<e, x1, y1, x2, y2>: a ring's edges with its box."""
    return F.struct(
        edges(points).alias("e"), F.array_min(points["x"]).alias("x1"), F.array_min(points["y"]).alias("y1"), F.array_max(points["x"]).alias("x2"), F.array_max(points["y"]).alias("y2")
    )


def polygon_window_area(exterior: Column, holes: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The window's share of an exterior (edges) less that of its holes (boxed
    edges); only holes whose box meets the window are looked at."""
    near = F.filter(holes, lambda h: (h["x1"] < x2) & (h["x2"] > x1) & (h["y1"] < y2) & (h["y2"] > y1))
    inner = F.aggregate(near, F.lit(0.0), lambda s, h: s + window_area(h["e"], x1, y1, x2, y2))
    return window_area(exterior, x1, y1, x2, y2) - inner


def ellipse_ring(corners: Column) -> Column:
    """The ellipse in a box given by its corners (from the top left, clockwise),
    as a closed ring of 65 whole-numbered points from the right-hand end. The
    centre and the half axes are whole numbers too."""
    p = [F.element_at(corners, i) for i in (1, 2, 4)]
    cx, cy = F.bround((p[0]["x"] + p[1]["x"]) / 2, 0), F.bround((p[0]["y"] + p[2]["y"]) / 2, 0)
    rx, ry = F.bround((p[1]["x"] - p[0]["x"]) / 2, 0), F.bround((p[2]["y"] - p[0]["y"]) / 2, 0)

    def point(i: Column) -> Column:
        t = -i * F.pi() / (2 * _QUARTER)
        return F.struct(F.bround(cx + rx * F.cos(t), 0).alias("x"), F.bround(cy + ry * F.sin(t), 0).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(4 * _QUARTER)), point)


def same_polygon(a: Column, b: Column) -> Column:
    """Value equality of (points, label, holes) structs; null holes are none."""
    none = F.array()
    return a["points"].eqNullSafe(b["points"]) & a["label"].eqNullSafe(b["label"]) & F.coalesce(a["holes"], none).eqNullSafe(F.coalesce(b["holes"], none))
