import math
import random

import pytest

from conftest import rows
from pathloom.operators.proximity import regions_in_reach

POINTS = "point_id long, slide_id string, x double, y double, level int"
POLYGONS = "polygon_id long, slide_id string, points array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>, grp string"


def brute(points, polygons, r):
    def edges(ring):
        return list(zip(ring, ring[1:] + ring[:1]))

    def inside(ring, x, y):
        return sum(((a[1] > y) != (b[1] > y)) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in edges(ring)) % 2 == 1

    def distance(a, b, x, y):
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = dx * dx + dy * dy
        t = max(0, min(1, ((x - a[0]) * dx + (y - a[1]) * dy) / n)) if n else 0
        return math.hypot(x - a[0] - t * dx, y - a[1] - t * dy)

    found = set()
    for pid, s, x, y, _ in points:
        for gid, t, ring, holes, _ in polygons:
            if None in (pid, s, x, y, gid, ring) or s != t or len(ring) < 3:
                continue
            holes_ = [h for h in holes or [] if h is not None]
            if any(distance(a, b, x, y) <= r for h in [ring, *holes_] for a, b in edges(h)) or inside(ring, x, y) and not any(inside(h, x, y) for h in holes_):
                found.add((pid, gid))
    return sorted(found, key=repr)


def star(rng, n, size):
    cx, cy = rng.uniform(0, 1000), rng.uniform(0, 1000)
    return [(cx + size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), cy + size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


@pytest.mark.parametrize("hot", [20, 100_000])
def test_against_brute_force(spark, hot):
    rng = random.Random(3)
    points = [(i, "s%d" % (i % 2), rng.uniform(-100, 1100), rng.uniform(-100, 1100), 1) for i in range(300)]
    polygons = [(i, "s%d" % (i % 2), star(rng, rng.randint(3, 9), 2.0 ** rng.randint(2, 10)), [star(rng, 5, 50)] if i % 3 else None, "g") for i in range(40)]
    got = regions_in_reach(spark.createDataFrame(points, POINTS), spark.createDataFrame(polygons, POLYGONS), 16.0, hot_rows=hot)
    assert rows(got) == brute(points, polygons, 16.0)


def test_edges_of_the_input(spark):
    square = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]
    points = [(1, "s", 50.0, 50.0, 0), (1, "s", 50.0, 50.0, 0), (2, "s", 132.0, 50.0, 0), (3, "s", 133.0, 50.0, 0), (4, None, 50.0, 50.0, 0), (5, "s", None, 1.0, 0), (6, "s", 0.0, 0.0, 0)]
    polygons = [
        (1, "s", square + square[:1], None, ""),
        (1, "s", square + square[:1], None, ""),
        (2, "s", square, [[(10.0, 10.0), (90.0, 10.0), (90.0, 90.0), (10.0, 90.0)], None, []], ""),
        (3, "s", square[:2], [], ""),
        (4, "s", None, None, ""),
        (5, None, square, [], ""),
        (6, "s", [(None, 1.0), *square[:2]], [], ""),
    ]
    p, q = spark.createDataFrame(points, POINTS), spark.createDataFrame(polygons, POLYGONS)
    assert rows(regions_in_reach(p, q, 32.0)) == [(1, 1), (2, 1), (2, 2), (6, 1), (6, 2)]
    assert rows(regions_in_reach(p.limit(0), q, 32.0)) == []
    assert rows(regions_in_reach(p, q.limit(0), 32.0)) == []
    with pytest.raises(ValueError):
        regions_in_reach(p, q, 0)
