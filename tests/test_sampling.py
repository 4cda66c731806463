import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from pathloom.functions import planar
from pathloom.functions.geometry import edges, window_area
from pathloom.operators import masks, patches, regions, sampling
from pathloom.operators.sampling import Patches

POLYGON = "slide_id string, polygon_id long, label string, points array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>, f double, seq int"
SQUARE, TRIANGLE = [(20.0, 20.0), (20.0, 1020.0), (1020.0, 1020.0), (1020.0, 20.0)], [(1200.0, 1500.0), (1200.0, 2800.0), (2500.0, 2800.0)]


def polygons(spark, shapes, f=4.0, slide="s"):
    return spark.createDataFrame([(slide, i, label, ring, holes, f, 0) for i, (label, ring, holes) in enumerate(shapes)], POLYGON)


def full_mask(spark, w, h):
    return spark.range(w).select(F.lit("s").alias("slide_id"), F.col("id").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("y"))


@pytest.fixture(scope="module")
def board(spark):
    """640 x 768 mask of a 2560 x 3072 slide, all foreground."""
    return full_mask(spark, 640, 768).cache()


@pytest.mark.parametrize("size,stride,overlap,want", [(256, 1, 0.8, (16, 10)), (256, 0.5, 0.8, (49, 36)), (256, 0.5, 1.0, (36, 28)), (128, 0.5, 0.8, (224, 171))])
def test_polygon_grid_counts(spark, board, size, stride, overlap, want):
    p = Patches(size, mask_factor=4.0, overlap_ratio=overlap, foreground_ratio=0.8)
    shapes = polygons(spark, [("area1", SQUARE, None), ("area2", TRIANGLE, None)])
    found = sampling.sample(sampling.grid_candidates(regions.polygon_regions(shapes, factor="f"), p, stride), p, board)
    assert rows(patches.label_counts(found, shapes)) == [("area1", want[0]), ("area2", want[1])]
    assert patches.count_map(patches.label_counts(found, shapes)).first()[0] == {"area1": want[0], "area2": want[1]}


def test_exact_places(spark, board):
    p = Patches(512, mask_factor=4.0, overlap_ratio=0.95, foreground_ratio=0.8)
    r = regions.polygon_regions(polygons(spark, [("area1", SQUARE, None), ("area2", TRIANGLE, None)]), factor="f")
    found = sampling.sample(sampling.grid_candidates(r, p, 1), p, board).orderBy("region_id", "seq")
    assert [(f.x, f.y, f.w, f.h, f.label) for f in found.collect()] == [(20, 20, 512, 512, "area1"), (532, 20, 512, 512, "area1"), (20, 532, 512, 512, "area1"), (1200, 2012, 512, 512, "area2")]


@pytest.mark.parametrize("size,stride,target,want", [(256, 1, 1.0, 120), (256, 1, 4.0, 6), (256, 0.5, 1.0, 437), (128, 1, 1.0, 480), (128, 0.5, 1.0, 1833)])
def test_whole_mask_counts(spark, board, size, stride, target, want):
    p = Patches(size, mask_factor=4.0, target_factor=target)
    assert sampling.sample(sampling.grid_candidates(regions.whole_mask_regions(board), p, stride), p, board).count() == want


def test_rounding_keeps_patches_on_the_edge(spark):
    p = Patches(512, mask_factor=16.003898842372223, overlap_ratio=1.0, foreground_ratio=0.0)
    ring = [(15000.0, 15000.0), (15000.0, 20000.0), (20000.0, 20000.0), (20000.0, 15000.0)]
    r = regions.polygon_regions(polygons(spark, [("", ring, None)], f=16.003898842372223), factor="f")
    assert sampling.sample(sampling.grid_candidates(r, p, 1), p).count() == 81


#: Patch size, stride and count of the published workloads on a slide of 27818 x 31316 pixels.
WORKLOADS = [(256, 1.0, 13_176), (256, 0.5, 52_488), (256, 0.25, 209_466), (65, 1.0, 205_387)]


@pytest.mark.parametrize("size,stride,count", WORKLOADS)
def test_large_slide(spark, size, stride, count):
    cells = full_mask(spark, 1738, 1957)
    p = Patches(size, mask_factor=16.003898842372223)
    assert sampling.sample(sampling.grid_candidates(regions.whole_mask_regions(cells), p, stride), p, cells).count() == count


def test_random_poisson_and_points(spark, board):
    p = Patches(256, mask_factor=4.0, overlap_ratio=0.5)
    r = regions.whole_mask_regions(board, "w")
    draw = lambda seed: sampling.sample_random(r, p, 20, board, seed=seed)
    assert draw(1).count() == 20 and rows(draw(1)) == rows(draw(1)) != rows(draw(2))
    corner = board.filter("x < 30 and y < 30")
    for least in (0.8, 0.01):  # no valid place at all, and some but too few
        few = Patches(256, mask_factor=4.0, overlap_ratio=0.5, foreground_ratio=least)
        with pytest.raises(ValueError, match="enough random patches"):
            sampling.sample_random(r, few, 200, corner, seed=1)
        assert sampling.sample_random(r, few, 200, corner, seed=1, strict=False).count() < 200
    found = sampling.valid_candidates(sampling.poisson_candidates(r, p, 50, seed=3), p, board).select("mx", "my").collect()
    assert len(found) > 50 and min(math.dist(a, b) for i, a in enumerate(found) for b in found[:i]) >= 50
    points = spark.createDataFrame([("s", 1, 0, 0, 7), ("s", 2, 2500, 3000, 7), ("s", 3, 900, 900, 7), ("t", 4, 0, 0, 7), (None, 5, 1, 1, 7), ("s", None, 1, 1, 7)], "slide_id string, seq int, x int, y int, level int")
    assert rows(sampling.sample(sampling.point_candidates(r, points, p), p, board).select("x", "y", "label")) == [(0, 0, "w"), (900, 900, "w")]
    loose = Patches(256, mask_factor=4.0, overlap_ratio=0.0, foreground_ratio=0.0)
    assert sampling.sample(sampling.point_candidates(r, points, loose), loose).count() == 3


def test_points_meet_regions_as_in_brute_force(spark):
    rng = random.Random(2)
    shapes = []
    for i in range(25):
        x, y, s = rng.uniform(0, 4000), rng.uniform(0, 4000), 2.0 ** rng.randint(3, 11)
        shapes.append((f"l{i}", [(x, y), (x + s, y), (x + s, y + s), (x, y + s)], None))
    points = spark.createDataFrame([("s", i, rng.randint(-200, 5000), rng.randint(-200, 5000)) for i in range(200)], "slide_id string, seq int, x int, y int")
    p = Patches(128, mask_factor=4.0, overlap_ratio=0.25, foreground_ratio=0.0)
    r = regions.polygon_regions(polygons(spark, shapes), factor="f")
    got = sampling.valid_candidates(sampling.point_candidates(r, points, p, hot_rows=50), p)
    brute = sampling._box(r).drop("bx1", "by1", "bx2", "by2").crossJoin(points.select(F.col("seq").cast("long").alias("seq"), (F.col("x") / 4).alias("mx"), (F.col("y") / 4).alias("my"))).withColumn("msize", F.lit(32.0))
    assert rows(got.select("region_id", "seq")) == rows(sampling.valid_candidates(brute, p).select("region_id", "seq"))


def test_labels_strides_and_empty_tables(spark, board):
    shapes = polygons(spark, [("a", SQUARE, None), ("b", TRIANGLE, None), (None, SQUARE, None), ("c", None, None), ("c", SQUARE[:2], [])])
    labels = lambda **k: [r.region_id for r in regions.polygon_regions(shapes, **k).orderBy("region_id").collect()]
    assert labels() == [0, 1, 2] and labels(included=["a"]) == [0] and labels(excluded=["a"]) == [1, 2]
    with pytest.raises(ValueError):
        labels(included=["a"], excluded=["b"])
    p = Patches(256, mask_factor=4.0, foreground_ratio=0.0)
    r = regions.polygon_regions(shapes, factor="f")
    for stride in (0.001, 6):
        with pytest.raises(Exception, match="stride"):
            sampling.grid_candidates(r, p, stride).collect()
    assert sampling.sample(sampling.grid_candidates(r.limit(0), p), p, board).count() == 0
    assert sampling.sample(sampling.grid_candidates(r, Patches(256, mask_factor=4.0)), Patches(256, mask_factor=4.0), board.limit(0)).count() == 0


def test_foreground_against_numpy(spark):
    rng = np.random.default_rng(4)
    mask = rng.random((150, 200)) < 0.3
    cells = spark.createDataFrame([("s", int(x), int(y), -1) for x, y in zip(*np.nonzero(mask))] + [("s", None, 1, 0), (None, 1, 1, 0), ("s", -4, 2, 0)], "slide_id string, x int, y int, bits int")
    windows = [("s", i, float(rng.uniform(-5, 160)), float(rng.uniform(-5, 210)), float(rng.uniform(0.2, 90))) for i in range(200)] + [("other", 999, 1.0, 1.0, 5.0)]
    got = {r.window_id: r.foreground for r in masks.foreground_ratio(spark.createDataFrame(windows, "slide_id string, window_id long, mx double, my double, msize double"), cells, hot_rows=20).collect()}
    for slide, i, x, y, s in windows:
        x1, y1, x2, y2 = round(x), round(y), round(x + s), round(y + s)
        size = (x2 - x1) * (y2 - y1)
        want = round(int(mask[x1:x2, y1:y2].sum()) / size, 10) if slide == "s" and size and x1 >= 0 and y1 >= 0 else 0.0
        assert got[i] == want
    assert len(got) == len(windows)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 62)), min_size=3, max_size=9, unique_by=lambda v: v[1]), st.integers(-15, 15), st.integers(-15, 15), st.integers(1, 20))
def test_window_area_equals_the_planar_kernel(spark, spokes, x, y, s):
    ring = [(r * math.cos(t / 10), r * math.sin(t / 10)) for r, t in sorted(spokes, key=lambda v: v[1])]
    df = spark.createDataFrame([([{"x": a, "y": b} for a, b in ring],)], "r array<struct<x:double,y:double>>")
    got = df.select(window_area(edges(F.col("r")), *[F.lit(float(v)) for v in (x, y, x + s, y + s)])).first()[0]
    square = planar.make_valid([(x, y), (x + s, y), (x + s, y + s), (x, y + s)])
    assert got == pytest.approx(planar.polygon_area(planar.intersection(planar.make_valid(ring), square)), abs=1e-5)


def test_distinct_patches_keep_the_first(spark):
    df = spark.createDataFrame([("s", 0, 2, 1, 1, 5, 5, None, 0.1), ("s", 0, 1, 1, 1, 5, 5, None, 0.2), ("s", 1, 0, 1, 1, 5, 5, None, 0.3), ("s", 0, 3, 1, 1, 5, 5, "a", 0.4)], "slide_id string, region_id int, seq int, x int, y int, w int, h int, label string, mx double")
    assert rows(sampling.distinct_patches(df).select("region_id", "seq", "label", "mx")) == [(0, 1, None, 0.2), (0, 3, "a", 0.4)]


def test_relations_nesting_and_inversion(spark, board):
    box = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    shapes = polygons(spark, [("a", box(0.0, 0.0, 100.0), None), ("b", box(10.0, 10.0, 30.0), None), ("c", box(15.0, 15.0, 5.0), None), ("d", box(90.0, 90.0, 50.0), None), ("e", box(500.0, 0.0, 9.0), None)], f=1.0)
    valid = regions.repaired_regions(regions.polygon_regions(shapes))
    rel = regions.region_relations(valid, hot_rows=2)
    assert rows(rel.select("a", "b", "relation", F.round("shared", 6))) == [(0, 1, "contains", 900.0), (0, 2, "contains", 25.0), (0, 3, "overlaps", 100.0), (1, 2, "contains", 25.0)]
    assert rows(regions.overlap_report(rel, 50.0, 2.0).select("a", "b", "patches")) == [(0, 3, 2.0)]
    nested = {r.region_id: len(r.parts[0].holes) for r in regions.nested_regions(valid).collect()}
    assert nested == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0}
    inverted = regions.inverted_regions(board, polygons(spark, [("a", SQUARE, None), ("a", [(x + 500, y) for x, y in SQUARE], None), ("b", TRIANGLE, None)]), factor="f").first()
    assert len(inverted.parts[0].holes) == 2 and inverted.label == ""
    with pytest.raises(Exception, match="empty"):
        regions.repaired_regions(regions.polygon_regions(shapes), buffer=-3.0).collect()
    assert regions.region_relations(valid.limit(0)).count() == 0


def test_numbers_and_sets(spark):
    df = spark.createDataFrame([("b", 70_000 * i) for i in range(5)] + [("a", 3 * i) for i in range(4)] + [(None, 1)], "slide_id string, seq long")
    assert [r.number for r in patches.numbered(df, "seq", start=10).orderBy("number").collect()] == list(range(10, 20))
    per = {(r.slide_id, r.seq): r.set_number for r in patches.set_numbers(df.dropna(), per_slide=True).collect()}
    assert per[("a", 9)] == 4 and per[("b", 70_000)] == 2
    total = {(r.slide_id, r.seq): r.set_number for r in patches.set_numbers(df.dropna()).collect()}
    assert total[("a", 9)] == 4 and total[("b", 0)] == 5
    room = spark.createDataFrame([("a", 10), ("b", 5)], "slide_id string, n int")
    assert {r.set_number for r in patches.set_numbers(df.filter("slide_id = 'b'"), reserved=room).collect()} == set(range(11, 16))
    assert spark.range(1).select(patches.set_count(F.lit(12), 4)).first()[0] == 3
    with pytest.raises(Exception, match="multiple"):
        spark.range(1).select(patches.set_count(F.lit(13), 4)).collect()


def test_problems_and_pool_counts(spark):
    df = spark.createDataFrame([("s", 1, 1, "a"), ("s", 1, 1, "b"), ("t", 1, 1, "z"), (None, 2, 2, None)], "slide_id string, x int, y int, label string")
    assert rows(patches.problems(df, spark.createDataFrame([("a",), ("b",), (None,)], "label string"))) == [("s", "duplicate location", "1,1", 2), ("t", "unknown label", "z", 1)]
    pool = {(r.by_slide, r.by_label): r.n for r in patches.pool_counts(df).filter("by_slide = 0 and by_label = 0").collect()}
    assert pool == {(0, 0): 4}


def test_chains_of_touching_regions_are_one_cluster(spark):
    rng = random.Random(4)
    order = list(range(120))
    rng.shuffle(order)
    chain = [(f"l{k}", [(10.0 * k, 0.0), (10.0 * k + 12, 0.0), (10.0 * k + 12, 9.0), (10.0 * k, 9.0)], None) for k in order]
    far = [("far", [(9000.0, 9000.0), (9010.0, 9000.0), (9010.0, 9010.0)], None)]
    r = regions.polygon_regions(polygons(spark, chain + far))
    found = {x.region_id: x.cluster for x in regions._touching(r).select("region_id", "cluster").collect()}
    assert found == {**{i: 0 for i in range(120)}, 120: 120}


def test_numbers_of_sparse_ids_in_ranges(spark):
    rng = random.Random(6)
    ids = rng.sample(range(10**12), 500)
    df = spark.createDataFrame([(i, "hot" if k % 2 else rng.choice(["a", None])) for k, i in enumerate(ids)], "id long, g string")
    got = patches.numbered(patches.numbered(df, "id", start=5, name="n"), "id", group="g", name="m").collect()
    overall = {i: n + 5 for n, i in enumerate(sorted(ids))}
    assert {r.id: r.n for r in got} == overall
    for g in ("hot", "a", None):
        own = sorted(r.id for r in got if r.g == g)
        assert {r.id: r.m for r in got if r.g == g} == {i: n for n, i in enumerate(own)}
    assert patches.numbered(df.limit(0), "id").count() == 0
