import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from pathloom.functions import resize
from pathloom.operators import heatmap, inference, masks

CELL = "slide_id string, x int, y int"


def brute_components(mask):
    labels, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if labels[start]:
            continue
        n += 1
        todo = [start]
        labels[start] = n
        while todo:
            y, x = todo.pop()
            for a, b in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not labels[a, b]:
                    labels[a, b] = n
                    todo.append((a, b))
    return labels, n


def test_components_against_flood_fill():
    rng = np.random.default_rng(1)
    for density in (0.2, 0.5, 0.7):
        mask = rng.random((40, 50)) < density
        got = masks.label_components(mask)
        want, n = brute_components(mask)
        assert got.max() == n and len(set(zip(got.ravel(), want.ravel()))) == n + (not mask.all())
    assert masks.label_components(np.zeros((3, 4), bool)).sum() == 0


def test_mask_cleaning_goldens():
    mask = np.zeros((100, 110), bool)
    mask[20:40, 60:90] = True
    solid = mask.copy()
    mask[25:35, 65:75] = False
    assert (masks.clean_mask(mask, 0, small_holes=0, small_objects=0, all_holes=True) == solid).all()
    one = solid.copy()
    one[25, 65] = False
    assert (masks.clean_mask(one, 3, small_holes=0.1, small_objects=0) == solid).all()
    assert (masks.clean_mask(mask, 3, small_holes=0.1, small_objects=0) == mask).all()
    dot = solid.copy()
    dot[0, 0] = True
    assert (masks.clean_mask(dot, 3, small_holes=0, small_objects=0.1) == solid).all()
    gap = solid.copy()
    gap[30, 60:90] = False
    assert (masks.close_mask(gap, 3) == solid).all() and (masks.close_mask(solid, 4) == solid).all()
    assert [masks.level_factor(v) for v in range(4)] == pytest.approx([65536, 4096, 256, 16], rel=1e-2)


def test_clean_cells_and_polygon_cells(spark):
    cells = spark.createDataFrame([("s", x, y) for x in range(10) for y in range(10) if (x, y) != (5, 5)] + [("s", 30, 30), ("t", 1, 1), (None, 1, 1), ("s", 99, 1)], CELL)
    sizes = spark.createDataFrame([("s", 40, 40), ("s", 40, 40)], "slide_id string, width int, height int")
    got = masks.clean_cells(cells, sizes, 3, small_holes=0.1, small_objects=0.1)
    assert {(r.x, r.y) for r in got.collect()} == {(x, y) for x in range(10) for y in range(10)}
    ring = "slide_id string, points array<struct<x:double,y:double>>"
    p = spark.createDataFrame([("s", [(2.9, 2.0), (6.0, 2.0), (6.0, 4.0), (2.0, 4.0)]), ("s", None)], ring)
    assert {(r.x, r.y) for r in masks.polygon_cells(p, sizes).collect()} == {(x, y) for x in range(2, 7) for y in range(2, 5)}
    with pytest.raises(Exception, match="exceed"):
        masks.polygon_cells(spark.createDataFrame([("s", [(2.0, 2.0), (41.0, 2.0), (6.0, 4.0)])], ring), sizes).collect()
    assert rows(masks.outline_cells(spark.createDataFrame([("s", x, y) for x in range(3) for y in range(3)], CELL))) == sorted([("s", x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)], key=repr)


def test_tissue_modes(spark):
    rng = np.random.default_rng(2)
    rgb = rng.integers(0, 256, (400, 3))
    df = spark.createDataFrame([("s", i, 0, *map(int, c)) for i, c in enumerate(rgb)] + [("s", 999, 0, None, 1, 1)], CELL + ", r int, g int, b int")
    top, low = rgb.max(axis=1), rgb.min(axis=1)
    sat = np.where(top > 0, (top - low) / np.maximum(top, 1), 0)
    assert {r.x for r in masks.tissue_cells(df, "hsv", 0.1).collect()} == set(np.flatnonzero(sat > 1.1 * sat.mean()))
    gray = np.floor(rgb @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(int)
    best = max(range(256), key=lambda t: ((gray <= t).sum() * (gray > t).sum() * (gray[gray <= t].mean() - gray[gray > t].mean()) ** 2 if (gray <= t).any() and (gray > t).any() else -1, -t))
    assert masks.otsu_thresholds(df.filter("r is not null").select("slide_id", masks.gray().alias("gray"))).first().threshold == best
    assert {r.x for r in masks.tissue_cells(df, "otsu").collect()} == set(np.flatnonzero(gray <= best))
    red, green = spark.createDataFrame([("s", 0, 0, 255, 0, 0), ("s", 1, 0, 0, 255, 0)], CELL + ", r int, g int, b int").select(masks.green_red()).collect()
    assert red[0] == pytest.approx(80.1, abs=0.1) and green[0] == pytest.approx(-86.2, abs=0.1)
    with pytest.raises(ValueError):
        masks.tissue_cells(df, "other")
    over = masks.overlay_pixels(df.filter("x < 2"), spark.createDataFrame([("s", 0, 0)], CELL), outline_rgb=None).orderBy("x").collect()
    assert over[0].g == int(rgb[0, 1] * (1 - 128 / 255) + 128 * 128 / 255 + 0.5) and over[1].g == rgb[1, 1]


def outputs(spark, data, shape):
    return spark.createDataFrame([("s", x, y, n, 100, 60, shape, v) for x, y, n, v in data], "slide_id string, px long, py long, psize long, raster_w int, raster_h int, shape array<int>, output array<float>")


def test_stitching_against_numpy(spark):
    rng = np.random.default_rng(3)
    data = [(int(rng.integers(-10, 95)), int(rng.integers(-10, 58)), 16, [float(np.float32(rng.random())) for _ in range(2)]) for _ in range(30)]
    total, count = np.zeros((2, 100, 60)), np.zeros((2, 100, 60), int)
    for x, y, n, v in data:
        for c in range(2):
            total[c, max(x, 0) : x + n, max(y, 0) : y + n] += v[c]
            count[c, max(x, 0) : x + n, max(y, 0) : y + n] += 1
    got = inference.stitch(outputs(spark, data, [2]), classes=2).collect()
    assert len(got) == (count > 0).sum()
    assert all(abs(r.prob - total[r["class"], r.x, r.y] / count[r["class"], r.x, r.y]) < 1e-9 for r in got)


def test_maps_are_turned_and_resized(spark):
    image = np.arange(16, dtype=np.float32).reshape(4, 4)
    got = {(r.x, r.y): r.prob for r in inference.stitch(outputs(spark, [(30, 58, 4, image.ravel().tolist())], [1, 4, 4]), classes=1, maps=True).collect()}
    assert got == {(30 + x, 58 + y): float(image[y, x]) for x in range(4) for y in range(2)}
    wide = inference.stitch(outputs(spark, [(0, 0, 8, image.ravel().tolist())], [1, 4, 4]), classes=1, maps=True)
    assert wide.count() == 64 and wide.agg(F.avg("prob")).first()[0] == pytest.approx(7.5)
    twice = inference.stitch(outputs(spark, [(0, 0, 4, image.ravel().tolist()), (2, 0, 4, image.ravel().tolist())], [1, 4, 4]), classes=1, maps=True)
    assert {(r.x, r.y): r.prob for r in twice.collect()}[2, 1] == (image[1, 2] + image[1, 0]) / 2
    for maps in (False, True):
        assert inference.stitch(outputs(spark, [], [1]), classes=1, maps=maps).count() == 0
        with pytest.raises(Exception, match="another rank"):
            inference.stitch(outputs(spark, [(0, 0, 4, [1.0, 0.0])], [2]), classes=2 if maps else 3, maps=maps).collect()


def test_predictions_and_footprints(spark):
    images = spark.createDataFrame([(i, 2, 2, 3, bytes([i * 10] * 12)) for i in range(5)], "region_id long, width int, height int, n_channels int, data binary")
    model = lambda: lambda b: np.stack([b.mean(axis=(1, 2, 3)), 1 - b.mean(axis=(1, 2, 3))], axis=1)
    got = inference.predictions(images, model, classes=2, batch=2, classifier=lambda o: o * 2).orderBy("region_id").collect()
    assert [r.output[0] for r in got] == pytest.approx([2 * i * 10 / 255 for i in range(5)]) and got[0]["shape"] == [2]
    for bad in (3, 1):
        with pytest.raises(Exception, match="classes"):
            inference.predictions(images, model, classes=bad).collect()
    drawn = [inference.predictions(images, lambda: lambda b: np.random.rand(len(b), 1), classes=1, seed=s).coalesce(1).orderBy("region_id").collect() for s in (1, 1, 2)]
    assert drawn[0] == drawn[1] != drawn[2]
    with pytest.raises(Exception, match="rank"):
        inference.predictions(images, lambda: lambda b: b.mean(axis=1), classes=2).collect()
    levels = spark.createDataFrame([("s", 0, 2560, 3072, 1.0, 0.25, 40), ("s", 1, 640, 768, 4.0, 1.0, 40)], "slide_id string, slide_level int, width int, height int, downsample double, mpp double, magnification int")
    p = inference.footprints(spark.createDataFrame([("s", 1023, 7)], "slide_id string, x int, y int"), levels, patch_size=256, raster_level=1).first()
    assert (p.px, p.py, p.psize, p.raster_w, p.raster_h) == (255, 1, 64, 640, 768)


def test_heatmap_goldens(spark):
    cells = spark.createDataFrame([("s", 0, 0, 0.25), ("s", 1, 0, 0.75), ("s", 2, 0, 0.0), ("s", 3, 0, 1.0), ("s", 4, 0, float("nan")), ("s", 5, 0, None)], CELL + ", prob double")
    run = lambda **k: [(r.r, r.g, r.b, r.a) for r in heatmap.colored(cells, **k).orderBy("x").collect()]
    assert run() == [(0, 128, 255, 255), (255, 148, 0, 255), (0, 0, 127, 255), (127, 0, 0, 255), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert run(vmin=0, vmax=1, alpha=0.5, background="white", cutoff=0.5)[:3] == [(255, 255, 255, 128), (255, 148, 0, 128), (255, 255, 255, 128)]
    assert tuple(heatmap.value_range(cells).first())[1:] == (0.0, 1.0)
    with pytest.raises(Exception, match="range is empty"):
        heatmap.colored(cells.filter("x = 0")).collect()
    pixels = cells.select("slide_id", "x", "y", *[F.lit(100).alias(c) for c in "rgb"])
    assert [r.g for r in heatmap.overlaid(pixels, heatmap.colored(cells)).orderBy("x").collect()] == [128, 148, 0, 0, 100, 100]
    byte = lambda v: spark.range(1).select(inference.byte_probability(F.lit(v).cast("double"))).first()[0]
    assert [byte(v) for v in (0.0, 0.999, 1.0, None, float("nan"))] == [0, 254, 255, 0, 0]
    with pytest.raises(Exception, match="outside"):
        byte(1.2)


def test_resizing():
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (30, 40, 3), dtype=np.uint8)
    assert (resize.resize(image, 20, 15, "BOX") == np.floor(np.floor(image.reshape(30, 20, 2, 3).mean(axis=2) + 0.5).reshape(15, 2, 20, 3).mean(axis=1) + 0.5)).all()
    for method in resize.FILTERS:
        flat = resize.resize(np.full((9, 7, 3), 77, np.uint8), 13, 4, method)
        assert flat.shape == (4, 13, 3) and (flat == 77).all()
        assert resize.resize(image, 40, 30, method) is image
    with pytest.raises(KeyError):
        resize.resize(image, 3, 3, "ODD")
    black = np.zeros((6, 6, 3), np.uint8)
    black[1:3, 1:5] = 9
    white = resize.white_borders(black)
    assert (white[0] == 255).all() and (white[:, 5] == 255).all() and (white == 255).all()
    edge = np.full((6, 6, 3), 9, np.uint8)
    edge[4:] = 0
    assert (resize.white_borders(edge)[4:] == 255).all() and (resize.white_borders(edge)[:4] == 9).all()
