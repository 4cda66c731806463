"""Plans that hold whatever the bytes of their inputs let the planner expect."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows
from pathloom.functions import codecs
from pathloom.functions.resize import resize
from pathloom.operators import inference, masks, outputs, pixels, regions
from pathloom.plans import slide_oracles, slides
from pathloom.plans.slides import _spread_check
from pathloom.sources.slides import TILES, cut_tiles


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def finished(df):
    """The adaptive plan after a run."""
    df.collect()
    return planned(df).split("Initial Plan")[0]


IMAGE = np.random.default_rng(4).integers(0, 256, (150, 200, 3)).astype(np.uint8)
LEVEL = "slide_id string, wsi_file string, slide_level int, width int, height int, downsample double, mpp double, magnification int"
REQUEST = "slide_id string, region_id long, x int, y int, slide_level int, mpp double, w int, h int"


def _regions(spark, data, **reading):
    levels = spark.createDataFrame([("s", "s.svs", 0, 200, 150, 1.0, 0.25, 40)], LEVEL)
    painted = lambda frames: (t for f in frames for _ in f.itertuples() for t in cut_tiles("s", 0, IMAGE, 32))
    images = pixels.read_regions(spark.createDataFrame(data, REQUEST), levels.mapInPandas(painted, TILES), levels, tile=32, skip_padding=True, **reading)
    out = {r.region_id: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) for r in images.collect()}
    plan = planned(images)
    # The tiles are joined without a broadcast, and cut before they are shuffled again.
    assert re.search(r"SortMergeJoin \[[^]]*tx", plan) and not re.search(r"BroadcastHashJoin \[[^]]*tx#\d+L?, ty#\d+L?, _salt", plan)
    assert "_cut_to_window" in plan
    return out


def test_tile_mode_without_a_broadcast_of_tiles(spark):
    out = _regions(spark, [("s", 1, 20, 30, None, 0.5, 25, 10), ("s", 2, 0, 0, None, 0.5, 90, 70)], mode="tile", method="BOX")
    assert (out[1] == resize(IMAGE[30:50, 20:70], 25, 10, "BOX")).all() and (out[2] == resize(IMAGE[:140, :180], 90, 70, "BOX")).all()


def test_wsi_mode_without_a_broadcast_of_tiles(spark):
    out = _regions(spark, [("s", 1, 21, 31, None, 0.5, 25, 10), ("s", 2, 0, 0, None, 0.5, 90, 70)], mode="wsi", method="BOX")
    assert (out[1] == resize(IMAGE[32:52, 20:70], 25, 10, "BOX")).all() and (out[2] == resize(IMAGE[:140, :180], 90, 70, "BOX")).all()


def test_native_regions_without_a_broadcast_of_tiles(spark):
    out = _regions(spark, [("s", 1, 30, 30, 0, None, 5, 5), ("s", 2, 10, 20, 0, None, 70, 40), ("s", 3, -9, -9, 0, None, 30, 30), ("s", 4, 190, 140, 0, None, 30, 30)])
    assert (out[1] == IMAGE[30:35, 30:35]).all() and (out[2] == IMAGE[20:60, 10:80]).all()
    assert (out[3][9:, 9:] == IMAGE[:21, :21]).all() and not out[3][:9].any()
    assert (out[4][:10, :10] == IMAGE[140:, 190:]).all() and not out[4][10:].any()


def test_overlay_meets_blocks_and_is_not_broadcast(spark):
    rng = np.random.default_rng(6)
    for low, share in ((0, 0.7), (-70, 0.95)):
        mask = rng.random((140, 131)) < share
        cells = spark.createDataFrame([("s", int(x) + low, int(y) + low) for x, y in np.argwhere(mask)] + [("t", 63, 63), ("s", None, 2)], "slide_id string, x long, y long")
        side = F.explode(F.sequence(F.lit(low - 1), F.lit(low + 141)))
        seen = spark.createDataFrame([("s",), ("t",), (None,)], "slide_id string").withColumn("x", side).withColumn("y", side).withColumns({c: F.lit(200) for c in "rgb"})
        over = masks.overlay_pixels(seen, cells, mask_rgb=(1, 1, 1), alpha=1.0, outline_rgb=(9, 9, 9))
        got = over.toPandas()
        assert len(got) == 3 * 143 * 143
        of = lambda c: {(r.slide_id, r.x, r.y) for r in got[got.r == c].itertuples()}
        edge = {tuple(r) for r in masks.outline_cells(cells.dropna()).collect()}
        held = {tuple(r) for r in cells.dropna().collect()}
        assert of(9) == edge and of(1) == held - edge
    assert "BroadcastHashJoin" not in finished(over)


def test_spread_of_points_is_checked_without_a_broadcast(spark):
    box = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    ring = "array<struct<x:double,y:double>>"
    points = [("s", 1, i, x, y, [(box, [])]) for i, (x, y) in enumerate([(1.0, 1.0), (1.5, 1.0), (7.0, 7.0), (2.1, 2.1)])]
    c = spark.createDataFrame(points, f"slide_id string, region_id long, seq long, mx double, my double, parts array<struct<ext:{ring},holes:array<{ring}>>>")
    checked = _spread_check(c, c.filter("seq < 2"), 1.0)
    assert rows(checked) == [("s", 1, True, 1, True, True)]
    assert "cx" not in "".join(x for x in planned(checked).splitlines() if "BroadcastHashJoin" in x)


def test_inverted_regions_are_merged_once(spark):
    ring = "array<struct<x:double,y:double>>"
    square = lambda x, y: [(x, y), (x + 2.0, y), (x + 2.0, y + 2.0), (x, y + 2.0)]
    polygons = spark.createDataFrame([("s", 1, "a", square(1.0, 1.0), None), ("s", 2, "a", square(2.0, 2.0), None), ("s", 3, "a", square(6.0, 6.0), None)], f"slide_id string, polygon_id long, label string, points {ring}, holes array<{ring}>")
    cells = spark.createDataFrame([("s", 0, 0), ("s", 9, 9)], "slide_id string, x long, y long")
    inverted = regions.inverted_regions(cells, polygons)
    assert "FlatMapGroupsInArrow" not in planned(inverted)
    holes = inverted.first().parts[0]["holes"]
    assert sorted(len(h) for h in holes) == [4, 8]


OUTPUTS = "slide_id string, px long, py long, psize long, raster_w int, raster_h int, shape array<int>, output array<double>"


def test_stitched_class_images_hold_no_rows_of_cells(spark):
    rng = np.random.default_rng(8)
    data = [(str(rng.choice(["s", "t"])), int(rng.integers(-9, 60)), int(rng.integers(-9, 40)), int(rng.integers(0, 9)), 57, 38, [2], [p := float(rng.integers(0, 100)) / 100, 1 - p]) for _ in range(300)]
    data += [("beyond", 99, 0, 4, 57, 38, [2], [0.5, 0.5]), (None, 0, 0, 4, 57, 38, [2], [0.5, 0.5]), ("no size", 0, 0, 4, None, 38, [2], [0.5, 0.5]), ("no value", 0, 0, 4, 57, 38, [2], [None, None])]
    values = spark.createDataFrame(data, OUTPUTS)
    sizes = values.filter("raster_w is not null").selectExpr("slide_id", "raster_w as width", "raster_h as height")
    probs = inference.stitch(values.filter("raster_w is not null"), classes=2).withColumn("prob", F.round("prob", 9))
    for c in (0, 1):
        images = outputs.stitched_class_images(values, classes=2, of_class=c)
        assert not re.search("Generate|FlatMapCoGroups", planned(images))
        got = {r.slide_id: bytes(r.png) for r in images.collect()}
        assert got == {r.slide_id: bytes(r.png) for r in outputs.class_images(probs, sizes, of_class=c).collect()}
        assert set(got) == {"s", "t", "beyond", "no value"} and not codecs.read_png(got["beyond"]).any()
    for bad, text in ((("s", 0, 0, 4, 9, 9, [2], [1.5, 0.0]), "outside"), (("s", 0, 0, 4, 9, 9, [3], [0.5, 0.0]), "number of classes")):
        with pytest.raises(Exception, match=text):
            outputs.stitched_class_images(spark.createDataFrame([bad], OUTPUTS), classes=2, of_class=0).collect()


def test_wsi_mode_shuffles_places_of_tiles_and_draws_those_it_reads(spark):
    def drawn(tile):
        assert (tile["tx"], tile["ty"]) in {(0, 1), (1, 1), (2, 1)} and tile["note"] == "kept"
        return IMAGE[tile["y0"] : tile["y0"] + tile["height"], tile["x0"] : tile["x0"] + tile["width"]]

    levels = spark.createDataFrame([("s", "s.svs", 0, 200, 150, 1.0, 0.25, 40)], LEVEL)
    places = [("s", 0, x // 32, y // 32, x, y, min(32, 200 - x), min(32, 150 - y), "kept") for y in range(0, 150, 32) for x in range(0, 200, 32)]
    tiles = spark.createDataFrame(places, "slide_id string, slide_level int, tx int, ty int, x0 int, y0 int, width int, height int, note string")
    requests = spark.createDataFrame([("s", i, 21 + i, 33, None, 0.5, 25, 10) for i in range(5)], REQUEST)
    images = pixels.read_regions(requests, tiles, levels, tile=32, skip_padding=True, mode="wsi", method="BOX", hot_rows=2, draw=drawn)
    out = {r.region_id: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) for r in images.collect()}
    for i in range(5):
        left, top = 2 * round((21 + i) / 2), 2 * round(33 / 2)
        assert (out[i] == resize(IMAGE[top : top + 20, left : left + 50], 25, 10, "BOX")).all()
    joined = re.search(r"Project \[([^]]*)\]\n[^\n]*SortMergeJoin", planned(images))[1]
    assert "_tile#" in joined and "data#" not in joined


def test_cut_windows_are_yielded_in_small_batches(monkeypatch):
    monkeypatch.setattr(pixels, "_OUT_BYTES", 2000)
    drawn = []
    row = lambda i, x: {"region_id": i, "x0": x, "y0": 0, "tw": 32, "th": 32, "rx": x + i, "ry": 2, "rw": 20, "rh": 10, "_tile": {"x": x}}
    given = [row(i, x) for x in (0, 32, 64) for i in range(4)]
    got = list(pixels._cut_to_window([pa.RecordBatch.from_pylist(given)], lambda t: drawn.append(t["x"]) or IMAGE[:32, t["x"] : t["x"] + 32]))
    assert drawn == [0, 32, 64] and len(got) > 3
    for want, r in zip(given, (r for b in got for r in b.to_pylist()), strict=True):
        wide = min(20, 32 - want["region_id"])
        assert (r["region_id"], r["x0"], r["y0"], r["tw"], r["th"]) == (want["region_id"], want["rx"], 2, wide, 10)
        assert r["data"] == IMAGE[2:12, want["rx"] : want["rx"] + wide].tobytes()


def test_native_query_shuffles_no_pixels_and_reads_slides_of_any_size(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    sizes = {"s": (30000, 20000), "edge": (16384, 16385), "narrow": (200, 20000), "flat": (20000, 200), "dot": (256, 256), None: (9000, 9000)}
    levels = [(s, f"{s}.svs", level, w >> 2 * level, h >> 2 * level, 4.0**level, 0.25 * 4**level, 40) for s, (w, h) in sizes.items() for level in (0, 1)]
    rng = np.random.default_rng(9)
    points = [(60 * k + i, s, i, int(rng.integers(-3000, w + 3000)), int(rng.integers(-3000, h + 3000))) for k, (s, (w, h)) in enumerate(sizes.items()) for i in range(60)]
    spark.createDataFrame(levels + levels[:3], LEVEL).write.parquet(f"{tmp_path}/slide_levels.parquet")
    spark.createDataFrame(points + points[:9], "point_id long, slide_id string, seq int, x long, y long").write.parquet(f"{tmp_path}/points.parquet")
    out = slides.region_native(spark, str(tmp_path))
    assert "MapInPandas" not in planned(out)
    db = duckdb.connect()
    for name in ("points", "slide_levels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = db.execute(f"SELECT {', '.join(out.columns)} FROM ({slide_oracles.ORACLES['region_native']})").fetchall()
    assert rows(out) == sorted(want, key=repr) and len(want) > 100


def test_region_queries_resolve_their_requests_once(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    sizes = {"s": (40000, 30000, 0.25), "no mpp": (30000, 20000, None), "small": (5000, 4000, 0.5), "unread": (20000, 20000, 0.25)}
    levels = [(s, f"{s}.svs", level, w >> 2 * level, h >> 2 * level, 4.0**level, mpp and mpp * 4**level, 40) for s, (w, h, mpp) in sizes.items() for level in (0, 1)]
    rng = np.random.default_rng(12)
    points = [(40 * k + i, s, i, int(rng.integers(-3000, 40000)), int(rng.integers(-3000, 30000))) for k, s in enumerate(["s", "no mpp", "small", "unknown", None]) for i in range(40)]
    points += [(900, "s", 0, None, 5), (901, "s", 1, 5, None), (None, "s", 2, 5, 5)]
    spark.createDataFrame(levels, LEVEL).write.parquet(f"{tmp_path}/slide_levels.parquet")
    spark.createDataFrame(points + points[:5], "point_id long, slide_id string, seq int, x long, y long").write.parquet(f"{tmp_path}/points.parquet")
    db = duckdb.connect()
    for name in ("points", "slide_levels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for query, least in ((slides.region_native, 40), (slides.region_tile_mode, 20), (slides.region_wsi_mode, 20)):
        out = query(spark, str(tmp_path))
        # The driver plans no lookup of a slide's levels for each use of the requests.
        plan = planned(out)
        assert "collect_list" not in plan and plan.count("BroadcastExchange") <= 6
        want = db.execute(f"SELECT {', '.join(out.columns)} FROM ({slide_oracles.ORACLES[query.__name__]})").fetchall()
        assert rows(out) == sorted(want, key=repr) and len(want) > least
