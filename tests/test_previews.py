import logging

import numpy as np
import pytest

from conftest import rows
from pathloom import runtime
from pathloom.functions import codecs
from pathloom.functions.scalars import no_reserved
from pathloom.operators import heatmap, outputs, previews, regions

FACTORS = "slide_id string, patch_scale double, region_scale double"
POLYGON = "slide_id string, polygon_id long, label string, points array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>"


@pytest.fixture(scope="module")
def drawn(spark):
    factors = spark.createDataFrame([("s", 0.1, 1.0)], FACTORS)
    patches = spark.createDataFrame([("s", 100, 50, 100, 100, "a"), ("s", 300, 50, 100, 100, "b"), ("t", 0, 0, 9, 9, "a")], "slide_id string, x int, y int, w int, h int, label string")
    shape = spark.createDataFrame([("s", 1, "a", [(5.0, 20.0), (15.0, 20.0), (15.0, 30.0)], [[(10.0, 21.0), (12.0, 21.0), (12.0, 23.0)]])], POLYGON)
    return factors, patches, regions.polygon_regions(shape)


def test_segments_and_label_filters(drawn):
    factors, patches, areas = drawn
    count = lambda **k: {r.kind: r["count"] for r in previews.segments(factors, patches=patches, regions=areas, buffered=areas, **k).groupBy("kind").count().collect()}
    assert count() == {"patch": 8, "bbox": 4, "polygon": 3, "hole": 3, "buffer": 3}
    assert count(drawn_patches_labels=["b"]) == {"patch": 4, "bbox": 4, "polygon": 3, "hole": 3, "buffer": 3}
    assert count(drawn_labels=["b"], drawn_patches_labels=["a"]) == {"patch": 4}
    one = previews.segments(factors, patches=patches, drawn_patches_labels=["a"])
    assert (10.0, 5.0, 10.0, 15.0) in [r[3:] for r in rows(one)]
    assert previews.segments(factors, patches=patches, markers=True).filter("slide_id = 's'").count() == 8
    assert previews.segments(factors).count() == 0


def test_preview_images(spark, drawn):
    factors, patches, areas = drawn
    white = bytes([255]) * (60 * 40 * 3)
    images = spark.createDataFrame([("s", 60, 40, white), ("u", 60, 40, white)], "slide_id string, width int, height int, data binary")
    got = {r.slide_id: codecs.read_png(bytes(r.png)) for r in previews.preview_images(images, previews.segments(factors, patches=patches, regions=areas), thickness=1).collect()}
    assert tuple(got["s"][5, 12]) == (255, 0, 0) and tuple(got["s"][20, 8]) == (0, 0, 255) and tuple(got["s"][21, 11]) == (0, 128, 128)
    assert (got["u"] == 255).all()
    image = np.zeros((5, 5, 3), np.uint8)
    previews.draw_line(image, -9, 2, 99, 2, (1, 2, 3), 2)
    assert (image[1:3, :, 0] == 1).all() and image[[0, 3, 4]].sum() == 0


def test_own_color_maps():
    heatmap.add_map("ours", [(0.0, 0.0), (1.0, 1.0)], [(0.0, 1.0), (0.5, 0.0), (1.0, 0.0)], [(0.0, 0.0), (1.0, 0.0)])
    assert outputs.color_table("ours")[0].tolist() == [0, 255, 0]
    with pytest.raises(ValueError):
        heatmap.add_map("bad", [(0.2, 0.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 0.0)], [(0.0, 0.0), (1.0, 0.0)])


def test_reserved_parameters_and_log(tmp_path):
    no_reserved({"patch_size": 1})
    with pytest.raises(ValueError, match="mask_data"):
        no_reserved({"mask_data": 1})
    place = str(tmp_path / "log.txt")
    runtime.log_to(place)
    runtime.log("done", "s1")
    runtime.log("all")
    logging.getLogger("pathloom").handlers[0].flush()
    assert open(place).read() == "s1: done\nall\n"
    runtime.log_to(None)
    runtime.log("nowhere")
    assert open(place).read() == "s1: done\nall\n"
