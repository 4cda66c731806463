import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import codecs
from pathloom.operators import runs
from pathloom.sources import slides

PATCH = "patch_id long, slide_id string, x int, y int, w int, h int, label string"


@pytest.fixture(scope="module")
def slide(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    base = rng.integers(1, 255, (300, 400, 3), dtype=np.uint8)
    half = base[::2, ::2].copy()
    place = tmp_path_factory.mktemp("slide")
    (place / "s.tif").write_bytes(codecs.tiff_bytes([base, half], resolution=(40_000, 40_000), tile=64))
    levels = slides.slide_levels(slides.read_slides(spark, str(place)))
    return base, half, slides.tiles(spark, str(place), tile=64).cache(), levels.cache()


def test_tiles_in_rows_are_the_levels(slide):
    base, half, tiles, _ = slide
    for level, image in ((0, base), (1, half)):
        back = np.zeros_like(image)
        for r in tiles.filter(F.col("slide_level") == level).collect():
            back[r.y0 : r.y0 + r.height, r.x0 : r.x0 + r.width] = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)
        assert (back == image).all()


def test_whole_levels_and_thumbnails(spark, slide):
    base, half, tiles, levels = slide
    from pathloom.operators.pixels import read_regions

    for request, image in ((runs.whole_requests(levels, level=1), half), (runs.whole_requests(levels, level=0), base)):
        r = read_regions(request, tiles, levels, skip_padding=True, tile=64).first()
        assert (np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) == image).all()
    assert runs.whole_requests(levels, level=7).count() == 0
    wsi = read_regions(runs.whole_requests(levels, mpp=1.0), tiles, levels, mode="wsi", method="BOX", skip_padding=True, tile=64).first()
    assert (wsi.width, wsi.height) == (100, 75)
    small = runs.thumbnails(tiles, levels, 50, tile=64).first()
    assert (small.width, small.height) == (50, 38) and len(small.data) == 50 * 38 * 3
    assert runs.thumbnails(tiles, levels, 9999, tile=64).first().width == 400


def test_extraction_run(spark, slide, tmp_path):
    base, _, tiles, levels = slide
    data = [(i, "s", 32 * i, 16, 32, 32, f"l{i % 2}") for i in range(5)]
    patches = spark.createDataFrame(data, PATCH)
    out = str(tmp_path / "out")
    done = runs.extract(patches, tiles, levels, out, "mmmm1111", by_label=True, comment="qc", patch_class="grid", patch_params={"b": 1, "self": 2}, tile=64)
    assert [(r.slide_id, r.n_files) for r in done.collect()] == [("s", 5)]
    text = open(done.first().manifest).read().splitlines()
    assert text[0].split() == ["Manifest", "ID:", "mmmm1111"] and text[-1].split() == ["Disk", "file", "count:", "5"]
    assert "Patch labels:" in "\n".join(text) and sum(".png" in line for line in text) == 5
    image = codecs.read_png(open(f"{out}/l1/s_mmmm1111_qc_l1_x32_y16.png", "rb").read())
    assert (image == base[16:48, 32:64]).all()
    with pytest.raises(Exception, match="already exists"):
        runs.extract(patches, tiles, levels, out, "mmmm1111", by_label=True, tile=64)
    assert runs.extract(patches.limit(0), tiles, levels, out, "none0000", tile=64).count() == 0


def test_missing_files_are_an_error(spark, tmp_path):
    saved = spark.createDataFrame([("s", str(tmp_path / "gone.png"))], "slide_id string, path string")
    labels = spark.createDataFrame([("s", None, 1)], "slide_id string, label string, n long")
    with pytest.raises(Exception, match="0 patches were saved, not 1"):
        runs.write_manifests(saved, labels, str(tmp_path), "m", {"patch_class": "", "patch_params": {}, "extractor": "", "extractor_params": {}}).collect()


@pytest.mark.parametrize("per_slide", [False, True])
def test_multi_resolution_run_and_sets(spark, slide, tmp_path, per_slide):
    base, half, tiles, levels = slide
    patches = spark.createDataFrame([(i, "s", 64 + 64 * i, 96, 32, 32, None) for i in range(3)], PATCH)
    out = str(tmp_path)
    done = runs.extract_sets(patches, tiles, levels, out, "mmmm2222", [0, 1], 0, per_slide=per_slide, tile=64)
    assert done.first().n_files == 6
    folder = os.path.join(out, "s__set1" if per_slide else "set1")
    assert sorted(os.listdir(folder)) == ["s_mmmm2222_level0_x64_y96.png", "s_mmmm2222_level1_x48_y80.png"]
    image = codecs.read_png(open(f"{folder}/s_mmmm2222_level1_x48_y80.png", "rb").read())
    assert (image == half[40:72, 24:56]).all()
    sets = runs.region_sets(runs.set_members(patches, levels, [0, 1], 0), tiles, levels, tile=64)
    one = sets.filter("set_number = 1").first()
    assert sets.count() == 3 and [i.member for i in one.images] == [0, 1]
    assert bytes(one.images[1].data) == half[40:72, 24:56].tobytes()
    tensors = runs.tensor_sets(sets).filter("set_number = 1").first().tensors
    assert tensors[0]["shape"] == [3, 32, 32] and tensors[0].tensor[0] == pytest.approx(base[96, 64, 0] / 255)
