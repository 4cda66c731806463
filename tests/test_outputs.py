import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import codecs
from pathloom.operators import extract, heatmap, outputs

PROBS = "slide_id string, class int, x int, y int, prob double"
SIZES = "slide_id string, width int, height int"
LEVELS = "slide_id string, slide_level int, width int, height int, downsample double, mpp double, magnification int"


@pytest.fixture(scope="module")
def table(spark):
    data = [("s", c, x, y, (x + y + c) / 10) for c in (0, 1) for x in range(4) for y in range(3) if (x, y) != (1, 1)] + [("s", 0, 99, 0, 0.5), (None, 0, 0, 0, 0.5), ("unknown", 0, 0, 0, 0.5)]
    return spark.createDataFrame(data, PROBS), spark.createDataFrame([("s", 6, 5), ("s", 6, 5), ("empty", 2, 2), ("none", None, 1)], SIZES)


def test_class_arrays(table):
    probs, sizes = table
    got = {r.slide_id: codecs.read_array(bytes(r.npz)) for r in outputs.class_arrays(probs, sizes, classes=2).collect()}
    assert set(got) == {"s", "empty"} and got["s"].shape == (2, 6, 5)
    assert got["s"][1, 3, 2] == 0.6 and np.isnan(got["s"][0, 1, 1]) and np.isnan(got["empty"]).all()
    one = outputs.class_arrays(probs, sizes, classes=2, only=1).filter("slide_id = 's'").first()
    assert np.array_equal(codecs.read_array(bytes(one.npz)), got["s"][1], equal_nan=True)


def test_class_images_with_resolution(spark, table):
    probs, sizes = table
    levels = spark.createDataFrame([("s", 0, 60, 50, 1.0, 0.5, 40)], LEVELS)
    sized = outputs.resolution(levels, sizes)
    got = {r.slide_id: r for r in outputs.class_images(probs, sized, of_class=1).collect()}
    gray = codecs.read_png(bytes(got["s"].png))[:, :, 0]
    assert gray.shape == (5, 6) and gray[2, 3] == int(0.6 * 255) and gray[1, 1] == 0
    pages = codecs.tiff_directories(bytes(got["s"].tif))
    assert float(codecs.page_properties(pages[0])["tiff.XResolution"]) == 10000 / (0.5 * 10)
    assert (codecs.read_tiff_page(bytes(got["s"].tif), pages[0]) == gray[:, :, None]).all()
    assert "tiff.XResolution" not in codecs.page_properties(codecs.tiff_directories(bytes(got["empty"].tif))[0])
    with pytest.raises(Exception, match="outside"):
        outputs.class_images(probs.withColumn("prob", F.col("prob") + 1), sized, of_class=1).collect()


def test_heatmap_images(table, tmp_path):
    probs, sizes = table
    colors = heatmap.colored(probs.filter("class = 0"), cmap="gray", vmin=0.0, vmax=1.0, alpha=1.0, background="white")
    one = outputs.heatmap_images(colors, sizes, cmap="gray", background="white").filter("slide_id = 's'").first()
    image = codecs.read_png(bytes(one.png))
    assert image.shape == (5, 6, 4) and tuple(image[4, 5]) == (255, 255, 255, 255) and image[2, 3, 0] == image[2, 3, 2] < 200
    flat = codecs.read_tiff_page(bytes(one.tif), codecs.tiff_directories(bytes(one.tif))[0])
    assert flat.shape == (5, 6, 3) and (flat == image[:, :, :3]).all()
    bar = codecs.read_png(bytes(one.bar_png))
    assert bar.shape == (5, 24, 4) and bar[0, -1, 0] == 255 and bar[-1, -1, 0] == 0
    half = heatmap.colored(probs.filter("class = 0"), cmap="gray", vmin=0.0, vmax=1.0, alpha=0.5)

    def draw(image):
        image[0, 0] = (1, 2, 3, 4)

    drawn = outputs.heatmap_images(half, sizes, cmap="gray", alpha=0.5, draw=draw).filter("slide_id = 's'").first()
    image = codecs.read_png(bytes(drawn.png))
    assert tuple(image[0, 0]) == (1, 2, 3, 4) and image[2, 3, 3] == 128 and tuple(image[4, 5]) == (0, 0, 0, 0)
    assert codecs.read_tiff_page(bytes(drawn.tif), codecs.tiff_directories(bytes(drawn.tif))[0]).shape[2] == 4
    files = outputs.file_paths(outputs.heatmap_images(colors, sizes), str(tmp_path / "maps"), "__heatmap.png")
    saved = {r.path: r.n_bytes for r in extract.save_bytes(files, "png").collect()}
    assert len(saved) == 2 and all(len(open(p, "rb").read()) == n for p, n in saved.items())


def test_overlay_images(spark, table):
    pixels = spark.createDataFrame([("s", 1, 2, 10, 20, 30), ("s", 9, 9, 1, 1, 1)], "slide_id string, x int, y int, r int, g int, b int")
    one = outputs.pixel_images(pixels, table[1]).filter("slide_id = 's'").first()
    image = codecs.read_png(bytes(one.png))
    assert tuple(image[2, 1]) == (10, 20, 30) and image.sum() == 60


def test_color_tables_have_the_maps_ends():
    assert tuple(outputs.color_table("gray")[[0, -1], 0]) == (0, 255)
    assert outputs.color_table("jet").shape == (256, 3)
