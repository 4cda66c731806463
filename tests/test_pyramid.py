import pytest
from pyspark.sql import functions as F

from conftest import rows
from pathloom.functions import scalars
from pathloom.functions.geometry import area, bounds, edges, ellipse_ring, same_polygon
from pathloom.operators import pyramid as P

LEVEL = "slide_id string, slide_level int, width int, height int, downsample double, mpp double, magnification int"
BOARD = [("b", 0, 2560, 3072, 1.0, 0.25, None), ("b", 1, 640, 768, 4.0, 1.0, None), ("b", 2, 160, 192, 16.0, 4.0, None)]
BARE = [("n", 0, 1000, 900, 1.0, None, 20), ("n", 1, 1000, 900, 1.0, None, 20)]


@pytest.fixture(scope="module")
def levels(spark):
    return spark.createDataFrame([*BOARD, BOARD[1], *BARE, (None, 0, 1, 1, 1.0, 1.0, 1), ("x", None, 1, 1, 1.0, 1.0, 1)], LEVEL)


def of(levels, column, slide="b"):
    return P.pyramids(levels).filter(F.col("slide_id") == slide).select(column).first()[0]


def test_pyramids_are_sorted_and_distinct(levels):
    found = P.pyramids(levels)
    assert {r.slide_id: [v.slide_level for v in r.levels] for r in found.collect()} == {"b": [0, 1, 2], "n": [0, 1]}
    assert P.pyramids(levels.limit(0)).count() == 0


def test_level_lookups(levels):
    assert of(levels, P.level_of_shape(F.lit(640), F.lit(768))) == 1 and of(levels, P.level_of_shape(F.lit(640), F.lit(767))) is None
    assert of(levels, P.level_of_shape(F.lit(1000), F.lit(900)), "n") == 1
    assert [of(levels, P.nearest_level(F.lit(n))) for n in (100, 160, 161, 640, 5000)] == [2, 2, 1, 1, 0]
    assert of(levels, P.nearest_level(F.lit(5000), allow_zero=False)) is None
    assert [of(levels, P.level_or_nearest(F.lit(n))) for n in (2, 99, 100)] == [2, 99, 2]
    assert [of(levels, P.level_of_mpp(F.lit(m))) for m in (0.25, 1.0029, 1.003, 3.9975, 0.5)] == [0, 1, -1, 2, -1]
    assert of(levels, P.level_of_mpp(F.lit(0.25)), "n") == -1
    assert [of(levels, P.best_base_level(F.lit(m))) for m in (0.1, 0.25, 0.9999999999999999, 3.0, 4.0, 9.0)] == [0, 0, 1, 1, 2, 2]


def test_factors_and_ranges(levels):
    none_i, none_d = F.lit(None).cast("int"), F.lit(None).cast("double")
    assert of(levels, P.target_factor(F.lit(2), none_d)) == 16.0 and of(levels, P.target_factor(none_i, F.lit(0.5))) == 2.0
    assert tuple(of(levels, P.resample_factors(none_i, F.lit(2.0), level_zero=False))) == (1, 2.0, 8.0)
    assert tuple(of(levels, P.resample_factors(none_i, F.lit(2.0)))) == (0, 8.0, 8.0)
    assert tuple(of(levels, P.resampled_size(F.lit(0.5)))) == (1280, 1536)
    assert [of(levels, P.mpp_in_range(F.lit(m))) for m in (0.0009, 0.001, 10.0, 10.1)] == [False, True, True, False]
    assert rows(P.resampling_batches(levels.sparkSession.createDataFrame([("b", 0.5), ("b", 2.0), ("b", 1.0), ("b", 0.5)], "slide_id string, mpp double"), levels, level_zero=False)) == [("b", 0, [0.5]), ("b", 1, [2.0])]
    for mode, extra in (("wsi", []), ("tile", [0.5]), (None, [0.5]), ("odd", []), ("wsi", [1]), ("wsi", [0.5, 0.5])):
        with pytest.raises(ValueError):
            P.check_resampling(mode, extra)
    P.check_resampling("wsi", [0.5])


@pytest.mark.parametrize("x,y,size,valid,pads", [(0, 0, 256, True, False), (2560, 0, 10, True, True), (2561, 0, 10, False, True), (-255, 5, 256, True, True), (-256, 5, 256, False, True), (-1, 0, 2561, False, True), (2300, 0, 250, True, False), (2300, 0, 251, True, True)])
def test_locations(levels, x, y, size, valid, pads):
    args = [F.lit(v) for v in (x, y, size, size, 1.0)]
    assert of(levels, P.location_valid(*args)) == valid and of(levels, P.needs_padding(*args)) == pads


def test_multires_golden(spark, levels):
    patch = spark.createDataFrame([("b", 512, 768, 256, 512)], "slide_id string, x int, y int, w int, h int")
    out = P.multires_patches(patch, levels, [0, 0.5, 0.75, 1, 4.0, 0.8], 0.25).orderBy("member")
    assert [(r.target_x, r.target_y) for r in out.collect()] == [(512, 768), (384, 512), (256, 256), (128, 0), (-1408, -3072), (230, 205)]


def test_mpp_sources(spark):
    run = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert run(P.centimeter_mpp(lit("centimeter"), lit("20000"))) == 0.5
    assert run(P.centimeter_mpp(lit("inch"), lit("20000"))) is None and run(P.centimeter_mpp(lit("CENTIMETER"), lit("0"))) is None and run(P.centimeter_mpp(lit("CENTIMETER"), lit("x"))) is None
    assert run(P.resolve_mpp([lit(0.22632099999999999), lit(1.0)], [lit(0.22631600000000002), lit(1.0)])) == 0.22632
    assert run(P.resolve_mpp([lit(None).cast("double"), lit(0.5)], [lit(None).cast("double"), lit(0.5)])) == 0.5
    assert run(P.resolve_mpp([lit(0.0)], [lit(0.0)], external=0.3)) == 0.3 and run(P.resolve_mpp([lit(0.0)], [lit(0.0)])) is None
    with pytest.raises(Exception, match="axes differ"):
        run(P.resolve_mpp([lit(0.1)], [lit(0.2)]))
    props = F.create_map(lit("a"), lit("7"))
    assert run(P.property_value(props, "a")) == "7" and run(P.property_value(props, "b", strict=False)) is None and run(P.magnification(props, "a")) == 7
    with pytest.raises(Exception, match="property b"):
        run(P.property_value(props, "b"))


def test_scalars(spark):
    run = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert [run(scalars.slide_key(lit(p))) for p in ("/a/b.c.svs", "x\\y.tif", "plain", ".hid")] == ["b.c", "y", "plain", ".hid"]
    assert scalars.level_and_mpp(0) == (0, None) and scalars.level_and_mpp(0.5) == (None, 0.5)
    for bad in (0.0, "1", None, True):
        with pytest.raises(ValueError):
            scalars.level_and_mpp(bad)
    assert scalars.one_each(3, "n", 2) == [3, 3] and scalars.one_list_each([1, 2], "n", 2) == [[1, 2], [1, 2]] and scalars.one_list_each([[1], [2]], "n", 2) == [[1], [2]]
    for call in (lambda: scalars.one_each([1], "n", 2), lambda: scalars.one_list_each([[1]], "n", 2)):
        with pytest.raises(ValueError):
            call()
    assert scalars.color_rgb("lime") == (0, 255, 0) and scalars.color_rgb("#0102ff") == (1, 2, 255)
    with pytest.raises(KeyError):
        scalars.color_hex("nocolour")
    assert tuple(run(scalars.rgb_of_hex(lit("#ff8000")))) == (255, 128, 0) and run(scalars.alpha_byte(lit(0.5))) == 128
    assert run(scalars.asap_color(lit("#F4FA58"))) == "#f4fa58" and run(scalars.sedeen_color(lit("#00ff00ff"))) == "#00ff00" and run(scalars.sedeen_color(lit("#"))) == ""
    name = scalars.patch_file_name(lit("board"), lit("t8mzd2i2"), lit(256), lit(256), label=lit("XYZ"), comment=lit("testcomment"), separator="__", image_type="tif")
    assert run(name) == "board__t8mzd2i2__testcomment__XYZ__x256__y256.tif"
    assert run(scalars.patch_path("out", lit("f.png"), label=lit("a"), set_dir=lit("set1"))) == "out/a/set1/f.png"
    with pytest.raises(Exception, match="label"):
        run(scalars.patch_path("out", lit("f.png"), label=lit("")))
    assert len(scalars.random_id()) == 8 and run(scalars.whole(lit(2.5))) == 2


def test_rings(spark):
    square = [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 2.0}, {"x": 0.0, "y": 2.0}]
    df = spark.createDataFrame([(square,)], "r array<struct<x:double,y:double>>")
    assert df.select(area(edges(F.col("r")))).first()[0] == 8.0 and tuple(df.select(bounds(F.col("r"))).first()[0]) == (0.0, 0.0, 4.0, 2.0)
    e = df.select(ellipse_ring(F.transform("r", lambda p: F.struct((p["x"] * 100).alias("x"), (p["y"] * 100).alias("y"))))).first()[0]
    assert len(e) == 65 and e[0] == e[-1] == (400.0, 100.0) and e[32] == (0.0, 100.0) and e[16] == (200.0, 0.0)
    poly = lambda h: F.struct(F.col("r").alias("points"), F.lit("a").alias("label"), h.cast("array<array<struct<x:double,y:double>>>").alias("holes"))
    assert df.select(same_polygon(poly(F.array()), poly(F.lit(None)))).first()[0]
