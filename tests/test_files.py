import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from pathloom.functions import codecs, resize
from pathloom.operators import extract, pixels
from pathloom.sources import annotations, masks, slides

RNG = np.random.default_rng(1)
IMAGE = RNG.integers(0, 256, (300, 400, 3), dtype=np.uint8)
LEVELS = [IMAGE, resize.resize(IMAGE, 100, 75, "BOX")]
REQUEST = "slide_id string, region_id long, x int, y int, slide_level int, mpp double, w int, h int, level int"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("wsi")
    (at / "a.b.tif").write_bytes(codecs.tiff_bytes(LEVELS, resolution=(40000.0, 40000.0)))
    return str(at)


def test_codecs_round_trip():
    bits = RNG.random((33, 45)) > 0.5
    assert (codecs.read_png(codecs.png_bytes(IMAGE)) == IMAGE).all() and (codecs.read_png(codecs.png_bytes(bits)) == bits).all()
    for packed in (True, False):
        data = codecs.tiff_bytes(LEVELS, compress=packed)
        pages = codecs.tiff_directories(data)
        assert all((codecs.read_tiff_page(data, p) == v).all() for p, v in zip(pages, LEVELS))
        assert (codecs.read_tiff_page(data, pages[0], (250, 10, 300, 290)) == IMAGE[10:290, 250:300]).all()
        assert (codecs.read_array(codecs.array_bytes(bits, packed=packed)) == bits).all()
    for bad in (b"", b"nothing at all"):
        for read in (codecs.read_png, codecs.tiff_directories):
            with pytest.raises(ValueError):
                read(bad)


def test_slides_levels_and_source(spark, folder):
    s = slides.read_slides(spark, folder)
    assert [(r.slide_id, r.name, r.mpp) for r in s.collect()] == [("a.b", "a.b.tif", 0.25)]
    assert [(r.slide_level, r.width, r.downsample, r.mpp) for r in slides.slide_levels(s).orderBy("slide_level").collect()] == [(0, 400, 1.0, 0.25), (1, 100, 4.0, 1.0)]
    spark.dataSource.register(slides.LevelsSource)
    assert rows(spark.read.format("pathloom_levels").load(folder).select("slide_id", "slide_level", "width", "height")) == [("a.b", 0, 400, 300), ("a.b", 1, 100, 75)]
    for backend in ("openslide", "other"):
        with pytest.raises(ValueError):
            slides.read_slides(spark, folder, backend=backend)


@pytest.mark.parametrize("mode", ["tile", "wsi"])
def test_regions(spark, folder, mode):
    levels, tiles = slides.slide_levels(slides.read_slides(spark, folder)), slides.tiles(spark, folder)
    data = [("a.b", 1, 10, 20, 0, None, 50, 60, 0), ("a.b", 2, -5, 250, 0, None, 64, 64, 0), ("a.b", 3, 40, 40, 1, None, 20, 20, 0), ("a.b", 4, 40, 40, None, 0.5, 30, 30, 0), ("a.b", 5, 390, 290, 0, None, 20, 20, 0), ("a.b", 6, 0, 0, None, 0.2505, 64, 64, 0)]
    requests = spark.createDataFrame(data, REQUEST)
    images = pixels.read_regions(requests, tiles, levels, mode=mode)
    out = {r.region_id: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) for r in images.collect()}
    assert (out[1] == IMAGE[20:80, 10:60]).all() and (out[3] == LEVELS[1][10:30, 10:30]).all() and (out[6] == IMAGE[:64, :64]).all()
    assert (out[2][:50, 5:] == IMAGE[250:, :59]).all() and (out[2][50:] == 255).all() and (out[2][:, :5] == 255).all()
    assert (out[4] == resize.resize(IMAGE[40:100, 40:100], 30, 30)).all()
    assert (out[5][:10, :10] == IMAGE[290:, 390:]).all() and (out[5][10:] == 255).all()
    plain = pixels.read_regions(requests.filter("region_id = 2"), tiles, levels, skip_padding=True).first()
    assert not np.frombuffer(plain.data, np.uint8).reshape(64, 64, 3)[50:].any()
    for bad in (("a.b", 9, 401, 0, 0, None, 5, 5, 0), ("a.b", 9, -5, 0, 0, None, 5, 5, 0), ("a.b", 9, 0, 0, 7, None, 5, 5, 0), ("a.b", 9, 0, 0, None, 99.0, 5, 5, 0)):
        with pytest.raises(Exception, match="can't be read"):
            pixels.read_regions(spark.createDataFrame([bad], REQUEST), tiles, levels, mode=mode).collect()
    with pytest.raises(Exception, match="can't be read"):
        pixels.read_regions(requests.filter("region_id = 4"), tiles, levels).collect()
    tensor = pixels.tensors(images.filter("region_id = 1")).first()
    assert tensor["shape"] == [3, 60, 50] and tensor.tensor[:2] == pytest.approx([IMAGE[20, 10, 0] / 255, IMAGE[20, 11, 0] / 255])
    struct = pixels.image_struct(images.filter("region_id = 1")).first().image
    assert struct.nChannels == 3 and struct.data[:3] == bytes(IMAGE[20, 10, ::-1])


def test_images_through_the_image_source(spark, tmp_path):
    (tmp_path / "flat.png").write_bytes(codecs.png_bytes(IMAGE))
    t = pixels.from_image_source(spark.read.format("image").load(str(tmp_path))).first()
    assert t.slide_id == "flat" and (np.frombuffer(t.data, np.uint8).reshape(300, 400, 3) == IMAGE).all()


def test_masks(spark, tmp_path):
    mask = RNG.random((20, 30)) > 0.6
    (tmp_path / "n.npy").write_bytes(codecs.array_bytes(mask, packed=False))
    (tmp_path / "z.npz").write_bytes(codecs.array_bytes(mask))
    (tmp_path / "p.png").write_bytes(codecs.png_bytes(mask.T))
    (tmp_path / "empty.npy").write_bytes(codecs.array_bytes(np.zeros((4, 5), bool), packed=False))
    cells = masks.read_masks(spark, str(tmp_path))
    for key in ("n", "z", "p"):
        assert {(r.x, r.y) for r in cells.filter(F.col("slide_id") == key).collect()} == set(zip(*np.nonzero(mask)))
    assert rows(cells.filter("slide_id = 'empty'")) == [("empty", 4, 5, None, None)]
    files = masks.mask_files(cells, cells).filter("slide_id = 'n'").first()
    assert (codecs.read_array(files.npz) == mask).all() and (codecs.read_png(files.png) == mask.T).all()
    with pytest.raises(TypeError):
        masks.mask_array(b"text")
    with pytest.raises(ValueError):
        masks.mask_array(codecs.array_bytes(np.zeros((2, 2, 2))))


ASAP = """<?xml version="1.0"?>
<ASAP_Annotations><Annotations>
<Annotation Name="d" Type="Dot" PartOfGroup="g" Color="#AA00FF"><Coordinates><Coordinate Order="0" X="1,6" Y="2.5"/></Coordinates></Annotation>
<Annotation Name="r" Type="Rectangle" PartOfGroup="g" Color="#AA00FF"><Coordinates><Coordinate Order="0" X="1,6" Y="2.5"/><Coordinate Order="1" X="3" Y="3.5"/><Coordinate Order="2" X="5" Y="5"/><Coordinate Order="3" X="6" Y="1"/></Coordinates></Annotation>
<Annotation Type="Spline" PartOfGroup="g" Color="#AA00FF"><Coordinates><Coordinate Order="0" X="1" Y="2"/></Coordinates></Annotation>
</Annotations><AnnotationGroups /></ASAP_Annotations>"""
SEDEEN = """﻿<?xml version="1.0"?>
<session software="s"><image identifier="i"><overlays>
<graphic type="ellipse" name="e" description="f"><pen color="#00ff00ff" width="3"/><point-list><point>0.0,0.0</point><point>400.2,0</point><point>400,200</point><point>0,200</point></point-list></graphic>
<graphic type="text" name="t" description=""><pen color="#00ff00ff"/><point-list><point>1,1</point></point-list></graphic>
</overlays></image></session>"""


def test_annotation_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ASAP)
    (tmp_path / "s.xml").write_text(SEDEEN)
    asap = annotations.asap_annotations(annotations.read_texts(spark, str(tmp_path / "a.xml")))
    assert [(r.ann_type, r.ann_name, len(r.points)) for r in asap.orderBy("ann_no").collect()] == [("Dot", "d", 1), ("Rectangle", "r", 4), ("Spline", None, 1)]
    with pytest.raises(Exception, match="Spline needs 3 points or more"):
        annotations.polygons_of(asap, F.col("ann_name")).collect()
    kept = annotations.polygons_of(asap, F.concat_ws("/", "ann_name", "color"), strict=False).first()
    assert kept.label == "r/#aa00ff" and kept.points[:2] == [(2.0, 2.0), (3.0, 4.0)]
    sedeen = annotations.polygons_of(annotations.sedeen_annotations(annotations.read_texts(spark, str(tmp_path / "s.xml"))), F.concat_ws("/", "ann_name", "group_text", "color")).collect()
    assert len(sedeen) == 1 and sedeen[0].label == "e/f/#00ff00" and len(sedeen[0].points) == 65
    with pytest.raises(ValueError):
        annotations.mapped(asap, F.lit("x"), extra={"ann_name": F.lit(1)})
    assert "name" in annotations.mapped(asap, F.lit("x"), names={"ann_name": "name"}, values={"color": F.lit("z")}, extra={"more": F.lit(1)}).columns


def test_json_polygons(spark, tmp_path):
    good = '[{"points": [[1, 2], [3, 4], [5, 6]], "label": "a", "holes": [[[1, 1], [2, 2], [3, 3]]]}, {"points": [[7, 8]], "label": null, "holes": null}]'
    texts = spark.createDataFrame([("g", good), ("e", "[]"), ("b", "{not json"), ("k", '[{"pts": 1}]')], "path string, text string")
    found = annotations.json_polygons(texts, strict=False)
    assert rows(found.select("path", "polygon_idx", "label", F.size("holes"))) == [("g", 0, "a", 1), ("g", 1, None, 0)]
    with pytest.raises(Exception, match="no list of polygons"):
        annotations.json_polygons(texts).collect()
    again = annotations.json_polygons(annotations.polygons_json(found).select("path", "text"), strict=False)
    assert rows(again) == rows(found)
    written = annotations.write_polygons_json(found, str(tmp_path / "out")).collect()
    assert [(r.path, r.n_bytes) for r in written] == [(str(tmp_path / "out" / "g.json"), (tmp_path / "out" / "g.json").stat().st_size)]
    project = '[{"image": "i", "annotations": [{"type": "Polygon", "name": "n", "points": [[1, 2]]}, {"type": "LineString", "name": "l", "points": [[1, 2]]}]}]'
    assert rows(annotations.project_polygons(spark.createDataFrame([("p", project)], "path string, text string")).select("image", "label")) == [("i", "n")]


def test_extraction(spark, tmp_path, folder):
    levels, tiles = slides.slide_levels(slides.read_slides(spark, folder)), slides.tiles(spark, folder)
    requests = spark.createDataFrame([("a.b", i, 32 * i, 0, 0, None, 32, 32, 0) for i in range(4)], REQUEST).withColumn("label", F.concat(F.lit("l"), F.col("region_id") % 2))
    placed = extract.with_paths(requests, str(tmp_path), F.lit("mmmm1111"), by_label=True)
    images = pixels.read_regions(requests, tiles, levels).join(placed.select("region_id", "path"), "region_id")
    extract.save_images(images).write.parquet(str(tmp_path / "log"))
    assert extract.saved_count(spark, str(tmp_path), "mmmm1111") == 4
    extract.check_saved(spark, str(tmp_path), "mmmm1111", 4)
    with pytest.raises(OSError):
        extract.check_saved(spark, str(tmp_path), "mmmm1111", 5)
    assert (codecs.read_png((tmp_path / "l1" / "a.b_mmmm1111_l1_x32_y0.png").read_bytes()) == IMAGE[:32, 32:64]).all()
    header = extract.manifest_header("mmmm1111", "p", patch_class="grid", patch_params={"b": 1, "a": 2, "self": 3}, counts={"l1": 2, "l0": 2}, extractor="disk", extractor_params={})
    place = extract.write_manifest(spark, str(tmp_path), "mmmm1111", "a.b", header, placed)
    lines = [r.value for r in spark.read.text(place).collect()]
    assert "Patch count:            4" in lines and " " * 24 + "a: 2" in lines and sum(".png" in v for v in lines) == 4 and not any("self" in v for v in lines)
    with pytest.raises(Exception):
        extract.write_manifest(spark, str(tmp_path), "mmmm1111", "a.b", header, placed)
    with pytest.raises(OSError):
        extract.write_manifest(spark, str(tmp_path / "none"), "m", "s", header, placed)
    with pytest.raises(ValueError):
        extract.save_images(images, image_type="gif")
    run = lambda c: spark.range(1).select(c).first()[0]
    assert run(extract.set_folder(F.lit(3))) == "set3" and run(extract.set_folder(F.lit(3), F.lit("s"))) == "s__set3"
    assert run(extract.member_comment(F.lit(None).cast("int"), F.lit(0.5), "c")) == "c_mpp0.5" and run(extract.member_comment(F.lit(1), F.lit(None).cast("double"))) == "level1"
