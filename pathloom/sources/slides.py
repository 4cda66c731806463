"""Slides from files: pyramid metadata and pixel tiles.

``read_slides`` opens image files of a backend and gives one row a slide with
its levels; ``tiles`` cuts every level into raw RGB tiles. A TIFF is read in
ranges: its directories for the one, the blocks under a row of tiles for the
other, so a slide of any size is spread over many tasks and never held whole.
Formats that no decoder here reads come as a metadata table with the same
columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pathloom.functions import codecs
from pathloom.functions.scalars import slide_key, slide_name
from pathloom.operators.pyramid import centimeter_mpp, magnification, resolve_mpp
from pathloom.sources.files import Ranged, split_uri

TILE = 256
_OPENED = "slide_id string, path string, lib string, props map<string,string>, sizes array<struct<width:int,height:int>>"
TILES = "slide_id string, slide_level int, tx int, ty int, x0 int, y0 int, width int, height int, data binary"


def _open(path: str, lib: str) -> tuple[dict[str, str], list[tuple[int, int]]]:
    with Ranged(path) as data:
        if lib == "tiff":
            pages = codecs.tiff_directories(data)
            return codecs.page_properties(pages[0]), [codecs.page_size(p) for p in pages]
        h, w = codecs.read_png(data[:]).shape[:2]
        return {}, [(w, h)]


def _rows_of(path: str, lib: str, level: int, y1: int, y2: int, width: int) -> np.ndarray:
    """The lines y1 to y2 of a level, [y, x, channels]."""
    with Ranged(path) as data:
        if lib == "tiff":
            return codecs.read_tiff_page(data, codecs.tiff_directories(data)[level], (0, y1, width, y2))
        image = codecs.read_png(data[:])
    image = image[:, :, None] * np.uint8(255) if image.ndim == 2 else image
    return image[y1:y2].astype(np.uint8)


#: Configured backend -> decoder; "table" stands for slides known by metadata alone.
BACKENDS = {"tiffslide": "tiff", "tiffopenslide": "tiff", "pillow": "png", "openslide": "table"}


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(slide_id, path) of the files under a path: listed, not read."""
    return spark.read.format("binaryFile").load(path).select(slide_key(F.col("path")).alias("slide_id"), "path")


def mpp_of_properties(props: Column) -> tuple[Column, Column]:
    """mpp of both axes as the properties state it."""
    return tuple(F.try_element_at(props, F.lit(f"openslide.mpp-{a}")).try_cast("double") for a in "xy")


def mpp_of_resolution(props: Column) -> tuple[Column, Column]:
    """mpp of both axes from a TIFF's pixels a centimetre."""
    p = lambda n: F.try_element_at(props, F.lit(n))
    return tuple(centimeter_mpp(p("tiff.ResolutionUnit"), p(f"tiff.{a}Resolution")) for a in "XY")


#: Where mpp comes from, in this order; the external value comes last.
MPP_SOURCES = (mpp_of_properties, mpp_of_resolution)


def read_slides(spark: SparkSession, path: str, *, backend: str = "tiffslide", external_mpp: float | None = None, mpp_sources: Sequence[Callable[[Column], tuple[Column, Column]]] = MPP_SOURCES) -> DataFrame:
    """(slide_id, path, name, lib, props, magnification, mpp, sizes) of the
    files under ``path``. mpp: from the first of ``mpp_sources`` that has both
    axes, else external. A backend without decoder is an error."""
    lib = BACKENDS.get(backend)
    if lib is None or lib == "table":
        raise ValueError(f"backend {backend} has no decoder here: give its slides as a table")
    files = _listed(spark, path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            opened = [_open(c, lib) for c in frame.path]
            yield pd.DataFrame({"slide_id": frame.slide_id, "path": frame.path, "lib": lib, "props": [o[0] for o in opened], "sizes": [[{"width": w, "height": h} for w, h in o[1]] for o in opened]})

    found = [source(F.col("props")) for source in mpp_sources]
    return files.mapInPandas(run, _OPENED).select("slide_id", "path", slide_name(F.col("path")).alias("name"), "lib", "props", magnification(F.col("props")).alias("magnification"), resolve_mpp([x for x, _ in found], [y for _, y in found], external_mpp).alias("mpp"), "sizes")


def slide_levels(slides: DataFrame) -> DataFrame:
    """A row a level, as the slide_levels table: downsample is the mean of the
    axes' ratios to level 0, mpp the slide's mpp times it."""
    rows = slides.select("slide_id", F.col("path").alias("wsi_file"), "mpp", "magnification", F.col("sizes")[0].alias("z"), F.posexplode("sizes").alias("slide_level", "s"))
    downsample = (F.col("z.width") / F.col("s.width") + F.col("z.height") / F.col("s.height")) / 2
    return rows.select("slide_id", "wsi_file", "slide_level", F.col("s.width").alias("width"), F.col("s.height").alias("height"), downsample.alias("downsample"), (F.col("mpp") * downsample).alias("mpp"), "magnification")


def tiles(spark: SparkSession, path: str, *, backend: str = "tiffslide", tile: int = TILE) -> DataFrame:
    """RGB tiles (slide_id, slide_level, tx, ty, x0, y0, width, height, data) of
    every level of the files, decoded tile by tile."""
    lib = BACKENDS[backend]

    def sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"slide_id": frame.slide_id, "path": frame.path, "sizes": [[{"width": w, "height": h} for w, h in _open(p, lib)[1]] for p in frame.path]})

    # A task a few rows of tiles; a flat image is decoded whole, so it is one request.
    high = F.lit(tile) if lib == "tiff" else F.greatest(F.col("s.height"), F.lit(1))
    levels = _listed(spark, path).mapInPandas(sizes, "slide_id string, path string, sizes array<struct<width:int,height:int>>").select("slide_id", "path", F.posexplode("sizes").alias("slide_level", "s"))
    wanted = levels.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("s.height") - 1, high))).select("slide_id", "path", "slide_level", "y", F.least(F.col("y") + high, F.col("s.height")).alias("y2"), F.col("s.width").alias("w"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                yield from cut_tiles(r.slide_id, r.slide_level, _rows_of(r.path, lib, r.slide_level, r.y, r.y2, r.w)[:, :, :3], tile, r.y)

    return wanted.repartition(n, "path", "slide_level", "y").mapInPandas(run, TILES)


def cut_tiles(slide_id: str, level: int, image: np.ndarray, tile: int = TILE, top: int = 0) -> Iterator[pd.DataFrame]:
    """A frame for each row of tiles of an image [y, x, 3], whose first line is
    the level's line ``top``, a multiple of ``tile``."""
    h, w = image.shape[:2]
    for y in range(0, h, tile):
        rows = []
        for x in range(0, w, tile):
            part = image[y : y + tile, x : x + tile]
            rows.append((slide_id, level, x // tile, (top + y) // tile, x, top + y, part.shape[1], part.shape[0], np.ascontiguousarray(part).tobytes()))
        yield pd.DataFrame(rows, columns=[f.split()[0] for f in TILES.split(", ")])


class LevelsSource(DataSource):
    """``spark.read.format("pathloom_levels").load(folder)``: the levels of TIFF
    slides on a folder every executor reaches, one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "pathloom_levels"

    def schema(self) -> str:
        return "slide_id string, wsi_file string, slide_level int, width int, height int"

    def reader(self, schema) -> DataSourceReader:
        return _LevelsReader(self.options["path"])


class _LevelsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        system, place = split_uri(self.path)
        found = sorted(f.path for f in system.get_file_info(pafs.FileSelector(place)) if f.is_file)
        scheme = self.path[: len(self.path) - len(place)] if self.path.endswith(place) else ""
        return [InputPartition(scheme + f) for f in found if f.lower().endswith((".tif", ".tiff"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with Ranged(partition.value) as data:
            pages = codecs.tiff_directories(data)
        name = partition.value.rpartition("/")[2]
        for level, page in enumerate(pages):
            yield (name.rpartition(".")[0] or name, partition.value.removeprefix("file:"), level, *codecs.page_size(page))
