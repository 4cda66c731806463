"""Results as files: class arrays, class images, heatmaps and their colour bars.

Each result is one raster of a slide, so a slide is a group: bounded by its
raster's size, never by how many patches it had. The bytes come out as columns;
``extract.save_bytes`` writes them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions import codecs
from pathloom.functions.scalars import color_rgb
from pathloom.operators import pyramid
from pathloom.operators.heatmap import MAPS
from pathloom.operators.inference import byte_probability, covered_squares

#: Bytes of images that a result batch holds, about.
_OUT_BYTES = 8 * 1024 * 1024


def _per_slide(cells: DataFrame, sizes: DataFrame, make: Callable[[pa.Table, dict], list[bytes | None]], names: list[str]) -> DataFrame:
    """(slide_id, names BINARY): ``make`` of a slide's cells and its row of ``sizes``."""
    schema = T.StructType([sizes.schema["slide_id"], *[T.StructField(n, T.BinaryType()) for n in names]])

    def run(key: tuple[pa.Scalar, ...], held: pa.Table, size: pa.Table) -> pa.Table:
        out = pa.schema([("slide_id", size.schema.field("slide_id").type), *[(n, pa.binary()) for n in names]])
        if not size.num_rows:
            return out.empty_table()
        made = make(held, size.slice(0, 1).to_pylist()[0])
        return pa.table([pa.array([key[0].as_py()], out.field(0).type), *[pa.array([m], pa.binary()) for m in made]], schema=out)

    once = sizes.filter(F.col("slide_id").isNotNull() & F.col("width").isNotNull() & F.col("height").isNotNull()).dropDuplicates(["slide_id"])
    return cells.filter(F.col("slide_id").isNotNull()).groupBy("slide_id").cogroup(once.groupBy("slide_id")).applyInArrow(run, schema)


def _within(held: pa.Table, size: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y = held["x"].to_numpy(), held["y"].to_numpy()
    return x, y, (x >= 0) & (x < size["width"]) & (y >= 0) & (y < size["height"])


def class_arrays(probabilities: DataFrame, sizes: DataFrame, *, classes: int, only: int | None = None) -> DataFrame:
    """(slide_id, npz): the packed array [class, x, y], or [x, y] of the class
    ``only``; NaN where no output lies. probabilities: slide_id, class, x, y,
    prob; sizes: slide_id, width, height of the raster. Cells beyond it are left
    out; a slide without any has NaN alone."""
    def make(held: pa.Table, size: dict) -> list[bytes]:
        out = np.full((classes, size["width"], size["height"]), np.nan)
        x, y, there = _within(held, size)
        out[held["class"].to_numpy()[there], x[there], y[there]] = held["prob"].to_numpy(zero_copy_only=False)[there]
        return [codecs.array_bytes(out if only is None else out[only])]

    return _per_slide(probabilities.select("slide_id", "class", "x", "y", "prob"), sizes, make, ["npz"])


def resolution(levels: DataFrame, sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``pixels_cm`` of a raster that covers the whole slide; null without mpp."""
    p = pyramid.pyramids(levels).select("slide_id", pyramid.of_level(F.lit(0), "width").alias("_w0"), pyramid.of_level(F.lit(0), "mpp").alias("_mpp"))
    return sizes.join(p, "slide_id", "left").withColumn("pixels_cm", pyramid.tiff_resolution(F.col("_mpp"), F.col("_w0") / F.col("width"))).drop("_w0", "_mpp")


def class_images(probabilities: DataFrame, sizes: DataFrame, *, of_class: int) -> DataFrame:
    """(slide_id, png, tif) of one class as gray from 0 to 255, turned to [y, x];
    no output is black. The TIFF is RGB, and has the resolution where ``sizes``
    has ``pixels_cm``. A probability outside [0, 1] is an error."""
    cells = probabilities.filter(F.col("class") == of_class).select("slide_id", "x", "y", byte_probability(F.col("prob")).alias("v"))

    def make(held: pa.Table, size: dict) -> list[bytes]:
        gray = np.zeros((size["height"], size["width"]), np.uint8)
        x, y, there = _within(held, size)
        gray[y[there], x[there]] = held["v"].to_numpy()[there]
        per_cm = size.get("pixels_cm")
        rgb = np.repeat(gray[:, :, None], 3, axis=2)
        return [codecs.png_bytes(gray), codecs.tiff_bytes([rgb], resolution=(per_cm, per_cm) if per_cm else None)]

    return _per_slide(cells, sizes, make, ["png", "tif"])


def stitched_class_images(values: DataFrame, *, classes: int, of_class: int, places: int = 9) -> DataFrame:
    """(slide_id, png) as ``class_images`` has it, of the means that ``stitch``
    makes of ``values`` (one number a class), rounded to ``places``.

    No row a cell is made: a slide's outputs are laid on its raster batch by
    batch, so a task holds one raster, and of the outputs a batch. The raster is
    that of a slide's outputs, which have it alike."""
    o = covered_squares(values, classes=classes).filter(F.col("raster_w").isNotNull() & F.col("raster_h").isNotNull())
    squares = o.select("slide_id", "raster_w", "raster_h", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("x1", "x2", "y1", "y2")], F.coalesce(F.col("output")[of_class].cast("double"), F.lit(0.0)).alias("v"))
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([values.schema["slide_id"], T.StructField("png", T.BinaryType())])

    def drawn(total: np.ndarray, count: np.ndarray) -> bytes:
        gray = np.zeros(total.shape, np.uint8)
        at = np.flatnonzero(count)
        mean = np.nan_to_num(total.ravel()[at] / count.ravel()[at], posinf=np.inf, neginf=-np.inf)
        mean = np.floor(mean * 10.0**places + 0.5) / 10.0**places
        if ((mean < 0) | (mean > 1)).any():
            raise ValueError("probability outside [0, 1]")
        gray.ravel()[at] = np.floor(mean * 255)
        return codecs.png_bytes(gray)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slide, total, count, done, size = None, None, None, [], 0
        for batch in batches:
            ids = batch.column("slide_id").to_pylist()
            squares = zip(ids, *[batch.column(c).to_numpy().tolist() for c in ("raster_w", "raster_h", "x1", "x2", "y1", "y2", "v")])
            for key, w, h, x1, x2, y1, y2, v in squares:
                if key != slide:
                    if slide is not None:
                        done.append({"slide_id": slide, "png": drawn(total, count)})
                        size += len(done[-1]["png"])
                        if size >= _OUT_BYTES:
                            yield pa.RecordBatch.from_pylist(done, out)
                            done, size = [], 0
                    slide, total, count = key, np.zeros((h, w)), np.zeros((h, w), np.int32)
                total[y1:y2, x1:x2] += v
                count[y1:y2, x1:x2] += 1
        if slide is not None:
            yield pa.RecordBatch.from_pylist([*done, {"slide_id": slide, "png": drawn(total, count)}], out)

    out = pa.schema([("slide_id", pa.string()), ("png", pa.binary())])
    return squares.repartition(n, "slide_id").sortWithinPartitions("slide_id").mapInArrow(run, schema)


def color_table(cmap: str, steps: int = 256) -> np.ndarray:
    """The RGB bytes of a colour map's steps."""
    at = np.arange(steps) / (steps - 1)
    return np.column_stack([np.floor(np.interp(at, *zip(*knots)) * 255) for knots in MAPS[cmap]]).astype(np.uint8)


def with_color_bar(image: np.ndarray, cmap: str, *, width: int = 12, gap: int = 6) -> np.ndarray:
    """An RGBA image with the colour map beside it, its largest value at the top."""
    h = image.shape[0]
    colors = color_table(cmap)[np.linspace(255, 0, h).round().astype(int)]
    bar = np.concatenate([colors, np.full((h, 1), 255, np.uint8)], axis=1)
    white = np.full((h, gap, 4), 255, np.uint8)
    return np.concatenate([image, white, np.repeat(bar[:, None], width, axis=1)], axis=1)


def heatmap_images(colors: DataFrame, sizes: DataFrame, *, cmap: str = "jet", alpha: float = 1.0, background: str | None = None, draw: Callable[[np.ndarray], np.ndarray | None] | None = None) -> DataFrame:
    """(slide_id, png, bar_png, tif) of heatmap colours (slide_id, x, y, r, g, b,
    a, as ``heatmap.colored`` gives them).

    Cells without colour have the background, or are clear. ``draw`` is called
    with each RGBA image [y, x, 4] and may change it or give another. bar_png
    has the colour bar beside it. The TIFF has the resolution where ``sizes`` has
    ``pixels_cm``, and no alpha where all is opaque on a background.
    """
    clear = (*color_rgb(background), round(255 * alpha)) if background else (0, 0, 0, 0)
    opaque = alpha == 1 and background is not None

    def make(held: pa.Table, size: dict) -> list[bytes]:
        image = np.empty((size["height"], size["width"], 4), np.uint8)
        image[:] = clear
        x, y, there = _within(held, size)
        image[y[there], x[there]] = np.column_stack([held[c].to_numpy() for c in "rgba"])[there]
        if draw:
            changed = draw(image)
            image = image if changed is None else changed
        per_cm = size.get("pixels_cm")
        tif = codecs.tiff_bytes([image[:, :, :3] if opaque else image], resolution=(per_cm, per_cm) if per_cm else None)
        return [codecs.png_bytes(image), codecs.png_bytes(with_color_bar(image, cmap)), tif]

    return _per_slide(colors.select("slide_id", "x", "y", *"rgba"), sizes, make, ["png", "bar_png", "tif"])


def pixel_images(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(slide_id, png) of pixel rows (slide_id, x, y, r, g, b), such as overlays; missing pixels are black."""
    def make(held: pa.Table, size: dict) -> list[bytes]:
        image = np.zeros((size["height"], size["width"], 3), np.uint8)
        x, y, there = _within(held, size)
        image[y[there], x[there]] = np.column_stack([held[c].to_numpy() for c in "rgb"])[there]
        return [codecs.png_bytes(image)]

    return _per_slide(pixels.select("slide_id", "x", "y", *"rgb"), sizes, make, ["png"])


def file_paths(rows: DataFrame, folder: str, suffix: str, name: Column | None = None) -> DataFrame:
    """``rows`` with ``path``: folder/<slide><suffix>."""
    return rows.withColumn("path", F.concat(F.lit(f"{folder}/"), F.col("slide_id") if name is None else name, F.lit(suffix)))
