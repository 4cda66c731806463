"""Preview images: patches, boxes, polygons, holes and buffers drawn on a level.

``segments`` gives the lines as rows, so that they can be filtered and counted;
``preview_images`` draws a slide's lines on its level's image. The image is of
one small level, so a slide is a group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import codecs
from pathloom.functions.geometry import box_ring, edges
from pathloom.functions.scalars import color_rgb

#: What is drawn, in this order, and its colour.
COLORS = {"patch": "red", "bbox": "lime", "polygon": "blue", "hole": "teal", "buffer": "black"}
_LINE = "slide_id string, kind string, label string, x1 double, y1 double, x2 double, y2 double"


def _lines(rows: DataFrame, kind: str, rings: Column, scale: Column) -> DataFrame:
    """The edges of each row's rings, in preview pixels."""
    e = rows.select("slide_id", "label", scale.alias("_f"), F.explode(rings).alias("_r")).select("slide_id", "label", "_f", F.explode(edges(F.col("_r"))).alias("e"))
    return e.select("slide_id", F.lit(kind).alias("kind"), "label", *[(F.col(f"e.{c}") * F.col("_f")).alias(n) for c, n in (("px", "x1"), ("py", "y1"), ("qx", "x2"), ("qy", "y2"))])


def segments(factors: DataFrame, *, patches: DataFrame | None = None, regions: DataFrame | None = None, buffered: DataFrame | None = None, drawn_labels: Sequence[str] = (), drawn_patches_labels: Sequence[str] = (), markers: bool = False) -> DataFrame:
    """(slide_id, kind, label, x1, y1, x2, y2): lines in preview pixels.

    factors: slide_id, ``patch_scale`` (preview pixels of a level-0 pixel) and
    ``region_scale`` (of a mask cell). patches: slide_id, x, y, w, h, label with
    w and h at level 0; with ``markers`` a cross at the corner in place of the
    box. regions give boxes, exteriors and holes; ``buffered`` regions, those
    that a buffer changed, their outlines. ``drawn_labels`` limits all, and wins
    over ``drawn_patches_labels``, which limits patches.
    """
    def limited(df: DataFrame, labels: Sequence[str]) -> DataFrame:
        return df.filter(F.col("label").isin(list(labels))) if labels else df

    spark = factors.sparkSession
    out = spark.createDataFrame([], _LINE)
    if patches is not None:
        p = limited(patches, drawn_labels or drawn_patches_labels).join(factors, "slide_id")
        x, y = F.col("x"), F.col("y")
        if markers:
            dx, dy = F.col("w") / 8, F.col("h") / 8
            line = lambda a, b, c, d: F.array(F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")), F.struct(c.cast("double").alias("x"), d.cast("double").alias("y")))
            rings = F.array(line(x - dx, y, x + dx, y), line(x, y - dy, x, y + dy))
        else:
            rings = F.array(box_ring(x, y, x + F.col("w"), y + F.col("h")))
        out = out.unionByName(_lines(p, "patch", rings, F.col("patch_scale")))
    for df, kinds in ((regions, ("bbox", "polygon", "hole")), (buffered, ("buffer",))):
        if df is None:
            continue
        r = limited(df, drawn_labels).join(factors, "slide_id")
        ext = F.transform("parts", lambda p: p["ext"])
        ends = lambda c, f: f(F.transform("parts", lambda p: f(p["ext"][c])))
        shapes = {"bbox": F.array(box_ring(ends("x", F.array_min), ends("y", F.array_min), ends("x", F.array_max), ends("y", F.array_max))), "polygon": ext, "hole": F.flatten(F.transform("parts", lambda p: p["holes"])), "buffer": ext}
        for kind in kinds:
            out = out.unionByName(_lines(r, kind, shapes[kind], F.col("region_scale")))
    return out


def draw_line(image: np.ndarray, x1: float, y1: float, x2: float, y2: float, color: tuple[int, int, int], thickness: int = 1) -> None:
    """A line of square pen points, cut off at the image's edges."""
    n = int(max(abs(x2 - x1), abs(y2 - y1))) + 1
    x, y = np.linspace(x1, x2, n + 1).round().astype(int), np.linspace(y1, y2, n + 1).round().astype(int)
    for dy in range(-(thickness // 2), thickness - thickness // 2):
        for dx in range(-(thickness // 2), thickness - thickness // 2):
            there = (x + dx >= 0) & (x + dx < image.shape[1]) & (y + dy >= 0) & (y + dy < image.shape[0])
            image[y[there] + dy, x[there] + dx] = color


def preview_images(images: DataFrame, lines: DataFrame, *, colors: dict[str, str] = {}, thickness: int = 2) -> DataFrame:
    """(slide_id, png): ``images`` (slide_id, width, height, data as RGB) with the
    lines of ``segments`` drawn on them. Slides without lines stay as they are."""
    rgb = {k: color_rgb(c) for k, c in {**COLORS, **colors}.items()}
    order = {k: i for i, k in enumerate(COLORS)}

    def run(key: tuple[pa.Scalar, ...], held: pa.Table, drawn: pa.Table) -> pa.Table:
        out = pa.schema([("slide_id", pa.string()), ("png", pa.binary())])
        if not held.num_rows:
            return out.empty_table()
        first = held.slice(0, 1).to_pylist()[0]
        image = np.frombuffer(first["data"], np.uint8).reshape(first["height"], first["width"], 3).copy()
        for s in sorted(drawn.to_pylist(), key=lambda s: order[s["kind"]]):
            draw_line(image, s["x1"], s["y1"], s["x2"], s["y2"], rgb[s["kind"]], thickness)
        return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([codecs.png_bytes(image)], pa.binary())], schema=out)

    held = images.select("slide_id", "width", "height", "data").filter(F.col("slide_id").isNotNull())
    return held.groupBy("slide_id").cogroup(lines.groupBy("slide_id")).applyInArrow(run, "slide_id string, png binary")
