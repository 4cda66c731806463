"""Binary masks: packed blocks, foreground counts, tissue detection, clean-up.

A mask is a table of its foreground cells (slide_id, x, y). For windows over it,
``mask_blocks`` packs 64 x 64 cells into 64 bit rows, and ``foreground_ratio``
joins each window with the few blocks it covers and counts bits, all in the
JVM. Tissue masks start from pixel rows (slide_id, x, y, r, g, b).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pathloom.functions.scalars import fixed, whole
from pathloom.operators.skew import HOT_ROWS, lookup_join, salted_join
from pathloom.runtime import cut_lineage

SIDE = 64


def mask_blocks(cells: DataFrame) -> DataFrame:
    """(slide_id, bx, by, bits ARRAY<LONG>): one long for each x of the block,
    with a bit for each y. Only blocks with foreground. Cells that are null or
    negative are none; repeated cells are one."""
    return _packed(cells.filter((F.col("x") >= 0) & (F.col("y") >= 0)))


def _at(c: str) -> Column:
    """A cell's place in its block, for negative ones too."""
    return F.pmod(F.col(c), F.lit(SIDE)).cast("int")


def _packed(cells: DataFrame) -> DataFrame:
    """``mask_blocks`` with negative cells."""
    c = cells.select("slide_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).dropna()
    line = c.groupBy("slide_id", F.floor(F.col("x") / SIDE).alias("bx"), F.floor(F.col("y") / SIDE).alias("by"), _at("x").alias("row")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _at("y"))).alias("bits")
    )
    packed = line.groupBy("slide_id", "bx", "by").agg(F.map_from_entries(F.collect_list(F.struct("row", "bits"))).alias("m"))
    zero = F.lit(0).cast("long")
    return packed.select("slide_id", "bx", "by", F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda i: F.coalesce(F.try_element_at("m", i), zero)).alias("bits"))


def foreground_ratio(windows: DataFrame, cells: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``windows`` (slide_id, window_id, mx, my, msize; window_id unique) with
    ``foreground``: the share of foreground cells in the window from the rounded
    corner to the rounded far corner. Cells beyond the mask count as background;
    a window that begins left of or above the mask counts as empty, as does one
    without any cell.
    """
    far = [whole(F.col(c) + F.col("msize")) for c in ("mx", "my")]
    # The windows are used several times, and may be costly to make: they are written once.
    w = cut_lineage(windows).withColumns({"_x1": whole(F.col("mx")), "_y1": whole(F.col("my")), "_x2": far[0], "_y2": far[1]})
    block = lambda lo, hi: F.sequence(F.floor(F.col(lo) / SIDE), F.floor((F.col(hi) - 1) / SIDE))
    covered = (
        w.filter((F.col("_x1") >= 0) & (F.col("_y1") >= 0) & (F.col("_x2") > F.col("_x1")) & (F.col("_y2") > F.col("_y1")))
        .select("slide_id", "window_id", "_x1", "_y1", "_x2", "_y2", F.explode(block("_x1", "_x2")).alias("bx"))
        .withColumn("by", F.explode(block("_y1", "_y2")))
    )
    joined = salted_join(covered, mask_blocks(cells), ["slide_id", "bx", "by"], spread_by=["window_id"], hot_rows=hot_rows)
    inside = lambda v, b: F.greatest(F.lit(0), F.least(F.lit(SIDE), F.col(v) - F.col(b) * SIDE)).cast("int")
    x1, x2, y1, y2 = inside("_x1", "bx"), inside("_x2", "bx"), inside("_y1", "by"), inside("_y2", "by")
    ones = F.lit(-1).cast("long")
    marked = F.call_function("shiftleft", ones, y1).bitwiseAND(F.call_function("shiftrightunsigned", ones, F.lit(SIDE) - y2))
    count = F.aggregate(F.slice("bits", x1 + 1, x2 - x1), F.lit(0), lambda s, row: s + F.bit_count(row.bitwiseAND(marked)))
    counts = joined.groupBy("window_id").agg(F.sum(count).alias("_n")).withColumnRenamed("window_id", "_w")
    size = (F.col("_x2") - F.col("_x1")) * (F.col("_y2") - F.col("_y1"))
    ratio = F.when(size > 0, fixed(F.coalesce(F.col("_n"), F.lit(0)) / size)).otherwise(F.lit(0.0))
    return w.join(counts, F.col("window_id") == F.col("_w"), "left").withColumn("foreground", ratio).drop("_x1", "_y1", "_x2", "_y2", "_w", "_n")


def bounding_boxes(cells: DataFrame, slides: DataFrame | None = None) -> DataFrame:
    """(slide_id, x1, y1, x2, y2) of the foreground; all 0 for a slide of
    ``slides``, or with a row of nulls, that has none."""
    ends = [F.coalesce(f(c), F.lit(0)).alias(n) for n, f, c in (("x1", F.min, "x"), ("y1", F.min, "y"), ("x2", F.max, "x"), ("y2", F.max, "y"))]
    rows = cells.select("slide_id", "x", "y")
    if slides is not None:
        none = F.lit(None)
        rows = rows.unionByName(slides.select("slide_id", none.cast(rows.schema["x"].dataType).alias("x"), none.cast(rows.schema["y"].dataType).alias("y")).distinct())
    return rows.groupBy("slide_id").agg(*ends)


def saturation() -> Column:
    """HSV saturation of r, g, b in 0..255."""
    most, least = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    return F.when(most > 0, (most - least) / most).otherwise(F.lit(0.0))


# sRGB to CIE XYZ, and the D65 white point.
_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
_WHITE = (0.95047, 1.0, 1.08883)


def green_red() -> Column:
    """CIE Lab a* of sRGB r, g, b in 0..255."""
    def linear(c: str) -> Column:
        v = F.col(c) / 255
        return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)

    rgb = [linear(c) for c in "rgb"]

    def f(i: int) -> Column:
        t = sum((w * c for w, c in zip(_XYZ[i], rgb)), F.lit(0.0)) / _WHITE[i]
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)

    return 500 * (f(0) - f(1))


def gray() -> Column:
    """Luma of r, g, b, rounded half up."""
    return F.floor(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b") + 0.5).cast("int")


def otsu_thresholds(grays: DataFrame) -> DataFrame:
    """(slide_id, threshold) from (slide_id, gray): the first gray level that
    maximises the variance between the levels up to it and those above."""
    hist = grays.groupBy("slide_id", "gray").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("slide_id").orderBy("gray").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("slide_id")
    h = hist.withColumns({"n0": F.sum("n").over(upto), "s0": F.sum(F.col("n") * F.col("gray")).over(upto), "n_all": F.sum("n").over(every), "s_all": F.sum(F.col("n") * F.col("gray")).over(every)})
    n1, s1 = F.col("n_all") - F.col("n0"), F.col("s_all") - F.col("s0")
    apart = F.col("s0") / F.col("n0") - s1 / n1
    between = F.when(n1 > 0, F.col("n0").cast("double") * n1 * apart * apart).otherwise(F.lit(0.0))
    return h.withColumn("v", between).groupBy("slide_id").agg(F.max_by("gray", F.struct("v", -F.col("gray"))).alias("threshold"))


def tissue_cells(pixels: DataFrame, mode: str = "hsv", threshold: float = 0.1) -> DataFrame:
    """Foreground cells (slide_id, x, y) of a level's pixels. hsv and lab: the
    channel is above (1 + threshold) x its mean over the slide; otsu: gray is
    not above the slide's Otsu level. The means are one row a slide and are
    joined back, so no slide is gathered in one task."""
    p = pixels.filter(F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull())
    if mode == "otsu":
        p = p.withColumn("gray", gray())
        return lookup_join(p, otsu_thresholds(p.select("slide_id", "gray")), ["slide_id"]).filter(F.col("gray") <= F.col("threshold")).select("slide_id", "x", "y")
    if mode not in ("hsv", "lab"):
        raise ValueError(f"unknown mask mode: {mode}")
    p = p.withColumn("channel", saturation() if mode == "hsv" else green_red())
    means = p.groupBy("slide_id").agg(F.avg("channel").alias("mean"))
    return lookup_join(p, means, ["slide_id"]).filter(F.col("channel") > (1 + threshold) * F.col("mean")).select("slide_id", "x", "y")


def level_factor(level: int) -> float:
    """About the pixels that a level-0 square of 256 has at a level."""
    return 256 * 256 * math.exp(-2.772 * level)


def label_components(mask: np.ndarray, *, diagonal: bool = False) -> np.ndarray:
    """Connected regions of a boolean array, numbered from 1; 0 is background.

    Runs of each row are the nodes; runs of neighbouring rows that touch are
    joined by union-find with path halving.
    """
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    change = np.diff(padded, axis=1)
    rows, starts = np.nonzero(change == 1)
    ends = np.nonzero(change == -1)[1]
    parent = np.arange(len(rows))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(rows, np.arange(h + 1))
    reach = 1 if diagonal else 0
    for r in range(1, h):
        i, j = first[r - 1], first[r]
        while i < first[r] and j < first[r + 1]:
            if starts[i] < ends[j] + reach and starts[j] < ends[i] + reach:
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(i) for i in range(len(rows))], dtype=np.int64)
    numbers = np.unique(roots, return_inverse=True)[1] + 1 if len(roots) else roots
    out = np.zeros((h, w), np.int32)
    for r, s, e, n in zip(rows.tolist(), starts.tolist(), ends.tolist(), numbers.tolist()):
        out[r, s:e] = n
    return out


def fill_all_holes(mask: np.ndarray) -> np.ndarray:
    """Background that doesn't reach the border becomes foreground."""
    outside = np.pad(~mask, 1, constant_values=True)
    labels = label_components(outside)
    return (labels != labels[0, 0])[1:-1, 1:-1]


def remove_small(mask: np.ndarray, least: int) -> np.ndarray:
    """Without 4-connected regions of fewer than ``least`` cells."""
    labels = label_components(mask)
    sizes = np.bincount(labels.ravel())
    keep = sizes >= least
    keep[0] = False
    return keep[labels]


def _slide_max(mask: np.ndarray, k: int, before: int) -> np.ndarray:
    """Maximum over k cells along both axes, ``before`` of them before the cell."""
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (before, k - 1 - before)
        wide = np.cumsum(np.insert(np.pad(mask, pad), 0, 0, axis=axis), axis=axis, dtype=np.int64)
        n = mask.shape[axis]
        mask = np.take(wide, np.arange(k, k + n), axis) - np.take(wide, np.arange(n), axis) > 0
    return mask


def close_mask(mask: np.ndarray, k: int) -> np.ndarray:
    """Dilation, then erosion, with a k x k square; outside the mask nothing is set or eaten."""
    grown = _slide_max(mask, k, k // 2)
    return ~_slide_max(~grown, k, (k - 1) - k // 2)


def clean_mask(mask: np.ndarray, level: int, *, small_holes: float = 0.1, small_objects: float = 0.1, all_holes: bool = False, close: int = 0) -> np.ndarray:
    """In this order, each only if asked: fill all holes, fill small ones, close,
    drop small objects; small is a share of a 256 square at the level."""
    if all_holes:
        mask = fill_all_holes(mask)
    if small_holes:
        mask = ~remove_small(~mask, math.ceil(small_holes * level_factor(level)))
    if close:
        mask = close_mask(mask, close)
    if small_objects:
        mask = remove_small(mask, math.ceil(small_objects * level_factor(level)))
    return mask


def clean_cells(cells: DataFrame, sizes: DataFrame, level: int, **options) -> DataFrame:
    """``clean_mask`` over whole masks: cells (slide_id, x, y) and sizes
    (slide_id, width, height, one row a slide). A mask is a raster of one level,
    bounded by its size, so a slide is one group."""
    schema = T.StructType([T.StructField("slide_id", cells.schema["slide_id"].dataType), T.StructField("x", T.LongType()), T.StructField("y", T.LongType())])

    def run(key: tuple[pa.Scalar, ...], held: pa.Table, size: pa.Table) -> pa.Table:
        out = pa.schema([("slide_id", held.schema.field("slide_id").type), ("x", pa.int64()), ("y", pa.int64())])
        if not size.num_rows:
            return out.empty_table()
        w, h = size["width"][0].as_py(), size["height"][0].as_py()
        mask = np.zeros((w, h), bool)
        x, y = held["x"].to_numpy(), held["y"].to_numpy()
        there = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        mask[x[there], y[there]] = True
        x, y = np.nonzero(clean_mask(mask, level, **options))
        return pa.table([pa.array([key[0].as_py()] * len(x), out.field(0).type), pa.array(x), pa.array(y)], schema=out)

    size = sizes.select("slide_id", "width", "height").dropna().dropDuplicates(["slide_id"])
    held = cells.select("slide_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).dropna()
    return held.groupBy("slide_id").cogroup(size.groupBy("slide_id")).applyInArrow(run, schema)


def polygon_cells(polygons: DataFrame, sizes: DataFrame) -> DataFrame:
    """Cells (slide_id, x, y) inside or on the edge of any polygon's exterior.

    polygons: slide_id, points in mask cells (cut to whole numbers); holes are
    ignored. sizes: slide_id, width, height. A point beyond the mask is an
    error; cells beyond it are left out. One numpy raster a polygon's box, no
    larger than the mask.
    """
    schema = T.StructType([T.StructField("slide_id", polygons.schema["slide_id"].dataType), T.StructField("x", T.LongType()), T.StructField("y", T.LongType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, points, width, height in zip(frame.slide_id, frame.points, frame.width, frame.height):
                ring = np.array([[int(p["x"]), int(p["y"])] for p in points if p is not None and p["x"] is not None and p["y"] is not None])
                if not len(ring):
                    continue
                if ring[:, 0].max() > width or ring[:, 1].max() > height:
                    raise ValueError(f"polygon coordinates exceed mask size ({width}, {height})")
                x, y = raster_ring(ring)
                keep = (x >= 0) & (y >= 0) & (x < width) & (y < height)
                yield pd.DataFrame({"slide_id": [key] * int(keep.sum()), "x": x[keep], "y": y[keep]})

    s = sizes.select("slide_id", "width", "height").dropna().dropDuplicates(["slide_id"])
    return polygons.select("slide_id", "points").dropna().join(s, "slide_id").mapInPandas(run, schema).distinct()


def raster_ring(ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole-numbered cells inside a ring (even-odd) or on its edges."""
    lo, hi = ring.min(axis=0), ring.max(axis=0)
    x, y = np.meshgrid(np.arange(lo[0], hi[0] + 1), np.arange(lo[1], hi[1] + 1), indexing="ij")
    inside = np.zeros(x.shape, bool)
    on = np.zeros(x.shape, bool)
    for (px, py), (qx, qy) in zip(ring, np.roll(ring, -1, axis=0)):
        cross = (qx - px) * (y - py) - (qy - py) * (x - px)
        on |= (cross == 0) & (x >= min(px, qx)) & (x <= max(px, qx)) & (y >= min(py, qy)) & (y <= max(py, qy))
        if py != qy:
            spans = (py > y) != (qy > y)
            inside ^= spans & ((cross < 0) == (qy < py)) & (cross != 0)
    found = inside | on
    return x[found], y[found]


def outline_cells(cells: DataFrame) -> DataFrame:
    """Foreground cells with a background 4-neighbour: the contour."""
    c = cells.select("slide_id", "x", "y").distinct()
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    around = c.select("slide_id", "x", "y", F.explode(steps).alias("d")).select("slide_id", "x", "y", (F.col("x") + F.col("d.dx")).alias("nx"), (F.col("y") + F.col("d.dy")).alias("ny"))
    other = c.select(F.col("slide_id").alias("_s"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    return around.join(other, (F.col("slide_id") == F.col("_s")) & (F.col("nx") == F.col("_x")) & (F.col("ny") == F.col("_y")), "left_anti").select("slide_id", "x", "y").distinct()


def _outlined(blocks: DataFrame) -> DataFrame:
    """Blocks with ``edge``: the bits of ``bits`` that have a background
    4-neighbour. Each block is handed to its four neighbours once."""
    sides = {"own": (0, 0), "left": (1, 0), "right": (-1, 0), "below": (0, 1), "above": (0, -1)}
    to = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("dx"), F.lit(b).alias("dy")) for n, (a, b) in sides.items()])
    sent = blocks.withColumn("to", F.explode(to)).select("slide_id", (F.col("bx") + F.col("to.dx")).alias("bx"), (F.col("by") + F.col("to.dy")).alias("by"), F.col("to.n").alias("n"), "bits")
    met = sent.groupBy("slide_id", "bx", "by").agg(*[F.first(F.when(F.col("n") == n, F.col("bits")), ignorenulls=True).alias(n) for n in sides]).filter(F.col("own").isNotNull())
    of = lambda side, i: F.coalesce(F.get(F.col(side), i), F.lit(0).cast("long"))
    shift = lambda how, v, n: F.call_function(f"shift{how}", v, F.lit(n))

    def edge(i: Column) -> Column:
        own = of("own", i)
        before = F.when(i == 0, of("left", F.lit(SIDE - 1))).otherwise(of("own", i - 1))
        after = F.when(i == SIDE - 1, of("right", F.lit(0))).otherwise(of("own", i + 1))
        down = shift("left", own, 1).bitwiseOR(shift("rightunsigned", of("below", i), SIDE - 1))
        up = shift("rightunsigned", own, 1).bitwiseOR(shift("left", of("above", i), SIDE - 1))
        return own.bitwiseAND(F.bitwise_not(before.bitwiseAND(after).bitwiseAND(down).bitwiseAND(up)))

    return met.select("slide_id", "bx", "by", F.col("own").alias("bits"), F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), edge).alias("edge"))


def overlay_pixels(pixels: DataFrame, cells: DataFrame, *, mask_rgb=(0, 128, 0), alpha: float = 0.5, outline_rgb=(0, 0, 255)) -> DataFrame:
    """Pixels (slide_id, x, y, r, g, b) with the mask blended over them and its
    contour drawn; ``mask_rgb`` or ``outline_rgb`` None leaves that out. Pixels
    meet the mask's blocks, not its cells."""
    a = round(255 * alpha) / 255
    # Far more blocks and pixels than the bytes they are made of: never broadcast.
    blocks = _outlined(_packed(cells)).select(F.col("slide_id").alias("_s"), "bx", "by", "bits", "edge").hint("shuffle_hash")
    here = (F.col("slide_id") == F.col("_s")) & (F.floor(F.col("x") / SIDE) == F.col("bx")) & (F.floor(F.col("y") / SIDE) == F.col("by"))
    bit = lambda c: F.coalesce(F.call_function("shiftrightunsigned", F.get(c, _at("x")), _at("y")).bitwiseAND(1) == 1, F.lit(False))
    p = pixels.join(blocks, here, "left").withColumns({"_on": bit("bits"), "_edge": bit("edge")})
    for i, c in enumerate("rgb"):
        value = F.col(c)
        if mask_rgb is not None:
            value = F.when(F.col("_on"), F.floor(F.col(c) * (1 - a) + mask_rgb[i] * a + 0.5).cast("int")).otherwise(value)
        if outline_rgb is not None:
            value = F.when(F.col("_edge"), F.lit(outline_rgb[i])).otherwise(value)
        p = p.withColumn(f"_{c}", value)
    return p.select("slide_id", "x", "y", *[F.col(f"_{c}").alias(c) for c in "rgb"])
