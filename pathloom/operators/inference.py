"""Model outputs over patches: batched prediction, stitching, mean probability.

Outputs are averaged where patches overlap. ``stitch`` adds up the outputs that
meet in a raster cell: an output of one number a class stays in the JVM, a map
is laid out by numpy in Arrow batches that are summed up first. Either way sums
and counts are combined in each task before they are shuffled, a hot slide is
spread over its cells, and no raster is held whole.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.resize import INTERPOLATIONS
from pathloom.functions.scalars import whole
from pathloom.operators import pyramid
from pathloom.operators.skew import lookup_join

def predictions(images: DataFrame, make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]], *, classes: int, classifier: Callable[[np.ndarray], np.ndarray] | None = None, transform: Callable[[np.ndarray], np.ndarray] | None = None, batch: int = 32, seed: int | None = None) -> DataFrame:
    """``images`` (region_id, width, height, n_channels, data) through a model:
    region_id, ``shape`` and ``output`` (flat floats).

    ``make_predict`` is called once a task and gives a function of a batch
    [n, channels, y, x] in 0 to 1 to outputs [n, classes] or [n, classes, y, x];
    ``classifier`` follows it. Another number of classes or rank is an error.
    ``seed`` seeds Python's and numpy's generators in each task before.
    """
    schema = T.StructType([images.schema["region_id"], T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("output", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if seed is not None:
            random.seed(seed)
            np.random.seed(seed)
        predict = make_predict()
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                stack = [np.frombuffer(d, np.uint8).reshape(h, w, c) for d, h, w, c in zip(part["data"], part.height, part.width, part.n_channels)]
                inputs = [transform(a) if transform else a.transpose(2, 0, 1).astype(np.float32) / 255 for a in stack]
                out = predict(np.stack(inputs))
                out = np.asarray(classifier(out) if classifier else out, dtype=np.float32)
                if out.ndim not in (2, 4):
                    raise ValueError(f"unsupported output rank {out.ndim}")
                if out.shape[1] != classes:
                    raise ValueError(f"{out.shape[1]} classes in the output, not {classes}")
                yield pd.DataFrame({"region_id": part.region_id, "shape": [list(out.shape[1:])] * len(part), "output": [o.ravel() for o in out]})

    return images.select("region_id", "width", "height", "n_channels", "data").mapInPandas(run, schema)


def footprints(outputs: DataFrame, levels: DataFrame, *, patch_size: int, patch_level: int | None = 0, patch_mpp: float | None = None, raster_level: int = 0) -> DataFrame:
    """Outputs (slide_id, x, y at level 0, ...) with their square on the raster
    level: px, py (cut down), psize (rounded), and the raster's width and height."""
    j = lookup_join(outputs, pyramid.pyramids(levels), ["slide_id"])
    level = F.lit(raster_level)
    down = pyramid.target_factor(level, F.lit(None).cast("double"))
    scale = pyramid.of_level(level, "downsample") / pyramid.target_factor(F.lit(patch_level).cast("int"), F.lit(patch_mpp).cast("double"))
    return j.withColumns(
        {
            "px": F.floor(F.col("x") / down),
            "py": F.floor(F.col("y") / down),
            "psize": whole(F.lit(patch_size) / scale),
            "raster_w": pyramid.of_level(level, "width"),
            "raster_h": pyramid.of_level(level, "height"),
        }
    ).drop("levels")


def stitch(outputs: DataFrame, *, classes: int, maps: bool = False, interpolation: str = "bilinear") -> DataFrame:
    """Mean over overlapping outputs: (slide_id, class, x, y, prob) of each raster
    cell that an output covers.

    outputs: slide_id, px, py, psize, raster_w, raster_h, and ``shape`` and
    ``output`` as ``predictions`` gives them. An output of one number a class
    fills its square; with ``maps`` there is a map a class, which is brought to
    the square and turned from [y, x] to [x, y]. Squares are cut off at the
    raster's edges. Rows with a null key take no part; an output of another
    number of classes or another rank is an error.
    """
    o = outputs.select("slide_id", *[F.col(c).cast("long").alias(c) for c in ("px", "py", "psize", "raster_w", "raster_h")], "shape", "output").filter(F.col("slide_id").isNotNull() & (F.col("psize") > 0))
    lo = lambda c: F.greatest(F.col(c), F.lit(0))
    hi = lambda c, limit: F.least(F.col(c) + F.col("psize"), F.col(limit))
    o = o.filter((hi("px", "raster_w") > lo("px")) & (hi("py", "raster_h") > lo("py")))
    fits = (F.size("shape") == (3 if maps else 1)) & (F.col("shape")[0] == classes)
    o = o.filter(F.when(fits, F.lit(True)).otherwise(F.raise_error(F.lit("the outputs have another rank or number of classes")).cast("boolean")))
    sums = [f"s{c}" for c in range(classes)]
    if maps:
        laid = o.mapInArrow(_laid_out(classes, interpolation), T.StructType([outputs.schema["slide_id"], T.StructField("x", T.LongType()), T.StructField("y", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in sums], T.StructField("n", T.LongType())]))
    else:
        span = lambda c, limit: F.explode(F.sequence(lo(c), hi(c, limit) - 1))
        values = o.select("slide_id", "px", "py", "psize", "raster_w", "raster_h", *[F.col("output")[c].cast("double").alias(sums[c]) for c in range(classes)])
        laid = values.withColumn("x", span("px", "raster_w")).withColumn("y", span("py", "raster_h")).withColumn("n", F.lit(1).cast("long"))
    total = laid.groupBy("slide_id", "x", "y").agg(*[F.sum(c).alias(c) for c in sums], F.sum("n").alias("n"))
    each = F.array(*[F.struct(F.lit(c).alias("class"), (F.col(sums[c]) / F.col("n")).alias("prob")) for c in range(classes)])
    return total.select("slide_id", "x", "y", F.inline(each)).select("slide_id", "class", "x", "y", "prob")


def covered_squares(outputs: DataFrame, *, classes: int) -> DataFrame:
    """The outputs of one number a class with the cells x1 to x2 and y1 to y2
    (ends not included) that ``stitch`` fills with them; none where x1 is null."""
    o = outputs.select("slide_id", *[F.col(c).cast("long").alias(c) for c in ("px", "py", "psize", "raster_w", "raster_h")], "shape", "output").filter(F.col("slide_id").isNotNull())
    lo = {c: F.greatest(F.col(f"p{c}"), F.lit(0)) for c in "xy"}
    hi = {c: F.least(F.col(f"p{c}") + F.col("psize"), F.col(limit)) for c, limit in (("x", "raster_w"), ("y", "raster_h"))}
    there = (F.col("psize") > 0) & (hi["x"] > lo["x"]) & (hi["y"] > lo["y"])
    fits = (F.size("shape") == 1) & (F.col("shape")[0] == classes)
    wrong = F.raise_error(F.lit("the outputs have another rank or number of classes")).cast("long")
    ends = {f"{c}{k}": F.when(there, F.when(fits, v[c]).otherwise(wrong)) for c in "xy" for k, v in ((1, lo), (2, hi))}
    return o.withColumns(ends).drop("px", "py", "psize", "shape")


def _laid_out(classes: int, interpolation: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The cells of maps: a batch's cells are summed up before they leave it."""
    zoom = INTERPOLATIONS[interpolation]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slides = batch.column("slide_id").dictionary_encode()
            own, values = [], []
            columns = [batch.column(c).to_pylist() for c in ("px", "py", "psize", "raster_w", "raster_h", "shape")]
            wide, high = (max([1, *batch.column(c).to_pylist()]) for c in ("raster_w", "raster_h"))
            starts, flat_output = batch.column("output").offsets.to_numpy(), batch.column("output").values.to_numpy(zero_copy_only=False)
            codes = slides.indices.to_numpy().astype(np.int64)
            for k, (px, py, n, w, h, shape) in enumerate(zip(*columns)):
                maps = flat_output[starts[k] : starts[k + 1]].reshape(shape)
                a, b, c, d = max(px, 0), min(px + n, w), max(py, 0), min(py + n, h)
                if maps.shape[1:] != (n, n):
                    maps = np.stack([zoom(m.astype(float), n, n) for m in maps])
                own.append((((codes[k] * wide) + np.arange(a, b))[:, None] * high + np.arange(c, d)).ravel())
                values.append(maps.transpose(0, 2, 1)[:, a - px : b - px, c - py : d - py].reshape(classes, -1))
            if not own:
                continue
            cells, at = np.unique(np.concatenate(own), return_inverse=True)
            flat = np.concatenate(values, axis=1)
            left, y = np.divmod(cells, high)
            code, x = np.divmod(left, wide)
            arrays = [slides.dictionary.take(pa.array(code)), pa.array(x), pa.array(y)]
            arrays += [pa.array(np.bincount(at, flat[c], len(cells))) for c in range(classes)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.bincount(at, minlength=len(cells)))], names=["slide_id", "x", "y", *[f"s{c}" for c in range(classes)], "n"])

    return run


def byte_probability(p: Column) -> Column:
    """0 to 255, cut down; no value is 0, and one outside [0, 1] an error."""
    value = F.coalesce(F.nanvl(p, F.lit(0.0)), F.lit(0.0))
    outside = (value < 0) | (value > 1)
    return F.when(outside, F.raise_error(F.lit("probability outside [0, 1]")).cast("int")).otherwise(F.floor(value * 255).cast("int"))
