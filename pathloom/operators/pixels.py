"""Pixel regions from tiled slides: crop, pad, resample.

A request (slide_id, region_id, x, y, level or mpp, w, h) is resolved against
the pyramid to a window of one level, joined with the tiles it meets on tile
keys, and put together from those few tiles. A slide is never loaded whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.resize import resize, white_borders
from pathloom.functions.scalars import whole
from pathloom.operators import pyramid
from pathloom.operators.proximity import covered_cells, in_covered
from pathloom.operators.skew import HOT_ROWS, lookup_join, salted_join

#: Bytes of images that a result batch holds, about.
_OUT_BYTES = 8 * 1024 * 1024
_IMAGE = "region_id bigint, width int, height int, n_channels int, data binary"


def resolved_regions(requests: DataFrame, levels: DataFrame, *, mode: str | None = None, level_zero: bool = True, check: bool = True) -> DataFrame:
    """Requests with what is read for them: read_level, its window (rx, ry, rw,
    rh), ``pad`` and ``valid``. ``slide_level`` or ``mpp`` is set in a request.

    An mpp that matches a level is read from it. Others need a resampling mode:
    "tile" reads the window at the base level; "wsi" rounds the place on the
    resampled level first, so both give the same size but may differ by a pixel.
    With ``check``, a request beyond the image or without a level is an error.
    """
    r = lookup_join(requests, pyramid.pyramids(levels), ["slide_id"])
    matched = F.when(F.col("mpp").isNotNull(), F.nullif(pyramid.level_of_mpp(F.col("mpp")), F.lit(-1))).when(pyramid.of_level(F.col("slide_level"), "width").isNotNull(), F.col("slide_level"))
    r = r.withColumn("_f", pyramid.resample_factors(F.col("slide_level"), F.col("mpp"), level_zero)).withColumn("_m", matched)
    zero = F.col("_f.zero_factor")
    valid = pyramid.location_valid(F.col("x"), F.col("y"), F.col("w"), F.col("h"), zero) & (F.col("_m").isNotNull() | (F.lit(mode is not None) & pyramid.mpp_in_range(F.col("mpp"))))
    level = F.coalesce("_m", "_f.base_level")
    scale = F.when(F.col("_m").isNotNull(), F.lit(1.0)).otherwise(F.col("_f.base_factor"))
    down = pyramid.of_level(level, "downsample")

    def start(c: str) -> Column:
        direct = F.col(c) / down
        if mode == "wsi":
            direct = F.when(F.col("_m").isNotNull(), direct).otherwise(whole(F.col(c) / zero) * F.col("_f.base_factor"))
        return F.floor(direct + 1e-9)

    pad = pyramid.needs_padding(F.col("x"), F.col("y"), F.col("w"), F.col("h"), zero)
    out = r.withColumns({"read_level": level, "rx": start("x"), "ry": start("y"), "rw": whole(F.col("w") * scale), "rh": whole(F.col("h") * scale), "pad": pad, "valid": F.coalesce(valid, F.lit(False))})
    if check:
        message = F.concat(F.lit("region "), F.col("region_id").cast("string"), F.lit(" of slide "), F.col("slide_id"), F.lit(" can't be read: beyond the image, or no such level"))
        out = out.filter(F.when(F.col("valid"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    return out.drop("_f", "_m", "levels")


def read_regions(requests: DataFrame, tiles: DataFrame, levels: DataFrame, *, mode: str | None = None, skip_padding: bool = False, method: str = "LANCZOS", tile: int = 256, level_zero: bool = True, hot_rows: int = HOT_ROWS, draw: Callable[[dict], np.ndarray] | None = None) -> DataFrame:
    """(region_id, width, height, n_channels, data): the raw RGB pixels of each
    request, [y, x, channel]. Pixels beyond the image are black, or white where
    padding applies (before resampling in tile mode, after it in wsi mode).
    region_id must be unique. A task goes through its regions one by one, so only
    one region's pixels are held. Only tiles that some region meets are
    shuffled, and of these what lies in a region's window goes on with it.

    ``draw`` makes a tile's pixels [y, x, 3], from its row of ``tiles`` as a
    dict. ``tiles`` then needs no data: its rows are shuffled in place of
    pixels, and a tile is made in the task of the regions that meet it."""
    r = resolved_regions(requests, levels, mode=mode, level_zero=level_zero)
    return read_resolved(r, tiles, mode=mode, skip_padding=skip_padding, method=method, tile=tile, hot_rows=hot_rows, draw=draw)


#: What is read for a request, of ``resolved_regions``.
WINDOW = ("slide_id", "region_id", "w", "h", "read_level", "rx", "ry", "rw", "rh", "pad")


def read_resolved(resolved: DataFrame, tiles: DataFrame, *, mode: str | None = None, skip_padding: bool = False, method: str = "LANCZOS", tile: int = 256, hot_rows: int = HOT_ROWS, draw: Callable[[dict], np.ndarray] | None = None) -> DataFrame:
    """``read_regions`` of requests that ``resolved_regions`` resolved in the same
    mode; of these the columns WINDOW. The plan has them five times over, so
    many of them, or what is long to plan, had better be given as a table."""
    r = resolved.select(*WINDOW)
    span = lambda a, n: F.sequence(F.greatest(F.floor(F.col(a) / tile), F.lit(0)), F.greatest(F.floor((F.col(a) + F.col(n) - 1) / tile), F.lit(0)))
    on = ["slide_id", "read_level", "tx", "ty"]
    keyed = r.withColumn("read_level", F.col("read_level").cast("int")).withColumn("tx", F.explode(span("rx", "rw"))).withColumn("ty", F.explode(span("ry", "rh")))
    t = tiles.select("slide_id", F.col("slide_level").cast("int").alias("read_level"), F.col("tx").cast("long").alias("tx"), F.col("ty").cast("long").alias("ty"), *[F.col(c).cast("int").alias(n) for c, n in (("x0", "x0"), ("y0", "y0"), ("width", "tw"), ("height", "th"))], *(["data"] if draw is None else [F.struct(*tiles.columns).alias("_tile")]))
    met = in_covered(t, covered_cells(keyed, *map(F.col, on)), *map(F.col, on))
    joined = salted_join(keyed, met, on, spread_by=["region_id"], hot_rows=hot_rows, large=True)
    pad_first = mode == "tile"
    columns = ["region_id", "w", "h", "rx", "ry", "rw", "rh", "pad", "x0", "y0", "tw", "th", "data"]
    # Each region has a row without a tile, so that one which meets none is there too: all background.
    none = r.withColumns({"x0": F.lit(None).cast("int"), "y0": F.lit(None).cast("int"), "tw": F.lit(0), "th": F.lit(0), "data": F.lit(None).cast("binary")})
    if draw is None:
        pieces = joined.select(*columns)
        pieces = pieces.mapInArrow(_cut_to_window, pieces.schema)
    else:
        pieces = joined.select(*columns[:-1], "_tile").mapInArrow(lambda batches: _cut_to_window(batches, draw), none.select(*columns).schema)
    parts = pieces.unionByName(none.select(*columns)).repartition("region_id").sortWithinPartitions("region_id")
    schema = pa.schema([("region_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("n_channels", pa.int32()), ("data", pa.binary())])

    def finished(image: np.ndarray, region: dict) -> dict:
        w, h = region["w"], region["h"]
        pad, resampled = region["pad"] and not skip_padding, (region["rw"], region["rh"]) != (w, h)
        if pad and (pad_first or not resampled):
            image = white_borders(image)
        image = resize(image, w, h, method)
        if pad and resampled and not pad_first:
            image = white_borders(image)
        return {"region_id": region["region_id"], "width": w, "height": h, "n_channels": 3, "data": image.tobytes()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Regions one after the other, each put together from its tiles."""
        region, image, done, size = None, None, [], 0
        for batch in batches:
            small, tiles_of = batch.drop_columns(["data"]).to_pylist(), batch.column("data")
            for i, row in enumerate(small):
                if region is None or row["region_id"] != region["region_id"]:
                    if region is not None:
                        done.append(finished(image, region))
                        size += len(done[-1]["data"])
                        if size >= _OUT_BYTES:
                            yield pa.RecordBatch.from_pylist(done, schema)
                            done, size = [], 0
                    region, image = row, np.zeros((row["rh"], row["rw"], 3), np.uint8)
                if row["x0"] is None or not tiles_of[i].is_valid:
                    continue
                tw, th = row["tw"], row["th"]
                block = np.frombuffer(tiles_of[i].as_buffer(), np.uint8).reshape(th, tw, 3)
                left, top = row["x0"] - row["rx"], row["y0"] - row["ry"]
                a, b, c, d = max(left, 0), min(left + tw, image.shape[1]), max(top, 0), min(top + th, image.shape[0])
                if a < b and c < d:
                    image[c:d, a:b] = block[c - top : d - top, a - left : b - left]
        if region is not None:
            yield pa.RecordBatch.from_pylist([*done, finished(image, region)], schema)

    return parts.mapInArrow(run, _IMAGE)


def _cut_to_window(batches: Iterable[pa.RecordBatch], draw: Callable[[dict], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Tiles (x0, y0, tw, th, data) cut to the window rx, ry, rw, rh of their row.

    With ``draw``, data is made from the row's ``_tile``. The join leaves a
    tile's rows one after the other, so that is done once for all of them."""
    last, tile = None, None
    for batch in batches:
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
        x0, y0, tw, th, rx, ry, rw, rh = map(column, ("x0", "y0", "tw", "th", "rx", "ry", "rw", "rh"))
        left, top = np.maximum(x0, rx), np.maximum(y0, ry)
        wide, high = (np.maximum(n, 0) for n in (np.minimum(x0 + tw, rx + rw) - left, np.minimum(y0 + th, ry + rh) - top))
        source = batch.column("data" if draw is None else "_tile")
        source = source if draw is None else source.to_pylist()
        small = batch.drop_columns(["data" if draw is None else "_tile"])
        for name, values in (("x0", left), ("y0", top), ("tw", wide), ("th", high)):
            at = small.schema.get_field_index(name)
            small = small.set_column(at, small.schema.field(at), pa.array(values, small.schema.field(at).type))
        cut, begun, size = [], 0, 0
        for k, (a, b, w, h) in enumerate(zip((left - x0).tolist(), (top - y0).tolist(), wide.tolist(), high.tolist())):
            if not w or not h or (draw is None and not source[k].is_valid):
                cut.append(None)
                continue
            if draw is None:
                tile = np.frombuffer(source[k].as_buffer(), np.uint8).reshape(th[k], tw[k], 3)
            elif source[k] != last:
                last, tile = source[k], draw(source[k])
            cut.append(tile[b : b + h, a : a + w].tobytes())
            size += len(cut[-1])
            if size >= _OUT_BYTES:
                yield small.slice(begun, len(cut)).append_column("data", pa.array(cut, pa.binary()))
                cut, begun, size = [], k + 1, 0
        yield small.slice(begun, len(cut)).append_column("data", pa.array(cut, pa.binary()))


def image_struct(images: DataFrame) -> DataFrame:
    """The images in Spark's image struct: BGR bytes, mode 16."""
    @F.pandas_udf("binary")
    def swap(data: pd.Series) -> pd.Series:
        return data.map(lambda d: np.frombuffer(d, np.uint8).reshape(-1, 3)[:, ::-1].tobytes())

    image = F.struct(F.lit("").alias("origin"), "height", "width", F.col("n_channels").alias("nChannels"), F.lit(16).alias("mode"), swap("data").alias("data"))
    return images.select("region_id", image.alias("image"))


def from_image_source(images: DataFrame) -> DataFrame:
    """Tiles of flat images read by Spark's image source: one tile a slide."""
    @F.pandas_udf("binary")
    def rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(d, np.uint8).reshape(-1, c)[:, [2, 1, 0] if c >= 3 else [0, 0, 0]].tobytes() for d, c in zip(data, channels)])

    name = F.regexp_replace(F.regexp_extract("image.origin", r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    zero = [F.lit(0).alias(c) for c in ("slide_level", "tx", "ty", "x0", "y0")]
    return images.select(name.alias("slide_id"), *zero, F.col("image.width").alias("width"), F.col("image.height").alias("height"), rgb("image.data", "image.nChannels").alias("data"))


def tensors(images: DataFrame) -> DataFrame:
    """(region_id, shape, tensor ARRAY<FLOAT>): channels first, 0 to 1."""
    @F.pandas_udf("array<float>")
    def to_tensor(data: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([(np.frombuffer(d, np.uint8).reshape(y, x, n).transpose(2, 0, 1).astype(np.float32) / 255).ravel() for d, y, x, n in zip(data, h, w, c)])

    return images.select("region_id", F.array("n_channels", "height", "width").alias("shape"), to_tensor("data", "height", "width", "n_channels").alias("tensor"))
