"""Masks from array and image files to foreground cells, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import codecs
from pathloom.functions.scalars import slide_key

_CELLS = "slide_id string, width int, height int, x int, y int"


def mask_array(content: bytes, key: str = "data") -> np.ndarray:
    """Boolean [x, y] of a file: arrays as they are, images transposed; anything
    else is a TypeError, more than two dimensions a ValueError."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        image = codecs.read_png(content)
        array = (image.any(axis=2) if image.ndim == 3 else image).T
    elif content[:6] == b"\x93NUMPY" or content[:2] == b"PK":
        array = codecs.read_array(content, key)
    elif content[:4] in (b"II*\0", b"MM\0*"):
        array = codecs.read_tiff_page(content, codecs.tiff_directories(content)[0]).any(axis=2).T
    else:
        raise TypeError("mask data is neither an array nor an image file")
    if array.ndim > 2:
        raise ValueError("mask data has more than two dimensions")
    return array.astype(bool)


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """Foreground cells (slide_id, width, height, x, y) of the mask files under
    ``path``; the slide is the file's name without extension. A mask without
    foreground has one row with null x and y, so its size isn't lost."""
    files = spark.read.format("binaryFile").load(path).select(slide_key(F.col("path")).alias("slide_id"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, content in zip(frame.slide_id, frame.content):
                array = mask_array(content)
                x, y = np.nonzero(array)
                if not len(x):
                    x = y = [None]
                yield pd.DataFrame({"slide_id": key, "width": array.shape[0], "height": array.shape[1], "x": x, "y": y})

    return files.mapInPandas(run, _CELLS)


def mask_files(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """(slide_id, npz, png) of each mask: the packed array [x, y] and the 1-bit
    image. A mask is one raster of its level, so a slide is one group."""
    def run(key: tuple, held: pd.DataFrame, size: pd.DataFrame) -> pd.DataFrame:
        if not len(size):
            return pd.DataFrame({"slide_id": [], "npz": [], "png": []})
        array = np.zeros((int(size.width.iloc[0]), int(size.height.iloc[0])), bool)
        held = held.dropna()
        array[held.x.to_numpy(int), held.y.to_numpy(int)] = True
        return pd.DataFrame({"slide_id": [key[0]], "npz": [codecs.array_bytes(array)], "png": [codecs.png_bytes(array.T)]})

    size = sizes.select("slide_id", "width", "height").dropDuplicates(["slide_id"])
    return cells.select("slide_id", "x", "y").groupBy("slide_id").cogroup(size.groupBy("slide_id")).applyInPandas(run, "slide_id string, npz binary, png binary")
