"""Patch images to disk: paths, manifests, writers and the count afterwards."""

from __future__ import annotations

import datetime
import os
import platform
import uuid
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import codecs
from pathloom.functions.scalars import patch_file_name, patch_path
from pathloom.sources.files import split_uri

# A manifest's keys in their order, and the width of the key column.
_INDENT = 24
_HEAD = ("Manifest ID:", "Manifest file path:", "Date created:", "Hostname:")
_PATCHES = ("Patch class:", "Patch class params:", "Patch count:", "Patch labels:")
_EXTRACTOR = ("Extractor class:", "Extractor class params:", "Saved patches:")


def with_paths(patches: DataFrame, folder: str, manifest_id: Column, *, by_label: bool = False, comment: str | Column = "", separator: str = "_", image_type: str = "png", set_dir: Column | None = None) -> DataFrame:
    """``patches`` (slide_id, x, y, label) with ``path`` of each image file."""
    name = patch_file_name(F.col("slide_id"), manifest_id, F.col("x"), F.col("y"), label=F.col("label"), comment=F.lit(comment) if isinstance(comment, str) else comment, separator=separator, image_type=image_type)
    return patches.withColumn("path", patch_path(folder, name, label=F.col("label") if by_label else None, set_dir=set_dir))


def member_comment(level: Column, mpp: Column, comment: str = "", separator: str = "_") -> Column:
    """comment and "mpp<v>" or "level<v>" of a patch-set member."""
    suffix = F.coalesce(F.concat(F.lit("mpp"), mpp.cast("string")), F.concat(F.lit("level"), level.cast("string")))
    return F.concat_ws(separator, F.lit(comment or None), suffix)


def set_folder(number: Column, slide: Column | None = None) -> Column:
    """"set<n>", or "<slide>__set<n>" where numbers begin anew in each slide."""
    plain = F.concat(F.lit("set"), number.cast("string"))
    return plain if slide is None else F.concat_ws("__", slide, plain)


def _store(path: str, content: bytes) -> None:
    """Under another name first, so that a task run again leaves a whole file."""
    fs, place = split_uri(path)
    fs.create_dir(os.path.dirname(place), recursive=True)
    torn = f"{place}.{uuid.uuid4().hex}"
    with fs.open_output_stream(torn) as f:
        f.write(content)
    fs.move(torn, place)


def save_bytes(rows: DataFrame, content: str) -> DataFrame:
    """Write the column ``content`` to each row's ``path``; (path, n_bytes), lazily:
    evaluate it once, by storing it."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame.path, frame["data"]):
                _store(path, data)
            yield pd.DataFrame({"path": frame.path, "n_bytes": frame["data"].map(len)})

    return rows.select("path", F.col(content).alias("data")).dropna().mapInPandas(run, "path string, n_bytes bigint")


def save_images(images: DataFrame, *, image_type: str = "png") -> DataFrame:
    """Write (path, width, height, n_channels, data) as PNG or TIFF files;
    returns (path, n_bytes), lazily: evaluate it once, by storing it."""
    if image_type not in ("png", "tif", "tiff"):
        raise ValueError(f"image type {image_type} can't be written")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = []
            for path, w, h, c, data in zip(frame.path, frame.width, frame.height, frame.n_channels, frame["data"]):
                image = np.frombuffer(data, np.uint8).reshape(h, w, c)
                content = codecs.png_bytes(image) if image_type == "png" else codecs.tiff_bytes([image])
                _store(path, content)
                sizes.append(len(content))
            yield pd.DataFrame({"path": frame.path, "n_bytes": sizes})

    return images.select("path", "width", "height", "n_channels", "data").mapInPandas(run, "path string, n_bytes bigint")


def manifest_line(key: str, value: object = "") -> str:
    return f"{key:<{_INDENT}}{value}"


def manifest_header(manifest_id: str, path: str, *, patch_class: str, patch_params: Mapping, counts: Mapping[str, int], extractor: str, extractor_params: Mapping) -> list[str]:
    """The lines before a manifest's file list."""
    hidden = {"self", "patches", "kwargs"}
    indented = lambda d: [manifest_line("", f"{k}: {v}") for k, v in sorted(d.items()) if k not in hidden]
    created = datetime.datetime.now().strftime("%Y-%b-%d %H:%M:%S")
    head = [manifest_line(k, v) for k, v in zip(_HEAD, (manifest_id, path, created, platform.node()))]
    kind, params, total, labels = _PATCHES
    patches = [manifest_line(kind, patch_class), params, *indented(patch_params), manifest_line(total, sum(counts.values())), manifest_line(labels, dict(sorted(counts.items())))]
    name, options, saved = _EXTRACTOR
    return [*head, "-" * 50, *patches, manifest_line(name, extractor), options, *indented(extractor_params), saved]


def write_manifest(spark: SparkSession, folder: str, manifest_id: str, slide: str, header: list[str], paths: DataFrame) -> str:
    """Write ``manifests/manifest__<id>__<slide>`` under ``folder``, which must
    exist: a text folder of the header and the sorted paths. One that is there
    already is an error."""
    if not os.path.isdir(folder):
        raise OSError(f'output directory "{folder}" does not exist')
    place = os.path.join(folder, "manifests", f"manifest__{manifest_id}__{slide}.txt")
    head = spark.createDataFrame([(i, line) for i, line in enumerate(header)], "k int, value string").coalesce(1).sortWithinPartitions("k").select("value")
    head.write.mode("error").text(place)
    paths.select(F.concat(F.lit(" " * _INDENT), F.col("path")).alias("value")).sort("value").write.mode("append").text(place)
    return place


def saved_count(spark: SparkSession, folder: str, manifest_id: str, image_type: str = "png") -> int:
    """Files under ``folder`` whose names have the manifest id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{manifest_id}*.{image_type}").option("recursiveFileLookup", "true").load(folder)
    return files.select("path").count()


def check_saved(spark: SparkSession, folder: str, manifest_id: str, expected: int, image_type: str = "png") -> None:
    found = saved_count(spark, folder, manifest_id, image_type)
    if found != expected:
        raise OSError(f"{found} patches were saved, not {expected}")


def outline_segments(regions: DataFrame, scale: float = 1.0) -> DataFrame:
    """(slide_id, region_id, kind, x1, y1, x2, y2): lines to draw a preview from:
    exteriors, holes and boxes of regions, brought to the preview level."""
    from pathloom.functions.geometry import edges

    part = F.explode("parts").alias("p")
    r = regions.select("slide_id", "region_id", part)
    rings = F.concat(F.array(F.struct(F.lit("polygon").alias("kind"), F.col("p.ext").alias("r"))), F.transform("p.holes", lambda h: F.struct(F.lit("hole").alias("kind"), h.alias("r"))))
    lines = r.select("slide_id", "region_id", F.explode(rings).alias("k")).select("slide_id", "region_id", "k.kind", F.explode(edges(F.col("k.r"))).alias("e"))
    return lines.select("slide_id", "region_id", "kind", *[(F.col(f"e.{c}") / scale).alias(n) for c, n in (("px", "x1"), ("py", "y1"), ("qx", "x2"), ("qy", "y2"))])
