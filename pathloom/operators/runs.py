"""Whole runs: patches to image files with manifests, and multi-resolution sets.

``extract`` reads the pixels of each patch, writes the images, writes a
manifest for each slide and counts the files that are there afterwards.
``extract_sets`` does the same for patches at several resolutions, which share
a folder a set. ``region_sets`` and ``tensor_sets`` keep the members of a set
together in one row, for use without files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators import extract as parts
from pathloom.operators import patches as numbers
from pathloom.operators import pixels, pyramid
from pathloom.runtime import written
from pathloom.sources.files import split_uri

_MANIFESTS = "slide_id string, manifest string, n_files long"


def whole_requests(levels: DataFrame, *, level: int | None = None, mpp: float | None = None, level_zero: bool = True) -> DataFrame:
    """A request for each slide's whole level, or for the whole slide brought to
    an mpp; slides without the level or the mpp are left out. region_id is a hash
    of the slide."""
    p = pyramid.pyramids(levels)
    if mpp is None:
        size = F.struct(*[pyramid.of_level(F.lit(level), c).alias(c) for c in ("width", "height")])
    else:
        size = pyramid.resampled_size(F.lit(float(mpp)), level_zero)
    zero = F.lit(0)
    r = p.withColumn("_s", size).filter(F.col("_s.width").isNotNull() & F.col("_s.height").isNotNull())
    return r.select("slide_id", F.xxhash64("slide_id").alias("region_id"), zero.alias("x"), zero.alias("y"), F.lit(level).cast("int").alias("slide_level"), F.lit(mpp).cast("double").alias("mpp"), F.col("_s.width").cast("int").alias("w"), F.col("_s.height").cast("int").alias("h"))


def thumbnails(tiles: DataFrame, levels: DataFrame, most: int, *, method: str = "LANCZOS", tile: int = 256) -> DataFrame:
    """(slide_id, width, height, n_channels, data): each slide with its longer
    side brought to at most ``most`` pixels, from the smallest level that is
    large enough; a slide is never enlarged. What is read at once is a level
    under twice that size, or the smallest there is."""
    from pathloom.functions.resize import resize

    p = pyramid.pyramids(levels)
    w0, h0 = (pyramid.of_level(F.lit(0), c) for c in ("width", "height"))
    share = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(w0, h0))
    target = {"_w": F.greatest(F.bround(w0 * share, 0).cast("int"), F.lit(1)), "_h": F.greatest(F.bround(h0 * share, 0).cast("int"), F.lit(1))}
    large = F.filter("levels", lambda v: (v["width"] >= F.col("_w")) & (v["height"] >= F.col("_h")))
    found = p.withColumns(target).withColumn("_v", F.try_element_at(large, F.lit(-1)))
    requests = found.select("slide_id", F.xxhash64("slide_id").alias("region_id"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("_v.slide_level").alias("slide_level"), F.lit(None).cast("double").alias("mpp"), F.col("_v.width").alias("w"), F.col("_v.height").alias("h"))
    images = pixels.read_regions(requests.dropna(subset=["slide_level"]), tiles, levels, skip_padding=True, tile=tile)
    sized = images.join(found.select("slide_id", F.xxhash64("slide_id").alias("region_id"), "_w", "_h"), "region_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for r in batch.to_pylist():
                image = resize(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3), r["_w"], r["_h"], method)
                yield pa.RecordBatch.from_pylist([{"slide_id": r["slide_id"], "width": r["_w"], "height": r["_h"], "n_channels": 3, "data": image.tobytes()}], schema=pa.schema([("slide_id", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("n_channels", pa.int32()), ("data", pa.binary())]))

    return sized.select("slide_id", "width", "height", "data", "_w", "_h").mapInArrow(run, "slide_id string, width int, height int, n_channels int, data binary")


def _requests(patches: DataFrame, level: Column, mpp: Column) -> DataFrame:
    return patches.select("slide_id", "region_id", "x", "y", level.cast("int").alias("slide_level"), mpp.cast("double").alias("mpp"), "w", "h")


def _save(named: DataFrame, requests: DataFrame, tiles: DataFrame, levels: DataFrame, image_type: str, reading: Mapping) -> DataFrame:
    """(slide_id, path, n_bytes) of the images of ``named`` (slide_id, region_id, path), written once."""
    images = pixels.read_regions(requests, tiles, levels, **reading).join(named.select("region_id", "path"), "region_id")
    saved = written(parts.save_images(images, image_type=image_type), "saved")[0]
    return named.select("slide_id", "path").join(saved, "path")


def write_manifests(saved: DataFrame, labels: DataFrame, folder: str, manifest_id: str, header: Mapping) -> DataFrame:
    """A manifest for each slide under ``folder``/manifests: the header, the
    sorted paths of ``saved`` (slide_id, path) and the count of the files that
    are there. (slide_id, manifest, n_files); evaluate it once.

    ``labels``: (slide_id, label, n) of the patches; their sum is what a slide
    must have on disk, else it is an error. A manifest that is there already is
    an error too. A slide's rows are sorted and go through its task one after
    the other, so none is collected.
    """
    counts = labels.groupBy("slide_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("label", F.lit("")), "n"))))).alias("line"))
    lines = counts.withColumn("_k", F.lit(0)).unionByName(saved.select("slide_id", F.col("path").alias("line"), F.lit(1).alias("_k")))
    fixed = dict(header)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = split_uri(folder)
        system.create_dir(f"{base}/manifests", recursive=True)
        out, slide, n, want, torn, place = None, None, 0, 0, "", ""

        def close() -> pa.RecordBatch:
            if n != want:
                raise OSError(f"{slide}: {n} patches were saved, not {want}")
            out.write(f"{parts.manifest_line('Disk file count:', n)}\n".encode())
            out.close()
            system.move(torn, place)
            return pa.RecordBatch.from_arrays([pa.array([slide], pa.string()), pa.array([place], pa.string()), pa.array([n], pa.int64())], names=["slide_id", "manifest", "n_files"])

        import json

        import pyarrow.fs as pafs

        for batch in batches:
            for key, line, kind in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if out is not None:
                        yield close()
                    by_label = json.loads(line)
                    slide, n, want = key, 0, sum(by_label.values())
                    place = f"{base}/manifests/manifest__{manifest_id}__{slide}"
                    if system.get_file_info(place).type != pafs.FileType.NotFound:
                        raise OSError(f'{slide}: manifest file "{place}" already exists')
                    torn = f"{place}.{uuid.uuid4().hex}"
                    out = system.open_output_stream(torn)
                    out.write("".join(f"{h}\n" for h in parts.manifest_header(manifest_id, place, counts=by_label, **fixed)).encode())
                else:
                    out.write(f"{parts.manifest_line('', line)}\n".encode())
                    there, where = split_uri(line)
                    n += there.get_file_info(where).type == pafs.FileType.File
        if out is not None:
            yield close()

    return lines.select("slide_id", "line", "_k").repartition("slide_id").sortWithinPartitions("slide_id", "_k", "line").mapInArrow(run, _MANIFESTS)


def extract(
    patches: DataFrame, tiles: DataFrame, levels: DataFrame, folder: str, manifest_id: str, *, level: int | None = 0, mpp: float | None = None, image_type: str = "png", by_label: bool = False, comment: str = "", separator: str = "_",
    patch_class: str = "", patch_params: Mapping = {}, **reading,
) -> DataFrame:
    """Write the images of ``patches`` (patch_id unique, slide_id, x, y, w, h,
    label) at a level or an mpp, and the manifests; what ``write_manifests`` gives.
    ``reading``: options of ``pixels.read_regions``."""
    named = parts.with_paths(patches.withColumnRenamed("patch_id", "region_id"), folder, F.lit(manifest_id), by_label=by_label, comment=comment, separator=separator, image_type=image_type)
    saved = _save(named, _requests(named, F.lit(None if mpp is not None else level), F.lit(mpp)), tiles, levels, image_type, reading)
    labels = patches.groupBy("slide_id", "label").agg(F.count(F.lit(1)).alias("n"))
    header = {"patch_class": patch_class, "patch_params": dict(patch_params), "extractor": "extract", "extractor_params": {"level": level, "mpp": mpp, "image_type": image_type, "by_label": by_label, "comment": comment, "separator": separator, **reading}}
    return written(write_manifests(saved, labels, folder, manifest_id, header), "manifests")[0]


def set_members(patches: DataFrame, levels: DataFrame, targets: Sequence[int | float], base: int | float, *, per_slide: bool = False, start: int = 1) -> DataFrame:
    """The members of each patch's set, one at each target: slide_id, label,
    ``set_number``, ``member``, ``region_id``, x, y at level 0, w, h,
    target_level, target_mpp. ``patches`` has patch_id, by which sets are numbered."""
    own = patches.withColumnRenamed("patch_id", "seq")
    numbered = numbers.set_numbers(own, start=start, per_slide=per_slide)
    m = pyramid.multires_patches(numbered, levels, targets, base)
    unique = F.col("seq") * len(targets) + F.col("member")
    return m.select("slide_id", "label", "set_number", "member", unique.alias("region_id"), F.col("target_x").cast("int").alias("x"), F.col("target_y").cast("int").alias("y"), "w", "h", "target_level", "target_mpp")


def extract_sets(
    patches: DataFrame, tiles: DataFrame, levels: DataFrame, folder: str, manifest_id: str, targets: Sequence[int | float], base: int | float = 0, *, per_slide: bool = False, start: int = 1, image_type: str = "png", by_label: bool = False, comment: str = "", separator: str = "_",
    patch_class: str = "", patch_params: Mapping = {}, **reading,
) -> DataFrame:
    """As ``extract``, with an image for each target of each patch, in a folder a set."""
    members = set_members(patches, levels, targets, base, per_slide=per_slide, start=start)
    set_dir = parts.set_folder(F.col("set_number"), F.col("slide_id") if per_slide else None)
    note = parts.member_comment(F.col("target_level"), F.col("target_mpp"), comment, separator)
    named = parts.with_paths(members, folder, F.lit(manifest_id), by_label=by_label, comment=note, separator=separator, image_type=image_type, set_dir=set_dir)
    level = F.when(F.col("target_mpp").isNull(), F.col("target_level"))
    saved = _save(named, _requests(named, level, F.col("target_mpp")), tiles, levels, image_type, reading)
    labels = members.groupBy("slide_id", "label").agg(F.count(F.lit(1)).alias("n"))
    header = {"patch_class": patch_class, "patch_params": dict(patch_params), "extractor": "extract_sets", "extractor_params": {"targets": list(targets), "base": base, "image_type": image_type, "by_label": by_label, "comment": comment, "separator": separator, **reading}}
    return written(write_manifests(saved, labels, folder, manifest_id, header), "manifests")[0]


def region_sets(members: DataFrame, tiles: DataFrame, levels: DataFrame, **reading) -> DataFrame:
    """(slide_id, set_number, label, images): the images of each set's members
    in their order, a struct (member, width, height, n_channels, data) each. A
    set has as many as there are targets."""
    images = pixels.read_regions(_requests(members, F.when(F.col("target_mpp").isNull(), F.col("target_level")), F.col("target_mpp")), tiles, levels, **reading)
    named = images.join(members.select("region_id", "slide_id", "set_number", "member", "label"), "region_id")
    one = F.struct("member", "width", "height", "n_channels", "data")
    return named.groupBy("slide_id", "set_number", "label").agg(F.array_sort(F.collect_list(one)).alias("images"))


def tensor_sets(sets: DataFrame) -> DataFrame:
    """``region_sets`` with ``tensors`` (shape, values 0 to 1, channels first) in place of the images."""
    kind = T.ArrayType(T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("tensor", T.ArrayType(T.FloatType()))]))

    @F.arrow_udf(kind)
    def to_tensors(images: pa.Array) -> pa.Array:
        import numpy as np

        def one(i: dict) -> dict:
            a = np.frombuffer(i["data"], np.uint8).reshape(i["height"], i["width"], i["n_channels"]).transpose(2, 0, 1).astype(np.float32) / 255
            return {"shape": list(a.shape), "tensor": a.ravel()}

        return pa.array([[one(i) for i in images_of] for images_of in images.to_pylist()], pa.list_(pa.struct([("shape", pa.list_(pa.int32())), ("tensor", pa.list_(pa.float32()))])))

    return sets.select("slide_id", "set_number", "label", to_tensors("images").alias("tensors"))
