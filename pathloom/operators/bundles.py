"""Millions of tiny files into a few large archive containers.

``current_files`` reduces a manifest (a row each time a file was listed) to one
row a file. ``plan_containers`` gives each file its container, offset and
length. ``pack_containers`` writes the planned containers: the original bytes
one after another, then the container's directory (a row a member with offset,
length and checksum) and a footer that locates and checks it. Bytes that differ
from the manifest in length or checksum are an error. ``pack_directories``
writes the directories alone, where a manifest is at hand and the files aren't.
``read_index`` reads directories back and verifies them; ``read_member`` and
``unpack`` get single files or all of them back.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pathloom.sources.files import split_uri
from pyspark.sql.window import Window

TARGET_BYTES = 128 * 1024 * 1024
#: Files that one window partition orders at most, about.
LANE_FILES = 100_000
_MAGIC = b"PLBOX001"
_FOOTER = "<QQI8s"  # directory's offset, length and CRC-32, magic


def file_key(path: Column) -> Column:
    """The last path component in lower case; "/" and "\\" both separate."""
    return F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))


def current_files(manifest: DataFrame, *, keep: Sequence[str] = (), id_col: str = "list_id", path_col: str = "patch_file", bytes_col: str = "n_bytes") -> DataFrame:
    """One row a file: ``file_key``, the id, bytes and ``keep`` columns of the
    listed row that stands for it, the one with the smallest id of those with
    bytes.

    Rows with null or no bytes, a null path, an empty last component or a null
    id stand for no file. The reduction is a map-side combined minimum, so a
    file listed a million times leaves each task once.
    """
    listed = manifest.filter((F.col(bytes_col) > 0) & F.col(path_col).isNotNull() & F.col(id_col).isNotNull())
    keyed = listed.select(file_key(F.col(path_col)).alias("_key"), *[F.col(c).alias(f"_{i}") for i, c in enumerate([id_col, bytes_col, *keep])]).filter(F.col("_key") != "")
    rest = [F.min_by(f"_{i}", "_0").alias(c) for i, c in enumerate([bytes_col, *keep], 1)]
    return keyed.groupBy(F.col("_key").alias("file_key")).agg(F.min("_0").alias(id_col), *rest)


def plan_containers(files: DataFrame, *, key_col: str = "file_key", bytes_col: str = "n_bytes", target_bytes: int = TARGET_BYTES, total: tuple[int, int] | None = None) -> DataFrame:
    """``files`` with ``container_id``, ``byte_offset`` and ``byte_length``.

    Files are dealt by hash to so many lanes that a lane holds about 64
    containers' bytes, and no more than about LANE_FILES files; then they are
    cut along each lane's running sum: a container starts at each multiple of
    ``target_bytes``, so it is over the target by less than one file. Every lane
    is one bounded window partition, and the plan depends on the files only, not
    on how they are partitioned. ``total``: their bytes and number, or bounds
    near them, where known; else they are counted first. Null bytes count as
    none.
    """
    n_bytes, n_files = total or files.agg(F.sum(F.col(bytes_col).cast("long")), F.count(F.lit(1))).first()
    lanes = max(1, -(-(n_bytes or 0) // (64 * target_bytes)), -(-n_files // LANE_FILES))
    lane = F.pmod(F.conv(F.substring(F.md5(F.col(key_col).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(lanes))
    along = Window.partitionBy("_lane").orderBy(key_col).rowsBetween(Window.unboundedPreceding, -1)
    length = F.coalesce(F.col(bytes_col).cast("long"), F.lit(0).cast("long"))
    return (
        files.withColumn("byte_length", length)
        .withColumn("_lane", lane)
        .withColumn("_before", F.coalesce(F.sum("byte_length").over(along), F.lit(0).cast("long")))
        .withColumn("_box", F.floor(F.col("_before") / target_bytes))
        .withColumn("byte_offset", F.col("_before") - F.first("_before").over(Window.partitionBy("_lane", "_box").orderBy("_before").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("container_id", F.concat(F.lit("c"), F.lpad(F.col("_lane").cast("string"), 8, "0"), F.lit("-"), F.lpad(F.col("_box").cast("string"), 4, "0")))
        .drop("_lane", "_box", "_before")
    )


#: One row a written container.
_BOXES = T.StructType(
    [
        T.StructField("container_id", T.StringType()),
        T.StructField("container", T.StringType()),
        T.StructField("n_files", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
    ]
)


def _read(path: str) -> bytes:
    system, place = split_uri(path)
    with system.open_input_file(place) as f:
        return f.read()


def _by_container(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that are sorted by container_id, a table a container."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("container_id")
        ends = pc.run_end_encode(ids).run_ends.to_pylist()
        for lo, hi in zip([0, *ends], ends):
            own = ids[lo].as_py()
            if held and own != name:
                yield pa.Table.from_batches(held)
                held = []
            name = own
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _write(planned: DataFrame, out_dir: str, columns: Sequence[str], in_lanes: bool, payload: Callable[[pa.Table], tuple[pa.Table, list[bytes]]]) -> DataFrame:
    """Containers of ``planned`` under ``out_dir``; ``payload`` gives a table's
    members and their bytes. A container that isn't whole in a partition leaves
    a part that doesn't begin at 0, which is an error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = split_uri(out_dir)
        system.create_dir(folder, recursive=True)
        for rows in _by_container(batches):
            own = rows["container_id"][0].as_py()
            members, blob = payload(rows)
            lengths = members["byte_length"].to_numpy()
            if (members["byte_offset"].to_numpy() != lengths.cumsum() - lengths).any():
                raise ValueError(f"container {own} isn't planned without gaps")
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, members.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(members)
            directory = sink.getvalue().to_pybytes()
            name = f"{own}-{zlib.crc32(directory):08x}.box"
            torn = f"{folder}/_{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(torn) as f:
                for data in blob:
                    f.write(data)
                f.write(directory)
                f.write(struct.pack(_FOOTER, sum(map(len, blob)), len(directory), zlib.crc32(directory), _MAGIC))
            system.move(torn, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([name]), pa.array([len(members)], pa.int64()), pa.array([int(lengths.sum())], pa.int64())], names=_BOXES.names)

    order = planned.select("container_id", "byte_offset", "byte_length", *columns)
    if not in_lanes:
        order = order.repartition("container_id")
    return order.sortWithinPartitions("container_id", "byte_offset", "byte_length").mapInArrow(run, _BOXES)


def pack_containers(planned: DataFrame, out_dir: str, *, checksum_col: str | None = None, columns: Sequence[str] = (), in_lanes: bool = False) -> DataFrame:
    """Write the files of ``planned`` (what ``plan_containers`` gives) into its
    containers under ``out_dir``, a folder or URI that all executors reach. One
    row a container: container_id, container (file name), n_files, n_bytes.

    ``planned`` has ``path``, and may have ``content``; without it the bytes are
    read from the path where they are packed, so that only paths are shuffled.
    A file whose length isn't the planned one, or whose CRC-32 isn't
    ``checksum_col`` (hexadecimal; null: none known), is an error, and so is a
    null path. ``columns`` go into the directory too. ``in_lanes``: ``planned``
    comes straight from ``plan_containers``, whose partitions hold whole
    containers, so that it isn't shuffled again.

    A container is named after the plan and its directory's checksum, and is
    written under another name until it is whole: a task that is run again
    writes the same bytes to the same name and leaves no orphan.
    """
    given = "content" in planned.columns
    extra = [*columns, *([checksum_col] if checksum_col and checksum_col not in columns else [])]

    def payload(rows: pa.Table) -> tuple[pa.Table, list[bytes]]:
        blob, sums = [], []
        stated = rows[checksum_col].to_pylist() if checksum_col else [None] * len(rows)
        for i, (path, length, known) in enumerate(zip(rows["path"].to_pylist(), rows["byte_length"].to_pylist(), stated)):
            if path is None:
                raise ValueError("a planned file has no path")
            data = rows["content"][i].as_py() if given else _read(path)
            if data is None or len(data) != length:
                raise ValueError(f"{path}: {'no' if data is None else len(data)} bytes, not {length}")
            sums.append(zlib.crc32(data))
            if known is not None and int(known, 16) != sums[-1]:
                raise ValueError(f"{path}: checksum differs from the manifest")
            blob.append(data)
        return rows.select(["path", "byte_offset", "byte_length", *columns]).append_column("crc32", pa.array(sums, pa.int64())), blob

    return _write(planned, out_dir, ["path", *["content"] * given, *extra], in_lanes, payload)


def pack_directories(planned: DataFrame, out_dir: str, *, columns: Sequence[str], in_lanes: bool = False) -> DataFrame:
    """As ``pack_containers``, but the directories alone: the planned offsets and
    lengths and the manifest's ``columns``, to be filled where the files are."""
    return _write(planned, out_dir, columns, in_lanes, lambda rows: (rows.select(["byte_offset", "byte_length", *columns]), []))


def read_index(boxes: DataFrame, out_dir: str, member: T.StructType) -> DataFrame:
    """The members of written containers (rows of ``pack_containers`` or
    ``pack_directories``): container_id, container, and the directory's columns
    as ``member`` has them. A directory that is torn, has another checksum, has
    gaps or overlaps, or other members than its container was given, is an error."""
    schema = T.StructType([*_BOXES.fields[:2], *member.fields])
    types = [to_arrow_type(f.dataType) for f in member.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = split_uri(out_dir)
        for batch in batches:
            for box in batch.to_pylist():
                rows = _directory(system, f"{folder}/{box['container']}")
                lengths = rows["byte_length"].to_numpy()
                if len(rows) != box["n_files"] or lengths.sum() != box["n_bytes"] or (rows["byte_offset"].to_numpy() != lengths.cumsum() - lengths).any():
                    raise ValueError(f"{box['container']}: its directory isn't what was packed")
                for part in rows.select(member.names).to_batches():
                    names = [pa.array([box[c]] * len(part), pa.string()) for c in schema.names[:2]]
                    yield pa.RecordBatch.from_arrays([*names, *[c.cast(t) for c, t in zip(part.columns, types)]], names=schema.names)

    return boxes.select(*_BOXES.names).mapInArrow(run, schema)


def _directory(system, place: str) -> pa.Table:
    with system.open_input_file(place) as f:
        size, tail = f.size(), struct.calcsize(_FOOTER)
        f.seek(max(0, size - tail))
        footer = f.read(tail)
        at, length, crc, magic = struct.unpack(_FOOTER, footer) if len(footer) == tail else (0, 0, 0, b"")
        if magic != _MAGIC or at + length + tail != size:
            raise ValueError(f"{place}: no whole container")
        f.seek(at)
        data = f.read(length)
    if zlib.crc32(data) != crc:
        raise ValueError(f"{place}: the directory's checksum differs")
    return pa.ipc.open_stream(data).read_all()


def read_member(out_dir: str, container: str, byte_offset: int, byte_length: int, crc32: int) -> bytes:
    """One file's bytes; ValueError where they don't have the checksum."""
    system, folder = split_uri(out_dir)
    with system.open_input_file(f"{folder}/{container}") as f:
        return _member(f, container, byte_offset, byte_length, crc32)


def _member(f, container: str, byte_offset: int, byte_length: int, crc32: int) -> bytes:
    f.seek(byte_offset)
    data = f.read(byte_length)
    if len(data) != byte_length or zlib.crc32(data) != crc32:
        raise ValueError(f"{container} at {byte_offset}: checksum differs")
    return data


def unpack(boxes: DataFrame, out_dir: str, *, out_bytes: int = 16 * 1024 * 1024) -> DataFrame:
    """(path, content) of every file of the containers, verified. A container is
    opened once and read from front to back, about ``out_bytes`` at a time."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = split_uri(out_dir)
        for batch in batches:
            for container in batch.column(0).to_pylist():
                rows = _directory(system, f"{folder}/{container}")
                with system.open_input_file(f"{folder}/{container}") as f:
                    paths, contents, size = [], [], 0
                    for row in rows.select(["path", "byte_offset", "byte_length", "crc32"]).to_pylist():
                        paths.append(row.pop("path"))
                        contents.append(_member(f, container, **row))
                        size += row["byte_length"]
                        if size >= out_bytes:
                            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], names=schema.names)
                            paths, contents, size = [], [], 0
                    if paths:
                        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], names=schema.names)

    return boxes.select("container").mapInArrow(run, schema)
