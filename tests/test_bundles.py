import os
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from pathloom.operators import bundles

MANIFEST = "list_id long, patch_file string, n_bytes int, checksum string, file_key string"


def test_current_files(spark):
    data = [
        (5, "out/A.PNG", 10, "c5", ""),
        (3, "x\\y\\a.png", 0, "c3", ""),
        (4, "./out//a.png", 7, None, ""),
        (9, "b.png", None, "c9", ""),
        (8, None, 5, "c8", ""),
        (7, "dir/", 5, "c7", ""),
        (None, "c.png", 5, "c", ""),
        (6, "d.png", 5, "c6", ""),
        (6, "d.png", 5, "c6", ""),
    ]
    df = spark.createDataFrame(data, MANIFEST)
    got = bundles.current_files(df, keep=["checksum"])
    assert rows(got.select("file_key", "list_id", "n_bytes", "checksum")) == [("a.png", 4, 7, None), ("d.png", 6, 5, "c6")]
    assert bundles.current_files(df.limit(0)).count() == 0


def test_containers_hold_each_file_once_and_are_full(spark):
    files = spark.range(2000).select(F.concat(F.lit("f"), "id").alias("file_key"), (F.col("id") % 97 + 1).cast("int").alias("n_bytes"))
    plan = bundles.plan_containers(files, target_bytes=1000).toPandas()
    assert len(plan) == 2000 and plan.file_key.nunique() == 2000
    for _, box in plan.sort_values("byte_offset").groupby("container_id"):
        assert (box.byte_offset.values == box.byte_length.cumsum().shift(fill_value=0).values).all()
        assert box.byte_length.sum() < 1000 + 97
    sizes = plan.groupby("container_id").byte_length.sum()
    assert (sizes > 900).sum() >= len(sizes) - 2 * (1 + plan.n_bytes.sum() // 64_000)
    assert bundles.plan_containers(files.limit(0)).count() == 0


def planned(spark, source, content, **k):
    df = spark.createDataFrame([(f"{'file:' if i % 2 else ''}{source}/{n}", len(d), f"{zlib.crc32(d):08x}" if i % 3 else None, "clash") for i, (n, d) in enumerate(content.items())], "path string, n_bytes int, checksum string, container string")
    return bundles.plan_containers(df, key_col="path", **k)


def test_pack_and_unpack_are_lossless(spark, tmp_path):
    source, boxes = tmp_path / "in", str(tmp_path / "boxes")
    source.mkdir()
    content = {f"p{i}.bin": os.urandom(i * 37 % 501) for i in range(60)}
    for name, data in content.items():
        (source / name).write_bytes(data)
    plan = planned(spark, source, content, target_bytes=4000)
    bundles.pack_containers(plan, boxes, checksum_col="checksum").write.parquet(str(tmp_path / "written"))
    written = spark.read.parquet(str(tmp_path / "written"))
    back = {os.path.basename(r.path): bytes(r.content) for r in bundles.unpack(written, boxes, out_bytes=1000).collect()}
    assert back == content
    names = sorted(os.listdir(boxes))
    assert 1 < len(names) < 10 and written.agg(F.sum("n_files")).first()[0] == 60
    bundles.pack_containers(plan, boxes, checksum_col="checksum").count()  # run again: the same names
    assert sorted(os.listdir(boxes)) == names
    index = bundles.read_index(written, boxes, T.StructType([T.StructField(n, t) for n, t in (("path", T.StringType()), ("byte_offset", T.LongType()), ("byte_length", T.LongType()), ("crc32", T.LongType()))]))
    assert index.count() == 60
    one = index.filter(F.col("path").endswith("p7.bin")).first()
    assert bundles.read_member(boxes, one.container, one.byte_offset, one.byte_length, one.crc32) == content["p7.bin"]
    with pytest.raises(ValueError):
        bundles.read_member(boxes, one.container, one.byte_offset, one.byte_length, one.crc32 ^ 1)
    given = spark.read.format("binaryFile").load(str(source)).select("path", "content", F.col("length").alias("n_bytes"))
    assert bundles.pack_containers(bundles.plan_containers(given, key_col="path"), str(tmp_path / "more")).first().n_files == 59  # binaryFile leaves out the empty one


def test_truncated_files_and_torn_containers_are_errors(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"12345")
    (tmp_path / "b").write_bytes(b"12345")
    for data in (b"1234567", b"54321"):
        with pytest.raises(Exception, match="not 7|differs"):
            bundles.pack_containers(planned(spark, tmp_path, {"a": b"12345", "b": data}), str(tmp_path / "x"), checksum_col="checksum").collect()
    boxes = str(tmp_path / "boxes")
    written = spark.createDataFrame(bundles.pack_containers(planned(spark, tmp_path, {"a": b"12345"}), boxes).collect())
    place = os.path.join(boxes, written.first().container)
    whole = open(place, "rb").read()
    for torn in (whole[:-1], whole[:9] + bytes([whole[9] ^ 1]) + whole[10:], b""):
        with open(place, "wb") as f:
            f.write(torn)
        with pytest.raises(Exception, match="container|checksum"):
            bundles.unpack(written, boxes).collect()


def test_directories_of_a_manifest(spark, tmp_path):
    files = spark.range(500).select(F.concat(F.lit("f"), "id").alias("file_key"), (F.col("id") % 97 + 1).cast("int").alias("n_bytes"), "id")
    plan = bundles.plan_containers(files, target_bytes=1000)
    written = spark.createDataFrame(bundles.pack_directories(plan, str(tmp_path), columns=["id"]).collect())
    member = T.StructType([T.StructField("byte_offset", T.LongType()), T.StructField("id", T.LongType())])
    got = bundles.read_index(written, str(tmp_path), member).select("container_id", "byte_offset", "id")
    assert rows(got) == rows(plan.select("container_id", "byte_offset", "id"))
    assert bundles.pack_directories(plan.limit(0), str(tmp_path), columns=["id"]).count() == 0
    wrong = written.withColumn("n_files", F.col("n_files") + 1)
    with pytest.raises(Exception, match="isn't what was packed"):
        bundles.read_index(wrong, str(tmp_path), member).collect()
