"""The pN_ queries of the core problems over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators import bundles, nested, proximity, quarantine, skew
from pathloom.runtime import cut_lineage, shared_folder, table

#: Pixels within which a location is near a region's edge.
REACH = 32.0
REPEAT_KEY = ["wsi_file", "x", "y", "w", "h", "label"]


def _p1_tables(spark: SparkSession, sf_dir: str, names: list[str], attributes: bool) -> dict[str, DataFrame]:
    """The named tables of the sessions' planned schema."""
    sessions = table(spark, sf_dir, "annotation_sessions")
    g = nested.SESSION_GRAMMAR
    plan = nested.inline_plan(nested.schema_graph(sessions, g, body_col="body", root="session"), keep=names)
    needed = set(names) | {e for e, p in plan.items() if p["why"] == "inlined" and p["kind"] == "element" and p["table"] in names and attributes}
    if not attributes:
        plan = {e: p | {"columns": []} for e, p in plan.items() if p["why"] != "inlined"}
    rows = nested.shred(sessions, g, id_col="session_id", body_col="body", root="session", only=sorted(needed), attributes=attributes)
    made = nested.tables(rows, plan, g, id_col="session_id", only=names)
    empty = rows.limit(0)
    return {n: made.get(n, empty) for n in names}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertex table's keys."""
    vertex = _p1_tables(spark, sf_dir, ["vertex"], attributes=False)["vertex"]
    return vertex.select("session_id", "object_no", "ring_no", "vertex_no").distinct()


def p1_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the object, ring and vertex tables with their keys and, of a vertex, its place."""
    made = _p1_tables(spark, sf_dir, ["object", "ring", "vertex"], attributes=True)
    keys = ["session_id", "object_no", "parent_object_no", "ring_no", "vertex_no", "x", "y"]

    def keyed(name: str, **of) -> DataFrame:
        t = made[name]
        have = {c: F.col(c) for c in keys if c in t.columns} | of
        number = lambda c: F.replace(have[c], F.lit(","), F.lit(".")).try_cast("double")
        value = lambda c: F.lit(None) if c not in have else number(c) if c in ("x", "y") else have[c]
        types = {"session_id": "long", "x": "double", "y": "double"}
        return t.select(F.lit(name).alias("in_table"), *[value(c).cast(types.get(c, "int")).alias(c) for c in keys])

    parts = keyed("object"), keyed("ring", vertex_no=F.lit(None)), keyed("vertex")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.later_repeats(table(spark, sf_dir, "patches"), REPEAT_KEY, "patch_id", required=["wsi_file"])


def p2_label_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches that meet the regions of their slide and label, and the pixels read for them."""
    patches = table(spark, sf_dir, "patches").select("wsi_file", "label", (F.col("w").cast("long") * F.col("h")).alias("pixels"))
    regions = table(spark, sf_dir, "polygons").select("wsi_file", "label", F.coalesce(F.size("points"), F.lit(0)).cast("long").alias("vertices"))
    return skew.eager_join_aggregate(patches, regions, ["wsi_file", "label"], left_sums=["pixels"], right_sums=["vertices"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity.regions_in_reach(table(spark, sf_dir, "points"), table(spark, sf_dir, "polygons"), REACH)


def p5_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine.parse_lines(table(spark, sf_dir, "annotation_lines"), quarantine.ANNOTATION_FORMATS)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_parsed(spark, sf_dir).filter(F.col("reason").isNotNull()).select("line_id", "reason").distinct()


def p5_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quarantine.annotations_from_lines(p5_parsed(spark, sf_dir))
    return rows.select("line_id", "vendor", "wsi_file", "ann_type", "ann_name", "group_text", F.size("coordinates").alias("n_points"))


def _p7_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of the containers that hold each file once, by path: planned
    from the manifest, written as directories, read back and verified."""
    manifest = table(spark, sf_dir, "patch_file_list")
    files = bundles.current_files(manifest, keep=("patch_file", "checksum")).drop("file_key")
    listed = manifest.filter(F.col("n_bytes") > 0).agg(F.sum("n_bytes"), F.count(F.lit(1))).first()  # bounds: files listed again count again
    plan = bundles.plan_containers(files, key_col="patch_file", total=tuple(listed))
    folder = shared_folder(spark, "containers")
    columns = ["list_id", "patch_file", "n_bytes", "checksum"]
    boxes = cut_lineage(bundles.pack_directories(plan, folder, columns=columns, in_lanes=True))
    return bundles.read_index(boxes, folder, T.StructType([T.StructField(c, plan.schema[c].dataType) for c in ("byte_offset", "byte_length", *columns)]))


def p7_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7_members(spark, sf_dir).withColumn("file_key", bundles.file_key(F.col("patch_file"))).drop("container")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7_members(spark, sf_dir).select("list_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_tables, p2_found, p2_label_load, p4_found, p5_found, p5_valid, p7_found, p7_index)}
