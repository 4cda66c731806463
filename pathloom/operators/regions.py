"""Regions to sample from: whole masks, annotation polygons, or all but these.

A region is a row: slide_id, region_id, label, ``parts`` (exterior and holes,
in mask cells) and the slide's ``mask_factor``. Relations between polygons of a
slide come from a hierarchical grid join of their boxes, so a slide with very
many polygons never pairs all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions import planar
from pathloom.functions.geometry import box_ring, scaled
from pathloom.functions.scalars import label_filter, only_one_of
from pathloom.operators.masks import bounding_boxes
from pathloom.operators.skew import HOT_ROWS, salted_join
from pathloom.runtime import cut_lineage, discard, written

RING = "array<struct<x:double,y:double>>"
PARTS = f"array<struct<ext:{RING},holes:array<{RING}>>>"
_ARROW_RING = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
_ARROW_PARTS = pa.list_(pa.struct([("ext", _ARROW_RING), ("holes", pa.list_(_ARROW_RING))]))
_MAX_LEVEL = 40


def whole_mask_regions(cells: DataFrame, label: str = "") -> DataFrame:
    """A slide's foreground box, one cell past its last ones, as one region."""
    b = bounding_boxes(cells)
    ring = box_ring(F.col("x1"), F.col("y1"), F.col("x2") + 1, F.col("y2") + 1)
    none = F.array().cast(f"array<{RING}>")
    return b.select("slide_id", F.lit(0).cast("long").alias("region_id"), F.lit(label).alias("label"), F.array(F.struct(ring.alias("ext"), none.alias("holes"))).alias("parts"))


def polygon_regions(polygons: DataFrame, *, included: Sequence[str] = (), excluded: Sequence[str] = (), factor: str | None = None) -> DataFrame:
    """Polygons (slide_id, polygon_id, label, points, holes) as regions of one
    raw part, divided by the column ``factor`` if named. Labels are filtered
    first. Polygons without slide, id or three points are left out."""
    p = polygons.filter(label_filter(F.col("label"), included, excluded)).filter(F.col("slide_id").isNotNull() & F.col("polygon_id").isNotNull())
    clean = lambda r: F.filter(r, lambda v: v["x"].isNotNull() & v["y"].isNotNull())
    by = F.col(factor) if factor else F.lit(1.0)
    holes = F.transform(F.filter(F.coalesce("holes", F.array()), lambda h: h.isNotNull()), clean)
    ext = clean(F.col("points"))
    part = F.struct(scaled(ext, by).alias("ext"), F.transform(holes, lambda h: scaled(h, by)).alias("holes"))
    return p.filter(F.size(ext) >= 3).select("slide_id", F.col("polygon_id").alias("region_id"), "label", F.array(part).alias("parts"))


def _to_polygon(parts) -> planar.Polygon:
    ring = lambda r: planar.as_ring([(p["x"], p["y"]) for p in r])
    return [(ring(p["ext"]), [ring(h) for h in p["holes"]]) for p in parts]


def _from_polygon(polygon: planar.Polygon) -> list[dict]:
    ring = lambda r: [{"x": float(x), "y": float(y)} for x, y in r]
    return [{"ext": ring(e), "holes": [ring(h) for h in holes]} for e, holes in polygon]


def repaired_regions(regions: DataFrame, *, buffer: float | str = 0.0, empty: str = "error") -> DataFrame:
    """Regions with valid parts (self-crossings resolved by even-odd), then
    grown or shrunk by ``buffer``, a number or the name of a column. A region
    without area is an error, or with ``empty="drop"`` left out."""
    if empty not in ("error", "drop"):
        raise ValueError('empty is "error" or "drop"')
    grown = F.col(buffer) if isinstance(buffer, str) else F.lit(float(buffer))

    @F.arrow_udf(PARTS)
    def repair(parts: pa.Array, distance: pa.Array) -> pa.Array:
        out = []
        for p, d in zip(parts.to_pylist(), distance.to_pylist()):
            whole: planar.Polygon = []
            for e, holes in _to_polygon(p):
                whole += planar.make_valid(e, holes)
            whole = planar.buffer(whole, d)
            area = planar.polygon_area(whole)
            if not area and empty == "error":
                raise ValueError("polygon is empty: use a larger mask or buffer, or leave it out")
            out.append(_from_polygon(whole) if area else [])
        return pa.array(out, _ARROW_PARTS)

    # Few bytes, much work: the regions are dealt to all tasks first.
    n = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = regions.repartition(n, "slide_id", "region_id").withColumn("parts", repair("parts", grown))
    return out.filter(F.size("parts") > 0) if empty == "drop" else out


def close_pairs(regions: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(slide_id, a, b, parts_a, parts_b), a < b: regions of a slide whose boxes
    share area. Each region is in at most four cells of its level and probes
    those of the same or a higher level; a pair is kept only in the cell of its
    boxes' common corner, so it comes once.
    """
    ends = F.transform("parts", lambda p: F.struct(F.array_min(p["ext"]["x"]).alias("x1"), F.array_min(p["ext"]["y"]).alias("y1"), F.array_max(p["ext"]["x"]).alias("x2"), F.array_max(p["ext"]["y"]).alias("y2")))
    boxed = regions.filter(F.size("parts") > 0).withColumn("e", ends).select("slide_id", F.col("region_id").alias("id"), "parts", *[f(F.col("e")[c]).alias(c) for c, f in (("x1", F.array_min), ("y1", F.array_min), ("x2", F.array_max), ("y2", F.array_max))])
    extent = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(1.0))
    boxed = boxed.withColumn("level", F.least(F.lit(_MAX_LEVEL), F.ceil(F.log2(extent))).cast("int"))
    levels = sorted(r[0] for r in boxed.select("level").distinct().collect())  # a few integers
    side = F.pow(F.lit(2.0), F.col("cell_level"))
    cells = lambda df: df.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x1") / side), F.floor(F.col("x2") / side)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("y1") / side), F.floor(F.col("y2") / side))))
    held = cells(boxed.withColumn("cell_level", F.col("level")))
    upward = F.filter(F.array(*[F.lit(v) for v in levels]).cast("array<int>"), lambda v: v >= F.col("level"))
    probes = cells(boxed.withColumn("cell_level", F.explode(upward)))
    on = ["slide_id", "cell_level", "cx", "cy"]
    other = held.select(*on, *[F.col(c).alias(f"o_{c}") for c in ("id", "parts", "x1", "y1", "x2", "y2", "level")])
    p = salted_join(probes, other, on, spread_by=["id"], hot_rows=hot_rows)
    corner_x, corner_y = F.greatest("x1", "o_x1"), F.greatest("y1", "o_y1")
    meet = (F.col("x1") < F.col("o_x2")) & (F.col("o_x1") < F.col("x2")) & (F.col("y1") < F.col("o_y2")) & (F.col("o_y1") < F.col("y2"))
    here = (F.floor(corner_x / side) == F.col("cx")) & (F.floor(corner_y / side) == F.col("cy"))
    once = (F.col("level") < F.col("o_level")) | ((F.col("level") == F.col("o_level")) & (F.col("id") < F.col("o_id")))
    p = p.filter(meet & here & once)
    first = F.col("id") < F.col("o_id")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return p.select("slide_id", pick("id", "o_id").alias("a"), pick("o_id", "id").alias("b"), pick("parts", "o_parts").alias("parts_a"), pick("o_parts", "parts").alias("parts_b"))


def region_relations(regions: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(slide_id, a, b, relation, shared): for each pair a < b of a slide that
    shares area, whether a's exterior contains b's, lies within it, or overlaps
    it, and the shared area of the exteriors. ``regions`` must be repaired."""
    @F.arrow_udf("struct<relation:string,shared:double>")
    def relate(a: pa.Array, b: pa.Array) -> pa.Array:
        found = [planar.relation(_to_polygon(x), _to_polygon(y)) for x, y in zip(a.to_pylist(), b.to_pylist())]
        return pa.array([{"relation": r, "shared": v} for r, v in found], pa.struct([("relation", pa.string()), ("shared", pa.float64())]))

    pairs = close_pairs(cut_lineage(regions), hot_rows=hot_rows).withColumn("r", relate("parts_a", "parts_b"))  # the repair isn't repeated for each use
    return pairs.select("slide_id", "a", "b", "r.relation", "r.shared").filter(F.col("relation") != "apart")


def overlap_report(relations: DataFrame, patch_area: float, threshold: float = 1.0) -> DataFrame:
    """Overlapping pairs whose shared area is at least ``threshold`` patches."""
    return relations.filter(F.col("relation") == "overlaps").withColumn("patches", F.bround(F.col("shared") / patch_area, 10)).filter(F.col("patches") >= threshold).select("slide_id", "a", "b", "patches")


def nested_regions(regions: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Regions in which the exteriors of contained regions are holes, merged
    with the region's own; a region inside a contained one adds nothing and is
    skipped. ``regions`` must be repaired."""
    regions = cut_lineage(regions)
    rel = cut_lineage(region_relations(regions, hot_rows=hot_rows))
    inner = rel.filter("relation = 'contains'").select("slide_id", F.col("a").alias("outer_id"), F.col("b").alias("inner_id")).unionByName(
        rel.filter("relation = 'within'").select("slide_id", F.col("b").alias("outer_id"), F.col("a").alias("inner_id"))
    )
    up = inner.select(F.col("slide_id").alias("s1"), F.col("outer_id").alias("o1"), F.col("inner_id").alias("m"))
    down = inner.select(F.col("slide_id").alias("s2"), F.col("outer_id").alias("m2"), F.col("inner_id").alias("i2"))
    deeper = up.join(down, (F.col("s1") == F.col("s2")) & (F.col("m") == F.col("m2"))).select(F.col("s1").alias("slide_id"), F.col("o1").alias("outer_id"), F.col("i2").alias("inner_id")).distinct()
    direct = inner.join(deeper, ["slide_id", "outer_id", "inner_id"], "left_anti")
    held = direct.join(regions.select("slide_id", F.col("region_id").alias("inner_id"), F.col("parts").alias("inner_parts")), ["slide_id", "inner_id"])
    lists = held.groupBy("slide_id", F.col("outer_id").alias("region_id")).agg(F.collect_list("inner_parts").alias("inner"))

    @F.arrow_udf(PARTS)
    def cut(parts: pa.Array, inside: pa.Array) -> pa.Array:
        return pa.array([_from_polygon(planar.with_holes(_to_polygon(p), [_to_polygon(q) for q in many])) for p, many in zip(parts.to_pylist(), inside.to_pylist())], _ARROW_PARTS)

    joined = regions.join(lists, ["slide_id", "region_id"], "left")
    plain = joined.filter(F.col("inner").isNull()).drop("inner")
    return plain.unionByName(joined.filter(F.col("inner").isNotNull()).withColumn("parts", cut("parts", "inner")).drop("inner"))


def inverted_regions(cells: DataFrame, polygons: DataFrame, *, label: str = "", included: Sequence[str] = (), excluded: Sequence[str] = (), factor: str | None = None) -> DataFrame:
    """A slide's foreground box with the union of its polygons as holes. The
    labels choose which polygons are holes; what their union encloses belongs
    to the hole. One row a slide."""
    only_one_of(included, excluded)
    regions = polygon_regions(polygons, included=included, excluded=excluded, factor=factor)
    ring = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
    schema = T.StructType([T.StructField("slide_id", polygons.schema["slide_id"].dataType), T.StructField("outlines", T.ArrayType(ring))])

    def merge(held: pa.Table) -> pa.Table:
        valid = [planar.make_valid(e, holes) for parts in held["parts"].to_pylist() for e, holes in _to_polygon(parts)]
        rings = [r["ext"] for r in _from_polygon(planar.union(valid))]
        return pa.table({"slide_id": held["slide_id"].slice(0, 1), "outlines": pa.array([rings], pa.list_(_ARROW_RING))})

    # Few bytes, much work: the clusters are dealt to all tasks, and merged once however often the regions are used.
    n = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clusters = _touching(regions).select("slide_id", "cluster", "parts").repartition(n, "slide_id", "cluster")
    merged = clusters.groupBy("slide_id", "cluster").applyInArrow(merge, schema).groupBy("slide_id").agg(F.flatten(F.collect_list("outlines")).alias("outlines"))
    merged = cut_lineage(merged)
    return (
        whole_mask_regions(cells, label).join(merged, "slide_id", "left")
        .withColumn("parts", F.transform("parts", lambda p: F.struct(p["ext"].alias("ext"), F.coalesce(F.col("outlines"), p["holes"]).alias("holes"))))
        .drop("outlines")
    )


def _touching(regions: DataFrame) -> DataFrame:
    """Regions with the smallest region of those that they touch, by their
    boxes, directly or over others: a cluster is merged in one task, far ones in
    others. Each round takes the least of the neighbours' clusters and then that
    cluster's own cluster, so a chain halves with every round."""
    pairs = close_pairs(regions).select("slide_id", "a", "b")
    step = regions.select("slide_id", "region_id", "parts")
    both = cut_lineage(pairs.select("slide_id", F.col("a").alias("region_id"), F.col("b").alias("o")).unionByName(pairs.select("slide_id", F.col("b").alias("region_id"), F.col("a").alias("o"))))
    ids = both.select("slide_id", "region_id").distinct().withColumn("cluster", F.col("region_id"))
    ids, path, _ = written(ids, "touching")
    while True:
        near = both.join(ids.select("slide_id", F.col("region_id").alias("o"), F.col("cluster").alias("oc")), ["slide_id", "o"]).groupBy("slide_id", "region_id").agg(F.min("oc").alias("oc"))
        least = ids.join(near, ["slide_id", "region_id"]).select("slide_id", "region_id", F.col("cluster").alias("old"), F.least("cluster", "oc").alias("cluster"))
        root = ids.select("slide_id", F.col("region_id").alias("cluster"), F.col("cluster").alias("root"))
        jumped = least.join(root, ["slide_id", "cluster"]).select("slide_id", "region_id", F.least("cluster", "root").alias("cluster"), "old")
        last = path
        new, path, seen = written(jumped, "touching", moved=F.count_if(F.col("cluster") != F.col("old")))
        ids = new.drop("old")
        discard(regions.sparkSession, last)
        if not seen["moved"]:
            named = step.join(ids, ["slide_id", "region_id"], "left")
            return named.withColumn("cluster", F.coalesce("cluster", "region_id"))
