"""Tables of patches: counts, checks, numbers and sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.functions.scalars import label_filter
from pathloom.runtime import written


def label_counts(patches: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, n) of every label of ``labels``, zero where it has no patch; a
    null label counts as one."""
    every = labels.select("label").distinct()
    n = patches.groupBy(F.col("label").alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    return every.join(n, F.col("label").eqNullSafe(F.col("_l")), "left").select("label", F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def count_map(counts: DataFrame) -> DataFrame:
    """One row: the counts as a map, labels in order; null labels as ""."""
    pairs = F.array_sort(F.collect_list(F.struct(F.coalesce("label", F.lit("")).alias("label"), "n")))
    return counts.agg(F.map_from_entries(pairs).alias("patch_info"))


def pool_counts(patches: DataFrame) -> DataFrame:
    """Counts by slide and label, by slide, by label and of all, in one pass:
    slide_id, label, n, and ``by_slide`` and ``by_label`` for which view a row is of."""
    g = patches.groupingSets([["slide_id", "label"], ["slide_id"], ["label"], []], "slide_id", "label")
    return g.agg(F.count(F.lit(1)).alias("n"), (1 - F.grouping("slide_id")).cast("int").alias("by_slide"), (1 - F.grouping("label")).cast("int").alias("by_label"))


def distinct_labels(patches: DataFrame) -> DataFrame:
    return patches.select("label").distinct()


def with_labels(patches: DataFrame, included: Sequence[str] = (), excluded: Sequence[str] = ()) -> DataFrame:
    return patches.filter(label_filter(F.col("label"), included, excluded))


def problems(patches: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """What is wrong with given patches: (slide_id, problem, detail, n) for
    places that come twice on a slide and for labels that aren't in ``labels``."""
    twice = patches.groupBy("slide_id", "x", "y").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = twice.select("slide_id", F.lit("duplicate location").alias("problem"), F.concat_ws(",", "x", "y").alias("detail"), "n")
    if labels is not None:
        known = labels.select(F.col("label").alias("_l")).distinct()
        odd = patches.join(known, F.col("label").eqNullSafe(F.col("_l")), "left_anti").groupBy("slide_id", "label").agg(F.count(F.lit(1)).alias("n"))
        found = found.unionByName(odd.select("slide_id", F.lit("unknown label").alias("problem"), F.col("label").alias("detail"), "n"))
    return found


def numbered(rows: DataFrame, order: str, *, group: str | None = None, start: int = 0, name: str = "number") -> DataFrame:
    """``rows`` with a running number by the column ``order``, from ``start``,
    over all or from anew in each ``group``.

    Rows are cut into ranges of the order column of about equal size and written
    with their range; each range is numbered by itself and moved by the count of
    those before it. Only the ranges' counts are ordered in one place, a row a
    range (and group). A large group is spread over the ranges like any other
    rows.
    """
    keys = [group] if group else []
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = written(rows.repartitionByRange(n, order).withColumn("_range", F.spark_partition_id()), "ranges")[0]
    counts = cut.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c").withColumnsRenamed({k: f"_{k}" for k in keys} | {"_range": "_r"})
    match = F.col("_range") == F.col("_r")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order)) - 1
    inside = cut.withColumn("_own", own).join(offsets, match)
    return inside.withColumn(name, F.col("_own") + F.col("_off") + start).drop("_own", "_off", "_range", "_r", *[f"_{k}" for k in keys])


def set_numbers(patches: DataFrame, *, start: int = 1, per_slide: bool = False, reserved: DataFrame | None = None) -> DataFrame:
    """Patch-set numbers in order of ``seq``: over all slides one after the
    other, or from ``start`` in each slide. ``reserved`` (slide_id, n) sets aside
    n numbers for a slide whatever it has, so numbers have gaps."""
    by_slide = numbered(patches, "seq", group="slide_id", start=start, name="set_number")
    if per_slide:
        return by_slide
    room = patches.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n")) if reserved is None else reserved.select("slide_id", "n")
    before = Window.orderBy("slide_id").rowsBetween(Window.unboundedPreceding, -1)  # one row a slide
    offset = room.withColumn("_off", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("slide_id").alias("_s"), "_off")
    return by_slide.join(offset, F.col("slide_id") == F.col("_s")).withColumn("set_number", F.col("set_number") + F.col("_off")).drop("_s", "_off")


def set_count(patch_count: Column, targets: int) -> Column:
    """Sets of so many patches; a remainder is an error."""
    return F.when(patch_count % targets != 0, F.raise_error(F.lit("patch count is no multiple of the targets"))).otherwise((patch_count / targets).cast("long"))
