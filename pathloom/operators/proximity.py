"""Points in, near or far from labelled regions: a hierarchical grid join.

Points and regions meet in grid cells whose side is a power of two times twice
the radius. A region uses the level at which its box, widened by the radius,
fits one cell side, so it covers at most four cells, however large it is; a
point has one cell at each level that some region uses. A bitmap of the cells
that regions cover, of a fixed size, goes to all tasks, so that only points in
such cells are shuffled. The equi-join on (group, level, cell) finds every pair
in reach; the box and then the exact geometry are verified inside the same
stage, in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.skew import HOT_ROWS, salted_join

#: Levels above this are clamped: a cell then covers 2**40 radii.
MAX_LEVEL = 40
#: Bits of the bitmap of covered cells: at most 2**18 rows of two numbers.
CELL_BITS = 1 << 24


def _clean(ring: Column) -> Column:
    return F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def _closed(ring: Column) -> Column:
    return F.concat(ring, F.slice(ring, 1, 1))


def _coordinate(rings: str, name: str) -> Column:
    return F.transform(rings, lambda ring: _closed(ring)[name])


def covered_cells(cells: DataFrame, *keys: Column, bits: int = CELL_BITS) -> DataFrame:
    """(_word, _mask): a bitmap of the hashes of the cells' keys."""
    at = F.pmod(F.xxhash64(*keys), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    return cells.groupBy(F.floor(at / 64).alias("_word")).agg(F.bit_or(one).alias("_mask"))


def in_covered(df: DataFrame, bitmap: DataFrame, *keys: Column, bits: int = CELL_BITS) -> DataFrame:
    """The rows whose cell may be covered: all that are, and few others."""
    at = F.pmod(F.xxhash64(*keys), F.lit(bits))
    near = df.withColumn("_at", at).join(F.broadcast(bitmap), F.floor(F.col("_at") / 64) == F.col("_word"))
    set_here = F.call_function("shiftrightunsigned", F.col("_mask"), (F.col("_at") % 64).cast("int")).bitwiseAND(1) == 1
    return near.filter(set_here).drop("_at", "_word", "_mask")


def _edges(xs: Column) -> Column:
    """The places in a closed ring's coordinates at which its edges begin."""
    return F.sequence(F.lit(0), F.size(xs) - 2)


def _near(xs: Column, ys: Column, x: Column, y: Column, radius: float) -> Column:
    """Whether the point is within the radius of an edge of a closed ring."""
    def close(i: Column) -> Column:
        x1, y1, x2, y2 = F.get(xs, i), F.get(ys, i), F.get(xs, i + 1), F.get(ys, i + 1)
        dx, dy = x2 - x1, y2 - y1
        length = dx * dx + dy * dy
        along = F.when(length > 0, ((x - x1) * dx + (y - y1) * dy) / length).otherwise(F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        ex, ey = x - (x1 + t * dx), y - (y1 + t * dy)
        # The edge's box, widened by the radius, drops most edges by a few comparisons.
        beside = (x >= F.least(x1, x2) - radius) & (x <= F.greatest(x1, x2) + radius)
        level = (y >= F.least(y1, y2) - radius) & (y <= F.greatest(y1, y2) + radius)
        return beside & level & (ex * ex + ey * ey <= radius * radius)

    return F.exists(_edges(xs), close)


def _inside(xs: Column, ys: Column, x: Column, y: Column) -> Column:
    """Even-odd, over the edges of a closed ring; most are dropped by their two heights."""
    def crosses(i: Column) -> Column:
        x1, y1, x2, y2 = F.get(xs, i), F.get(ys, i), F.get(xs, i + 1), F.get(ys, i + 1)
        return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)

    return F.size(F.filter(_edges(xs), crosses)) % 2 == 1


def regions_in_reach(
    points: DataFrame,
    polygons: DataFrame,
    radius: float,
    *,
    group: str = "slide_id",
    point_id: str = "point_id",
    polygon_id: str = "polygon_id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(point_id, polygon_id), distinct, of each point and region of the same
    group where the point is inside the exterior ring and inside no hole
    (even-odd), or at most ``radius`` from an edge of any ring.

    ``points``: point_id, group, x, y. ``polygons``: polygon_id, group, points,
    holes. Rings are taken as closed. Rows with a null group, id or coordinate,
    and regions with fewer than three points, take no part; null or empty holes
    are no holes; repeated rows count once; other columns are ignored.
    """
    if radius <= 0:
        raise ValueError("radius must be positive")
    base = 2.0 * radius
    shapes = (
        polygons.select(F.col(polygon_id).alias("polygon_id"), F.col(group).alias("grp"), _clean(F.col("points")).alias("ext"), "holes")
        .filter(F.col("polygon_id").isNotNull() & F.col("grp").isNotNull() & (F.size("ext") >= 3))
        .withColumn("holes", F.filter(F.transform(F.filter(F.coalesce("holes", F.array()), lambda h: h.isNotNull()), _clean), lambda h: F.size(h) > 0))
        .withColumn("all", F.concat(F.col("ext"), F.flatten("holes")))
        .select(
            "polygon_id",
            "grp",
            *[_closed(F.col("ext"))[c].alias(f"e{c}") for c in "xy"],
            *[_coordinate("holes", c).alias(f"h{c}") for c in "xy"],
            *[(F.array_min(F.col("all")[c]) - radius).alias(f"lo{c}") for c in "xy"],
            *[(F.array_max(F.col("all")[c]) + radius).alias(f"hi{c}") for c in "xy"],
        )
        .withColumn("extent", F.greatest(F.col("hix") - F.col("lox"), F.col("hiy") - F.col("loy")))
        .withColumn("level", F.least(F.lit(MAX_LEVEL), F.greatest(F.lit(0), F.ceil(F.log2(F.col("extent") / base)))).cast("int"))
    )
    levels = sorted(r[0] for r in shapes.select("level").distinct().collect())  # at most MAX_LEVEL + 1 integers
    side = F.lit(base) * F.pow(F.lit(2.0), F.col("level"))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / side), F.floor(F.col(hi) / side)))
    shapes = shapes.withColumn("cx", cells("lox", "hix")).withColumn("cy", cells("loy", "hiy")).drop("extent")
    key = ["grp", "level", "cx", "cy"]
    bitmap = covered_cells(shapes, *map(F.col, key))
    spots = (
        points.select(F.col(point_id).alias("point_id"), F.col(group).alias("grp"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
        .dropna()
        .withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
        .withColumn("cx", F.floor(F.col("px") / side))
        .withColumn("cy", F.floor(F.col("py") / side))
    )
    spots = in_covered(spots, bitmap, *map(F.col, key))
    x, y = F.col("px"), F.col("py")
    in_box = (x >= F.col("lox")) & (x <= F.col("hix")) & (y >= F.col("loy")) & (y <= F.col("hiy"))
    holes = F.sequence(F.lit(0), F.size("hx") - 1)
    of_hole = lambda test: (F.size("hx") > 0) & F.exists(holes, test)
    ex, ey = F.col("ex"), F.col("ey")
    reached = (
        (_inside(ex, ey, x, y) & ~of_hole(lambda k: _inside(F.get("hx", k), F.get("hy", k), x, y)))
        | _near(ex, ey, x, y, radius)
        | of_hole(lambda k: _near(F.get("hx", k), F.get("hy", k), x, y, radius))
    )
    pairs = salted_join(spots, shapes, key, spread_by=["point_id"], hot_rows=hot_rows)
    return pairs.filter(in_box).filter(reached).select("point_id", "polygon_id").distinct()
