"""Patch locations: grid, random, Poisson-disk or given points, over any region.

Candidates are generated from a region's box by exploding sequences (or by a
numpy sampler, for Poisson disks), checked against the region's area and the
mask, brought to level 0 and made distinct. All slides go through one plan; the
overlap check keeps one row a candidate and needs no shuffle, and comes before
the foreground check, which does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.functions.geometry import boxed_edges, edges, polygon_window_area
from pathloom.functions.scalars import AREA_PLACES, fixed, whole
from pathloom.operators.masks import foreground_ratio
from pathloom.operators.proximity import covered_cells, in_covered
from pathloom.operators.skew import HOT_ROWS, salted_join
from pathloom.runtime import cut_lineage

MAX_STRIDE = 5
#: Attempts a random sampler has for each patch asked for.
ATTEMPTS = 100
#: Attempts for each patch after which the regions still short are looked for.
ROUNDS = (4, 8, 16, 32, 64)
# The pseudo-random recurrence, in whole numbers that SQL engines share.
_PRIME, _A, _B, _C = 2147483647, 7919, 104729, 48271


@dataclass(frozen=True)
class Patches:
    """size: pixels of a patch at the target; target_factor: the target's
    downsample; mask_factor: the mask's. Each may name a column of the regions."""

    size: int
    mask_factor: float | str = 1.0
    target_factor: float | str = 1.0
    foreground_ratio: float | str = 1.0
    overlap_ratio: float | str = 1.0

    def column(self, name: str) -> Column:
        value = getattr(self, name)
        return F.col(value).cast("double") if isinstance(value, str) else F.lit(float(value))

    @property
    def relative(self) -> Column:
        return self.column("mask_factor") / self.column("target_factor")

    @property
    def mask_size(self) -> Column:
        return F.lit(float(self.size)) / self.relative


def _spread(regions: DataFrame) -> DataFrame:
    """Regions over all tasks, before each becomes many candidates: their bytes
    say nothing of the work that follows."""
    n = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return regions.repartition(n, "slide_id", "region_id")


def _box(regions: DataFrame) -> DataFrame:
    """Regions with their rounded box, and ``shape``: the parts as edges, made
    once a region and not once a candidate."""
    ends = lambda c, f: f(F.transform("parts", lambda p: f(p["ext"][c])))
    shape = F.transform("parts", lambda p: F.struct(edges(p["ext"]).alias("ext"), F.transform(p["holes"], boxed_edges).alias("holes")))
    return regions.withColumns({"shape": shape, "bx1": fixed(ends("x", F.array_min)), "by1": fixed(ends("y", F.array_min)), "bx2": fixed(ends("x", F.array_max)), "by2": fixed(ends("y", F.array_max))})


def mask_step(patches: Patches, stride: Column) -> Column:
    """Mask cells between grid points; an error for less than a pixel or a
    stride over the limit."""
    step = stride * patches.size / patches.relative
    small = fixed(step * patches.relative) < 1
    return F.when(small, F.raise_error(F.lit("patch stride is too small: the step at level 0 is under a pixel"))).when(stride > MAX_STRIDE, F.raise_error(F.lit(f"patch stride is over {MAX_STRIDE}"))).otherwise(step)


def _last_index(lo: Column, hi: Column, step: Column) -> Column:
    """The first k with lo + k * step, rounded, at or past hi."""
    k = F.ceil((hi - lo) / step)
    at = lambda i: fixed(lo + i * step)
    return F.when((k > 0) & (at(k - 1) >= hi), k - 1).when(at(k) < hi, k + 1).otherwise(k)


def grid_candidates(regions: DataFrame, patches: Patches, stride: float | str = 1.0) -> DataFrame:
    """Grid points of each region's box, row by row, as far as the first one at
    or past its far edge: regions with seq, mx, my, msize."""
    by = F.col(stride).cast("double") if isinstance(stride, str) else F.lit(float(stride))
    r = _box(_spread(regions)).withColumn("_step", mask_step(patches, by))
    r = r.withColumns({"_nx": _last_index(F.col("bx1"), F.col("bx2"), F.col("_step")), "_ny": _last_index(F.col("by1"), F.col("by2"), F.col("_step"))})
    zero = F.lit(0).cast("long")
    r = r.withColumn("_iy", F.explode(F.sequence(zero, F.col("_ny")))).withColumn("_ix", F.explode(F.sequence(zero, F.col("_nx"))))
    return r.withColumns(
        {
            "seq": F.col("_iy") * (F.col("_nx") + 1) + F.col("_ix"),
            "mx": F.col("bx1") + F.col("_ix") * F.col("_step"),
            "my": F.col("by1") + F.col("_iy") * F.col("_step"),
            "msize": patches.mask_size,
        }
    ).drop("_ix", "_iy", "_nx", "_ny", "_step", "bx1", "by1", "bx2", "by2")


def uniform_pair(region: Column, attempt: Column, seed: int) -> tuple[Column, Column]:
    """Two numbers in [0, 1) of a region and attempt: a quadratic recurrence in
    64-bit whole numbers, so another engine can repeat it."""
    p = F.lit(_PRIME)
    s = (F.lit(seed % _PRIME).cast("long") * _A + (region % p) * _B + attempt * _C + 1) % p
    x = (s * s + attempt) % p
    x = (x * x + s) % p
    y = (x * x + s + 1) % p
    return x / p, y / p


def random_valid(regions: DataFrame, patches: Patches, number: int | str, cells: DataFrame | None = None, *, seed: int = 0, strict: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The first ``number`` valid ones of each region's uniform points, by
    attempt (``seq``); a region has ATTEMPTS attempts for each patch asked for.

    Attempts are made in rounds: four for each patch first, then as many again,
    and so on, for the regions that are still short. A round's attempts are an
    array of the region's row, filtered in place by the area they share, so the
    region's rings are in no candidate row. With ``strict``, a region that has
    too few after all attempts, or none, is an error.
    """
    wanted = F.col(number) if isinstance(number, str) else F.lit(number)
    base = cut_lineage(_box(_spread(regions)).withColumn("_want", wanted.cast("long")).filter(F.col("_want") > 0).withColumn("_short", F.col("_want")))
    key, short, found, done = ["slide_id", "region_id"], base, None, 0
    for upto in [*ROUNDS, ATTEMPTS]:
        def attempt(i: Column) -> Column:
            u, v = uniform_pair(F.col("region_id"), i, seed)
            place = lambda lo, hi, w: F.col(lo) + (F.col(hi) - F.col(lo)) * w
            return F.struct(i.alias("seq"), place("bx1", "bx2", u).alias("mx"), place("by1", "by2", v).alias("my"))

        tries = F.transform(F.sequence(F.col("_want") * done + 1, F.col("_want") * upto), attempt)
        fits = F.filter(tries, lambda t: enough_overlap(t["mx"], t["my"], F.col("msize"), patches))
        if cells is None or patches.foreground_ratio == 0:
            fits = F.slice(fits, F.lit(1), F.col("_short").cast("int"))
        columns = [c for c in short.columns if c not in ("parts", "shape", "bx1", "by1", "bx2", "by2", "msize")]
        valid = short.withColumn("msize", patches.mask_size).withColumn("_fits", fits).select(*columns, "msize", F.inline("_fits"))
        valid = with_foreground(valid, patches, cells, hot_rows=hot_rows)
        rank = F.row_number().over(Window.partitionBy(*key).orderBy("seq"))
        kept = cut_lineage(valid.withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_short")).drop("_rank"))
        have = kept.groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.count(F.lit(1)).alias("_have"))
        same = (short["slide_id"] == have["_slide_id"]) & (short["region_id"] == have["_region_id"])
        left = short.join(have, same, "left").withColumn("_short", F.col("_short") - F.coalesce("_have", F.lit(0))).filter(F.col("_short") > 0)
        short = cut_lineage(left.drop("_have", "_slide_id", "_region_id"))
        kept = kept.drop("_want", "_short")
        found, done = kept if found is None else found.unionByName(kept), upto
        if short.isEmpty():
            return found
    if strict:
        names = [f"{r.slide_id}/{r.region_id}" for r in short.select(*key).limit(5).collect()]
        raise ValueError(f"could not find enough random patches for regions such as {', '.join(names)}")
    return found


def poisson_disk(width: float, height: float, radius: float, seed: int, k: int = 30) -> np.ndarray:
    """Points of [0, width) x [0, height), no two nearer than ``radius``, by
    darts thrown around live points; ``k`` misses retire one. A grid of side
    radius / sqrt 2 holds at most one point a cell."""
    if width <= 0 or height <= 0 or radius <= 0:
        return np.empty((0, 2))
    rng = np.random.default_rng(seed)
    side = radius / np.sqrt(2)
    grid = np.full((int(width / side) + 6, int(height / side) + 6, 2), np.inf)
    around = np.stack(np.meshgrid(np.arange(-2, 3), np.arange(-2, 3), indexing="ij"), axis=-1).reshape(-1, 2)
    points = [rng.uniform((0, 0), (width, height))]
    grid[tuple((points[0] / side).astype(int) + 2)] = points[0]
    live = [0]
    while live:
        at = int(rng.integers(len(live)))
        angles, reach = rng.uniform(0, 2 * np.pi, k), radius * np.sqrt(rng.uniform(1, 4, k))
        darts = points[live[at]] + np.column_stack((np.cos(angles), np.sin(angles))) * reach[:, None]
        darts = darts[np.all((darts >= 0) & (darts < (width, height)), axis=1)]
        cells = (darts / side).astype(int) + 2
        near = cells[:, None, :] + around
        gaps = grid[near[..., 0], near[..., 1]] - darts[:, None, :]
        free = np.flatnonzero(np.all(np.sum(gaps * gaps, axis=2) >= radius * radius, axis=1))
        if len(free):
            dart = darts[free[0]]
            grid[tuple(cells[free[0]])] = dart
            live.append(len(points))
            points.append(dart)
        else:
            live[at] = live[-1]
            live.pop()
    return np.array(points)


def poisson_candidates(regions: DataFrame, patches: Patches, spacing: float | str = 50.0, *, seed: int = 0) -> DataFrame:
    """Poisson-disk points of each region's box, ``spacing`` mask cells apart;
    seeded by region, so a task run again gives the same ones."""
    gap = F.col(spacing).cast("double") if isinstance(spacing, str) else F.lit(float(spacing))
    r = _box(_spread(regions)).withColumns({"_gap": gap, "_seed": F.xxhash64("slide_id", "region_id", F.lit(seed))})

    @F.pandas_udf("array<struct<seq:bigint,mx:double,my:double>>")
    def sample(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series, gap: pd.Series, seed: pd.Series) -> pd.Series:
        out = []
        for a, b, c, d, g, s in zip(x1, y1, x2, y2, gap, seed):
            found = poisson_disk(c - a, d - b, g, int(s) & (1 << 62) - 1)
            out.append([{"seq": i, "mx": float(p[0] + a), "my": float(p[1] + b)} for i, p in enumerate(found)])
        return pd.Series(out)

    # The optimizer would filter by an array's size before the regions are dealt, and sample twice for that.
    sample = sample.asNondeterministic()
    points = r.withColumn("_p", sample("bx1", "by1", "bx2", "by2", "_gap", "_seed"))
    return points.select(*regions.columns, "shape", F.inline("_p")).withColumn("msize", patches.mask_size)


def point_candidates(regions: DataFrame, points: DataFrame, patches: Patches, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Given level-0 corners (slide_id, seq, x, y) against the regions of their
    slide; points of slides without region are dropped by the join.

    Where some overlap is needed, only corners whose square meets the region's
    box can be valid. A grid join at level 0 finds these: a region's box, widened
    by the square on its low sides, lies in at most four cells of its level, and
    a point has one cell at each level in use. Factors may be columns. Without
    any overlap needed, every pair of a slide is a candidate.
    """
    f = patches.column("mask_factor")
    p = points.select("slide_id", F.col("seq").cast("long").alias("seq"), F.col("x").alias("_x"), F.col("y").alias("_y")).dropna()
    boxed = _box(regions)
    place = {"mx": F.col("_x") / f, "my": F.col("_y") / f, "msize": patches.mask_size}
    names = [*regions.columns, "shape", "seq", "mx", "my", "msize"]
    if patches.overlap_ratio == 0:
        return salted_join(p, boxed, ["slide_id"], spread_by=["seq"], hot_rows=hot_rows).withColumns(place).select(*names)
    base, size = float(patches.size), patches.mask_size * f
    # A pixel on each side makes up for the rounding of boxes; the exact test follows.
    reach = {"_x1": F.col("bx1") * f - size - 1, "_y1": F.col("by1") * f - size - 1, "_x2": F.col("bx2") * f + 1, "_y2": F.col("by2") * f + 1}
    boxed = boxed.withColumns(reach).withColumn("_level", F.ceil(F.log2(F.greatest(F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1"), F.lit(base)) / base)).cast("int"))
    levels = sorted(r[0] for r in boxed.select("_level").distinct().collect())  # a few integers
    side = F.lit(base) * F.pow(F.lit(2.0), F.col("_level"))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / side), F.floor(F.col(hi) / side)))
    held = boxed.withColumn("_cx", cells("_x1", "_x2")).withColumn("_cy", cells("_y1", "_y2")).drop("_x1", "_y1", "_x2", "_y2")
    probes = p.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>"))).withColumns({"_cx": F.floor(F.col("_x") / side), "_cy": F.floor(F.col("_y") / side)})
    on = ["slide_id", "_level", "_cx", "_cy"]
    probes = in_covered(probes, covered_cells(held, *map(F.col, on)), *map(F.col, on))
    pairs = salted_join(probes, held, on, spread_by=["seq"], hot_rows=hot_rows).withColumns(place)
    meet = (F.col("mx") <= F.col("bx2")) & (F.col("bx1") <= F.col("mx") + F.col("msize")) & (F.col("my") <= F.col("by2")) & (F.col("by1") <= F.col("my") + F.col("msize"))
    return pairs.filter(meet).select(*names)


def overlap_area(x1: Column, y1: Column, size: Column) -> Column:
    """Area that a square shares with its region's parts."""
    part = lambda p: polygon_window_area(p["ext"], p["holes"], x1, y1, x1 + size, y1 + size)
    return F.aggregate(F.transform("shape", part), F.lit(0.0), lambda s, v: s + v)


def enough_overlap(x1: Column, y1: Column, size: Column, patches: Patches) -> Column:
    least = fixed(size * size * patches.column("overlap_ratio"), AREA_PLACES)
    return fixed(overlap_area(x1, y1, size), AREA_PLACES) >= least


def with_foreground(candidates: DataFrame, patches: Patches, cells: DataFrame | None, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Candidates with enough foreground; none is needed where the ratio is 0 or there is no mask."""
    if cells is None or patches.foreground_ratio == 0:
        return candidates
    keyed = candidates.withColumn("window_id", F.struct("slide_id", "region_id", "seq"))
    counted = foreground_ratio(keyed, cells, hot_rows=hot_rows)
    return counted.filter(F.col("foreground") >= patches.column("foreground_ratio")).drop("window_id", "foreground")


def valid_candidates(candidates: DataFrame, patches: Patches, cells: DataFrame | None = None, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Candidates with enough of their square in the region and enough foreground."""
    kept = candidates.filter(enough_overlap(F.col("mx"), F.col("my"), F.col("msize"), patches)).drop("parts", "shape")
    return with_foreground(kept, patches, cells, hot_rows=hot_rows)


def at_level_zero(valid: DataFrame, patches: Patches) -> DataFrame:
    """Patch rows: slide_id, region_id, seq, x, y, w, h, label and the place in the mask."""
    f = patches.column("mask_factor")
    size = F.lit(patches.size).cast("int")
    return valid.select("slide_id", "region_id", "seq", whole(F.col("mx") * f).alias("x"), whole(F.col("my") * f).alias("y"), size.alias("w"), size.alias("h"), "label", "mx", "my", "msize")


def distinct_patches(patches: DataFrame) -> DataFrame:
    """The first of each slide's patches with equal place, size and label, by
    region and seq. A minimum a key, combined before the shuffle."""
    key = ["slide_id", "x", "y", "w", "h", "label"]
    rest = [c for c in patches.columns if c not in key]
    first = patches.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("region_id", "seq")).alias("_r"))
    return first.select(*[F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in patches.columns])


def sample(candidates: DataFrame, patches: Patches, cells: DataFrame | None = None) -> DataFrame:
    """From candidates to distinct patches."""
    return distinct_patches(at_level_zero(valid_candidates(candidates, patches, cells), patches))


def sample_random(regions: DataFrame, patches: Patches, number: int | str, cells: DataFrame | None = None, *, seed: int = 0, strict: bool = True) -> DataFrame:
    """From regions to distinct random patches."""
    return distinct_patches(at_level_zero(random_valid(regions, patches, number, cells, seed=seed, strict=strict), patches))
