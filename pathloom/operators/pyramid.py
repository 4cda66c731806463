"""Slide pyramids: levels, microns per pixel, resampling factors, location checks.

``pyramids`` folds the level rows into one row a slide with a short sorted
array; every lookup then is a higher-order function over that array, so a
request table needs one join on slide_id, whatever it asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.scalars import LEVEL_OR_SIZE, fixed, level_and_mpp, whole
from pathloom.operators.skew import lookup_join

# Defaults of the settings.
MPP_PLACES, MIN_MPP, MAX_MAGNIFICATION, LEVEL_MARGIN, PADDING_MARGIN = 5, 0.001, 40, 0.003, 10


def property_value(props: Column, name: str, strict: bool = True) -> Column:
    """A property as text; a missing one is an error, or null if not strict."""
    value = F.try_element_at(props, F.lit(name)).cast("string")
    return F.when(value.isNull(), F.raise_error(F.lit(f"property {name} does not exist"))).otherwise(value) if strict else value


def all_properties(slides: DataFrame, props: str = "props") -> DataFrame:
    """(slide_id, name, value): one row a property."""
    return slides.select("slide_id", F.explode(props).alias("name", "value"))


def magnification(props: Column, name: str = "openslide.objective-power") -> Column:
    return F.try_element_at(props, F.lit(name)).try_cast("int")


def centimeter_mpp(unit: Column, resolution: Column) -> Column:
    """10000 / pixels a centimetre; null for another unit, zero or no number."""
    value = resolution.try_cast("double")
    return F.when((F.upper(unit) == "CENTIMETER") & (value != 0), 10000 / value)


def resolve_mpp(x_sources: Sequence[Column], y_sources: Sequence[Column], external: float | None = None, places: int = MPP_PLACES) -> Column:
    """The first source with both axes, else the external value. Axes that
    differ are rounded; if they differ still, it is an error. Zero is no value."""
    found = F.lit(None).cast("struct<x:double,y:double>")
    if external is not None:
        found = F.struct(F.lit(float(external)).alias("x"), F.lit(float(external)).alias("y"))
    for x, y in reversed(list(zip(x_sources, y_sources))):
        found = F.when((x != 0) & (y != 0), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))).otherwise(found)
    x, y = F.bround(found["x"], places), F.bround(found["y"], places)
    return F.when(found["x"] == found["y"], found["x"]).when(x == y, x).when(found.isNotNull(), F.raise_error(F.lit("MPP data is not supported: axes differ")))


def level_mpp(levels: DataFrame, slides: DataFrame) -> DataFrame:
    """Levels with ``mpp`` = the slide's mpp times the level's downsample."""
    return levels.drop("mpp").join(slides.select("slide_id", F.col("mpp").alias("_m")), "slide_id", "left").withColumn("mpp", F.col("_m") * F.col("downsample")).drop("_m")


def pyramids(levels: DataFrame) -> DataFrame:
    """(slide_id, levels): the slide's levels in order, each once.

    ``levels``: slide_id, slide_level, width, height, downsample, mpp, magnification.
    Rows that come twice count once; rows without slide or level are left out.
    """
    rows = levels.filter(F.col("slide_id").isNotNull() & F.col("slide_level").isNotNull()).groupBy("slide_id", "slide_level")
    values = ["width", "height", "downsample", "mpp", "magnification"]
    once = rows.agg(*[F.max(c).alias(c) for c in values])
    return once.groupBy("slide_id").agg(F.array_sort(F.collect_list(F.struct("slide_level", *values))).alias("levels"))


def _first(condition, found: str = "slide_level", last: bool = False) -> Column:
    matching = F.filter("levels", condition)
    return F.try_element_at(matching, F.lit(-1 if last else 1))[found]


def of_level(level: Column, what: str) -> Column:
    return _first(lambda v: v["slide_level"] == level, what)


def level_of_shape(width: Column, height: Column) -> Column:
    """The highest level with exactly this size; null if there is none."""
    return _first(lambda v: (v["width"] == width) & (v["height"] == height), last=True)


def nearest_level(least: Column, allow_zero: bool = True) -> Column:
    """The highest level that is at least so wide and high, else 0; where 0 is
    not allowed, null."""
    level = F.coalesce(_first(lambda v: (v["width"] >= least) & (v["height"] >= least), last=True), F.lit(0))
    return level if allow_zero else F.nullif(level, F.lit(0))


def level_or_nearest(value: Column) -> Column:
    return F.when(value > LEVEL_OR_SIZE, nearest_level(value)).otherwise(value)


def level_of_mpp(mpp: Column, margin: float = LEVEL_MARGIN) -> Column:
    """The first level whose mpp differs by less than the margin, else -1; -1
    too where a level has no mpp."""
    known = F.forall("levels", lambda v: F.coalesce(v["mpp"] != 0, F.lit(False)))
    return F.when(known, F.coalesce(_first(lambda v: fixed(F.abs(v["mpp"] - mpp)) < margin), F.lit(-1))).otherwise(F.lit(-1))


def best_base_level(mpp: Column) -> Column:
    """The last level that is no coarser than the requested mpp, else 0."""
    return F.coalesce(_first(lambda v: fixed(v["mpp"]) <= fixed(mpp), last=True), F.lit(0))


def target_factor(level: Column, mpp: Column, base_level: Column | None = None) -> Column:
    """Downsample of the target against the base level; an mpp if no level is given."""
    base = F.lit(0) if base_level is None else base_level
    return F.coalesce(of_level(level, "downsample") / of_level(base, "downsample"), mpp / of_level(base, "mpp"))


def resample_factors(level: Column, mpp: Column, level_zero: bool = True) -> Column:
    """STRUCT<base_level, base_factor, zero_factor> of a target: the level it is
    read at, and its factors against that level and level 0."""
    base = F.when(mpp.isNotNull(), F.lit(0) if level_zero else best_base_level(mpp)).otherwise(level)
    return F.struct(base.alias("base_level"), target_factor(level, mpp, base).alias("base_factor"), target_factor(level, mpp).alias("zero_factor"))


def resampled_size(mpp: Column, level_zero: bool = True) -> Column:
    """STRUCT<width, height> of the base level brought to an mpp."""
    f = resample_factors(F.lit(None).cast("int"), mpp, level_zero)
    return F.struct(whole(of_level(f["base_level"], "width") / f["base_factor"]).alias("width"), whole(of_level(f["base_level"], "height") / f["base_factor"]).alias("height"))


def resampling_batches(requests: DataFrame, levels: DataFrame, level_zero: bool = True) -> DataFrame:
    """(slide_id, base_level, mpps): requested mpps (slide_id, mpp) that match no
    level, grouped by the level they are read from."""
    asked = lookup_join(requests, pyramids(levels), ["slide_id"]).filter(level_of_mpp(F.col("mpp")) == -1)
    return asked.select("slide_id", "mpp", resample_factors(F.lit(None).cast("int"), F.col("mpp"), level_zero)["base_level"].alias("base_level")).groupBy("slide_id", "base_level").agg(F.array_sort(F.collect_set("mpp")).alias("mpps"))


def max_mpp(default_magnification: int = MAX_MAGNIFICATION) -> Column:
    power = F.coalesce(F.nullif(of_level(F.lit(0), "magnification"), F.lit(0)), F.lit(default_magnification))
    return fixed(of_level(F.lit(0), "mpp") * power)


def mpp_in_range(mpp: Column, least: float = MIN_MPP, default_magnification: int = MAX_MAGNIFICATION) -> Column:
    return (mpp >= least) & (mpp <= max_mpp(default_magnification))


def check_resampling(mode: str | None, extra_mpps: Sequence[float]) -> None:
    """mode None, wsi or tile; wsi needs distinct float mpps, the others none."""
    if mode not in (None, "wsi", "tile"):
        raise ValueError(f"invalid resampling mode: {mode}")
    if bool(extra_mpps) != (mode == "wsi"):
        raise ValueError("MPP values are missing" if mode == "wsi" else "superfluous MPP values")
    if any(not isinstance(m, float) for m in extra_mpps) or len(set(extra_mpps)) != len(extra_mpps):
        raise ValueError("MPP values must be distinct floats")


def location_valid(x: Column, y: Column, width: Column, height: Column, factor: Column) -> Column:
    """Whether a region may be read: its corner isn't beyond the image, and one
    with a negative corner touches the image and doesn't span it."""
    w0, h0 = of_level(F.lit(0), "width"), of_level(F.lit(0), "height")
    sw, sh = whole(width * factor), whole(height * factor)
    negative = (x < 0) | (y < 0)
    touches = (x + sw > 0) & (y + sh > 0)
    spans = ((x < 0) & (sw > w0)) | ((y < 0) & (sh > h0))
    return (x <= w0) & (y <= h0) & (~negative | (touches & ~spans))


def needs_padding(x: Column, y: Column, width: Column, height: Column, factor: Column, margin: int = PADDING_MARGIN) -> Column:
    """Whether a region may hold pixels beyond the image."""
    sw, sh = whole(width * factor), whole(height * factor)
    return (x < 0) | (y < 0) | (x + sw + margin > of_level(F.lit(0), "width")) | (y + sh + margin > of_level(F.lit(0), "height"))


def tiff_resolution(mpp: Column, downsample: Column) -> Column:
    """Pixels a centimetre."""
    return 10000 / (mpp * downsample)


def centred_location(x: Column, width: Column, base_mpp: Column, target_mpp: Column, zero_mpp: Column) -> Column:
    """Level-0 start of a target patch of the same size whose centre is that of
    the base patch at ``x``; one axis."""
    base, target = base_mpp / zero_mpp, target_mpp / zero_mpp
    centre = (x + width * base / 2) / target
    return whole((centre - width / 2) * target)


def multires_patches(patches: DataFrame, levels: DataFrame, targets: Sequence[int | float], base: int | float) -> DataFrame:
    """Each patch (slide_id, x, y, w, h) at every target level (int) or mpp
    (float), sharing its centre: ``member``, ``target_level``, ``target_mpp``,
    ``target_x``, ``target_y``. Null places where a needed mpp is missing."""
    base_level, base_mpp = level_and_mpp(base)
    wanted = [level_and_mpp(t) for t in targets]
    members = F.array(*[F.struct(F.lit(i).alias("member"), F.lit(v).cast("int").alias("target_level"), F.lit(m).cast("double").alias("target_mpp")) for i, (v, m) in enumerate(wanted)])
    zero = of_level(F.lit(0), "mpp")
    from_mpp = F.lit(base_mpp) if base_mpp else of_level(F.lit(base_level), "mpp")
    to_mpp = F.coalesce("target_mpp", of_level(F.col("target_level"), "mpp"))
    joined = lookup_join(patches, pyramids(levels), ["slide_id"]).select("*", F.inline(members))
    return (
        joined.withColumn("target_x", centred_location(F.col("x"), F.col("w"), from_mpp, to_mpp, zero))
        .withColumn("target_y", centred_location(F.col("y"), F.col("h"), from_mpp, to_mpp, zero))
        .drop("levels")
    )
