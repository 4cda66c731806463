"""Probabilities to colours: value range, colour maps, background, overlay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.scalars import color_rgb
from pathloom.operators.skew import lookup_join

# Colour maps as (place, value) knots a channel, linear between them.
_GREY = ((0.0, 0.0), (1.0, 1.0))
MAPS: dict[str, tuple[Sequence[tuple[float, float]], ...]] = {
    "gray": (_GREY, _GREY, _GREY),
    "jet": (
        ((0.0, 0.0), (0.35, 0.0), (0.66, 1.0), (0.89, 1.0), (1.0, 0.5)),
        ((0.0, 0.0), (0.125, 0.0), (0.375, 1.0), (0.64, 1.0), (0.91, 0.0), (1.0, 0.0)),
        ((0.0, 0.5), (0.11, 1.0), (0.34, 1.0), (0.65, 0.0), (1.0, 0.0)),
    ),
    "hot": (((0.0, 0.0416), (0.365079, 1.0), (1.0, 1.0)), ((0.0, 0.0), (0.365079, 0.0), (0.746032, 1.0), (1.0, 1.0)), ((0.0, 0.0), (0.746032, 0.0), (1.0, 1.0))),
    "cool": (_GREY, ((0.0, 1.0), (1.0, 0.0)), ((0.0, 1.0), (1.0, 1.0))),
    "autumn": (((0.0, 1.0), (1.0, 1.0)), _GREY, ((0.0, 0.0), (1.0, 0.0))),
    "winter": (((0.0, 0.0), (1.0, 0.0)), _GREY, ((0.0, 1.0), (1.0, 0.5))),
    "spring": (((0.0, 1.0), (1.0, 1.0)), _GREY, ((0.0, 1.0), (1.0, 0.0))),
    "summer": (_GREY, ((0.0, 0.5), (1.0, 1.0)), ((0.0, 0.4), (1.0, 0.4))),
    "copper": (((0.0, 0.0), (0.809524, 1.0), (1.0, 1.0)), ((0.0, 0.0), (1.0, 0.7812)), ((0.0, 0.0), (1.0, 0.4975))),
    "bone": (((0.0, 0.0), (0.746032, 0.652778), (1.0, 1.0)), ((0.0, 0.0), (0.365079, 0.319444), (0.746032, 0.777778), (1.0, 1.0)), ((0.0, 0.0), (0.365079, 0.444444), (1.0, 1.0))),
}
_STEPS = 256


def add_map(name: str, red: Sequence[tuple[float, float]], green: Sequence[tuple[float, float]], blue: Sequence[tuple[float, float]]) -> None:
    """A colour map of one's own: (place, value) knots a channel, from 0 to 1."""
    for knots in (red, green, blue):
        places = [p for p, _ in knots]
        if places != sorted(places) or (places[0], places[-1]) != (0.0, 1.0):
            raise ValueError("knots go from 0 to 1 in order")
    MAPS[name] = (tuple(red), tuple(green), tuple(blue))


def _channel(at: Column, knots: Sequence[tuple[float, float]]) -> Column:
    value = F.lit(knots[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:]))):
        value = F.when(at <= x1, y0 + (at - x0) * (y1 - y0) / (x1 - x0)).otherwise(value)
    return F.floor(value * 255).cast("int")


def value_range(cells: DataFrame, *, value: str = "prob", by: Sequence[str] = ("slide_id",)) -> DataFrame:
    """(by, vmin, vmax), NaN and null left out."""
    p = F.when(~F.isnan(value), F.col(value))
    return cells.groupBy(*by).agg(F.min(p).alias("vmin"), F.max(p).alias("vmax"))


def colored(
    cells: DataFrame, *, cmap: str = "jet", vmin: float | None = None, vmax: float | None = None, alpha: float = 1.0, background: str | None = None, cutoff: float | None = None, value: str = "prob", by: Sequence[str] = ("slide_id",)
) -> DataFrame:
    """``cells`` with r, g, b, a. The range is the given one or that of the
    values; an empty range is an error. 256 steps; values beyond the range get
    its end's colour. A value under the cutoff, NaN or null is no value: the
    background colour, or transparent without one. A cutoff of 0 is none.
    """
    knots = MAPS[cmap]
    out = cells
    if vmin is None or vmax is None:
        out = lookup_join(out, value_range(cells, value=value, by=by), by, null_safe=True)
    lo, hi = (F.col(n) if v is None else F.lit(float(v)) for n, v in (("vmin", vmin), ("vmax", vmax)))
    p = F.when(~F.isnan(value), F.col(value))
    if cutoff:
        p = F.when(p >= cutoff, p)
    share = F.when(lo == hi, F.raise_error(F.lit("the value range is empty")).cast("double")).otherwise((p - lo) / (hi - lo))
    step = F.greatest(F.lit(0), F.least(F.lit(_STEPS - 1), F.floor(share * _STEPS)))
    at = step / (_STEPS - 1)
    clear = round(255 * alpha)
    none = (*color_rgb(background), clear) if background else (0, 0, 0, 0)
    channels = [_channel(at, k) for k in knots] + [F.lit(clear if alpha < 1 else 255)]
    out = out.withColumn("_at", at)
    return out.withColumns({c: F.when(share.isNull(), F.lit(n)).otherwise(v).cast("int") for c, v, n in zip("rgba", channels, none)}).drop("_at", *[c for c in ("vmin", "vmax") if c not in cells.columns])


def overlaid(pixels: DataFrame, colors: DataFrame) -> DataFrame:
    """Slide pixels (slide_id, x, y, r, g, b) under heatmap colours (…, r, g, b, a)."""
    c = colors.select("slide_id", "x", "y", *[F.col(k).alias(f"_{k}") for k in "rgba"])
    share = F.coalesce(F.col("_a"), F.lit(0)) / 255
    blend = lambda k: F.floor(F.col(k) * (1 - share) + F.coalesce(F.col(f"_{k}"), F.lit(0)) * share + 0.5).cast("int").alias(k)
    return pixels.join(c, ["slide_id", "x", "y"], "left").select("slide_id", "x", "y", *[blend(k) for k in "rgb"])
