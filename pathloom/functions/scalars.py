"""Scalar column functions: names, rounding, colours, levels and file names."""

from __future__ import annotations

import random
import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal places of coordinates and ratios, and of areas.
PLACES, AREA_PLACES = 10, 8
#: Values above this are a least size in pixels, others a level.
LEVEL_OR_SIZE = 99


def fixed(c: Column, places: int = PLACES) -> Column:
    """Half-even rounding to fixed places, against accumulated float noise."""
    return F.bround(c, places)


def whole(c: Column) -> Column:
    """The nearest whole number, half to even, as LONG."""
    return F.bround(c, 0).cast("long")


def slide_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def slide_key(path: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(slide_name(path), r"(?<=.)\.[^.]*$", "")


def level_and_mpp(value: int | float) -> tuple[int | None, float | None]:
    """An int is a level, a float is microns per pixel; 0.0 and others are errors."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or isinstance(value, float) and value == 0:
        raise ValueError(f"invalid level or MPP value: {value!r}")
    return (None, value) if isinstance(value, float) else (value, None)


def one_each(value: object, name: str, count: int) -> list:
    """A parameter for each of ``count`` polygons: a scalar counts for all, a
    list must have their number."""
    if isinstance(value, (list, tuple)):
        if len(value) != count:
            raise ValueError(f"{name}: {len(value)} values for {count} items")
        return list(value)
    return [value] * count


def one_list_each(value: Sequence, name: str, count: int) -> list[list]:
    """A list parameter for each of ``count`` slides: a flat list counts for all."""
    if any(isinstance(v, (list, tuple)) for v in value):
        if len(value) != count or not all(isinstance(v, (list, tuple)) for v in value):
            raise ValueError(f"{name}: one list for each of {count} items is needed")
        return [list(v) for v in value]
    return [list(value)] * count


def no_reserved(args: dict, reserved: Sequence[str] = ("wsi_file", "mask_data", "slide_id", "cells")) -> None:
    """Parameters for many slides can't name what is given slide by slide."""
    for name in args:
        if name in reserved:
            raise ValueError(f"incorrect parameter for many slides: {name}")


def only_one_of(included: Sequence[str], excluded: Sequence[str]) -> None:
    if included and excluded:
        raise ValueError("only one of included and excluded labels can be given")


def label_filter(label: Column, included: Sequence[str] = (), excluded: Sequence[str] = ()) -> Column:
    """Keep included labels, or all but excluded ones; a null label is no
    included one and no excluded one."""
    only_one_of(included, excluded)
    if included:
        return F.coalesce(label.isin(list(included)), F.lit(False))
    if excluded:
        return F.coalesce(~label.isin(list(excluded)), F.lit(True))
    return F.lit(True)


def random_id(length: int = 8) -> str:
    return "".join(random.choices(string.ascii_lowercase + string.digits, k=length))


def alpha_byte(alpha: Column) -> Column:
    return F.bround(alpha * 255, 0).cast("int")


def rgb_of_hex(c: Column) -> Column:
    """STRUCT<r, g, b> of "#rrggbb"."""
    part = lambda i: F.conv(F.substring(c, i, 2), 16, 10).cast("int")
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


# Colour names and their hex codes.
_COLORS = """
aliceblue f0f8ff antiquewhite faebd7 aqua 00ffff aquamarine 7fffd4 azure f0ffff beige f5f5dc bisque ffe4c4 black 000000
blanchedalmond ffebcd blue 0000ff blueviolet 8a2be2 brown a52a2a burlywood deb887 cadetblue 5f9ea0 chartreuse 7fff00
chocolate d2691e coral ff7f50 cornflowerblue 6495ed cornsilk fff8dc crimson dc143c cyan 00ffff darkblue 00008b
darkcyan 008b8b darkgoldenrod b8860b darkgray a9a9a9 darkgreen 006400 darkgrey a9a9a9 darkkhaki bdb76b
darkmagenta 8b008b darkolivegreen 556b2f darkorange ff8c00 darkorchid 9932cc darkred 8b0000 darksalmon e9967a
darkseagreen 8fbc8f darkslateblue 483d8b darkslategray 2f4f4f darkslategrey 2f4f4f darkturquoise 00ced1
darkviolet 9400d3 deeppink ff1493 deepskyblue 00bfff dimgray 696969 dimgrey 696969 dodgerblue 1e90ff
firebrick b22222 floralwhite fffaf0 forestgreen 228b22 fuchsia ff00ff gainsboro dcdcdc ghostwhite f8f8ff gold ffd700
goldenrod daa520 gray 808080 green 008000 greenyellow adff2f grey 808080 honeydew f0fff0 hotpink ff69b4
indianred cd5c5c indigo 4b0082 ivory fffff0 khaki f0e68c lavender e6e6fa lavenderblush fff0f5 lawngreen 7cfc00
lemonchiffon fffacd lightblue add8e6 lightcoral f08080 lightcyan e0ffff lightgoldenrodyellow fafad2 lightgray d3d3d3
lightgreen 90ee90 lightgrey d3d3d3 lightpink ffb6c1 lightsalmon ffa07a lightseagreen 20b2aa lightskyblue 87cefa
lightslategray 778899 lightslategrey 778899 lightsteelblue b0c4de lightyellow ffffe0 lime 00ff00 limegreen 32cd32
linen faf0e6 magenta ff00ff maroon 800000 mediumaquamarine 66cdaa mediumblue 0000cd mediumorchid ba55d3
mediumpurple 9370db mediumseagreen 3cb371 mediumslateblue 7b68ee mediumspringgreen 00fa9a mediumturquoise 48d1cc
mediumvioletred c71585 midnightblue 191970 mintcream f5fffa mistyrose ffe4e1 moccasin ffe4b5 navajowhite ffdead
navy 000080 oldlace fdf5e6 olive 808000 olivedrab 6b8e23 orange ffa500 orangered ff4500 orchid da70d6
palegoldenrod eee8aa palegreen 98fb98 paleturquoise afeeee palevioletred db7093 papayawhip ffefd5 peachpuff ffdab9
peru cd853f pink ffc0cb plum dda0dd powderblue b0e0e6 purple 800080 rebeccapurple 663399 red ff0000
rosybrown bc8f8f royalblue 4169e1 saddlebrown 8b4513 salmon fa8072 sandybrown f4a460 seagreen 2e8b57 seashell fff5ee
sienna a0522d silver c0c0c0 skyblue 87ceeb slateblue 6a5acd slategray 708090 slategrey 708090 snow fffafa
springgreen 00ff7f steelblue 4682b4 tan d2b48c teal 008080 thistle d8bfd8 tomato ff6347 turquoise 40e0d0
violet ee82ee wheat f5deb3 white ffffff whitesmoke f5f5f5 yellow ffff00 yellowgreen 9acd32
""".split()
COLORS = {name: f"#{code}" for name, code in zip(_COLORS[::2], _COLORS[1::2])}


def color_hex(color: str) -> str:
    """"#rrggbb" as given, or that of a name; KeyError for an unknown one."""
    return color if color.startswith("#") and len(color) == 7 else COLORS[color]


def color_rgb(color: str) -> tuple[int, int, int]:
    code = color_hex(color)
    return int(code[1:3], 16), int(code[3:5], 16), int(code[5:7], 16)


def asap_color(c: Column) -> Column:
    return F.lower(c)


def sedeen_color(c: Column) -> Column:
    """Without the two alpha digits."""
    return F.substring(c, F.lit(1), F.greatest(F.length(c) - 2, F.lit(0)))


def patch_file_name(slide: Column, manifest_id: Column, x: Column, y: Column, *, label: Column | None = None, comment: Column | None = None, separator: str = "_", image_type: str = "png") -> Column:
    """slide, manifest, comment, label and place, joined; empty and null parts are left out."""
    optional = [F.when(p != "", p) for p in (comment, label) if p is not None]
    parts = [slide, manifest_id, *optional, F.concat(F.lit("x"), x.cast("string")), F.concat(F.lit("y"), y.cast("string"))]
    return F.concat(F.concat_ws(separator, *parts), F.lit(f".{image_type}"))


def patch_path(folder: str, name: Column, *, label: Column | None = None, set_dir: Column | None = None) -> Column:
    """folder / label / set / name; a subfolder by label needs a label."""
    parts = [F.lit(folder)]
    if label is not None:
        parts.append(F.when(F.coalesce(label, F.lit("")) == "", F.raise_error(F.lit("a label subfolder needs a label"))).otherwise(label))
    return F.concat_ws("/", *parts, *([set_dir] if set_dir is not None else []), name)
