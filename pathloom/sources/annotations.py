"""Annotation files to typed rows and polygons: two XML vendors, JSON, projects.

The XML trees are parsed by Spark's own ``from_xml`` with a schema, so missing
attributes are nulls and nothing leaves the JVM. Every reader gives raw rows
(path, ann_no, ann_type, ann_name, group_text, color, points); ``polygons_of``
validates, maps and labels them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.geometry import ellipse_ring
from pathloom.functions.scalars import asap_color, sedeen_color
from pathloom.operators.extract import save_bytes

_ASAP = "Annotations struct<Annotation:array<struct<_Name:string,_Type:string,_PartOfGroup:string,_Color:string,Coordinates:struct<Coordinate:array<struct<_X:string,_Y:string>>>>>>"
_SEDEEN = "image struct<_identifier:string,overlays:struct<graphic:array<struct<_type:string,_name:string,_description:string,pen:struct<_color:string>,`point-list`:struct<point:array<string>>>>>>"
_POLYGONS = "array<struct<points:array<array<double>>,label:string,holes:array<array<array<double>>>>>"
_PROJECT = "array<struct<image:string,annotations:array<struct<type:string,name:string,points:array<array<double>>>>>>"

#: Types that are kept, by vendor, with the points they need: exactly, or at least if negative.
POLYGON_TYPES = {"asap": {"Polygon": -3, "Spline": -3, "Rectangle": 4}, "sedeen": {"polygon": -3, "rectangle": 4, "ellipse": 4}}


def read_texts(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, text) of whole files, without a byte-order mark."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\\ufeff", "").alias("text"))


def _point(x: Column, y: Column) -> Column:
    number = lambda c: F.bround(F.regexp_replace(c, ",", ".").cast("double"), 0)
    return F.struct(number(x).alias("x"), number(y).alias("y"))


def asap_annotations(texts: DataFrame) -> DataFrame:
    """Raw rows of ASAP trees; decimal commas are read, points are whole numbers."""
    tree = F.from_xml(F.regexp_replace("text", r"^\s*<\?xml[^>]*\?>", ""), _ASAP)
    rows = texts.select("path", F.posexplode(tree["Annotations"]["Annotation"]).alias("ann_no", "a"))
    points = F.transform(F.coalesce(F.col("a.Coordinates.Coordinate"), F.array()), lambda p: _point(p["_X"], p["_Y"]))
    return rows.select("path", "ann_no", F.lit("asap").alias("vendor"), F.col("a._Type").alias("ann_type"), F.col("a._Name").alias("ann_name"), F.col("a._PartOfGroup").alias("group_text"), F.col("a._Color").alias("color"), points.alias("points"))


def sedeen_annotations(texts: DataFrame) -> DataFrame:
    """Raw rows of Sedeen sessions, with "x,y" points."""
    tree = F.from_xml(F.regexp_replace("text", r"^\s*<\?xml[^>]*\?>", ""), _SEDEEN)
    rows = texts.select("path", F.posexplode(tree["image"]["overlays"]["graphic"]).alias("ann_no", "a"))

    def point(p: Column) -> Column:
        xy = F.split(p, ",")
        return _point(F.get(xy, F.lit(0)), F.get(xy, F.lit(1)))

    points = F.transform(F.coalesce(F.col("a.point-list.point"), F.array()), point)
    return rows.select("path", "ann_no", F.lit("sedeen").alias("vendor"), F.col("a._type").alias("ann_type"), F.col("a._name").alias("ann_name"), F.col("a._description").alias("group_text"), F.col("a.pen._color").alias("color"), points.alias("points"))


def polygon_like(rows: DataFrame) -> DataFrame:
    """Rows of a polygon-like type of their vendor."""
    keep = F.lit(False)
    for vendor, types in POLYGON_TYPES.items():
        keep = keep | ((F.col("vendor") == vendor) & F.col("ann_type").isin(list(types)))
    return rows.filter(keep)


def point_problem() -> Column:
    """Why a row's points don't fit its type, or null."""
    need = F.lit(None).cast("int")
    for vendor, types in POLYGON_TYPES.items():
        for kind, n in types.items():
            need = F.when((F.col("vendor") == vendor) & (F.col("ann_type") == kind), F.lit(n)).otherwise(need)
    n = F.size("points")
    return F.when((need > 0) & (n != need), F.concat(F.col("ann_type"), F.lit(" needs "), need.cast("string"), F.lit(" points"))).when((need < 0) & (n < -need), F.concat(F.col("ann_type"), F.lit(" needs "), (-need).cast("string"), F.lit(" points or more")))


def mapped(
    rows: DataFrame, label: Column, *, values: Mapping[str, Column] | None = None, names: Mapping[str, str] | None = None, extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """Rows with their values mapped (custom over built-in), keys renamed, extra
    keys and the user's label added; an extra key that is there is an error."""
    ellipse = (F.col("vendor") == "sedeen") & (F.col("ann_type") == "ellipse")
    built_in = {"color": F.when(F.col("vendor") == "sedeen", sedeen_color(F.col("color"))).otherwise(asap_color(F.col("color"))), "points": F.when(ellipse, ellipse_ring(F.col("points"))).otherwise(F.col("points"))}
    for key in ["user_label", *(extra or {})]:
        if key in rows.columns:
            raise ValueError(f"key {key} already exists")
    out = rows.withColumns({**built_in, **(values or {})}).withColumns(dict(extra or {})).withColumn("user_label", label)
    return out.withColumnsRenamed(dict(names or {}))


def polygons_of(rows: DataFrame, label: Column, *, strict: bool = True) -> DataFrame:
    """(path, polygon_idx, label, points, holes) of raw rows. Rows whose points
    don't fit their type are an error, or left out if not strict."""
    kept = polygon_like(rows).withColumn("_problem", point_problem())
    if strict:
        kept = kept.filter(F.when(F.col("_problem").isNotNull(), F.raise_error(F.concat(F.col("path"), F.lit(": "), F.col("_problem"))).cast("boolean")).otherwise(F.lit(True)))
    else:
        kept = kept.filter(F.col("_problem").isNull())
    out = mapped(kept.drop("_problem"), label)
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    return out.select("path", F.col("ann_no").alias("polygon_idx"), F.col("user_label").alias("label"), "points", none.alias("holes"))


def _rings(c: Column) -> Column:
    return F.transform(c, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def json_polygons(texts: DataFrame, *, strict: bool = True) -> DataFrame:
    """(path, polygon_idx, label, points, holes) of JSON lists of {points,
    label, holes}. A text that is no such list, or an empty one, is an error, or
    left out if not strict."""
    parsed = texts.withColumn("_p", F.from_json("text", _POLYGONS, {"mode": "PERMISSIVE"}))
    bad = F.col("_p").isNull() | (F.size("_p") == 0) | F.exists("_p", lambda p: p["points"].isNull())
    if strict:
        parsed = parsed.filter(F.when(bad, F.raise_error(F.concat(F.col("path"), F.lit(": no list of polygons"))).cast("boolean")).otherwise(F.lit(True)))
    else:
        parsed = parsed.filter(~bad)
    rows = parsed.select("path", F.posexplode("_p").alias("polygon_idx", "p"))
    holes = F.transform(F.coalesce(F.col("p.holes"), F.array()), _rings)
    return rows.select("path", "polygon_idx", F.col("p.label").alias("label"), _rings(F.col("p.points")).alias("points"), holes.alias("holes"))


def project_polygons(texts: DataFrame) -> DataFrame:
    """(image, polygon_idx, label, points, holes) of project exports: a list of
    {image, annotations: [{type, name, points}]}. Only type Polygon; exteriors
    alone, as projects give them."""
    rows = texts.select(F.explode(F.from_json("text", _PROJECT)).alias("i")).select(F.col("i.image").alias("image"), F.posexplode("i.annotations").alias("polygon_idx", "a"))
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    return rows.filter(F.col("a.type") == "Polygon").select("image", "polygon_idx", F.col("a.name").alias("label"), _rings(F.col("a.points")).alias("points"), none.alias("holes"))


def polygons_json(polygons: DataFrame, key: str = "path") -> DataFrame:
    """(key, text): each key's polygons in order, as one JSON list."""
    pairs = lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))
    one = F.struct("polygon_idx", F.struct(pairs(F.col("points")).alias("points"), F.col("label").alias("label"), F.transform(F.coalesce("holes", F.array()), pairs).alias("holes")).alias("p"))
    return polygons.groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["p"]), {"ignoreNullFields": "false"}).alias("text"))


def write_polygons_json(polygons: DataFrame, folder: str, key: str = "path") -> DataFrame:
    """``<key>.json`` for each key under ``folder``; (path, n_bytes) of the files,
    lazily: evaluate it once, by storing it."""
    named = polygons_json(polygons, key).select(F.concat(F.lit(f"{folder}/"), F.col(key), F.lit(".json")).alias("path"), F.col("text").cast("binary").alias("data"))
    return save_bytes(named, "data")
