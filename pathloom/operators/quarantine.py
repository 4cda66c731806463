"""Delimited lines: load the valid ones, set each broken one apart with its reason.

A block of lines goes through one bulk parse (the Arrow CSV reader) and a few
columnar checks. A mask over the block, one compiled pattern, tells which lines
can't have the right fields; the block is cut at these, and the stretches
between are parsed together. A block that still doesn't parse is cut in two and
each half tried again, down to one line. Lines that were cut out, and parsed
ones whose columns fail a check, go one by one to a strict reader that names
the first rule they break, or finds them valid.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines parsed at once.
BLOCK_ROWS = 4096
_FIELD = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'


@dataclass(frozen=True)
class LineFormat:
    """How the lines of one vendor look. ``point_counts``: type -> (least, most)
    points, ``most`` None for no limit. ``point``: pattern of one point."""

    columns: tuple[str, ...]
    type_index: int
    points_index: int
    point_counts: Mapping[str, tuple[int, int | None]]
    point: str


def rfc4180_fields(line: str) -> list[str] | None:
    """The fields of a line, or None where its quoting isn't RFC 4180: a quote
    inside an unquoted field, text after a closing quote, no closing quote."""
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            start, i = i + 1, i + 1
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                if line[j + 1 : j + 2] == '"':
                    i = j + 2
                    continue
                break
            fields.append(line[start:j].replace('""', '"'))
            i = j + 1
            if i < n and line[i] != ",":
                return None
        else:
            j = line.find(",", i)
            j = n if j < 0 else j
            if '"' in line[i:j]:
                return None
            fields.append(line[i:j])
            i = j
        if i >= n:
            return fields
        i += 1


class _Checker:
    """The rules of one format, for one line and for columns of a whole block."""

    def __init__(self, form: LineFormat):
        self.form = form
        self.point = re.compile(form.point)
        self.list_pattern = rf"\A *{form.point} *(?:; *{form.point} *)*\z"
        self.row_pattern = rf"(?s)\A{_FIELD}(?:,{_FIELD}){{{len(form.columns) - 1}}}\z"

    def diagnose(self, line: str) -> tuple[str | None, list[str]]:
        fields = rfc4180_fields(line)
        if fields is None:
            return "quoting", []
        if len(fields) != len(self.form.columns):
            return "column_count", []
        least_most = self.form.point_counts.get(fields[self.form.type_index])
        if least_most is None:
            return "bad_type", []
        points = [p.strip(" ") for p in fields[self.form.points_index].split(";")]
        if not all(self.point.fullmatch(p) for p in points):
            return "bad_coordinates", []
        if len(points) < least_most[0] or least_most[1] is not None and len(points) > least_most[1]:
            return "point_count", []
        return None, fields

    def bulk(self, lines: pa.Array) -> tuple[list[pa.Array], pa.Array] | None:
        """The block's columns and which of its rows break no rule; None where
        the block as a whole doesn't parse to a row a line."""
        n, names = len(lines), [str(i) for i in range(len(self.form.columns))]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), lines), "\n")[0].as_buffer()
        try:
            block = pacsv.read_csv(
                pa.BufferReader(joined),
                read_options=pacsv.ReadOptions(column_names=names, use_threads=False, block_size=joined.size + 16),
                parse_options=pacsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False),
                convert_options=pacsv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False),
            )
        except pa.ArrowInvalid:
            return None
        if block.num_rows != n:
            return None
        columns = [c.combine_chunks() for c in block.columns]
        kinds, places = columns[self.form.type_index], columns[self.form.points_index]
        counts = pc.add(pc.count_substring(places, ";"), 1)
        allowed = pa.array([False] * n)
        for kind, (least, most) in self.form.point_counts.items():
            fits = pc.and_(pc.equal(kinds, kind), pc.greater_equal(counts, least))
            allowed = pc.or_(allowed, fits if most is None else pc.and_(fits, pc.less_equal(counts, most)))
        return columns, pc.and_(allowed, pc.match_substring_regex(places, self.list_pattern))

    def split(self, lines: pa.Array) -> Iterator[tuple[np.ndarray, list[pa.Array] | None, list[str | None]]]:
        """(places, columns or None, reasons): every line in one of them."""
        sure = pc.match_substring_regex(lines, self.row_pattern).to_numpy(zero_copy_only=False)
        places, doubted = np.flatnonzero(sure), [np.flatnonzero(~sure)]
        todo = [places[i : i + BLOCK_ROWS] for i in range(0, len(places), BLOCK_ROWS)]
        while todo:
            at = todo.pop()
            parsed = self.bulk(lines.take(pa.array(at)))
            if parsed is not None:
                columns, good = parsed
                own = good.to_numpy(zero_copy_only=False)
                yield at[own], [c.filter(good) for c in columns], [None] * int(own.sum())
                doubted.append(at[~own])
            elif len(at) == 1:
                doubted.append(at)
            else:
                todo += [at[len(at) // 2 :], at[: len(at) // 2]]
        at = np.concatenate(doubted)
        if len(at):
            found = [self.diagnose(line) for line in lines.take(pa.array(at)).to_pylist()]
            bad = np.array([reason is not None for reason, _ in found])
            yield at[bad], None, [reason for reason, _ in found if reason]
            if not bad.all():
                valid = [fields for reason, fields in found if not reason]
                yield at[~bad], [pa.array(c, pa.string()) for c in zip(*valid)], [None] * len(valid)


def parse_lines(
    df: DataFrame,
    formats: Mapping[str, LineFormat],
    *,
    id_col: str = "line_id",
    vendor_col: str = "vendor",
    line_col: str = "line_text",
) -> DataFrame:
    """Every line of ``df``, parsed or with its reason: id, vendor, ``reason``
    (null for a valid line) and ``fields`` (array of strings, null for a broken
    one). No line is lost or repeated.

    reason is the first that applies of quoting, column_count, bad_type,
    bad_coordinates, point_count. A leading byte-order mark and one trailing
    line end (CR, LF or CRLF) are no errors. An empty line has one column; a
    null line has none (both: column_count). A vendor without a format knows no
    type, so its well-quoted lines of the common width are bad_type. Repeated
    ids are repeated in the result; other columns are ignored.
    """
    checkers = {v: _Checker(f) for v, f in formats.items()}
    other = _Checker(LineFormat(next(iter(formats.values())).columns, 1, -1, {}, r"(?:a^)"))
    source = df.select(F.col(id_col).alias("id"), F.col(vendor_col).alias("vendor"), F.col(line_col).alias("line"))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(vendor_col, T.StringType()), T.StructField("reason", T.StringType()), T.StructField("fields", T.ArrayType(T.StringType()))])
    lists = pa.list_(pa.field("element", pa.string()))

    def fields_of(columns: list[pa.Array]) -> pa.Array:
        width, n = len(columns), len(columns[0])
        order = np.arange(width * n).reshape(width, n).T.ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.concat_arrays(columns).take(pa.array(order))).cast(lists)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vendors, lines = batch.columns
            lines = pc.replace_substring_regex(pc.replace_substring_regex(lines, "\\A\ufeff", ""), r"(?:\r\n|\r|\n)\z", "")
            for vendor in pc.unique(vendors).to_pylist():
                mine = pc.fill_null(pc.equal(vendors, vendor), False) if vendor is not None else pc.is_null(vendors)
                own_ids, own = pc.filter(ids, mine), pc.filter(lines, mine)
                none = pc.is_null(own)
                reasons, parts, order = [], [], []
                missing = np.flatnonzero(none.to_numpy(zero_copy_only=False))
                if len(missing):
                    reasons += ["column_count"] * len(missing)
                    parts.append(pa.nulls(len(missing), lists))
                    order.append(missing)
                there = np.flatnonzero(~none.to_numpy(zero_copy_only=False))
                for at, columns, why in checkers.get(vendor, other).split(own.take(pa.array(there))):
                    reasons += why
                    parts.append(pa.nulls(len(at), lists) if columns is None else fields_of(columns))
                    order.append(there[at])
                n = len(own_ids)
                arrays = [own_ids.take(pa.array(np.concatenate(order))), pa.array([vendor] * n, pa.string()), pa.array(reasons, pa.string()), pa.concat_arrays(parts)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


_COUNT = {1: (1, 1), 2: (2, 2), 4: (4, 4), 3: (3, None)}
_NUMBER_ASAP, _NUMBER = r"[+-]?[0-9]+(?:[.,][0-9]+)?", r"[+-]?[0-9]+(?:\.[0-9]+)?"

#: Annotation exports: the two vendors' columns, types and point lists.
ANNOTATION_FORMATS = {
    "asap": LineFormat(
        ("wsi_file", "Type", "Name", "PartOfGroup", "Color", "Coordinates"),
        1,
        5,
        {"Polygon": _COUNT[3], "Spline": _COUNT[3], "Rectangle": _COUNT[4], "Dot": _COUNT[1], "Measurement": _COUNT[2]},
        f"{_NUMBER_ASAP} +{_NUMBER_ASAP}",
    ),
    "sedeen": LineFormat(
        ("identifier", "type", "name", "description", "color", "point-list"),
        1,
        5,
        {"polygon": _COUNT[3], "rectangle": _COUNT[4], "ellipse": _COUNT[4]},
        f"{_NUMBER},{_NUMBER}",
    ),
}


def annotations_from_lines(parsed: DataFrame, *, id_col: str = "line_id") -> DataFrame:
    """The valid rows of ``parse_lines`` under common names, with their points
    as ARRAY<STRUCT<x DOUBLE, y DOUBLE>>."""
    f = lambda i: F.element_at("fields", i + 1)
    number = lambda s: F.regexp_replace(s, ",", ".").cast("double")

    def point(p):
        parts = F.when(F.col("vendor") == "asap", F.split(F.trim(p), " +")).otherwise(F.split(F.trim(p), ","))
        return F.struct(number(parts[0]).alias("x"), number(parts[1]).alias("y"))

    return parsed.filter(F.col("reason").isNull()).select(
        id_col,
        "vendor",
        f(0).alias("wsi_file"),
        f(1).alias("ann_type"),
        f(2).alias("ann_name"),
        f(3).alias("group_text"),
        f(4).alias("ann_color"),
        F.transform(F.split(f(5), ";"), point).alias("coordinates"),
    )
