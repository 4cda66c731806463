import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from pathloom.operators.quarantine import ANNOTATION_FORMATS, _Checker, annotations_from_lines, parse_lines, rfc4180_fields

LINES = "line_id long, vendor string, line_text string, reason string"
GOOD = 'a.svs,Polygon,"x, ""y""",None,#fff,"1,5 2;-3 4.5; 5 6"'
CASES = [
    ("asap", GOOD, None),
    ("asap", "﻿" + GOOD + "\r", None),
    ("asap", "a,Polygon,x\"y,None,#f,1 2;3 4;5 6", "quoting"),
    ("asap", 'a,Polygon,"x"y,None,#f,1 2;3 4;5 6', "quoting"),
    ("asap", 'a,Polygon,x,None,#f,"1 2;3 4;5 6', "quoting"),
    ("asap", ' "a",Polygon,x,None,#f,1 2;3 4;5 6', "quoting"),
    ("asap", "a,Polygon,x,None,#f,y,1 2;3 4;5 6", "column_count"),
    ("asap", "", "column_count"),
    ("asap", None, "column_count"),
    ("asap", "a,polygon,x,None,#f,1 2;3 4;5 6", "bad_type"),
    ("asap", "a,,x,None,#f,", "bad_type"),
    ("asap", "a,Dot,x,None,#f,", "bad_coordinates"),
    ("asap", "a,Dot,x,None,#f,1e5 2", "bad_coordinates"),
    ("asap", "a,Dot,x,None,#f,1 2;", "bad_coordinates"),
    ("asap", "a,Dot,x,None,#f,NaN 2", "bad_coordinates"),
    ("asap", "a,Dot,x,None,#f,1 2; 3 4", "point_count"),
    ("asap", "a,Rectangle,x,None,#f,1 2;3 4;5 6", "point_count"),
    ("asap", "a,Measurement,x,None,#f,+1 2; 3 -4", None),
    ("sedeen", 'a,ellipse,x,None,#f,"1,2;3,4; 5.5,6;7,8"', None),
    ("sedeen", 'a,ellipse,x,None,#f,"1 2;3,4;5,6;7,8"', "bad_coordinates"),
    ("sedeen", 'a,polygon,x,None,#f,"1,2;3,4"', "point_count"),
    ("other", "a,polygon,x,None,#f,z", "bad_type"),
    (None, "a,polygon", "column_count"),
    ("sedeen", 'a,polygon,"two\nlines",None,#f,"' + ";".join(["1.0,2.0"] * 20_000) + '"', None),
]


@pytest.mark.parametrize("copies", [1, 40])
def test_reasons(spark, copies):
    data = [(i * copies + k, v, t, "clash") for i, (v, t, _) in enumerate(CASES) for k in range(copies)]
    got = {r.line_id: r.reason for r in parse_lines(spark.createDataFrame(data, LINES), ANNOTATION_FORMATS).collect()}
    assert got == {i * copies + k: r for i, (_, _, r) in enumerate(CASES) for k in range(copies)}


def test_values_and_empty_table(spark):
    df = spark.createDataFrame([(1, "asap", GOOD, ""), (1, "asap", GOOD, ""), (2, "sedeen", 'b,polygon,"",d,#f,"1,2;3,4;5,6"', "")], LINES)
    parsed = parse_lines(df, ANNOTATION_FORMATS)
    assert parsed.count() == 3
    valid = annotations_from_lines(parsed).distinct()
    assert rows(valid.select("line_id", "ann_name", "coordinates")) == [(1, 'x, "y"', [(1.5, 2.0), (-3.0, 4.5), (5.0, 6.0)]), (2, "", [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)])]
    assert parse_lines(df.limit(0), ANNOTATION_FORMATS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab,"; 1\n\r', max_size=6), min_size=6, max_size=6), min_size=1, max_size=12))
def test_bulk_and_strict_agree(fields):
    """What the bulk path accepts, the strict reader accepts with equal fields."""
    import pyarrow as pa

    checker = _Checker(ANNOTATION_FORMATS["asap"])
    lines = []
    for f in fields:
        f = [f[0], "Dot", f[2], f[3], f[4], "1 2"]
        lines.append(",".join('"' + x.replace('"', '""') + '"' if len(x) % 2 else x for x in f))
    seen = []
    for places, columns, reasons in checker.split(pa.array(lines)):
        assert len(places) == len(reasons)
        for k, i in enumerate(places.tolist()):
            strict = checker.diagnose(lines[i])
            assert strict[0] == reasons[k]
            if columns is not None:
                assert [c[k].as_py() for c in columns] == strict[1]
        seen += places.tolist()
    assert sorted(seen) == list(range(len(lines)))


def test_fields_of_quoted_text():
    assert rfc4180_fields('"a""b",c,') == ['a"b', "c", ""]
    assert rfc4180_fields('""') == [""]
    assert rfc4180_fields('"') is None
