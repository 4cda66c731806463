import json

from conftest import rows
from pathloom.operators import nested

G = nested.SESSION_GRAMMAR
SESSIONS = "session_id long, body string, element string"


def sessions(spark, bodies):
    return spark.createDataFrame([(i, b if b is None or isinstance(b, str) else json.dumps(b), "clash") for i, b in enumerate(bodies)], SESSIONS)


def shred(spark, bodies, **k):
    return nested.shred(sessions(spark, bodies), G, id_col="session_id", body_col="body", root="session", **k)


def graph(spark, bodies, **k):
    return nested.schema_graph(sessions(spark, bodies), G, body_col="body", root="session", **k)


def vertices(spark, bodies):
    return rows(shred(spark, bodies, only=["vertex"], attributes=False).select("session_id", "object_no", "ring_no", "vertex_no"))


P = {"Order": "0", "X": "1", "Y": "2"}


def test_vendor_trees(spark):
    asap = {"ASAP_Annotations": {"Annotations": {"Annotation": {"Coordinates": {"Coordinate": [{"Order": "1", "X": "1", "Y": "2"}, P]}}}, "AnnotationGroups": {"Group": {"Name": "g", "Annotations": [{"Coordinates": P}], "Group": [{"Name": "h", "Annotations": [{"Name": "none"}, {"Coordinates": [P]}]}]}}}}
    sedeen = {"session": {"image": [{"overlays": {"graphic": [{"point-list": [{"point": "1,2"}, {"point": "3,4"}]}]}}, {"overlays": None}, {"overlays": [{"pen": {"color": "#f"}, "point-list": {"point": ["1,2"]}}]}]}}
    plain = {"project": {"images": [{"image": "a", "polygons": [{"points": [[1, 2]], "children": {"points": [{"x": 1, "y": 2}], "holes": None}, "holes": [[[1, 2], [3, 4]], None, [[5, 6]]]}]}]}}
    assert vertices(spark, [asap, sedeen, plain]) == [
        (0, 0, 0, 0), (0, 0, 0, 1), (0, 1, 0, 0), (0, 3, 0, 0),
        (1, 0, 0, 0), (1, 0, 0, 1), (1, 1, 0, 0),
        (2, 0, 0, 0), (2, 0, 1, 0), (2, 0, 1, 1), (2, 0, 3, 0), (2, 1, 0, 0),
    ]


def test_odd_bodies(spark):
    deep = "[" * 5000 + "]" * 5000
    bodies = [None, "", "{", "[]", "{}", "null", "3", deep, [{"points": [[1, 2]]}], {"points": [[1, 2]], "label": None}]
    assert vertices(spark, bodies) == [(8, 0, 0, 0), (9, 0, 0, 0)]
    assert shred(spark, bodies).filter("element = 'session'").count() == len(bodies)
    assert shred(spark, []).count() == 0


def test_graph_plan_and_tables(spark):
    bodies = [
        {"session": {"version": "1", "image": [{"identifier": "i", "transform": {"rotation": {"units": "deg"}}, "overlays": [{"name": "n", "pen": {"color": "#f"}, "tags": ["a", "b"], "point-list": ["1,2", "3,4"]}]}]}},
        [{"label": "t", "points": [[1, 2]], "children": [{"label": "u", "points": [[3, 4]], "holes": [[[1, 1]]]}]}],
    ]
    found = shred(spark, bodies)
    plan = nested.inline_plan(graph(spark, bodies))
    assert {e: p["why"] for e, p in plan.items()} == {"session": "root", "image": "inlined", "object": "recursive", "object_tags": "repeated", "ring": "repeated", "vertex": "repeated", "pen": "inlined", "transform": "inlined", "rotation": "inlined"}
    out = nested.tables(found, plan, G, id_col="session_id")
    assert set(out) == {"session", "object", "object_tags", "ring", "vertex"}
    assert rows(out["session"].select("session_id", "version", "image_identifier", "image_transform_rotation_units")) == [(0, "1", "i", "deg"), (1, None, None, None)]
    objects = out["object"].select("session_id", "object_no", "parent_object_no", "name", "label", "pen_color")
    assert rows(objects) == [(0, 0, None, "n", None, "#f"), (1, 0, None, None, "t", None), (1, 1, 0, None, "u", None)]
    assert rows(out["object_tags"].select("object_no", "object_tags_no", "value")) == [(0, 0, "a"), (0, 1, "b")]
    joined = out["vertex"].join(out["ring"], ["session_id", "object_no", "ring_no"]).join(out["object"], ["session_id", "object_no"])
    assert joined.count() == out["vertex"].count() == 5


def test_shared_singleton_gets_a_table(spark):
    bodies = [{"session": {"meta": {"by": "a"}, "image": [{"meta": {"by": "b"}}, {"x": 1}]}}]
    found = shred(spark, bodies)
    plan = nested.inline_plan(graph(spark, bodies))
    assert plan["meta"]["why"] == "shared"
    out = nested.tables(found, plan, G, id_col="session_id")
    assert rows(out["meta"].select("parent_element", "image_no", "by")) == [("image", 0, "b"), ("session", None, "a")]


def test_no_depth_limit(spark):
    depth = 20_000
    children = '{"points": [[1, 2]], "children": [' * depth + '{"points": [[1, 2]]}' + "]}" * depth
    wrapped = '{"a": ' * depth + '{"label": "t"}' + "}" * depth
    assert len(vertices(spark, [children])) == depth + 1
    found = shred(spark, [children], only=["object"]).filter("object_no = 20000").select("parent_no").first()
    assert found[0] == depth - 1
    assert nested.inline_plan(graph(spark, [children]))["object"]["why"] == "recursive"
    assert shred(spark, [wrapped]).count() == 1


def test_deep_reader_agrees_with_the_usual_one():
    texts = ['{"a": [1, -2.5e3, true, null, "\\u00e9\\n", {}, [], {"b": [[], {}]}], "c": "x" }', "[]", " 3 ", '"s"', "[1, 2", "[1,]", "{1: 2}", '{"a" 1}', "[1] 2", "", "[}", "nul", '{"a": 1,}', '["\n"]', "[1 2]", "01"]
    for text in texts:
        try:
            expected = json.loads(text, parse_float=str, parse_int=str, parse_constant=str)
        except ValueError:
            expected = ValueError
        try:
            got = nested._read_deep(text)
        except ValueError:
            got = ValueError
        assert got == expected, text


def test_keys_that_are_data_become_rows(spark):
    bodies = [[{"points": [[1, 2]], "scores": {f"k{i}": i for i in range(30)}, f"list{j}": [{"v": j}]}] for j in range(3)]
    edges = graph(spark, bodies, max_edges=20)
    plan = nested.inline_plan(edges)
    assert plan["object"]["open"] and not plan["object"]["columns"] and len(edges) < 10
    out = nested.tables(shred(spark, bodies), plan, G, id_col="session_id")
    entries = rows(out["object_entries"].select("session_id", "element", "path", "value"))
    assert len(entries) == 3 * 31 and (2, "object_list2", "v", "2") in entries and (0, "object", "scores.k7", "7") in entries
    assert "scores_k7" not in out["object"].columns and out["object"].count() == 3


def test_kept_elements_have_a_table(spark):
    plan = nested.inline_plan(graph(spark, [{"points": [[1, 2]]}]), keep=("vertex",))
    assert plan["vertex"]["why"] == "kept" and plan["ring"]["why"] == "inlined"
