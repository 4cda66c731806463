import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from pathloom.llm import canonical

ROWS = "id long, value string, score string"
GROUPS = "group_id int, group_name string"
LIST = [(1, "Tumor center"), (2, "Smooth muscle bundle"), (3, "Tissue fold"), (4, "Adipose tissue"), (5, "Prostatic acinus"), (6, "Stain precipitate"), (7, "Pen marking")]
CASES = [
    ("Tumor center", 1), ("  CENTER, TUMOR ", 1), ("3. tumour-céntre (2)", 1), ("Tumorcenter", 1), ("Tumor cente.", 1), ("TMUOR CEENTER?", 1),
    ("smoot. musclebundle", 2), ("bundle smooth muscles", 2), ("tissue folds", 3), ("Adip.tissue", 4), ("PROSTATIC ACUIS", 5), ("markingpen", 7), (" stain__precipitate #4", 6),
    ("lunch", 0), ("tissue", 0), ("", 0), ("17", 0), ("?", 0), ("tumor tissue fold pen", 0), ("xx " * 5000, 0), ("None", 0),
]


def test_cases(spark):
    data = [(i, v, "clash") for i, (v, _) in enumerate(CASES)]
    df = spark.createDataFrame([*data, data[0], (None, "Tumor center", ""), (99, None, "")], ROWS)
    got = canonical.map_to_canonical(df, spark.createDataFrame(LIST, GROUPS), id_col="id", value_col="value")
    assert got.count() == len(CASES) + 1
    assert {r.id: r.group_id for r in got.collect()} == {i: g for i, (_, g) in enumerate(CASES)}


def test_empty_tables_and_ties(spark):
    df, groups = spark.createDataFrame([(1, "pen marking", "")], ROWS), spark.createDataFrame(LIST, GROUPS)
    run = lambda a, b: rows(canonical.map_to_canonical(a, b, id_col="id", value_col="value").select("id", "group_id"))
    assert run(df.limit(0), groups) == []
    assert run(df, groups.limit(0)) == [(1, 0)]
    assert run(df, spark.createDataFrame([(1, "Pen marking"), (2, "Marking pen"), (3, None)], GROUPS)) == [(1, 0)]


def test_expressions_equal_the_plain_definitions(spark):
    rng = random.Random(6)
    pairs = {("abc", "ca"), ("ca", "abc"), ("", "ab"), ("ab", ""), ("a", "a"), ("abcd", "badc"), ("tmuor", "tumor"), ("straße", "strasse")}
    while len(pairs) < 600:
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
        pairs.add((a, b))
    df = spark.createDataFrame(sorted(pairs), "a string, b string")
    got = df.select("a", "b", canonical.near_edits(F.col("a"), F.col("b")).alias("d"), canonical.keys_of(F.col("a")).alias("keys")).collect()
    for r in got:
        assert r.d == min(3, canonical.edits(r.a, r.b, 9)), (r.a, r.b)
        assert set(r["keys"]) == canonical.neighbourhood(r.a, 2 if len(r.a) >= 4 else 1)


def test_long_tokens_share_a_key_of_their_beginnings():
    rng = random.Random(8)
    for _ in range(300):
        a = [rng.choice("abcdef") for _ in range(rng.randint(41, 60))]
        b = list(a)
        for _ in range(2):
            i, kind = rng.randrange(len(b) - 1), rng.randrange(4)
            if kind == 0:
                b.insert(i, rng.choice("abcdef"))
            elif kind == 1:
                b.pop(i)
            elif kind == 2:
                b[i] = rng.choice("abcdef")
            else:
                b[i], b[i + 1] = b[i + 1], b[i]
        n = canonical.KEY_LETTERS
        assert canonical.neighbourhood("".join(a[:n]), 2) & canonical.neighbourhood("".join(b[:n]), 2)


def corrupted(rng, name):
    """A name as people type it: an edit or two, another case or order, a missing space."""
    words = name.lower().split()
    for _ in range(rng.choice([0, 1, 1, 2])):
        k = rng.randrange(len(words))
        w = words[k]
        if len(w) < 5:
            continue
        i = rng.randrange(len(w) - 1)
        words[k] = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeiorst") + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + rng.choice("aeiorst") + w[i + 1 :]])
    if rng.random() < 0.2:
        rng.shuffle(words)
    text = ("" if rng.random() < 0.1 else " ").join(words)
    return rng.choice([text, text.upper(), f" {text}. "])


def test_threshold_on_held_out_corruptions(spark):
    """Precision and recall over thresholds; the one in use is at the best of both."""
    rng = random.Random(21)
    others = ["lunch break", "tissue only", "ask colleague", "center", "muscle pain", "smooth operator", "scan again", "left half", "fold here", "not sure", "old pen", "stain", "wrong slide", "batch"]
    truth = [(i, corrupted(rng, name), gid) for i, (gid, name) in enumerate(LIST * 40)] + [(1000 + i, t, 0) for i, t in enumerate(others * 4)]
    df = spark.createDataFrame([(i, v, "") for i, v, _ in truth], ROWS)
    best = canonical.map_to_canonical(df, spark.createDataFrame(LIST, GROUPS), id_col="id", value_col="value", threshold=0.3)
    found = {r.id: (r.group_id, r.score) for r in best.collect()}

    def quality(threshold):
        hits = sum(1 for i, _, g in truth if g and found[i][0] == g and found[i][1] >= threshold)
        claimed = sum(1 for i, _, _ in truth if found[i][0] and found[i][1] >= threshold)
        return hits / claimed, hits / sum(1 for *_, g in truth if g)

    precision, recall = quality(canonical.THRESHOLD)
    assert precision >= 0.99 and recall >= 0.95
    assert quality(0.5)[0] < precision and quality(0.95)[1] < recall


def test_edit_distance_and_neighbourhood():
    rng = random.Random(4)
    near = {}
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(b) + 1)
            kind = rng.randrange(3)
            if kind == 0:
                b.insert(i, rng.choice("abc"))
            elif b and kind == 1:
                b.pop(min(i, len(b) - 1))
            elif i + 1 < len(b):
                b[i], b[i + 1] = b[i + 1], b[i]
        b = "".join(b)
        near[a, b] = canonical.edits(a, b, 9)
        assert near[a, b] <= 2
        assert canonical.neighbourhood(a, 2) & canonical.neighbourhood(b, 2)
    assert canonical.edits("acuis", "acinus", 2) == 2
    assert canonical.edits("abc", "xyz", 2) == 3


@pytest.mark.parametrize("vendor,own,name,want", [("asap", "a", "b", "a"), ("asap", " NONE ", "b", "b"), ("asap", None, "Annotation 7", None), ("sedeen", "x", " region 12 ", None), ("asap", "", None, None), ("asap", " ", "mark 3", "mark 3")])
def test_annotation_value(spark, vendor, own, name, want):
    df = spark.createDataFrame([(vendor, own, None, name)], "vendor string, part_of_group string, ann_description string, ann_name string")
    assert df.select(canonical.annotation_value()).first()[0] == want
