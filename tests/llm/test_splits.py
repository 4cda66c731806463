import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from pathloom.llm import splits


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sorted(((x, find(x)) for x in list(parent)), key=repr)


@pytest.mark.parametrize("hot", [10, 10_000])
def test_components_against_union_find(spark, hot):
    rng = random.Random(7)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 901 + i) for i in range(60)] + [(5, 5), (None, 3), (7, None)]
    got = splits.components(spark.createDataFrame(edges, "a long, b long"), hot_rows=hot)
    assert rows(got.select("node", "component")) == union_find(edges)


def test_empty_edges(spark):
    assert splits.components(spark.createDataFrame([], "a long, b long")).count() == 0


NAMES = {
    "/wsi/reference/QK-10-984568_HE.svs": "qk-10-984568", "scans\\x\\wt09-009271-F7.svs": "wt-09-9271", "he__Wt-09-9271__D8.tiff": "wt-09-9271", "E7_MG-24_003573.mrxs": "mg-24-3573",
    "a/YX15.006805.E8.tif": "yx-15-6805", "a/JR 16 9708 (rescan).svs": "jr-16-9708", "copy of wt-23-002117.tif": "wt-23-2117", "FW21002566.tiff": "fw-21-2566", "KD-10-12/no label.svs": None, "scan (76).mrxs": None, "tray 31.tif": None, None: None,
}


def test_case_key(spark):
    df = spark.createDataFrame([(k,) for k in NAMES], "f string")
    assert {r.f: r.c for r in df.select("f", splits.case_key(F.col("f")).alias("c")).collect()} == NAMES


def test_related_slides(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]
    slides = spark.createDataFrame([("a", "x/WT-09-009271.svs", 1), ("b", "y/wt 09 9271.tif", 1), ("c", None, 1), ("d", "none.svs", 1), ("e", "none.svs", 1), ("a", "x/WT-09-009271.svs", 1), (None, "WT-09-9271", 1)], "slide_id string, wsi_file string, node int")
    polygons = spark.createDataFrame(
        [("b", "t", ring), ("c", "t", [*ring[1:], ring[0], ring[1]]), ("d", None, ring), ("e", "u", ring), ("d", "t", ring[:2] * 2), ("e", "t", None), (None, "t", ring), ("d", "t", [(0.0, 0.0), (1.0, 0.0), (1.0, 2.0)])],
        "slide_id string, label string, points array<struct<x:double,y:double>>",
    )
    grouped = splits.related_slides(slides, polygons)
    assert rows(grouped.select("node", "component")) == [("a", "a"), ("b", "a"), ("c", "a")]
    out = splits.assign_splits(slides.select("slide_id"), grouped, {"train": 0.7, "test": 0.3}, node="slide_id")
    assert {r.slide_id: r.group_id for r in out.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    assert out.filter("group_id = 'a'").select("split").distinct().count() == 1


def test_rendezvous_shares_and_stability(spark):
    df = spark.range(20_000).select("id", splits.rendezvous(F.col("id"), {"train": 0.7, "validation": 0.15, "test": 0.15}).alias("s"), splits.rendezvous(F.col("id"), {"train": 0.7, "validation": 0.15, "test": 0.6}).alias("more"))
    shares = {r.s: r["count"] / 20_000 for r in df.groupBy("s").count().collect()}
    assert abs(shares["train"] - 0.7) < 0.015 and abs(shares["test"] - 0.15) < 0.015
    assert df.filter("s <> more and more <> 'test'").count() == 0
    with pytest.raises(ValueError):
        splits.rendezvous(F.col("id"), {"train": 0.0})


def test_shares_over_components_of_uneven_size(spark):
    """Whole components go to a split; over many components the slides' shares are the wanted ones."""
    rng = random.Random(12)
    data, n = [], 0
    for g in range(4000):
        size = rng.choice([1, 1, 2, 3, 8])
        data += [(n + i, n) for i in range(size)]
        n += size
    grouped = spark.createDataFrame(data, "node long, component long")
    out = splits.assign_splits(grouped, grouped, {"train": 0.7, "validation": 0.15, "test": 0.15}, node="node")
    shares = {r.split: r["count"] / n for r in out.groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.7) < 0.03 and abs(shares["validation"] - 0.15) < 0.03 and abs(shares["test"] - 0.15) < 0.03
    assert out.groupBy("group_id").agg(F.countDistinct("split").alias("k")).filter("k > 1").count() == 0
