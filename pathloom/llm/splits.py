"""Training splits that keep related records together.

``components`` finds connected components by hash-to-min: every node holds a
cluster, at first itself and its neighbours; in a round it sends the cluster to
the cluster's smallest member and the smallest member to all others, until
nothing changes. Clusters are rows, never lists, so the cluster of a giant
component is spread like any other rows. ``assign_splits`` gives each
component a split by weighted rendezvous hashing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.skew import HOT_ROWS, hot_buckets, salted_join
from pathloom.runtime import discard, written

MAX_ROUNDS = 60


def star_edges(members: DataFrame, key: str, node: str, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Edges (a, b) that connect all nodes with equal keys: each node with the
    smallest one of its key, so a key with n nodes has n - 1 edges. Rows with a
    null take no part; ``members`` is read twice."""
    rows = members.select(F.col(key).alias("_k"), F.col(node).alias("a")).dropna()
    least = rows.groupBy("_k").agg(F.min("a").alias("b"), F.max("a").alias("_most"), F.count(F.lit(1)).alias("_n")).filter(F.col("b") != F.col("_most"))
    joined = salted_join(rows, least.select("_k", "b"), ["_k"], spread_by=["a"], hot=hot_buckets(least, ["_k"], hot_rows))
    return joined.filter(F.col("a") != F.col("b")).select("a", "b")


def components(edges: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is the
    smallest node of the component. Edges with a null end, loops and repeated
    edges change nothing. Each round is written to the shared folder, and the
    one before it deleted; the driver sees only a count and a hash of a round's
    clusters, taken while they are written.
    """
    spark = edges.sparkSession
    links = edges.select("a", "b").dropna()
    ends = F.explode(F.array(*[F.struct(F.col(v).alias("v"), F.col(u).alias("u")) for v, u in ("ab", "ba", "aa", "bb")])).alias("r")
    state = {"n": F.count(F.lit(1)), "mark": F.bit_xor(F.xxhash64("v", "u"))}
    clusters, path, now = written(links.select(ends).select("r.v", "r.u").distinct(), "clusters", **state)
    for _ in range(MAX_ROUNDS):
        least = clusters.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("_n"))
        joined = salted_join(clusters, least.select("v", "m"), ["v"], spread_by=["u"], hot=hot_buckets(least, ["v"], hot_rows))
        sent = joined.select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("r"))
        before, last = now, path
        clusters, path, now = written(sent.select("r.v", "r.u").distinct(), "clusters", **state)
        discard(spark, last)
        if before == now:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return clusters.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node")


def rendezvous(key: Column, weights: Mapping[str, float]) -> Column:
    """The split of a key: the largest of -weight / ln(hash of key and split),
    which gives each split its share and moves no key between two splits when
    another's weight changes."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("splits need positive weights")
    scores = []
    for name, weight in sorted(weights.items()):
        uniform = (F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(name)).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
        scores.append(F.struct((-F.lit(float(weight)) / F.log(uniform)).alias("score"), F.lit(name).alias("name")))
    return F.array_max(F.array(*scores))["name"]


def case_key(path: Column) -> Column:
    """The case named by a slide file: site letters, year and number from the
    last path component, however written; null where there is none."""
    name = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    pattern = r"(?<![a-z0-9])([a-z]{2})[ ._-]*(\d{2})[ ._-]*(\d+)"
    parts = [F.regexp_extract(name, pattern, i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.concat_ws("-", parts[0], parts[1], F.regexp_replace(parts[2], "^0+(?=.)", "")))


def vertex_set(points: Column) -> Column:
    """A ring's distinct vertices in order: equal however closed, turned or begun."""
    whole = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.array_sort(F.array_distinct(F.transform(whole, lambda p: F.struct((p["x"] + 0.0).alias("x"), (p["y"] + 0.0).alias("y")))))


def related_slides(slides: DataFrame, polygons: DataFrame) -> DataFrame:
    """(node, component) of the slides related to another: the same case, or
    polygons with the same label and vertex set (three vertices or more). The
    slides' keys are written once; a polygon's is a digest."""
    by_case = slides.select(F.col("slide_id").alias("node"), F.concat(F.lit("case "), case_key(F.col("wsi_file"))).alias("key"))
    sets = polygons.select(F.col("slide_id").alias("node"), "label", vertex_set(F.col("points")).alias("ring")).filter(F.col("label").isNotNull() & (F.size("ring") >= 3))
    by_ring = sets.select("node", F.sha2(F.to_json(F.struct("label", "ring")), 256).alias("key"))
    members = written(by_case.unionByName(by_ring).dropna().distinct(), "members")[0]
    return components(star_edges(members, "key", "node"))


def assign_splits(records: DataFrame, grouped: DataFrame, weights: Mapping[str, float], *, node: str) -> DataFrame:
    """(node, group_id, split) of every distinct node of ``records``; a node
    without relations is a group of its own. Null nodes take no part."""
    nodes = records.select(F.col(node).alias("_node")).dropna().distinct()
    named = nodes.join(grouped.select(F.col("node").alias("_n"), "component"), F.col("_node") == F.col("_n"), "left")
    group = F.coalesce("component", "_node")
    return named.select(F.col("_node").alias(node), group.alias("group_id"), rendezvous(group, weights).alias("split"))
