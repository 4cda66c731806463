import random

from pyspark.sql import functions as F

from conftest import rows
from pathloom.operators.skew import BUCKETS, eager_join_aggregate, hot_buckets, later_repeats, lookup_join, salted_join, with_salts

PATCH = "patch_id long, wsi_file string, x long, label string, _n int, _first string"
KEY = ["wsi_file", "x", "label"]


def brute(data):
    return sorted({(p[0],) for p in data for q in data if p[1] is not None and p[0] is not None and q[0] is not None and q[0] < p[0] and q[1:4] == p[1:4]}, key=repr)


def test_later_repeats_against_brute_force_with_hot_keys(spark):
    rng = random.Random(1)
    data = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([1, 2]), rng.choice([None, "t"]), 1, "clash") for i in range(300)]
    df = spark.createDataFrame(data, PATCH)
    for hot in (10, 10_000):
        assert rows(later_repeats(df, KEY, "patch_id", required=["wsi_file"], hot_rows=hot)) == brute(data)


def test_later_repeats_edges(spark):
    assert rows(later_repeats(spark.createDataFrame([], PATCH), KEY, "patch_id", required=["wsi_file"])) == []
    data = [(1, "a", None, None, 1, ""), (2, "a", None, None, 1, ""), (None, "a", None, None, 1, ""), (3, None, 1, "t", 1, ""), (4, None, 1, "t", 1, ""), (1, "a", None, None, 1, "")]
    assert rows(later_repeats(spark.createDataFrame(data, PATCH), KEY, "patch_id", required=["wsi_file"])) == [(2,)]


def test_every_hot_key_is_split_however_many(spark):
    counts = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.lit(10).cast("long").alias("_n"))
    hot = hot_buckets(counts, ["k"], 5)
    assert hot.count() <= BUCKETS
    assert with_salts(counts, ["k"], hot).filter("_salts < 3").count() == 0
    data = [(i, f"w{i % 7}", i % 3, None, 1, "") for i in range(2000)]
    df = spark.createDataFrame(data, PATCH)
    assert rows(later_repeats(df, KEY, "patch_id", required=["wsi_file"], hot_rows=20)) == brute(data)


def test_salted_join_keeps_every_pair(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else "k%d" % i) for i in range(200)] + [(999, None)], "id int, k string")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("k6", 4), (None, 5)], "k string, v int")
    plain = rows(left.join(right, "k").select("id", "k", "v"))
    for hot in (5, 10_000):
        assert rows(salted_join(left, right, ["k"], spread_by=["id"], hot_rows=hot).select("id", "k", "v")) == plain
    with_null = rows(salted_join(left, right, ["k"], spread_by=["id"], hot_rows=5, null_safe=True).select("id", "k", "v"))
    assert len(with_null) == len(plain) + 1


def test_eager_join_aggregate_equals_the_join(spark):
    left = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "y", None), (None, "x", 9), ("b", "z", 4)], "k string, g string, v int")
    right = spark.createDataFrame([("a", 10), ("a", 20), (None, 1), ("c", 5)], "k string, w int")
    joined = left.join(right, "k").groupBy("k", "g").agg(F.count("*").alias("n_pairs"), F.sum("v").alias("sum_v"), F.sum("w").alias("sum_w"))
    got = eager_join_aggregate(left, right, ["k"], left_sums=["v"], right_sums=["w"], left_group=["g"])
    assert rows(got) == rows(joined)
    assert eager_join_aggregate(left.limit(0), right, ["k"]).count() == 0
    assert ("n_pairs" in got.columns) and got.filter("k is null").count() == 0


def test_lookup_join_is_the_same_either_way(spark):
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"s{i % 40}", {"k": i}) for i in range(300)] + [(900, None, None)], "id int, slide_id string, m map<string,int>")
    right = spark.createDataFrame([("hot", 1), ("s0", 2), ("s8", 3), (None, 4)], "slide_id string, v int")
    for null_safe in (False, True):
        same = F.col("slide_id").eqNullSafe(F.col("o")) if null_safe else F.col("slide_id") == F.col("o")
        want = rows(left.join(right.withColumnRenamed("slide_id", "o"), same).select("id", "slide_id", "v"))
        for most in (2, 100):
            got = lookup_join(left, right, ["slide_id"], null_safe=null_safe, most=most, hot_rows=20)
            assert rows(got.select("id", "slide_id", "v")) == want


def test_a_hot_slide_is_spread_over_tasks(spark):
    left = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id"))).alias("slide_id"))
    right = left.select("slide_id").distinct()
    joined = lookup_join(left, right, ["slide_id"], most=10, hot_rows=200).filter("slide_id = 'hot'")
    assert joined.count() == 2000
    with_part = joined.groupBy(F.spark_partition_id()).count().collect()
    assert len(with_part) > 1 and max(r["count"] for r in with_part) < 2000
