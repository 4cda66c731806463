import datetime as dt

from conftest import rows
from pathloom.streaming import patches as streams

PATCH = "patch_id long, slide_id string, x long, y long, w int, h int, label string, saved_at timestamp"
T0 = dt.datetime(2025, 1, 1, 12, 0)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


DATA = [(1, "s", 0, 0, 5, 5, "a", at(0)), (2, "s", 0, 0, 5, 5, "a", at(3)), (3, "s", 5, 0, 5, 5, "a", at(12)), (4, "s", 0, 0, 5, 5, None, at(14)), (5, "t", 0, 0, 5, 5, "a", at(100)), (6, "t", 0, 0, 5, 5, "b", None)]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(DATA, PATCH)
    for i in range(2):
        df.filter(f"patch_id % 2 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = streams.arriving(spark, str(tmp_path / "in"), df.schema, files_a_batch=1)
    query = streams.store(streams.first_arrivals(arriving), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    stored = spark.read.schema(df.schema).parquet(str(tmp_path / "out"))
    assert stored.select(*streams.PATCH_KEY).distinct().count() == stored.count() == 5
    query = streams.store(streams.windowed_counts(arriving), str(tmp_path / "out2"), str(tmp_path / "ck2"))
    query.awaitTermination(120)
    want = streams.windowed_counts(df)
    closed = {tuple(r) for r in want.collect() if r.end <= at(100 - 60)}  # the watermark is an hour behind the last patch
    assert len(closed) == 3 and {tuple(r) for r in spark.read.parquet(str(tmp_path / "out2")).collect()} == closed


def test_windows_and_sessions(spark):
    df = spark.createDataFrame(DATA, PATCH)
    assert rows(streams.windowed_counts(df).select("start", "slide_id", "label", "n")) == sorted([(at(0), "s", "a", 2), (at(10), "s", "a", 1), (at(10), "s", None, 1), (at(100), "t", "a", 1)], key=repr)
    assert rows(streams.sessions(df, gap="10 minutes")) == sorted([(at(0), at(24), "s", 4), (at(100), at(110), "t", 1)], key=repr)
    assert streams.sessions(df.limit(0)).count() == 0
