"""Joins and aggregates that hold when a few keys own most of the rows.

Two tools cover the engine's needs:

* ``eager_join_aggregate`` never joins raw rows: both inputs are reduced to one
  compact state per join key first (map-side combined, so a hot key leaves each
  task as a single row), the states are joined, counts are multiplied and sums
  are scaled by the other side's count, and the result is rolled up.
  ``later_repeats`` does the same where ids come out: a side's state is then
  its ids, a bounded number a state.
* ``salted_join`` is for joins whose raw rows must come out. It counts one
  side's keys, and splits the hot ones over several tasks.

Which keys are hot is told by hash buckets, not by a list of keys: however many
hot keys there are, the table that is broadcast has at most BUCKETS rows of two
numbers, and none is left out. A bucket's keys are all split alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a key that one task should meet; a key with more is split.
HOT_ROWS = 200_000
#: Buckets of keys that are split alike.
BUCKETS = 1 << 16
#: Rows of a lookup table that are broadcast at most.
BROADCAST_ROWS = 100_000


def _same(left: Column, right: Column, null_safe: bool) -> Column:
    return left.eqNullSafe(right) if null_safe else left == right


def key_bucket(*keys: str | Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def hot_buckets(counts: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(_bucket, _salts) of the buckets with a key of at least ``hot_rows`` rows;
    ``counts`` has the keys and their number of rows, ``_n``. A split into more
    parts than a shuffle has room for would only repeat the other side's rows."""
    most = 4 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = counts.filter(F.col("_n") >= hot_rows).groupBy(key_bucket(*keys).alias("_bucket")).agg(F.max("_n").alias("_n"))
    return hot.select("_bucket", F.least(F.ceil(F.col("_n") / hot_rows) + 1, F.lit(most)).cast("int").alias("_salts"))


def hot_of(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``hot_buckets`` of the rows of ``df``. Rows are counted by bucket first,
    which shuffles BUCKETS numbers a task at most; keys are counted only in
    buckets that are full enough to hold a hot one."""
    full = df.groupBy(key_bucket(*keys).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= hot_rows).select("_bucket")
    within = df.select(*keys).join(F.broadcast(full), key_bucket(*keys) == F.col("_bucket"), "left_semi")
    return hot_buckets(within.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, hot_rows)


def with_salts(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """``df`` with ``_salts``, the parts its key is split into (1: not split)."""
    h = hot.select(F.col("_bucket").alias("_hot_bucket"), "_salts")
    marked = df.join(F.broadcast(h), key_bucket(*[df[k] for k in keys]) == h["_hot_bucket"], "left").drop("_hot_bucket")
    return marked.withColumn("_salts", F.coalesce("_salts", F.lit(1)))


def dealt(df: DataFrame, spread_by: Sequence[str], name: str = "_salt") -> DataFrame:
    """Rows of a split key dealt to its parts by the columns ``spread_by``."""
    return df.withColumn(name, F.pmod(F.xxhash64(*spread_by), F.col("_salts")).cast("int")).drop("_salts")


def repeated(df: DataFrame, name: str = "_salt") -> DataFrame:
    """Each row once for every part of its key."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    *,
    spread_by: Sequence[str],
    hot_rows: int = HOT_ROWS,
    null_safe: bool = False,
    hot: DataFrame | None = None,
    large: bool = False,
) -> DataFrame:
    """Inner equi-join of ``left`` and ``right`` on the columns ``on``.

    ``left`` is the side that may hold a third of its rows under one key: rows
    of a hot key are dealt to several salts by the columns ``spread_by``, and
    the rows of ``right`` with that key are repeated once a salt. No row is
    dropped or repeated in the result. Null keys match only if ``null_safe``.
    Columns of ``right`` must not clash with those of ``left`` except ``on``.
    ``hot`` may give the hot buckets (as ``hot_buckets`` does) where the counts
    are known from compact states; otherwise the keys of ``left`` are counted.
    ``large``: neither side is broadcast, however small it is estimated (what
    Python or an explode makes of few bytes may be far more than these).
    """
    if hot is None:
        hot = hot_of(left, on, hot_rows)
    a = dealt(with_salts(left, on, hot), spread_by)
    b = repeated(with_salts(right, on, hot), "_salt_r").withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(on)})
    match = a["_salt"] == b["_salt_r"]
    for i, k in enumerate(on):
        match = match & _same(a[k], b[f"_r{i}"], null_safe)
    return a.join(b.hint("merge") if large else b, match).drop("_salt", "_salt_r", *[f"_r{i}" for i in range(len(on))])


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], *, null_safe: bool = False, spread_by: Sequence[str] | None = None, most: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of many rows with a table of a row a key, such as slides.

    The rows of ``right`` are counted, up to ``most``: so few are broadcast, and
    ``left`` isn't shuffled at all; more are joined by ``salted_join``, since a
    slide may hold a third of all rows and a plain join would leave these to one
    task. The result is the same.
    """
    if right.limit(most + 1).count() > most:
        by = spread_by or [f.name for f in left.schema if not isinstance(f.dataType, T.MapType)]
        return salted_join(left, right, on, spread_by=by, hot_rows=hot_rows, null_safe=null_safe)
    r = right.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(on)})
    match = F.lit(True)
    for i, k in enumerate(on):
        match = match & _same(left[k], r[f"_r{i}"], null_safe)
    return left.join(F.broadcast(r), match).drop(*[f"_r{i}" for i in range(len(on))])


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    *,
    left_sums: Sequence[str] = (),
    right_sums: Sequence[str] = (),
    left_group: Sequence[str] = (),
    null_safe: bool = False,
) -> DataFrame:
    """COUNT and SUMs over the inner join of ``left`` and ``right``, without
    ever joining raw rows.

    Result: ``on`` + ``left_group``, ``n_pairs`` (joined row pairs) and
    ``sum_<column>`` of each named column over those pairs. A key with a million
    rows on either side meets the join as one row each. Null keys match nothing
    unless ``null_safe``; null values are skipped in sums (all null: null).
    Empty inputs give an empty result.
    """
    def states(df: DataFrame, keys: Sequence[str], sums: Sequence[str], side: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_n{side}"), *[F.sum(c).alias(f"_s{side}_{c}") for c in sums])

    a = states(left, [*on, *left_group], left_sums, "l")
    b = states(right, on, right_sums, "r").withColumnsRenamed({k: f"_r_{k}" for k in on})
    match = F.lit(True)
    for k in on:
        match = match & _same(a[k], b[f"_r_{k}"], null_safe)
    joined = a.join(b, match)
    return joined.select(
        *on,
        *left_group,
        (F.col("_nl") * F.col("_nr")).alias("n_pairs"),
        *[(F.col(f"_sl_{c}") * F.col("_nr")).alias(f"sum_{c}") for c in left_sums],
        *[(F.col(f"_sr_{c}") * F.col("_nl")).alias(f"sum_{c}") for c in right_sums],
    )


def later_repeats(df: DataFrame, key: Sequence[str], id_col: str, *, required: Sequence[str] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Ids of the rows for which an earlier row (smaller ``id_col``) has the same key.

    The self-join "some q with q.key = p.key and q.id < p.id" is computed on
    states of both inputs. q is reduced to one state a key: its smallest id and
    its number of rows; keys that occur once are dropped. p is reduced to its
    ids, one state a key; a key with more than about ``hot_rows`` rows is split
    into several states, each with that many ids, so no state grows without
    bound. The states are joined and rolled up to the ids after the smallest.

    Nulls in ``key`` are equal to each other; rows with a null in ``required``
    or a null id take no part. A row repeated with its own id is no later row.
    One column, distinct values.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.struct(*key).alias("_key"), *[F.col(c).alias(f"_need{i}") for i, c in enumerate(required)]).dropna(subset=["_id", *[f"_need{i}" for i in range(len(required))]]).select("_id", "_key")
    firsts = rows.groupBy("_key").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    hot = hot_of(rows, ["_key"], hot_rows)
    ids = dealt(with_salts(rows, ["_key"], hot), ["_id"]).groupBy("_key", "_salt").agg(F.collect_set("_id").alias("_ids"))
    states = repeated(with_salts(firsts, ["_key"], hot), "_salt_r").select(F.col("_key").alias("_key_r"), "_salt_r", "_first")
    joined = ids.join(states, (ids["_key"] == states["_key_r"]) & (ids["_salt"] == states["_salt_r"]))
    return joined.select(F.explode(F.filter("_ids", lambda i: i > F.col("_first"))).alias(id_col))
