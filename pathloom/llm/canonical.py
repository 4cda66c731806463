"""Free-entered values to the entries of a reference list, by token repair.

Only distinct values are worked on. Their distinct tokens meet the reference
vocabulary through an equi-join of deletion neighbourhoods (two strings within
two edits share a string left by two deletions) or, for abbreviations, of
prefixes; the edit distance is then verified. Each value's repaired tokens are
combined by soft TF-IDF into a score for every entry they touch, and the best
entry over the threshold is the value's; all others are reported with group 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pathloom.operators.skew import hot_buckets, salted_join
from pathloom.runtime import cut_lineage

#: Least soft TF-IDF score of a match.
THRESHOLD = 0.78
#: Letters an abbreviation needs.
ABBREVIATION = 3
#: Letters of a token from which its keys are made. Two tokens within two edits
#: also share a key of their beginnings: an edit there costs each side one
#: deletion at most, of the letter edited or of the last one that it pushes in.
KEY_LETTERS = 40
_ASIDE = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_TOKEN = re.compile(r"[^\W_]+")
_TOKEN_TYPE = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("cut", T.BooleanType())]))


def tokens(text: str | None) -> list[tuple[str, bool]]:
    """(token, whether it ends in an abbreviation's full stop): lower case, no
    accents, no numbers, nothing in brackets."""
    if not text:
        return []
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower().replace("ß", "ss")
    plain = _ASIDE.sub(" ", plain)
    found = []
    for m in _TOKEN.finditer(plain):
        if any(c.isdigit() for c in m[0]):
            continue
        found.append((m[0], len(m[0]) >= ABBREVIATION and plain[m.end() : m.end() + 1] == "."))
    return found


def edits(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (insert, delete, replace, swap neighbours),
    or most + 1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = len(a) + len(b)
    last_row: dict[str, int] = {}
    cost = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, last_column = [far, i], 0
        for j, y in enumerate(b, 1):
            k, m = last_row.get(y, 0), last_column
            if x == y:
                last_column = j
            row.append(min(cost[i][j] + (x != y), row[j] + 1, cost[i][j + 1] + 1, cost[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        cost.append(row)
        last_row[x] = i
    return min(cost[-1][-1], most + 1)


def neighbourhood(token: str, deletions: int) -> set[str]:
    """The strings left by at most so many deletions."""
    found = frontier = {token}
    for _ in range(deletions):
        frontier = {t[:i] + t[i + 1 :] for t in frontier for i in range(len(t))}
        found = found | frontier
    return found


def _tokens_of(column: str) -> Column:
    @F.pandas_udf(_TOKEN_TYPE)
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in values:
            yield v.map(lambda t: [{"token": a, "cut": b} for a, b in tokens(t)])

    return run(F.col(column))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _runs(parts: pd.Series, most: pd.Series) -> pd.Series:
    """Runs of two or more neighbouring words, and all words in reverse order,
    that have at most so many letters: no token seen could be a longer one."""
    def of(words: list[str], most: int) -> list[list[str]]:
        words = list(words)
        found = {tuple(reversed(words))} if len(words) > 1 and sum(map(len, words)) <= most else set()
        for i in range(len(words)):
            letters = len(words[i])
            for k in range(i + 1, len(words)):
                letters += len(words[k])
                if letters > most:
                    break
                found.add(tuple(words[i : k + 1]))
        return [list(f) for f in sorted(found)]

    return pd.Series([of(p, m) for p, m in zip(parts, most)])


def _part(t: Column, start: Column | int, length: Column | int) -> Column:
    of = lambda v: F.lit(v) if isinstance(v, int) else v
    return F.substring(t, of(start), of(length))


def keys_of(token: Column) -> Column:
    """``neighbourhood`` of a token's beginning as an array: its two deletions,
    or one for a token of under four letters, are places i and j."""
    t = F.substring(token, 1, KEY_LETTERS)
    n = F.length(t)

    def left(i: Column, j: Column) -> Column:
        one = F.concat(_part(t, 1, i - 1), _part(t, i + 1, n))
        two = F.concat(_part(t, 1, i - 1), _part(t, i + 1, j - i - 1), _part(t, j + 1, n))
        return F.when(i == j, one).otherwise(two)

    places = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i <= n)
    cut = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: (j == i) | (j > i) & (n >= 4)), lambda j: left(i, j))))
    return F.array_distinct(F.concat(F.array(t), cut))


def near_edits(a: Column, b: Column) -> Column:
    """``edits`` of two tokens up to 2, else 3. A distance has a swap of
    neighbours, in either token, or is a plain one."""
    def swaps(t: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: i < F.length(t))
        return F.transform(places, lambda i: F.concat(_part(t, 1, i - 1), _part(t, i + 1, 1), _part(t, i, 1), _part(t, i + 2, F.length(t))))

    plain = F.levenshtein(a, b)
    one = (plain <= 1) | F.exists(swaps(a), lambda s: s == b)
    two = (plain <= 2) | F.exists(swaps(a), lambda s: (F.levenshtein(s, b) <= 1) | F.array_contains(swaps(b), s)) | F.exists(swaps(b), lambda s: F.levenshtein(a, s) <= 1)
    return F.when(plain > 4, 3).when(plain == 0, 0).when(one, 1).when(two, 2).otherwise(3)


def similarity(seen: Column, known: Column) -> Column:
    """1 for equal tokens, less with each edit, null beyond the allowed ones."""
    most = F.when(F.length(known) < 3, 0).when(F.length(known) < 5, 1).otherwise(2)
    d = near_edits(seen, known)
    return F.when(d <= most, 1.0 - d / (2 * (F.length(known) + 1)))


def map_to_canonical(
    df: DataFrame,
    reference: DataFrame,
    *,
    id_col: str,
    value_col: str,
    group_id: str = "group_id",
    group_name: str = "group_name",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, value, group_id, score) of each row of ``df`` with a value: the
    entry of ``reference`` that is meant, or group 0 with the best score found
    among the entries that could have reached the threshold.

    Rows with a null id or value take no part; a value without any token (blank,
    numbers) is unmatched. Where two entries have the same best score the value
    names neither: it is unmatched. Repeated rows give repeated results. An
    empty reference leaves all unmatched. Long values count whole.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).alias("_id"), F.col(value_col).alias("_value")).filter(F.col("_id").isNotNull() & F.col("_value").isNotNull())
    # The distinct values with their tokens are small against the rows, and used several times: they are written once.
    values = cut_lineage(rows.groupBy("_value").agg(F.count(F.lit(1)).alias("_n")).repartition(tasks, "_value").withColumn("tokens", F.array_distinct(_tokens_of("_value"))))
    value_tokens = values.select("_value", F.explode("tokens").alias("t")).select("_value", "t.token", "t.cut")
    entries = reference.select(F.col(group_id).alias("gid"), F.col(group_name).alias("gname")).dropna().distinct()
    named = cut_lineage(entries.select("gid", F.array_distinct(F.transform(_tokens_of("gname"), lambda t: t["token"])).alias("parts")))
    entry_tokens = named.select("gid", F.explode("parts").alias("known"))
    vocabulary = entry_tokens.groupBy("known").agg(F.countDistinct("gid").alias("df"))
    total = entries.select(F.countDistinct("gid").alias("total"))
    idf = vocabulary.crossJoin(F.broadcast(total)).select("known", (F.log(F.col("total") / F.col("df")) + 1).alias("idf"))  # total is one row
    unknown_idf = total.select((F.log(F.greatest(F.col("total"), F.lit(1))) + 1).alias("most"))
    # Weights of each entry's words, and which of them a match can't do without: the words that come
    # after, the commoner ones, have together too short a vector to reach the threshold.
    by_rarity = Window.partitionBy("gid").orderBy(F.desc("idf"), "known")
    square = F.col("idf") * F.col("idf")
    weights = entry_tokens.join(idf, "known").withColumn("rest", F.sum(square).over(by_rarity.rowsBetween(0, Window.unboundedFollowing)))
    whole = weights.groupBy("gid").agg(F.sqrt(F.sum(square)).alias("norm"), F.collect_list(F.struct("known", "idf", "rest")).alias("words"))
    bound = F.col("norm") * (threshold - 1e-6)
    needed = whole.select("gid", "norm", "words", F.explode(F.filter("words", lambda w: F.sqrt(w["rest"]) >= bound)).alias("w")).select(F.col("w.known").alias("known"), "gid", "norm", "words")

    seen = value_tokens.select("token", "cut").distinct()
    longest = seen.select((F.coalesce(F.max(F.length("token")), F.lit(0)) + 2).alias("longest"))
    # What a token may have been: one word of an entry, or neighbouring words typed without a space.
    written = vocabulary.select(F.col("known").alias("form"), F.array("known").alias("parts")).unionByName(
        named.crossJoin(F.broadcast(longest)).select(F.explode(_runs("parts", "longest")).alias("parts")).distinct().select(F.concat_ws("", "parts").alias("form"), "parts")  # one row
    )
    # These joins are of distinct tokens: a key is shared by no more of them than there are ways to spell it.
    near = seen.select("token").distinct().withColumn("key", F.explode(keys_of(F.col("token")))).join(written.withColumn("key", F.explode(keys_of(F.col("form")))), "key")
    by_edit = (
        near.select("token", "form", "parts").repartition(tasks, "token", "form").distinct().withColumn("sim", similarity(F.col("token"), F.col("form"))).filter(F.col("sim").isNotNull())
        .withColumn("most", F.max("sim").over(Window.partitionBy("token")))
        .filter((F.size("parts") == 1) | (F.col("sim") == F.col("most")))
        .select("token", F.lit(None).cast("boolean").alias("for_cut"), F.posexplode("parts").alias("part", "known"), "sim")
    )
    start = F.substring("token", 1, ABBREVIATION)
    by_prefix = (
        seen.filter("cut").withColumn("key", start)
        .join(vocabulary.select("known", F.substring("known", 1, ABBREVIATION).alias("key")), "key")
        .filter(F.col("known").startswith(F.col("token")))
        .select("token", F.lit(True).alias("for_cut"), F.lit(0).alias("part"), "known", F.lit(0.97).alias("sim"))
    )
    # Repairs belong to distinct tokens; they go back to the values that have these.
    repaired = cut_lineage(by_edit.unionByName(by_prefix).select("token", F.struct(F.coalesce("for_cut", F.lit(False)).alias("for_cut"), "part", "known", "sim").alias("r")).groupBy("token").agg(F.collect_set("r").alias("repairs")))
    held = salted_join(value_tokens, repaired, ["token"], spread_by=["_value"]).select("_value", "token", F.inline(F.filter("repairs", lambda r: ~r["for_cut"] | F.col("cut"))))
    # From here on, all of a value's rows are in one place: its words' weights and length are made without another shuffle.
    held = held.withColumnRenamed("known", "_k").join(idf, F.col("_k") == F.col("known")).repartition(tasks, "_value").groupBy("_value", "token", "part", "known").agg(F.max("sim").alias("sim"), F.max("idf").alias("idf"))
    # A token weighs as much as what it is repaired to, an unknown one the most; of equally near words the rarest counts.
    weighed = held.groupBy("_value", "token", "part").agg(F.max(F.struct("sim", "idf", "known"))["idf"].alias("w"), F.collect_list(F.struct("known", "sim")).alias("options"))
    lengths = weighed.groupBy("_value").agg(F.sum(F.col("w") * F.col("w")).alias("known2"), F.countDistinct("token").alias("n_known"), F.flatten(F.collect_list(F.transform("options", lambda o: F.struct(o["known"].alias("known"), o["sim"].alias("sim"), F.col("w").alias("w"))))).alias("found"))
    n_tokens = F.size(F.array_distinct(F.transform("tokens", lambda t: t["token"])))
    length2 = F.col("known2") + (n_tokens - F.col("n_known")) * F.col("most") * F.col("most")
    profile = cut_lineage(
        values.withColumnRenamed("_value", "_v").join(lengths, F.col("_v") == F.col("_value")).crossJoin(F.broadcast(unknown_idf))  # one row
        .select("_value", "found", F.sqrt(length2).alias("vnorm"))
    )
    pairs = salted_join(profile.select("_value", "found", "vnorm", F.explode(F.array_distinct(F.col("found")["known"])).alias("known")), needed, ["known"], spread_by=["_value"])

    def shared(word: Column) -> Column:
        """The product of an entry's word with the value's nearest token for it."""
        best = F.array_max(F.transform(F.filter("found", lambda f: f["known"] == word["known"]), lambda f: F.struct(f["sim"], f["w"])))
        return F.coalesce(best["sim"] * best["w"] * word["idf"], F.lit(0.0))

    dot = F.aggregate("words", F.lit(0.0), lambda t, word: t + shared(word))
    scores = pairs.select("_value", "gid", F.round(dot / F.col("norm") / F.col("vnorm"), 9).alias("score"))  # a pair found by two words comes twice, with one score
    ranked = scores.groupBy("_value").agg(F.max("score").alias("best"), F.max_by("gid", F.struct("score", -F.col("gid"))).alias("gid"), F.max_by("gid", F.struct("score", "gid")).alias("gid2"))
    chosen = values.join(ranked.withColumnRenamed("_value", "_v"), F.col("_value") == F.col("_v"), "left").select(
        F.col("_value").alias("_key"),
        "_n",
        F.when((F.col("best") >= threshold) & (F.col("gid") == F.col("gid2")), F.col("gid")).otherwise(F.lit(0)).alias("group_id"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
    )
    joined = salted_join(rows.withColumnRenamed("_value", "_key"), chosen.drop("_n"), ["_key"], spread_by=["_id"], hot=hot_buckets(chosen, ["_key"]))
    return joined.select(F.col("_id").alias(id_col), F.col("_key").alias(value_col), "group_id", "score")


def annotation_value() -> Column:
    """The free text that names an annotation's group: part_of_group (asap) or
    ann_description (sedeen), else ann_name; null where neither is a value."""
    def stated(c: str) -> Column:
        plain = F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))
        return F.when((plain != "") & (plain != "none"), F.col(c))

    own = F.when(F.col("vendor") == "sedeen", stated("ann_description")).otherwise(stated("part_of_group"))
    default = F.col("ann_name").rlike(r"(?i)^\s*(annotation|region)\s*\d+\s*$")
    return F.coalesce(own, F.when(~default, stated("ann_name")))
