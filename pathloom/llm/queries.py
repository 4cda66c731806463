"""The pN_ queries of the language-model problems over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import bpe, canonical, chunking, leakage, splits
from pathloom.llm.sql import ORACLES
from pathloom.runtime import cut_lineage, table

__all__ = ["ORACLES", "QUERIES"]

SPLITS = {"train": 0.70, "validation": 0.15, "test": 0.15}


def p3_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "annotations").select("annotation_id", canonical.annotation_value().alias("value"))
    return canonical.map_to_canonical(rows.distinct(), table(spark, sf_dir, "canonical_groups"), id_col="annotation_id", value_col="value")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_mapped(spark, sf_dir).select("annotation_id", "group_id").distinct()


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values without an entry, and how many annotations have them."""
    return p3_mapped(spark, sf_dir).filter(F.col("group_id") == 0).groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("best_score"))


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    slides = table(spark, sf_dir, "slide_levels").select("slide_id", "wsi_file").distinct()
    return splits.related_slides(slides, table(spark, sf_dir, "polygons").select("slide_id", "label", "points"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _related(spark, sf_dir).select(F.col("node").alias("slide_id"), F.col("component").alias("group_id"))


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    slides = table(spark, sf_dir, "slide_levels").select("slide_id").unionByName(table(spark, sf_dir, "polygons").select("slide_id"))
    return splits.assign_splits(slides, _related(spark, sf_dir), SPLITS, node="slide_id")


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides and groups of each split, and the slides' share of all."""
    counts = p6_splits(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n_slides"), F.countDistinct("group_id").alias("n_groups"))
    counts = cut_lineage(counts)
    total = counts.agg(F.sum("n_slides").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("split", "n_slides", "n_groups", F.round(F.col("n_slides") / F.col("total"), 6).alias("share"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).filter(F.col("edits") == 0).select("doc_id", "item_id")


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_documents(table(spark, sf_dir, "documents"))


def p10_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cuts there are of each kind, and the fewest and mean new tokens of the pieces after them."""
    new = F.col("n_tokens") - F.col("overlap_tokens")
    return p10_pieces(spark, sf_dir).filter(F.col("piece_no") > 0).groupBy("cut").agg(F.count(F.lit(1)).alias("n"), F.min(new).alias("fewest_new"), F.avg(new).alias("mean_new"))


QUERIES = {f.__name__: f for f in (p3_found, p3_unmatched, p6_found, p6_splits, p6_shares, p8_ids, p9_found, p9_leaks, p10_pieces, p10_cuts)}
