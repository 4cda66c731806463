"""Session helpers: table access and lineage cuts that survive executor loss."""

from __future__ import annotations

import logging
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables; pruning and pushdown reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir.

    Only a session without that setting, and only a single-JVM one, gets a
    temporary folder; on a cluster a missing setting is an error, because a
    folder on one machine is lost with that machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(named)
        return
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="pathloom-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written to the shared folder, so that a lost
    executor never forces a whole iteration to be computed again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for files that executors hand to each other."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **observed: Column) -> tuple[DataFrame, str, dict]:
    """``df`` as a table written in the shared folder, which cuts its lineage; its
    path, and aggregates of its rows that were taken while they were written."""
    path, seen = shared_folder(df.sparkSession, name), Observation()
    watched = df.observe(seen, *[c.alias(n) for n, c in observed.items()]) if observed else df
    watched.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path, seen.get if observed else {}


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that ``written`` made, once nothing reads it any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def log(text: str, slide: str | None = None) -> None:
    """A message of the package's logger, with the slide before it. Where it goes
    (screen, file or nowhere) is set on the logger "pathloom"."""
    logging.getLogger("pathloom").info("%s: %s" if slide else "%.0s%s", slide or "", text)


def log_to(place: str | None) -> None:
    """Send messages to the screen ("screen"), to a file, or nowhere (None)."""
    logger = logging.getLogger("pathloom")
    logger.handlers[:] = [logging.NullHandler() if place is None else logging.StreamHandler() if place == "screen" else logging.FileHandler(place)]
    logger.setLevel(logging.INFO)
    logger.propagate = False
