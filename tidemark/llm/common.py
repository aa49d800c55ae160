"""Helpers shared by the corpus operators: shared scratch folder, checkpoints, null-safe text."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]+"  # separators of the whitespace words
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a local master, as in tests, gets a temporary folder; a cluster gets an error,
    since a folder of the driver's machine is not shared.
    """
    ctx = spark.sparkContext
    path = ctx.getConf().get("spark.checkpoint.dir") or ctx.getCheckpointDir()
    if not path:
        if not ctx.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
    if not ctx.getCheckpointDir():
        ctx.setCheckpointDir(path)
    return path


def materialise(df: DataFrame, eager: bool = True) -> DataFrame:
    """checkpoint() into the shared folder: cuts the lineage and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder. Unlike a checkpoint, it also leaves behind what the optimizer derived of df."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone; lower() would also change letters beyond ASCII."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Whitespace words of a text; an empty array for null."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(c: Column) -> Column:
    """Number of whitespace words, without building them."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable over links (a, b), for every id in them.

    Rounds of neighbours' least labels and of label-of-label jumps, each checkpointed, until nothing
    changes.
    """
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        step = labels.join(near, "id", "left").select("id", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("old"))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("up"))
        step = materialise(step.join(jump, "label", "left").select("id", F.least("label", F.coalesce("up", "label")).alias("label"), "old"))
        changed = step.where(F.col("label") != F.col("old")).limit(1).count()
        labels = step.drop("old")
        if not changed:
            return labels
