"""Connected components by label spreading, cut with checkpoints."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; only a local test session gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="attesta-checkpoint-"))


def settle(df: DataFrame) -> DataFrame:
    """A table several steps read, computed once and kept in the checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for edges(a, b): the smallest node reachable.

    Every round a node takes the smallest label around it and then its label's label, which halves
    chains, so the number of rounds grows with the logarithm of the longest chain.  A hub may own most
    edges: the joins are plain equi-joins, whose large partitions are split while they run, and the
    smallest label around a node is a partial aggregate.  The edges are computed once, so both directions
    of an edge are there even if another run of their source would give others.
    """
    once = settle(edges.select("a", "b"))
    both = once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")).checkpoint()
    for _ in range(max_rounds):
        seen = labels.select(F.col("node").alias("b"), F.col("component").alias("near"))
        around = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lowered = labels.join(around, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        step = lowered.join(jump, "mid", "left").select(
            "node", "old", F.least("mid", F.coalesce("far", "mid")).alias("component")).checkpoint()
        labels = step.select("node", "component")
        if step.where(F.col("old") != F.col("component")).isEmpty():
            return labels
    raise RuntimeError("components did not settle")
