"""Iterated joins with bounded lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by the shared checkpoint folder; the session's, or one of its own where it has none (tests)."""
    sc = df.sparkSession.sparkContext
    where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not where:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            where = "file://" + tempfile.mkdtemp(prefix="quarry-checkpoint-")
        sc.setCheckpointDir(where)
    return df.checkpoint()


def least_labels(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of an undirected edge list (a, b) is connected with.

    Each round takes the least label around a node and then the label's own label, so
    paths shorten by half; two grouped minima and a join for a round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().persist()
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        new = labels.join(around, F.col("node") == F.col("a")).select("node", F.least("root", "m").alias("r"))
        jump = new.join(labels.select(F.col("node").alias("r"), F.col("root").alias("far")), "r", "left")
        new = checkpointed(jump.select("node", F.least("r", F.coalesce("far", "r")).alias("root")))
        moved = new.join(labels.withColumnRenamed("root", "old"), "node").where("root <> old")
        done = moved.isEmpty()
        labels = new
        if done:
            both.unpersist()
            return labels
