"""Connected components of an edge table, by alternating stars of larger and smaller neighbours."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    made = tempfile.mkdtemp(prefix="warraq-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there from now on."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


FEW = 100_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, sent whole to all tasks where it joins if it has no more than `most` rows; counted here, so df should be cheap or written."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """No node has two parents and no parent has a parent; three counts come to the driver.

    Parents are counted once each before they meet, so a parent of many is one row.
    """
    children = edges.select("a").distinct()
    parents = edges.select(F.col("b").alias("a")).distinct()
    return children.count() == edges.count() and parents.join(children, "a", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the columns a and b of edges; root is the component's smallest node.

    Each round writes its edges to the checkpoint folder, so the plan stays short and lost executors cost
    one round at most.  Least neighbours are written as well before they join the edges: both sides of these joins
    are then plain exchanges, which adaptive execution can split at a node of many edges.
    """
    now = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _is_forest_of_stars(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = cut_lineage(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        least = cut_lineage(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = cut_lineage(small.filter("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
