"""Page-level data: landmarks, bounding boxes, family trees, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.functions import text as T


def filter_places(places: DataFrame, mode: str = "all", query: str = "") -> DataFrame:
    """Places of an era (or 'unesco', or 'all') whose name holds the query, both normalized."""
    rows = places
    if mode == "unesco":
        rows = rows.filter(F.coalesce("unesco", F.lit(False)))
    elif mode != "all":
        rows = rows.filter(F.col("era") == mode)
    return rows.filter(F.contains(T.normalize_place("name"), T.normalize_place(F.lit(query))))


def visible_count(places: DataFrame, mode: str = "all", query: str = "") -> DataFrame:
    """One row: visible, total."""
    return filter_places(places, mode, query).agg(F.count("*").alias("visible")).crossJoin(places.agg(F.count("*").alias("total")))  # one row each


def bounding_box(places: DataFrame, *keys: str) -> DataFrame:
    return places.groupBy(*keys).agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"))


def tree_counts(nodes: DataFrame) -> DataFrame:
    """(root, n): people with a name in each tree of (node_id, parent_id, name); a root has no parent.

    Level by level to the deepest one; a node moves on with the root of its parent, so each row is joined once, and
    each level is written to the checkpoint folder, so none is worked out twice.
    """
    from warraq.operators.components import cut_lineage

    named = (T.strip(T.text("name")) != "").cast("long")
    level = cut_lineage(nodes.filter("parent_id IS NULL").select("node_id", F.col("node_id").alias("root"), named.alias("n")))
    done = level
    while not level.isEmpty():
        parents = level.select(F.col("node_id").alias("parent_id"), "root")
        level = cut_lineage(nodes.join(parents, "parent_id").select("node_id", "root", named.alias("n")))
        done = done.union(level)
    return done.groupBy("root").agg(F.sum("n").alias("n"))


def upsert_counters(counters: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, value, updated_at): values added, the latest time kept."""
    return counters.select("key", "value", "updated_at").unionByName(changes.select("key", "value", "updated_at")).groupBy("key").agg(F.sum("value").alias("value"), F.max("updated_at").alias("updated_at"))
