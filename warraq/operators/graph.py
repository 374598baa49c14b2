"""Knowledge graph: nodes and edges of passages, categories and triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.functions import text as T


def entity_id(name: Column) -> Column:
    return F.concat(F.lit("entity:"), F.substring(T.normalize_index(name), 1, 160))


def document_node() -> Column:
    return F.concat(F.lit("document:"), F.substring(T.normalize_index(F.concat(T.text("url"), F.lit("#"), T.text("title"))), 1, 160))


def build_graph(passages: DataFrame | None, triples: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, label, type, url; edges: source, predicate, target).

    passages need doc_id, title, type, url, categories; triples need subject, predicate, object and ord, their
    place in order.  A node that comes up again takes its last label; edges are distinct.
    """
    nodes, edges = [], []
    if passages is not None:
        rows = passages.withColumn("node", document_node())
        nodes.append(rows.select(F.col("node").alias("id"), F.col("title").alias("label"), T.text("type").alias("type"), T.text("url").alias("url"), F.struct(F.lit(0), F.col("doc_id").cast("long"), F.lit(0)).alias("ord")))
        marked = rows.select("node", F.explode("categories").alias("c"))
        nodes.append(marked.select(F.concat(F.lit("category:"), "c").alias("id"), F.col("c").alias("label"), F.lit("category").alias("type"), F.lit("").alias("url"), F.struct(F.lit(0), F.lit(0).cast("long"), F.lit(0)).alias("ord")))
        edges.append(marked.select(F.col("node").alias("source"), F.lit("categorizedAs").alias("predicate"), F.concat(F.lit("category:"), "c").alias("target")))
    if triples is not None:
        named = triples.withColumns({"s": entity_id(F.col("subject")), "o": entity_id(F.col("object"))}).filter("s <> 'entity:' AND o <> 'entity:'")
        for k, (node, label) in enumerate((("s", "subject"), ("o", "object"))):
            nodes.append(named.select(F.col(node).alias("id"), F.col(label).alias("label"), F.lit("entity").alias("type"), F.lit("").alias("url"), F.struct(F.lit(1), F.col("ord").cast("long"), F.lit(k)).alias("ord")))
        edges.append(named.select(F.col("s").alias("source"), F.substring(T.clean_text("predicate"), 1, 100).alias("predicate"), F.col("o").alias("target")))
    every = nodes[0]
    for n in nodes[1:]:
        every = every.union(n)
    lines = edges[0]
    for e in edges[1:]:
        lines = lines.union(e)
    return every.groupBy("id").agg(F.max_by(F.struct("label", "type", "url"), "ord").alias("v")).select("id", "v.label", "v.type", "v.url"), lines.distinct()
