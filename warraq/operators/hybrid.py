"""Hybrid retrieval: Okapi BM25 over raw tokens, cosine over unit vectors, and their weighted sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warraq.functions import text as T
from warraq.operators.components import cut_lineage, few

K1, B, EPSILON = 1.5, 0.75, 0.25


def okapi(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, id, bm25) of documents that share a token with the query; others score 0.

    Negative idf values become a quarter of the mean idf of all tokens, as the public library does.  Texts are dealt by
    document before they become tokens, so no token is shuffled by document; of the counts only those asked for are kept.
    """
    tokens = docs.select(id_col, text_col).repartition(id_col).select(id_col, F.explode(T.retrieval_tokens(text_col)).alias("token"))
    counts = tokens.groupBy(id_col, "token").agg(F.count("*").alias("tf"))
    asked = cut_lineage(queries.select("query_id", F.explode(T.retrieval_tokens("q")).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times")))
    wanted = few(asked.select("token").distinct().withColumn("wanted", F.lit(True)))
    found = F.collect_list(F.when(F.col("wanted"), F.struct("token", "tf"))).alias("found")
    sizes = cut_lineage(counts.join(wanted, "token", "left").groupBy(id_col).agg(F.sum("tf").alias("dl"), found))  # a row for each document
    figures = docs.agg(F.count("*").alias("n")).crossJoin(sizes.agg(F.sum("dl").alias("all")))  # one row each
    df = counts.groupBy("token").agg(F.count("*").alias("df"))
    raw = cut_lineage(df).crossJoin(F.broadcast(figures)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    weighted = raw.join(few(asked), "token").crossJoin(F.broadcast(mean)).withColumn("idf", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")))
    hits = sizes.select(id_col, "dl", F.explode("found").alias("f")).select(id_col, "dl", "f.token", "f.tf").join(few(cut_lineage(weighted)), "token")
    value = F.col("times") * F.col("idf") * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (F.col("all") / F.col("n")))))
    parts = hits.groupBy("query_id", id_col).agg(F.sort_array(F.collect_list(F.struct("token", value.alias("x")))).alias("parts"))  # added in one order
    return parts.select("query_id", id_col, F.aggregate("parts", F.lit(0.0), lambda total, p: total + p.x).alias("bm25"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(vectors: DataFrame, query_vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, cosine) of unit vectors for a stated set of queries, which must fit in a broadcast.

    query_vectors: (query_id, q_vector), at most 1000 rows; more are refused, as each meets every vector.
    """
    if query_vectors.limit(1001).count() > 1000:
        raise ValueError("more than 1000 query vectors: use an index")
    return vectors.crossJoin(F.broadcast(query_vectors)).select("query_id", id_col, dot(F.col(vector_col), F.col("q_vector")).alias("cosine"))


def combine(docs: DataFrame, queries: DataFrame, bm25: DataFrame, dense: DataFrame | None, id_col: str = "doc_id", top_k: int = 10, weight: float = 0.5) -> DataFrame:
    """(query_id, rank, id, score): weight x BM25 / its maximum + (1 - weight) x cosine; BM25 alone without vectors.

    Documents without a score count as 0, as in a full ranking; ties go to the earlier document.  Only scored
    documents are ranked, and where a query has fewer than top_k above 0 it gets the first unscored ones, so no
    document meets every query.  More than 1000 queries are refused.
    """
    if queries.limit(1001).count() > 1000:
        raise ValueError("more than 1000 queries: combine them in parts")
    top = F.max("bm25").over(Window.partitionBy("query_id"))
    part = bm25.select("query_id", id_col, (F.col("bm25") / F.when(top > 0, top).otherwise(1.0)).alias("score"))
    if dense is not None:
        both = part.join(dense, ["query_id", id_col], "full")
        part = both.select("query_id", id_col, (weight * F.coalesce("score", F.lit(0.0)) + (1 - weight) * F.coalesce("cosine", F.lit(0.0))).alias("score"))
    asked = queries.select("query_id").distinct()
    part = part.join(docs.select(id_col), id_col, "left_semi").join(F.broadcast(asked), "query_id", "left_semi")  # at most 1000 rows
    part = cut_lineage(part)  # scored once, read three times
    figures = asked.join(part, "query_id", "left").groupBy("query_id").agg(F.count_if(F.col("score") > 0).alias("good"), F.count("score").alias("scored"))
    short = figures.filter(F.col("good") < top_k)
    most = short.agg(F.max("scored")).first()[0]
    rows = part
    if most is not None:
        first = docs.select(id_col).orderBy(id_col).limit(top_k + most)  # holds top_k unscored ones for each of these queries
        rest = first.crossJoin(F.broadcast(short.select("query_id"))).join(part, ["query_id", id_col], "left_anti")
        rows = part.unionByName(rest.withColumn("score", F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).select("query_id", "rank", id_col, "score")
