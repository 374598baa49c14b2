"""Whole lifecycles: from files to saved indexes and graph, and from queries to result pages."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.functions import constants as C
from warraq.functions import text as T
from warraq.operators import expand, graph, present, rank
from warraq.operators.index import Index, category_index
from warraq.sources import files

CATEGORIES = tuple(C.CATEGORY_PATTERNS)
MASTER = "master"


def build(spark: SparkSession, root: str, out: str) -> DataFrame:
    """Seven artifacts below out: the master index, the graph and an index of each category; returns the counts.

    Each category index has ids, frequencies and lengths of its own, so its scores compare with itself alone.
    """
    passages, triples, counts = files.collect(spark, root)
    passages.write.mode("overwrite").parquet(f"{out}/passages")
    passages = spark.read.parquet(f"{out}/passages")
    Index.create(passages, f"{out}/{MASTER}", compose=True)
    nodes, edges = graph.build_graph(passages, triples)
    nodes.write.mode("overwrite").parquet(f"{out}/graph/nodes")
    edges.write.mode("overwrite").parquet(f"{out}/graph/edges")
    for category in CATEGORIES:
        category_index(passages, category, f"{out}/{category}", compose=True)
    made = spark.createDataFrame([(C.INDEX_VERSION, int(time.time() * 1000))], "v string, built long")
    made.write.mode("overwrite").parquet(f"{out}/made")
    return counts


def is_fresh(spark: SparkSession, out: str, ttl_hours: float = 12, now_ms: int | None = None, signature: int | None = None) -> bool:
    """Whether a saved build has this version, is younger than its time to live and has as many passages as expected."""
    try:
        made = spark.read.parquet(f"{out}/made").first()
    except Exception as failure:  # Spark has no narrower type for a missing path in both of its clients
        if "PATH_NOT_FOUND" in str(failure):
            return False
        raise
    young = (now_ms or int(time.time() * 1000)) - made["built"] <= ttl_hours * 3_600_000
    return made["v"] == C.INDEX_VERSION and young and (signature is None or signature == spark.read.parquet(f"{out}/passages").count())


@dataclass
class Response:
    """Tables of one batch of queries; each is a plan."""

    hits: DataFrame
    totals: DataFrame
    facets: DataFrame
    terms: DataFrame
    suggestions: DataFrame


@dataclass
class Archive:
    """An index that answers batches of queries (query_id, q); without concepts of its own it has the built-in ones."""

    index: Index
    concepts: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, out: str, part: str = MASTER, concepts: DataFrame | None = None) -> Archive:
        return cls(Index.load(spark, f"{out}/{part}"), concepts)

    def extend(self, concepts: DataFrame) -> Archive:
        """The archive with more concepts (id, term, kind)."""
        return Archive(self.index, self.known_concepts().unionByName(concepts))

    def known_concepts(self) -> DataFrame:
        return expand.built_in_concepts(self.index.terms.sparkSession) if self.concepts is None else self.concepts

    def search(self, queries: DataFrame, limit: int = rank.DEFAULT_LIMIT, now_ms: int = 0, section: str | None = None, type_: str | None = None) -> Response:
        queries = queries.withColumn("q", T.nfkc(T.text("q")))  # as what is indexed
        found = expand.candidates(queries, self.index.terms, self.index.stems, self.known_concepts())
        hits, totals, facets = rank.search(queries, self.index, found, limit, now_ms, section, type_)
        marked = present.display_terms(found, hits)
        text = present.snippet(T.text("b"), T.text("d"), F.col("terms"), F.col("nq"))
        shown = hits.withColumn("snippet", text).drop("b", "d", "nq", "terms").join(marked, ["query_id", "doc_id"], "left")
        in_order = F.sort_array(F.collect_list("came"))
        good = found.filter("quality >= 0.6").groupBy("query_id").agg(F.transform(F.slice(in_order, 1, 20), lambda c: c.term).alias("terms"))
        without = queries.join(totals, "query_id", "left_anti")
        return Response(shown, totals, facets, good, present.suggestions(without, self.index.terms))

    def stats(self) -> DataFrame:
        """One row: documents, terms, average length."""
        return self.index.figures.crossJoin(self.index.terms.agg(F.count("*").alias("n_terms")))  # one row each


def with_section_rank(passages: DataFrame, ranks: dict[str, float] | None = None) -> DataFrame:
    """passages whose rank is that of their section where none is given (0 or null); sections not listed have 1."""
    table = F.create_map(*(F.lit(v) for pair in (ranks or C.SECTION_RANKS).items() for v in pair))
    known = F.coalesce(table[F.col("section")], F.lit(1.0))
    return passages.withColumn("rank", F.when(F.coalesce("rank", F.lit(0.0)) == 0, known).otherwise(F.col("rank")))
