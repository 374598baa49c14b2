"""The evidence plan: normalize, match, apply rules, test contradictions, classify, score, gate, route."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.functions import text as T
from warraq.operators import resolve, rules

# Fixed value: how a borderline pair is described to the reviewer.
BORDERLINE = ("مرشح دمج حدّي بين '", "' و'", "' — درجة تطابق ", " (دون عتبة الدمج التلقائي 0.75 لكن فوق عتبة التجاهل 0.55). راجع يدوياً هل هما شخص واحد.")


@dataclass
class Decisions:
    results: DataFrame
    borderline: DataFrame
    members: DataFrame


def normalize_batch(batch: DataFrame) -> DataFrame:
    """Names trimmed; quotes stay as they are."""
    return batch.withColumns({"canonical_name": T.strip(T.text("canonical_name")), "kunya": T.strip(F.col("kunya"))})


def run(batch: DataFrame, match_threshold: int = resolve.MERGE) -> Decisions:
    """One row for each person from a batch of extractions (idx, the columns of people and of evidence)."""
    ready = normalize_batch(batch)
    members, doubtful = resolve.cluster(ready, match_threshold)
    evidence = ready.join(members, "idx").withColumn("item_id", F.col("idx"))
    heads = ready.select(F.col("idx").alias("cluster_id"), "canonical_name", "kunya", "geographical_mentions", "raw_quote", "source_meta")
    results = rules.with_traces(evidence).join(heads, "cluster_id")
    return Decisions(results, doubtful, members)


def borderline_reviews(decisions: Decisions, batch: DataFrame) -> DataFrame:
    """Review rows for pairs that may be one person: relation U, code H1, confidence 0."""
    name = normalize_batch(batch).select("idx", "canonical_name", "kunya", "geographical_mentions")
    rows = decisions.borderline.join(name.withColumnRenamed("idx", "i"), "i").join(name.select(F.col("idx").alias("j"), F.col("canonical_name").alias("other")), "j")
    detail = F.concat(F.lit(BORDERLINE[0]), "canonical_name", F.lit(BORDERLINE[1]), "other", F.lit(BORDERLINE[2]), F.format_number(F.col("points") / 100, 2), F.lit(BORDERLINE[3]))
    return rows.select("i", "j", "canonical_name", "kunya", "geographical_mentions", F.lit("U").alias("relation"), F.lit("H1").alias("evidence_code"), F.lit(0).alias("confidence"), F.lit(False).alias("has_contradiction"), detail.alias("raw_quote"))
