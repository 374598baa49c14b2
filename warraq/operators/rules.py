"""Evidence rules: deterministic, traced, from single items to a gate for each cluster; expressions only.

evidence: cluster_id, item_id (order in the cluster), assigned_code, proposed_relation, attributed_tribe,
source_meta map<string,string>, has_explicit_linking_text, has_corroborating_clue, definitively_other_tribe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.functions import text as T

#: Codes from the strongest to the weakest.
PRIORITY = ("N1", "N2", "W1", "D1", "R1", "H1", "U1")
# Details of traces and reasons of the gate.
NOT_APPLICABLE = "لا ينطبق"
GEOGRAPHY_DETAIL = ("الاقتراح كان N بدون دليل نسبي صريح (assigned_code=", ") — خُفِّض إلى C قسراً.")
NISBA_DETAIL = "نسبة 'العبدي' مجردة بلا نص رابط — صُنِّف C/R1."
HADITH_DETAIL = "hadith_evaluation مقروء فقط في حقل التقييم الحديثي، لا في proposed_relation."
CONTRADICTION_DETAIL = "تعارض نسبي بين المصادر: "
REJECT_REASON = "درجة ثقة 0/5 — ثبوت الانتساب لقبيلة أخرى يقيناً."
ACCEPT_REASON = ("ثقة ", "/5، بلا تعارض، صلة ", " — إدخال مباشر مسموح.")
REVIEW_REASON = ("ثقة ", "/5 أو صلة ", " أو وجود تعارض — يتطلب مراجعة بشرية قبل الإدخال.")


def trace(rule: str, triggered: Column, detail: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), triggered.alias("triggered"), detail.alias("detail"))


def apply_item_rules(evidence: DataFrame) -> DataFrame:
    """evidence with final_proposal and three traces: geography alone, bare nisba, hadith independence."""
    code, proposed = F.col("assigned_code"), F.col("proposed_relation")
    by_place = (proposed == "N") & ~code.isin("N1", "N2", "W1")
    bare = (code == "R1") & ~F.coalesce("has_explicit_linking_text", F.lit(True))
    detail = F.concat(F.lit(GEOGRAPHY_DETAIL[0]), code, F.lit(GEOGRAPHY_DETAIL[1]))
    none = F.lit(NOT_APPLICABLE)
    traces = F.array(
        trace("geography_isolation", by_place, F.when(by_place, detail).otherwise(none)),
        trace("nisba_ambiguity", bare, F.when(bare, F.lit(NISBA_DETAIL)).otherwise(none)),
        trace("hadith_independence", F.lit(False), F.lit(HADITH_DETAIL)),
    )
    return evidence.withColumn("final_proposal", F.when(by_place | bare, F.lit("C")).otherwise(proposed)).withColumn("traces", traces)


def summarize(evidence: DataFrame) -> DataFrame:
    """A row for each cluster: codes, tribes, sources, flags; every aggregate is bounded by codes and tribes named."""
    tribe = F.when(T.text("attributed_tribe") != "", T.strip(F.col("attributed_tribe")))
    source = F.to_json(F.array_sort(F.map_entries(F.coalesce("source_meta", F.create_map().cast("map<string,string>")))))
    return evidence.groupBy("cluster_id").agg(
        F.sort_array(F.collect_set("assigned_code")).alias("codes"), F.sort_array(F.collect_set(tribe)).alias("tribes"), F.count_distinct(source).alias("sources"),
        F.bool_or(F.coalesce("has_corroborating_clue", F.lit(False))).alias("clue"), F.bool_or(F.coalesce("definitively_other_tribe", F.lit(False))).alias("other_tribe"),
    ).withColumn("has_contradiction", F.size("tribes") > 1)


def holds(code: str) -> Column:
    return F.array_contains("codes", code)


def relation() -> Column:
    """Disputed on contradiction, else lineage, else clientage, else candidate for a bare nisba, else unknown."""
    return F.when(F.col("has_contradiction"), "D").when(holds("N1") | holds("N2"), "N").when(holds("W1"), "W").when(holds("R1"), "C").otherwise("U")


def confidence() -> Column:
    return (
        F.when(F.col("other_tribe"), 0).when(F.col("has_contradiction"), 2).when(holds("N1"), 5)
        .when(holds("N2") | holds("W1"), F.when(F.col("sources") >= 2, 4).otherwise(3))
        .when(holds("R1"), F.when(F.col("clue"), 3).otherwise(2)).when(holds("H1"), 1).otherwise(0)
    )


def final_code() -> Column:
    strongest = F.coalesce(*(F.when(holds(c), F.lit(c)) for c in PRIORITY), F.lit("U1"))
    return F.when(F.col("has_contradiction"), "D1").otherwise(strongest)


def gate() -> Column:
    accepted = (F.col("confidence") >= 4) & ~F.col("has_contradiction") & F.col("relation").isin("N", "W")
    return F.when(F.col("confidence") == 0, "REJECT").when(accepted, "ACCEPT").otherwise("REVIEW")


def gate_reason() -> Column:
    parts = lambda words: F.concat(F.lit(words[0]), F.col("confidence").cast("string"), F.lit(words[1]), F.col("relation"), F.lit(words[2]))
    return F.when(F.col("gate") == "REJECT", F.lit(REJECT_REASON)).when(F.col("gate") == "ACCEPT", parts(ACCEPT_REASON)).otherwise(parts(REVIEW_REASON))


def decide(evidence: DataFrame) -> DataFrame:
    """A row for each cluster: relation, confidence, evidence_code, gate, gate_reason, has_contradiction."""
    out = summarize(evidence).withColumn("relation", relation()).withColumn("confidence", confidence()).withColumn("evidence_code", final_code())
    return out.withColumn("gate", gate()).withColumn("gate_reason", gate_reason())


def with_traces(evidence: DataFrame) -> DataFrame:
    """decide() with rule_traces: three of each item in order, the contradiction if there is one, the gate.

    A cluster's items are one person's evidence; they are gathered in one row, as the result holds them all.
    """
    decided = decide(evidence)
    items = apply_item_rules(evidence).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("item_id", "traces"))).alias("items"))
    alert = F.when(F.col("has_contradiction"), F.array(trace("contradiction_alert", F.lit(True), F.concat(F.lit(CONTRADICTION_DETAIL), F.array_join("tribes", " / "))))).otherwise(F.array().cast("array<struct<rule:string,triggered:boolean,detail:string>>"))
    last = F.array(trace("gate_decision", F.lit(True), F.col("gate_reason")))
    every = F.concat(F.flatten(F.transform("items", lambda i: i.traces)), alert, last)
    return decided.join(items, "cluster_id").withColumn("rule_traces", every).drop("items")
