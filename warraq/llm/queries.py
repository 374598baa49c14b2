"""The thin queries of this package: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from warraq.llm import bpe, curves, html_main, language, lm_scores, near_duplicates, packing, passages, quality_rules, repeats
from warraq.llm._common import read_table


def op1_stupid_backoff(spark, sf_dir):
    scored = lm_scores.score_documents(read_table(spark, sf_dir, "documents"))
    return scored.withColumn("log_score", F.round("log_score", 4))


def op2_repeated_substrings(spark, sf_dir):
    return repeats.span_digests(read_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn_decision_list(quality_rules.labelled_statistics(docs, read_table(spark, sf_dir, "labels")))
    out = quality_rules.apply_rules(docs, rules)
    return out.select("doc_id", *quality_rules.BASE, "base_failed", "kept", "rule")


def op4_ngram_jaccard_join(spark, sf_dir):
    return near_duplicates.linked_documents(read_table(spark, sf_dir, "documents")).drop("class_key")


def op5_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op6_chained_passages(spark, sf_dir):
    return passages.repeated_passages(read_table(spark, sf_dir, "documents"))


def op7_bpe_codec(spark, sf_dir):
    return bpe.round_trip_digests(read_table(spark, sf_dir, "documents"))


def op8_hilbert_neighbours(spark, sf_dir):
    return curves.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def held_out(id_col="doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def op9_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    profiles = language.learn_profiles(docs.filter(~held_out()))
    return language.identify_digest(docs, profiles, [F.col("doc_id"), held_out().alias("held_out")])


def op10_html_main_text(spark, sf_dir):
    return html_main.extract(read_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_stupid_backoff, op2_repeated_substrings, op3_quality_rules, op4_ngram_jaccard_join, op5_best_fit_packing, op6_chained_passages, op7_bpe_codec, op8_hilbert_neighbours, op9_language_id, op10_html_main_text)}
ORACLE_SQL = {"op1_stupid_backoff": lm_scores.ORACLE}
