"""The corpus pipeline: documents in, packed training sequences out; part of the language-model operators.

Each stage takes (spark, docs, sf_dir), where docs holds all that the stage before kept, and returns a
DataFrame; run() writes it as Parquet to the shared folder and reads it back as the next stage's docs.  All
stages but the last return the columns of documents, further columns included and unchanged whatever their names.  Rows without an id go in the
first stage, as later ones tell rows apart by it, and null texts go with those that have no letter.  Of rows
that repeat an id one stays after the join.  An empty table gives empty stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.llm import language, near_duplicates, packing, quality_rules, repeats
from warraq.llm._common import read_table
from warraq.operators.components import shared_folder

#: A text is rejected if its profile is further than this from every language's (random letters score below 0.2).
LEAST_LANGUAGE_SCORE = 0.2


def whole_rows(docs: DataFrame) -> DataFrame:
    """docs as (_row: all of its columns, doc_id, text): what a stage adds can't meet a column of the documents."""
    return docs.select(F.struct("*").alias("_row"), "doc_id", "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in a learned language; rows without an id and texts without a letter or far from all profiles go."""
    profiles = language.learn_profiles(docs)
    found = language.identify(whole_rows(docs).filter(F.col("doc_id").isNotNull()), profiles)
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("_row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that pass the base rules and the decision list learned from the labels."""
    rules = quality_rules.learn_decision_list(quality_rules.labelled_statistics(docs, read_table(spark, sf_dir, "labels")))
    return quality_rules.apply_rules(whole_rows(docs), rules).filter("kept").select("_row.*")


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of linked texts: the one with the smallest id, of rows that repeat it the one
    whose text has the smallest hash (one row of equal rows).  Rows without a word are classes of their own."""
    rows = whole_rows(docs).withColumn("_text", F.xxhash64("text"))
    linked = near_duplicates.linked_documents(rows, keep=("_text",))
    one = F.struct("doc_id", "_text")
    heads = linked.groupBy(F.coalesce("class_key", F.encode(F.concat_ws("|", "doc_id", "_text"), "utf-8")).alias("class")).agg(F.min(one).alias("head")).select("head.*")
    return rows.dropDuplicates(["doc_id", "_text"]).join(heads, ["doc_id", "_text"], "left_semi").select("_row.*")


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings that occur earlier out of the texts (whole characters only); documents left empty go.

    Rows are told apart by their id and text, which the stage before leaves once each.
    """
    cut = repeats.cleaned_texts(docs).select("doc_id", "before", F.col("text").alias("_left")).filter(F.col("_left") != "")
    rest = F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name == "text" else f.name for f in docs.schema.fields))
    joined = docs.select(rest.alias("_row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("before")).join(cut, ["doc_id", "before"])
    changed = {"text": F.col("_left"), "n_chars": F.char_length("_left").cast("long")}
    return joined.select(*(changed[c].alias(c) if c in changed else F.col("_row")[c].alias(c) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicate_join),
    ("suffix_array_dedup", repeated_substrings),
    ("best_fit_packing", best_fit_packing),
]

#: Learned profiles, MinHash links and packing have no SQL form; tests compare the rows of the join and of the cut with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again below the shared checkpoint folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
