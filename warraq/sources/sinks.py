"""Writers: JSON and CSV files, and the evidence tables with their upserts and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.functions import text as T
from warraq.operators.index import dense_ids

SOURCE_FIELDS = ("title", "author", "publisher_editor", "edition", "volume", "page", "entry_number")
#: The publisher is no part of a source's identity.
SOURCE_KEYS = ("author", "edition", "volume", "page", "entry_number")

TABLES = {
    "review_queue": "review_id BIGINT, canonical_name STRING, kunya STRING, nisba STRING, proposed_relation STRING, proposed_evidence_code STRING, confidence_score SMALLINT, has_contradiction BOOLEAN, raw_quote STRING, source_meta STRING, rule_trace STRING, suggested_existing_person_id BIGINT, status STRING, created_at TIMESTAMP, reviewed_at TIMESTAMP, reviewer_notes STRING",
    "rejected_log": "rejected_id BIGINT, canonical_name STRING, reason STRING, raw_quote STRING, source_meta STRING, created_at TIMESTAMP",
    "person": "person_id BIGINT, canonical_name STRING, kunya STRING, nisba STRING, geographical_scope STRING, notes STRING",
    "source": "source_id BIGINT, title STRING, author STRING, publisher_editor STRING, edition STRING, volume STRING, page STRING, entry_number STRING",
    "affiliation": "affiliation_id BIGINT, person_id BIGINT, affiliation_type STRING, evidence_code STRING, confidence_score SMALLINT, verification_status STRING",
    "evidence": "evidence_id BIGINT, person_id BIGINT, source_id BIGINT, claim_type STRING, quotation STRING, confidence SMALLINT, notes STRING",
}
#: The note of persons that the accept route inserts.
ACCEPT_NOTE = "أُدرج آلياً — بوابة ACCEPT"


def ensure_tables(spark, database: str) -> None:
    """Creates what is missing; running it again changes nothing."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def new_sources(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of wanted (SOURCE_FIELDS) to insert, with ids after the greatest one.

    Equal are title and, with nulls as empty, all other fields but the publisher.  A null title equals none,
    not even another null, so such rows are always new.  Copies within the batch are one row.
    """
    same = [F.coalesce(F.col(c), F.lit("")).alias(f"k_{c}") for c in SOURCE_KEYS]
    keys = [f"k_{c}" for c in SOURCE_KEYS]
    rows = wanted.select(*SOURCE_FIELDS, *same)
    named = rows.filter("title IS NOT NULL").groupBy("title", *keys).agg(F.min(F.struct(*(c for c in SOURCE_FIELDS if c != "title"))).alias("v")).select("title", "v.*", *keys)
    fresh = named.join(source.select("title", *same), ["title", *keys], "left_anti").select(*SOURCE_FIELDS)
    fresh = fresh.union(rows.filter("title IS NULL").select(*SOURCE_FIELDS))
    return numbered(fresh, "source_id", source, list(SOURCE_FIELDS))


def numbered(rows: DataFrame, id_col: str, table: DataFrame, order: list[str]) -> DataFrame:
    """rows with dense ids after the greatest of the table."""
    top = table.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    return dense_ids(rows, order, id_col, int(top) + 1).select(id_col, *[c for c in rows.columns if c != id_col])


def accepted(results: DataFrame, matched: DataFrame) -> DataFrame:
    """Accepted persons with the id of the known person they match, if any, and the columns of a new one."""
    rows = results.filter("gate = 'ACCEPT'").join(matched.select(F.col("idx").alias("cluster_id"), F.col("person_id").alias("matched_id")), "cluster_id", "left")
    scope = F.array_join("geographical_mentions", " / ")
    return rows.withColumn("geographical_scope", F.when(scope != "", scope)).withColumn("notes", F.lit(ACCEPT_NOTE)).withColumn("verification_status", F.lit("Verified"))


def review_rows(results: DataFrame, suggested: DataFrame) -> DataFrame:
    """Columns of review_queue but ids and times, with the likeliest known person."""
    rows = results.filter("gate = 'REVIEW'").join(suggested.select(F.col("idx").alias("cluster_id"), "person_id"), "cluster_id", "left")
    return rows.select("canonical_name", "kunya", F.lit(None).cast("string").alias("nisba"), F.col("relation").alias("proposed_relation"), F.col("evidence_code").alias("proposed_evidence_code"), F.col("confidence").cast("smallint").alias("confidence_score"), "has_contradiction", "raw_quote", F.to_json("source_meta").alias("source_meta"), F.to_json("rule_traces").alias("rule_trace"), F.col("person_id").alias("suggested_existing_person_id"), F.lit("pending").alias("status"))


def reject_rows(results: DataFrame) -> DataFrame:
    return results.filter("gate = 'REJECT'").select("canonical_name", F.col("gate_reason").alias("reason"), "raw_quote", F.to_json("source_meta").alias("source_meta"))


def write_decisions(spark, database: str, results: DataFrame, evidence: DataFrame, known: DataFrame | None = None) -> None:
    """Appends accepted, reviewed and rejected persons; evidence: cluster_id, claim_type, raw_quote, assigned_code, source_meta."""
    from warraq.operators import resolve
    from warraq.operators.components import cut_lineage

    ensure_tables(spark, database)
    person = known if known is not None else spark.table(f"{database}.person")
    people = results.select(F.col("cluster_id").alias("idx"), "canonical_name", "kunya", F.lit(None).cast("string").alias("death_year_mentioned"), "geographical_mentions", F.array().cast("array<string>").alias("teachers"), F.array().cast("array<string>").alias("students"))
    taken = accepted(results, resolve.match_known(people, person))
    fresh = numbered(taken.filter("matched_id IS NULL").select("cluster_id", "canonical_name", "kunya", F.lit(None).cast("string").alias("nisba"), "geographical_scope", "notes", "relation", "evidence_code", "confidence", "verification_status"), "person_id", person, ["cluster_id"])
    fresh = cut_lineage(fresh)
    source = spark.table(f"{database}.source")
    meta = evidence.select("cluster_id", "claim_type", "raw_quote", "assigned_code", *(F.col("source_meta")[c].alias(c) for c in SOURCE_FIELDS))
    sources = cut_lineage(new_sources(source, meta.join(taken.select("cluster_id"), "cluster_id", "left_semi")))
    every = source.unionByName(sources)
    ids = fresh.select("cluster_id", "person_id").union(taken.filter("matched_id IS NOT NULL").select("cluster_id", "matched_id"))
    on = [F.col("m.title") == F.col("s.title"), *(F.coalesce(F.col(f"m.{c}"), F.lit("")) == F.coalesce(F.col(f"s.{c}"), F.lit("")) for c in SOURCE_KEYS)]
    rows = meta.join(ids, "cluster_id").join(taken.select("cluster_id", "confidence"), "cluster_id").alias("m").join(every.alias("s"), on, "left")
    note = F.concat(F.lit("مُدخَل آلياً — assigned_code="), "assigned_code")
    proof = rows.select("person_id", "s.source_id", "claim_type", F.col("raw_quote").alias("quotation"), F.col("confidence").cast("smallint").alias("confidence"), note.alias("notes"))
    affiliation = fresh.select("person_id", F.col("relation").alias("affiliation_type"), "evidence_code", F.col("confidence").cast("smallint").alias("confidence_score"), "verification_status")
    review, reject = review_rows(results, resolve.match_known(people, person, resolve.REVIEW)), reject_rows(results)
    stamped = lambda df: df.withColumn("created_at", F.current_timestamp())
    ready = []  # all of them before the first insert, as they read the tables
    for name, id_col, df in (("source", None, sources), ("person", None, fresh), ("affiliation", "affiliation_id", affiliation), ("evidence", "evidence_id", proof), ("review_queue", "review_id", stamped(review)), ("rejected_log", "rejected_id", stamped(reject))):
        table = spark.table(f"{database}.{name}")
        full = numbered(df, id_col, table, [c for c in df.columns if c != "created_at"]) if id_col else df
        ready.append((name, cut_lineage(full.select(*(F.col(c) if c in full.columns else F.lit(None).alias(c) for c in table.columns)))))
    for name, rows in ready:
        rows.write.insertInto(f"{database}.{name}")


def json_lines(df: DataFrame, folder: str) -> None:
    """One compact JSON object a row, text beyond ASCII as it is, nulls left out."""
    df.write.mode("overwrite").json(folder)


def quoted_csv(df: DataFrame, folder: str) -> None:
    """Every field quoted, with a header."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(folder)


def csv_report(rows: list[tuple], header: tuple[str, ...]) -> bytes:
    """A small report with byte-order mark, plain header, quoted fields and CRLF; for rows already at the driver."""
    lines = [",".join(header), *(",".join('"' + str(v).replace('"', '""') + '"' for v in r) for r in rows)]
    return ("﻿" + "\r\n".join(lines) + "\r\n").encode()


def csv_line(*columns: str) -> Column:
    """A row as one CSV line, every field quoted."""
    return F.concat_ws(",", *(F.concat(F.lit('"'), F.replace(T.text(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns))
