"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

1. Each batch of documents counts its distinct n-grams and deals them by hash into buckets.
2. A count table has one packed row for each order and bucket: all words, and the longer n-grams that the corpus
   holds at least `min_count` times, in order, with their counts summed over all batches.
3. The n-grams of each batch are joined with the count table by order and bucket; counts come back to the batch.
4. Scores of words are summed by document; the number of all words is one aggregate over the result.

An n-gram is in the model if the corpus holds it at least `min_count` times, so it can be only if both n-grams
a word shorter are, and orders above two are counted and joined in further rounds among those alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm._exchange import ANSWERS, QUESTIONS, Batch, Question, batches, pack, question_frame, sizes, tasks_for, unpack
from warraq.llm._words import batch_words, gram_hashes
from warraq.operators.components import cut_lineage

ORDER, BACKOFF, MIN_COUNT = 3, 0.4, 2
#: Larger than elsewhere, as n-grams that a batch repeats are sent once.
BATCH_BYTES = 8 << 20


TABLE = "kind int, bucket long, payload binary"


def count_table(questions: DataFrame, min_count: int, n_tasks: int) -> DataFrame:
    """(kind: the order, bucket, payload: n-grams in order and their counts, packed) of all words, and of longer
    n-grams that are there often enough.

    questions: n-grams of each batch by order and bucket, with how often the batch holds them.
    """

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        grams, counts = [], []
        for raw in part.payload:
            steps, own = unpack(raw, "u8", "u8")
            grams.append(np.cumsum(steps, dtype=np.uint64))
            counts.append(own)
        order = np.argsort(np.concatenate(grams), kind="stable")
        grams = np.concatenate(grams)[order]
        starts = np.flatnonzero(np.concatenate(([True], np.diff(grams) != 0)))
        sums = np.add.reduceat(np.concatenate(counts)[order], starts)
        often = sums >= np.uint64(min_count if key[1] > 1 else 1)
        return pd.DataFrame({"kind": [key[1]], "bucket": [key[0]], "payload": [pack(grams[starts][often], sums[often])]})

    return questions.repartition(n_tasks, "bucket", "kind").groupBy("bucket", "kind").applyInPandas(run, TABLE)


def looked_up(questions: DataFrame, table: DataFrame, n_tasks: int) -> DataFrame:
    """Answers to each batch: the counts of its n-grams in the order of its question, 0 where the table has none."""

    def run(key: tuple, part: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        grams, counts = unpack(rows.payload[0], "u8", "u8") if len(rows) else (np.empty(0, np.uint64), np.empty(0, np.uint64))
        press, out = zstandard.ZstdCompressor(level=1), []
        for raw in part.payload:
            asked = np.cumsum(unpack(raw, "u8", "u8")[0], dtype=np.uint64)
            found = np.zeros(len(asked), np.uint64)
            if len(grams):
                at = np.minimum(np.searchsorted(grams, asked), len(grams) - 1)
                found = np.where(grams[at] == asked, counts[at], np.uint64(0))
            out.append(press.compress(found.tobytes()))
        return pd.DataFrame({"b": part.b, "bucket": key[0], "kind": key[1], "payload": out})

    return questions.repartition(n_tasks, "bucket", "kind").groupBy("bucket", "kind").cogroup(table.groupBy("bucket", "kind")).applyInPandas(run, ANSWERS)


class Grams:
    """n-grams of a batch and their corpus counts as far as they are answered; 0 where the table has none."""

    def __init__(self, batch: Batch, n_buckets: int, order: int, min_count: int):
        self.n_buckets, self.min_count = n_buckets, min_count
        words, self.cuts = batch_words(batch)
        self.hashes = gram_hashes(words, order)
        self.place = np.arange(len(words)) - np.repeat(self.cuts[:-1], np.diff(self.cuts))
        self.counts: list[np.ndarray] = []  # by order; 0 where there is no such n-gram in the model

    def question(self, n: int) -> tuple[Question, np.ndarray, np.ndarray]:
        ask = self.place >= n - 1
        if n > 2:
            known = self.counts[n - 2] >= self.min_count
            ask[1:] &= known[1:] & known[:-1]
        at = np.flatnonzero(ask)
        keys, inverse, counts = np.unique(self.hashes[n - 1][at], return_inverse=True, return_counts=True)
        return Question(n, keys, self.n_buckets, counts.astype(np.uint64)), at, inverse

    def hear(self, n: int, answers: pd.DataFrame) -> None:
        question, at, inverse = self.question(n)
        counts = np.zeros(len(self.place), np.int64)
        counts[at] = question.answer(answers, "u8").astype(np.int64)[inverse]
        self.counts.append(counts)

    def scores(self, backoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sum of log scores but for the division by all words, words so divided, steps of backing off) of each document."""
        value = self.counts[0].astype(float)
        single = np.ones(len(value), bool)
        steps = np.zeros(len(value), np.int64)
        for n in range(2, len(self.counts) + 1):
            seen = self.counts[n - 1] >= self.min_count
            ratio = self.counts[n - 1][1:] / np.maximum(self.counts[n - 2][:-1], 1)
            has_context = self.place >= n - 1
            value = np.where(has_context & ~seen, value * backoff, value)
            steps += has_context & ~seen
            value[1:] = np.where(seen[1:], ratio, value[1:])
            steps[seen] = 0
            single &= ~seen
        owner = np.repeat(np.arange(len(self.cuts) - 1), np.diff(self.cuts))
        n_docs = len(self.cuts) - 1
        return np.bincount(owner, np.log(value), n_docs), np.bincount(owner, single, n_docs).astype(np.int64), np.bincount(owner, steps, n_docs).astype(np.int64)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """(id, n_words, log_score, n_backoffs) of each whole text.

    log_score sums ln S(w); S is count(n-gram) / count(its first n - 1 words) for the longest n-gram ending at
    the word that the corpus holds min_count times, times backoff for each longer one that the text has
    there, down to count(word) / all words.  n-grams don't cross documents.  A null, empty or blank text
    scores 0 with 0 words; rows that repeat an id count and are scored each; an empty table gives no rows;
    further columns are ignored; a null id
    stays null.
    """
    n_batches, n_buckets = sizes(docs, BATCH_BYTES)
    n_tasks = tasks_for(docs)
    dealt = batches(docs, n_batches, id_col, text_col).repartition(n_tasks, "b").groupBy("b")

    def heard(part: pd.DataFrame, answers: pd.DataFrame, upto: int) -> tuple[Batch, Grams]:
        batch = Batch(part.blob)
        grams = Grams(batch, n_buckets, order, min_count)
        for n in range(1, upto + 1):
            grams.hear(n, answers)
        return batch, grams

    def ask_first(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        grams = Grams(Batch(part.blob), n_buckets, order, min_count)
        return question_frame(key[0], [grams.question(n)[0] for n in range(1, min(order, 2) + 1)])

    def ask(n: int):
        def run(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
            return question_frame(int(part.b.iloc[0]), [heard(part, answers, n - 1)[1].question(n)[0]])

        return run

    def finish(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        batch, grams = heard(part, answers, order)
        logs, single, steps = grams.scores(backoff)
        return pd.DataFrame({id_col: batch.named(), "n_words": np.diff(grams.cuts), "_log": logs, "_single": single, "n_backoffs": steps})

    def known_to(questions: DataFrame) -> DataFrame:
        # dealt by batch once: a union of equal partitionings keeps them, so earlier answers aren't dealt anew
        return looked_up(questions, count_table(questions, min_count, n_tasks), n_tasks).repartition(n_tasks, "b")

    known = known_to(dealt.applyInPandas(ask_first, QUESTIONS))
    for n in range(3, order + 1):
        known = known.unionByName(known_to(dealt.cogroup(known.groupBy("b")).applyInPandas(ask(n), QUESTIONS)))
    scored = cut_lineage(dealt.cogroup(known.groupBy("b")).applyInPandas(finish, f"{id_col} long, n_words long, _log double, _single long, n_backoffs long"))
    words = scored.agg(F.greatest(F.sum("n_words"), F.lit(1)).alias("_all"))  # one row
    return scored.crossJoin(F.broadcast(words)).select(id_col, "n_words", (F.col("_log") - F.col("_single") * F.log("_all")).alias("log_score"), "n_backoffs")


ORACLE = """
WITH w AS (
  SELECT doc_id, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i-1] END AS p, CASE WHEN i > 2 THEN ws[i-2] END AS q
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents))
), n AS (SELECT count(*) AS total FROM w),
c1 AS (SELECT w, count(*) AS c FROM w GROUP BY w),
c2 AS (SELECT p, w, count(*) AS c FROM w WHERE p IS NOT NULL GROUP BY p, w),
c3 AS (SELECT q, p, w, count(*) AS c FROM w WHERE q IS NOT NULL GROUP BY q, p, w),
s AS (
  SELECT w.doc_id, w.p, w.q, c1.c / n.total AS s1, c2.c AS c2, c2.c / cp.c AS s2, c3.c AS c3, c3.c / cqp.c AS s3
  FROM w CROSS JOIN n JOIN c1 ON c1.w = w.w LEFT JOIN c1 cp ON cp.w = w.p
  LEFT JOIN c2 ON c2.p = w.p AND c2.w = w.w LEFT JOIN c2 cqp ON cqp.p = w.q AND cqp.w = w.p
  LEFT JOIN c3 ON c3.q = w.q AND c3.p = w.p AND c3.w = w.w
), v AS (
  SELECT doc_id,
    CASE WHEN c3 >= 2 THEN s3 WHEN c2 >= 2 THEN s2 * CASE WHEN q IS NULL THEN 1 ELSE 0.4::DOUBLE END
         WHEN p IS NULL THEN s1 WHEN q IS NULL THEN s1 * 0.4::DOUBLE ELSE s1 * 0.4::DOUBLE * 0.4::DOUBLE END AS s,
    CASE WHEN c3 >= 2 THEN 0 WHEN c2 >= 2 THEN CASE WHEN q IS NULL THEN 0 ELSE 1 END
         WHEN p IS NULL THEN 0 WHEN q IS NULL THEN 1 ELSE 2 END AS b
  FROM s)
SELECT d.doc_id, count(v.s) AS n_words, round(coalesce(sum(ln(v.s)), 0), 4) AS log_score, CAST(coalesce(sum(v.b), 0) AS BIGINT) AS n_backoffs
FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id GROUP BY d.doc_id
"""
