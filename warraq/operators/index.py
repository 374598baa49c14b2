"""Inverted index as tables: weighted postings, lengths, dictionary, stems, corpus figures, categories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warraq.functions import constants as C
from warraq.functions import text as T
from warraq.operators.components import cut_lineage

FIELDS = tuple(C.FIELD_WEIGHTS)
PASSAGE_COLUMNS = ("title", "section", "type", "url", "desc", "heading", "keywords", "alt", "body", "img", "updated", "source")


def as_passages(docs: DataFrame, body: str = "text", section: str = "source") -> DataFrame:
    """Plain documents as passages: the first line is the title, its source the section, 220 characters the description."""
    whole = T.text(body)
    empty = {c: F.lit("") for c in ("type", "url", "heading", "keywords", "alt", "img", "updated")}
    return docs.select(
        "doc_id", F.substring_index(whole, "\n", 1).alias("title"), T.text(section).alias("section"), F.substring(whole, 1, C.DESC_CHARS).alias("desc"),
        whole.alias("body"), T.text(section).alias("source"), *(v.alias(k) for k, v in empty.items()), F.lit(1.0).alias("rank"),
    )


def field_tokens(passages: DataFrame, compose: bool = False) -> DataFrame:
    """(doc_id, weight, token) of every field, stop words left out; one Generate over one scan."""
    fields = [c for c in FIELDS if c in passages.columns]
    parts = [F.struct(F.lit(C.FIELD_WEIGHTS[c]).alias("weight"), T.without_stops(T.tokens_of(T.normalize_index(c, compose))).alias("tokens")) for c in fields]
    rows = passages.select("doc_id", F.explode(F.array(*parts)).alias("f"))
    return rows.select("doc_id", F.col("f.weight").alias("weight"), F.explode("f.tokens").alias("token"))


def postings(tokens: DataFrame) -> DataFrame:
    """(doc_id, term, wtf, n): the sum of field weights, rounded to two places, and how often the term is there."""
    return tokens.groupBy("doc_id", F.col("token").alias("term")).agg(F.round(F.sum("weight"), 2).alias("wtf"), F.count("*").alias("n"))


def lengths(passages: DataFrame, posted: DataFrame) -> DataFrame:
    """(doc_id, l): unweighted tokens, one at least."""
    counted = posted.groupBy("doc_id").agg(F.sum("n").alias("n"))
    return passages.select("doc_id").join(counted, "doc_id", "left").select("doc_id", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("l"))


def dictionary(posted: DataFrame) -> DataFrame:
    """(term, df)."""
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def corpus_figures(doc_lengths: DataFrame) -> DataFrame:
    """One row: n_docs, avg_len."""
    return doc_lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("l"), F.lit(0.0)).alias("avg_len"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def stem_map(terms: DataFrame, stemmer=T.stem_index) -> DataFrame:
    """(stem, term) where the stem is another string of three characters or more."""
    stemmed = terms.select(stemmer("term").alias("stem"), "term").filter((F.col("stem") != F.col("term")) & (F.char_length("stem") >= 3))
    return stemmed.distinct()


def section_counts(passages: DataFrame) -> DataFrame:
    return passages.groupBy("section").agg(F.count("*").alias("n"))


def epoch_ms(date: Column) -> Column:
    """Milliseconds since 1970 of an ISO date or time, in UTC where it names no zone; 0 for anything else."""
    whole = F.when(date.rlike(r"^\d{4}$"), F.concat(date, F.lit("-01-01"))).when(date.rlike(r"^\d{4}-\d\d$"), F.concat(date, F.lit("-01"))).otherwise(date)
    zoned = F.when(whole.rlike(r"[Tt ].*(Z|[+-]\d\d:?\d\d)$"), whole).when(whole.rlike(r"\d[Tt ]\d"), F.concat(whole, F.lit("Z"))).otherwise(F.concat(whole, F.lit("T00:00:00Z")))
    return F.coalesce(F.when(date.rlike(r"^\d{4}"), F.unix_millis(F.try_to_timestamp(zoned))), F.lit(0))


def stored_documents(passages: DataFrame, doc_lengths: DataFrame, compose: bool = False) -> DataFrame:
    """What ranking and display need of a passage: i, t, s, y, u, d, b, g, n, nt, r, m, l (n and nt: normalized)."""
    joined = F.concat_ws(" ", *(T.text(c) for c in ("title", "section", "keywords", "heading", "desc", "body")))
    return passages.join(doc_lengths, "doc_id").select(
        F.col("doc_id").alias("i"), F.col("title").alias("t"), F.col("section").alias("s"), F.col("type").alias("y"), F.col("url").alias("u"), F.col("desc").alias("d"),
        F.substring("body", 1, C.STORED_BODY).alias("b"), F.col("img").alias("g"), F.substring(T.normalize_index(joined, compose), 1, C.STORED_TEXT).alias("n"), T.normalize_query("title", compose).alias("nt"), F.col("rank").alias("r"), epoch_ms(T.text("updated")).alias("m"), "l",
    )


@dataclass
class Index:
    """The tables of one index; all of them are plans, nothing runs until one is used or written."""

    documents: DataFrame
    postings: DataFrame
    terms: DataFrame
    stems: DataFrame
    figures: DataFrame
    sections: DataFrame

    @classmethod
    def build(cls, passages: DataFrame, compose: bool = False) -> Index:
        return cls.around(passages, postings(field_tokens(passages, compose)), compose)

    @classmethod
    def around(cls, passages: DataFrame, posted: DataFrame, compose: bool) -> Index:
        """The tables that follow from the postings: texts are read once for these and once to store them."""
        terms, sized = dictionary(posted), lengths(passages, posted)
        return cls(stored_documents(passages, sized, compose), posted, terms, stem_map(terms), corpus_figures(sized), section_counts(passages))

    @classmethod
    def create(cls, passages: DataFrame, folder: str, compose: bool = False) -> Index:
        """Builds and saves an index: postings first, all else from the saved ones.

        Texts are dealt by document before they become postings, so only they are shuffled, and no posting.
        """
        cls._write_postings(postings(field_tokens(passages.repartition("doc_id"), compose)), folder)
        cls.around(passages, passages.sparkSession.read.parquet(f"{folder}/postings"), compose)._write_rest(folder)
        return cls.load(passages.sparkSession, folder)

    @staticmethod
    def _write_postings(posted: DataFrame, folder: str) -> None:
        """Each file has its documents' postings by term, so a term is a short run in each and no task has all of a frequent one."""
        posted.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{folder}/postings")

    def _write_rest(self, folder: str) -> None:
        for name, table in vars(self).items():
            if name != "postings":
                table.write.mode("overwrite").parquet(f"{folder}/{name}")

    def save(self, folder: str) -> None:
        self._write_postings(self.postings, folder)
        self._write_rest(folder)

    @classmethod
    def load(cls, spark, folder: str) -> Index:
        """A saved index; one without its columns, or with documents and no postings, is refused."""
        tables = {name: spark.read.parquet(f"{folder}/{name}") for name in cls.__dataclass_fields__}
        for name, needed in (("documents", {"i", "t", "n", "nt", "l"}), ("postings", {"term", "doc_id", "wtf"}), ("terms", {"term", "df"})):
            if not needed <= set(tables[name].columns):
                raise ValueError(f"not an index: {name} lacks {sorted(needed - set(tables[name].columns))}")
        if tables["postings"].isEmpty() and not tables["documents"].isEmpty():
            raise ValueError("not an index: it has documents and no postings")
        return cls(**tables)


def category_index(passages: DataFrame, category: str, folder: str | None = None, compose: bool = False) -> Index:
    """An index of one category with its own figures and dense ids in the order of the master's, saved where a folder is given."""
    own = dense_ids(passages.filter(F.array_contains("categories", category)), ["doc_id"], "doc_id")
    return Index.create(own, folder, compose) if folder else Index.build(own, compose)


def dense_ids(df: DataFrame, order: list[str], out: str, first: int = 0) -> DataFrame:
    """df with numbers from `first` in the given order, without a window over all rows.

    Rows are range-partitioned and sorted, and written to the checkpoint folder; numbers count within a
    partition, and one row for each partition tells how many come before it.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_before", F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_p").withColumn(out, (F.col("_before") + F.col("_k") + first).cast("long")).drop("_p", "_k", "_before")
