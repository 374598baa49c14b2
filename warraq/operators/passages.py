"""From parsed sections to passages: chunks, categories, content filter and both ways of removing duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.functions import constants as C
from warraq.functions import text as T

CUT = "\u0001"


def chunks(text: Column, limit: int = C.PASSAGE_CHARS) -> Column:
    """Pieces of at most `limit` characters: sentences (ends . ! ؟ ؛; an ASCII ? is none) packed greedily, longer ones cut.

    One fold over the sentences of a row; its state is the closed pieces and the open one.
    """
    cleaned = T.clean_text(text)
    pieces = F.filter(F.split(F.regexp_replace(cleaned, r"([.!؟؛])\s+", f"$1{CUT}"), CUT), lambda s: s != "")

    def step(state: Column, s: Column) -> Column:
        full = (F.char_length(state.open) + F.char_length(s) + 1 > limit) & (state.open != "")
        closed = F.when(full, F.array_append(state.closed, state.open)).otherwise(state.closed)
        open_ = F.when(full, F.lit("")).otherwise(state.open)
        count = F.when(F.char_length(s) > limit, F.ceil(F.char_length(s) / limit) - 1).otherwise(F.lit(0)).cast("int")
        whole = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: F.substring(s, k * limit + 1, F.lit(limit)))).otherwise(F.array().cast("array<string>"))
        rest = F.substring(s, count * limit + 1, F.lit(limit))
        return F.struct(F.concat(closed, whole).alias("closed"), F.trim(F.concat(open_, F.lit(" "), rest)).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("closed"), F.lit("").alias("open"))
    packed = F.aggregate(pieces, start, step, lambda s: F.when(s.open != "", F.array_append(s.closed, s.open)).otherwise(s.closed))
    return F.when(cleaned == "", F.array().cast("array<string>")).when(F.char_length(cleaned) <= limit, F.array(cleaned)).otherwise(packed)


def make_passages(sections: DataFrame, limit: int = C.PASSAGE_CHARS) -> DataFrame:
    """A row for each chunk of body; its title is the heading or title, numbered from the second chunk on.

    sections: title, section, type, url, body, and optionally desc, heading, keywords, alt, img, updated, rank, source;
    other columns pass.
    """
    have = set(sections.columns)
    for name in ("desc", "heading", "keywords", "alt", "img", "updated", "source"):
        if name not in have:
            sections = sections.withColumn(name, F.lit(""))
    if "rank" not in have:
        sections = sections.withColumn("rank", F.lit(1.0))
    own = ("title", "section", "type", "url", "body", "desc", "heading", "keywords", "alt", "img", "updated", "source", "rank")
    rest = [c for c in sections.columns if c not in (*own, "passage_no")]
    rows = sections.select(*rest, *own, F.posexplode(chunks(F.col("body"), limit)).alias("passage_no", "passage"))
    name = F.when(T.text("heading") != "", F.col("heading")).otherwise(F.col("title"))
    name = F.when(F.col("passage_no") > 0, F.concat(name, F.lit(C.PART_LABEL), (F.col("passage_no") + 1).cast("string"))).otherwise(name)
    first = lambda a, b: F.when(T.text(a) != "", T.text(a)).otherwise(b)
    return rows.select(
        *rest, "passage_no", T.clean_text(name).alias("title"), T.clean_text(first("section", T.text("title"))).alias("section"), T.text("type").alias("type"), T.text("url").alias("url"),
        T.clean_text(first("desc", F.substring("passage", 1, C.DESC_CHARS))).alias("desc"), T.clean_text("heading").alias("heading"), T.clean_text("keywords").alias("keywords"),
        T.clean_text("alt").alias("alt"), F.substring("passage", 1, C.BODY_CHARS).alias("body"), T.text("img").alias("img"), T.text("updated").alias("updated"), T.text("source").alias("source"), "rank",
    )


def classify(passages: DataFrame, patterns: dict[str, str] | None = None, default: str = "heritage", with_files: bool = True) -> DataFrame:
    """passages with an array of categories: all whose pattern matches, those of the file's kind, or the default."""
    head = F.concat_ws(" ", *(T.text(c) for c in ("source", "title", "section", "type", "keywords")), F.substring("body", 1, 1200))
    tests = [F.when(head.rlike(f"(?iu){p}"), F.lit(name)) for name, p in (patterns or C.CATEGORY_PATTERNS).items()]
    if with_files:
        kind = F.lower(F.regexp_extract("source", r"(\.[^./#]+)(?:#.*)?$", 1))
        tests += [F.when(kind.isin(".rdf", ".owl", ".xml", ".jsonld"), F.lit("ontology")), F.when(kind.isin(".pdf", ".docx"), F.lit("books")), F.when(kind.isin(".md", ".markdown"), F.lit("articles")), F.when(F.lower("source").contains("ansab"), F.lit("genealogy"))]
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*tests))))
    return passages.withColumn("categories", F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found))


def with_content(passages: DataFrame, least: int = 8) -> DataFrame:
    """Passages with a title and eight characters or more of normalized title and body."""
    joined = T.normalize_index(F.concat_ws(" ", T.text("title"), T.text("body")))
    return passages.filter((T.text("title") != "") & (F.char_length(joined) >= least))


def deduplicate(passages: DataFrame, order: str = "doc_id") -> DataFrame:
    """One passage for each normalized url, title and start of body: the first; categories of all united.

    Aggregated before and after the shuffle, so a key that fills the table moves one row for each task.
    """
    key = T.normalize_index(F.concat(T.text("url"), F.lit("|"), T.text("title"), F.lit("|"), F.substring(T.text("body"), 1, 180)))
    others = [c for c in passages.columns if c != "categories"]
    rows = with_content(passages).select(key.alias("_key"), F.struct(order, *[c for c in others if c != order]).alias("_row"), *(["categories"] if "categories" in passages.columns else []))
    if "categories" not in passages.columns:
        return rows.groupBy("_key").agg(F.min_by("_row", F.col(f"_row.{order}")).alias("_row")).select("_row.*").select(*others)
    labels = rows.select("_key", F.explode("categories").alias("c")).distinct().groupBy("_key").agg(F.sort_array(F.collect_set("c")).alias("categories"))
    heads = rows.groupBy("_key").agg(F.min_by("_row", F.col(f"_row.{order}")).alias("_row"))
    return heads.join(labels, "_key", "left").select("_row.*", "categories").select(*passages.columns)


def deduplicate_longest(passages: DataFrame, order: str = "doc_id") -> DataFrame:
    """One passage for each url and title start: the first, with the longest body and the first image of all."""
    key = F.concat(T.text("url"), F.lit("|"), F.substring(T.text("title"), 1, 80))
    rows = with_content(passages).withColumn("_key", key)
    kept = [c for c in passages.columns if c not in ("body", "img")]
    place = F.struct(F.char_length("body"), -F.col(order))
    first = F.min_by(F.struct(*kept), F.col(order)).alias("_row")
    image = F.min_by(F.when(T.text("img") != "", F.col("img")), F.when(T.text("img") != "", F.col(order))).alias("img")
    out = rows.groupBy("_key").agg(first, F.max_by("body", place).alias("body"), F.coalesce(image, F.lit("")).alias("img"))
    return out.select("_row.*", "body", "img").select(*passages.columns)
