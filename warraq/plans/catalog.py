"""The query catalogue: each entry applies operators to the driver's tables; ORACLE_SQL has the same in DuckDB SQL.

The tables hold no Arabic text, so letter folds and marks are left out of the SQL; golden tests cover them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.functions import constants as C
from warraq.functions import text as T
from warraq.operators import components as linked
from warraq.operators import expand, graph, hybrid, index, passages, places, present, rank, resolve, rules, tiers
from warraq.plans.archive import with_section_rank
from warraq.sources import files, live, sinks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


# --- SQL pieces -----------------------------------------------------------------------------------------


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def toks(x: str) -> str:
    return f"list_transform(list_filter(string_split({norm(x)}, ' '), lambda t: length(t) >= 2 OR regexp_full_match(t, '\\p{{Nd}}+')), lambda t: substr(t, 1, 40))"


STOPS = "[" + ", ".join(f"'{w}'" for w in C.STOP_WORDS) + "]"


def content(x: str) -> str:
    return f"list_filter({toks(x)}, lambda t: NOT list_contains({STOPS}, t))"


def sql_stem_index(t: str) -> str:
    cases = "".join(f" WHEN {t} LIKE '%{s}' AND length({t}) >= {len(s) + 3} THEN substr({t}, 1, length({t}) - {len(s)})" for s in C.ENGLISH_SUFFIXES)
    return f"CASE WHEN length({t}) < 4 THEN {t} WHEN {t} LIKE '%ies' THEN substr({t}, 1, length({t}) - 3) || 'y'{cases} ELSE {t} END"


def sql_stem_query(t: str) -> str:
    cut = lambda k: f"substr({t}, 1, length({t}) - {k})"
    return (
        f"CASE WHEN length({t}) < 4 THEN {t} WHEN {t} LIKE '%ies' THEN {cut(3)} || 'y' WHEN regexp_matches({t}, '(sses|shes|ches|xes)$') THEN {cut(2)} "
        f"WHEN {t} LIKE '%ing' AND length({t}) > 5 THEN {cut(3)} WHEN {t} LIKE '%ed' AND length({t}) > 4 THEN {cut(2)} WHEN {t} LIKE '%ly' AND length({t}) > 4 THEN {cut(2)} "
        f"WHEN {t} LIKE '%s' AND {t} NOT LIKE '%ss' THEN {cut(1)} ELSE {t} END"
    )


PASSAGES_CTE = "pas AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(source, '') AS section, substr(coalesce(text, ''), 1, 220) AS \"desc\", coalesce(text, '') AS body FROM documents)"
FIELD_SQL = {"title": 8.0, "section": 3.5, "desc": 2.0, "body": 1.0}
TOKENS_CTE = (
    PASSAGES_CTE
    + ", tok AS (SELECT doc_id, weight, unnest(ts) AS token FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, {w}::DOUBLE AS weight, {content(chr(34) + c + chr(34))} AS ts FROM pas" for c, w in FIELD_SQL.items())
    + "))"
)
INDEX_CTE = (
    TOKENS_CTE + ", post AS (SELECT token AS term, doc_id, round(sum(weight), 2) AS wtf FROM tok GROUP BY ALL)"
    ", len AS (SELECT pas.doc_id, greatest(count(tok.token), 1) AS l FROM pas LEFT JOIN tok USING (doc_id) GROUP BY pas.doc_id)"
    ", dict AS (SELECT term, count(*) AS df FROM post GROUP BY term)"
    ", fig AS (SELECT count(*) AS n_docs, avg(l) AS avg_len FROM len)"
    f", stm AS (SELECT DISTINCT {sql_stem_index('term')} AS stem, term FROM dict WHERE {sql_stem_index('term')} <> term AND length({sql_stem_index('term')}) >= 3)"
)
SEARCHES = [(1, "The thing licensed"), (2, "public license"), (3, "tion thonti"), (4, "und der die"), (5, "Anti the"), (6, "zzzzqq")]
QT_CTE = (
    "qs(query_id, q) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in SEARCHES) + ")"
    f", qn AS (SELECT query_id, {norm('q')} AS nq, {content('q')} AS ts FROM qs)"
    ", qt AS (SELECT query_id, pos - 1 AS pos, ts[pos] AS token FROM (SELECT query_id, ts, unnest(range(1, len(ts) + 1)) AS pos FROM qn))"
)
EXACT_SQL = "SELECT query_id, term, 1.0::DOUBLE AS quality, pos AS grp, 0 AS seq FROM qt JOIN dict ON dict.term = qt.token"
PREFIX_SQL = (
    "SELECT query_id, term, 0.8::DOUBLE * (length(token) / length(term)) AS quality, pos AS grp, 1 AS seq FROM (SELECT qt.*, term, row_number() OVER (PARTITION BY query_id, pos ORDER BY encode(term)) AS k "
    "FROM qt JOIN dict ON starts_with(term, token) WHERE length(token) >= 2) WHERE k <= 12 AND term <> token"
)
STEMS_SQL = (
    f"SELECT query_id, term, 0.72::DOUBLE AS quality, pos AS grp, 2 AS seq FROM qt JOIN dict ON dict.term = {sql_stem_query('token')} WHERE {sql_stem_query('token')} <> token "
    f"UNION ALL SELECT query_id, term, 0.7::DOUBLE, pos, 3 FROM (SELECT query_id, pos, token AS stem FROM qt UNION SELECT query_id, pos, {sql_stem_query('token')} FROM qt) JOIN stm USING (stem)"
)
CONCEPTS = [("law", "public license", "term"), ("law", "license", "term"), ("law", "warranty", "related"), ("law", "software", "related"), ("thing", "thing", "term"), ("thing", "tion", "related")]
CONCEPTS_CTE = (
    "con(id, term, kind) AS (VALUES " + ", ".join(map(str, CONCEPTS)) + ")"
    ", keys AS (SELECT id, term AS key FROM con WHERE kind = 'term' UNION SELECT id, unnest(list_filter(string_split(term, ' '), lambda w: length(w) > 2)) FROM con WHERE kind = 'term' AND contains(term, ' '))"
    ", named AS (SELECT DISTINCT query_id, id FROM (SELECT query_id, nq AS key FROM qn UNION SELECT query_id, unnest(string_split(nq, ' ')) FROM qn) JOIN keys USING (key))"
    ", cw AS (SELECT query_id, w AS term, max(weight) AS weight FROM (SELECT query_id, unnest(string_split(term, ' ')) AS w, CASE kind WHEN 'term' THEN 0.85::DOUBLE ELSE 0.45 END AS weight FROM named JOIN con USING (id)) GROUP BY ALL)"
)
CONCEPT_SQL = (
    "SELECT query_id, term, weight AS quality, NULL::INT AS grp, 5 AS seq FROM cw JOIN dict USING (term) UNION ALL SELECT query_id, term, weight * 0.8::DOUBLE, NULL, 6 FROM "
    "(SELECT cw.query_id, dict.term, weight, row_number() OVER (PARTITION BY query_id, cw.term ORDER BY encode(dict.term)) AS k FROM cw JOIN dict ON starts_with(dict.term, cw.term) WHERE weight >= 0.8) WHERE k <= 4"
)


def distance(a: str, b: str) -> str:
    """Distance in characters: the SQL's function counts bytes, so the letters beyond ASCII become capitals, which terms don't hold."""
    one = lambda x: f"translate({x}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"
    return f"levenshtein({one(a)}, {one(b)})"


FUZZY_SQL = (
    "SELECT query_id, pos, token, term, dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id, pos ORDER BY dist, length(term), encode(term)) AS k FROM (SELECT query_id, pos, token, term, " + distance("token", "term") + " AS dist, "
    "CASE WHEN length(token) <= 3 THEN 0 WHEN length(token) <= 5 THEN 1 ELSE 2 END AS budget FROM qt JOIN dict ON substr(term, 1, 1) = substr(token, 1, 1) AND abs(length(term) - length(token)) <= 2) WHERE dist > 0 AND dist <= budget) WHERE k <= 8"
)
FUZZY_OFFERS_SQL = f"SELECT query_id, term, 0.6::DOUBLE * (1 - dist / greatest(3, length(token))) AS quality, pos AS grp, 4 AS seq FROM ({FUZZY_SQL})"
CANDIDATES_CTE = (
    f"{INDEX_CTE}, {QT_CTE}, {CONCEPTS_CTE}, offers AS ({EXACT_SQL} UNION ALL {PREFIX_SQL} UNION ALL {STEMS_SQL} UNION ALL {FUZZY_OFFERS_SQL} UNION ALL {CONCEPT_SQL})"
    ", cand AS (SELECT query_id, term, quality, grp FROM (SELECT *, row_number() OVER (PARTITION BY query_id, term ORDER BY quality DESC, grp NULLS LAST, seq) AS k FROM offers) WHERE k = 1)"
)
BM25_CTE = (
    CANDIDATES_CTE + ", sc AS (SELECT query_id, doc_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * quality * (wtf * 2.2 / (wtf + 1.2 * (0.4 + 0.6 * (l / avg_len)))) ORDER BY encode(term)) AS score, count(DISTINCT grp) AS groups, list_sort(list(DISTINCT term)) AS terms "
    "FROM cand JOIN dict USING (term) CROSS JOIN fig JOIN post USING (term) JOIN len USING (doc_id) GROUP BY query_id, doc_id)"
)
BOOST_CTE = (
    BM25_CTE + ", need AS (SELECT query_id, nq, greatest(len(ts), 1) AS need FROM qn)"
    f", docn AS (SELECT doc_id, section, title, substr({norm(chr(39) * 2 + ' || title || ' + chr(39) + ' ' + chr(39) + ' || section || ' + chr(39) + '   ' + chr(39) + ' || ' + chr(34) + 'desc' + chr(34) + ' || ' + chr(39) + ' ' + chr(39) + ' || body')}, 1, 6000) AS n, {norm('title')} AS nt FROM pas)"
    ", bo AS (SELECT query_id, doc_id, section, score, groups, need, terms, nq, title, CASE WHEN groups = 0 THEN 0.35::DOUBLE ELSE 0.55::DOUBLE + 0.45::DOUBLE * least(1.0::DOUBLE, groups / need) END AS coverage,"
    " CASE WHEN need > 1 AND contains(n, nq) THEN 1.6::DOUBLE ELSE 1 END AS phrase, CASE WHEN nt = nq THEN 2.2::DOUBLE WHEN starts_with(nt, nq) THEN 1.7 WHEN contains(nt, nq) THEN 1.35 ELSE 1 END AS title_boost"
    " FROM sc JOIN need USING (query_id) JOIN docn USING (doc_id))"
    ", ranked AS (SELECT query_id, doc_id, section, terms, nq, title, score * coverage * phrase * title_boost AS score FROM bo)"
    ", kept AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM ranked) WHERE score >= 0.06::DOUBLE * best)"
)


def searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEARCHES, "query_id int, q string")


_SAVED: dict[tuple, str] = {}


def built(spark, sf_dir) -> index.Index:
    """The index of the documents, built once for each session and set of files, in the shared folder."""
    docs = documents(spark, sf_dir)
    key = (spark.sparkContext.applicationId, *sorted(docs.inputFiles()))
    if key not in _SAVED:
        folder = f"{linked.shared_folder(spark)}/index-{uuid.uuid4().hex}"
        index.Index.create(index.as_passages(docs), folder)
        _SAVED[key] = folder
    return index.Index.load(spark, _SAVED[key])


def offered(spark, ix: index.Index) -> DataFrame:
    return expand.candidates(searches(spark), ix.terms, ix.stems, spark.createDataFrame(CONCEPTS, "id string, term string, kind string"))


def scored(spark, sf_dir):
    ix = built(spark, sf_dir)
    return ix, rank.bm25(offered(spark, ix), ix)


def kept(spark, sf_dir):
    ix, s = scored(spark, sf_dir)
    return rank.above_floor(rank.boosted(s, searches(spark), ix))


# --- text -----------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {norm('coalesce(text, chr(32))')} AS n FROM documents")
def normalize_docs(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.normalize_index("text").alias("n"))


@query(f"SELECT doc_id, len({toks('text')}) AS n_tokens, array_to_string({toks('text')}, ' ') AS tokens FROM documents")
def tokenize_docs(spark, sf_dir):
    tokens = T.tokens_of(T.normalize_index("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.array_join(tokens, " ").alias("tokens"))


@query(f"SELECT doc_id, len({content('text')}) AS n_tokens, array_to_string({content('text')}, ' ') AS tokens FROM documents")
def stopword_filter(spark, sf_dir):
    tokens = T.without_stops(T.tokens_of(T.normalize_index("text")))
    return documents(spark, sf_dir).select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.array_join(tokens, " ").alias("tokens"))


def _words(spark, sf_dir):
    return documents(spark, sf_dir).select(F.explode(T.tokens_of(T.normalize_index("text"))).alias("token")).distinct()


WORDS_SQL = f"(SELECT DISTINCT unnest({toks('text')}) AS token FROM documents)"


@query(f"SELECT token, {sql_stem_index('token')} AS stem FROM {WORDS_SQL}")
def stem_index_flavour(spark, sf_dir):
    return _words(spark, sf_dir).select("token", T.stem_index("token").alias("stem"))


@query(f"SELECT token, {sql_stem_query('token')} AS stem FROM {WORDS_SQL}")
def stem_query_flavour(spark, sf_dir):
    return _words(spark, sf_dir).select("token", T.stem_query("token").alias("stem"))


@query("SELECT p_partkey, replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, CAST(nullif(regexp_extract(p_brand, '(\\d+)', 1), '') AS BIGINT) AS brand_no FROM part")
def scalar_escape_number(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.escape_html("p_name").alias("escaped"), T.first_number("p_brand").alias("brand_no"))


# --- index ----------------------------------------------------------------------------------------------


@query(f"WITH {INDEX_CTE} SELECT term, doc_id, wtf FROM post")
def weighted_postings(spark, sf_dir):
    return built(spark, sf_dir).postings.select("term", "doc_id", "wtf")


@query(f"WITH {INDEX_CTE} SELECT doc_id, l FROM len")
def doc_length(spark, sf_dir):
    return built(spark, sf_dir).documents.select(F.col("i").alias("doc_id"), "l")


@query(f"WITH {INDEX_CTE} SELECT n_docs, round(avg_len, 6) AS avg_len FROM fig")
def corpus_stats(spark, sf_dir):
    return built(spark, sf_dir).figures.withColumn("avg_len", F.round("avg_len", 6))


@query(f"WITH {INDEX_CTE} SELECT term, df FROM dict")
def term_dictionary(spark, sf_dir):
    return built(spark, sf_dir).terms


@query(f"WITH {INDEX_CTE} SELECT df, count(*) AS n_terms FROM dict GROUP BY df")
def doc_frequency(spark, sf_dir):
    return built(spark, sf_dir).terms.groupBy("df").agg(F.count("*").alias("n_terms"))


@query(f"WITH {INDEX_CTE} SELECT term, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS idf FROM dict CROSS JOIN fig")
def idf_table(spark, sf_dir):
    ix = built(spark, sf_dir)
    return ix.terms.crossJoin(F.broadcast(ix.figures)).select("term", F.round(index.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


@query(f"WITH {INDEX_CTE} SELECT stem, term FROM stm")
def stem_map(spark, sf_dir):
    return built(spark, sf_dir).stems


@query("SELECT coalesce(source, '') AS section, count(*) AS n FROM documents GROUP BY 1")
def section_counts(spark, sf_dir):
    return index.section_counts(index.as_passages(documents(spark, sf_dir)))


@query(f"WITH {INDEX_CTE} SELECT doc_id AS i, title AS t, section AS s, substr(body, 1, 1600) AS b, l FROM pas JOIN len USING (doc_id)")
def stored_documents(spark, sf_dir):
    return built(spark, sf_dir).documents.select("i", "t", "s", "b", "l")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS new_id FROM part WHERE p_size > 25")
def dense_ids(spark, sf_dir):
    big = table(spark, sf_dir, "part").filter("p_size > 25").select("p_partkey")
    return index.dense_ids(big, ["p_partkey"], "new_id")


# --- expansion ------------------------------------------------------------------------------------------


@query(f"WITH {INDEX_CTE}, {QT_CTE} {EXACT_SQL}")
def expand_exact(spark, sf_dir):
    return expand.exact(expand.query_tokens(searches(spark)), built(spark, sf_dir).terms)


@query(f"WITH {INDEX_CTE}, {QT_CTE} SELECT query_id, term, round(quality, 6) AS quality, grp, seq FROM ({PREFIX_SQL})")
def expand_prefix(spark, sf_dir):
    return expand.prefix(expand.query_tokens(searches(spark)), built(spark, sf_dir).terms).withColumn("quality", F.round("quality", 6))


@query(f"WITH {INDEX_CTE}, {QT_CTE} {STEMS_SQL}")
def expand_stem(spark, sf_dir):
    ix = built(spark, sf_dir)
    return expand.stems(expand.query_tokens(searches(spark)), ix.terms, ix.stems)


@query(f"WITH {INDEX_CTE}, {QT_CTE} {FUZZY_SQL}")
def expand_fuzzy(spark, sf_dir):
    return expand.fuzzy_matches(expand.query_tokens(searches(spark)), built(spark, sf_dir).terms)


@query(f"WITH {QT_CTE}, {CONCEPTS_CTE} SELECT query_id, term, weight FROM cw")
def expand_concepts(spark, sf_dir):
    return expand.concept_terms(searches(spark), spark.createDataFrame(CONCEPTS, "id string, term string, kind string"))


@query(f"WITH {CANDIDATES_CTE} SELECT query_id, term, round(quality, 6) AS quality, grp FROM cand")
def expand_merged(spark, sf_dir):
    return offered(spark, built(spark, sf_dir)).select("query_id", "term", F.round("quality", 6).alias("quality"), "grp")


# --- ranking --------------------------------------------------------------------------------------------


def top(sql_from: str, first: int, last: int, where: str = "") -> str:
    return f"SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {sql_from} {where}) WHERE rank BETWEEN {first} AND {last}"


def page(df: DataFrame, first: int, last: int) -> DataFrame:
    return rank.ranked(df, first, last).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {BM25_CTE} " + top("sc", 1, 10))
def bm25_topk(spark, sf_dir):
    return page(scored(spark, sf_dir)[1], 1, 10)


@query(f"WITH {BOOST_CTE}, own AS (SELECT * FROM ranked WHERE section = 'src0'), fl AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM own) WHERE score >= 0.06::DOUBLE * best) " + top("fl", 1, 40))
def bm25_filtered_section(spark, sf_dir):
    ix, s = scored(spark, sf_dir)
    return page(rank.above_floor(rank.boosted(s, searches(spark), ix, section="src0")), 1, 40)


@query(f"WITH {BOOST_CTE} " + top("kept", 21, 40))
def bm25_paged(spark, sf_dir):
    return page(kept(spark, sf_dir), 21, 40)


@query(f"WITH {BOOST_CTE}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM kept) SELECT query_id, rank, doc_id, title, section, round(score, 3) AS score, total FROM o WHERE rank <= 40")
def search_response(spark, sf_dir):
    """The whole search call: every branch of expansion, all boosts, floor, rank and total, scores to three places."""
    ix = built(spark, sf_dir)
    hits, totals, _ = rank.search(searches(spark), ix, offered(spark, ix))
    return hits.join(totals, "query_id").select("query_id", "rank", "doc_id", "title", "section", "score", "total")


def _boosts(spark, sf_dir):
    ix, s = scored(spark, sf_dir)
    asked = searches(spark).select("query_id", T.normalize_query("q").alias("nq"), F.greatest(F.size(T.without_stops(T.tokens_of(T.normalize_query("q")))), F.lit(1)).alias("need"))
    return s.join(linked.few(asked), "query_id").join(ix.documents.select(F.col("i").alias("doc_id"), "t", "n", "nt"), "doc_id")


@query(f"WITH {BOOST_CTE} SELECT query_id, doc_id, groups, round(coverage, 6) AS boost FROM bo")
def coverage_boost(spark, sf_dir):
    return _boosts(spark, sf_dir).select("query_id", "doc_id", "groups", F.round(rank.coverage(F.col("groups"), F.col("need")), 6).alias("boost"))


@query(f"WITH {BOOST_CTE} SELECT query_id, doc_id, phrase AS boost FROM bo")
def phrase_boost(spark, sf_dir):
    return _boosts(spark, sf_dir).select("query_id", "doc_id", rank.phrase(F.col("need"), F.col("n"), F.col("nq")).alias("boost"))


@query(f"WITH {BOOST_CTE} SELECT query_id, doc_id, title_boost AS boost FROM bo")
def title_boost(spark, sf_dir):
    return _boosts(spark, sf_dir).select("query_id", "doc_id", rank.title(F.col("nt"), F.col("nq")).alias("boost"))


NOW_MS = 1_000_000_000_000


@query(f"SELECT o_orderkey, round(1 + greatest(0, 0.12::DOUBLE * (1 - ({NOW_MS} - epoch_ms(o_orderdate)) / (3.0::DOUBLE * {C.YEAR_MS}))), 6) AS boost FROM orders")
def recency_boost(spark, sf_dir):
    ms = F.unix_millis(F.to_timestamp(F.concat(F.col("o_orderdate").cast("string"), F.lit("Z"))))  # in any session time zone
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(rank.recency(ms, NOW_MS), 6).alias("boost"))


@query(f"WITH {BOOST_CTE} SELECT query_id, doc_id, round(score, 6) AS score FROM kept")
def relevance_floor(spark, sf_dir):
    return kept(spark, sf_dir).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {BOOST_CTE} SELECT query_id, section, count(*) AS n FROM kept GROUP BY ALL")
def facets(spark, sf_dir):
    return rank.facets(kept(spark, sf_dir))


@query(f"WITH {BOOST_CTE}, f AS (SELECT query_id, section, count(*) AS n FROM kept GROUP BY ALL) SELECT query_id, section, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, section) AS k, count(*) OVER (PARTITION BY query_id) AS c FROM f) WHERE c >= 2 AND k <= 8")
def facet_top8(spark, sf_dir):
    return rank.top_facets(rank.facets(kept(spark, sf_dir)))


@query(f"WITH {BOOST_CTE} SELECT query_id, count(*) AS total FROM kept GROUP BY query_id")
def result_totals(spark, sf_dir):
    return kept(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("total"))


# --- presentation ---------------------------------------------------------------------------------------

SNIPPET_TERMS = ["thing", "license", "tion"]


@query(
    "WITH s AS (SELECT doc_id, b, list_filter(regexp_split_to_array(regexp_replace(b, '([.!?،؛:])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+'), lambda c: length(trim(c, ' ' || chr(9) || chr(10) || chr(13))) > 20) AS cs FROM (SELECT doc_id, coalesce(text, '') AS b FROM documents))"
    ", c AS (SELECT doc_id, b, CASE WHEN len(cs) = 0 THEN [b] ELSE cs END AS cs FROM s)"
    ", p AS (SELECT doc_id, b, cs, i, cs[i] AS piece FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM c))"
    ", w AS (SELECT *, (CASE WHEN contains(nn, 'public license') THEN 5 ELSE 0 END) + contains(nn, 'thing')::INT + contains(nn, 'license')::INT + contains(nn, 'tion')::INT AS pts FROM (SELECT *, trim(regexp_replace(regexp_replace(lower(piece), '[!-/:-@\\[-`{-~]', ' ', 'g'), '\\s+', ' ', 'g')) AS nn FROM p))"
    ", o AS (SELECT doc_id, trim(CASE WHEN pts > 0 THEN piece ELSE cs[1] END, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pts DESC, i) AS k FROM w) WHERE k = 1)"
    " SELECT doc_id, CASE WHEN length(t) > 260 THEN regexp_replace(substr(t, 1, 257), '\\s+\\S*$', '') || '…' ELSE t END AS snippet FROM o"
)
def snippet_best_sentence(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", T.text("text").alias("b"))
    return rows.select("doc_id", present.snippet(F.col("b"), F.lit(""), F.array(*map(F.lit, SNIPPET_TERMS)), F.lit("public license"), most=None).alias("snippet"))


MARKED = "(?:thing|license|tion)+"  # none of these terms overlaps another, so neighbours make one stretch


@query(
    f"WITH m AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '(?i){MARKED}') AS ps, regexp_extract_all(coalesce(text, ''), '(?i){MARKED}') AS ms FROM documents), i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m)"
    ' SELECT doc_id, s AS start, s + length(ms[i]) AS "end" FROM (SELECT *, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM i)'
)
def highlight_ranges(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text", F.array(*map(F.lit, SNIPPET_TERMS)).alias("terms"))
    return present.highlight(rows, "text", "terms", most=None).select("doc_id", F.explode("ranges").alias("r")).select("doc_id", F.col("r.start").cast("long").alias("start"), F.col("r.end").cast("long").alias("end"))


MISSPELT = [(1, "licence thinng"), (2, "the licensse"), (3, "public license"), (4, "qqqqqq"), (5, "warrenty sofware")]


@query(
    f"WITH {INDEX_CTE}, ms(query_id, q) AS (VALUES " + ", ".join(map(str, MISSPELT)) + ")"
    ", t AS (SELECT query_id, unnest(range(len(ts))) AS pos, unnest(ts) AS token FROM (SELECT query_id, string_split(q, ' ') AS ts FROM ms))"
    f", f AS (SELECT query_id, pos, term FROM (SELECT *, row_number() OVER (PARTITION BY query_id, pos ORDER BY dist, df DESC, term) AS k FROM (SELECT *, row_number() OVER (PARTITION BY query_id, pos ORDER BY dist, length(term), term) AS m FROM (SELECT t.*, dict.term, dict.df, {distance('token', 'dict.term')} AS dist, CASE WHEN length(token) <= 3 THEN 0 WHEN length(token) <= 5 THEN 1 ELSE 2 END AS budget"
    " FROM t JOIN dict ON substr(dict.term, 1, 1) = substr(token, 1, 1) AND abs(length(dict.term) - length(token)) <= 2 WHERE token NOT IN (SELECT term FROM dict)) WHERE dist BETWEEN 1 AND budget) WHERE m <= 8) WHERE k = 1)"
    " SELECT query_id, string_agg(coalesce(f.term, t.token), ' ' ORDER BY pos) AS suggestion FROM t LEFT JOIN f USING (query_id, pos) GROUP BY query_id HAVING count(f.term) > 0"
)
def did_you_mean(spark, sf_dir):
    return present.suggestions(spark.createDataFrame(MISSPELT, "query_id int, q string"), built(spark, sf_dir).terms)


@query(
    f"WITH {PASSAGES_CTE}, d AS (SELECT doc_id, substr({norm(chr(39) * 2 + ' || title || ' + chr(39) + ' ' + chr(39) + ' || section || ' + chr(39) + '   ' + chr(39) + ' || ' + chr(34) + 'desc' + chr(34) + ' || ' + chr(39) + ' ' + chr(39) + ' || body')}, 1, 6000) AS n, {norm('title')} AS t FROM pas)"
    " SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, ((CASE WHEN contains(n, 'public') THEN 2 ELSE 0 END) + (CASE WHEN contains(t, 'public') THEN 6 ELSE 0 END) + (CASE WHEN contains(n, 'license') THEN 2 ELSE 0 END) + (CASE WHEN contains(t, 'license') THEN 6 ELSE 0 END)) * CASE WHEN contains(n, 'public license') THEN 1.6::DOUBLE ELSE 1 END AS score FROM d) WHERE score > 0"
)
def fallback_scan(spark, sf_dir):
    return present.fallback_scan(built(spark, sf_dir).documents, "Public license").withColumn("score", F.round("score", 6))


@query("SELECT user_id, CAST(rank AS INT) AS rank, q FROM (SELECT user_id, q, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, q) AS rank FROM (SELECT user_id, event_type AS q, max(ts) AS ts FROM events GROUP BY ALL)) WHERE rank <= 6")
def recent_queries(spark, sf_dir):
    return present.recent_queries(table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_type").alias("q")))


# --- passages -------------------------------------------------------------------------------------------


CHUNKS_SQL = (
    "WITH c AS (SELECT doc_id, source, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS x FROM documents)"
    ", p AS (SELECT doc_id, source, x, list_filter(string_split(regexp_replace(x, '([.!؟؛])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS ps FROM c WHERE x <> '')"
    # a fold over sentences: pieces closed so far and the open one
    ", f AS (SELECT *, list_reduce(list_prepend({'closed': []::VARCHAR[], 'open': ''}, list_transform(ps, lambda s: {'closed': []::VARCHAR[], 'open': s})), lambda a, s: {"
    "'closed': list_concat(CASE WHEN length(a.open) + length(s.open) + 1 > 3600 AND a.open <> '' THEN list_append(a.closed, a.open) ELSE a.closed END,"
    " list_transform(range(0, CASE WHEN length(s.open) > 3600 THEN ceil(length(s.open) / 3600)::BIGINT - 1 ELSE 0 END), lambda k: substr(s.open, k * 3600 + 1, 3600))),"
    " 'open': trim(CASE WHEN length(a.open) + length(s.open) + 1 > 3600 AND a.open <> '' THEN '' ELSE a.open END || ' ' || substr(s.open, CASE WHEN length(s.open) > 3600 THEN ceil(length(s.open) / 3600)::BIGINT - 1 ELSE 0 END * 3600 + 1, 3600))}) AS r FROM p)"
    ", g AS (SELECT doc_id, source, CASE WHEN length(x) <= 3600 THEN [x] WHEN r.open <> '' THEN list_append(r.closed, r.open) ELSE r.closed END AS cs FROM f)"
    " SELECT doc_id, (i - 1)::INT AS passage_no, trim(regexp_replace(coalesce(source, '') || CASE WHEN i > 1 THEN '" + C.PART_LABEL + "' || i ELSE '' END, '\\s+', ' ', 'g')) AS title, cs[i] AS body FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM g)"
)


@query(CHUNKS_SQL)
def chunk_passages(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.col("source").alias("title"), F.col("source").alias("section"), F.lit("").alias("type"), F.lit("").alias("url"), F.col("text").alias("body"))
    return passages.make_passages(rows).select("doc_id", "passage_no", "title", "body")


CLEAN = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {CLEAN} AS body FROM documents WHERE length({CLEAN}) BETWEEN 1 AND 3600")
def chunk_short_documents(spark, sf_dir):
    pieces = passages.chunks(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", pieces.alias("c")).filter("size(c) = 1").filter(F.char_length(F.col("c")[0]) <= C.PASSAGE_CHARS).select("doc_id", F.col("c")[0].alias("body")).join(documents(spark, sf_dir).filter(F.char_length(T.clean_text("text")) <= C.PASSAGE_CHARS).select("doc_id"), "doc_id", "left_semi")


DEDUP_KEY = norm("'|' || title || '|' || substr(body, 1, 180)")


@query(f"WITH {PASSAGES_CTE} SELECT min(doc_id) AS doc_id FROM pas WHERE title <> '' AND length({norm('title || chr(32) || body')}) >= 8 GROUP BY {DEDUP_KEY}")
def dedup_docs(spark, sf_dir):
    return passages.deduplicate(index.as_passages(documents(spark, sf_dir))).select("doc_id")


@query(f"WITH {PASSAGES_CTE} SELECT min(doc_id) AS doc_id, max(length(body)) AS n FROM pas WHERE title <> '' AND length({norm('title || chr(32) || body')}) >= 8 GROUP BY '|' || substr(title, 1, 80)")
def dedup_keep_longest(spark, sf_dir):
    return passages.deduplicate_longest(index.as_passages(documents(spark, sf_dir))).select("doc_id", F.char_length("body").cast("long").alias("n"))


LATIN_CLASSES = {"law": "license|warranty", "contact": "@|phone", "list": "\\|"}


@query(
    f"WITH {PASSAGES_CTE}, h AS (SELECT doc_id, section || ' ' || title || ' ' || section || '    ' || substr(body, 1, 1200) AS h FROM pas), c AS (SELECT doc_id, list_filter([{', '.join(f'CASE WHEN regexp_matches(h, {chr(39)}(?i){p}{chr(39)}) THEN {chr(39)}{k}{chr(39)} END' for k, p in sorted(LATIN_CLASSES.items()))}], lambda x: x IS NOT NULL) AS cs FROM h)"
    " SELECT doc_id, CASE WHEN len(cs) = 0 THEN 'heritage' ELSE array_to_string(list_sort(cs), ',') END AS categories FROM c"
)
def classify_multilabel(spark, sf_dir):
    p = passages.classify(index.as_passages(documents(spark, sf_dir)), LATIN_CLASSES, with_files=False)
    return p.select("doc_id", F.array_join("categories", ",").alias("categories"))


LATIN_TIERS = tiers.Patterns(lineage="licen[sc]e", context="public|terms", subtribes="warranty|copyright", nisba="token|password", geo="key|secret|=")


@query(
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), c AS (SELECT doc_id, x, regexp_matches(x, 'licen[sc]e') AND regexp_matches(x, 'public|terms') AS a, regexp_matches(x, 'warranty|copyright') AS b, regexp_matches(x, 'token|password') AND regexp_matches(x, 'key|secret|=') AS g FROM t)"
    " SELECT doc_id, CASE WHEN a THEN 'Confirmed Target' WHEN b THEN 'Candidate: Sub-tribe' WHEN g THEN 'Discovery Signal Only' ELSE 'No Match' END AS tier,"
    " array_to_string(CASE WHEN a THEN regexp_extract_all(x, 'licen[sc]e') WHEN b THEN list_sort(list_distinct(regexp_extract_all(x, 'warranty|copyright'))) WHEN g THEN list_sort(list_distinct(regexp_extract_all(x, 'token|password'))) ELSE [] END, ',') AS terms,"
    " array_to_string(CASE WHEN NOT a AND NOT b AND g THEN list_sort(list_distinct(regexp_extract_all(x, 'key|secret|='))) ELSE [] END, ',') AS geo FROM c"
)
def tier_candidates(spark, sf_dir):
    rows = tiers.classify_candidates(documents(spark, sf_dir), "text", LATIN_TIERS)
    return rows.select("doc_id", "tier", F.array_join("matched_terms", ",").alias("terms"), F.array_join("matched_geo", ",").alias("geo"))


# --- sources --------------------------------------------------------------------------------------------

def sql_references(x: str) -> str:
    """Character references of the given pages resolved."""
    for name, c in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{c}')"
    return x


def sql_page_text(x: str, between: str) -> str:
    """Text without tags, with this between what they part, white space as single blanks."""
    return f"trim(regexp_replace({sql_references(f"regexp_replace({x}, '<[^>]*>', '{between}', 'g')")}, '\\s+', ' ', 'g'))"


PAGES_CTE = "pg AS (SELECT page_id, regexp_replace(html, '<style>.*?</style>|<script>.*?</script>|<!--.*?-->', ' ', 'gs') AS h FROM pages)"


@query(
    f"WITH {PAGES_CTE}, t AS (SELECT page_id, {sql_page_text("regexp_extract(h, '<title>(.*?)</title>', 1, 's')", ' ')} AS title, {sql_page_text("regexp_extract(h, '<h1>(.*?)</h1>', 1, 's')", ' ')} AS head, {sql_page_text("split_part(h, '<h1>', 1)", ' ')} AS before, {sql_page_text("split_part(h, '</h1>', 2)", ' ')} AS after FROM pg)"
    ", s AS (SELECT page_id, 0 AS k, title, '' AS heading, before AS body FROM t UNION ALL SELECT page_id, 1, title, head, after FROM t)"
    " SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INT AS section_no, title, heading, body FROM s WHERE body <> ''"
)
def html_sections(spark, sf_dir):
    return files.html_sections(table(spark, sf_dir, "pages")).select("page_id", "section_no", "title", "heading", "body")


@query("SELECT event_id, k || ': ' || v AS line FROM (SELECT event_id, unnest(map_keys(m)) AS k, unnest(map_values(m)) AS v FROM (SELECT event_id, CAST(CAST(props AS JSON) AS MAP(VARCHAR, VARCHAR)) AS m FROM events)) WHERE v NOT IN ('', '0', 'false', '0.0')")
def json_flatten(spark, sf_dir):
    return files.json_lines_flat(table(spark, sf_dir, "events"), "props").select("event_id", "line")


@query("SELECT c_custkey AS doc_id, 'customer' AS section, 'c_name: ' || c_name || ' — c_nationkey: ' || c_nationkey || ' — c_mktsegment: ' || c_mktsegment AS body FROM (SELECT * FROM customer)")
def csv_rows_as_docs(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    made = files.csv_rows_as_passages(rows.select("c_name", "c_nationkey", "c_mktsegment", "c_custkey"), "customer", "c_custkey")
    return made.withColumn("body", F.regexp_replace("body", " — c_custkey: .*$", ""))


@query("SELECT c_custkey, '\"' || c_name || '\",\"' || c_mktsegment || '\"' AS line FROM customer")
def quoted_csv_lines(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", sinks.csv_line("c_name", "c_mktsegment").alias("line"))


SOURCES_SQL = "SELECT DISTINCT o_orderpriority AS title, o_orderstatus AS author FROM orders"


@query(f"WITH known AS (SELECT DISTINCT o_orderpriority AS title, o_orderstatus AS author FROM orders WHERE o_orderkey % 7 = 0 AND o_orderstatus = 'O'), fresh AS ({SOURCES_SQL} EXCEPT SELECT * FROM known) SELECT title, author, row_number() OVER (ORDER BY title, author) + 100 AS source_id FROM fresh")
def source_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    empty = {c: F.lit(None).cast("string") for c in sinks.SOURCE_FIELDS if c not in ("title", "author")}
    rows = orders.select(F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("author")).withColumns(empty)
    known = rows.filter(F.lit(True)).join(orders.filter("o_orderkey % 7 = 0 AND o_orderstatus = 'O'").select(F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("author")).distinct(), ["title", "author"], "left_semi").distinct()
    return sinks.new_sources(known.withColumn("source_id", F.lit(100).cast("long")), rows).select("title", "author", "source_id")


# --- graph, trees, places -------------------------------------------------------------------------------


def _triples(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    customer = table(spark, sf_dir, "customer")
    inside = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("subject"), F.lit("in region").alias("predicate"), F.col("r_name").alias("object"), F.col("n_nationkey").cast("long").alias("ord"))
    lives = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("subject"), F.lit("lives in").alias("predicate"), F.col("n_name").alias("object"), (F.col("c_custkey") + 1000).alias("ord"))
    return inside.union(lives)


TRIPLES_SQL = "tri AS (SELECT n_name AS subject, 'in region' AS predicate, r_name AS object FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT c_name, 'lives in', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def entity(x: str) -> str:
    return f"'entity:' || substr({norm(x)}, 1, 160)"


@query(f"WITH {TRIPLES_SQL} SELECT DISTINCT {entity('x')} AS id, x AS label, 'entity' AS type FROM (SELECT subject AS x FROM tri UNION SELECT object FROM tri)")
def graph_nodes(spark, sf_dir):
    return graph.build_graph(None, _triples(spark, sf_dir))[0].select("id", "label", "type")


@query(f"WITH {TRIPLES_SQL} SELECT DISTINCT {entity('subject')} AS source, predicate, {entity('object')} AS target FROM tri")
def graph_edges(spark, sf_dir):
    return graph.build_graph(None, _triples(spark, sf_dir))[1]


@query("SELECT 'r' || r_regionkey AS root, 1 + count(DISTINCT n_nationkey) + count(DISTINCT c_custkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey")
def tree_count(spark, sf_dir):
    part = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    none = F.lit(None).cast("string")
    nodes = table(spark, sf_dir, "region").select(part("r", "r_regionkey").alias("node_id"), none.alias("parent_id"), F.col("r_name").alias("name"))
    nodes = nodes.union(table(spark, sf_dir, "nation").select(part("n", "n_nationkey"), part("r", "n_regionkey"), "n_name"))
    nodes = nodes.union(table(spark, sf_dir, "customer").select(part("c", "c_custkey"), part("n", "c_nationkey"), "c_name"))
    return places.tree_counts(nodes)


@query("SELECT event_type AS key, CAST(sum(1) AS BIGINT) AS value, max(ts) AS updated_at FROM events GROUP BY event_type")
def counter_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.lit(1).cast("long").alias("value"), F.col("ts").alias("updated_at"))
    even = F.pmod(F.hash("updated_at"), F.lit(2)) == 0
    return places.upsert_counters(rows.filter(even), rows.filter(~even))


def _places(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("era"), (F.col("p_size") % 7 == 0).alias("unesco"), F.col("p_retailprice").alias("lat"), F.col("p_size").cast("double").alias("lng"))


@query("SELECT count_if(contains(p_name, 'a') AND p_size % 7 = 0) AS visible, count(*) AS total FROM part")
def place_filter(spark, sf_dir):
    return places.visible_count(_places(spark, sf_dir), "unesco", " a ")


@query("SELECT p_brand AS era, min(p_retailprice) AS south, max(p_retailprice) AS north, min(p_size)::DOUBLE AS west, max(p_size)::DOUBLE AS east FROM part GROUP BY 1")
def bounding_box(spark, sf_dir):
    return places.bounding_box(_places(spark, sf_dir), "era")


# --- entities and evidence ------------------------------------------------------------------------------


def _people(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    return s.select(
        key.alias("idx"), F.md5(text(key % 20)).alias("canonical_name"), F.concat(F.lit("abu "), text(key % 10)).alias("kunya"), F.concat(F.lit("d. "), text(200 + key % 23)).alias("death_year_mentioned"),
        F.array(F.concat(F.lit("g"), text(F.col("s_nationkey")))).alias("geographical_mentions"), F.array(F.concat(F.lit("t"), text(key % 40))).alias("teachers"), F.array(F.concat(F.lit("s"), text(key % 40))).alias("students"),
    )


#: Names are digests, which are equal or far from alike, so that points for names need no similarity in SQL.
POINTS_SQL = (
    "pe AS (SELECT s_suppkey AS k, s_nationkey AS g FROM supplier), ps AS (SELECT a.k AS i, b.k AS j, CASE WHEN a.k % 20 = b.k % 20 THEN 30 ELSE 0 END AS name, CASE WHEN a.k % 10 = b.k % 10 THEN 15 ELSE 0 END AS kunya,"
    " CASE WHEN abs(a.k % 23 - b.k % 23) <= 5 THEN 20 ELSE 0 END AS year, CASE WHEN a.k % 40 = b.k % 40 THEN 25 ELSE 0 END AS network, CASE WHEN a.g = b.g THEN 10 ELSE 0 END AS geography FROM pe a JOIN pe b ON a.k < b.k)"
    ", pt AS (SELECT *, name + kunya + year + network + geography AS points FROM ps)"
)
CLUSTERS_SQL = (
    POINTS_SQL + ", eg AS (SELECT i AS a, j AS b FROM pt WHERE points >= 75 UNION ALL SELECT j, i FROM pt WHERE points >= 75)"
    ", reach(n, r) AS (SELECT k, k FROM pe UNION SELECT reach.n, eg.b FROM reach JOIN eg ON eg.a = reach.r), cl AS (SELECT n AS idx, min(r) AS cluster_id FROM reach GROUP BY n)"
)
ABLE = "network > 0 OR (kunya > 0 AND geography > 0) OR (kunya > 0 AND year > 0) OR (geography > 0 AND year > 0)"


@query(f"WITH {POINTS_SQL} SELECT i, j, name, kunya, year, network, geography, points FROM pt WHERE {ABLE}")
def pair_match_score(spark, sf_dir):
    """Pairs with enough in common to reach the threshold of review."""
    out = resolve.all_scored(resolve.prepare(_people(spark, sf_dir)))
    return out.filter(ABLE).select("i", "j", "name", "kunya", "year", "network", "geography", "points")


@query(f"WITH RECURSIVE {CLUSTERS_SQL} SELECT idx, cluster_id FROM cl")
def entity_clusters(spark, sf_dir):
    return resolve.cluster(_people(spark, sf_dir))[0]


@query(f"WITH RECURSIVE {CLUSTERS_SQL} SELECT i, j, points FROM pt JOIN cl a ON a.idx = i JOIN cl b ON b.idx = j WHERE points BETWEEN 55 AND 74 AND a.cluster_id <> b.cluster_id")
def borderline_pairs(spark, sf_dir):
    return resolve.cluster(_people(spark, sf_dir))[1]


CODES = ("N1", "N2", "W1", "D1", "R1", "H1", "U1")


def _evidence(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    codes = F.array(*map(F.lit, CODES))
    return o.select(
        F.col("o_custkey").alias("cluster_id"), F.col("o_orderkey").alias("item_id"), F.get(codes, (F.col("o_orderkey") % 7).cast("int")).alias("assigned_code"), F.when(F.col("o_orderkey") % 3 == 0, "N").otherwise("U").alias("proposed_relation"),
        F.when(F.col("o_orderkey") % 29 == 0, "other").otherwise("tribe").alias("attributed_tribe"), F.create_map(F.lit("title"), F.col("o_orderpriority")).alias("source_meta"), (F.col("o_orderkey") % 2 == 0).alias("has_explicit_linking_text"),
        (F.col("o_orderkey") % 5 == 0).alias("has_corroborating_clue"), (F.col("o_orderkey") % 101 == 0).alias("definitively_other_tribe"),
    )


EVIDENCE_SQL = (
    "ev AS (SELECT o_custkey AS c, o_orderkey AS k, ['N1','N2','W1','D1','R1','H1','U1'][o_orderkey % 7 + 1] AS code, CASE WHEN o_orderkey % 29 = 0 THEN 'other' ELSE 'tribe' END AS tribe, o_orderpriority AS src, o_orderkey % 5 = 0 AS clue, o_orderkey % 101 = 0 AS ot FROM orders)"
    ", su AS (SELECT c, list(DISTINCT code) AS codes, count(DISTINCT tribe) > 1 AS con, count(DISTINCT src) AS n, bool_or(clue) AS clue, bool_or(ot) AS ot FROM ev GROUP BY c)"
    ", de AS (SELECT *, CASE WHEN con THEN 'D' WHEN list_has_any(codes, ['N1','N2']) THEN 'N' WHEN list_contains(codes, 'W1') THEN 'W' WHEN list_contains(codes, 'R1') THEN 'C' ELSE 'U' END AS relation,"
    " CASE WHEN ot THEN 0 WHEN con THEN 2 WHEN list_contains(codes, 'N1') THEN 5 WHEN list_has_any(codes, ['N2','W1']) THEN CASE WHEN n >= 2 THEN 4 ELSE 3 END WHEN list_contains(codes, 'R1') THEN CASE WHEN clue THEN 3 ELSE 2 END WHEN list_contains(codes, 'H1') THEN 1 ELSE 0 END AS confidence,"
    " CASE WHEN con THEN 'D1' ELSE list_filter(['N1','N2','W1','D1','R1','H1','U1'], lambda x: list_contains(codes, x))[1] END AS code FROM su)"
    ", ga AS (SELECT *, CASE WHEN confidence = 0 THEN 'REJECT' WHEN confidence >= 4 AND NOT con AND relation IN ('N', 'W') THEN 'ACCEPT' ELSE 'REVIEW' END AS gate FROM de)"
)


@query("SELECT o_orderkey AS item_id, (o_orderkey % 3 = 0 AND o_orderkey % 7 >= 3) AS geography, (o_orderkey % 7 = 4 AND o_orderkey % 2 <> 0) AS nisba, CASE WHEN (o_orderkey % 3 = 0 AND o_orderkey % 7 >= 3) OR (o_orderkey % 7 = 4 AND o_orderkey % 2 <> 0) THEN 'C' WHEN o_orderkey % 3 = 0 THEN 'N' ELSE 'U' END AS final_proposal, 3 AS n_traces FROM orders")
def evidence_rules(spark, sf_dir):
    rows = rules.apply_item_rules(_evidence(spark, sf_dir))
    return rows.select("item_id", F.col("traces")[0].triggered.alias("geography"), F.col("traces")[1].triggered.alias("nisba"), "final_proposal", F.size("traces").alias("n_traces"))


@query(f"WITH {EVIDENCE_SQL} SELECT c AS cluster_id, relation, con AS has_contradiction, code AS evidence_code FROM ga")
def evidence_classify(spark, sf_dir):
    return rules.decide(_evidence(spark, sf_dir)).select("cluster_id", "relation", "has_contradiction", "evidence_code")


@query(f"WITH {EVIDENCE_SQL} SELECT c AS cluster_id, confidence, n AS sources FROM ga")
def evidence_confidence(spark, sf_dir):
    return rules.decide(_evidence(spark, sf_dir)).select("cluster_id", "confidence", "sources")


@query(f"WITH {EVIDENCE_SQL} SELECT c AS cluster_id, gate FROM ga")
def evidence_gate(spark, sf_dir):
    return rules.decide(_evidence(spark, sf_dir)).select("cluster_id", "gate")


@query(f"WITH {EVIDENCE_SQL} SELECT gate, relation, count(*) AS n FROM ga GROUP BY ALL")
def gate_routing(spark, sf_dir):
    return rules.decide(_evidence(spark, sf_dir)).groupBy("gate", "relation").agg(F.count("*").alias("n"))


@query(f"WITH {EVIDENCE_SQL} SELECT c AS cluster_id, 3 * count(*) + max(con::INT) + 1 AS n_traces FROM ev JOIN su USING (c) GROUP BY c")
def evidence_traces(spark, sf_dir):
    return rules.with_traces(_evidence(spark, sf_dir)).select("cluster_id", F.size("rule_traces").cast("long").alias("n_traces"))


# --- hybrid ---------------------------------------------------------------------------------------------

RAW_WORDS = "regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+')"
OKAPI_SQL = (
    f"rt AS (SELECT doc_id, unnest({RAW_WORDS}) AS token FROM documents), rc AS (SELECT doc_id, token, count(*) AS tf FROM rt GROUP BY ALL), rl AS (SELECT doc_id, sum(tf) AS dl FROM rc GROUP BY doc_id)"
    ", rf AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM rl) AS total), rd AS (SELECT token, count(*) AS df FROM rc GROUP BY token), ri AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS raw, n, total FROM rd CROSS JOIN rf)"
    ", rm AS (SELECT avg(raw) AS mean FROM ri), rq(query_id, q) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in SEARCHES) + "), ra AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest(string_split(q, ' ')) AS token FROM rq) GROUP BY ALL)"
    ", ok AS (SELECT query_id, doc_id, sum(times * (CASE WHEN raw < 0 THEN 0.25::DOUBLE * mean ELSE raw END) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (total / n))))) AS bm25 FROM ra JOIN ri USING (token) CROSS JOIN rm JOIN rc USING (token) JOIN rl USING (doc_id) GROUP BY ALL)"
)
DOT_SQL = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"


@query(f"WITH {OKAPI_SQL} SELECT query_id, doc_id, round(bm25, 5) AS bm25 FROM ok")
def okapi_scores(spark, sf_dir):
    return hybrid.okapi(documents(spark, sf_dir), searches(spark)).withColumn("bm25", F.round("bm25", 5))


def _query_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id IN (0, 1, 2, 3, 4)").select((F.col("vec_id") + 1).cast("int").alias("query_id"), F.col("embedding").alias("q_vector"))


@query(f"SELECT query_id, vec_id, cosine, CAST(rank AS INT) AS rank FROM (SELECT query_id, vec_id, round(s, 5) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM (SELECT CAST(q.vec_id + 1 AS INT) AS query_id, e.vec_id, {DOT_SQL.format(a='e.embedding', b='q.embedding')} AS s FROM embeddings e CROSS JOIN embeddings q WHERE q.vec_id < 5)) WHERE rank <= 10")
def dense_cosine_topk(spark, sf_dir):
    rows = hybrid.cosine(table(spark, sf_dir, "embeddings"), _query_vectors(spark, sf_dir)).withColumnsRenamed({"cosine": "score", "vec_id": "doc_id"})
    return rank.ranked(rows, 1, 10).select("query_id", F.col("doc_id").alias("vec_id"), F.round("score", 5).alias("cosine"), "rank")


@query(
    f"WITH {OKAPI_SQL}, tp AS (SELECT query_id, max(bm25) AS top FROM ok GROUP BY query_id), dn AS (SELECT CAST(q.vec_id + 1 AS INT) AS query_id, e.vec_id AS doc_id, {DOT_SQL.format(a='e.embedding', b='q.embedding')} AS s FROM embeddings e CROSS JOIN embeddings q WHERE q.vec_id < 5)"
    ", al AS (SELECT r.query_id, d.doc_id, 0.5 * (coalesce(bm25, 0) / CASE WHEN coalesce(top, 0) > 0 THEN top ELSE 1 END) + 0.5 * coalesce(s, 0) AS score FROM rq r CROSS JOIN documents d LEFT JOIN ok USING (query_id, doc_id) LEFT JOIN tp USING (query_id) LEFT JOIN dn USING (query_id, doc_id))"
    " SELECT query_id, CAST(rank AS INT) AS rank, doc_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM al) WHERE rank <= 10"
)
def hybrid_topk(spark, sf_dir):
    docs = documents(spark, sf_dir)
    dense = hybrid.cosine(table(spark, sf_dir, "embeddings"), _query_vectors(spark, sf_dir)).withColumnRenamed("vec_id", "doc_id")
    return hybrid.combine(docs, searches(spark), hybrid.okapi(docs, searches(spark)), dense).withColumn("score", F.round("score", 5))


# --- further operators ----------------------------------------------------------------------------------


@query("SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY c_nationkey) AS root FROM customer UNION ALL SELECT 1000000 + c_nationkey, min(c_custkey) FROM customer GROUP BY c_nationkey")
def connected_components(spark, sf_dir):
    return linked.components(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), (F.lit(1_000_000) + F.col("c_nationkey")).cast("long").alias("b")))


@query(
    f"WITH {TOKENS_CTE}, h AS (SELECT doc_id, section || ' ' || title || ' ' || section || '    ' || substr(body, 1, 1200) AS h FROM pas), m AS (SELECT doc_id FROM h WHERE regexp_matches(h, '(?i)license|warranty'))"
    ", l AS (SELECT m.doc_id, greatest(count(token), 1) AS l FROM m LEFT JOIN tok USING (doc_id) GROUP BY m.doc_id) SELECT count(*) AS n_docs, coalesce(round(avg(l), 6), 0) AS avg_len FROM l"
)
def category_figures(spark, sf_dir):
    p = passages.classify(index.as_passages(documents(spark, sf_dir)), LATIN_CLASSES, with_files=False)
    return index.category_index(p, "law").figures.withColumn("avg_len", F.round("avg_len", 6))


@query(
    f"WITH {BM25_CTE}, m AS (SELECT query_id, doc_id, unnest(terms) AS term FROM sc), g AS (SELECT query_id, doc_id, term, quality, grp FROM m JOIN cand USING (query_id, term) WHERE length(term) >= 3)"
    " SELECT query_id, doc_id, array_to_string(list_sort(list(DISTINCT term) FILTER (WHERE quality >= 0.45 AND grp IS NOT NULL))[1:12], ',') AS terms FROM g GROUP BY ALL HAVING count(*) FILTER (WHERE quality >= 0.45 AND grp IS NOT NULL) > 0"
)
def display_terms(spark, sf_dir):
    ix = built(spark, sf_dir)
    found = offered(spark, ix)
    shown = present.display_terms(found, rank.bm25(found, ix))
    return shown.filter(F.size("terms") > 0).select("query_id", "doc_id", F.array_join("terms", ",").alias("terms"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)manuscript') THEN 'مخطوطة' WHEN regexp_matches(p_name, '(?i)landmark') THEN 'معلم' WHEN regexp_matches(p_name, '(?i)person') THEN 'شخصية' WHEN regexp_matches(p_name, '(?i)era|timeline') THEN 'حدث' WHEN regexp_matches(p_name, '(?i)ansab') THEN 'نسب' WHEN regexp_matches(p_name, '(?i)library') THEN 'مرجع' ELSE 'صفحة' END AS type FROM part")
def guess_types(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.guess_type(F.col("p_name")).alias("type"))


@query("SELECT a.s_suppkey AS idx, min(b.s_suppkey) AS person_id, 55 AS points FROM supplier a JOIN supplier b ON a.s_suppkey % 20 = b.s_suppkey % 20 AND a.s_nationkey = b.s_nationkey WHERE b.s_suppkey % 2 = 0 GROUP BY a.s_suppkey")
def known_person_match(spark, sf_dir):
    people = _people(spark, sf_dir)
    known = people.filter("idx % 2 = 0").select(F.col("idx").alias("person_id"), "canonical_name", "kunya", F.col("geographical_mentions")[0].alias("geographical_scope"))
    return resolve.match_known(people, known, resolve.REVIEW)


@query(f"WITH {PAGES_CTE}, a AS (SELECT page_id, regexp_extract(h, '<article>(.*?)</article>', 1, 's') AS x FROM pg) SELECT page_id, 0 AS entry_no, {sql_page_text("regexp_extract(x, '<h1>(.*?)</h1>', 1, 's')", '')} AS title, {sql_page_text('x', '')} AS body FROM a WHERE x <> ''")
def live_sections(spark, sf_dir):
    return live.live_sections(table(spark, sf_dir, "pages")).select("page_id", "entry_no", "title", "body")


@query(f"SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;'), '({MARKED})', '<mark>\\1</mark>', 'gi') AS html FROM documents")
def highlight_html(spark, sf_dir):
    """Whole texts with their marks."""
    rows = documents(spark, sf_dir).select("doc_id", "text", F.array(*map(F.lit, SNIPPET_TERMS)).alias("terms"))
    return present.highlight_html(rows, "text", "terms", most=None).select("doc_id", "html")


# --- Arabic strings, built from keys as the tables hold none ----------------------------------------------

ROOTS, BEFORE, AFTER = ["كتاب", "قَلْعة", "أَحمد", "إبراهيم", "آل مُبارك", "مصطفى", "سؤال", "شيء"], ["", "ال", "وال", "بال", "لل", "و", "فال"], ["", "ات", "ها", "ين", "ية", "هم", "ون", "ة"]


def _made(spark, sf_dir) -> DataFrame:
    pick = lambda words, k: F.get(F.array(*map(F.lit, words)), k.cast("int"))
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(pick(BEFORE, k % 7), pick(ROOTS, k % 8), pick(AFTER, F.floor(k / 8) % 8)).alias("w"))


MADE_SQL = "made AS (SELECT p_partkey, " + " || ".join(f"{words}[({k})::INT + 1]" for words, k in ((BEFORE, "p_partkey % 7"), (ROOTS, "p_partkey % 8"), (AFTER, "(p_partkey // 8) % 8"))) + " AS w FROM part)"


def sql_affix_off(x: str, pattern: str) -> str:
    return f"CASE WHEN regexp_extract({x}, '{pattern}', 1) <> '' THEN regexp_extract({x}, '{pattern}', 1) ELSE {x} END"


@query(
    f"WITH {MADE_SQL}, one AS (SELECT p_partkey, w, {sql_affix_off('w', '^(?:' + '|'.join(C.ARABIC_PREFIXES) + ')(.{3,})$')} AS p FROM made)"
    f" SELECT p_partkey, w AS word, {sql_affix_off('p', '^(.{3,}?)(?:' + '|'.join(C.ARABIC_SUFFIXES) + ')$')} AS index_stem, {sql_affix_off('p', '^(.{3,}?)(?:' + '|'.join(C.ARABIC_SUFFIXES) + ')$')} AS query_stem FROM one"
)
def arabic_stems(spark, sf_dir):
    """Both stemmers go by script to the same rules for Arabic words."""
    return _made(spark, sf_dir).select("p_partkey", F.col("w").alias("word"), T.stem_index("w").alias("index_stem"), T.stem_query("w").alias("query_stem"))


@query(
    f"WITH {MADE_SQL} SELECT p_partkey, lower(regexp_replace(regexp_replace(translate(w, '{C.NAME_FROM}', '{C.NAME_TO}'), '[{C.NAME_MARKS}]', '', 'g'), '\\s+', '', 'g')) AS name,"
    f" trim(translate(regexp_replace(w, '[{C.PLACE_MARKS}]', '', 'g'), '{C.PLACE_FROM}', '{C.PLACE_TO}')) AS place,"
    f" trim(regexp_replace(translate(regexp_replace(lower(w), '[{C.MARKS}]', '', 'g'), '{C.FOLD_FROM}', '{C.FOLD_TO}'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS indexed,"
    f" trim(regexp_replace(translate(regexp_replace(lower(w), '[{C.MARKS}]', '', 'g'), '{C.FOLD_FROM}', '{C.FOLD_TO}'), '\\s+', ' ', 'g')) AS asked,"
    f" array_to_string(regexp_extract_all(regexp_replace(w, '[{C.NAME_MARKS}]', '', 'g'), '[\\x{{0600}}-\\x{{06FF}}]+|[\\p{{L}}\\p{{N}}_]+'), ',') AS retrieved FROM made"
)
def arabic_normal_forms(spark, sf_dir):
    return _made(spark, sf_dir).select(
        "p_partkey", T.normalize_name("w").alias("name"), T.normalize_place("w").alias("place"), T.normalize_index("w").alias("indexed"), T.normalize_query("w").alias("asked"), F.array_join(T.retrieval_tokens("w"), ",").alias("retrieved"),
    )


@query("SELECT o_orderkey, translate(o_orderkey::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩') AS shown, o_orderkey AS read FROM orders")
def local_digits(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", T.local_digits(F.col("o_orderkey")).alias("shown"))
    return rows.withColumn("read", T.first_number("shown"))


@query("SELECT p_partkey, '/' || array_to_string(list_transform(string_split(p_type || '/' || p_name || ' é.html', '/'), lambda x: url_encode(x)), '/') AS url FROM part")
def url_paths(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.url_path(F.concat("p_type", F.lit("/"), "p_name", F.lit(" é.html"))).alias("url"))


RANKS = {"src0": 1.25, "src1": 0.7}


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2.0::DOUBLE WHEN source = 'src0' THEN 1.25 WHEN source = 'src1' THEN 0.7 ELSE 1 END AS rank FROM documents")
def section_rank(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.col("source").alias("section"), F.when(F.col("doc_id") % 3 == 0, 2.0).otherwise(0.0).alias("rank"))
    return with_section_rank(rows, RANKS).select("doc_id", "rank")


def _routed(spark, sf_dir) -> DataFrame:
    """Decisions with the columns that the routes write; the head of a cluster is its customer."""
    heads = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("cluster_id"), F.col("c_name").alias("canonical_name"), F.col("c_mktsegment").alias("kunya"), F.array(F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("geographical_mentions"),
        F.lit("q").alias("raw_quote"), F.create_map(F.lit("title"), F.col("c_mktsegment")).alias("source_meta"),
    )
    return rules.with_traces(_evidence(spark, sf_dir)).join(heads, "cluster_id")


def _nobody(spark) -> DataFrame:
    return spark.createDataFrame([], "idx long, person_id long, points int")


@query(f"WITH {EVIDENCE_SQL} SELECT c_name AS canonical_name, relation AS proposed_relation, code AS proposed_evidence_code, confidence AS confidence_score, con AS has_contradiction FROM ga JOIN customer ON c_custkey = c WHERE gate = 'REVIEW'")
def review_queue_rows(spark, sf_dir):
    rows = sinks.review_rows(_routed(spark, sf_dir), _nobody(spark))
    return rows.select("canonical_name", "proposed_relation", "proposed_evidence_code", F.col("confidence_score").cast("int").alias("confidence_score"), "has_contradiction")


@query(f"WITH {EVIDENCE_SQL} SELECT c_name AS canonical_name, 'q' AS raw_quote, '{{\"title\":\"' || c_mktsegment || '\"}}' AS source_meta FROM ga JOIN customer ON c_custkey = c WHERE gate = 'REJECT'")
def rejected_log_rows(spark, sf_dir):
    return sinks.reject_rows(_routed(spark, sf_dir)).select("canonical_name", "raw_quote", "source_meta")


@query(f"WITH {EVIDENCE_SQL} SELECT c AS cluster_id, c_mktsegment || ' / ' || c_nationkey AS geographical_scope, relation, code AS evidence_code, confidence FROM ga JOIN customer ON c_custkey = c WHERE gate = 'ACCEPT'")
def accepted_persons(spark, sf_dir):
    return sinks.accepted(_routed(spark, sf_dir), _nobody(spark)).select("cluster_id", "geographical_scope", "relation", "evidence_code", "confidence")
