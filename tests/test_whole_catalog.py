"""Cases in which catalogue queries once did less than the whole job."""

import html

import pytest
from pyspark.sql import functions as F

from warraq.operators import expand, hybrid
from warraq.plans import catalog

SMALL = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        out = [i + 1]
        for j, y in enumerate(b):
            out.append(min(row[j] + (x != y), row[j + 1] + 1, out[j] + 1))
        row = out
    return row[-1]


def test_fuzzy_offers_over_all_terms(spark):
    terms = [r.term for r in catalog.built(spark, SMALL).terms.select("term").collect()]
    expected = []
    for r in expand.query_tokens(catalog.searches(spark)).collect():
        budget = 0 if len(r.token) <= 3 else 1 if len(r.token) <= 5 else 2
        near = [(distance(r.token, t), len(t), t) for t in terms if t[0] == r.token[0] and abs(len(t) - len(r.token)) <= budget and len(t) >= 2]
        expected += [(r.query_id, r.pos, r.token, t, d) for d, _, t in sorted(n for n in near if 0 < n[0] <= budget)[:8]]
    found = sorted(map(tuple, catalog.expand_fuzzy(spark, SMALL).collect()))
    assert found == sorted(expected) and any(not r[3].isascii() for r in found)


def test_suggestions_over_all_terms(spark, monkeypatch):
    monkeypatch.setattr(catalog, "MISSPELT", [(1, "tionxé")])
    terms = {r.term: r.df for r in catalog.built(spark, SMALL).terms.select("term", "df").collect()}
    near = [(distance("tionxé", t), len(t), t) for t in terms if t[0] == "t" and abs(len(t) - 6) <= 2]
    offers = sorted(n for n in near if 0 < n[0] <= 2)[:8]
    best = min((d, -terms[t], t) for d, _, t in offers)[2]
    assert not best.isascii() and [tuple(r) for r in catalog.did_you_mean(spark, SMALL).collect()] == [(1, best)]


def marked(text, terms):
    hit = [False] * (len(text) + 1)
    for term in terms:
        at = text.lower().find(term)
        while at >= 0:
            hit[at : at + len(term)] = [True] * len(term)
            at = text.lower().find(term, at + len(term))
    out = []
    for k, ch in enumerate(text):
        out.append(("<mark>" if hit[k] and not (k and hit[k - 1]) else "") + html.escape(ch).replace("&#x27;", "&#39;") + ("</mark>" if hit[k] and not hit[k + 1] else ""))
    return "".join(out)


def test_marks_in_whole_texts(spark, tmp_path):
    texts = ["x & y <b> 'q' " * 40 + "A License for the THING, thingtion\"s end", "no word of it " * 50, "thing", "", "tion" * 100 + " & license"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.html for r in catalog.highlight_html(spark, str(tmp_path)).collect()}
    assert found == {i: marked(t, catalog.SNIPPET_TERMS) for i, t in enumerate(texts)} and "<mark>THING</mark>" in found[0]


def test_more_than_a_thousand_queries_are_refused(spark):
    docs = spark.createDataFrame([(1,)], "doc_id long")
    bm25 = spark.createDataFrame([(1, 1, 1.0)], "query_id long, doc_id long, bm25 double")
    assert hybrid.combine(docs, spark.range(1000).select(F.col("id").alias("query_id")), bm25, None).count() == 1000
    with pytest.raises(ValueError):
        hybrid.combine(docs, spark.range(1001).select(F.col("id").alias("query_id")), bm25, None)
