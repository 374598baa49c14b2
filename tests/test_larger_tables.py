"""Cases in which queries once took more than their limits on larger tables, or differed from their SQL there."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from warraq.operators import expand, hybrid, index, present, rank, resolve
from warraq.plans import catalog
from warraq.sources import live, parsers

PEOPLE = "idx long, canonical_name string, kunya string, death_year_mentioned string, geographical_mentions array<string>, teachers array<string>, students array<string>"


def by_hand(people):
    """Every pair i < j with its points, by the rules themselves."""
    out = {}
    for a in people:
        for b in people:
            if a[0] < b[0]:
                net, other, same = set(a[5] + a[6]), set(b[5] + b[6]), lambda k: a[k] and b[k] and a[k] == b[k]  # noqa: B023
                name = 30 if SequenceMatcher(None, a[1], b[1]).ratio() > 0.85 else 0
                year = 20 if a[3] and b[3] and abs(int(a[3]) - int(b[3])) <= 5 else 0
                network = 25 if net and other and len(net & other) / len(net | other) > 0.3 else 0
                out[a[0], b[0]] = name + (15 if same(2) else 0) + year + network + (10 if set(a[4]) & set(b[4]) else 0)
    return out


def test_profiles_score_as_people_do(spark):
    rng = random.Random(3)
    names = ["baabacaacabbcb", "baabcacbaaabcb", "other", "wholly unlike"]  # the first two are alike in one order only
    made = [(rng.choice(names), rng.choice(["abua", "abub", None]), rng.choice(["200", "204", "211", None]), rng.choice([["g"], ["g", "h"], []]), rng.choice([["t"], ["t", "u"], ["v"], []]), []) for _ in range(40)]
    people = [(i, *rng.choice(made)) for i in range(150)]
    assert any(SequenceMatcher(None, a, b).ratio() > 0.85 >= SequenceMatcher(None, b, a).ratio() for a in names for b in names)
    expected, df = by_hand(people), spark.createDataFrame(people, PEOPLE)
    found = resolve.all_scored(resolve.prepare(df)).collect()
    got = {(r.i, r.j): r.points for r in found}
    assert len(got) == len(found) and all(expected[k] == p for k, p in got.items())
    assert {k for k, p in expected.items() if p >= 55} <= set(got)

    root = {p[0]: p[0] for p in people}
    for _ in people:
        for (i, j), p in expected.items():
            if p >= 75:
                root[i] = root[j] = min(root[i], root[j])
    members, doubtful = resolve.cluster(df)
    assert {r.idx: r.cluster_id for r in members.collect()} == root
    pairs = sorted((r.i, r.j, r.points) for r in doubtful.collect())
    assert pairs == sorted((i, j, p) for (i, j), p in expected.items() if 55 <= p < 75 and root[i] != root[j]) != []


def test_people_alike_are_compared_once(spark):
    same = [(i, f"name {i % 3}", "abu", "200", ["g"], ["t"], []) for i in range(900)]
    ready = resolve.prepare(spark.createDataFrame(same, PEOPLE))
    assert resolve.profiles(ready).count() == 3
    assert resolve.all_scored(ready).count() == 900 * 899 // 2


def test_references_without_their_semicolon_stay(spark):
    page = "<title>a&amp;&amp</title><body><h1 id='x&y'>b &copy; &cop &#38; &#38 &amp;lt;</h1><p>c & d&notit; R&D</p></body>"
    docs, _ = parsers.parse_html(page, "u", "u")
    assert [(d["title"], d["heading"], d["body"]) for d in docs] == [("a&&amp", "", "a&&amp"), ("a&&amp", "b © &cop & &#38 &lt;", "c & d&notit; R&D")]
    assert docs[1]["url"] == "u#x%26y"


def test_live_references_without_their_semicolon_stay():
    page = "<article><h1>a&amp;&amp</h1><p>b &copy; &cop</p></article><script type='application/ld+json'>{\"name\": \"x\", \"description\": \"R&D &amp y\"}</script>"
    found = live.parse_live_page(page, "/p")
    assert (found[0]["title"], found[0]["body"]) == ("a&&amp", "a&&ampb © &cop") and len(found) == 2


def test_live_entries_have_their_whole_text():
    words = "word " * 3000
    assert live.parse_live_page(f"<article><h1>t</h1> {words}</article>", "/p")[0]["body"] == f"t {words}".strip()


def test_shortened_text_that_is_cut_after_a_line_end(spark):
    text = "one " * 63 + "four\n" + "more and more"
    assert len(text[:257]) == 257 and text[256] == "\n"
    rows = spark.createDataFrame([(text,)], "t string").select(present.shortened(F.col("t")))
    assert rows.first()[0] == text[:256] + "…"


def test_snippet_from_the_end_of_a_long_text(spark, tmp_path):
    text = "a sentence that says nothing here. " * 200 + "here is the public license at last."
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert catalog.snippet_best_sentence(spark, str(tmp_path)).first().snippet == "here is the public license at last."


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_floor_brings_no_query_to_one_task(spark):
    scores = spark.createDataFrame([(1, 1, 100.0), (1, 2, 6.0), (1, 3, 5.9), (2, 1, 0.0)], "query_id int, doc_id int, score double")
    kept = rank.above_floor(scores)
    assert "Window" not in plan(kept) and sorted((r.query_id, r.doc_id) for r in kept.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_the_dictionary_is_not_shuffled(spark):
    tokens = expand.query_tokens(spark.createDataFrame([(1, "license thinng")], "query_id int, q string"))
    terms = spark.createDataFrame([("thing", 2), ("license", 1)], "term string, df long")
    for found in (expand.exact(tokens, terms), expand.prefix(tokens, terms), expand.stems(tokens, terms, index.stem_map(terms)), expand.fuzzy_matches(tokens, terms)):
        assert "SortMergeJoin" not in plan(found) and "BroadcastHashJoin" in plan(found)


def test_postings_are_not_shuffled(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(index.Index, "_write_postings", staticmethod(lambda posted, folder: written.append(plan(posted.sortWithinPartitions("term", "doc_id"))) or posted.write.parquet(f"{folder}/postings")))
    docs = spark.createDataFrame([(1, "one two", "s"), (2, "two", "s")], "doc_id long, text string, source string")
    ix = index.Index.create(index.as_passages(docs), str(tmp_path / "ix"))
    assert written[0].count("Exchange hashpartitioning(doc_id") == 1 == written[0].count("Exchange hashpartitioning") and ix.terms.count() == 2


def test_okapi_shuffles_no_tokens_by_document(spark):
    docs = spark.createDataFrame([(1, "one two two"), (2, "two"), (2, "one"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "two two one"), (2, "none")], "query_id int, q string")
    found = hybrid.okapi(docs, asked)
    assert "hashpartitioning(doc_id" not in plan(found) and {(r.query_id, r.doc_id) for r in found.collect()} == {(1, 1), (1, 2)}


def test_known_persons_are_met_by_profile(spark):
    people = spark.createDataFrame([(i, f"name {i % 2}", "abu", str(200 + i), ["g"], [f"t{i}"], []) for i in range(600)], PEOPLE)
    known = spark.createDataFrame([(k, f"name {k % 2}", "abu", "g / h") for k in range(600, 0, -1)], "person_id long, canonical_name string, kunya string, geographical_scope string")
    found = resolve.match_known(people, known, resolve.REVIEW)
    assert sorted(map(tuple, found.collect())) == [(i, 2 if i % 2 == 0 else 1, 55) for i in range(600)]
    assert "Window" not in plan(found)


def test_texts_without_folds_are_searched_as_they_are(monkeypatch):
    assert present.highlight_ranges("قَلْعة قلعة", ["قلعه"]) == [(0, 6), (7, 11)]
    monkeypatch.setattr(present, "_letters", lambda: 1 / 0)
    found = present.highlight_ranges("the thing is éé licensed, " * 40_000, catalog.SNIPPET_TERMS, None)
    assert len(found) == 80_000 and found[:2] == [(4, 9), (16, 23)]
    assert present.highlight_ranges("abcabc", ["abc", "cab", "bca"], None) == [(0, 6)]


def test_ranges_leave_python_in_short_batches(spark):
    rows = spark.createDataFrame([("a thing", ["thing"]), (None, ["thing"]), ("none", None)], "t string, w array<string>")
    out = present.highlight(rows, "t", "w")
    assert out.schema["ranges"].dataType.simpleString() == "array<struct<start:int,end:int>>"
    assert [[tuple(x) for x in r.ranges] for r in out.collect()] == [[(2, 7)], [], []]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
