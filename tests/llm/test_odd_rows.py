"""Null ids, ids that repeat with other texts, and columns of clashing names, compared by value."""

import random

import corpus_pipeline
from warraq.llm import language, lm_scores, near_duplicates, passages, quality_rules, repeats

SMALL = "/root/testdata/sf0.001"
LEAST = -(1 << 63)


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def text(seed, n):
    return " ".join(words(seed, n))


def test_ids_that_repeat_with_other_texts(spark):
    base = words(1, 200)
    near = base[:100] + ["other"] + base[101:]
    rows = [(1, text(2, 150)), (1, " ".join(base)), (2, " ".join(near)), (None, " ".join(base)), (None, text(3, 120)), (LEAST, text(4, 90)), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {(r.doc_id, r._t): r for r in near_duplicates.linked_documents(df.withColumnRenamed("text", "_t").selectExpr("doc_id", "_t", "_t AS text"), keep=("_t",)).collect()}
    assert found[(1, rows[0][1])].n_links == 0 and found[(1, rows[1][1])].n_links == 2 and found[(2, rows[2][1])].n_links == 2
    assert found[(None, rows[3][1])].n_links == 2 and found[(None, rows[3][1])].class_id == 1 and found[(None, rows[4][1])].n_links == 0
    assert found[(None, rows[4][1])].class_id is None and found[(LEAST, rows[5][1])].class_id == LEAST and found[(3, None)].class_id == 3
    assert found[(1, rows[0][1])].class_key != found[(1, rows[1][1])].class_key == found[(2, rows[2][1])].class_key
    docs = spark.createDataFrame([r for r in rows if r[0] is not None] + [rows[1]], "doc_id long, text string")
    kept = sorted((r.doc_id, r.text or "") for r in corpus_pipeline.near_duplicate_join(spark, docs, "").collect())
    assert kept == sorted([(1, rows[0][1]), (1, rows[1][1]), (LEAST, rows[5][1]), (3, "")])
    cut = sorted((r.doc_id, r.text) for r in corpus_pipeline.repeated_substrings(spark, corpus_pipeline.near_duplicate_join(spark, docs, ""), "").collect())
    assert cut == sorted([(1, rows[0][1]), (1, rows[1][1]), (LEAST, rows[5][1])])


def test_null_ids_stay_null(spark):
    rows = [(None, text(1, 60)), (LEAST, text(1, 60)), (5, text(2, 60)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scored = sorted((r.doc_id is None, r.n_words) for r in lm_scores.score_documents(df).collect())
    assert scored == [(False, 60), (False, 60), (True, 0), (True, 60)]
    spans = {(r.doc_id, r.n_bytes): r.n_removed for r in repeats.span_digests(df).collect()}
    n = len(rows[0][1])
    assert spans[(None, n)] + spans[(LEAST, n)] == n and spans[(5, len(rows[2][1]))] == 0 and spans[(None, 0)] == 0
    found = passages.repeated_passages(spark.createDataFrame([*rows, (7, text(2, 60))], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.source_id, r.n_words) for r in found] == [(7, 5, 60)]


def test_clashing_columns_keep_their_values(spark):
    names = ("score", "lang_pred", "n_words", "kept", "rule", "base_failed", "class_id", "class_key", "_text", "_row", "before", "_left", "b", "key")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("*", *(f"concat('{c}', doc_id) AS {c}" for c in names))
    for stage in (corpus_pipeline.language_id, corpus_pipeline.quality, corpus_pipeline.near_duplicate_join, corpus_pipeline.repeated_substrings):
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        rows = out.select("doc_id", *names).collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names), stage.__name__


def test_more_languages_than_are_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"{'ab'[i % 2] * 5} text of {'cd'[i % 2] * 4}", f"l{i % 2}") for i in range(40)], "doc_id long, text string, lang string")
    one = language.learn_profiles(df, per_language=5)
    monkeypatch.setattr(language, "BROADCAST_LANGUAGES", 1)
    two = language.learn_profiles(df, per_language=5)
    assert one.languages == two.languages == ["l0", "l1"] and (one.ranks == two.ranks).all()


def test_labelled_rows_that_repeat_an_id(spark):
    docs = spark.createDataFrame([(i % 30, text(i, 40)) for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    rows = quality_rules.labelled_statistics(docs, labels)
    assert len(rows) == 30 and sorted(rows) == sorted(quality_rules.labelled_statistics(docs.orderBy("text"), labels))


def test_profiles_choose_by_distance_out_of_place():
    """The choice against the measure worked out gram by gram."""
    texts = {"aa": "the other thing is that they went there with them", "bb": "der andere ist dass sie dort mit ihnen gingen und", "cc": "los otros que se fueron con ellos a la casa de"}
    ranked = {k: language.top_grams(*language.gram_counts(t), 40) for k, t in texts.items()}
    profiles = language.Profiles.of(ranked, 40)
    for t in (*texts.values(), "the house of them", "und der", "casa", "x", "zzz qq"):
        own = language.top_grams(*language.gram_counts(t), 40).tolist()
        apart = {}
        for lang, grams in ranked.items():
            at = {g: k for k, g in enumerate(grams.tolist())}
            apart[lang] = sum(abs(at[g] - k) if g in at else 40 for k, g in enumerate(own))
        best = min(sorted(apart), key=apart.get)
        assert profiles.predict(t) == (best, 1 - apart[best] / (40 * len(own)))
