"""Cases in which the operators once did less than the whole job."""

import random

import numpy as np

import corpus_pipeline
from warraq.llm import html_main, near_duplicates, passages


def some_words(seed):
    rng = random.Random(seed)
    return lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def covered(rows, doc, start, n):
    """The share of these words of the text that its passages hold."""
    hit = np.zeros(start + n, bool)
    for r in rows:
        if r.doc_id == doc:
            hit[r.start_word : r.start_word + r.n_words] = True
    return hit[start:].mean()


def next_row(row, v, b):
    """The next row of the table of longest common subsequences."""
    out = [0]
    for j in range(len(b)):
        out.append(row[j] + 1 if v == b[j] else max(row[j + 1], out[j]))
    return out


def written(spark):
    """Bytes that all stages of the session have shuffled."""
    return sum(x.totalShuffleWrite() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().statusStore().executorList(False)))


# chained passages


def test_two_passages_with_other_words_between(spark):
    fill, texts, places = some_words(7), [], []
    for n, gap in ((60, 40), (60, 100), (100, 200), (200, 256), (60, 900)):
        one, two = fill(n), fill(n)
        texts += [fill(20) + one + fill(gap) + two + fill(20), fill(33) + one + fill(gap) + two + fill(9)]
        places += [(len(texts) - 1, 33, n), (len(texts) - 1, 33 + n + gap, n)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = passages.repeated_passages(df).collect()
    assert [covered(rows, *p) for p in places] == [1.0] * len(places)
    assert len(rows) == len(places) and all(r.n_matched == r.n_words for r in rows)


def test_parts_of_a_chain_that_fails():
    fill = some_words(8)
    one, two = fill(60), fill(60)
    number = {}
    source, text = (np.array([number.setdefault(w, len(number)) for w in one + fill(k) + two], np.uint32) for k in (70, 90))
    chain = [(0, 0, 60), (130, 150, 60)]
    assert passages.align(chain, text, source, 0) == [(0, 60, 0, 60, 60), (150, 210, 130, 190, 60)]


def test_long_gaps_are_aligned():
    rng = random.Random(9)
    source = np.array([rng.randrange(10**6) for _ in range(700)], np.uint32)
    text = source.copy()
    text[100:600:5] = np.arange(2 * 10**6, 2 * 10**6 + 100)
    assert passages.align([(0, 0, 100), (600, 600, 100)], text, source, 0) == [(0, 700, 0, 700, 600)]
    for _ in range(50):
        a, b = (np.array([rng.randrange(6) for _ in range(rng.randrange(40))]) for _ in range(2))
        row = [0] * (len(b) + 1)
        for v in a:
            row = next_row(row, v, b)
        assert passages.common_length(a, b) == row[-1]


def test_passage_with_a_phrase_of_an_earlier_text(spark):
    """Every stretch of 50 words that an earlier place holds lies in a passage, wherever its seeds were first seen."""
    rng, fill = random.Random(11), some_words(12)
    stock = [fill(rng.randrange(12, 45)) for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(stock) if rng.random() < 0.7 else fill(rng.randrange(1, 30)) for _ in range(8)]
        texts.append([w for p in parts for w in p])
    common, own = fill(25), fill(30)
    texts = [fill(40) + common[:24] + fill(5), fill(9) + own + fill(3) + common[12:] + fill(40), *texts]
    texts.append(fill(30) + texts[1][9:55] + texts[1][55:60] + fill(30))
    rows = passages.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    first, missed, n = {}, [], 0
    for i, t in enumerate(texts):
        for y in range(len(t) - 49):
            source = first.setdefault(tuple(t[y : y + 50]), (i, y))
            if source[0] < i or source[1] + 50 <= y:
                n += 1
                if not any(r.doc_id == i and r.start_word <= y and y + 50 <= r.start_word + r.n_words for r in rows):
                    missed.append((i, y))
    assert n > 500 and missed == []
    assert all(r.n_words >= 50 and r.n_matched >= 0.8 * max(r.n_words, r.source_words) for r in rows)


# pages


def test_end_tags_that_are_left_out():
    lines = [f"Line {k} of the article says in some more words what the thing is about and why it was so." for k in range(4)]
    article = "<h1>The head of it</h1>" + "".join(f"<p>{x}</p>" for x in lines)
    menus = ["<nav><ul>" + "<li><p>item" * 40 + "</ul></nav>", "<aside><table><tr>" + "<td>cell" * 80 + "</table></aside>", "<div class=sidebar><table>" + "<tr><th>name<td>value" * 70 + "</table></div>", "<form>" + "<td>cell" * 65 + "</form>", "<nav>" + "<div>" * 100 + "item</nav>"]
    for menu in menus:
        blocks = html_main.flat_blocks(f"<body>{menu}{article}<footer>end</footer>")
        assert [b[3] for b in blocks if b[0] in lines] == [0] * 4, menu[:40]
        assert all(b[3] for b in blocks if b[0] in ("item", "cell", "name", "value", "name value"))
        assert html_main.main_text(f"<body>{menu}{article}").endswith("\n\n".join(lines)), menu[:40]


def test_implied_ends_keep_to_their_list_and_table():
    off = lambda page: {b[0]: int(b[3] > 0) for b in html_main.flat_blocks(page)}
    assert off("<ul><li class=menu>a<ul><li>b<li>c</ul>d<li>e</ul>f") == {"a": 1, "b": 1, "c": 1, "d": 1, "e": 0, "f": 0}
    assert off("<table><tr class=ad><td>a<table><tr><td>b<tr><td>c</table>d<td>e<tr><td>f</table>g") == {"a": 1, "b": 1, "c": 1, "d": 1, "e": 1, "f": 0, "g": 0}
    assert off("<p class=share>a<div>b</div>c<p>d</p>e") == {"a": 1, "b": 0, "c": 0, "d": 0, "e": 0}


# pipeline


def test_rows_of_the_join_and_of_the_cut(spark):
    rng, fill = random.Random(21), some_words(22)
    texts = [fill(rng.randrange(60, 120)) for _ in range(12)]
    for _ in range(24):
        t = list(rng.choice(texts))
        for _ in range(rng.choice([0, 1, 1, 12])):
            t[rng.randrange(len(t))] = fill(1)[0]
        texts.append(t if rng.random() < 0.7 else fill(20) + t[:40] + fill(20))
    rows = [(i, " ".join(t), "en", "s", len(" ".join(t))) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    n = near_duplicates.WORDS
    sets = [{tuple(t[k : k + n]) for k in range(len(t) - n + 1)} for t in texts]
    head = list(range(len(texts)))
    for _ in texts:  # until no link lowers a class
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if len(a & b) >= near_duplicates.THRESHOLD * len(a | b):
                    head[i] = min(head[i], head[j])
    joined = corpus_pipeline.near_duplicate_join(spark, docs, "")
    expected = [r for r in rows if head[r[0]] == r[0]]
    assert sorted(map(tuple, joined.collect())) == expected and len(expected) < len(rows)
    seen, left = set(), []
    for i, t, *rest in expected:
        hit = np.zeros(len(t), bool)
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                hit[k : k + 100] = True
            seen.add(t[k : k + 100])
        kept = "".join(ch for ch, cut in zip(t, hit, strict=True) if not cut)
        if kept:
            left.append((i, kept, *rest[:2], len(kept)))
    found = sorted(map(tuple, corpus_pipeline.repeated_substrings(spark, spark.createDataFrame(expected, docs.schema), "").collect()))
    assert found == left and found != expected


# main text of pages: a held-out share of the given pages, as they are and without any tag or name that tells parts apart


def test_main_text_by_words_and_neighbours():
    import re
    from collections import Counter

    import pandas as pd

    pages = pd.read_parquet("/root/testdata/sf0.001/pages.parquet").html
    for plain in (False, True):
        right = said = due = 0
        for page in pages:
            main = page[page.index("<article>") : page.index("</article>")]
            expected = Counter(" ".join(b[0] for b in html_main.flat_blocks(main)).split())
            if plain:
                page = re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", page).replace('<div class="ad">', "<div>")
            found = Counter(html_main.main_text(page).split())
            right, said, due = right + (found & expected).total(), said + found.total(), due + expected.total()
        assert right >= 0.95 * said and right >= 0.95 * due, plain


def test_main_text_keeps_what_an_article_holds():
    page = "<body><nav><a href=x>m</a></nav><article><div class='article-header'><p>Intro of this.</p></div><p>A <button>word</button> and <math>x</math> in it.</p></article>"
    assert html_main.main_text(page) == "Intro of this.\n\nA word and x in it."
    deep = "<nav>" + "<div>" * 300 + "<a href=x>m</a></nav><article>" + "<div>" * 250 + "<p>The text of it.</p></article>"
    assert html_main.main_text(deep) == "The text of it."


def test_broken_markup_takes_time_in_proportion():
    import time

    for part in ('<p class="x ', "<p a='\">", "<script", "<svg>", "<head>", "<![CDATA[", '<p a="x>" "', "<!--"):
        began = time.perf_counter()
        html_main.main_text(part * 20_000)
        assert time.perf_counter() - began < 5, part


# near copies


def test_blocks_of_near_copies_travel_packed(spark, monkeypatch):
    """A set of a large group once travelled whole to each pair of blocks: bytes grew with the square of the group."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 10)
    rng, fill = random.Random(31), some_words(32)
    base, texts = fill(400), []
    for _ in range(200):
        t = list(base)
        for _ in range(rng.randrange(1, 8)):
            t[rng.randrange(len(t))] = fill(1)[0]
        texts.append(t)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    before = written(spark)
    rows = near_duplicates.linked_documents(df).collect()
    sets = [{tuple(t[k : k + near_duplicates.WORDS]) for k in range(len(t) - near_duplicates.WORDS + 1)} for t in texts]
    links = [sum(len(a & b) >= near_duplicates.THRESHOLD * len(a | b) for b in sets) - 1 for a in sets]
    assert {r.doc_id: r.n_links for r in rows} == dict(enumerate(links)) and sum(links) > 100 * len(texts)
    assert written(spark) - before < 4 * sum(8 * len(a) for a in sets)
