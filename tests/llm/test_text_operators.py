import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from warraq.llm import curves, html_main, language, lm_scores, near_duplicates, passages, quality_rules, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def words(text):
    return WORD.findall(text or "")


# repeated substrings


def brute_spans(rows, n=100):
    seen, out = set(), []
    for i, t in sorted(rows):
        hit = np.zeros(len(t), bool)
        for p in range(len(t) - n + 1):
            w = t[p : p + n]
            if w in seen:
                hit[p : p + n] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(int), [0]))) == 1)
        out.append((i, len(t), int(hit.sum()), len(edges), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~hit])).hexdigest()))
    return sorted(out)


def test_repeats_match_brute_force(odd, docs):
    for df in (odd.filter("doc_id <> 6 AND doc_id <> 7"), docs.limit(120), odd.filter("doc_id in (0, 1, 7)")):
        rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
        assert sorted(map(tuple, repeats.span_digests(df).collect())) == brute_spans(rows)


def test_repeats_of_repetitive_texts(spark):
    texts = ["a" * 350, "ab" * 200, "a" * 100, "x" + "a" * 150, "abc" * 90, "é" * 120]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, repeats.span_digests(df).collect())) == brute_spans([(i, t.encode()) for i, t in enumerate(texts)])
    cleaned = {r.doc_id: r.text for r in repeats.cleaned_texts(df).collect()}
    assert cleaned[2] == "" and set(cleaned[5]) <= {"é"}


def test_long_texts_in_parts_give_the_same_passes():
    import pandas as pd
    import zstandard

    from warraq.llm._exchange import Batch, Question

    rng = np.random.default_rng(1)
    part = bytes(rng.integers(97, 123, 700, dtype=np.uint8))
    texts = [bytes(rng.integers(97, 123, 900, dtype=np.uint8)) + part + b"z" * 150 + part[:300], b"q" + part, part[50:260], b"short"]
    head = np.array([len(texts), *range(len(texts)), *map(len, texts)], "<i8").tobytes() + bytes(len(texts))
    batch = Batch([zstandard.ZstdCompressor().compress(head + b"".join(texts))])

    def spans(size: int) -> list:
        s = repeats.Suffixes(batch, 1, 100, 32, size)
        anchors, runs = s.first_questions()
        frame = lambda q, bits: pd.DataFrame({"bucket": [0], "kind": [q.kind], "payload": [zstandard.ZstdCompressor().compress(np.packbits(bits).tobytes())]})
        contents = defaultdict(set)
        for a, c in zip(s.anchor.tolist(), s.content.tolist(), strict=True):
            contents[a].add(c)
        s.settle_runs(pd.concat([frame(anchors, np.array([len(contents[k]) > 1 for k in anchors.keys.tolist()])), frame(runs, np.ones(len(runs.keys), bool))]))
        windows: Question = s.window_question()
        doc, low, high = s.repeated_windows(frame(windows, np.ones(len(windows.keys), bool)))
        return [repeats.merged(low[doc == d], high[doc == d]) for d in range(len(texts))]

    assert spans(1 << 20) == spans(200) == spans(333)
    assert [sum(b - a for a, b in x) for x in spans(200)] == [r[2] for r in brute_spans(list(enumerate(texts)))]


def test_words_of_long_texts_in_parts(monkeypatch):
    from warraq.llm import _words

    raw = np.frombuffer(b"alpha be  gamma\ndelta " * 50 + b"x" * 400 + b" end", np.uint8)
    whole = _words.words_of(np.array([0, len(raw)]), raw)
    monkeypatch.setattr(_words, "PART", 64)
    parts = _words.words_of(np.array([0, len(raw)]), raw)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_repeats_of_nothing(empty):
    assert repeats.span_digests(empty).count() == 0


# quality rules


def brute_statistics(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics_match_brute_force(odd, docs, empty):
    for df in (odd, docs):
        for r in quality_rules.with_statistics(df).join(df.select("doc_id", F.col("text").alias("t")).distinct(), "doc_id").collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(r.t), r.doc_id
    assert quality_rules.apply_rules(empty, []).count() == 0


def test_decision_list_learns_and_spares_good_texts(docs, spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rules = quality_rules.learn_decision_list(quality_rules.labelled_statistics(docs, labels))
    out = quality_rules.apply_rules(docs, rules).join(labels, "doc_id")
    good = out.filter("quality = 1 AND NOT base_failed")
    assert good.filter("kept").count() >= 0.97 * good.count()
    bad = out.filter("quality = 0")
    assert bad.filter("NOT kept").count() >= 0.8 * bad.count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_decision_list_of_planted_rules():
    rows = [(int(a > 5 and b <= 2), float(a), float(b)) for a in range(10) for b in range(10) for _ in range(4)]
    rules = quality_rules.learn_decision_list(rows, ("a", "b"))
    assert len(rules) == 1 and {t[0] for t in rules[0].tests} == {"a", "b"}
    assert quality_rules.learn_decision_list([], ("a",)) == [] and quality_rules.learn_decision_list([(0, 1.0)], ("a",)) == []


# near duplicates


def brute_links(rows, n=5, t=0.8):
    sets = [frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if (w := words(x)) else frozenset() for _, x in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[max(top(a), top(b))] = min(top(a), top(b))
    least = defaultdict(lambda: 1 << 60)
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least[top(k)], i)
    return sorted((i, least[top(k)], links[k]) for k, (i, _) in enumerate(rows))


def test_links_match_brute_force(odd, docs, empty):
    for df in (odd, docs):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        found = sorted((r.doc_id, r.class_id, r.n_links) for r in near_duplicates.linked_documents(df).collect())
        assert found == brute_links(rows)
    assert near_duplicates.linked_documents(empty).count() == 0


def test_a_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 20)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:k] + [f"new{k}"] + base[k + 1 :]) for k in range(60)] + ["other words entirely in this text here"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted((r.doc_id, r.class_id, r.n_links) for r in near_duplicates.linked_documents(df).collect())
    assert found == brute_links(list(enumerate(texts)))


def test_posterior_keeps_what_can_reach_the_threshold():
    plan = near_duplicates.least_matches(16, 112, 0.8, 1e-7)
    for m, n in plan:
        grid = np.linspace(0, 1, 20001)
        density = grid**n * (1 - grid) ** (m - n)
        tail = density[grid >= 0.8].sum() / density.sum()
        assert tail >= 0.5e-7
        if n:
            below = grid ** (n - 1) * (1 - grid) ** (m - n + 1)
            assert below[grid >= 0.8].sum() / below.sum() < 2e-7


# language-model scores


def brute_scores(rows, order=3):
    counts = [Counter() for _ in range(order + 1)]
    texts = [(i, words(t)) for i, t in rows]
    for _, w in texts:
        for n in range(1, order + 1):
            counts[n].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    total, out = sum(counts[1].values()), []
    for i, w in texts:
        s = b = 0
        for k in range(len(w)):
            factor, most = 1.0, min(order, k + 1)
            for n in range(most, 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if n == 1 or counts[n][g] >= 2:
                    s += math.log(factor * counts[n][g] / (counts[n - 1][g[:-1]] if n > 1 else total))
                    b += most - n
                    break
                factor *= 0.4
        out.append((i, len(w), round(s, 6), b))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_match_brute_force(odd, empty, order):
    df = odd.filter("doc_id <> 6")
    found = sorted((r.doc_id, r.n_words, round(r.log_score, 6), r.n_backoffs) for r in lm_scores.score_documents(df, order=order).collect())
    expected = brute_scores([(r.doc_id, r.text) for r in df.collect()], order)
    assert [(a, b, d) for a, b, _, d in found] == [(a, b, d) for a, b, _, d in expected]
    assert all(abs(x[2] - y[2]) < 1e-4 for x, y in zip(found, expected, strict=True))
    assert lm_scores.score_documents(empty).count() == 0


# chained passages


def test_fuzzy_passages(spark, odd, empty):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(80)]
    edited = [word() if k % 17 == 8 else w for k, w in enumerate(passage)]
    del edited[40]
    fill = lambda n: [word() for _ in range(n)]
    texts = [fill(50) + passage + fill(30), fill(120), fill(20) + edited + fill(60), fill(10) + passage, fill(200)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r for r in passages.repeated_passages(df).collect()}
    assert set(found) == {2, 3}
    assert found[3].start_word == 10 and found[3].n_words == 80 and found[3].n_matched == 80 and found[3].source_start == 50
    assert found[2].source_id == 0 and abs(found[2].start_word - 20) <= 2 and found[2].n_words >= 75 and found[2].n_matched >= 70
    assert passages.repeated_passages(empty).count() == 0
    passages.repeated_passages(odd).collect()


def test_chaining_against_brute_force():
    import random

    rng = random.Random(2)
    for _ in range(30):
        links = sorted({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(25)}, key=lambda p: (p[1], p[0]))
        x, y = np.array([p[0] for p in links]), np.array([p[1] for p in links])
        best = passages.chains(x, y, 1)[0]
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(best, best[1:], strict=False))
    x = np.array([10, 12, 14, 50, 16])
    y = np.array([0, 2, 4, 5, 6])
    assert passages.chains(x, y, 2)[0] == [(10, 0, 6), (16, 6, 2)]


# language


def test_language_profiles(docs, odd, empty):
    profiles = language.learn_profiles(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    tested = language.identify(docs, profiles).filter(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    assert tested.filter("lang_pred = lang").count() >= 0.95 * tested.count()
    found = {r.doc_id: r for r in language.identify(odd, profiles).collect()}
    assert {i for i, r in found.items() if r.lang_pred == "und"} == {0, 1, 2, 3}
    assert all(0 <= r.score <= 1 for r in found.values()) and "score" in language.identify(odd, profiles).columns
    assert language.identify(empty, profiles).count() == 0
    nothing = language.learn_profiles(empty)
    assert language.identify(odd, nothing).filter("lang_pred <> 'und'").count() == 0


def test_profiles_match_brute_force():
    text = "Ab ab, ba!"
    grams, counts = language.gram_counts(text)
    expected = Counter()
    padded = " ab ab ba "
    for n in (1, 2, 3):
        for k in range(len(padded) - n + 1):
            g = padded[k : k + n]
            if g != " " and " " not in g[1:-1]:
                expected[g] += 1
    decode = lambda g: "".join(chr(g >> s & (1 << 21) - 1) for s in (42, 21, 0) if g >> s)
    assert {decode(int(g)): int(c) for g, c in zip(grams, counts, strict=True)} == dict(expected)


# pages


def test_main_text_keeps_the_article(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class='cookie-notice'>We set cookies here.</div><article><h1>Head &amp; line</h1><p>First  text\nhere&nbsp;now.<script>var a='</p>'</script></p><p>One.</p><p>Second <a href=y>link</a> of the long text that goes on for some words.</p><section id=comments><p>Nice text, thank you for it.</p></section></article><footer>&copy; 2020 all of it</footer></body></html>"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<p>open <b>text<p>next"), (1, "u", page), (5, "u", "<div><<<>>&&&lt;" + "<p" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html_main.extract(df).collect()
    by = {r.page_id: r for r in found}
    assert by[1].text == "Head & line\n\nFirst text here now.\n\nOne.\n\nSecond link of the long text that goes on for some words."
    assert by[2].text == by[3].text == "" and by[4].text == "open text\n\nnext" and len(found) == len(rows)
    assert all(r.n_chars == len(r.text) for r in found)
    assert html_main.extract(df.limit(0)).count() == 0


def test_tree_on_its_table():
    x, y = html_main.labelled_table()
    right = [html_main.classify(html_main.trained_tree(), r) == k for r, k in zip(x, y, strict=True)]
    assert len(y) <= 200 and sum(right) >= 0.95 * len(y)


# neighbours


def test_hilbert_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(4)] * 3), -1).reshape(-1, 3)
    keys = curves.hilbert_keys(grid, 2)
    assert sorted(keys) == list(range(64))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000 + i, x[7].tolist()) for i in range(60)]  # one common vector
    rows += [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [None] * 16), (3080, [1.0] * 3), (3100, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = defaultdict(list)
    for r in curves.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    ids = np.array([i for i, v in rows if i < 3000])
    y = np.array([v for i, v in rows if i < 3000], dtype=np.float32).astype(float)
    hit = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        score = (y * y[k]).sum(axis=1)
        order = [o for o in np.lexsort((ids, -score)) if o != k][:20]
        got = found[ids[k]]
        assert len(got) == 20 and all(abs(s - score[np.flatnonzero(ids == i)[0]]) < 1e-12 for i, s in got)
        hit += len({i for i, _ in got} & set(ids[order]))
        total += 20
        if ids[k] >= 2000:
            assert [i for i, _ in got] == [i for i in [7, *range(2000, 2060)] if i != ids[k]][:20]
    assert set(found) == set(ids[ids % 20 == 0]) and hit >= 0.9 * total
    few = {(r.query_id, r.vec_id) for r in curves.nearest(df.filter("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()}
    assert few == {(0, 1), (0, 2), (0, 3), (0, 4)}
    assert curves.nearest(df.limit(0), F.lit(True)).count() == 0
