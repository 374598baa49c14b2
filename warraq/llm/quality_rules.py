"""Quality rules: text statistics and learned decision lists, all in native column expressions.

The list is learned at the driver from the statistics of a bounded sample of labelled texts.  Sequential
covering: a rule grows by the threshold test with the greatest information gain on two thirds of what
earlier rules leave, is pruned back on the last third, and is kept if it is precise enough there.  The list
becomes one ordered CASE expression, so that applying it needs no code outside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.llm._common import require

SAMPLE_ROWS, MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 12_000, 20, 30, 8
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols_per_word", "chars_per_word", "repeat_share", "dup_line_share", "distinct_share", "upper_share", "marks_per_word", "words_per_line")


def _count(text: Column, characters: str) -> Column:
    """Occurrences of single-byte characters."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters), F.lit(0)).cast("long")


def _once(value: Column) -> Column:
    """The same value, marked as tied to its partition: the planner then keeps it in its own projection and
    neither repeats a costly expression in what uses it nor moves a filter on it below."""
    return F.when(F.spark_partition_id() >= 0, value)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns of BASE and FEATURES (existing columns of these names are replaced).

    A null text counts as empty: all statistics 0.  Windows are compared by a 64-bit hash of the 64-bit
    hashes of their words.  Every step works on one row; nothing is exploded or shuffled.
    """
    require(docs, text_col)
    own = {*BASE, *FEATURES, "_t", "_w", "_l", "_h", "_n", "_win", "_p"}
    kept = [c for c in docs.columns if c not in own]
    df = docs.select(*kept, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    bare = F.btrim("_t", F.lit(_BLANKS))
    df = df.select("*", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")).alias("_w"))
    df = df.select("*", _once(F.transform("_w", lambda w: F.xxhash64(w))).alias("_h"), F.size("_w").cast("long").alias("n_words"), F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "").alias("_l"))
    at = lambda i, k: F.get("_h", i + k)
    windows = F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW))))
    df = df.select("*", _once(F.when(F.size("_h") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>"))).alias("_win"))
    # positions of windows that occur again, in rising order; most texts have none and skip the sort
    pairs = F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.sort_array(F.transform("_win", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    df = df.select(*[c for c in df.columns if c != "_win"], _once(F.coalesce(pairs, F.array().cast("array<struct<x:bigint,i:int>>"))).alias("_p"))
    again = F.filter("_p", lambda s, k: F.coalesce(s.x == F.get("_p", k - 1).x, F.lit(False)) | F.coalesce(s.x == F.get("_p", k + 1).x, F.lit(False)))
    covered = F.aggregate(
        F.sort_array(F.transform(again, lambda s: s.i)),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s.n + i + WINDOW - F.greatest(i, s.end)).cast("long").alias("n"), (i + WINDOW).alias("end")),
        lambda s: s.n,
    )
    chars = F.char_length("_t")
    df = df.select(
        *kept,
        _once(F.col("n_words")).alias("n_words"),
        (chars - _count(F.col("_t"), _BLANKS)).cast("long").alias("word_chars"),
        _count(F.col("_t"), _SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _once(F.when(F.size("_p") == 0, F.lit(0).cast("long")).otherwise(covered)).alias("n_repeat_words"),
        F.size("_l").alias("_lines"),
        F.size(F.array_distinct("_h")).alias("_distinct"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).alias("_upper"),
        _count(F.col("_t"), "!?").alias("_marks"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return df.select(
        *kept,
        *BASE,
        share("n_symbols", "n_words").alias("symbols_per_word"),
        share("word_chars", "n_words").alias("chars_per_word"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_dup_lines", "_lines").alias("dup_line_share"),
        share("_distinct", "n_words").alias("distinct_share"),
        share("_upper", "word_chars").alias("upper_share"),
        share("_marks", "n_words").alias("marks_per_word"),
        share("n_words", "_lines").alias("words_per_line"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Reject if all tests (feature, above, threshold) hold; above: value > threshold, else value <= threshold."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        return reduce(and_, (F.col(f) > t if above else F.col(f) <= t for f, above, t in self.tests))

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>' if above else '<='} {t:.4g}" for f, above, t in self.tests)


def _holds(x: np.ndarray, tests: list[tuple[int, bool, float]]) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for f, above, t in tests:
        ok &= x[:, f] > t if above else x[:, f] <= t
    return ok


def _grow(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray], most_tests: int) -> list[tuple[int, bool, float]]:
    tests: list[tuple[int, bool, float]] = []
    inside = np.ones(len(x), dtype=bool)
    while len(tests) < most_tests:
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        if not p or not n:
            break
        best, base = (1e-9, None), np.log2(p / (p + n))
        for f, values in enumerate(cuts):
            below_p = np.searchsorted(np.sort(x[inside & bad, f]), values, side="right")
            below_n = np.searchsorted(np.sort(x[inside & ~bad, f]), values, side="right")
            for above, ps, ns in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
                gain = np.where(ps > 0, ps * (np.log2(np.maximum(ps, 1) / np.maximum(ps + ns, 1)) - base), 0)
                k = int(gain.argmax()) if len(gain) else -1
                if k >= 0 and gain[k] > best[0]:
                    best = (gain[k], (f, above, float(values[k])))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= _holds(x, tests[-1:])
    return tests


def _prune(x: np.ndarray, bad: np.ndarray, tests: list[tuple[int, bool, float]]) -> list[tuple[int, bool, float]]:
    def worth(k: int) -> float:
        ok = _holds(x, tests[:k])
        p, n = (ok & bad).sum(), (ok & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return tests[: max(range(1, len(tests) + 1), key=lambda k: (worth(k), -k))] if tests else tests


def learn_decision_list(rows: list[tuple], features: tuple[str, ...] = FEATURES, most_rules: int = 12, most_tests: int = 4, precision: float = 0.95, least_covered: int = 4) -> list[Rule]:
    """Ordered rules that reject; rows: (1 for bad or 0, the features' values ...).

    Without both kinds of label the list is empty and nothing is rejected by it.
    """
    if not rows:
        return []
    table = np.array(rows, dtype=float)
    table = table[np.lexsort(table.T[::-1])]  # the same rows in any order give the same list
    bad, x = table[:, 0] > 0.5, table[:, 1:]
    values = [np.unique(x[:, f]) for f in range(x.shape[1])]
    middles = [(v[1:] + v[:-1]) / 2 for v in values]
    cuts = [m if len(m) <= 256 else m[np.linspace(0, len(m) - 1, 256).astype(int)] for m in middles]
    grow_part = np.arange(len(x)) % 3 != 2
    rules: list[Rule] = []
    left = np.ones(len(x), dtype=bool)
    while len(rules) < most_rules and (left & bad).any():
        a, b = left & grow_part, left & ~grow_part
        tests = _prune(x[b], bad[b], _grow(x[a], bad[a], cuts, most_tests))
        if not tests:
            break
        hit = _holds(x, tests)
        good_rule = True
        for part in (left, b):
            p, n = (hit & part & bad).sum(), (hit & part & ~bad).sum()
            good_rule &= p + n > 0 and p >= precision * (p + n)
        if not good_rule or (hit & left).sum() < least_covered:
            break
        rules.append(Rule(tuple((features[f], above, t) for f, above, t in tests)))
        left &= ~hit
    return rules


def labelled_statistics(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> list[tuple]:
    """(bad, features ...) of at most `rows` labelled texts: those whose id has the smallest hash.

    The sample's ids are at most `rows` rows, which bounds what is broadcast; of texts that repeat an id the one with
    the smallest hash counts, which bounds what comes to the driver.
    """
    require(labels, id_col, label_col)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    stats = with_statistics(chosen.withColumn("_hash", F.xxhash64("_text")), "_text").filter(~base_failed())
    each = stats.groupBy("_id").agg(F.min(F.struct("_hash", (F.col("_label") == 0).cast("int").alias("bad"), *FEATURES)).alias("_row"))
    return [tuple(r) for r in each.select("_row.bad", *(f"_row.{f}" for f in FEATURES)).collect()]


def apply_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """docs with statistics, base_failed, rule (number of the first rule that holds, else null) and kept.

    Repeated rows stay, an empty table stays empty, a null or empty text fails the base rule.
    """
    df = with_statistics(docs.drop("base_failed", "rule", "kept"), text_col).withColumn("base_failed", base_failed())
    chain = F.lit(None).cast("int")
    for k in reversed(range(len(rules))):
        chain = F.when(rules[k].column(), F.lit(k + 1)).otherwise(chain)
    return df.withColumn("rule", chain).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
