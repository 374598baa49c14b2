"""Language identification by rank-order profiles.

A profile is a list of n-grams (1 to 3 characters of a word padded by blanks) from the most to the least
frequent.  A text goes to the language whose profile is the least out of place against its own: the sum of
rank differences, with the profile's length for an n-gram that the language's profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from warraq.llm._common import require, short_batches
from warraq.operators.components import cut_lineage

PROFILE, TEXTS_PER_LANGUAGE, BROADCAST_LANGUAGES = 300, 400, 100_000
UNKNOWN = "und"
_BLANK, _BITS = 32, 21


@cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as integers in rising order, their counts) of the whole text; empty if it has no letter."""
    codes = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate(([_BLANK], np.where(letter, codes, _BLANK)[keep]))
    inner = c != _BLANK
    one = c[inner]
    two = (c[:-1] << _BITS) | c[1:]
    three = ((c[:-2] << 2 * _BITS) | (c[1:-1] << _BITS) | c[2:])[inner[1:-1]]
    found = [np.unique(x, return_counts=True) for x in (one, two, three)]
    return np.concatenate([g for g, _ in found]), np.concatenate([n for _, n in found])


def top_grams(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, ties by n-gram."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


@dataclass
class Profiles:
    """Languages in alphabetical order; grams: all n-grams of their profiles; ranks: [gram, language]."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int

    @classmethod
    def of(cls, ranked: dict[str, np.ndarray], size: int) -> Profiles:
        languages = sorted(ranked)
        grams = np.unique(np.concatenate([ranked[x] for x in languages])) if languages else np.empty(0, np.int64)
        ranks = np.full((len(grams), len(languages)), -1, dtype=np.int64)
        for k, x in enumerate(languages):
            ranks[np.searchsorted(grams, ranked[x]), k] = np.arange(len(ranked[x]))
        return cls(languages, grams, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, 1 - distance / greatest possible distance); ties go to the first in the alphabet."""
        own = top_grams(*gram_counts(text), self.size)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = np.where((self.grams[at] == own)[:, None], self.ranks[at], -1)
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return self.languages[best], float(1 - apart[best] / (self.size * len(own)))


def training_sample(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, per_language: int) -> DataFrame:
    """(lang, text) of at most per_language rows of each language: those whose id has the smallest hash.

    The number of rows of each language sets a cut of the hash, so that only about twice the sample is ranked, however
    many tasks there are.  The cuts, a row for each language, are broadcast up to a checked number of languages and
    joined by language beyond it.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col).alias("h"))
    share = F.lit(2.0 * per_language + 50) / F.col("n")
    cut = F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise((share * float(1 << 64) - float(1 << 63)).cast("long"))
    cuts = cut_lineage(rows.groupBy("lang").agg(F.count("*").alias("n")).select("lang", cut.alias("cut")))
    near = F.broadcast(cuts) if cuts.count() <= BROADCAST_LANGUAGES else cuts
    picked = rows.join(near, "lang").filter(F.col("h") <= F.col("cut"))
    order = Window.partitionBy("lang").orderBy("h", "text")  # rows that repeat an id have one hash
    return picked.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= per_language).select("lang", "text")


def learn_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", size: int = PROFILE, per_language: int = TEXTS_PER_LANGUAGE) -> Profiles:
    """Profiles from a bounded sample (per_language whole texts of each language) of the labelled rows."""
    require(labelled, text_col, lang_col, id_col)

    def count(frames):
        import pandas as pd

        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                found = [gram_counts(t) for t in texts]
                grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                yield pd.DataFrame({"lang": lang, "gram": grams, "n": np.bincount(at, np.concatenate([n for _, n in found]), len(grams)).astype(np.int64)})

    grams = training_sample(labelled, text_col, lang_col, id_col, per_language).mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked: dict[str, list] = {}
    for r in grams.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).orderBy("lang", "rank").collect():
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles.of({k: np.array(v, dtype=np.int64) for k, v in ranked.items()}, size)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1), from the whole text alone.

    `und` and 0 for a null text, a text without a letter, or if no language was learned; a word repeated
    any number of times or a very long text needs no more than a few arrays of its length; columns already
    named lang_pred or score are replaced; an empty table stays empty.
    """
    require(docs, text_col)
    rest = short_batches(docs).drop("lang_pred", "score")
    shape = "struct<lang_pred:string,score:double>"

    @F.pandas_udf(shape)
    def predict(texts):
        import pandas as pd

        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])

    return rest.withColumn("_lang", predict(F.col(text_col))).select(*rest.columns, "_lang.lang_pred", "_lang.score")


def identify_digest(docs: DataFrame, profiles: Profiles, keep: list, text_col: str = "text") -> DataFrame:
    """The given columns, lang_pred and score; texts stay in the Python worker."""
    head = short_batches(docs).select(*keep, F.col(text_col).alias("_text"))
    names = head.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t.as_py()) for t in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head.schema.fields[:-1])
    return head.mapInArrow(run, f"{schema}, lang_pred string, score double")
