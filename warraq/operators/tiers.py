"""Tiered candidate patterns: how strong a signal a text gives before anything is extracted from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.functions import constants as C
from warraq.functions import text as T


@dataclass(frozen=True)
class Patterns:
    lineage: str = C.TIER_LINEAGE
    context: str = C.TIER_CONTEXT
    subtribes: str = C.TIER_SUBTRIBES
    nisba: str = C.TIER_NISBA
    geo: str = C.TIER_GEO


def classify_candidates(df: DataFrame, text_col: str = "text", patterns: Patterns | None = None) -> DataFrame:
    """df with tier, matched_terms and matched_geo: lineage with context, else a sub-tribe, else nisba with geography.

    The first tier keeps repeats of its matches in order; the others give each match once, sorted.
    """
    p, value = patterns or Patterns(), T.text(text_col)
    all_of = lambda pattern: F.regexp_extract_all(value, F.lit(pattern), F.lit(0))
    once = lambda pattern: F.array_sort(F.array_distinct(all_of(pattern)))
    first = value.rlike(p.lineage) & value.rlike(p.context)
    second = value.rlike(p.subtribes)
    third = value.rlike(p.nisba) & value.rlike(p.geo)
    nothing = F.array().cast("array<string>")
    names = [F.lit(n) for n in C.TIER_NAMES]
    return df.withColumns({
        "tier": F.when(first, names[0]).when(second, names[1]).when(third, names[2]).otherwise(names[3]),
        "matched_terms": F.when(first, all_of(p.lineage)).when(second, once(p.subtribes)).when(third, once(p.nisba)).otherwise(nothing),
        "matched_geo": F.when(~first & ~second & third, once(p.geo)).otherwise(nothing),
    })
