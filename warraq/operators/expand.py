"""Query expansion: exact, prefix, stem, fuzzy and concept candidates, joined on the term dictionary.

queries: (query_id, q).  Every branch returns (query_id, term, quality, grp, seq): grp is the query token's
position or null for concepts, seq the order in which equal offers win.  Query tokens are few and are sent to the tasks
that scan the dictionary, which isn't shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warraq.functions import constants as C
from warraq.functions import text as T
from warraq.operators.components import cut_lineage, few

PREFIX_LIMIT, CONCEPT_PREFIX_LIMIT, FUZZY_LIMIT = 12, 4, 8


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, normalized, pos, token): stop words out, repeats kept, positions counted without stop words."""
    rows = queries.select("query_id", T.normalize_query("q").alias("normalized"))
    return few(rows.select("query_id", "normalized", F.posexplode(T.without_stops(T.tokens_of("normalized"))).alias("pos", "token")))


def exact(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    return tokens.join(terms.select(F.col("term")), F.col("token") == F.col("term")).select("query_id", "term", F.lit(1.0).alias("quality"), F.col("pos").alias("grp"), F.lit(0).alias("seq"))


def _first_with_prefix(tokens: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """The first terms in order that begin with the token: an equi-join on two letters, then the whole prefix.

    Tokens have two characters or more (or are one digit, joined by that digit).
    """
    head = lambda c: F.substring(c, 1, 2)
    keyed = terms.select("term", head("term").alias("k")).union(terms.filter(F.char_length("term") > 1).select("term", F.substring("term", 1, 1).alias("k")))
    found = tokens.withColumn("k", head("token")).join(keyed, "k").filter(F.col("term").startswith(F.col("token"))).drop("k")
    order = Window.partitionBy("query_id", "pos").orderBy("term")
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit)


def prefix(tokens: DataFrame, terms: DataFrame, limit: int = PREFIX_LIMIT) -> DataFrame:
    found = _first_with_prefix(tokens.filter(F.char_length("token") >= 2), terms, limit).filter("term <> token")
    quality = 0.80 * (F.char_length("token") / F.char_length("term"))
    return found.select("query_id", "term", quality.alias("quality"), F.col("pos").alias("grp"), F.lit(1).alias("seq"))


def stems(tokens: DataFrame, terms: DataFrame, stem_map: DataFrame) -> DataFrame:
    """The stem itself if it is a term (.72), and all terms of the stem's and of the token's own family (.70)."""
    own = tokens.withColumn("stem", T.stem_query("token"))
    itself = own.filter("stem <> token").join(terms.select("term"), F.col("stem") == F.col("term")).select("query_id", "term", F.lit(0.72).alias("quality"), F.col("pos").alias("grp"), F.lit(2).alias("seq"))
    keys = own.select("query_id", "pos", F.explode(F.array_distinct(F.array("stem", "token"))).alias("stem"))
    family = keys.join(stem_map, "stem").select("query_id", "term", F.lit(0.70).alias("quality"), F.col("pos").alias("grp"), F.lit(3).alias("seq"))
    return itself.union(family)


def fuzzy_matches(tokens: DataFrame, terms: DataFrame, limit: int | None = FUZZY_LIMIT, keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, pos, token, term, dist, kept columns of terms): distance 1 to the token's budget among terms with its first letter.

    Joined on first letter and length, so each token meets the terms of at most five lengths.
    """
    budget = T.fuzzy_budget(F.char_length("token"))
    keyed = tokens.withColumn("budget", budget).filter("budget > 0").select("*", F.substring("token", 1, 1).alias("c"), F.explode(F.sequence(F.char_length("token") - F.col("budget"), F.char_length("token") + F.col("budget"))).alias("len"))
    lexicon = terms.select("term", *keep, F.substring("term", 1, 1).alias("c"), F.char_length("term").alias("len"))
    found = keyed.filter("len >= 2").join(lexicon, ["c", "len"]).withColumn("dist", T.edit_distance(F.col("token"), F.col("term"))).filter("dist > 0 AND dist <= budget")
    if limit is None:
        return found.select("query_id", "pos", "token", "term", "dist", *keep)
    order = Window.partitionBy("query_id", "pos").orderBy("dist", "len", "term")
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).select("query_id", "pos", "token", "term", "dist", *keep)


def fuzzy(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    quality = 0.60 * (1 - F.col("dist") / F.greatest(F.lit(3), F.char_length("token")))
    return fuzzy_matches(tokens, terms).select("query_id", "term", quality.alias("quality"), F.col("pos").alias("grp"), F.lit(4).alias("seq"))


def concept_terms(queries: DataFrame, concepts: DataFrame) -> DataFrame:
    """(query_id, term, weight) of the concepts that the whole query or a word of it names.

    concepts: (id, term, kind), kind 'term' (weight .85) or 'related' (.45).  Names of several words count by
    word too, for words of three characters or more that aren't stop words.
    """
    rows = queries.select("query_id", T.normalize_query("q").alias("n")).filter("n <> ''")
    asked = rows.select("query_id", F.explode(F.array_distinct(F.concat(F.array("n"), F.split("n", " ")))).alias("key"))
    named = concepts.select("id", "kind", T.normalize_query("term").alias("n")).filter("n <> ''")
    words = F.split("n", " ")
    long_words = F.filter(words, lambda w: (F.char_length(w) > 2) & ~T.is_stop(w))
    keys = named.filter("kind = 'term'").select("id", F.explode(F.when(F.size(words) > 1, F.concat(F.array("n"), long_words)).otherwise(F.array("n"))).alias("key")).distinct()
    hit = asked.join(keys, "key").select("query_id", "id").distinct()
    weighted = named.select("id", F.when(F.col("kind") == "term", 0.85).otherwise(0.45).alias("weight"), F.explode(words).alias("term"))
    good = weighted.filter((F.char_length("term") >= 2) & ~T.is_stop(F.col("term")))
    return hit.join(good, "id").groupBy("query_id", "term").agg(F.max("weight").alias("weight"))


def concept_offers(queries: DataFrame, concepts: DataFrame, terms: DataFrame) -> DataFrame:
    found = few(cut_lineage(concept_terms(queries, concepts)))
    nobody = F.lit(None).cast("int")
    own = found.join(terms.select("term"), "term").select("query_id", "term", F.col("weight").alias("quality"), nobody.alias("grp"), F.lit(5).alias("seq"))
    strong = found.filter("weight >= 0.8").select("query_id", F.col("term").alias("token"), F.col("term").alias("pos"), "weight")
    near = _first_with_prefix(strong, terms, CONCEPT_PREFIX_LIMIT).select("query_id", "term", (F.col("weight") * 0.8).alias("quality"), nobody.alias("grp"), F.lit(6).alias("seq"))
    return own.union(near)


def merge(*branches: DataFrame) -> DataFrame:
    """(query_id, term, quality, grp, came): the best offer; equal offers go to the earlier token, then the earlier branch.

    came: the order in which terms first arrive, by token (concepts last), branch and term.
    """
    every = branches[0]
    for b in branches[1:]:
        every = every.union(b)
    order = Window.partitionBy("query_id", "term").orderBy(F.desc("quality"), F.col("grp").asc_nulls_last(), "seq")
    first = F.min(F.struct(F.coalesce("grp", F.lit((1 << 31) - 1)).alias("token"), "seq", "term")).over(Window.partitionBy("query_id", "term"))
    return every.withColumn("_n", F.row_number().over(order)).withColumn("came", first).filter("_n = 1").select("query_id", "term", "quality", "grp", "came")


def built_in_concepts(spark: SparkSession) -> DataFrame:
    """(id, term, kind) of the network of concepts that every archive starts with."""
    rows = [(name, word, kind) for name, named in C.CONCEPTS.items() for kind, words in zip(("term", "related"), named, strict=True) for word in words]
    return spark.createDataFrame(rows, "id string, term string, kind string")


def candidates(queries: DataFrame, terms: DataFrame, stem_map: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    tokens = query_tokens(queries)
    branches = [exact(tokens, terms), prefix(tokens, terms), stems(tokens, terms, stem_map), fuzzy(tokens, terms)]
    return merge(*branches, *([concept_offers(queries, concepts, terms)] if concepts is not None else []))
