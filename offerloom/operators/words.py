"""Indexes of words, so that typed words meet only what they may mean: near words, trigrams, prefixes. DataFrame functions only.

None of these joins forms pairs beyond the candidates: each side gives the keys that any match must share, sides meet by
equality of keys, and the rule itself is confirmed on what has met.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions import text as t
from offerloom.operators.tables import written


def deletions(word: Column) -> Column:
    """A word and the word less each one of its letters: two words share one of these if they are one edit or one swap apart."""
    less = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.when(F.length(word) > 0, F.array_distinct(F.concat(F.array(word), less))).otherwise(F.array(word))


def near_words(typed: DataFrame, known: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b): pairs of distinct words at a Damerau-Levenshtein distance of one at most. Nulls match nothing; the empty word is near to any single letter."""
    left, right = (df.select(F.col(c).alias("w")).where(F.col(c).isNotNull()).distinct().select("w", F.explode(deletions(F.col("w"))).alias("key")) for df, c in ((typed, a), (known, b)))
    met = left.select("key", F.col("w").alias("x")).join(right.select("key", F.col("w").alias("y")), "key").select("x", "y").distinct()
    # the empty word has no neighbours to swap, and a sequence over them would run backwards
    near = F.when((F.length("x") < 2) | (F.length("y") < 2), F.levenshtein("x", "y") <= 1).otherwise(F.expr(t.near_word("x", "y")))
    return met.where(near).select(F.col("x").alias(a), F.col("y").alias(b))


def trigram_index(titles: DataFrame, key: str, text: str) -> DataFrame:
    """(trigram, key): a row for each distinct trigram of a title's words; written once, in order of trigrams, so that a look at a few of them reads little."""
    rows = titles.select(key, F.explode(F.array_distinct(F.flatten(F.transform(F.split(text, " "), lambda w: _trigrams(w))))).alias("trigram"))
    return written(rows.repartitionByRange("trigram", key).sortWithinPartitions("trigram", key), "trigrams")


def _trigrams(word: Column) -> Column:
    padded = F.concat(F.lit("  "), word, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_search(typed: DataFrame, index: DataFrame, titles: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """(query, key, similarity): titles in which every word of a query is found, by the sum of their strict word similarities.

    typed: (query, word), a word in its normal form; titles: (key, text in its normal form). A word is found where its
    similarity with a run of whole words is over least. A run that is so like a word of n trigrams shares more than
    least * n of them, so its title holds one of the word's rarest n - floor(least * n): only these postings are read."""
    pieces = typed.where("word <> ''").distinct().withColumn("own", _trigrams(F.col("word")))
    each = pieces.select("query", "word", F.size("own").alias("n"), F.explode("own").alias("trigram"))
    wanted = each.select("trigram").distinct()
    often = index.join(wanted, "trigram", "left_semi").groupBy("trigram").agg(F.count("*").alias("titles"))
    ranked = each.join(often, "trigram", "left").selectExpr("query", "word", "n", "trigram", "row_number() over (partition by query, word order by coalesce(titles, 0), trigram) as place")
    keys = ranked.where(F.col("place") <= F.col("n") - F.floor(F.lit(least) * F.col("n"))).select("query", "word", "trigram")
    words = typed.where("word <> ''").distinct().groupBy("query").agg(F.count("*").alias("words"))
    met = keys.join(index, "trigram").select("query", "word", key).distinct()
    whole = met.groupBy("query", key).agg(F.count("*").alias("found")).join(words, "query").where("found = words").select("query", key)
    survivors = whole.join(titles.select(key, F.col(text).alias("title")), key).join(pieces.select("query", "word"), "query")
    alike = survivors.select("query", key, F.expr(t.strict_word_similarity("word", "title")).alias("s"))
    summed = alike.groupBy("query", key).agg(F.min("s").alias("worst"), F.sort_array(F.collect_list("s")).alias("all"))
    return summed.where(F.col("worst") > least).select("query", key, F.aggregate("all", F.lit(0.0), lambda a, s: a + s).alias("similarity"))


def prefix_counts(left: DataFrame, right: DataFrame, by: Sequence[str], key: str, of: str, longer_only: bool = False) -> DataFrame:
    """left's rows that have partners, with their number (partners) and the least and greatest of among them (first_partner, last_partner).

    Partners of a row are the right rows with equal by's columns whose key begins with its own or, but for longer_only, is a
    prefix of it. They are counted for each key and then for each prefix, so no pairs are formed, and a prefix that a third
    of all keys share is one row. Prefixes are cut at the lengths that the other side's keys have. Null keys have no
    partners; keys may be of any length, also empty."""
    by = list(by)
    own = written(left.where(F.col(key).isNotNull()).select(*by, key).distinct(), "own-keys")
    theirs = written(right.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count("*").alias("n"), F.min(of).alias("lo"), F.max(of).alias("hi")), "their-keys")
    whole = (F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def cut(df: DataFrame, other: DataFrame, proper: bool) -> DataFrame:
        lengths = other.agg(F.array_sort(F.collect_set(F.length(key))).alias("lengths"))  # one row
        fits = (lambda n: n < F.length(key)) if proper else (lambda n: n <= F.length(key))
        return df.crossJoin(lengths).withColumn("prefix", F.explode(F.transform(F.filter("lengths", fits), lambda n: F.substring(key, F.lit(1), n)))).drop("lengths")

    # right keys that begin with a left key, by prefix; and left keys that go on from a right key
    found = own.join(cut(theirs, own, False).groupBy(*by, "prefix").agg(*whole).withColumnRenamed("prefix", key), [*by, key])
    if not longer_only:
        found = found.unionByName(cut(own, theirs, True).join(theirs.withColumnRenamed(key, "prefix"), [*by, "prefix"]).drop("prefix"))
    summed = found.groupBy(*by, key).agg(*whole).withColumnsRenamed({"n": "partners", "lo": "first_partner", "hi": "last_partner"})
    return left.join(summed, [*by, key])
