"""Which texts hold which passages, by anchors: hashed windows of words that any text with the passage must have.

A passage may begin and end within a word of the text, so only its inner words stand as whole words in it. Of a passage
with at least WINDOW inner words every window of so many is looked up among the texts' windows; the rarest of them leads
to the candidates, and one that no text has rules the passage out. A shorter passage is led by its longest word: the
texts' distinct words that hold it are found by equality with their substrings of that length. Candidates are confirmed
by a search for the whole passage. Nothing compares each text with each passage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.operators.tables import written

WINDOW = 5


def _windows(hashes: Column, size: int) -> Column:
    """Hashes of all runs of so many words, from the words' hashes."""
    run = lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(size)))
    return F.when(F.size(hashes) >= size, F.transform(F.sequence(F.lit(0), F.size(hashes) - size), run)).otherwise(F.array().cast("array<bigint>"))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def cited(texts: DataFrame, passages: DataFrame, text_id: str, passage_id: str, text: str, passage: str, window: int = WINDOW) -> DataFrame:
    """(text_id, passage_id) of each text that holds a passage; both in their normal form, words parted by single spaces.

    Null texts and passages match nothing, nor does an empty passage. Rows that repeat an id are one where they match."""
    said = texts.select(F.col(text_id).alias("t"), F.col(text).alias("said")).where("said <> ''").withColumn("words", F.split("said", " "))
    given = passages.select(F.col(passage_id).alias("p"), F.col(passage).alias("cited")).where("cited <> ''").withColumn("w", F.split("cited", " "))
    # rows are told apart by what they say, as ids may repeat
    said, given = said.withColumn("tk", F.xxhash64("said")), given.withColumn("pk", F.xxhash64("cited"))
    said, given = written(said, "texts"), written(given, "passages")  # their normal forms are worked out once
    inner = F.slice("w", F.lit(2), F.size("w") - 2)
    long, short = given.where(F.size("w") >= window + 2), given.where(F.size("w") < window + 2)

    anchors = long.select("pk", _hashed(inner).alias("h")).select("pk", F.explode(_windows(F.col("h"), window)).alias("anchor")).distinct()
    each = said.select("tk", _hashed(F.col("words")).alias("h")).select("tk", F.explode(F.array_distinct(_windows(F.col("h"), window))).alias("anchor"))
    hits = written(each.join(anchors.select("anchor").distinct(), "anchor", "left_semi").distinct(), "anchor-hits")
    often = hits.groupBy("anchor").agg(F.count("*").alias("texts"))
    rarest = anchors.join(often, "anchor", "left").groupBy("pk").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "anchor")).alias("r")).where("r.texts > 0").select("pk", "r.anchor")
    by_window = rarest.join(hits, "anchor").select("pk", "tk")

    led = short.select("pk", F.reduce("w", F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a)).alias("lead")).distinct()
    lengths = led.agg(F.collect_set(F.length("lead")).alias("lengths"))  # one row
    vocabulary = said.select(F.explode("words").alias("word")).distinct().crossJoin(lengths)
    parts = vocabulary.select("word", F.explode(F.array_distinct(F.flatten(F.transform("lengths", lambda n: F.when(n <= F.length("word"), F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.substring("word", i, n))).otherwise(F.array().cast("array<string>")))))).alias("lead"))
    holding = parts.join(led, "lead").select("pk", "word").distinct()
    by_word = said.select("tk", F.explode(F.array_distinct("words")).alias("word")).join(holding, "word").select("pk", "tk")

    met = by_window.union(by_word).distinct()
    full = met.join(given.select("pk", "p", "cited"), "pk").join(said.select("tk", "t", "said"), "tk")
    return full.where(F.contains("said", "cited")).select(F.col("t").alias(text_id), F.col("p").alias(passage_id)).distinct()
