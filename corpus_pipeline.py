"""The corpus pipeline over documents: quality classifier, quality rules, near-duplicates, packing.

Each stage works on all its predecessor kept and writes its verdict into effect: documents that the classifier or the
rules reject go, one document of each group of near-duplicates stays, and the rest is packed into sequences. All stages
but the last return the columns of documents.

Defined cases: a document's text decides, whatever its id. Null and empty texts fail the rules' least number of words.
A null doc_id is kept through all stages: rows without an id and with the same text are one document, others are
compared as any. Rows that repeat a doc_id are one document to near-dedup, which keeps the least of them by its row
as JSON; the classifier and the rules judge each by its own text. Of equal documents the least doc_id stays. A null id stands as a
number from 2^62 on to near-dedup, so ids must be below that. Other columns
are handed on, whatever their names. An empty table gives empty tables at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import table, written
from offerloom.llm.compress_quality import THRESHOLD, quality_scores
from offerloom.llm.line_rules import cleaned
from offerloom.llm.minhash import near_duplicates
from offerloom.llm.packing import pack
from offerloom.llm.subword import tokenizer_path


def _rows(docs: DataFrame, key: Column) -> DataFrame:
    """Each row as one value beside its key, so that no column of it can clash with ours."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose compression score, which is of the text alone, is under the threshold."""
    scores = quality_scores(docs, table(spark, sf_dir, "labels"), text_print=True)
    gone = written(scores.where(F.col("score") < THRESHOLD).select(F.col("text_print").alias("gone")).distinct(), "low-quality")
    rows = _rows(docs, F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.join(gone, F.expr("key = gone"), "left_anti").select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes boilerplate lines, and drops documents that fail the base rules or that those lines deplete."""
    return cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group of documents with similar five-word shingles (0.8)."""
    # a text without an id stands for itself, under a number of its own beyond all ids
    key = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62))
    found = near_duplicates(docs.select(key.alias("doc_id"), "text"), words=5, percent=80)
    gone = written(found.where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "duplicates")
    left = _rows(docs, key).join(gone, F.expr("key = gone"), "left_anti")
    again = written(left.groupBy("key").count().where("count > 1").select(F.col("key").alias("again")), "repeated-ids")
    if again.isEmpty():
        return left.select("row.*")
    # of rows that repeat an id, the least; only these are grouped
    once = left.join(again, F.expr("key = again"), "left_semi").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return left.join(again, F.expr("key = again"), "left_anti").select("row.*").union(once.select("row.*"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("packing", packing),
]

#: Compression, MinHash and the tokenizer are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
