"""Defined cases of the pipeline's stages: nulls, repeated rows, ids, clashing columns, empty tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, words=60):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("etaoinshrdlu"), r.integers(2, 9))) for _ in range(words))


ONE, TWO, THREE = prose(1), prose(2), prose(3)
ROWS = [(5, ONE), (3, ONE), (7, TWO), (7, TWO), (8, TWO + " tail"), (9, None), (10, ""), (None, THREE), (None, THREE), (None, ONE), (None, prose(4)), (11, " ".join([prose(6, 3000)] * 1))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", "s", 1) for d, t in ROWS], DOC).withColumn("row", F.lit("clash")).withColumn("score", F.lit(2)).withColumn("gone_id", F.lit(3))


def test_near_dedup(spark, docs):
    got = pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    assert kept == Counter({(3, ONE): 1, (7, TWO): 1, (9, None): 1, (10, ""): 1, (None, THREE): 1, (None, prose(4)): 1, (11, ROWS[-1][1]): 1})


def test_quality_classifier(spark, docs, tmp_path):
    spark.createDataFrame([(k, k % 2, 0) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good = [(k, prose(1000 + k), "en", "s", 1) for k in range(1, 300, 2)]
    bad = [(k, " ".join(w.upper() + "!!" for w in prose(2000 + k).split()), "en", "s", 1) for k in range(0, 300, 2)]
    more = [(None, prose(300), "en", "s", 1), (None, bad[1][1], "en", "s", 1), (1, bad[0][1], "en", "s", 1)]
    table = spark.createDataFrame(good + bad + more, DOC).withColumn("text_print", F.lit("clash"))
    got = pipeline.quality_classifier(spark, table, str(tmp_path))
    assert got.columns == table.columns
    kept = {(r.doc_id, r.text) for r in got.collect()}
    assert kept == {(d, t) for d, t, *_ in good} | {(None, prose(300))}


def test_rules_and_packing(spark, docs):
    got = pipeline.quality_rules(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((d, t) for d, t in ROWS if t)
    assert Counter(r.doc_id for r in pipeline.packing(spark, docs, "").where("start = 0").collect()) == Counter(d for d, _ in ROWS)


def test_empty_tables(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    none = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_stages_with_odd_columns(spark, docs):
    odd = docs.withColumn("meta.x", F.lit(1)).withColumn("tags", F.create_map(F.lit("k"), F.lit(1)))
    got = pipeline.near_dedup(spark, odd, "")
    assert got.columns == odd.columns and Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect())
    assert pipeline.quality_rules(spark, odd, "").columns == odd.columns
