"""The registered corpus queries against DuckDB, and the pipeline against a brute-force version."""

import glob
import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from offerloom import llm
from offerloom.llm.common import table
from offerloom.llm.compress_quality import quality_scores
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    answer = con.execute(llm.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    want = Counter(tuple(r) for r in answer.fetchall())
    assert Counter(tuple(r[c] for c in names) for r in llm.queries()[name](spark, SMALL).collect()) == want


def test_every_operator_is_registered():
    assert {int(k[2:].split("_")[0]) for k in llm.queries()} == set(range(1, 14))


def test_pipeline_is_its_stages_by_hand(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    docs = table(spark, SMALL, "documents")
    good = {r.doc_id for r in quality_scores(docs, table(spark, SMALL, "labels")).where("score >= 0.3").collect()}
    rows_of = docs.where(F.col("doc_id").isin(list(good))).orderBy("doc_id").collect()
    plain = {r.doc_id: [x for x in (" ".join(line.lower().split()) for line in (r.text or "").split("\n")) if x] for r in rows_of}
    sets = {(r.source, frozenset(plain[r.doc_id])) for r in rows_of if plain[r.doc_id]}
    hosts, lines = Counter(h for h, _ in sets), Counter((h, x) for h, lines_of in sets for x in lines_of)
    kept = {}
    for r in rows_of:
        words = (r.text or "").encode()
        split = words.split()
        count = Counter(tuple(split[k : k + 8]) for k in range(len(split) - 7))
        covered = {k + j for k in range(len(split) - 7) if count[tuple(split[k : k + 8])] > 1 for j in range(8)}
        gone = {x for x in plain[r.doc_id] if lines[r.source, x] > 5 and 100 * lines[r.source, x] > 2 * hosts[r.source]}
        removed = sum(len(x.split()) for x in plain[r.doc_id] if x in gone)
        if len(split) >= 20 and 100 * len(covered) <= 30 * len(split) and 100 * (len(split) - removed) >= 66 * len(split):
            low = "\n".join(x for x in plain[r.doc_id] if x not in gone).encode().lower().split()
            kept[r.doc_id] = {tuple(low[k : k + 5]) for k in range(len(low) - 4)}
    ids, group = sorted(kept), {i: i for i in kept}
    for a in ids:
        for b in ids:
            if b < a and 100 * len(kept[a] & kept[b]) >= 80 * len(kept[a] | kept[b]):
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert {r.doc_id for r in rows} == {i for i in ids if group[i] == i}
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024 and np.mean(list(filled.values())) > 900
