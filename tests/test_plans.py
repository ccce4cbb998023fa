"""Every plan of the catalogue against its oracle on the smallest tables."""

import datetime
import glob
import os
from collections import Counter

import duckdb
import pytest

from offerloom import plans
from tests.conftest import SMALL

QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        found.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return found


def plain(x):
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if isinstance(x, datetime.datetime) and x.time() == datetime.time():
        return x.date()
    return x


def test_every_plan_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys() and len(QUERIES) > 200


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, con, name):
    answer = con.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    want = Counter(tuple(map(plain, r)) for r in answer.fetchall())
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(plain(r[c]) for c in names) for r in df.collect()) == want
