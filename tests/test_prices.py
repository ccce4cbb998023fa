"""List-price consensus and value families, on literal values and against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from offerloom.operators import groups, prices

CASES = [  # (what sources state, best price, the price told)
    ({"a": 209.99, "b": 209.99}, 157.40, (209.99, 1, "a+b")),
    ({"a": 189.99, "b": 190.50}, 140.0, (190.50, 1, "a+b")),  # within 1 %, the higher one
    ({"a": 100.0, "b": 101.5}, 80.0, None),  # 1.5 % apart
    ({"c": 143.95}, 120.0, None), ({"a": 159.95}, 120.0, None),  # alone and not trusted
    ({"c": 159.95, "a": 159.95}, 135.0, (159.95, 1, "a+c")),
    ({"b": 189.95}, 145.27, (189.95, 2, "b")), ({"b": 189.95}, 100.0, None), ({"b": 150.0}, 149.0, None),  # alone and trusted, within 1.03 to 1.5 times
    ({"a": 129.95, "b": 139.95, "c": 124.95}, 100.0, None), ({"a": 129.95, "b": 139.95}, 100.0, None),  # they disagree
    ({"a": 300.0, "b": 300.0}, 90.0, None),  # over three times the best price
    ({"a": 100.0, "b": 100.5, "c": 140.0}, 90.0, (100.5, 1, "a+b")),
    ({"a": None, "b": 0.0, "c": -5.0}, 90.0, None), ({"a": 100.0, "b": 100.0}, None, None), ({"a": 100.0, "b": 100.0}, 0.0, None),
    ({"a": 100.0, "b": 100.0, "z": 110.0}, 90.0, (100.0, 1, "a+b")), ({"b": 120.0, "z": 150.0}, 100.0, (120.0, 2, "b")),  # z is not heard
]


def test_consensus(spark):
    stated = spark.createDataFrame([(k, s, v) for k, (said, _, _) in enumerate(CASES) for s, v in said.items()], "id int, source string, list double").withColumn("members", F.lit("clash")).withColumn("tier", F.lit(9))
    best = spark.createDataFrame([(k, b) for k, (_, b, _) in enumerate(CASES)], "id int, best double")
    found = {r.id: (r.list, r.tier, r.sources) for r in prices.list_price_consensus(stated, best, ["id"], "source", "list", "best", sources=["a", "b", "c"], trusted=["b"]).collect()}
    assert found == {k: want for k, (_, _, want) in enumerate(CASES) if want}
    assert prices.list_price_consensus(stated.limit(0), best, ["id"], "source", "list", "best").count() == 0


@pytest.mark.parametrize("tolerance", [0.0, 0.01, 0.2])
def test_families_are_brute_force(spark, tolerance):
    r = random.Random(4)
    rows = [(r.choice([None, "x", "y"]), k % 4, r.choice([None, *range(90, 131)]) if k % 3 else 100) for k in range(600)]
    want = {}
    of = defaultdict(list)
    for a, b, v in rows:
        if v is not None:
            of[a, b].append(v)
    for key, values in of.items():
        families = [[y for y in values if abs(x - y) * 1000 <= round(tolerance * 1000) * max(x, y)] for x in values]
        n, top = max((len(f), max(f)) for f in families)
        want[key] = (n, top, min(min(f) for f in families if (len(f), max(f)) == (n, top)))
    found = groups.value_families(spark.createDataFrame(rows, "a string, b int, v long"), ["a", "b"], "v", tolerance).collect()
    assert {(x.a, x.b): (x.members, x.v, x.family_low) for x in found} == want and len(found) == len(want)
