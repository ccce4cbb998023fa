"""Indexes of words and passages against the comparison of all with all, and their defined cases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from offerloom.functions import text as t
from offerloom.operators import groups, passages, words


def near(a, b):
    """Damerau-Levenshtein distance of one at most, by trying every edit of a."""
    letters = set(a + b)
    cuts = [(a[:k], a[k:]) for k in range(len(a) + 1)]
    made = {a, *(x + y[1:] for x, y in cuts if y), *(x + y[1] + y[0] + y[2:] for x, y in cuts if len(y) > 1), *(x + c + y[1:] for x, y in cuts if y for c in letters), *(x + c + y for x, y in cuts for c in letters)}
    return b in made


def test_near_words_are_all_pairs(spark):
    r = random.Random(3)
    some = ["", "a", "b", "ab", "ba", "abc", "acb", "é", "ée", *("".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(150))]
    known = ["", "a", *("".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(150))]
    got = words.near_words(spark.createDataFrame([(w,) for w in [*some, None, some[5]]], "q string"), spark.createDataFrame([(w,) for w in [*known, None]], "w string"), "q", "w")
    assert Counter((x.q, x.w) for x in got.collect()) == Counter((a, b) for a in set(some) for b in set(known) if near(a, b))


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8])
def test_trigram_search_is_the_full_scan(spark, least):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdr") for _ in range(r.randint(1, 7))) for _ in range(60)]
    titles = [(k, " ".join(r.choices(vocabulary, k=r.randint(0, 5)))) for k in range(300)] + [(900, ""), (901, vocabulary[0])]
    typed = [(q, w) for q in range(12) for w in {r.choice(vocabulary)[: r.randint(1, 6)] for _ in range(r.randint(1, 2))}] + [(50, "zzzz"), (51, "")]
    df, asked = spark.createDataFrame(titles, "id int, title string"), spark.createDataFrame(typed, "query int, word string")
    got = {(x.query, x.id): round(x.similarity, 9) for x in words.trigram_search(asked, words.trigram_index(df, "id", "title"), df, "id", "title", least).collect()}
    pairs = asked.where("word <> ''").crossJoin(df).select("query", "id", "word", F.expr(t.strict_word_similarity("word", "title")).alias("s")).collect()
    want, worst, many = Counter(), {}, Counter(q for q, w in typed if w)
    for x in pairs:
        want[x.query, x.id] += x.s
        worst[x.query, x.id] = min(worst.get((x.query, x.id), 1), x.s)
    assert got == {k: round(v, 9) for k, v in want.items() if worst[k] > least} and many


def test_prefix_counts_are_the_nested_loop(spark):
    r = random.Random(1)
    key = lambda: "".join(r.choice("ab") for _ in range(r.randint(0, 5)))
    left = [(k, r.choice("xy"), key()) for k in range(80)] + [(k, "x", "a") for k in range(100, 150)] + [(200, "x", None)]
    right = [(k, r.choice("xyz"), key()) for k in range(120)] + [(k, "x", "aab") for k in range(300, 400)] + [(500, "x", None), (501, None, "a")]
    got = words.prefix_counts(spark.createDataFrame(left, "id int, g string, k string"), spark.createDataFrame(right, "of int, g string, k string"), ["g"], "k", "of").collect()
    want = {}
    for i, g, k in left:
        met = [o for o, h, m in right if k is not None and m is not None and g == h and (m.startswith(k) or k.startswith(m))]
        if met:
            want[i] = (len(met), min(met), max(met))
    assert {x.id: (x.partners, x.first_partner, x.last_partner) for x in got} == want and len(got) == len(want)


def test_mutually_only(spark):
    r = random.Random(2)
    left = [(k, r.choice("gh"), float(r.randint(1, 60))) for k in range(40)] + [(90, "i", 10.0), (91, "j", None), (92, "k", 0.0)]
    right = [(k, r.choice("gh"), float(r.randint(1, 60))) for k in range(40)] + [(90, "i", 15.0), (91, "j", 1.0), (92, "k", 0.0)]
    fits = [(a, b) for a, g, v in left for b, h, w in right if g == h and v and w and max(v, w) <= 1.5 * min(v, w)]
    many_a, many_b = Counter(a for a, _ in fits), Counter(b for _, b in fits)
    got = groups.mutually_only(spark.createDataFrame(left, "a int, g string, v double"), spark.createDataFrame(right, "b int, g string, v double"), ["g"], "a", "b", "v", 1.5)
    assert {(x.a, x.b) for x in got.collect()} == {(a, b) for a, b in fits if many_a[a] == many_b[b] == 1} >= {(90, 90)}


def test_cited_is_all_pairs_and_has_no_nested_loop(spark):
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(25)]
    texts = [(k, " ".join(r.choices(vocabulary, k=r.randint(0, 60)))) for k in range(80)] + [(200, None), (201, ""), (5, "a repeated id")]
    taken = [(r.choice(texts[:80])[1], r.randint(1, 40)) for _ in range(60)]
    given = [(k, text[(at := r.randint(0, max(0, len(text) - n))) : at + n].strip()) for k, (text, n) in enumerate(taken)]
    given += [(100, None), (101, ""), (102, "not there at all in any of them"), (103, "a"), (104, " ".join(vocabulary[:9])), (0, "repeated")]
    df, ps = spark.createDataFrame(texts, "doc int, said string").withColumn("pk", F.lit("clash")), spark.createDataFrame(given, "item int, passage string").withColumn("tk", F.lit("clash"))
    for window in (1, 3, 5):
        got = passages.cited(df, ps, "doc", "item", "said", "passage", window)
        assert Counter((x.doc, x.item) for x in got.collect()) == Counter({(d, p) for d, a in texts for p, b in given if a and b and b in a})
    plan = passages.cited(df, ps, "doc", "item", "said", "passage")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert plan.count("NestedLoop") == 1 and "CartesianProduct" not in plan  # the one row of lengths
    assert passages.cited(df.limit(0), ps, "doc", "item", "said", "passage").count() == 0
