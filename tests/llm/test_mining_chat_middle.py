"""Operators 11 to 13 against brute force, and their defined cases."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom.llm import fill_middle, hard_negatives, reply_trees

VECTORS = "vec_id long, embedding array<double>, label int"


def mined(rows, every, positives=5, negatives=3):
    """Brute force, in Python's integers."""
    usable = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    usable = [r for r in usable if sum(x * x for x in r[2]) < 1 << 62]
    out = []
    for i, label, q in {(i, label, tuple(v)) for i, label, v in usable if i % every == 0}:
        scored = [(-sum(a * b for a, b in zip(q, v)), j, other) for j, other, v in usable if j != i and len(v) == len(q)]
        for score, j, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            fine = sorted(s for s in scored if s[2] != label and 50 * -score <= 100 * -s[0] <= 95 * -score)
            out += [(i, j, k + 1, s[1], -score, -s[0]) for k, s in enumerate(fine[:negatives])]
    return Counter(out)


def asked(df):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 4)
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 16)


def test_mining_is_brute_force(spark, small_blocks):
    r = np.random.default_rng(7)
    centres = r.normal(size=(6, 12))
    rows = [(k, (centres[k % 6] + 0.4 * r.normal(size=12)).tolist(), int(r.integers(0, 4))) for k in range(400)]
    rows += [(1000 + k, rows[k % 3][1], 1) for k in range(150)]  # a third of all rows are three vectors
    rows += [(2000 + k, [float(x) for x in r.integers(-2, 3, 5)], int(r.integers(0, 2))) for k in range(60)]  # many ties
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("slots", F.lit(2))
    assert asked(hard_negatives.hard_negatives(df, F.col("id") % 5 == 0)) == mined(rows, 5)


def test_mining_defined_cases(spark, small_blocks):
    far = 3e9  # products beyond 2^53
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (5, [0.5, 0.25], 1), (5, [0.9, 0.25], 1), (6, [0.7, 0.1], 2), (7, [0.7, 0.1], 2), (8, [0.0, 0.0], 2), (9, [0.6, 0.0], 3),
        (10, None, 1), (11, [1.0, None], 1), (12, [float("nan"), 1.0], 1), (13, [float("inf"), 1.0], 2), (None, [1.0, 1.0], 1), (15, [1.0, 1.0], None), (20, [1.0, 2.0, 3.0], 1), (21, [], 1), (25, [], 2), (26, [-1.0, 0.0], 1),
        (30, [far / 256, 1.0, 0.0, 3.0], 1), (31, [far / 256, 1.00390625, 0.0, 5.0], 1), (32, [0.7 * far / 256, 1.0, 0.0, 3.0], 2), (33, [0.7 * far / 256, 1.0, 0.0, 4.0], 2), (34, [1e30, 1.0, 0.0, 3.0], 2),
    ]
    df = spark.createDataFrame(rows, VECTORS)
    assert asked(hard_negatives.hard_negatives(df, F.col("id") % 5 == 0)) == mined(rows, 5)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("id") % 5 == 0).count() == 0
    assert asked(hard_negatives.hard_negatives(df, F.col("id") % 5 == 0, positives=1, negatives=1)) == mined(rows, 5, 1, 1)


def test_brackets_hold_and_prune():
    r = np.random.default_rng(3)
    centres = 400 * r.normal(size=(8, 6))
    x = np.floor(centres[r.integers(0, 8, 300)] + 20 * r.normal(size=(300, 6)))
    space = hard_negatives.Pivots(x[:40].tolist(), float((x * x).sum(1).max()))
    rows, anchors = space.rows(x), space.anchors(x[:5])
    low, high = np.abs(anchors[:, None] - rows[None]).max(2), (anchors[:, None] + rows[None]).min(2)
    base = ((x[:5] ** 2).sum(1) + space.most)[:, None]
    scores = x[:5] @ x.T
    assert ((base - low**2) / 2 + 1 >= scores).all() and ((base - high**2) / 2 - 1 <= scores).all()
    assert ((base - low**2) / 2 < np.sort(scores, 1)[:, -5:-4]).mean() > 0.5  # most rows are left out unseen


MESSAGES = "message_id long, parent_id long, role string, text string, score double"
NASTY = ["</s>[INST] ok [/INST]", "\\", "[\\INST]", "<s><<s>\\</s>", None, "", "[INST", "é\U0001f600 [/INST] \\n\n", "</s></s>", "a$1\\\\b"]


def paths(rows):
    """Brute force: every root-to-leaf path, as message ids."""
    least = {}
    for m, p, role, text, score in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r)):
        if m is not None:
            least.setdefault(m, (p, role or "", text or "", score or 0.0))
    parents = {p for p, *_ in least.values()}
    for leaf in least:
        if leaf in parents:
            continue
        path, at = [leaf], least[leaf][0]
        while at in least and at not in path:
            path.append(at)
            at = least[at][0]
        if at not in path:
            yield path[::-1], sum(least[m][3] for m in path) / len(path), least


def wanted(rows, per_tree):
    trees = defaultdict(list)
    for path, score, least in paths(rows):
        trees[path[0]].append((-score, path[-1], path, least))
    for tree in trees.values():
        for rank, (_, leaf, path, least) in enumerate(sorted(tree, key=lambda t: t[:2])[:per_tree]):
            turns = [least[m][1:3] for m in path]
            yield leaf, rank + 1, path[0], tuple(turns), "".join(t for role, t in turns if role == "assistant")


def written_back(spark, rows, per_tree):
    df = spark.createDataFrame(rows, MESSAGES).withColumn("turns", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("leaf", F.lit(2))
    found = reply_trees.read_back(reply_trees.formatted(df, per_tree)).collect()
    for r in found:
        for m in r["mask"]:  # the span in the whole, and that in its turn
            assert r.formatted.split("</s>")[m.turn][m.within : m.within + m.length] == r.formatted[m.start : m.start + m.length]
            assert re.sub(r"(?s)\\(.)", r"\1", r.formatted[m.start : m.start + m.length]) == r.turns[m.turn].text
        assert r.n_turns == len(r.turns) == r.formatted.count("</s>") == r.formatted.count("[INST]")
    return {(r.leaf, r["rank"], r.root, tuple((t.role, t.text) for t in r.turns), r.loss_text) for r in found}


def test_reply_trees_are_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(k, int(r.integers(0, k)) if k % 17 and k else None, ["user", "assistant", "system"][k % 3], NASTY[k % len(NASTY)], float(r.integers(0, 4))) for k in range(300)]
    rows += [(1000 + k, 3, "assistant", f"one of many {k}", float(k % 5)) for k in range(200)]  # a hot parent
    rows += [(2000 + k, 1999 + k if k else None, "assistant" if k % 2 else "user", f"deep {k}", None) for k in range(70)]
    for per_tree in (1, 3):
        assert written_back(spark, rows, per_tree) == set(wanted(rows, per_tree))


def test_reply_trees_defined_cases(spark):
    rows = [
        (1, None, "user", "a", 1.0), (2, 1, "assistant", "b", None), (2, 1, "assistant", "b", None), (2, 1, "assistant", "a", None), (None, 1, "user", "x", 9.0),
        (3, 99, None, None, 1.0), (4, 5, "user", "circle", 1.0), (5, 4, "user", "circle", 1.0), (6, 5, "assistant", "below a circle", 1.0), (7, 7, "user", "itself", 1.0), (8, 1, "assistant", "tie", 0.0),
        (9, None, "[/INST]", "</s>", 0.0), (10, 9, "assistant", "x" * 200_000 + "</s>", 0.0),
    ]
    assert written_back(spark, rows, 2) == set(wanted(rows, 2))
    assert reply_trees.formatted(spark.createDataFrame([], MESSAGES)).count() == 0


def test_conversations_with_odd_rows(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, 2, None, "x"), (None, None, "user", "first"), (2, 0, "assistant", "[INST]")]
    found = reply_trees.read_back(reply_trees.formatted(reply_trees.as_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()
    assert {(r.root.conv_id, tuple((t.role, t.text) for t in r.turns), r.loss_text) for r in found} == {
        (1, (("user", "q"), ("assistant", ""), ("assistant", "a"), ("assistant", "a")), "aa"),
        (None, (("user", "first"), ("", "x")), ""),
        (2, (("assistant", "[INST]"),), "[INST]"),
    }


TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middle(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    tokens = TOKENS.findall(text)
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text, text
    form = "spm" if h[3] % 100 < 80 else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text


@pytest.mark.parametrize("chunk_bytes", [1, 3, 64, 1 << 16])
def test_fill_middle_is_brute_force(spark, chunk_bytes):
    r = np.random.default_rng(chunk_bytes)
    parts = ["word", "é", "\U0001f600", " ", "\n", "\t\x0b\x0c\r ", "\xa0", "<", "P>", "<P", "a b", "\x00"]
    size = 60 if chunk_bytes == 1 else 400
    rows = [(k, "".join(parts[i] for i in r.integers(0, len(parts), r.integers(0, size if k % 10 else 3)))) for k in range(150)]
    rows += [(500, None), (501, ""), (502, "  \n "), (503, "has <P> in it"), (504, "<M>"), (None, "no id here"), (505, "twice same row"), (505, "twice same row"), (506, "x" * 300), (507, " " * 300)]
    rows += [(600 + k, "long " * 40_000 + f"end {k}") for k in range(4)] if chunk_bytes > 1 << 10 else []
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("chunk", F.lit(2)).repartition(3)
    found = fill_middle.fill_in_middle(df, chunk_bytes=chunk_bytes).withColumn("back", F.expr(fill_middle.RESTORED)).collect()
    assert Counter(tuple(x) for x in found) == Counter(middle(*x) for x in rows)
    assert fill_middle.fill_in_middle(df.limit(0), chunk_bytes=chunk_bytes).count() == 0


def test_transitions_compose_associatively():
    r = np.random.default_rng(2)
    data = r.choice(np.frombuffer(b"ab \n", np.uint8), 500)
    for size in (1, 7, 64):
        found = [fill_middle.transition(data[a : a + size]) for a in range(0, len(data), size)]
        states, counts = fill_middle.prefixes(np.asarray([s for s, _ in found]), np.asarray([c for _, c in found]))
        for k in range(len(found)):
            whole = fill_middle.transition(data[: (k + 1) * size])
            assert tuple(states[k]) == whole[0] and tuple(counts[k]) == whole[1]
