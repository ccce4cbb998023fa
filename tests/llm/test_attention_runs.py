"""What op9's model learns from: all training text, the ends of texts, and nothing that depends on order or partitions."""

import numpy as np
import pytest

from offerloom.llm import attention_lm as lm
from offerloom.llm.subword import tokenizer_path
from offerloom.llm.word_blocks import squeeze

BYTES, END = "byte_bpe_50k.json", 50256


def test_ids_met_in_windows_are_of_all_texts():
    r = np.random.default_rng(1)
    lengths, column = np.asarray([1, 32, 33, 100]), lm.frequent(r.integers(1, 1000, 300))
    flat = r.integers(0, 300, lengths.sum())
    met = np.zeros((300, lm.SINGLE), np.int64)
    lm.add_met(met, flat, lengths, column)
    want = np.zeros_like(met)
    for text in np.split(flat, np.cumsum(lengths)[:-1]):
        for at in range(0, len(text), lm.WIDTH):
            window = text[at : at + lm.WIDTH]
            for i in window:
                for j in window:
                    if column[j] >= 0:
                        want[i, column[j]] += 1
    assert (met == want).all()


def test_runs_reach_the_end_and_score_as_the_text_does():
    r = np.random.default_rng(2)
    classes = r.integers(2, lm.CLASSES, 500).astype(np.uint8)
    model = lm.Attention()
    model.starts = np.ones(lm.CLASSES, np.float32)
    for words in (1, 20, 64, 65, 300):
        sizes = np.append(r.integers(1, 4, words), 1)
        heads = np.cumsum(sizes) - sizes
        flat = r.integers(0, 500, sizes.sum())
        whole, seen = lm.score_tokens(model, classes[flat].astype(np.int64), np.asarray([len(flat)])), np.zeros(len(flat), int)
        for one in range(0, words + 1, lm.RUN_WORDS):
            two = min(words + 1, one + lm.RUN_WORDS)
            before, ids, place = lm.cut_run(flat, heads, one, two - 1)
            mine = lm.score_tokens(model, classes[ids].astype(np.int64), np.asarray([len(ids)]), first=classes[before] if before >= 0 else 0)
            at = heads[one]
            assert np.allclose(mine[:, place:], whole[:, at : at + len(ids) - place], atol=1e-4)
            seen[at : heads[two - 1] + sizes[two - 1]] += 1
            x, y, valid = lm.run_windows([(before, ids)], classes)
            assert x[0, 0] == (classes[before] if before >= 0 else 0) and (x[:, 1:][valid[:, 1:]] == y[:, :-1][valid[:, 1:]]).all()
            if two == words + 1:
                assert y[-1][valid[-1]][-1] == classes[flat[-1]]  # the end is a target
        assert (seen == 1).all()


def texts(n):
    r = np.random.default_rng(3)
    return [(i, " ".join(r.choice([f"w{k}" for k in range(40 * (1 + i % 3))], 150)) + f" rare{i}") for i in range(1, n)]


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(texts(120), "doc_id long, text string")
    one, six = ({r.doc_id: r.score for r in lm.lm_scores(d, tokenizer_path(BYTES), END).collect()} for d in (docs.coalesce(1), docs.orderBy("text").repartition(6)))
    assert one.keys() == six.keys() and all(one[k] == pytest.approx(six[k], rel=1e-6) for k in one)


def test_more_runs_than_a_slice_are_fitted_in_executors(spark):
    r = np.random.default_rng(4)
    classes = np.append(r.integers(2, lm.CLASSES, 400), 1).astype(np.uint8)
    rows = [(k, np.asarray([-1, 0], "<i8").tobytes(), np.append(np.full(40, r.integers(0, 400)), 400).astype("<u4").tobytes()) for k in range(300)]
    runs = spark.createDataFrame(rows, "key long, at binary, ids binary")
    few, all_of = lm.fitted(runs.where("key % 3 = 0"), classes, 1), lm.fitted(runs, classes, 3)
    x, y, valid = lm.run_windows([(-1, np.frombuffer(i, "<u4").astype(np.int64)) for k, _, i in rows if k % 3], classes)
    for m in (few, all_of):
        m.starts = np.ones(lm.CLASSES, np.float32)
    assert all_of.log_probs(x, y, valid)[0].mean() > few.log_probs(x, y, valid)[0].mean()
    met = spark.createDataFrame([(1, k, squeeze(np.full(2 * lm.SINGLE, n, "<i8").tobytes())) for n in (3, 4) for k in range(lm.MET_PARTS)], "kind int, key long, counts binary")
    assert (lm.met_sums(met, 2 * lm.MET_PARTS) == 7).all()
