"""op9 learns from all training text once there is more of it than a slice: weights of the attention and of the mixture."""

import tracemalloc

import numpy as np
import pytest

from offerloom.llm import attention_lm as lm
from offerloom.llm.subword import tokenizer_path

BYTES, END = "byte_bpe_50k.json", 50256


def test_fit_and_mixture_are_of_every_training_word(spark, monkeypatch):
    r = np.random.default_rng(12)
    names = np.asarray([f"wort{k}" for k in range(300)])
    rows = [(i, " ".join(names[r.integers(0, 300, n)])) for i, n in enumerate(r.integers(1, 2500, 420).tolist())]
    kept = [[*t.split(), ""] for i, t in rows if lm.trains(i)]
    seen = {"mixture_weights": []}
    fitted, mixture = lm.fitted, lm.mixture_weights

    def fit(runs, classes, slices):
        seen["slices"] = slices
        seen["runs"] = [np.frombuffer(x.classes, "u1", offset=1) for x in runs.collect()]
        return fitted(runs, classes, slices)

    def weigh(chances, times):
        seen["mixture_weights"].append(times.sum())
        return mixture(chances, times)

    monkeypatch.setattr(lm, "fitted", fit)
    monkeypatch.setattr(lm, "mixture_weights", weigh)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert lm.lm_scores(docs, tokenizer_path(BYTES), END).where("score < 0").count() == len(rows)
    assert seen["slices"] > 1
    assert len(seen["runs"]) == sum(-(-len(words) // lm.RUN_WORDS) for words in kept)
    assert sum((run == 1).sum() for run in seen["runs"]) >= len(kept)  # the ends; a run before the last may end with one, too
    assert sum(map(len, seen["runs"])) >= sum(map(len, kept))
    assert seen["mixture_weights"][-1] == sum(map(len, kept))


def test_each_token_of_a_run_is_one_target():
    r = np.random.default_rng(13)
    classes = np.arange(lm.CLASSES, dtype=np.uint8)
    runs = [(-1, r.integers(1, lm.CLASSES, n)) for n in (1, 31, 32, 33, 64, 200)]
    _, y, valid = lm.run_windows(runs, classes)
    assert (y[valid] == np.concatenate([ids for _, ids in runs])).all()


@pytest.mark.parametrize("change", [0.0, 0.04, 0.09])
def test_scores_at_near_weights_are_carried_over(spark, change):
    r = np.random.default_rng(14)
    chances, centre = r.random((3, 50)) ** 8, np.asarray([0.001, 0.9, 0.099])
    weights = centre * np.asarray([1 - change, 1 - change * 0.1, 1 + change])
    near = centre @ chances
    a, b, _ = centre[:, None] * chances / near
    sums = {"n_tokens": 50.0, "near": np.log(near).sum(), "a": a, "b": b, "aa": a * a, "ab": a * b, "bb": b * b, "aaa": a**3, "aab": a * a * b, "abb": a * b * b, "bbb": b**3}
    row = spark.createDataFrame([tuple(float(np.sum(v)) for v in sums.values())], list(sums))
    got = row.selectExpr(f"{lm.moved(weights, centre)} as x").first().x
    assert lm.close_weights(weights, centre)
    assert abs(got - np.log(weights @ chances).sum()) < 50 * 4e-5


def test_far_weights_are_not_close():
    assert not lm.close_weights(np.asarray([0.2, 0.3, 0.5]), np.asarray([0.2, 0.4, 0.4]))


def test_gradients_of_a_part_stay_in_the_cache():
    """Memory held at once while a batch's gradients are worked out; twice as much, and the fit's cost rises by a third."""
    r = np.random.default_rng(15)
    x, y = r.integers(0, lm.CLASSES, (2, lm.BATCH, lm.WIDTH))
    model, valid = lm.Attention(), np.ones(x.shape, bool)
    model.gradients(x, y, valid)
    tracemalloc.start()
    model.gradients(x, y, valid)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 20


@pytest.mark.parametrize("size", [1, 200])
def test_gradients_by_plain_formulas(size):
    """All weights' gradients, window by window; large logits, too."""
    r = np.random.default_rng(16)
    x, y = r.integers(0, lm.CLASSES, (2, lm.PART + 2, lm.WIDTH))
    valid = r.random(x.shape) < 0.8
    model = lm.Attention()
    model.w["bias"] = np.linspace(0, size, lm.CLASSES, dtype=np.float32)
    w, want = {k: v.astype(float) for k, v in model.w.items()}, {k: np.zeros(v.shape) for k, v in model.w.items()}
    for xs, ys, use in zip(x, y, valid):
        h = w["embed"][xs] + w["place"]
        q, k, v = h @ w["query"], h @ w["key"], h @ w["value"]
        a = np.exp(q @ k.T / np.sqrt(lm.DIM)) * np.tri(lm.WIDTH)
        a /= a.sum(1, keepdims=True)
        o = h + a @ v
        z = o @ w["out"] + w["bias"]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d_z = (p - np.eye(lm.CLASSES)[ys]) * use[:, None] / valid.sum()
        d_o = d_z @ w["out"].T
        d_a = d_o @ v.T
        d_s = a * (d_a - (a * d_a).sum(1, keepdims=True)) / np.sqrt(lm.DIM)
        d_q, d_k, d_v = d_s @ k, d_s.T @ q, a.T @ d_o
        d_h = d_o + d_q @ w["query"].T + d_k @ w["key"].T + d_v @ w["value"].T
        np.add.at(want["embed"], xs, d_h)
        for name, g in (("place", d_h), ("query", h.T @ d_q), ("key", h.T @ d_k), ("value", h.T @ d_v), ("out", o.T @ d_z), ("bias", d_z.sum(0))):
            want[name] += g
    got = model.gradients(x, y, valid)
    assert got.keys() == want.keys()
    assert all(np.abs(got[k] - want[k]).max() < 1e-4 * np.abs(want[k]).max() for k in want)
