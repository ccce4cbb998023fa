"""op9's scores end to end: each document's score worked out again token by token, and a normalised unigram as a yardstick."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from offerloom.llm import attention_lm as lm
from offerloom.llm.subword import encoder, tokenizer_path

BYTES, END = "byte_bpe_50k.json", 50256
STOP = b"\n"  # the end among words


def rows_of_texts():
    r = np.random.default_rng(8)
    known = [f"wort{k}" for k in range(25)] + ["Été", "le", "chat", "de", "x,y;z", "\U0001f600"]
    rows = [(i, " ".join(r.choice(known, r.integers(1, 60)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n\t "), (63, "LE Chat unseen-word-of-one-text"), (None, "le chat"), (5, rows[5][1])]
    rows += [(k, " ".join(r.choice(known, 300)) + f" only-in-{k}") for k in range(70, 76)]
    return rows


class Plain:
    """Sub-words, counts and unigrams of texts, by loops."""

    def __init__(self, rows):
        self.lib = encoder(tokenizer_path(BYTES)).lib
        self.spelt = {STOP: [END]}
        self.texts = [(d, [*(t or "").encode().lower().split(), STOP]) for d, t in rows]
        for word in {w for _, words in self.texts for w in words} - {STOP}:
            self.spelt[word] = self.lib.encode(" " + word.decode(), add_special_tokens=False).ids
        self.words, self.ids, self.firsts = Counter(), Counter(), Counter()
        for doc, words in self.texts:
            if lm.trains(doc):
                self.words.update(words)
                self.firsts.update(self.spelt[w][0] for w in words)
                self.ids.update(i for w in words for i in self.spelt[w])
        self.total = sum(self.words.values())

    def starts(self, i):
        return i == END or (self.lib.id_to_token(i) or "")[:1] == "Ġ"


def attended(model, classes, starting):
    """log p(class) and log p(a word starts) at each place, by the layer's formula; the context is the window that scores the place."""
    w, x, out = model.w, [0, *classes[:-1]], []
    for t, y in enumerate(classes):
        begin = 0 if t < lm.WIDTH else (t - (lm.WIDTH - lm.STEP)) // lm.STEP * lm.STEP
        h = w["embed"][x[begin : t + 1]] + w["place"][: t + 1 - begin]
        a = np.exp((h[-1] @ w["query"]) @ (h @ w["key"]).T / np.sqrt(lm.DIM))
        z = np.exp((h[-1] + (a / a.sum()) @ (h @ w["value"])) @ w["out"] + w["bias"])
        out.append((np.log(z[y] / z.sum()), np.log(z[starting].sum() / z.sum())))
    return out


def test_scores_by_loops(spark, monkeypatch):
    """The fitted weights are taken as they are; counts, classes' shares, windows, mixture and sums are worked out again."""
    seen = {}

    def watched(name):
        whole = getattr(lm, name)

        def call(*given):
            seen[name] = given, whole(*given)
            return seen[name][1]

        monkeypatch.setattr(lm, name, call)

    watched("fitted")
    watched("mixture_weights")
    rows = rows_of_texts()
    got = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tokenizer_path(BYTES), END).collect()
    (_, classes, _), model = seen["fitted"]
    weights = seen["mixture_weights"][1]
    plain = Plain(rows)
    size = len(classes)
    starting = sorted({int(classes[i]) for i in range(size) if plain.starts(i)})
    mass, led = defaultdict(float), Counter()
    for i in range(size):
        mass[classes[i]] += plain.ids[i] + lm.SMOOTH
    for i, n in plain.firsts.items():
        led[classes[i]] += n

    def chances(words, own):
        """Of each word: its count and three probabilities, with so many own occurrences left out of the counts."""
        flat = [i for w in words for i in plain.spelt[w]]
        each, at = attended(model, [int(classes[i]) for i in flat], starting), 0
        for w in words:
            ids, n = plain.spelt[w], plain.words[w] - own
            log = sum(each[at + k][0] + np.log((plain.ids[i] + lm.SMOOTH) / mass[classes[i]]) for k, i in enumerate(ids)) - each[at][1]
            first, lead = classes[ids[0]], np.exp(each[at][0] - each[at][1])
            at += len(ids)
            log += each[at][1] if at < len(flat) else 0
            yield n, (n / (plain.total - own), lead * n / max(1, led[first] - own), np.exp(log))

    # all runs are picked of a corpus this small, so the mixture's weights are of all training words
    events = [(n, p) for d, words in plain.texts if lm.trains(d) for n, p in chances(words, 1)]
    exact = lm.mixture_weights(np.asarray([p if n else (0, 0, 1) for n, p in events]).T, np.ones(len(events)))
    assert np.abs(exact - weights).max() < 0.02
    want = Counter()
    for doc, words in plain.texts:
        want[doc, len(words), round(sum(np.log10(np.dot(weights, p)) for _, p in chances(words, 0)), 1)] += 1
    close = Counter()
    left = list(want.elements())
    for r in got:
        best = min((w for w in left if w[:2] == (r.doc_id, r.n_tokens)), key=lambda w: abs(w[2] - r.score))
        left.remove(best)
        close[abs(best[2] - r.score) < 0.06 + 1e-4 * abs(r.score)] += 1
    assert not left and close == {True: len(rows)}


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    return [tuple(r) for r in docs.collect()], lm.lm_scores(docs, tokenizer_path(BYTES), END).where("held_out").collect()


def test_model_beats_a_normalised_unigram(scored):
    """The yardstick: shares of words, mixed with sub-words drawn one by one, which is a probability over all texts (the base score is none)."""
    rows, got = scored
    plain = Plain(rows)
    size = plain.lib.get_vocab_size(with_added_tokens=True)
    whole = sum(plain.ids.values()) + lm.SMOOTH * size
    part = {i: (plain.ids[i] + lm.SMOOTH) / whole for i in range(size)}
    start = sum(p for i, p in part.items() if plain.starts(i))
    new = sum(n == 1 for n in plain.words.values()) / plain.total  # the share of words not met before

    def log10(word):
        spelt = np.prod([part[i] for i in plain.spelt[word]]) / start * (1 if word == STOP else start)
        return np.log10((1 - new) * plain.words[word] / plain.total + new * spelt)

    unigram = sum(log10(w) for d, words in plain.texts if not lm.trains(d) for w in words)
    ours, tokens = sum(r.score for r in got), sum(r.n_tokens for r in got)
    print(f"mean log10 of a held-out token: model {ours / tokens:.4f}, unigram {unigram / tokens:.4f}, base {sum(r.base_score for r in got) / tokens:.4f}")
    assert tokens == sum(len(words) for d, words in plain.texts if not lm.trains(d))
    assert ours > unigram
