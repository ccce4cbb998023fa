"""Operator 9, language-model scoring: a causal self-attention model over sub-word ids, trained and run in numpy.

The model factors a token's probability in two: p(class | context) by one causal attention layer over classes of
sub-word ids, and p(id | class) from counts. The counts, like those of the base score, are of every training document:
words are counted per block, summed in word partitions and brought back to the blocks, so what is gathered grows with
the corpus. A token's class is one of the most frequent ids, or a cluster of ids by the frequent ids around them, which
are counted over the windows of every training document and added up in the executors. The attention layer's weights are
fitted on all training text, ends included, in runs of RUN_WORDS words that a hash of (doc_id, text, run) deals into
slices of about SLICE_RUNS runs. The first slice is fitted on the driver for a start; then, ROUNDS times, each slice
(the first, too) goes on from the common weights in an executor, and the mean of all slices is the next start.

A word's probability mixes three: its share of all training tokens; the attention's p(class of its first sub-word)
times its share of the words with that class; and the attention's p(its sub-words), which includes the word's end (what
follows the last sub-word starts a word or is the end) and takes the first sub-word given that one starts. The three
weights are found by expectation maximisation over all training words, each word's own occurrence left out of its counts:
the executors count the words by the (rounded) ratios of the three, so the driver gets a table of ratios. That count
and the scores share one pass: scores are worked out at first weights, of one document in CENTRE, with the sums that
carry them over to the final ones (see moved); where these are not close, scores are worked out again at the final ones.
Neither the runs nor the sums depend on the order or the partitions of the rows.

A text is its lower-cased words (A-Z) as sub-words that each begin with a space, then one end. Windows of WIDTH tokens
advance by STEP: the first scores all its tokens and each later one its last STEP, so every token is scored once, with
WIDTH - STEP tokens of context at least where the text has them, by batched masked attention.

Defined cases: null and empty texts consist of the end; a null doc_id counts as fold 0 (held out); repeated rows count
as often as they occur; an empty table gives an empty table, and without training text all counts are 0 (base_score
then is null); other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import crc32_text, table, written
from offerloom.llm.subword import encoder, tokenizer_path
from offerloom.llm.word_blocks import opened, squeeze, text_blocks, unsqueeze, word_lists, word_parts

WIDTH, STEP, DIM, CLASSES, SINGLE = 32, 24, 16, 64, 38
TRAIN_STEPS, BATCH = 500, 192
#: Windows of a batch whose gradients are worked out together, so that their places stay in the cache.
PART = 24
#: Runs of words that all training text is dealt out by: words of each, runs of a slice, rounds over all slices.
RUN_WORDS, SLICE_RUNS, ROUNDS = 256, 1024, 1
FOLDS = 10
#: Steps of a unit (natural logarithm) by which ratios of probabilities are told apart, and the most units.
RATIO_STEPS, RATIO_MOST = 16, 50
#: Scores are first worked out at weights of one document in CENTRE (and of CENTRE_WORDS words at least); these are CLOSE
#: if no final weight differs by more than this share of it.
CENTRE, CENTRE_WORDS, CLOSE = 16, 1 << 18, 0.1
#: Parts of the table of ids met in windows, for its sum.
MET_PARTS = 16
#: Characters of a block of texts, which the steps hold as words, ids and counts.
BLOCK = 6_000_000
#: Added to each id's count within its class.
SMOOTH = 0.5
INDEXED = "kind int, key long, docs binary, per binary, at binary, sizes binary, ids binary, counts binary"
RUNS = "slice int, key long, classes binary"
CELLS = "led long, spelt long, n long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, known_log10 double, near double, a double, b double, aa double, ab double, bb double, aaa double, aab double, abb double, bbb double"


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def trains(doc: int | None) -> bool:
    return crc32_text(doc) % FOLDS != 0


def encoded(enc, words: list[bytes]) -> dict[bytes, bytes]:
    """Sub-words of each word after a space; the first always starts a word, and special tokens' names are ordinary text."""
    return dict(zip(words, enc.spaced([w.decode() for w in words])))


def trained_counts(docs: Iterable[tuple[int | None, bytes]]) -> dict[bytes, int]:
    """A block's words with their counts in training documents (0: only held out)."""
    found: Counter = Counter()
    held: set[bytes] = set()
    for doc, text in docs:
        (found if trains(doc) else held).update(words_of(text))
    found.update(dict.fromkeys(held.difference(found), 0))
    return found


def total_words(lists: DataFrame, path: str, parts: int) -> DataFrame:
    """Replies for each list (role 0: words; given: totals and sub-word ids) and sums of each word partition (role 2)."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, plain=True)
        size = enc.lib.get_vocab_size(with_added_tokens=True)
        totals: dict[bytes, int] = {}
        rows: list[tuple[int, bytes]] = []
        for batch in batches:
            for block, packed, counts in zip(*(batch.column(k).to_pylist() for k in ("block", "words", "counts"))):
                rows.append((block, packed))
                for word, n in zip(unsqueeze(packed).split(b"\n"), np.frombuffer(unsqueeze(counts), "<i8").tolist()):
                    totals[word] = totals.get(word, 0) + n
        ids = encoded(enc, list(totals))
        for block, packed in rows:
            words = unsqueeze(packed).split(b"\n")
            own = [ids[w] for w in words]
            given = np.fromiter(map(totals.__getitem__, words), "<i8", len(words)).tobytes() + np.fromiter(map(len, own), "<u4", len(own)).tobytes() + b"".join(own)
            yield reply(block, 0, packed, squeeze(given))
        if totals:
            each = np.fromiter(totals.values(), np.int64, len(totals))
            sizes = np.fromiter((len(v) // 4 for v in ids.values()), np.int64, len(ids))
            flat = np.frombuffer(b"".join(ids.values()), "<u4")
            by_id = np.bincount(flat, weights=np.repeat(each, sizes).astype(float), minlength=size)
            by_first = np.bincount(flat[np.cumsum(sizes) - sizes], weights=each.astype(float), minlength=size)
            yield reply(int(each.sum()), 2, np.asarray([(each > 0).sum()], "<i8").tobytes(), squeeze(np.concatenate([by_id, by_first]).astype("<i8").tobytes()))

    def reply(block, role, words, given):
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([role], pa.int32()), pa.array([words], pa.binary()), pa.array([given], pa.binary())], ["block", "role", "words", "given"])

    return lists.repartition(parts, "part").mapInArrow(total, "block long, role int, words binary, given binary")


def corpus_counts(replies: DataFrame, size: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Of all training text: words, distinct words, counts by sub-word id and by first id of words; added up in the executors."""

    def opened_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for total, distinct, packed in zip(frame["block"], frame["words"], frame["given"]):
                by_id = np.frombuffer(unsqueeze(packed), "<i8")
                at = np.flatnonzero(by_id)
                yield pd.DataFrame({"id": np.append(at, [-1, -2]), "n": np.append(by_id[at], [total, np.frombuffer(distinct, "<i8")[0]])})

    found = replies.where("role = 2").select("block", "words", "given").mapInPandas(opened_sums, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    sums = dict(zip(found["id"], found["n"]))
    counts = np.zeros(2 * size, np.int64)
    for i, n in sums.items():
        if i >= 0:
            counts[i] = n
    return int(sums.get(-1, 0)), int(sums.get(-2, 0)), counts[:size], counts[size:]


def frequent(counts: np.ndarray) -> np.ndarray:
    """Of each id, its place among the most frequent ids, else -1."""
    column = np.full(len(counts), -1, np.int8)
    column[np.argsort(-counts, kind="stable")[:SINGLE]] = np.arange(SINGLE)
    return column


def add_met(met: np.ndarray, flat: np.ndarray, lengths: np.ndarray, column: np.ndarray) -> None:
    """Adds to met (ids by frequent ids) how often they share a window of WIDTH, for texts of these lengths laid end to end."""
    if not len(flat):
        return
    wide = -(-lengths // WIDTH)
    window = np.repeat(np.cumsum(wide) - wide, lengths) + (np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // WIDTH
    col = column[flat]
    use = col >= 0
    near = np.bincount(window[use] * SINGLE + col[use], minlength=int(wide.sum()) * SINGLE).reshape(-1, SINGLE).astype(np.uint8)
    order = np.argsort(flat.astype(np.min_scalar_type(len(column))), kind="stable")
    ids = flat[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    met[ids[first]] += np.add.reduceat(near[window[order]], first, axis=0, dtype=np.int64)


def class_table(counts: np.ndarray, pieces: list[str], end: int, met: np.ndarray) -> np.ndarray:
    """Class of each id: 0 the start of a text, 1 its end, then the most frequent ids, then clusters of the others.

    Ids that start a word and ids that do not fall in clusters of their own, by the frequent ids that share their
    windows (met); an id that no training text has joins the cluster of most ids of its kind.
    """
    classes = np.zeros(len(counts), np.uint8)
    column = frequent(counts)
    classes[column >= 0] = 2 + column[column >= 0]
    share = (met.sum(0) + 1) / (met.sum() + SINGLE)
    starts = np.asarray([p[:1] == "Ġ" for p in pieces])
    half = (CLASSES - 2 - SINGLE) // 2
    for first, kind in ((2 + SINGLE, starts), (2 + SINGLE + half, ~starts)):
        others = kind & (column < 0)
        classes[others] = first
        known = np.flatnonzero(others & (met.sum(1) > 0))
        if len(known):
            spread = (met[known] + 20 * share) / (met[known].sum(1, keepdims=True) + 20)
            classes[known] = first + clustered(np.sqrt(spread), counts[known] + 1.0, half)
    classes[end] = 1
    return classes


def clustered(points: np.ndarray, weights: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Weighted k-means; the first centres are each the point of most weight times distance from those before."""
    centres, far = [points[weights.argmax()]], np.full(len(points), np.inf)
    for _ in range(1, k):
        far = np.minimum(far, ((points - centres[-1]) ** 2).sum(1))
        centres.append(points[(far * weights).argmax()])
    middle = np.asarray(centres)
    for _ in range(rounds):
        nearest = ((points**2).sum(1)[:, None] - 2 * points @ middle.T + (middle**2).sum(1)).argmin(1)
        for c in range(k):
            if (nearest == c).any():
                middle[c] = np.average(points[nearest == c], axis=0, weights=weights[nearest == c])
    return nearest


def starting(classes: np.ndarray, pieces: list[str]) -> np.ndarray:
    """Of each class, whether its ids start a word (or are the end); classes never mix the two."""
    out = np.zeros(CLASSES, np.float32)
    out[classes[[i for i, p in enumerate(pieces) if p[:1] == "Ġ"]]] = 1
    out[1] = 1
    return out


def lowered(x: np.ndarray, axis: int = -1) -> np.ndarray:
    """Logits whose exponentials are finite: less each row's greatest, where any is high. Shares of a row (along axis) stay as they are."""
    return x - x.max(axis, keepdims=True) if x.max(initial=0) > 60 else x


class Attention:
    """One causal attention layer with a residual, over classes; its weights are fitted by Adam."""

    NAMES = ("embed", "place", "query", "key", "value", "out", "bias")

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        shapes = {"embed": (CLASSES, DIM), "place": (WIDTH, DIM), "query": (DIM, DIM), "key": (DIM, DIM), "value": (DIM, DIM), "out": (DIM, CLASSES), "bias": (CLASSES,)}
        self.w = {k: (r.normal(size=s) * (0.3 if k in ("embed", "out") else 0.1)).astype(np.float32) * (k != "bias") for k, s in shapes.items()}
        self.mask = np.where(np.tri(WIDTH, dtype=bool), 0, -1e9).astype(np.float32)

    def hidden(self, x: np.ndarray):
        w = self.w
        h = w["embed"][x] + w["place"]
        q, k, v = h @ w["query"], h @ w["key"], h @ w["value"]
        a = q @ k.transpose(0, 2, 1)
        a *= np.float32(DIM**-0.5)
        a += self.mask
        a = lowered(a)
        np.exp(a, out=a)
        a /= a.sum(-1, keepdims=True)
        return h, q, k, v, a, h + a @ v

    def lookups(self) -> tuple[np.ndarray, ...]:
        """What a class and a place add to a key, a value, a one (the shares' sum), a query and the residual; the last layer."""
        w = self.w
        by = np.concatenate([w["key"], w["value"], np.zeros((DIM, 1), np.float32), w["query"] * np.float32(DIM**-0.5), np.eye(DIM, dtype=np.float32)], 1)
        by_class, by_place = w["embed"] @ by, w["place"] @ by
        by_place[:, 2 * DIM] = 1
        kept, looked = slice(2 * DIM + 1), slice(2 * DIM + 1, None)
        tables = by_class[:, kept], by_place[:, kept], by_class[:, looked], by_place[:, looked], self.mask.T, np.concatenate([w["out"], w["bias"][None]]).T, np.stack([np.ones(CLASSES, np.float32), self.starts])
        return tuple(map(np.ascontiguousarray, tables))

    def log_probs(self, x: np.ndarray, y: np.ndarray, scored: np.ndarray, since: int = 0, tables: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        """Rows of natural log p(class) of the scored places (none before since), in order, and log p(a word starts) there.

        The layer's outputs (and a one) are features by windows by places, so that what belongs to a place is worked out
        along rows. Classes are few, so projections are looked up, not multiplied."""
        kept, kept_at, looked, looked_at, mask, out, sums = tables or self.lookups()
        kv = np.take(kept, x, axis=0)
        kv += kept_at
        qh = np.take(looked, x[:, since:], axis=0)
        qh += looked_at[since:]
        a = kv[..., :DIM] @ qh[..., :DIM].transpose(0, 2, 1)  # keys by queries
        a += mask[:, since:]
        a = lowered(a, 1)
        np.exp(a, out=a)
        o = np.empty((DIM + 1, *qh.shape[:2]), np.float32)
        np.matmul(kv[..., DIM:].transpose(0, 2, 1), a, out=o.transpose(1, 0, 2))
        o[:DIM] /= o[DIM]
        o[:DIM] += qh[..., DIM:].transpose(2, 0, 1)
        o[DIM] = 1
        rows, named, use = o.reshape(DIM + 1, -1), y[:, since:].reshape(-1), scored[:, since:].reshape(-1)
        if 2 * use.sum() < len(use):
            rows, named, use = rows[:, use], named[use], slice(None)
        z = lowered(out @ rows, 0)
        found = np.empty((3, len(named)))
        found[0] = np.take(z.reshape(-1), named * len(named) + np.arange(len(named)))
        np.exp(z, out=z)
        np.log(sums @ z, out=found[1:], dtype=np.float64)
        found[::2] -= found[1]
        return found[::2][:, use]

    def fit(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray, seed: int = 6) -> None:
        if not len(x):
            return
        r = np.random.default_rng(seed)
        share = np.bincount(y[valid], minlength=CLASSES) + 1.0
        self.w["bias"] = np.log(share / share.sum()).astype(np.float32)
        self.descend(x, y, valid, (r.integers(0, len(x), BATCH) for _ in range(TRAIN_STEPS)), TRAIN_STEPS, 0.01)

    def refine(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray, seed: int) -> None:
        """Each window once more, from the weights there are."""
        steps = -(-len(x) // BATCH)
        self.descend(x, y, valid, np.array_split(np.random.default_rng(seed).permutation(len(x)), max(1, steps)), steps, 0.002)

    def descend(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray, picks, steps: int, top: float) -> None:
        m, s = {}, {}
        for step, pick in zip(range(1, steps + 1), picks):
            grads = self.gradients(x[pick], y[pick], valid[pick])
            rate = top * min(1, step / 20) * (1 - step / (steps + 1)) ** 0.5
            for name, g in grads.items():
                m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                s[name] = 0.99 * s.get(name, 0) + 0.01 * g * g
                self.w[name] = (self.w[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss over the valid places. Lookups are by windows and places, all else is laid out as in outputs;
        shares are left as exponentials, and what divides them is applied to the narrow rows beside them."""
        w, scale, each = self.w, np.float32(DIM**-0.5), np.float32(1 / max(1, valid.sum()))
        by = np.concatenate([w["query"] * scale, w["key"], w["value"], np.eye(DIM, dtype=np.float32)], 1)
        looked, looked_at = (np.insert(w[name] @ by, 3 * DIM, one, axis=1) for name, one in (("embed", 0), ("place", 1)))  # a value of one after the values
        out, mask, hot = np.concatenate([w["out"], w["bias"][None]]), np.ascontiguousarray(self.mask.T), np.eye(CLASSES, dtype=np.float32)
        by_class, by_place = np.zeros_like(w["embed"].T), np.zeros_like(w["place"].T)
        d_out, inner = np.zeros_like(out), np.zeros((DIM, 3 * DIM), np.float32)
        for s in range(0, len(x), PART):
            at, named = x[s : s + PART], y[s : s + PART].reshape(-1)
            all_of = np.take(looked, at, axis=0)
            all_of += looked_at
            q, k, v, h = np.split(all_of, (DIM, 2 * DIM, 3 * DIM + 1), axis=-1)
            a = k @ q.transpose(0, 2, 1)  # keys by queries
            a += mask
            a = lowered(a, 1)
            np.exp(a, out=a)
            o = np.empty((DIM + 1, *at.shape), np.float32)
            np.matmul(v.transpose(0, 2, 1), a, out=o.transpose(1, 0, 2))
            over = 1 / o[DIM]
            mean = o[:DIM] * over
            np.add(mean, h.transpose(2, 0, 1), out=o[:DIM])
            o[DIM] = 1
            rows = o.reshape(DIM + 1, -1)
            p = out.T @ rows
            p = lowered(p, 0)
            np.exp(p, out=p)
            whole = p.sum(0)
            p.reshape(-1)[named * len(named) + np.arange(len(named))] -= whole
            share = valid[s : s + PART].reshape(-1) * (each / whole)
            rows *= share
            d_out += rows @ p.T
            grad = np.empty((4 * DIM, *at.shape), np.float32)
            flat, by_window, d_o = grad.reshape(4 * DIM, -1), grad.transpose(1, 0, 2), o  # o is done with
            np.matmul(w["out"], p, out=flat[3 * DIM :])
            flat[3 * DIM :] *= share
            np.multiply(grad[3 * DIM :], over, out=d_o[:DIM])
            mean *= d_o[:DIM]
            np.negative(mean.sum(0), out=d_o[DIM])
            d_s = v @ d_o.transpose(1, 0, 2)
            d_s *= a
            np.matmul(k.transpose(0, 2, 1), d_s, out=by_window[:, :DIM])
            np.matmul(q.transpose(0, 2, 1), d_s.transpose(0, 2, 1), out=by_window[:, DIM : 2 * DIM])
            np.matmul(d_o[:DIM].transpose(1, 0, 2), a.transpose(0, 2, 1), out=by_window[:, 2 * DIM : 3 * DIM])
            inner += h.reshape(-1, DIM).T @ flat[: 3 * DIM].T
            d_h = by @ flat
            by_place += d_h.reshape(DIM, *at.shape).sum(1)
            by_class += d_h @ np.take(hot, at.reshape(-1), axis=0, out=p.reshape(-1, CLASSES), mode="clip")
            del all_of, q, k, v, h, a, o, over, mean, rows, p, grad, flat, by_window, d_o, d_s, d_h  # the next part takes their place in the cache
        return {"embed": by_class.T, "place": by_place.T, "query": inner[:, :DIM] * scale, "key": inner[:, DIM : 2 * DIM], "value": inner[:, 2 * DIM :], "out": d_out[:DIM], "bias": d_out[DIM]}


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of these numbers of tokens, laid end to end: each window's first token, first scored place and scored tokens."""
    more = np.maximum(0, -(-(lengths - WIDTH) // STEP))
    per = 1 + more
    text = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    start = np.repeat(np.cumsum(lengths) - lengths, per) + nth * STEP
    left = lengths[text] - nth * STEP
    return start, np.where(nth == 0, 0, WIDTH - STEP), np.minimum(WIDTH, left)


def score_tokens(model: Attention, classes: np.ndarray, lengths: np.ndarray, batch: int = 128, first: int | np.ndarray = 0) -> np.ndarray:
    """Rows of log p(class) and log p(a word starts) for each token of texts laid end to end, each after the class first."""
    ends = np.cumsum(lengths)
    before = np.concatenate([[0], classes[:-1]])
    before[(ends - lengths)] = first
    start, since, stop = windows(lengths)
    x, y = (np.lib.stride_tricks.sliding_window_view(np.append(v, np.zeros(WIDTH, v.dtype)), WIDTH) for v in (before, classes))
    nth, out = np.arange(len(classes)) - np.repeat(ends - lengths, lengths), np.empty((2, len(classes)))
    tables = model.lookups()
    for lead, by_first in ((0, nth < WIDTH), (WIDTH - STEP, nth >= WIDTH)):  # first windows, then later ones, whose first places are context alone
        some = np.flatnonzero(since == lead)
        picks = [some[a : a + batch] for a in range(0, len(some), batch)]
        found = [model.log_probs(x[start[p]], y[start[p]], (np.arange(WIDTH) >= lead) & (np.arange(WIDTH) < stop[p, None]), lead, tables) for p in picks]
        if found:
            out[:, by_first] = np.concatenate(found, 1)  # windows follow each other as their tokens do
    return out


def run_hashes(doc: int, runs: int) -> np.ndarray:
    """A 63-bit hash for each of a document's runs."""
    h = (np.arange(runs, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(doc * 0xBF58476D1CE4E5B9 & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
    return ((h ^ h >> np.uint64(31)) >> np.uint64(1)).astype(np.int64)


def cut_run(flat: np.ndarray, heads: np.ndarray, first: int, last: int) -> tuple[int, np.ndarray, int]:
    """For words first to last of a text (flat: its ids and the end, heads: where its words begin): (id before the slice
    or -1, the slice's ids, place in it of the first word). The slice begins where the scores' window of the first word
    begins, and ends with the token after the last word, if there is one."""
    at = int(heads[first])
    begin = 0 if at < WIDTH else (at - (WIDTH - STEP)) // STEP * STEP
    stop = int(heads[last + 1]) + 1 if last + 1 < len(heads) else len(flat)
    return int(flat[begin - 1]) if begin else -1, flat[begin:stop], at - begin


def run_windows(runs: list[tuple[int, np.ndarray]], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and valid places of all windows of runs (id before, ids); each token of a run is the target of one place."""
    if not runs:
        return np.zeros((0, WIDTH), np.int64), np.zeros((0, WIDTH), np.int64), np.zeros((0, WIDTH), bool)
    lengths = np.asarray([len(ids) for _, ids in runs])
    y = classes[np.concatenate([ids for _, ids in runs])].astype(np.int64)
    before = np.concatenate([[0], y[:-1]])
    before[np.cumsum(lengths) - lengths] = [classes[b] if b >= 0 else 0 for b, _ in runs]
    per = -(-lengths // WIDTH)
    skipped = (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * WIDTH
    start, left = np.repeat(np.cumsum(lengths) - lengths, per) + skipped, np.repeat(lengths, per) - skipped
    at, place = np.minimum(start[:, None] + np.arange(WIDTH), len(y) - 1), np.arange(WIDTH)
    return before[at], y[at], place < left[:, None]


def opened_runs(packed: bytes) -> list[tuple[int, np.ndarray]]:
    """Of each run of a slice: the class before it and its own."""
    raw = unsqueeze(packed)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    each = np.split(np.frombuffer(raw, "u1", offset=8 + 8 * n), np.cumsum(np.frombuffer(raw, "<i8", n, 8))[:-1])
    return [(int(run[0]), run[1:]) for run in each]


def fitted(runs: DataFrame, classes: np.ndarray, slices: int) -> Attention:
    """The attention layer: the first slice on the driver, then the mean of all slices, each fitted further in an executor."""
    own = np.arange(CLASSES, dtype=np.uint8)

    def by_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ats, each = (batch.column(k).to_pylist() for k in ("key", "at", "ids"))
            packed = [classed(int(np.frombuffer(at, "<i8")[0]), np.frombuffer(ids, "<u4"), classes) for at, ids in zip(ats, each)]
            yield pa.RecordBatch.from_arrays([pa.array([k % slices for k in keys], pa.int32()), pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], ["slice", "key", "classes"])

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        each = frame.sort_values(["key", "classes"])["classes"].tolist()
        return pd.DataFrame({"slice": [frame["slice"].iloc[0]], "runs": [squeeze(np.asarray([len(each), *map(len, each)], "<i8").tobytes() + b"".join(each))]})

    rows = runs if "classes" in runs.columns else runs.select("key", "at", "ids").mapInArrow(by_classes, RUNS)  # of ids: classed here
    sliced = written(rows.groupBy("slice").applyInPandas(joined, "slice int, runs binary"), "slices")
    model = Attention()
    first = sliced.where("slice = 0").toPandas()
    model.fit(*run_windows([run for packed in first["runs"] for run in opened_runs(packed)], own))

    def further(now: dict[str, np.ndarray], seed: int):
        def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """The weights of a task's slices, added up."""
            n, whole = 0, 0.0
            for packed in (p for frame in frames for p in frame["runs"]):
                x, y, valid = run_windows(opened_runs(packed), own)
                mine = Attention()
                mine.w = dict(now)
                mine.refine(x, y, valid, seed)
                n, whole = n + len(x), whole + len(x) * np.concatenate([mine.w[k].ravel() for k in Attention.NAMES]).astype(np.float64)
            if n:
                yield pd.DataFrame({"n": [n], "w": [whole.tobytes()]})

        return fit

    for turn in range(ROUNDS if slices > 1 else 0):
        now = dict(model.w)
        sums = sliced.mapInPandas(further(now, 7 + turn), "n long, w binary").toPandas()
        mean = sum(np.frombuffer(w, "<f8") for w in sums["w"]) / sums["n"].sum()
        at = 0
        for name in Attention.NAMES:
            size = now[name].size
            model.w[name] = mean[at : at + size].reshape(now[name].shape).astype(np.float32)
            at += size
    return model


def mixture_weights(chances: np.ndarray, times: np.ndarray, rounds: int = 80) -> np.ndarray:
    """Weights of several probabilities (rows) of the same events, met so many times, by expectation maximisation; none falls to 0."""
    weights = np.full(len(chances), 1 / len(chances))
    for _ in range(rounds if chances.size else 0):
        part = weights[:, None] * chances
        weights = np.maximum((part / part.sum(0)) @ times / times.sum(), 1e-3)
        weights /= weights.sum()
    return weights


@dataclass
class Block:
    """A block's documents as places in its list of words (the end is the last); sizes, ids and counts are of that list."""

    docs: list[int | None]
    per: np.ndarray
    at: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray

    def only(self, use: np.ndarray) -> Block:
        return Block([d for d, u in zip(self.docs, use.tolist()) if u], self.per[use], self.at[np.repeat(use, self.per)], self.sizes, self.ids, self.counts)

    def training(self) -> np.ndarray:
        return np.fromiter(map(trains, self.docs), bool, len(self.docs))


def laid_out(block: Block, words: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of a block's documents of about so many words: doc_ids, words in each, and of all words the place in the
    block's list, sub-words and first sub-word's place; the sub-words' places in the block's ids."""
    begins, ends = np.cumsum(block.sizes) - block.sizes, np.cumsum(block.per)
    for a, b in groups_of(block.per, words):
        at = block.at[ends[a] - block.per[a] : ends[b - 1]].astype(np.int64)
        each = block.sizes[at]
        heads = np.cumsum(each) - each
        yield block.docs[a:b], block.per[a:b], at, each, heads, np.repeat(begins[at] - heads, each) + np.arange(each.sum())


def one_by_one(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of a batch of large values, without a copy of them all."""
    columns = [batch.column(k) for k in names]
    for n in range(batch.num_rows):
        yield tuple(c[n].as_py() for c in columns)


def opened_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for fields in one_by_one(batch, ("docs", "per", "at", "sizes", "ids", "counts")):
            docs, per, at, sizes, ids, counts = (np.frombuffer(unsqueeze(f), t) for f, t in zip(fields, ("<i8", "<i8", "<i4", "<u4", "<u4", "<i8")))
            yield Block([d if known else None for d, known in docs.reshape(-1, 2).tolist()], per, at, sizes.astype(np.int64), ids, counts)


def groups_of(per: np.ndarray, words: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about so many words together; a longer document is one of its own."""
    first, size = 0, 0
    for n, k in enumerate(per.tolist()):
        size += k
        if size >= words:
            yield first, n + 1
            first, size = n + 1, 0
    if first < len(per):
        yield first, len(per)


def arrow(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), *[pa.binary()] * 6)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [f.split()[0] for f in INDEXED.split(", ")])


def indexer(column: np.ndarray, end: int, n_train: int):
    """Blocks with their words' replies to: indexed blocks (kind 0), sums of ids met in windows (kind 1)."""
    size = len(column)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, places, lists = None, {}, []
        met = np.zeros((size, SINGLE), np.int64)  # of one task
        for batch in batches:
            for block, role, names, given, known, texts in one_by_one(batch, ("block", "role", "words", "given", "docs", "texts")):
                if block != now:
                    now, places, lists = block, {}, []
                if role == 0:
                    own = unsqueeze(names).split(b"\n")
                    for w in own:
                        places[w] = len(places)
                    lists.append((len(own), unsqueeze(given)))
                    continue
                counts = np.concatenate([np.frombuffer(g, "<i8", n) for n, g in lists] + [np.asarray([n_train], "<i8")])
                sizes = np.concatenate([np.frombuffer(g, "<u4", n, 8 * n) // 4 for n, g in lists] + [np.ones(1, "<u4")]).astype("<u4")
                ids = np.concatenate([np.frombuffer(g, "<u4", offset=12 * n) for n, g in lists] + [np.asarray([end], "<u4")])
                last, docs, each = len(counts) - 1, [], []
                for doc, text in opened(known, texts):
                    found = words_of(text)
                    docs.append(doc)
                    each.append(np.append(np.fromiter(map(places.__getitem__, found), "<i4", len(found)), np.int32(last)).astype("<i4"))
                per, at = np.asarray([len(a) for a in each], "<i8"), np.concatenate(each)
                places, lists, each, texts = {}, [], [], None  # before the sums
                named = np.asarray([[d or 0, d is not None] for d in docs], "<i8")
                yield arrow([(0, block, *(squeeze(v.tobytes()) for v in (named, per, at, sizes, ids, counts)))])
                block_of = Block(docs, per, at, sizes.astype(np.int64), ids, counts)
                for _, per, at, each, _, place in laid_out(block_of.only(block_of.training()), 20_000):
                    add_met(met, ids[place].astype(np.int64), np.add.reduceat(each, np.cumsum(per) - per), column)
        if met.any():
            yield arrow([(1, k, None, None, None, None, None, squeeze(part.astype("<i8").tobytes())) for k, part in enumerate(np.array_split(met, MET_PARTS))])

    return index


def classed(before: int, ids: np.ndarray, classes: np.ndarray) -> bytes:
    """A byte for the class before a run and for each of its tokens."""
    return bytes([classes[before] if before >= 0 else 0]) + classes[ids].tobytes()


def training_runs(classes: np.ndarray, slices: int):
    """All training text of indexed blocks in runs of RUN_WORDS words by classes, dealt to slices by a hash of document and place."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in opened_blocks(batches):
            for docs, per, _, each, heads, place in laid_out(block.only(block.training()), 20_000):
                flat, first, rows = block.ids[place], np.cumsum(per) - per, []
                for doc, f, n, h, length in zip(docs, first.tolist(), per.tolist(), heads[first].tolist(), np.add.reduceat(each, first).tolist()):
                    text, own = flat[h : h + length], heads[f : f + n] - h
                    hashes = run_hashes(doc ^ xxhash.xxh3_64_intdigest(text.astype("<u4")), -(-n // RUN_WORDS))  # the text, too: rows may repeat an id
                    for r, key in enumerate(hashes.tolist()):
                        before, ids, _ = cut_run(text, own, r * RUN_WORDS, min(n, (r + 1) * RUN_WORDS) - 1)
                        rows.append((key % slices, key, classed(before, ids, classes)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["slice", "key", "classes"])

    return cut


def met_sums(indexed: DataFrame, size: int) -> np.ndarray:
    """Ids by the frequent ids that share their windows, of all training text; added up in the executors."""

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(unsqueeze(c), "<i8") for c in frame["counts"])
        return pd.DataFrame({"key": [frame["key"].iloc[0]], "counts": [squeeze(total.tobytes())]})

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums within a task, so that what a part's sum reads is a row for each task."""
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            for key, counts in zip(frame["key"], frame["counts"]):
                new = np.frombuffer(unsqueeze(counts), "<i8")
                held[key] = held[key] + new if key in held else new
        if held:
            yield pd.DataFrame({"key": list(held), "counts": [squeeze(v.tobytes()) for v in held.values()]})

    rows = indexed.where("kind = 1").select("key", "counts").mapInPandas(part, "key long, counts binary").groupBy("key").applyInPandas(added, "key long, counts binary").toPandas().sort_values("key")
    if not len(rows):
        return np.zeros((size, SINGLE))
    return np.concatenate([np.frombuffer(unsqueeze(c), "<i8") for c in rows["counts"]]).reshape(size, SINGLE).astype(float)


def lm_scores(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Counts, base score and model score of every document; see op9's contract for the columns."""
    enc = encoder(path, plain=True)
    size = enc.lib.get_vocab_size(with_added_tokens=True)
    packed = written(text_blocks(docs, BLOCK), "text-blocks")  # written once: counts and scores must see the same blocks
    parts = word_parts(docs.sparkSession, packed.count())
    replies = written(total_words(word_lists(packed, parts, trained_counts), path, parts), "word-totals")
    words, distinct, by_id, by_first = corpus_counts(replies, size)
    n_train = docs.where(F.expr(f"coalesce(crc32(cast(cast(doc_id as string) as binary)), 0) % {FOLDS} != 0")).count()
    by_id[end] += n_train
    total, kinds = words + n_train, distinct + (n_train > 0)
    pieces = [enc.lib.id_to_token(i) or "" for i in range(size)]
    told = replies.where("role = 0").select("block", "role", "words", "given", F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("texts"))
    column, slices = frequent(by_id), max(1, round(total / (RUN_WORDS * SLICE_RUNS)))
    indexed = written(told.unionByName(packed).repartition("block").sortWithinPartitions("block", "role").mapInArrow(indexer(column, end, n_train), INDEXED), "indexed-blocks")
    kept = indexed.where("kind = 0")
    classes = class_table(by_id, pieces, end, met_sums(indexed, size))
    by_first[end] = n_train
    class_words = np.bincount(classes, weights=by_first, minlength=CLASSES)
    mass = np.bincount(classes, weights=by_id + SMOOTH, minlength=CLASSES)
    inside = np.log10((by_id + SMOOTH) / mass[classes])
    model = fitted(kept.mapInArrow(training_runs(classes, slices), RUNS), classes, slices)
    model.starts = starting(classes, pieces)
    inside_ln = inside * math.log(10)
    class_ln = np.log(np.maximum(1, np.stack([class_words, class_words - 1])))
    most = RATIO_MOST * RATIO_STEPS
    wide = 2 * most + 1

    def attended(block: Block) -> Iterator[tuple]:
        """Of each group of documents: doc_ids, words in each, and each word's count, log p(its first class), that class, and log p(its sub-words)."""
        kinds_of, fixed = classes[block.ids].astype(np.int64), np.add.reduceat(inside_ln[block.ids], np.cumsum(block.sizes) - block.sizes)
        for docs_of, per, at, each, heads, place in laid_out(block, 60_000):
            flat = kinds_of[place]
            tokens, start = score_tokens(model, flat, np.add.reduceat(each, np.cumsum(per) - per))
            word = np.add.reduceat(tokens, heads) + fixed[at] - start[heads]
            inner = np.ones(len(at), bool)
            inner[np.cumsum(per) - 1] = False  # after the end, nothing follows
            word[inner] += start[heads[1:]][inner[:-1]] if len(at) > 1 else 0
            yield docs_of, per, block.counts[at], tokens[heads] - start[heads], flat[heads], word

    def chances(counts: np.ndarray, lead: np.ndarray, first: np.ndarray, word: np.ndarray, own: int) -> np.ndarray:
        """Log-probabilities of words: by their share, by first class then share in it, and by sub-words; own occurrences left out."""
        with np.errstate(divide="ignore"):
            share = np.log(counts - own)
        return np.stack([share - math.log(max(1, total - own)), lead + share - class_ln[own][first], word])

    def add_cells(cells: np.ndarray, counts: np.ndarray, lead: np.ndarray, first: np.ndarray, word: np.ndarray) -> None:
        """Counts training words by the ratios of their second and third probability to the first, in steps (the last cell: the third alone)."""
        known = counts > 1
        cell = chances(counts[known], lead[known], first[known], word[known], 1)
        led, spelt = np.clip(np.rint((cell[1:] - cell[0]) * RATIO_STEPS), -most, most).astype(np.int64) + most
        np.add.at(cells, led * wide + spelt, 1)
        cells[-1] += len(known) - len(cell[0])

    def rows_of(cells: np.ndarray) -> list[pa.Array]:
        at = np.flatnonzero(cells)
        lone = at == wide * wide
        return [pa.array(v, pa.int64(), mask=m) for v, m in ((at // wide - most, lone), (at % wide - most, lone), (cells[at], None))]

    def some_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells of the training documents that the first weights are found by."""
        cells = np.zeros(wide * wide + 1, np.int64)
        for block in opened_blocks(batches):
            use = block.training() & np.asarray([crc32_text(d) // FOLDS % one_in == 0 for d in block.docs], bool)
            for _, _, *words in attended(block.only(use)):
                add_cells(cells, *words)
        yield pa.RecordBatch.from_arrays(rows_of(cells), [f.split()[0] for f in CELLS.split(", ")])

    def found_weights(cells: DataFrame) -> np.ndarray:
        cells = cells.groupBy("led", "spelt").agg(F.sum("n").alias("n")).orderBy("led", "spelt").toPandas()
        led, spelt = (np.exp(cells[c].to_numpy(float) / RATIO_STEPS) for c in ("led", "spelt"))
        lone = np.isnan(led)
        return mixture_weights(np.stack([np.where(lone, 0, 1.0), np.where(lone, 0, led), np.where(lone, 1.0, spelt)]), cells["n"].to_numpy(float))

    def scored_at(centre: np.ndarray) -> DataFrame:
        """Documents' scores at these weights with the sums by which near weights change them, and the cells of all training words."""
        names, types = [f.split()[0] for f in f"{SCORED}, {CELLS}".split(", ")], (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), *[pa.float64()] * 11, *[pa.int64()] * 3)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = np.zeros(wide * wide + 1, np.int64)
            for docs_of, per, *words in (group for block in opened_blocks(batches) for group in attended(block)):
                held = np.asarray([not trains(d) for d in docs_of])
                learnt = np.repeat(~held, per)
                add_cells(cells, *(v[learnt] for v in words))
                joint = chances(*words, 0) + np.log(centre)[:, None]
                near = np.logaddexp.reduce(joint)
                a, b = np.exp(joint[:2] - near)
                sums = [np.add.reduceat(v, np.cumsum(per) - per) for v in ((words[0] > 0).astype(np.int64), np.log10(words[0] + 0.1), near, a, b, a * a, a * b, b * b, a**3, a * a * b, a * b * b, b**3)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((docs_of, held, per, *sums), types)] + [pa.nulls(len(per), t) for t in types[-3:]], names)
            own = rows_of(cells)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(own[0]), t) for t in types[:-3]] + own, names)

        return written(kept.mapInArrow(score, f"{SCORED}, {CELLS}"), "near-scores")

    one_in = int(min(CENTRE, max(1, total // CENTRE_WORDS)))
    centre = found_weights(kept.mapInArrow(some_cells, CELLS))
    rows = scored_at(centre)
    weights = found_weights(rows.where("n is not null").select("led", "spelt", "n"))
    if not close_weights(weights, centre):
        centre, rows = weights, scored_at(weights)
    below = math.log10(total + 0.1 * (kinds + 1)) if total else None
    return rows.where("n is null").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("known_log10") - F.col("n_tokens") * F.lit(below).cast("double")).alias("base_score"), (F.expr(moved(weights, centre)) / math.log(10)).alias("score"))


def close_weights(weights: np.ndarray, centre: np.ndarray) -> bool:
    return bool(np.abs(weights / centre - 1).max() <= CLOSE)


def moved(weights: np.ndarray, centre: np.ndarray) -> str:
    """A document's log-probability at weights close to centre, as an SQL expression over the sums at centre.

    A word's probability grows by the factor 1 + z, where z is the mean of the weights' relative changes under the word's
    shares (a, b and 1 - a - b) of the three at centre. log(1 + z) is taken as z - z^2 / 2 + z^3 / 3; z is CLOSE at most,
    so a word's error is below 4e-5, and below 2e-6 where the weights change by half of that.
    """
    one, two, same = (float(t) for t in weights / centre - 1)
    z = {"": same, "a": one - same, "b": two - same}
    power, terms = {"": 1.0}, Counter()
    for factor in (1, -1 / 2, 1 / 3):
        raised: Counter = Counter()
        for p, u in power.items():
            for q, v in z.items():
                raised["".join(sorted(p + q))] += u * v
        power = raised
        for p, u in power.items():
            terms[p] += factor * u
    return " + ".join(["near", *(f"{p or 'n_tokens'} * {u!r}D" for p, u in terms.items())])


def op9_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end=50256)


QUERIES = {"op9_attention_lm": op9_attention_lm}
SQL: dict[str, str] = {}
