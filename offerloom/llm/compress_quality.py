"""Operator 3, quality: a compression classifier over zstandard dictionaries of good and of bad labelled text.

Two dictionaries are trained by zstandard on labelled texts, one on each kind, and two more on their shapes: letters,
capitals and digits each become one character, other ASCII stays; a third pair comes from shapes whose letter runs are
one letter each. For each form of a text the score sees one number, the normalised difference
    (size under the good dictionary - size under the bad one) / size without a dictionary,
and nothing else of the text. Logistic regression on the three differences, their squares and products, fitted on
labelled texts that the dictionaries did not see, calibrates them; each kind weighs there as it does among all labels,
however many of its documents are sampled.

The fit uses a bounded sample: the DICTIONARY_DOCS + CALIBRATION_DOCS labelled documents of each kind with the least
hash of their id, of which only those outside the held-out fold count; their texts are used in whole. Every document is
scored, in whole.

Defined cases: null and empty texts score as the empty text (differences of the empty frame); a null doc_id is in fold 0, so held out; labels that are null, repeat or disagree are dropped; without
labels of both kinds every score is 0.5; repeated rows give repeated results; an empty table gives an empty table; other
columns, and clashing ones of labels, are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import id_fold, lean_batches, table

FOLDS = 5
DICTIONARY_DOCS, CALIBRATION_DOCS = 400, 1200
#: Bytes of a dictionary.
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
SCORED = "doc_id long, held_out boolean, score double"
THRESHOLD = 0.3


def dictionary(texts: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on the texts; of texts too few or too alike to train on, their own content, of which a dictionary of that size holds the last DICTIONARY_BYTES."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"\n".join(texts)[-DICTIONARY_BYTES:] or b"\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


_SHAPE = bytes(ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b for b in range(256))


_RUN = re.compile(rb"[aA0]+")


def forms(text: bytes) -> tuple[bytes, bytes, bytes]:
    """A text, its shape, and its shape with runs of letters and digits as one letter."""
    shape = text.translate(_SHAPE)
    return text, shape, _RUN.sub(b"a", shape)


def trained(good: list[bytes], bad: list[bytes]) -> list[tuple[tuple[bytes, int], tuple[bytes, int]]]:
    """Of each form, the good and the bad dictionary, as (content, kind), which travel to the workers."""
    found = [(dictionary([forms(t)[k] for t in good]), dictionary([forms(t)[k] for t in bad])) for k in range(3)]
    return [tuple((d.as_bytes(), zstandard.DICT_TYPE_FULLDICT if d.dict_id() else zstandard.DICT_TYPE_RAWCONTENT) for d in pair) for pair in found]


class Differences:
    """Normalised differences of a text's compressed sizes under good and bad dictionaries, of its three forms."""

    def __init__(self, dictionaries: list[tuple[tuple[bytes, int], tuple[bytes, int]]]):
        self.plain = self._compressor(None)
        self.pairs = [tuple(map(self._compressor, pair)) for pair in dictionaries]

    @staticmethod
    def _compressor(given: tuple[bytes, int] | None) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(given[0], dict_type=given[1]) if given else None
        if held:
            held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)

    def of(self, text: bytes) -> list[float]:
        return [(len(good.compress(form)) - len(bad.compress(form))) / len(self.plain.compress(form)) for form, (good, bad) in zip(forms(text), self.pairs)]


def curve(differences: np.ndarray) -> np.ndarray:
    """What the regression sees: 1, the differences, their squares and products."""
    x = differences.reshape(-1, 3)
    return np.column_stack([np.ones(len(x)), x, *(x[:, i] * x[:, j] for i in range(3) for j in range(i, 3))])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Newton steps of logistic regression on weighted rows."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[dict[int, list[bytes]], dict[int, int]]:
    """Texts of each kind in the order of a hash of their ids, bounded by the constants, and the number of all labels of each."""
    fine = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("kind")).where("doc_id is not null")
    fine = fine.groupBy("doc_id").agg(F.min("kind").alias("kind"), F.max("kind").alias("most"), F.count("*").alias("n"), F.count("kind").alias("known")).where("kind = most and n = known and kind in (0, 1)")
    fine = fine.where(id_fold(F.col("doc_id"), FOLDS) != 0)
    wanted = DICTIONARY_DOCS + CALIBRATION_DOCS
    picked = None
    for kind in (0, 1):
        one = fine.where(f"kind = {kind}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(wanted).select("doc_id", "kind")
        picked = one if picked is None else picked.union(one)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "kind").agg(F.min("text").alias("text")).collect()  # 2 * wanted rows at most
    found.sort(key=lambda r: (_order(r.doc_id), r.doc_id))
    many = {r.kind: r["count"] for r in fine.groupBy("kind").count().collect()}
    return {k: [r.text.encode() for r in found if r.kind == k] for k in (0, 1)}, many


def _order(doc: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(str(doc))


def fitted(sample: dict[int, list[bytes]], many: dict[int, int]) -> tuple[list, np.ndarray | None]:
    """Dictionaries, and the weights of the calibration; without labels of both kinds, none."""
    if any(len(v) < 2 for v in sample.values()):
        return [], None
    cut = {k: min(DICTIONARY_DOCS, len(v) // 2) for k, v in sample.items()}
    dictionaries = trained(*(sample[k][: cut[k]] for k in (1, 0)))
    differences = Differences(dictionaries)
    seen = [(differences.of(t), k) for k in (0, 1) for t in sample[k][cut[k] :]]
    kinds = np.asarray([k for _, k in seen], float)
    each = {k: many[k] / max(1, (kinds == k).sum()) for k in (0, 1)}
    weight = np.where(kinds == 1, each[1], each[0])
    return dictionaries, logistic(curve(np.asarray([d for d, _ in seen])), kinds, weight * len(seen) / weight.sum())


def quality_scores(docs: DataFrame, labels: DataFrame, text_print: bool = False) -> DataFrame:
    """doc_id, held_out and score of every document; text_print adds a hash of the text (null: empty)."""
    lean_batches(docs.sparkSession)
    dictionaries, weights = fitted(*labelled_sample(docs, labels))
    more = ["text_print"] if text_print else []

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        differences = Differences(dictionaries)
        for batch in batches:
            if weights is None:
                scores = np.full(batch.num_rows, 0.5)
            else:
                found = curve(np.asarray([differences.of((t.as_py() or "").encode()) for t in batch.column("text")]))
                scores = 1 / (1 + np.exp(-np.clip(found @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), *(batch.column(c) for c in more)], ["doc_id", "held_out", "score", *more])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "text", *([F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_print")] if text_print else []))
    return kept.mapInArrow(score, SCORED + (", text_print long" if text_print else ""))


def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


QUERIES = {"op3_compression_quality": op3_compression_quality}
SQL: dict[str, str] = {}
