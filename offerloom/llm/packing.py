"""Operator 4, packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

Documents become token ids (null and empty text: the end id alone). A document longer than a sequence is cut into full
sequences and a rest. All pieces are dealt to groups by a hash of (doc_id, start, ids) and of the row's number within
its input partition, so that neither a key nor rows that are equal in all decide a group's size, and each group packs on its own: only piece records of a few numbers are shuffled, never text or ids.

Defined cases: null doc_id is kept as null; repeated rows give repeated pieces; an empty table gives an empty table;
other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import lean_batches, table
from offerloom.llm.subword import encoder, runs, tokenizer_path

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long, sequence_tokens long, padded_length long"

#: Documents that a group holds on average: enough for first-fit decreasing to leave next to no padding.
GROUP_DOCS = 2000


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """A row for each piece: where it starts in its document, its length and the crc32 of its ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.asarray([end_id], "<u4")
        for batch in runs(batches):
            ids, offsets = enc.many(batch.column(1))
            rows: list[tuple] = []
            for doc, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                own = np.append(ids[a:b], end)
                total = len(own)
                rows += ((doc, at, len(part), zlib.crc32(part), total) for at in range(0, total, capacity) for part in (own[at : at + capacity],))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, PIECES)


class CapacityTree:
    """A tournament over bins: each inner node holds the larger free capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.size)

    def place(self, need: int) -> int:
        """Takes need from the first bin with room; there is always one."""
        free, at = self.free, 1
        while at < self.size:
            at *= 2
            if free[at] < need:
                at += 1
        free[at] -= need
        found = at - self.size
        while at > 1:
            at >>= 1
            top = max(free[2 * at], free[2 * at + 1])
            if free[at] == top:
                break
            free[at] = top
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length; lengths must come in decreasing order."""
    tree = CapacityTree(max(1, len(lengths)), capacity)
    filled: dict[int, int] = {}
    bins, offsets = [], []
    for n in lengths:
        b = tree.place(n)
        bins.append(b)
        offsets.append(filled.get(b, 0))
        filled[b] = offsets[-1] + n
    return bins, offsets


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 1024, group_docs: int = GROUP_DOCS, seed: int = 17) -> DataFrame:
    """Packs whole documents into sequences of at most capacity tokens; returns a row for each piece."""
    lean_batches(docs.sparkSession)
    groups = max(1, math.ceil(docs.count() / group_docs))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, rows["offset"] = first_fit_decreasing(rows["length"].tolist(), capacity)
        rows["sequence_id"] = rows["pack_group"].astype("int64") * (1 << 32) + np.asarray(bins, dtype="int64")
        rows["sequence_tokens"] = rows.groupby("sequence_id")["length"].transform("sum")
        fill = rows["sequence_tokens"].to_numpy()
        rows["padded_length"] = np.where(fill & (fill - 1) == 0, fill, capacity)
        return rows[[c.split()[0] for c in PACKED.split(", ")]]

    dealt = pieces(docs, path, end_id, capacity).withColumn("pack_group", F.expr(f"pmod(xxhash64(doc_id, start, ids_crc32, monotonically_increasing_id(), {int(seed)}), {groups})"))
    return dealt.groupBy("pack_group").applyInPandas(fill, PACKED)


def op4_pack_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=1024)


QUERIES = {"op4_pack_first_fit": op4_pack_first_fit}
SQL: dict[str, str] = {}
