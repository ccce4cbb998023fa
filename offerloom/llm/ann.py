"""Operator 10, nearest neighbours by a block matrix join: int8 product tiles with error bounds, exact recomputation, heaps.

Usable vectors (not null, not zero, all components finite) are packed into blocks of the same length of vector. Each
two blocks meet once, in a grid of tasks (llm/grid.py). A tile is one join row whose size is fixed by the block sizes. Blocks travel as 32-bit
floats where these hold every component exactly, else as 64-bit ones.

In a tile both sides are rounded to int8 with a scale for each row. The integer products (exact in float32 below 2^24,
so vectors up to 1040 components; longer ones are taken in runs of components) give each inner product within
    |q.c - sq*sc*Q.C| <= sq/2 * |c|_1 + sc/2 * |q|_1 + n/4 * sq*sc,
and a pair whose upper bound lies under the query's k-th best lower bound in the tile cannot be among its k nearest
there. The others are recomputed in double precision, component after component, so equal vectors get equal scores.
A task merges the lists of k of a query block's tiles, and leaves out what the block has found k nearer of; the tasks'
lists are merged by a heap of k for each query.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part; vectors of different
lengths are never compared; a null vec_id takes no part; rows that repeat a vec_id are separate candidates, though a
query never finds its own vec_id; as queries, rows of one vec_id are one query for each different vector; ties go to the smaller vec_id; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import shuffle_width, table
from offerloom.llm.grid import sides, tiles

QUERY_BLOCK, VECTOR_BLOCK = 1024, 8192
#: Components whose int8 products add up exactly in float32.
EXACT_RUN = 1040
FOUND = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    parts = F.transform(vec_col, lambda x: x.cast("double"))
    fine = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), parts.alias("v")).where(fine)


def blocked(rows: DataFrame, size: int, count: int) -> DataFrame:
    """(dim, block, ids, values): rows packed into count blocks at random, each cut at size rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def out(dim):
            ids, values = held.pop(dim)
            values = np.asarray(values, "<f8")
            narrow = values.astype("<f4")
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.asarray(ids, "<i8").tobytes()], pa.binary()), pa.array([(narrow if (narrow == values).all() else values).tobytes()], pa.binary())], ["dim", "ids", "data"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = v.values.to_numpy(zero_copy_only=False)
                ids, values = held.setdefault(len(v), ([], []))
                ids.append(i)
                values.append(v)
                if len(ids) >= size:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    dealt = rows.repartition(count, F.xxhash64("id")) if count else rows
    return dealt.mapInArrow(pack, "dim int, ids binary, data binary")


def opened(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's ids and its vectors in double precision."""
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(data, "<f4" if len(data) == 4 * dim * len(ids) else "<f8").reshape(-1, dim).astype(np.float64)


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 values (in float32) and the scale of each row."""
    scale = np.abs(x).max(1) / 127
    return np.rint(x / scale[:, None]).astype(np.float32), scale


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, least: np.ndarray | float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of queries, vector ids, scores) that hold each query's k nearest among c, nearest first, ties to the smaller id.

    least: of each query, a score under which nothing is wanted."""
    qi, qs = rounded(q)
    ci, cs = rounded(c)
    dim = q.shape[1]
    dots = sum((qi[:, a : a + EXACT_RUN] @ ci[:, a : a + EXACT_RUN].T).astype(np.float64) for a in range(0, dim, EXACT_RUN))
    near = dots * qs[:, None] * cs[None, :]
    slack = (qs[:, None] / 2) * np.abs(c).sum(1)[None, :] + (cs[None, :] / 2) * np.abs(q).sum(1)[:, None] + dim / 4 * qs[:, None] * cs[None, :]
    slack = slack * (1 + 1e-9) + 1e-300
    own = q_ids[:, None] == c_ids[None, :]
    low = np.where(own, -np.inf, near - slack)
    m = low.shape[1]
    bar = np.partition(low, m - k, axis=1)[:, m - k] if m > k else np.full(len(q), -np.inf)
    keep = (near + slack >= np.maximum(bar, least)[:, None]) & ~own
    rows, cols = np.nonzero(keep)
    scores = np.zeros(len(rows))
    for d in range(dim):
        scores += q[rows, d] * c[cols, d]
    order = np.lexsort((c_ids[cols], -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    starts = np.searchsorted(rows, np.arange(len(q)))
    best = np.arange(len(rows)) - starts[rows] < k
    return rows[best], c_ids[cols[best]], scores[best]


class Best:
    """The k nearest that a block of queries has met so far, from tile to tile."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int):
        self.q_ids, self.q, self.k = q_ids, q, k
        self.least = np.full(len(q), -np.inf)
        self.found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def meet(self, c_ids: np.ndarray, c: np.ndarray) -> None:
        parts = [self.found]
        for a in range(0, len(self.q), 256):
            b = a + 256
            at, vecs, scores = tile(self.q_ids[a:b], self.q[a:b], c_ids, c, self.k, self.least[a:b])
            parts.append((at + a, vecs, scores))
        at, vecs, scores = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((vecs, -scores, at))
        at, vecs, scores = at[order], vecs[order], scores[order]
        nth = np.arange(len(at)) - np.searchsorted(at, np.arange(len(self.q)))[at]
        self.least[at[nth == self.k - 1]] = scores[nth == self.k - 1]
        keep = nth < self.k
        self.found = at[keep], vecs[keep], scores[keep]

    def batch(self) -> pa.RecordBatch:
        at, vecs, scores = self.found
        prints = np.asarray([xxhash.xxh3_64_intdigest(v.tobytes()) for v in self.q], np.uint64).view(np.int64)  # tell vectors of one id apart
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.q_ids[at], prints[at], vecs, scores)], ["query_id", "print", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest of every query row by inner product; is_query is a condition on the id, named "id"."""
    width = shuffle_width(vectors.sparkSession)
    rows = usable(vectors, id_col, vec_col)
    asked = rows.where(is_query).dropDuplicates(["id", "v"])
    n, m = (f.count() for f in (vectors, asked))
    blocks, q_blocks = max(1, -(-n // VECTOR_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    met = tiles(blocked(asked, QUERY_BLOCK, q_blocks), blocked(rows, VECTOR_BLOCK, blocks), *sides(q_blocks, blocks, width, VECTOR_BLOCK / QUERY_BLOCK), "ids")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None

        def told() -> Iterator[pa.RecordBatch]:
            if best is not None:
                yield best.batch()

        for batch in batches:
            for r in range(batch.num_rows):
                dim, q_ids, q_data, ids, data = (batch.column(x)[r].as_py() for x in ("dim", "ids", "data", "c_ids", "c_data"))
                if (dim, q_ids, q_data) != now:  # the tiles of one query block follow each other
                    yield from told()
                    now, best = (dim, q_ids, q_data), Best(*opened(q_ids, q_data, dim), k)
                best.meet(*opened(ids, data, dim))
        yield from told()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple[int, int], list[tuple[float, int]]] = {}
        for batch in batches:
            for query, own, vec, score in zip(*(batch.column(x).to_pylist() for x in ("query_id", "print", "vec_id", "score"))):
                heap = heaps.setdefault((query, own), [])
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                else:
                    heapq.heappushpop(heap, (score, -vec))
        for (query, _), heap in heaps.items():
            heap.sort(reverse=True)
            yield pa.RecordBatch.from_arrays([pa.array([query] * len(heap)), pa.array(range(1, len(heap) + 1), pa.int32()), pa.array([-v for _, v in heap]), pa.array([s for s, _ in heap])], ["query_id", "rank", "vec_id", "score"])

    found = met.mapInArrow(multiply, "query_id long, print long, vec_id long, score double")
    return found.repartition(width, "query_id").mapInArrow(merge, FOUND)


def op10_nearest_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


QUERIES = {"op10_nearest_blocks": op10_nearest_blocks}
SQL = {
    "op10_nearest_blocks": """
WITH usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, q.v AS v, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
  FROM (SELECT DISTINCT vec_id, v FROM usable WHERE vec_id % 20 = 0) q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
}
