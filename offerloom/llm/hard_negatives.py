"""Operator 11, hard negatives by a pivot table: inner products bracketed by the triangle inequality, survivors checked exactly.

Each vector x is augmented by sqrt(M^2 - |x|^2), M^2 being the largest squared length, and each anchor q by 0; then
    |q' - x'|^2 = |q|^2 + M^2 - 2 q.x,
so that the order of inner products is the order of Euclidean distances. A few pivots are picked among the vectors
(farthest first, out of one vector for each of PIVOT_SAMPLE hash buckets: a bounded sample, which decides the speed and no
result). The pivot table holds every row's distances to them, in blocks of rows with the same nearest pivot, and each
block's least and greatest distance to every pivot. For a pivot p,
    |d(q, p) - d(x, p)| <= d(q, x) <= d(q, p) + d(x, p)
brackets a whole block's and then each row's score. Blocks and rows whose bracket lies outside of what an anchor still
wants are left out, and the others' integer inner products are worked out exactly.

Blocks of anchors meet blocks of rows in a grid of tasks, twice: once for each anchor's nearest rows of its own label,
then for the nearest rows of other labels within the window that each of those positives sets. A task keeps a list for
each anchor and window from tile to tile; the tasks' lists are merged by rank. The pivot table and the positives are
written to the shared folder, so a lost executor costs no more than a stage.

Defined cases: rows with a null id, label or vector, or with any null or non-finite component take no part; nor do rows
whose squared integer length is 2^62 or more, as their scores need not fit 64 bits. Zero and empty vectors take part.
Vectors of different lengths are never compared. Rows that repeat an id are separate candidates, though an anchor never
finds its own id; as anchors, rows with the same id, label and vector are one. Ties go to the smaller id. A negative
positive score has no window, so its pair gives no row. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import shuffle_width, table, written
from offerloom.llm.grid import sides, tiles

ANCHOR_BLOCK, ROW_BLOCK = 512, 4096
PIVOTS, PIVOT_SAMPLE = 16, 256
LEAST, GREATEST = -(1 << 63), (1 << 63) - 1
#: Above this share of survivors a tile is multiplied whole, which is quicker than pair by pair.
DENSE = 1 / 32

_FOUND = "id long, print long, slot int, found long, score long"


def usable(vectors: DataFrame, id_col: str, label: Column, vec_col: str, scale: int) -> DataFrame:
    """(id, label, v, print): rows that take part; v holds the integer components, as doubles."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(vec_col, lambda x: x.cast("double")).alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    rows = rows.select("id", "label", F.transform("x", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return rows.where(square < float(1 << 62)).select("id", "label", "v", F.xxhash64("label", "v").alias("print"), square.alias("square"))


class Pivots:
    """The augmented space: M^2, and the pivots of each length of vector."""

    def __init__(self, picked: list[list[float]], most: float, count: int = PIVOTS):
        self.most = most
        self.of: dict[int, np.ndarray] = {}
        for dim in {len(v) for v in picked}:
            own = np.asarray([v for v in picked if len(v) == dim], np.float64).reshape(sum(len(v) == dim for v in picked), dim)
            apart = np.full(len(own), np.inf)
            order = []
            while len(order) < min(count, len(own)):
                order.append(int(np.argmax(apart)))
                apart = np.minimum(apart, self.apart(own, own[order[-1:]])[:, 0])
                if apart.max() <= 0:
                    break
            self.of[dim] = own[order]

    def extra(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - (x * x).sum(1), 0))

    def apart(self, x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """Distances of augmented rows from augmented pivots."""
        return np.sqrt(np.maximum(2 * self.most - 2 * (x @ pivots.T + np.outer(self.extra(x), self.extra(pivots))), 0))

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.apart(x, self.of.get(x.shape[1], x[:0]))

    def anchors(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.most - 2 * q @ self.of.get(q.shape[1], q[:0]).T, 0))


def pivots(rows: DataFrame, most: float) -> Pivots:
    """One vector of each hash bucket, that of the least id, is all that reaches the driver."""
    picked = rows.groupBy(F.pmod(F.xxhash64("id", "print"), F.lit(PIVOT_SAMPLE)).alias("bucket")).agg(F.min(F.struct("id", "v")).alias("least")).select("bucket", "least.v")
    return Pivots([list(r.v) for r in sorted(picked.collect(), key=lambda r: r.bucket)], most)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _by_length(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = np.diff(batch.column(name).offsets.to_numpy())
    for dim in np.unique(lengths):
        yield int(dim), batch.take(pa.array(np.flatnonzero(lengths == dim)))


def pivot_table(rows: DataFrame, space: Pivots, blocks: int) -> DataFrame:
    """Blocks of rows near to the same pivot: (dim, ids, labels, data, apart, near, far), written to the shared folder."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim, batch in _by_length(whole, "v"):
                apart = space.rows(_matrix(batch.column("v"), dim))
                cell = apart.argmin(1) if apart.shape[1] else np.zeros(len(apart), np.int64)
                near = apart.min(1) if apart.shape[1] else np.zeros(len(apart))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(near), batch.column("id"), batch.column("label"), batch.column("v")], ["dim", "cell", "near", "id", "label", "v"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            rows = pa.concat_batches(held)
            dim = rows.column("dim")[0].as_py()
            x = _matrix(rows.column("v"), dim)
            apart = space.rows(x)
            return _block(dim, rows, x, apart, [apart.min(0).tobytes(), apart.max(0).tobytes()], ["near", "far"])

        for batch in batches:
            ends = np.flatnonzero(np.diff(batch.column("dim").to_numpy(), append=-1) != 0) + 1
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                for at in range(a, b, ROW_BLOCK):
                    part = batch.slice(at, min(ROW_BLOCK, b - at))
                    if held and (sum(map(len, held)) + len(part) > ROW_BLOCK or held[0].column("dim")[0] != part.column("dim")[0]):
                        yield out()
                        held.clear()
                    held.append(part)
        if held:
            yield out()

    dealt = rows.select("id", "label", "v").mapInArrow(placed, "dim int, cell int, near double, id long, label long, v array<double>")
    order = ["dim", "cell", "near", "id"]  # an id ends the order, so that a pivot with very many near rows is cut too
    packed = dealt.repartitionByRange(blocks, *order).sortWithinPartitions(*order).mapInArrow(pack, "dim int, ids binary, labels binary, data binary, apart binary, near binary, far binary")
    return written(packed, "pivot-table")


def _block(dim: int, rows: pa.RecordBatch, x: np.ndarray, apart: np.ndarray, more: list, names: list[str]) -> pa.RecordBatch:
    data = x.astype("<i4") if np.abs(x).max(initial=0) < 1 << 31 else x.astype("<i8")
    cells = [rows.column("id").to_numpy().tobytes(), rows.column("label").to_numpy().tobytes(), data.tobytes(), apart.tobytes(), *more]
    return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], ["dim", "ids", "labels", "data", "apart", *names])


def anchor_blocks(anchors: DataFrame, space: Pivots, blocks: int) -> DataFrame:
    """Blocks of anchors: (dim, ids, labels, data, apart, prints, slots); slots: anchor's place, slot, least and greatest score wanted."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim, rows in _by_length(whole, "v"):
                for at in range(0, len(rows), ANCHOR_BLOCK):
                    part = rows.slice(at, ANCHOR_BLOCK)
                    q = _matrix(part.column("v"), dim)
                    slots = [(k, s["slot"], s["low"], s["high"]) for k, own in enumerate(part.column("slots").to_pylist()) for s in own]
                    yield _block(dim, part, q, space.anchors(q), [part.column("print").to_numpy().tobytes(), np.asarray(slots, "<i8").reshape(-1, 4).tobytes()], ["prints", "slots"])

    dealt = anchors.repartition(blocks, F.xxhash64("id", "print"))
    return dealt.select("id", "label", "v", "print", "slots").mapInArrow(pack, "dim int, ids binary, labels binary, data binary, apart binary, prints binary, slots binary")


class Wanted:
    """What a block of anchors has found so far, from tile to tile: the k best of each slot."""

    def __init__(self, dim: int, ids: bytes, labels: bytes, data: bytes, apart: bytes, prints: bytes, slots: bytes, most: float, same: bool, k: int):
        self.ids, self.labels, self.prints = (np.frombuffer(x, "<i8") for x in (ids, labels, prints))
        n = len(self.ids)
        self.q, self.apart = _opened(data, n, dim), np.frombuffer(apart).reshape(n, -1)
        self.square = (self.q.astype(np.float64) ** 2).sum(1)
        self.most, self.same, self.k = most, same, k
        self.at, self.slot, self.low, self.high = np.frombuffer(slots, "<i8").reshape(-1, 4).T
        self.least = self.low.copy()
        self.nth = np.arange(len(self.at)) - np.searchsorted(self.at, self.at)  # which of its anchor's slots it is
        self.found = (np.empty(0, np.int64),) * 3
        self.checked = self.met = 0

    def bracket(self, at: np.ndarray, nearest: np.ndarray, farthest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest and least score at distances from nearest to farthest; rounding is allowed for."""
        base = (self.square[at] + self.most).reshape(-1, *[1] * (nearest.ndim - 1))
        slack = 1e-9 * base + 1
        return (base - nearest**2) / 2 + slack, (base - farthest**2) / 2 - slack

    def meet(self, ids: bytes, labels: bytes, data: bytes, apart: bytes, near: bytes, far: bytes) -> None:
        ids, labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        dim = self.q.shape[1]
        apart, near, far = np.frombuffer(apart).reshape(len(ids), -1), np.frombuffer(near), np.frombuffer(far)
        self.met += len(ids) * len(self.ids)
        every = np.arange(len(self.ids))
        top, bottom = self.bracket(every, np.maximum(np.maximum(self.apart - far, near - self.apart), 0).max(1, initial=0), (self.apart + far).min(1, initial=np.inf))
        live = (top[self.at] >= self.least) & (bottom[self.at] <= self.high)
        who = np.unique(self.at[live])
        if not len(who):
            return
        least, most = np.full(len(every), np.inf), np.full(len(every), -np.inf)
        np.minimum.at(least, self.at[live], self.least[live].astype(np.float64))
        np.maximum.at(most, self.at[live], self.high[live].astype(np.float64))
        nearest, farthest = np.zeros((len(who), len(ids))), np.full((len(who), len(ids)), np.inf)
        for p in range(apart.shape[1]):
            mine, theirs = self.apart[who, p][:, None], apart[:, p][None, :]
            np.maximum(nearest, np.abs(mine - theirs), out=nearest)
            np.minimum(farthest, mine + theirs, out=farthest)
        top, bottom = self.bracket(who, nearest, farthest)
        alike = self.labels[who][:, None] == labels[None, :]
        maybe = (alike if self.same else ~alike) & (self.ids[who][:, None] != ids[None, :]) & (top >= least[who][:, None]) & (bottom <= most[who][:, None])
        rows, cols = np.nonzero(maybe)
        self.checked += len(rows)
        scores = self.exact(who, rows, cols, _opened(data, len(ids), dim))
        rows, cols, scores = who[rows], ids[cols], scores
        fine = (scores >= least[rows]) & (scores <= most[rows])
        rows, cols, scores = rows[fine], cols[fine], scores[fine]
        parts = [self.found]
        for j in range(self.nth.max(initial=-1) + 1):  # each anchor's j-th slot
            slot_of = np.full(len(every), -1)
            slot_of[self.at[self.nth == j]] = np.flatnonzero(self.nth == j)
            slot = slot_of[rows]
            use = (slot >= 0) & (scores >= self.least[slot]) & (scores <= self.high[slot])
            parts.append((slot[use], cols[use], scores[use]))
        slot, found, scores = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((found, -scores, slot))
        slot, found, scores = slot[order], found[order], scores[order]
        nth = np.arange(len(slot)) - np.searchsorted(slot, slot)
        self.least[slot[nth == self.k - 1]] = scores[nth == self.k - 1]
        self.found = tuple(x[nth < self.k] for x in (slot, found, scores))

    def exact(self, who: np.ndarray, rows: np.ndarray, cols: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Integer inner products: in doubles where these hold every partial sum, else in 64-bit integers."""
        q = self.q[who]
        longest = np.sqrt(self.square[who].max(initial=0) * (x.astype(np.float64) ** 2).sum(1).max(initial=0))
        kind = np.float64 if longest < 1 << 52 else np.int64
        q, x = q.astype(kind), x.astype(kind)
        if len(rows) > DENSE * len(q) * len(x):
            return (q @ x.T)[rows, cols].astype(np.int64)
        return np.concatenate([np.empty(0, kind), *((q[rows[a : a + 65536]] * x[cols[a : a + 65536]]).sum(1) for a in range(0, len(rows), 65536))]).astype(np.int64)

    def batch(self) -> pa.RecordBatch:
        slot, found, scores = self.found
        at = self.at[slot]
        return pa.RecordBatch.from_arrays([pa.array(self.ids[at]), pa.array(self.prints[at]), pa.array(self.slot[slot].astype(np.int32)), pa.array(found), pa.array(scores)], ["id", "print", "slot", "found", "score"])


def _opened(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i4" if len(data) == 4 * dim * n else "<i8").reshape(n, dim)


def best(anchors: DataFrame, table_of: DataFrame, space: Pivots, q_blocks: int, blocks: int, same: bool, k: int) -> DataFrame:
    """(id, print, slot, found, score, nth): the k best of every anchor's slots, among rows of its label or of others."""
    rows, columns = sides(q_blocks, blocks, shuffle_width(anchors.sparkSession), ROW_BLOCK / ANCHOR_BLOCK)
    met = tiles(anchor_blocks(anchors, space, q_blocks), table_of, rows, columns, "ids")
    own, theirs = ("dim", "ids", "labels", "data", "apart", "prints", "slots"), ("c_ids", "c_labels", "c_data", "c_apart", "c_near", "c_far")
    most = space.most

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, wanted = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                anchor = tuple(batch.column(c)[r].as_py() for c in own)
                if anchor != now:  # the tiles of one block of anchors follow each other
                    if wanted is not None:
                        yield wanted.batch()
                    now, wanted = anchor, Wanted(*anchor, most, same, k)
                wanted.meet(*(batch.column(c)[r].as_py() for c in theirs))
        if wanted is not None:
            yield wanted.batch()

    found = met.select(*own, *theirs).mapInArrow(search, _FOUND)
    return found.selectExpr("*", "row_number() over (partition by id, print, slot order by score desc, found) as nth").where(f"nth <= {k}")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3,
    low_percent: int = 50, high_percent: int = 95, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """For each anchor and each of its nearest rows of the same label, the nearest rows of other labels with a score from low_percent to high_percent of the positive's.

    is_anchor is a condition on the id, named "id". Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = usable(vectors, id_col, F.col("label") if label is None else label, vec_col, scale)
    known = rows.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors"), F.max("square").alias("most")).first()
    space = pivots(rows, known.most or 0.0)
    blocks, q_blocks = max(1, -(-known.n // ROW_BLOCK)), max(1, -(-known.anchors // ANCHOR_BLOCK))
    stored = pivot_table(rows, space, blocks)
    anchors = rows.where(is_anchor).groupBy("id", "label", "v", "print").agg(F.count("*").alias("copies")).drop("copies")
    every = F.array(F.struct(F.lit(0).alias("slot"), F.lit(LEAST).alias("low"), F.lit(GREATEST).alias("high")))
    near = written(best(anchors.withColumn("slots", every), stored, space, q_blocks, blocks, True, positives).selectExpr("id", "print", "nth as slot", "found as positive_id", "score as positive_score"), "positives")
    # in decimals, as a hundred times a score need not fit 64 bits
    share = lambda percent, way: f"cast({way}(cast(positive_score as decimal(20, 0)) * {percent} / 100) as bigint)"
    windows = near.where("positive_score >= 0").selectExpr("id", "print", f"struct(slot, {share(low_percent, 'ceil')} as low, {share(high_percent, 'floor')} as high) as w").groupBy("id", "print").agg(F.sort_array(F.collect_list("w")).alias("slots"))
    found = best(anchors.join(windows, ["id", "print"]), stored, space, q_blocks, blocks, False, negatives)
    pairs = found.selectExpr("id", "print", "slot", "nth as rank", "found as negative_id", "score as negative_score").join(near, ["id", "print", "slot"])
    return pairs.selectExpr("id as anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_pivot_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label, positives=5, negatives=3, low_percent=50, high_percent=95)


QUERIES = {"op11_pivot_hard_negatives": op11_pivot_hard_negatives}
SQL = {
    "op11_pivot_hard_negatives": """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM usable a JOIN usable c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
  AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 3
"""
}
