"""Group operators of the catalogue that Spark has no single function for."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unanimous(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The value of each key whose known values agree."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("_most")).where(F.col(value) == F.col("_most")).drop("_most")


def mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each key; ties go to the larger."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.max(F.struct("n", value)).alias("x")).select(*keys, F.col(f"x.{value}").alias(value), F.col("x.n").alias("n"))


def leave_one_out_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "others") -> DataFrame:
    """The exact median of the other rows of a key, from two ranks instead of a self-join of each key with itself.

    Without the row of rank r, the n - 1 other values keep their order, so their median is one or two of at most three
    neighbouring ranks around the middle, which are collected once for each key.
    """
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(value).over(w))
    half = F.floor(F.col("_n") / 2).cast("int")
    near = ranked.withColumn("_at", F.when(F.abs(F.col("_r") - half) <= 2, F.struct("_r", F.col(value).cast("double").alias("v"))))
    near = near.withColumn("_mid", F.map_from_entries(F.array_sort(F.collect_list("_at").over(w))))
    m = F.col("_n") - 1  # number of the others

    def other(k: Column) -> Column:
        """The k-th of the others, counted from 1."""
        return F.try_element_at("_mid", (k + F.when(k >= F.col("_r"), 1).otherwise(0)).cast("int"))

    low, high = F.floor((m + 1) / 2), F.floor((m + 2) / 2)
    return near.withColumn(out, F.when(m >= 1, (other(low) + other(high)) / 2)).drop("_r", "_n", "_at", "_mid")


def round_robin(df: DataFrame, family: str, *order: Column, each: int | None = None, limit: int = 1000) -> DataFrame:
    """rank: rows take turns by family, in order, up to a limit of the whole row; each bounds a family's turns."""
    turns = df.withColumn("_k", F.row_number().over(Window.partitionBy(family).orderBy(*order)))
    if each is not None:
        turns = turns.where(F.col("_k") <= each)
    head = turns.orderBy("_k", *order).limit(limit)  # only so many rows are ranked in one place
    return head.withColumn("rank", F.row_number().over(Window.orderBy("_k", *order))).drop("_k")


def histogram(df: DataFrame, value: str, buckets: int = 12, step: int = 1000) -> DataFrame:
    """Counts and running totals of buckets up to the 95th percentile, rounded up to a step; the last holds the rest."""
    top = df.agg((F.ceil(F.percentile(value, 0.95) / step) * step).alias("_top"))
    cut = df.crossJoin(top).withColumn("bucket", F.width_bucket(F.col(value).cast("double"), F.lit(0.0), F.col("_top").cast("double"), F.lit(buckets)))
    counted = cut.groupBy("bucket").agg(F.count("*").alias("n"))
    return counted.withColumn("cumulated", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))


def split_by_gap(df: DataFrame, keys: Sequence[str], value: str, ratio: float) -> DataFrame:
    """part: rows of a key in order of value, a new part wherever the next value is ratio times the one before."""
    w = Window.partitionBy(*keys).orderBy(value)
    jump = F.coalesce(F.col(value) / F.lag(value).over(w) >= ratio, F.lit(False)).cast("int")
    return df.withColumn("_j", jump).withColumn("part", F.sum("_j").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_j")


def value_families(df: DataFrame, keys: Sequence[str], value: str, tolerance: float = 0.01) -> DataFrame:
    """The largest family of values within a tolerance of one of them, by each key; ties go to the higher values.

    Returns the keys, the family's greatest value under the value's name, its least one as family_low, and members (rows).
    A key's distinct values are read in order, with two pointers that follow each value at the ends of its family, so a
    task holds the values of one family's width and no pairs are formed. Null values are left out.
    """
    share = Fraction(str(tolerance))
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("members"))
    names = [f"`{k}`" for k in keys]
    ordered = counted.repartition(*names).sortWithinPartitions(*names, f"`{value}`").select(F.struct(*names).alias("key"), F.col(value).alias("v"), "members")
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}

    def near(x, y) -> bool:
        return abs(x - y) * share.denominator <= share.numerator * max(x, y)

    class Scan:
        """One key's values in order: the rows before each value, the families that may still grow, the best one so far."""

        def __init__(self):
            self.rows, self.last, self.best = 0, None, None
            self.values: deque = deque()  # (value, rows before it), from the least that a later family may hold
            self.open: deque = deque()  # (value whose family it is, the family's least value, rows before that)

        def add(self, v, n: int) -> None:
            self.close(lambda x: not near(x, v))
            self.values.append((v, self.rows))
            while not near(self.values[0][0], v):
                self.values.popleft()
            self.open.append((v, *self.values[0]))
            self.rows, self.last = self.rows + n, v

        def close(self, done) -> None:
            while self.open and done(self.open[0][0]):
                _, low, before = self.open.popleft()
                found = (self.rows - before, self.last, low)
                self.best = found if self.best is None or found[:2] > self.best[:2] else self.best

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, out = None, None, []

        def told() -> pa.RecordBatch:
            cols = zip(*((k, top, low, members) for k, (members, top, low) in out))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, of, of, pa.int64()))], ["key", "v", "family_low", "members"])

        for batch in batches:
            kind, of = batch.schema.field("key").type, batch.schema.field("v").type
            for k, v, n in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or k != key:
                    if now is not None:
                        now.close(lambda x: True)
                        out.append((key, now.best))
                    key, now = k, Scan()
                now.add(v, n)
            if out:
                yield told()
                out = []
        if now is not None:
            now.close(lambda x: True)
            out.append((key, now.best))
            yield told()

    found = ordered.mapInArrow(scan, f"key {kinds['key']}, v {kinds['v']}, family_low {kinds['v']}, members long")
    return found.select("key.*", F.col("v").alias(value), "family_low", "members")


def mutually_only(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, value: str, ratio: float) -> DataFrame:
    """(a, b): rows of a key whose values lie within a ratio of each other, each being the other's only such row.

    What fits a value is a run of the other side's values in order, around it, so a row's two neighbours on either side tell
    whether there is none, one or more: no pairs are formed. Values must be above zero; nulls match nothing."""
    one = left.select(*keys, F.col(value).alias("v"), F.struct(F.col(value).alias("v"), F.col(a).alias("id")).alias("l"), F.lit(None).alias("r"))
    two = right.select(*keys, F.col(value).alias("v"), F.lit(None).alias("l"), F.struct(F.col(value).alias("v"), F.col(b).alias("id")).alias("r"))
    names = ", ".join(f"`{k}`" for k in keys)

    def neighbours(side: str) -> str:
        return f"array({', '.join(f'{way}({side}, {n}) ignore nulls over w' for way in ('lag', 'lead') for n in (1, 2))})"

    rows = one.unionByName(two).where("v > 0")
    around = rows.withColumns({k: F.expr(neighbours(k[0]).replace("over w", f"over (partition by {names} order by v)")) for k in ("ls", "rs")})
    fits = lambda others: F.filter(others, lambda x: x.isNotNull() & (F.greatest(x["v"], F.col("v")) <= ratio * F.least(x["v"], F.col("v"))))
    only = lambda own, others, mine, its: around.where(F.col(own).isNotNull()).select(F.col(f"{own}.id").alias(mine), fits(others).alias("f")).where(F.size("f") == 1).select(mine, F.col("f")[0]["id"].alias(its))
    return only("l", "rs", a, b).join(only("r", "ls", b, a), [a, b])


def only_unlike(df: DataFrame, keys: Sequence[str], kind: str, key: str, value: str, ratio: float) -> DataFrame:
    """(a, b), a < b: rows of a key of different kinds whose values lie within less than a ratio, each being the other's only such row.

    In order of value, rows of one kind in succession are a run, and what fits a row are those next to it that are not of
    its kind. The two nearest on either side tell whether there is none, one or more, and they are a run's and not a row's:
    the end of the next run, and the row behind that, or, where it has one row, the end of a further run of another kind.
    So no pairs are formed. Values must be above zero and ids distinct; nulls match nothing."""
    known = df.dropna(subset=[*keys, kind]).where(F.col(value) > 0)
    rows = known.select(F.struct(*keys).alias("of"), F.col(kind).alias("kind"), F.col(value).alias("v"), F.struct(F.col(value).alias("v"), F.col(key).alias("id")).alias("row"))
    order = Window.partitionBy("of").orderBy("row")
    rows = rows.withColumn("begins", F.coalesce(F.lag("kind").over(order) != F.col("kind"), F.lit(True)))
    rows = rows.withColumn("run", F.count_if("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda n: F.coalesce(F.lag("run", n).over(order) if n > 0 else F.lead("run", -n).over(order), F.lit(-1)) == F.col("run")
    marked = rows.withColumns({"second": at(1) & ~at(2), "last_but_one": at(-1) & ~at(-2)})
    ends = marked.groupBy("of", "run").agg(
        F.first("kind").alias("kind"), F.min("row").alias("first1"), F.min(F.when(F.col("second"), F.col("row"))).alias("first2"), F.max("row").alias("last1"), F.max(F.when(F.col("last_but_one"), F.col("row"))).alias("last2")
    )
    runs = Window.partitionBy("of").orderBy("run")

    def nearest(way, end: str) -> list[Column]:
        """The two nearest rows of other kinds on one side of a run."""
        further = F.when(way("kind", 2).over(runs) != F.col("kind"), way(f"{end}1", 2).over(runs)).otherwise(way(f"{end}1", 3).over(runs))
        return [way(f"{end}1", 1).over(runs), F.coalesce(way(f"{end}2", 1).over(runs), further)]

    around = ends.select("of", "run", F.array(*nearest(F.lag, "last"), *nearest(F.lead, "first")).alias("near"))
    fits = F.filter("near", lambda x: x.isNotNull() & (F.greatest(x["v"], F.col("v")) < ratio * F.least(x["v"], F.col("v"))))
    only = rows.join(around, ["of", "run"]).select(F.col("row.id").alias("id"), fits.alias("f")).where(F.size("f") == 1).select("id", F.col("f")[0]["id"].alias("other"))
    both = only.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.count("*").alias("n"))
    return both.where("n = 2").select("a", "b")


def compare_gates(known: Sequence[tuple[str, object]], always: Sequence[str], left: str = "a", right: str = "b") -> Column:
    """Whether two rows disagree: by a column that is known on both sides (its unknown value given), or always compared."""
    out = F.lit(False)
    for name, unknown in known:
        x, y = F.col(f"{left}.{name}"), F.col(f"{right}.{name}")
        sure = (x.isNotNull() & y.isNotNull()) if unknown is None else (x != F.lit(unknown)) & (y != F.lit(unknown))
        out = out | F.coalesce(sure & (x != y), F.lit(False))
    for name in always:
        out = out | ~F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return out
