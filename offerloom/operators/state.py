"""Changes of tables as functions: (state, batch) -> state, in place of MERGE."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in an order, which should be total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(state: DataFrame, batch: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """batch's first row of each key (in order, where given), and the rows of state whose key it lacks."""
    fresh = first_by(batch, keys, *order) if order else batch
    return state.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh.select(*state.columns))


def insert_if_absent(state: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    return state.unionByName(batch.join(state.select(*keys).distinct(), list(keys), "left_anti").select(*state.columns))


def conditional_upsert(state: DataFrame, batch: DataFrame, keys: Sequence[str], replaceable: Column) -> DataFrame:
    """Like upsert, but a row of state for which replaceable does not hold stays; batch has one row for each key."""
    held = state.where(~F.coalesce(replaceable, F.lit(False)))
    fresh = batch.join(held.select(*keys).distinct(), list(keys), "left_anti").select(*state.columns)
    return upsert(state, fresh, keys)


def retire(state: DataFrame, seen: DataFrame, keys: Sequence[str], floor: int = 500, share: float = 0.2) -> tuple[DataFrame, bool]:
    """Marks live rows that a feed no longer has as not live; refuses (True) to retire over a share of at least floor rows."""
    marked = state.join(seen.select(*keys).distinct().withColumn("_seen", F.lit(True)), list(keys), "left")
    live, gone = marked.where("live").agg(F.count("*"), F.count(F.when(F.col("_seen").isNull(), 1))).first()
    if live >= floor and gone > share * live:
        return state, True
    return marked.withColumn("live", F.col("live") & F.col("_seen").isNotNull()).drop("_seen").select(*state.columns), False


def apply_overrides(df: DataFrame, overrides: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """column by an override where there is one."""
    return df.join(overrides.select(*keys, F.col(column).alias("_o")), list(keys), "left").withColumn(column, F.coalesce("_o", column)).drop("_o").select(*df.columns)
