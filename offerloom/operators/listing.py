"""The filtered listing: one filter object, its predicates, its facets (each with its own criterion lifted), its orders."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active_chips(given: Sequence[str]) -> Column:
    """Names of the active criteria of requests that are rows, in the order of Filters.chips; given: the criteria's columns that there are."""
    found = []
    for f in fields(Filters):
        if f.name == "words" and f.name in given:
            found.append(F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.concat(F.lit("word "), w)))
        elif f.name in given:
            several = isinstance(f.default, tuple)
            active = F.coalesce(F.size(f.name) > 0 if several else F.col(f.name) if f.default is False else F.col(f.name).isNotNull(), F.lit(False))
            found.append(F.when(active, F.array(F.lit(f.name))).otherwise(F.array().cast("array<string>")))
    return F.concat(*found)


@dataclass(frozen=True)
class Filters:
    """Criteria of a listing; unset ones (None, empty) add no predicate, so that the scan is pruned by the set ones."""

    department: str | None = None
    brands: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    colours: tuple[str, ...] = ()
    sizes: tuple[str, ...] = ()
    gender: str | None = None  # woman, man or child
    low: int | None = None
    high: int | None = None
    words: tuple[str, ...] = ()
    in_stock: bool = False
    years: tuple[int, ...] = ()
    discount: float | None = None
    merchants: int | None = None

    def conditions(self) -> dict[str, Column]:
        """Each set criterion's predicate over a listing's columns."""
        out: dict[str, Column] = {}
        for name, column in (("brands", "brand"), ("categories", "category"), ("sizes", "size"), ("years", "year")):
            if getattr(self, name):
                out[name] = F.col(column).isin(*getattr(self, name))
        if self.department is not None:
            out["department"] = F.col("department") == self.department
        if self.colours:
            parts = F.split(F.regexp_replace("colour", r"\|", "-"), "-")
            out["colours"] = F.arrays_overlap(parts, F.array(*map(F.lit, self.colours)))
        if self.gender:
            out["gender"] = {"woman": F.col("genre").like("F-%"), "man": F.col("genre").isin("H-A", "U-A"), "child": F.col("genre").like("%-E")}[self.gender]
        if self.low is not None:
            out["low"] = F.col("cents") >= self.low
        if self.high is not None:
            out["high"] = F.col("cents") <= self.high
        for word in self.words:
            out[f"word {word}"] = F.contains(F.lower("title"), F.lit(word.lower()))
        if self.in_stock:
            out["in_stock"] = F.coalesce("in_stock", F.lit(True))
        if self.discount is not None:
            out["discount"] = F.col("cents") <= (1 - self.discount) * F.col("list_cents")
        if self.merchants is not None:
            out["merchants"] = F.col("merchants") >= self.merchants
        return out

    def chips(self) -> list[str]:
        """Names of the active criteria, for display."""
        return list(self.conditions())

    def without(self, name: str) -> Filters:
        blank = {f.name: f.default for f in fields(self)}
        return replace(self, **{name: blank[name]})



def order_of(name: str) -> list[Column]:
    """Sort vocabulary; every order ends in the unique key, so that pages are stable."""
    discount = F.when(F.col("list_cents") >= 1.03 * F.col("cents"), 1 - F.col("cents") / F.col("list_cents")).otherwise(1 - F.col("cents") / F.col("high_cents"))
    orders = {"relevance": [F.desc("merchants")], "price": [F.asc_nulls_last("cents")], "price_down": [F.desc_nulls_last("cents")], "discount": [discount.desc_nulls_last()], "newest": [F.desc_nulls_last("first_seen")]}
    return [*orders[name], F.asc("product_id")]


def listing(products: DataFrame, filters: Filters, order: str = "relevance", page: int = 0, size: int = 48) -> DataFrame:
    """One page; a sort with a limit keeps only the best rows of each partition."""
    found = products
    for condition in filters.conditions().values():
        found = found.where(condition)
    return found.orderBy(*order_of(order)).offset(page * size).limit(size)


def facets(products: DataFrame, filters: Filters, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """(facet, value, n) of each (criterion, column): counts under all other criteria, in one pass over the products.

    Each row carries, for each facet, whether it passes the criteria other than that facet's own; one grouped count of
    the exploded (facet, value) pairs then serves all facets.
    """
    pairs = []
    for criterion, column in wanted:
        passes = F.lit(True)
        for condition in filters.without(criterion).conditions().values():
            passes = passes & F.coalesce(condition, F.lit(False))
        pairs.append(F.when(passes, F.struct(F.lit(criterion).alias("facet"), F.col(column).cast("string").alias("value"))))
    return products.select(F.explode(F.array_compact(F.array(*pairs))).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n")).where("value is not null")
