"""Merchant feeds: delimited text to offers with a fixed schema. Everything is text until one explicit projection."""

from __future__ import annotations

import zipfile
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.functions import text as t


@dataclass(frozen=True)
class FeedSpec:
    """One merchant's feed: its delimiter, and for each field the header names that may hold it, in order."""

    merchant: str
    sep: str = ";"
    aliases: Mapping[str, Sequence[str]] = field(default_factory=dict)
    required: Sequence[str] = ("sku", "title", "url")
    rejected_paths: str | None = None  # pattern of categories out of scope
    rejected_titles: str | None = None


DEFAULT_ALIASES = {
    "sku": ("id", "sku", "product_id", "aw_product_id"),
    "title": ("title", "product_name", "name"),
    "url": ("link", "url", "deep_link", "aw_deep_link"),
    "price": ("price", "search_price", "store_price"),
    "sale_price": ("sale_price",),
    "gtin": ("gtin", "ean", "product_gtin"),
    "stock": ("availability", "in_stock", "stock"),
    "brand": ("brand", "brand_name"),
    "colour": ("color", "colour"),
    "size": ("size", "fashion:size"),
    "category": ("product_type", "category_name", "merchant_category"),
}


class MissingColumns(ValueError):
    """A feed lacks a column that its specification requires; raised before anything is written."""


def unpacked(path: str, folder: str) -> list[str]:
    """The text files of a zip archive, unpacked on the driver (Spark has no zip codec); folder must be shared."""
    with zipfile.ZipFile(path) as archive:
        names = [n for n in archive.namelist() if n.lower().endswith((".csv", ".txt"))]
        archive.extractall(folder, names)
    return [str(Path(folder, n)) for n in names]


def read_feed(spark: SparkSession, path: str | list[str], spec: FeedSpec) -> DataFrame:
    """(merchant, row, corrupt): each record as a map from lower-case header names to text; quoted fields may hold lines."""
    raw = spark.read.option("header", True).option("sep", spec.sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").option("inferSchema", False)
    head = raw.csv(path)
    schema = ", ".join(f"`{c}` string" for c in head.columns) + ", `_corrupt` string"
    rows = raw.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    have = {c.strip().lstrip("﻿").lower() for c in head.columns}
    aliases = {**DEFAULT_ALIASES, **spec.aliases}
    missing = [f for f in spec.required if not have & {a.lower() for a in aliases[f]}]
    if missing:
        raise MissingColumns(f"{spec.merchant}: no column for {', '.join(missing)}")
    pairs = [x for c in head.columns for x in (F.lit(c.strip().lstrip("﻿").lower()), F.col(f"`{c}`"))]
    return rows.select(F.lit(spec.merchant).alias("merchant"), F.create_map(*pairs).alias("row"), F.col("_corrupt").isNotNull().alias("corrupt"))


def ragged(staged: DataFrame) -> DataFrame:
    """(merchant, rows, ragged): records of a staged feed, and those whose number of fields is not the header's."""
    read = F.length(F.array_join(F.map_values("row"), "")) >= 0  # Spark refuses to read the flag of a file alone
    return staged.groupBy("merchant").agg(F.count("*").alias("rows"), F.count_if(F.col("corrupt") & read).alias("ragged"))


def first_of(row: str, names: Sequence[str]) -> Column:
    """The first alias with a value that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(F.col(row), F.lit(n.lower()))), F.lit("")) for n in names], F.lit(None).cast("string"))


def in_scope(staged: DataFrame, spec: FeedSpec) -> DataFrame:
    """The columns that offers are made of, and reason: why a record is left out at the door (null: it is kept)."""
    aliases = {**DEFAULT_ALIASES, **spec.aliases}
    rows = staged.select("merchant", *[first_of("row", names).alias(f) for f, names in aliases.items()])

    def hit(pattern: str | None, column: str) -> Column:
        return F.coalesce(F.lower(column).rlike(pattern), F.lit(False)) if pattern else F.lit(False)

    reason = F.when(hit(spec.rejected_paths, "category"), "category").when(hit(spec.rejected_titles, "title"), "title").when(F.col("title").isNull() | F.col("url").isNull(), "incomplete")
    return rows.withColumn("reason", reason)


def offers(staged: DataFrame, spec: FeedSpec, as_of: str) -> DataFrame:
    """Typed offers of a staged feed: in scope, complete, prices in cents, one row for each key (that of the greatest title)."""
    rows = in_scope(staged, spec).where("reason is null").drop("reason")
    live = F.expr(t.sale_is_live("coalesce(sale_window, '')", f"DATE'{as_of}'")) if "sale_window" in rows.columns else F.lit(True)
    rows = rows.select("merchant", F.expr(t.merchant_key("coalesce(sku, '')", "url")).alias("offer_key"), "title", "url", "brand", "colour", "size", "category", F.when(F.expr(t.valid_gtin("coalesce(gtin, '')")), F.col("gtin")).alias("gtin"), F.expr(t.money("price")).alias("list_cents"), F.expr(t.money("sale_price")).alias("sale_cents"), F.expr(t.in_stock("stock")).alias("in_stock"), live.alias("_live"))
    rows = rows.withColumn("cents", F.expr(t.effective_price("list_cents", "sale_cents", "_live"))).drop("_live")
    return rows.groupBy("merchant", "offer_key").agg(F.max(F.struct("title", *[c for c in rows.columns if c not in ("merchant", "offer_key", "title")])).alias("x")).select("merchant", "offer_key", "x.*")


def scrape_is_sound(pages: DataFrame, key_field: str, least: float = 0.5) -> bool:
    """False for an empty scrape, or one whose key field is filled on under a share of its pages."""
    n, filled = pages.agg(F.count("*"), F.count(F.nullif(F.col(key_field), F.lit("")))).first()
    return n > 0 and filled >= least * n
