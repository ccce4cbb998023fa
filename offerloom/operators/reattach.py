"""Units of new offers put to the product that carries their barcode already, with a log of each offer that was moved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.operators.state import upsert

# Barcodes above which a product is no target, and offers above which a night's move waits for the owner.
TARGET_MOST, OFFERS_MOST = 25, 2000


def moves(offers: DataFrame, units: DataFrame, linked: DataFrame, refused: DataFrame, target_most: int = TARGET_MOST, offers_most: int = OFFERS_MOST) -> DataFrame:
    """(offer_id, gtin, product, own_hash, held): unresolved offers and the product each goes to; held where a night has too many.

    offers: (offer_id, gtin, resolved); units: (gtin, identity, conflict); linked: (gtin, product, identity of the product),
    a row for each linked live offer or more; refused: (gtin) of barcodes that a gate or a split by hand keeps apart. A unit
    moves if it has no conflict, all linked offers of its barcode are of one product, that product has at most target_most
    barcodes and another identity than the unit's own."""
    of = linked.select("gtin", "product", "identity").where("gtin is not null and product is not null").distinct()
    target = of.groupBy("gtin").agg(F.min("product").alias("product"), F.count_distinct("product").alias("n"), F.max("identity").alias("theirs")).where("n = 1").drop("n")
    small = of.groupBy(F.col("product").alias("p")).agg(F.count_distinct("gtin").alias("n")).where(F.col("n") <= target_most).select("p")
    kept = units.where("not conflict").select("gtin", F.col("identity").alias("own_hash")).join(target, "gtin").where("not (own_hash <=> theirs)")
    kept = kept.join(small, F.expr("product = p"), "left_semi").join(refused.select("gtin").distinct(), "gtin", "left_anti")
    new = offers.where("not resolved").select("offer_id", "gtin").join(kept.select("gtin", "product", "own_hash"), "gtin").select("offer_id", "gtin", "product", "own_hash")
    return new.crossJoin(new.agg(F.count("*").alias("n"))).select("offer_id", "gtin", "product", "own_hash", (F.col("n") > offers_most).alias("held"))  # one row


def logged(log: DataFrame, moved: DataFrame, night: str) -> DataFrame:
    """The log after a night: (offer_id, gtin, product, own_hash, night), the last move of each offer; held moves are not made."""
    fresh = moved.where("not held").select("offer_id", "gtin", "product", "own_hash", F.lit(night).cast("date").alias("night"))
    return upsert(log, fresh, ["offer_id"])
