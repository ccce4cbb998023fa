"""List prices by consensus of the sources that state one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.operators.groups import value_families

# How near two sources agree, and how far a list price may lie from the best price.
TOLERANCE = 0.01
AGREED_MOST = 3.0
LONE_LEAST, LONE_MOST = 1.03, 1.5


def list_price_consensus(
    stated: DataFrame, best: DataFrame, keys: Sequence[str], source: str, value: str, price: str, *, sources: Sequence | None = None, trusted: Sequence = (),
    tolerance: float = TOLERANCE, agreed_most: float = AGREED_MOST, lone_least: float = LONE_LEAST, lone_most: float = LONE_MOST,
) -> DataFrame:
    """(keys, value, tier, sources): the list price of each key that its sources agree on, or that a trusted one states alone.

    Tier 1: the largest family of at least two sources within the tolerance, at its highest value, at most agreed_most
    times the best price. Tier 2: the value of a trusted source that no other source stands beside, from lone_least to
    lone_most times the best price. Sources that disagree give no price, nor does a lone source that is not trusted.
    stated has one row for each key and source (the highest value counts where it has more); values and best prices that
    are null or not above zero do not take part. sources, if given, are the only ones heard.
    """
    fine = stated.where(F.col(value) > 0).where(F.lit(True) if sources is None else F.col(source).isin(*sources))
    each = fine.groupBy(*keys, source).agg(F.max(value).alias(value))
    least = best.where(F.col(price) > 0).groupBy(*keys).agg(F.min(price).alias("best_price"))
    agreed = value_families(each, keys, value, tolerance).where("members > 1")
    heard = each.groupBy(*keys).agg(F.count("*").alias("heard"), F.max(value).alias("lone_value"), F.max(source).alias("lone_source"))
    judged = heard.join(agreed, list(keys), "left").join(least, list(keys))
    tier = F.when(F.col("members") > 1, F.when(F.col(value) <= agreed_most * F.col("best_price"), 1))
    lone = (F.col("heard") == 1) & (F.col("lone_source").isin(*trusted) if trusted else F.lit(False)) & (F.col("lone_value") >= lone_least * F.col("best_price")) & (F.col("lone_value") <= lone_most * F.col("best_price"))
    told = judged.select(*keys, F.coalesce(value, "lone_value").alias("told"), F.coalesce("family_low", "lone_value").alias("low"), tier.otherwise(F.when(lone, 2)).alias("tier")).where("tier is not null")
    # the sources of the family: a handful for each key
    named = each.join(told, list(keys)).where(F.col(value).between(F.col("low"), F.col("told")))
    return named.groupBy(*keys, F.col("told").alias(value), "tier").agg(F.array_join(F.sort_array(F.collect_set(F.col(source).cast("string"))), "+").alias("sources"))
