"""Whether products that look alike are one: a verdict on each group, with its reasons, from grouped counts alone.

Nothing holds a group in one task: every signal is a count, a set of codes from a short vocabulary, a least or greatest
value, or a window over barcodes in order, worked out for each product, size, barcode or reference of a group before the
group's single row is put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How near neighbouring barcodes lie in their first twelve digits, and ratios of median prices.
BARCODE_GAP = 20
PRICES_DOUBTFUL, PRICES_REFUSED = 1.5, 3.0

SAFE, PROBABLE, DOUBTFUL, REFUSED = "safe", "probable", "doubtful", "refused"


def _known(x: str, unknown: str = "") -> Column:
    return F.when(F.lower(x) != F.lit(unknown), F.col(x))


def _listed(name: str, values: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), F.array_join(F.array_sort(values), " / "))


def group_verdicts(offers: DataFrame, gap: int = BARCODE_GAP, doubtful: float = PRICES_DOUBTFUL, refused: float = PRICES_REFUSED) -> DataFrame:
    """(grp, verdict, reasons): one row for each group of products.

    offers: (grp, product, colour, genre, year, size, gtin, ref, price), a row for each offer; colour, genre and year are
    its product's (unknown: null, '' or 'unknown'; genre as sex-age with U for either sex), and gtin, ref, size, price may
    be null. Refused: several colours, sexes, ages or years, a size with other barcodes on another product, or median
    prices over refused times apart; the reasons are all that apply. Else safe: one colour known on all, prices within
    doubtful times, and a barcode on two products or a reference common to all. Probable: in place of these, sizes that
    complete each other and barcodes near to another product's on every product. Doubtful: the rest."""
    rows = offers.where("grp is not null and product is not null").select(
        "grp", "product", F.coalesce(_known("colour", "unknown"), F.lit("")).alias("colour"), F.coalesce(_known("genre"), F.lit("U-A")).alias("genre"), F.when(F.col("year") != 0, F.col("year")).alias("year"), _known("size").alias("size"), _known("gtin").alias("gtin"), _known("ref").alias("ref"), "price"
    )
    sex, age = F.substring_index("genre", "-", 1), F.substring_index("genre", "-", -1)
    products = rows.groupBy("grp", "product").agg(F.max("colour").alias("colour"), F.max("genre").alias("genre"), F.max("year").alias("year"), F.percentile("price", 0.5).alias("median"), F.count("size").alias("sized"), F.count("ref").alias("referred"))
    of = products.groupBy("grp").agg(
        F.count("*").alias("products"), F.array_sort(F.collect_set(F.nullif("colour", F.lit("")))).alias("colours"), F.bool_or(F.col("colour") == "").alias("colour_unknown"),
        F.collect_set(F.when(sex != "U", sex)).alias("sexes"), F.collect_set(age).alias("ages"), F.collect_set("year").alias("years"),
        F.bool_and(F.col("sized") > 0).alias("all_sized"), F.bool_and(F.col("referred") > 0).alias("all_referred"),
        F.when((F.count("median") > 1) & (F.min("median") > 0), F.max("median") / F.min("median")).otherwise(1.0).alias("ratio"),
    )

    sizes = rows.where("size is not null").groupBy("grp", "size").agg(F.count_distinct("product").alias("products"), F.count_distinct("gtin").alias("codes")).where("products > 1")
    sizes = sizes.groupBy("grp").agg(F.count("*").alias("doubled"), F.collect_set(F.when(F.col("codes") > 1, F.col("size"))).alias("clashes"))
    coded = rows.where("gtin is not null").select("grp", "product", "gtin").distinct()
    shared = coded.groupBy("grp", "gtin").agg(F.count("*").alias("n")).where("n > 1").select("grp").distinct().withColumn("shared_code", F.lit(True))
    common = rows.where("ref is not null").groupBy("grp", "ref").agg(F.count_distinct("product").alias("n")).groupBy("grp").agg(F.max("n").alias("most_referred"))
    # barcodes of one block in order: another product's lies within the gap where the least and greatest product there differ
    digits = coded.where(F.col("gtin").rlike("^[0-9]{12}")).select("grp", "product", F.substring("gtin", 1, 9).alias("block"), F.substring("gtin", 1, 12).cast("long").alias("at"))
    around = f"over (partition by grp, block order by at range between {int(gap)} preceding and {int(gap)} following)"
    near = digits.withColumn("near", F.expr(f"min(product) {around} <> max(product) {around}")).where("near").groupBy("grp").agg(F.count_distinct("product").alias("near_products"))

    whole = of
    for part in (sizes, shared, common, near):
        whole = whole.join(part, "grp", "left")
    doubled = F.coalesce("doubled", F.lit(0)) > 0
    complete = ~doubled & F.col("all_sized")
    neighbours = complete & (F.coalesce("near_products", F.lit(0)) == F.col("products"))
    code, ref = F.coalesce("shared_code", F.lit(False)), F.col("all_referred") & (F.col("most_referred") == F.col("products"))
    one_colour, prices = (F.size("colours") == 1) & ~F.col("colour_unknown"), F.col("ratio") <= doubtful
    vetoes = F.array_compact(F.array(
        F.when(F.size("colours") > 1, _listed("colours", F.col("colours"))), F.when(F.size("sexes") > 1, _listed("sexes", F.col("sexes"))), F.when(F.size("ages") > 1, _listed("ages", F.col("ages"))),
        F.when(F.size("years") > 1, _listed("years", F.transform("years", lambda y: y.cast("string")))), F.when(F.size("clashes") > 0, _listed("sizes with other barcodes", F.col("clashes"))), F.when(F.col("ratio") > refused, F.format_string("median prices %.1f times apart", "ratio")),
    ))
    signals = F.array_compact(F.array(
        F.when(code, "a barcode on two products"), F.when(ref, "one reference"), F.when(complete, "sizes complete each other"), F.when(neighbours, "neighbouring barcodes"),
        F.when(one_colour, _listed("colour", F.col("colours"))).when(F.col("colour_unknown"), "a colour unknown"), F.format_string("median prices %.2f times apart", "ratio"),
    ))
    judged = whole.select("grp", vetoes.alias("vetoes"), signals.alias("signals"), F.when(one_colour & prices & (code | ref), SAFE).when(one_colour & prices & neighbours, PROBABLE).otherwise(DOUBTFUL).alias("note"))
    return judged.select("grp", F.when(F.size("vetoes") > 0, REFUSED).otherwise(F.col("note")).alias("verdict"), F.when(F.size("vetoes") > 0, F.col("vetoes")).otherwise(F.col("signals")).alias("reasons"))
