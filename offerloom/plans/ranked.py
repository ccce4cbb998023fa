"""Plans whose rule pairs rows of a group, answered from ranks, counts and extremes of the group; their texts stay the oracles."""

from pyspark.sql import functions as F

from offerloom.functions import text as t
from offerloom.operators import groups, passages, words
from offerloom.operators.tables import written
from offerloom.plans import catalogue, relational, scalars  # noqa: F401  (register the texts)
from offerloom.plans.dialect import OFFER, SparkDialect, run_text, runs
from offerloom.plans.frames import offers
from offerloom.plans.resolution import DETACH_OFFERS, DETACH_PRODUCTS
from offerloom.plans.scalars import FOUND_AT, TYPED


@runs("c03_same_code_other_merchant")
def c03(spark, sf_dir):
    """Ordered pairs of different merchants: all pairs less those of one merchant, from counts."""
    each = offers(spark, sf_dir).where("live").groupBy("product_id", "merchant_id").agg(F.count("*").alias("n"))
    pairs = each.groupBy("product_id").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("pairs"))
    return pairs.where("pairs > 0")


@runs("c08_disagreement_semi_join")
def c08(spark, sf_dir):
    """An offer disagrees with another of its product if a known value of its own is not the product's least and greatest."""
    sig = offers(spark, sf_dir).selectExpr(
        "offer_id", "product_id", "case when merchant_id % 7 <> 0 then brand end as brand", "case merchant_id % 3 when 0 then 'F' when 1 then 'H' end as sex", "size % 2 = 0 as pack", "case when feed_id % 5 <> 0 then 2018 + merchant_id % 2 end as year"
    )
    names = ("brand", "sex", "pack", "year")
    ends = sig.groupBy("product_id").agg(*[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)])
    apart = " or ".join(f"coalesce(min_{n} <> {n} or max_{n} <> {n}, false)" for n in names)
    return sig.join(ends, "product_id").where(apart).select("offer_id")


@runs("c12_jaccard_threshold")
def c12(spark, sf_dir):
    """Pairs that share one of the rarest words which a pair at 0.4 must share, then confirmed on all words."""
    words = run_text(spark, sf_dir, "SELECT p_brand AS brand, p_size AS size, p_partkey AS id, split(lower(concat(p_name, ' ', p_type)), ' ') AS words FROM part").withColumn("words", F.array_distinct("words"))
    often = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    ranked = words.select("id", F.explode("words").alias("word")).join(often, "word").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w"))
    # of n words, a partner at 0.4 shares 0.4 n at least, so one of the n - ceil(0.4 n) + 1 rarest
    heads = ranked.select("id", F.explode(F.expr("slice(w, 1, cast(size(w) - ceil(0.4 * size(w)) + 1 as int)).word")).alias("word"))
    rows = words.join(heads, "id")
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, F.expr("a.brand = b.brand and a.size = b.size and a.word = b.word and b.id > a.id")).selectExpr("a.id", "b.id as other", "cast(size(array_intersect(a.words, b.words)) as bigint) as shared", "size(array_union(a.words, b.words)) as whole")
    return met.where("shared / whole >= 0.4").select("id", "other", "shared").distinct()


@runs("c15_leave_one_out_median")
def c15(spark, sf_dir):
    return groups.leave_one_out_median(offers(spark, sf_dir).where("live"), ["product_id"], "cents").where("others is not null").select("offer_id", "cents", "others")


UNITS = "SELECT merchant_id % 20 AS m, sku, md5(concat(brand, title, CAST(size AS STRING))) AS h, category, count(*) AS n, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY wide) AS DOUBLE) AS price FROM offer WHERE live AND wide > 0 GROUP BY 1, sku, brand, title, size, category"


@runs("q13_item_group_separation")
def q13(spark, sf_dir):
    units = run_text(spark, sf_dir, f"WITH {OFFER} {UNITS}")
    s = groups.leave_one_out_median(units, ["h"], "price").where("others is not null")
    ratio = F.when(F.col("category").isin("SMALL", "LARGE"), 5).otherwise(3)
    far = s.withColumn("far", (F.col("price") >= ratio * F.col("others")) | (F.col("price") <= F.col("others") / ratio))
    # the whole group's near count, and its first unit: a grouped count and a greatest row
    first = F.min(F.struct((-F.col("n")).alias("n"), "price", "m", "sku", "category"))
    of = far.groupBy("h").agg(F.count_if(~F.col("far")).alias("near"), first.alias("first"))
    alone = (F.col("near") == 0) & (F.struct((-F.col("n")).alias("n"), "price", "m", "sku", "category") == F.col("first"))
    return far.join(of, "h").select("m", "sku", "category", "h", "price", "others", (F.col("far") & ~alone).alias("separated"))


@runs("q14_detach_far_offers")
def q14(spark, sf_dir):
    """Offers nine times over or under the median of their product's others; held for a look where they are too many."""
    live = groups.leave_one_out_median(offers(spark, sf_dir).where("live"), ["product_id"], "wide")
    far = live.where("wide >= 9 * others or wide <= others / 9").select("offer_id", "product_id")
    cap = far.groupBy("product_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("offers"), F.count("*").alias("products"))
    held = (F.col("offers") > DETACH_OFFERS) | (F.col("products") > DETACH_PRODUCTS)
    return far.crossJoin(cap).select("offer_id", "product_id", held.alias("held"))  # one row


@runs("c10_prefix_join")
def c10(spark, sf_dir):
    """Partners of each key by counts for each prefix; a row is its own partner and is taken off."""
    ref = run_text(spark, sf_dir, f"SELECT p_partkey AS id, p_brand AS brand, upper({SparkDialect().gsub('concat(p_name, p_type)', '[^A-Za-z0-9]', '')}) AS k FROM part")
    met = words.prefix_counts(ref.where("length(k) >= 8"), ref.where("length(k) >= 8"), ["brand"], "k", "id")
    return met.selectExpr("id", "partners - 1 as n").where("n > 0")


@runs("q12_link_by_reference_prefix")
def q12(spark, sf_dir):
    """Offers with exactly one candidate, which a count and a least value for each prefix tell."""
    ref = f"upper({SparkDialect().gsub('concat(title, brand, size)', '[^A-Za-z0-9]', '')})"
    p = run_text(spark, sf_dir, f"WITH {OFFER} SELECT DISTINCT product_id, brand, size, {ref} AS k FROM offer")
    o = run_text(spark, sf_dir, f"WITH {OFFER} SELECT offer_id, merchant_id, brand, size, concat({ref}, CASE WHEN position = 2 THEN 'X' ELSE '' END) AS k FROM offer WHERE live")
    o = written(o.where("length(k) >= 8"), "offers-with-references")  # read for their keys, and again for the offers of keys with one partner
    only = words.prefix_counts(o, p.where("length(k) >= 8"), ["brand", "size"], "k", "product_id").where("partners = 1")
    first = only.groupBy(F.col("first_partner").alias("product_id"), "merchant_id").agg(F.min("offer_id").alias("offer_id"))
    return first.selectExpr("offer_id", "product_id", "CAST(0.70 AS DOUBLE) AS confidence")


@runs("q24_short_long_pairs")
def q24(spark, sf_dir):
    """A long model's words less one of the listed ones are the short model's: they meet by equality, and prices tell which are each other's only."""
    models = run_text(spark, sf_dir, f"WITH {OFFER} SELECT product_id AS id, brand, size, array_sort(array_distinct(split(CASE WHEN product_id % 2 = 0 THEN concat(title, ' pro') ELSE title END, ' '))) AS toks, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY cents) AS DOUBLE) AS price FROM offer GROUP BY product_id, brand, size, title")
    short = models.selectExpr("brand", "size", "toks", "id as short_id", "price")
    long = models.selectExpr("brand", "size", "id as long_id", "price", "toks as whole", "explode(array_intersect(toks, array('pro', 'evo'))) as w").selectExpr("brand", "size", "array_remove(whole, w) as toks", "long_id", "price")
    return groups.mutually_only(short, long, ["brand", "size", "toks"], "short_id", "long_id", "price", 1.5)


@runs("q26_cut_by_size")
def q26(spark, sf_dir):
    """Products of one bare title and different sizes that are each other's only such in price: told from neighbours in price."""
    bare = t.title_without_size("concat(p_name, ' - ', p_size)")
    p = run_text(spark, sf_dir, f"SELECT p_partkey AS id, p_brand AS brand, p_type AS kind, p_size AS size, p_retailprice AS price, {bare} AS bare FROM part")
    return groups.only_unlike(p, ["brand", "kind", "bare"], "size", "id", "price", 1.3)


@runs("h30_trigram_search")
def h30(spark, sf_dir):
    """The typed words' rarest trigrams lead to titles; only these are compared."""
    titles = run_text(spark, sf_dir, f"SELECT p_partkey, {t.norm_text('p_name')} AS title FROM part")
    typed = spark.createDataFrame([(1, w) for w in TYPED], "query int, word string")
    return words.trigram_search(typed, words.trigram_index(titles, "p_partkey", "title"), titles, "p_partkey", "title", FOUND_AT).select("p_partkey", "similarity")


@runs("h31_near_words")
def h31(spark, sf_dir):
    known = run_text(spark, sf_dir, "SELECT explode(split(p_name, ' ')) AS w FROM part")
    typed = run_text(spark, sf_dir, "SELECT q FROM (VALUES ('rde'), ('rnig'), ('wiget'), ('blolt'), ('smal')) AS typed(q)")
    return words.near_words(typed, known, "q", "w")


@runs("h49_brand_recognition")
def h49(spark, sf_dir):
    """Exact and begun brands by prefixes, near ones by deletions; the best tier, in which a near brand must be alone."""
    brands = run_text(spark, sf_dir, f"SELECT DISTINCT lower({SparkDialect().gsub('p_brand', '#', '')}) AS brand FROM part")
    typed = run_text(spark, sf_dir, "SELECT q FROM (VALUES ('brand1'), ('brnad12'), ('brand2'), ('brand2x'), ('zzz')) AS typed(q)")
    begun = words.prefix_counts(typed.selectExpr("q as k").distinct(), brands.selectExpr("brand as k", "brand"), [], "k", "brand", longer_only=True)
    begun = begun.selectExpr("k as q", "partners as n", "first_partner as brand", "if(first_partner = k, 1, 2) as tier")  # the exact one sorts first
    near = words.near_words(typed, brands, "q", "brand").groupBy("q").agg(F.count("*").alias("n"), F.min("brand").alias("brand")).withColumn("tier", F.lit(3))
    best = begun.unionByName(near.select(*begun.columns)).groupBy("q").agg(F.min(F.struct("tier", "brand", "n")).alias("b"))
    return best.where("b.tier < 3 or b.n = 1").selectExpr("q", "b.brand", "b.tier")


@runs("x20_cited_passage")
def x20(spark, sf_dir):
    texts = run_text(spark, sf_dir, f"SELECT doc_id, {t.norm_text('text')} AS said FROM documents")
    given = run_text(spark, sf_dir, f"SELECT item_id, {t.norm_text('text')} AS cited FROM benchmark")
    return passages.cited(texts, given, "doc_id", "item_id", "said", "cited")


@runs("q33_true_price_drops")
def q33(spark, sf_dir):
    """First and last price of the period, and the prices known before it, from one grouping of the daily prices."""
    days = offers(spark, sf_dir).groupBy("product_id", "merchant_id", "seen").agg(F.min("wide").alias("cents"))
    start = run_text(spark, sf_dir, "SELECT CAST(max(l_shipdate) AS DATE) - INTERVAL 2000 DAY AS start FROM lineitem")
    recent = F.col("seen") >= F.col("start")
    of = days.crossJoin(start).groupBy("product_id", "merchant_id").agg(  # one row
        F.min_by("cents", F.when(recent, F.col("seen"))).alias("before"), F.max_by("cents", F.when(recent, F.col("seen"))).alias("now"),
        F.count_if(recent).alias("days"), F.collect_set(F.when(~recent, F.col("cents"))).alias("earlier"),
    )
    pairs = of.where("days > 1").withColumn("low", F.expr("min(now) over (partition by product_id)"))
    fell = "now = low and now <= 0.9 * before and now >= 0.45 * before and before - now >= 2000"
    return pairs.where(fell).where(~F.array_contains("earlier", F.col("now"))).select("product_id", "merchant_id", "before", "now")
