"""Plans made of the operator library's DataFrame functions, each with an oracle."""

from pyspark.sql import functions as F

from offerloom.operators import extract, graph, groups, journal, listing, prices, promo, reattach, state, verdicts
from offerloom.plans.dialect import OFFER, SparkDialect, frame, run_text


def _width(spark) -> int:
    """Tasks for work that costs much more than its bytes tell."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def offers(spark, sf_dir):
    return run_text(spark, sf_dir, f"WITH {OFFER} SELECT * FROM offer")


REACH = "reach(a, b) AS (SELECT a, a FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b)"
#: Products of one brand that one merchant key names.
LINKS = "SELECT DISTINCT min(l_partkey) AS a, max(l_partkey) AS b FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, l_linenumber, p_brand HAVING count(DISTINCT l_partkey) > 1"


@frame("q20_component_groups", f"""WITH RECURSIVE link AS ({LINKS}), edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link), {REACH}, c AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
  s AS (SELECT component FROM c GROUP BY component HAVING count(*) <= 25) SELECT node, component AS survivor FROM c JOIN s USING (component)""")
def q20(spark, sf_dir):
    """Links to groups of at most 25 to their survivor."""
    return graph.survivors(graph.connected_components(run_text(spark, sf_dir, LINKS)), 25)


LABELS = "SELECT DISTINCT CASE WHEN l_suppkey % 2 = 0 THEN concat('EU', p_size) ELSE concat('T', CAST(floor(p_size / 2) AS INT)) END AS label, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey"


@frame("q48_size_label_equivalence", f"""WITH RECURSIVE u AS ({LABELS}), edge AS (SELECT DISTINCT x.label AS a, y.label AS b FROM u x JOIN u y ON x.l_partkey = y.l_partkey AND x.label <> y.label), {REACH} SELECT a AS label, min(b) AS canonical FROM reach GROUP BY a""")
def q48(spark, sf_dir):
    """Size labels that merchants give to the same barcode are one size."""
    used = run_text(spark, sf_dir, LABELS)
    pairs = used.groupBy("l_partkey").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("a", "b").distinct()
    return graph.connected_components(pairs).select(F.col("node").alias("label"), F.col("component").alias("canonical"))


@frame("a18_frame_upsert", f"""WITH {OFFER}, r AS (SELECT sku, offer_id, cents, row_number() OVER (PARTITION BY sku ORDER BY seen DESC, offer_id) AS n FROM offer WHERE live)
SELECT sku, offer_id, cents FROM r WHERE n = 1 UNION ALL SELECT sku, offer_id, cents FROM offer o WHERE NOT live AND NOT EXISTS (SELECT 1 FROM offer f WHERE f.live AND f.sku = o.sku)""")
def a18(spark, sf_dir):
    all_of = offers(spark, sf_dir)
    old = all_of.where("not live").select("sku", "offer_id", "cents", "seen")
    return state.upsert(old, all_of.where("live"), ["sku"], F.desc("seen"), "offer_id").drop("seen")


@frame("a20_frame_conditional_upsert", f"""WITH {OFFER}, s AS (SELECT product_id, min(cents) AS cents, count(*) % 2 = 0 AS open FROM offer WHERE NOT live GROUP BY product_id), b AS (SELECT product_id, max(cents) AS cents FROM offer WHERE live GROUP BY product_id)
SELECT coalesce(s.product_id, b.product_id) AS product_id, CASE WHEN s.product_id IS NOT NULL AND (b.product_id IS NULL OR NOT s.open) THEN s.cents ELSE b.cents END AS cents FROM s FULL JOIN b ON b.product_id = s.product_id""")
def a20(spark, sf_dir):
    all_of = offers(spark, sf_dir)
    old = all_of.where("not live").groupBy("product_id").agg(F.min("cents").alias("cents"), (F.count("*") % 2 == 0).alias("open"))
    new = all_of.where("live").groupBy("product_id").agg(F.max("cents").alias("cents")).withColumn("open", F.lit(True))
    return state.conditional_upsert(old, new, ["product_id"], F.col("open")).drop("open")


@frame("c15_frame_leave_one_out_median", f"""WITH {OFFER} SELECT a.offer_id, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY b.cents) AS DOUBLE) AS others FROM offer a JOIN offer b ON b.product_id = a.product_id AND b.offer_id <> a.offer_id WHERE a.live AND b.live GROUP BY a.offer_id""")
def c15(spark, sf_dir):
    """The same median from ranks, without joining each product's offers with themselves."""
    live = offers(spark, sf_dir).where("live")
    return groups.leave_one_out_median(live, ["product_id"], "cents").where("others is not null").select("offer_id", "others")


@frame("d12_frame_mode", f"WITH {OFFER}, c AS (SELECT merchant_id, size, count(*) AS n FROM offer GROUP BY merchant_id, size), r AS (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY n DESC, size DESC) AS k FROM c) SELECT merchant_id, size, n FROM r WHERE k = 1")
def d12(spark, sf_dir):
    return groups.mode(offers(spark, sf_dir), ["merchant_id"], "size")


@frame("d14_frame_unanimous", f"WITH {OFFER} SELECT sku, min(brand) AS brand FROM offer GROUP BY sku HAVING count(DISTINCT brand) = 1")
def d14(spark, sf_dir):
    return groups.unanimous(offers(spark, sf_dir), ["sku"], "brand")


@frame("d15_frame_histogram", lambda d: f"""WITH {OFFER}, top AS (SELECT ceil(percentile_cont(0.95) WITHIN GROUP (ORDER BY cents) / 1000.0) * 1000 AS ceiling FROM offer),
b AS (SELECT {d.bucket("cents", "0", "CAST(ceiling AS BIGINT)", "12")} AS bucket, count(*) AS n FROM offer CROSS JOIN top GROUP BY 1) SELECT bucket, n, CAST(sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulated FROM b""")
def d15(spark, sf_dir):
    return groups.histogram(offers(spark, sf_dir), "cents")


@frame("q08_frame_split_by_gap", f"""WITH {OFFER}, u AS (SELECT brand, product_id, max(wide) AS wide FROM offer GROUP BY brand, product_id), j AS (SELECT *, CASE WHEN wide / CAST(lag(wide) OVER (PARTITION BY brand ORDER BY wide, product_id) AS DOUBLE) >= 1.05 THEN 1 ELSE 0 END AS j FROM u)
SELECT product_id, CAST(sum(j) OVER (PARTITION BY brand ORDER BY wide, product_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS part FROM j""")
def q08(spark, sf_dir):
    units = offers(spark, sf_dir).groupBy("brand", "product_id").agg(F.max("wide").alias("wide"))
    return groups.split_by_gap(units, ["brand"], "wide", 1.05).select("product_id", "part")


@frame("c08_frame_gates", f"""WITH {OFFER}, s AS (SELECT offer_id, sku, CASE WHEN merchant_id % 7 = 0 THEN 'unknown' ELSE brand END AS brand, size % 2 AS age FROM offer)
SELECT DISTINCT a.offer_id FROM s a JOIN s b ON b.sku = a.sku AND b.offer_id <> a.offer_id WHERE (a.brand <> 'unknown' AND b.brand <> 'unknown' AND a.brand <> b.brand) OR a.age <> b.age""")
def c08(spark, sf_dir):
    signed = offers(spark, sf_dir).selectExpr("offer_id", "sku", "CASE WHEN merchant_id % 7 = 0 THEN 'unknown' ELSE brand END AS brand", "size % 2 AS age")
    disagree = groups.compare_gates([("brand", "unknown")], ["age"])
    return signed.alias("a").join(signed.alias("b"), (F.col("a.sku") == F.col("b.sku")) & (F.col("a.offer_id") != F.col("b.offer_id")) & disagree, "left_semi").select("offer_id")


def description(d) -> str:
    return """SELECT p_partkey AS id, p_name, concat('<p>', p_name, CASE p_partkey % 4 WHEN 0 THEN ' en carbone, sans intercom' WHEN 1 THEN ' polycarbonate double-D pinlock' WHEN 2 THEN ' cuir impermeable, 1350 g' ELSE ' textile, pas de dorsale, ECE 22.06' END, '</p> ', p_size + 1, ' poches, ', p_size % 9 + 1, ' ventilations, coudes') AS body FROM part"""


def said(d, x, pattern, value=None):
    no = "(sans|pas de) "
    return f"CASE WHEN {d.matches(d.gsub(x, no + pattern, ' '), pattern)} THEN '{value or 'yes'}' {'' if value else f"WHEN {d.matches(x, no + pattern)} THEN 'no' "}END"


@frame("x09_frame_helmet_attributes", lambda d: f"""WITH b AS ({description(d)}), r AS (
  SELECT id, 'shell' AS name, coalesce({said(d, "body", "carbone", "carbon")}, {said(d, "body", "polycarbonate", "polycarbonate")}) AS value FROM b UNION ALL SELECT id, 'standard', {said(d, "body", "22[.]06", "22.06").replace("body", "lower(body)")} FROM b
  UNION ALL SELECT id, 'buckle', {said(d, "lower(body)", "double-d", "double D")} FROM b UNION ALL SELECT id, 'insert', CASE WHEN {d.matches("body", "pinlock")} THEN 'supplied' END FROM b UNION ALL SELECT id, 'intercom', CASE WHEN {d.matches("body", "sans intercom")} THEN 'no' END FROM b
  UNION ALL SELECT id, 'weight', CASE WHEN {d.extract("body", "([0-9]{{4}}) g", 1).replace("{{4}}", "{4}")} <> '' THEN '1350' END FROM b UNION ALL SELECT id, 'vents', {d.extract("body", "([0-9]+) ventilations", 1)} FROM b) SELECT id, name, value FROM r WHERE value IS NOT NULL""")
def x09(spark, sf_dir):
    return extract.attributes(run_text(spark, sf_dir, description(SparkDialect())), "id", "body", "helmet")


@frame("x10_frame_jacket_attributes", lambda d: f"""WITH b AS ({description(d)}), r AS (
  SELECT id, 'material' AS name, CASE WHEN {d.matches("body", "cuir")} THEN 'leather' WHEN {d.matches("body", "textile")} THEN 'textile' END AS value FROM b UNION ALL SELECT id, 'waterproof', {said(d, "body", "impermeable")} FROM b UNION ALL SELECT id, 'back protector', CASE WHEN {d.matches("body", "pas de dorsale")} THEN 'no' END FROM b
  UNION ALL SELECT id, 'ventilation', 'yes' FROM b UNION ALL SELECT id, 'elbow protectors', 'supplied' FROM b UNION ALL SELECT id, 'pockets', CASE WHEN CAST({d.extract("body", "([0-9]+) poches", 1)} AS INT) <= 20 THEN {d.extract("body", "([0-9]+) poches", 1)} END FROM b) SELECT id, name, value FROM r WHERE value IS NOT NULL""")
def x10(spark, sf_dir):
    return extract.attributes(run_text(spark, sf_dir, description(SparkDialect())), "id", "body", "jacket")


def category_frame(name: str, category: str, rules: dict[str, tuple[tuple[str, str | None], ...]]):
    """Glove, trouser and boot attributes: the same evaluation with other tables."""

    def oracle(d):
        parts = [f"SELECT id, '{n}' AS name, coalesce({', '.join(said(d, 'body', p, v) for p, v in tries)}, NULL) AS value FROM b" for n, tries in rules.items()]
        return f"WITH b AS ({description(d)}), r AS ({' UNION ALL '.join(parts)}) SELECT id, name, value FROM r WHERE value IS NOT NULL"

    frame(name, oracle)(lambda spark, sf_dir: extract.attributes(run_text(spark, sf_dir, description(SparkDialect())), "id", "body", category))


category_frame("x11_frame_glove_attributes", "glove", {"material": (("cuir", "leather"), ("textile", "textile")), "waterproof": (("impermeable", None),), "ventilation": (("ventilations", None),)})
category_frame("x12_frame_trouser_attributes", "trousers", {"material": (("cuir", "leather"), ("textile", "textile")), "waterproof": (("impermeable", None),), "ventilation": (("ventilations", None),)})
category_frame("x13_frame_boot_attributes", "boots", {"material": (("cuir", "leather"), ("textile", "textile")), "waterproof": (("impermeable", None),), "ventilation": (("ventilations", None),)})


@frame("x14_frame_merge_readings", """WITH r AS (SELECT l_partkey AS product, CASE l_linenumber % 2 WHEN 0 THEN 'safety' ELSE 'shell' END AS name, CASE l_suppkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'web' ELSE 'feed' END AS source, concat('v', CAST(l_quantity AS INT) % 3) AS value FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY product, name ORDER BY CASE source WHEN 'manual' THEN 1 WHEN 'web' THEN 2 ELSE 3 END, value) AS n FROM r), d AS (SELECT product, name, count(DISTINCT value) AS kinds FROM r GROUP BY product, name)
SELECT k.product, k.name, k.value, k.source FROM k JOIN d ON d.product = k.product AND d.name = k.name WHERE n = 1 AND (k.name <> 'safety' OR kinds = 1)""")
def x14(spark, sf_dir):
    read = run_text(spark, sf_dir, "SELECT l_partkey AS product, CASE l_linenumber % 2 WHEN 0 THEN 'safety' ELSE 'shell' END AS name, CASE l_suppkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'web' ELSE 'feed' END AS source, concat('v', CAST(l_quantity AS INT) % 3) AS value FROM lineitem")
    return extract.merge_readings(read, "product", ["manual", "web"], ["safety"])




PRODUCTS = f"""SELECT product_id, min(brand) AS brand, min(category) AS category, min(size) AS size, min(title) AS title, min(cents) AS cents, max(cents) AS high_cents, max(wide) AS list_cents, count(DISTINCT merchant_id) AS merchants, min(seen) AS first_seen, bool_or(in_stock) AS in_stock FROM offer GROUP BY product_id"""


def products(spark, sf_dir):
    return run_text(spark, sf_dir, f"WITH {OFFER} {PRODUCTS}")


FILTERS = listing.Filters(brands=("Brand#1", "Brand#2", "Brand#5"), categories=("PROMO", "SMALL", "LARGE"), high=120_000, words=("red",), merchants=5)
_OTHERS = "cents <= 120000 AND contains(title, 'red') AND merchants >= 5"
_BRANDS, _CATEGORIES = "brand IN ('Brand#1', 'Brand#2', 'Brand#5')", "category IN ('PROMO', 'SMALL', 'LARGE')"


@frame("b07_frame_optional_predicates", f"WITH {OFFER}, p AS ({PRODUCTS}) SELECT product_id, brand, cents FROM p WHERE {_BRANDS} AND {_CATEGORIES} AND {_OTHERS} ORDER BY cents, product_id LIMIT 48")
def b07(spark, sf_dir):
    return listing.listing(products(spark, sf_dir), FILTERS, "price").select("product_id", "brand", "cents")


@frame("q38_frame_facets", f"""WITH {OFFER}, p AS ({PRODUCTS}) SELECT 'brands' AS facet, brand AS value, count(*) AS n FROM p WHERE {_CATEGORIES} AND {_OTHERS} GROUP BY brand
UNION ALL SELECT 'categories', category, count(*) FROM p WHERE {_BRANDS} AND {_OTHERS} GROUP BY category UNION ALL SELECT 'sizes', CAST(size AS VARCHAR), count(*) FROM p WHERE {_BRANDS} AND {_CATEGORIES} AND {_OTHERS} GROUP BY size""")
def q38(spark, sf_dir):
    """All facets by one grouped count."""
    return listing.facets(products(spark, sf_dir), FILTERS, [("brands", "brand"), ("categories", "category"), ("sizes", "size")])


_DAY = "o_orderkey % 28 + 1"
_NAME = "concat('MOTO', o_orderkey % 90 + 10)"
#: What pages write of a code, by the remainder of their id: seven ways that lead to one, then words and offers that are none.
_WAYS = (
    f"concat('CODE ', {_NAME}, ' - ACTIF -', o_orderkey % 50 + 10, '%')", "'-20 % avec le code TVA ici'", f"concat('rien de mieux avec le code ', {_NAME})", f"concat('code promo : ', {_NAME}, ' -', o_orderkey % 50 + 10, '%')", f"concat('le code : ', {_NAME})", f"concat('saisissez le code ', {_NAME})",
    f"concat('CODE ', {_NAME}, ' ici')", "'CODE POSTAL'", f"concat('CODE ', {_NAME}, ' inactif')", f"concat('CODE ', {_NAME}, ' GANTS ET CASQUES')", f"concat('inscription et rabais avec le code ', {_NAME})", f"concat('offre terminée avec le code ', {_NAME})", "'Code Promo CITROUILLE puis -20 % avec le code TVA ici'", "'CODE SUPER et CODE 2026'",
)
#: Pages with a code, its validity in one of five forms on either side of it, an older one far above, and conditions.
PROMO = f"""SELECT o_orderkey AS page_id, concat('<p>Offre &amp; remise du 01/01/2020 au 02/01/2020</p> ', repeat('mot ', 80), CASE o_orderkey % 5 WHEN 1 THEN concat('valable jusqu au : 2024-02-', lpad(CAST({_DAY} AS VARCHAR(2)), 2, '0'), ' ') WHEN 3 THEN concat('du 01/02/2024 au ', {_DAY}, '/02/24 ') ELSE '' END,
  CASE o_orderkey % {len(_WAYS)} {" ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_WAYS))} END,
  CASE o_orderkey % 5 WHEN 0 THEN concat(' jusqu au ', {_DAY}, '/2/2024') WHEN 2 THEN concat(' du 1er février au ', {_DAY}, ' février') WHEN 4 THEN concat(' jusqu au jeudi ', {_DAY}, ' févr') ELSE '' END,
  CASE WHEN o_orderkey % 2 = 0 THEN ' dès 79,90 € d achat, hors soldes, non cumulable' ELSE '' END, ' <b>fin</b>') AS html FROM orders"""
#: What the pages say, from the rule that makes them.
_SAID = f"""said AS (SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 14 IN (1, 12) THEN 'TVA' ELSE {_NAME} END AS code, CASE o_orderkey % 14 WHEN 0 THEN 50 WHEN 1 THEN 45 WHEN 12 THEN 45 WHEN 2 THEN 40 WHEN 3 THEN 30 WHEN 4 THEN 25 WHEN 5 THEN 25 ELSE 10 END AS score FROM orders WHERE o_orderkey % 14 IN (0, 1, 2, 3, 4, 5, 6, 12))"""


@frame("x16_frame_promo_codes", f"""WITH {_SAID} SELECT page_id, code, score, CASE WHEN page_id % 5 IN (2, 3) THEN make_date(2024, 2, 1) END AS starts, make_date(2024, 2, page_id % 28 + 1) AS ends,
  CASE WHEN code = 'TVA' THEN '-20 % avec le code TVA' WHEN score IN (30, 50) THEN concat('-', page_id % 50 + 10, ' % avec le code ', code) ELSE concat('Code promo ', code) END AS discount, CASE WHEN page_id % 2 = 0 THEN 'dès 79,90 € d''achat · hors soldes · non cumulable' ELSE '' END AS conditions FROM said""")
def x16(spark, sf_dir):
    """Codes of page texts with their score, validity, discount label and conditions (X16 to X18)."""
    pages = run_text(spark, sf_dir, PROMO.replace("VARCHAR(2)", "STRING")).repartition(_width(spark), "page_id").withColumn("text", promo.page_text(F.col("html")))
    return promo.described(promo.find_codes(pages, "page_id", "text"), F.lit("2024-01-15").cast("date")).select("page_id", "code", "score", "starts", "ends", "discount", "conditions")


@frame("x26_frame_scan_of_pages", f"""WITH {_SAID}, c AS (SELECT DISTINCT page_id % 50 AS merchant, code, page_id % 4 AS lot FROM said), state AS (SELECT DISTINCT merchant, code FROM c WHERE lot <> 1), found AS (SELECT DISTINCT merchant, code FROM c WHERE lot <> 0)
SELECT merchant, code FROM state WHERE merchant % 5 = 0 UNION SELECT merchant, code FROM found""")
def x26(spark, sf_dir):
    """Yesterday's codes after today's scan, in which every fifth merchant's pages did not answer."""
    pages = run_text(spark, sf_dir, PROMO.replace("VARCHAR(2)", "STRING")).repartition(_width(spark), "page_id").withColumn("text", promo.page_text(F.col("html")))
    read = promo.codes(pages, "page_id", "text").selectExpr("page_id % 50 as merchant", "code", "page_id % 4 as lot")
    state, found = (read.where(c).select("merchant", "code").distinct() for c in ("lot <> 1", "lot <> 0"))
    answered = read.select("merchant").where("merchant % 5 <> 0").distinct()
    return promo.live_codes(state, found, answered, "merchant")


@frame("q29_frame_value_families", f"""WITH {OFFER}, v AS (SELECT product_id, merchant_id, max(wide) AS wide FROM offer GROUP BY product_id, merchant_id), f AS (SELECT a.product_id, a.wide, count(*) AS members, max(b.wide) AS top FROM v a JOIN v b ON b.product_id = a.product_id AND abs(a.wide - b.wide) <= 0.01 * greatest(a.wide, b.wide) GROUP BY a.product_id, a.merchant_id, a.wide),
r AS (SELECT product_id, top AS wide, members, row_number() OVER (PARTITION BY product_id ORDER BY members DESC, top DESC) AS k FROM f) SELECT product_id, wide, members FROM r WHERE k = 1""")
def q29(spark, sf_dir):
    per = offers(spark, sf_dir).groupBy("product_id", "merchant_id").agg(F.max("wide").alias("wide"))
    return groups.value_families(per, ["product_id"], "wide", 0.01).drop("family_low")


#: Three sources of a product's list price, some silent and some up to 2 % off; and what it costs.
STATED = """SELECT o.product_id, concat('source', o.merchant_id % 3) AS source, max(CAST(floor(t.list * (1000 + CASE (o.product_id + o.merchant_id % 3) % 7 WHEN 0 THEN 9 WHEN 1 THEN 10 WHEN 2 THEN 21 ELSE 0 END) / 1000) AS BIGINT)) AS wide
  FROM offer o JOIN (SELECT product_id, max(cents) AS list FROM offer GROUP BY product_id) t ON t.product_id = o.product_id WHERE (o.product_id + 2 * (o.merchant_id % 3)) % 5 < 2 OR o.product_id % 11 = 0 GROUP BY o.product_id, o.merchant_id % 3"""
_BEST = "SELECT product_id, min(CASE product_id % 4 WHEN 0 THEN cents WHEN 1 THEN floor(cents / 4) ELSE floor(cents * 0.8) END) AS low FROM offer WHERE live GROUP BY product_id"


@frame("q29_list_price_consensus", f"""WITH {OFFER}, s AS ({STATED}), b AS ({_BEST}), f AS (SELECT a.product_id, a.source, count(*) AS n, max(x.wide) AS top, string_agg(x.source, '+' ORDER BY x.source) AS sources FROM s a JOIN s x ON x.product_id = a.product_id AND abs(x.wide - a.wide) <= 0.01 * greatest(x.wide, a.wide) GROUP BY a.product_id, a.source),
r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY n DESC, top DESC, sources) AS k, count(*) OVER (PARTITION BY product_id) AS heard FROM f)
SELECT product_id, top AS wide, CAST(CASE WHEN n > 1 THEN 1 ELSE 2 END AS INTEGER) AS tier, sources FROM r JOIN b USING (product_id) WHERE k = 1 AND (n > 1 AND top <= 3 * low OR heard = 1 AND sources = 'source1' AND top BETWEEN 1.03 * low AND 1.5 * low)""")
def q29_prices(spark, sf_dir):
    """List prices on which sources agree within 1 %, or which a trusted source states alone."""
    stated = run_text(spark, sf_dir, f"WITH {OFFER} {STATED}")
    best = run_text(spark, sf_dir, f"WITH {OFFER} {_BEST}")
    return prices.list_price_consensus(stated, best, ["product_id"], "source", "wide", "low", trusted=["source1"])


#: Blocks of ten products with chains of merges, some undone in the middle, and merged again.
_MERGES = "SELECT p_partkey * 10 + k AS seq, p_partkey * 10 + k AS merge, p_partkey + a AS product, p_partkey + b AS survivor FROM part JOIN (VALUES (1, 1, 2, 1), (1, 6, 2, 1), (2, 2, 3, 1), (4, 1, 4, 4), (6, 3, 5, 1), (7, 7, 5, 3)) AS v(k, a, b, every) ON p_partkey % 10 = 0 AND p_partkey / 10 % every = 0"
_UNDOS = "SELECT p_partkey * 10 + k AS seq, p_partkey * 10 + undone AS merge FROM part JOIN (VALUES (3, 1, 2), (5, 2, 3), (8, 6, 5), (9, 1, 4)) AS v(k, undone, every) ON p_partkey % 10 = 0 AND p_partkey / 10 % every = 0"


@frame("q22_merge_chains", f"""WITH RECURSIVE {OFFER}, m AS ({_MERGES.replace("/ 10", "// 10")}), u AS ({_UNDOS.replace("/ 10", "// 10")}), back AS (SELECT u.merge, min(u.seq) AS seq FROM u JOIN (SELECT merge, min(seq) AS made FROM m GROUP BY merge) x ON x.merge = u.merge AND u.seq > x.made GROUP BY u.merge),
life(product, holder, since, trace) AS (SELECT DISTINCT product, product, CAST(0 AS BIGINT), CAST([] AS STRUCT(merge BIGINT, place BIGINT)[]) FROM m
  UNION ALL SELECT product, place, seq, trace FROM (SELECT l.product, e.place, e.seq, CASE WHEN e.merge IS NULL THEN l.trace ELSE list_append(l.trace, {{'merge': e.merge, 'place': l.holder}}) END AS trace, row_number() OVER (PARTITION BY l.product ORDER BY e.seq) AS k
    FROM life l JOIN LATERAL (SELECT m.seq, m.merge, m.survivor AS place FROM m WHERE m.product = l.holder AND m.seq > l.since UNION ALL SELECT b.seq, NULL, t.h.place FROM (SELECT unnest(l.trace) AS h) t JOIN back b ON b.merge = t.h.merge WHERE b.seq > l.since) e ON TRUE) x WHERE k = 1),
ends AS (SELECT product, arg_max(holder, since) AS holder, max(len(trace)) AS merges FROM life GROUP BY product)
SELECT coalesce(e.holder, o.product_id) AS product, count(*) AS offers, count(e.product) AS of_merged FROM offer o LEFT JOIN ends e ON e.product = o.product_id GROUP BY 1""")
def q22_chains(spark, sf_dir):
    """Offers of each product after a journal of merges, chains among them, and undoings in the middle."""
    merges, undos = (run_text(spark, sf_dir, text.replace("/ 10", "DIV 10")) for text in (_MERGES, _UNDOS))
    held = journal.replayed(merges, undos).select(F.col("product").alias("merged"), "holder")
    moved = offers(spark, sf_dir).select("product_id").join(held, F.expr("product_id = merged"), "left")
    return moved.groupBy(F.coalesce("holder", "product_id").alias("product")).agg(F.count("*").alias("offers"), F.count("merged").alias("of_merged"))


#: Groups of some three products with signals that agree in many of them.
_BLOCK = "CAST(floor(product_id / 700.0) AS BIGINT)"
SIGNALS = f"""SELECT product_id % 700 AS grp, product_id AS product, CASE product_id % 700 % 7 WHEN 0 THEN 'unknown' WHEN 1 THEN CASE WHEN product_id % 3 = 0 THEN 'WH' ELSE 'BK|MAT' END ELSE 'BK|MAT' END AS colour,
  CASE WHEN product_id % 41 = 0 THEN 'F-E' WHEN product_id % 2 = 0 THEN 'H-A' ELSE 'U-A' END AS genre, CASE WHEN product_id % 43 = 0 THEN 2023 WHEN product_id % 4 = 0 THEN 2024 END AS year, concat('T', CASE WHEN product_id % 47 = 0 THEN 0 ELSE {_BLOCK} END) AS size,
  concat(376000000000 + product_id % 700 * 1000 + CASE WHEN product_id % 37 = 0 THEN 0 ELSE {_BLOCK} * (5 + product_id % 700 % 3 * 8) END, '0') AS gtin, CASE WHEN product_id % 3 = 0 AND product_id % 5 > 0 OR product_id % 700 % 4 = 0 THEN concat('R', product_id % 700) END AS ref, CAST(cents AS DOUBLE) AS price FROM offer"""


@frame("u05_group_verdicts", f"""WITH {OFFER}, o AS ({SIGNALS}), p AS (SELECT grp, product, max(nullif(colour, 'unknown')) AS colour, max(split_part(genre, '-', 1)) AS sex, max(split_part(genre, '-', 2)) AS age, max(year) AS year, median(price) AS price, max(size) AS size, max(gtin) AS gtin, max(ref) AS ref FROM o GROUP BY grp, product),
pair AS (SELECT a.grp, a.product, bool_or(a.size = b.size) AS same_size, bool_or(a.size = b.size AND a.gtin <> b.gtin) AS clash, bool_or(a.gtin = b.gtin) AS shared, bool_or(left(a.gtin, 9) = left(b.gtin, 9) AND abs(CAST(left(a.gtin, 12) AS BIGINT) - CAST(left(b.gtin, 12) AS BIGINT)) <= 20) AS near FROM p a JOIN p b ON b.grp = a.grp AND b.product <> a.product GROUP BY a.grp, a.product),
g AS (SELECT p.grp, count(DISTINCT colour) AS colours, max(colour) AS colour, bool_or(colour IS NULL) AS bare, count(DISTINCT nullif(sex, 'U')) AS sexes, count(DISTINCT age) AS ages, count(DISTINCT year) AS years, CASE WHEN count(*) > 1 THEN max(price) / min(price) ELSE 1.0 END AS ratio, coalesce(bool_or(same_size), FALSE) AS doubled, coalesce(bool_or(clash), FALSE) AS clash,
  coalesce(bool_or(shared), FALSE) AS code, count(DISTINCT ref) = 1 AND count(ref) = count(*) AS one_ref, coalesce(bool_and(coalesce(near, FALSE)), FALSE) AS near FROM p LEFT JOIN pair ON pair.grp = p.grp AND pair.product = p.product GROUP BY p.grp)
SELECT grp, CASE WHEN colours > 1 OR sexes > 1 OR ages > 1 OR years > 1 OR clash OR ratio > 3 THEN 'refused' WHEN colours = 1 AND NOT bare AND ratio <= 1.5 AND (code OR one_ref) THEN 'safe' WHEN colours = 1 AND NOT bare AND ratio <= 1.5 AND NOT doubled AND near THEN 'probable' ELSE 'doubtful' END AS verdict,
  CASE WHEN colours > 1 OR sexes > 1 OR ages > 1 OR years > 1 OR clash OR ratio > 3 THEN (colours > 1)::INT + (sexes > 1)::INT + (ages > 1)::INT + (years > 1)::INT + clash::INT + (ratio > 3)::INT ELSE code::INT + one_ref::INT + (NOT doubled)::INT + (NOT doubled AND near)::INT + (bare OR colours = 1)::INT + 1 END AS reasons FROM g""")
def u05(spark, sf_dir):
    """Verdicts on groups of products that look alike, and how many reasons each has."""
    signals = run_text(spark, sf_dir, f"WITH {OFFER} {SIGNALS}")
    return verdicts.group_verdicts(signals).select("grp", "verdict", F.size("reasons").alias("reasons"))


_OFFERS_TO_MOVE = "SELECT offer_id, product_id AS gtin, merchant_id % 9 > 0 OR feed_id % 5 > 0 AS resolved FROM offer"
_UNITS = "SELECT p_partkey AS gtin, concat('h', p_partkey % 6) AS identity, p_partkey % 17 = 0 AS conflict FROM part"
_LINKED = "SELECT p_partkey AS gtin, p_partkey % 400 AS product, concat('h', p_partkey % 400 % 6) AS identity FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, p_partkey % 9, concat('h', p_partkey % 9 % 6) FROM part WHERE p_partkey % 50 = 1"
_REFUSED, _NIGHT = "SELECT p_partkey AS gtin FROM part WHERE p_partkey % 7 = 0", "2024-03-05"
_LOG = "SELECT offer_id, product_id AS gtin, product_id AS product, 'h' AS own_hash, DATE '2024-03-04' AS night FROM offer WHERE feed_id % 10 = 0"


@frame("q09_reattach_log", f"""WITH {OFFER}, o AS ({_OFFERS_TO_MOVE}), u AS ({_UNITS}), l AS ({_LINKED}), was AS ({_LOG}), t AS (SELECT gtin, min(product) AS product, max(identity) AS theirs FROM l GROUP BY gtin HAVING count(DISTINCT product) = 1),
m AS (SELECT o.offer_id, o.gtin, t.product, u.identity AS own_hash FROM o JOIN u ON u.gtin = o.gtin JOIN t ON t.gtin = o.gtin WHERE NOT o.resolved AND NOT u.conflict AND u.identity <> t.theirs AND o.gtin NOT IN ({_REFUSED}) AND t.product IN (SELECT product FROM l GROUP BY product HAVING count(DISTINCT gtin) <= 25)),
made AS (SELECT * FROM m WHERE (SELECT count(*) FROM m) <= 1000000)
SELECT offer_id, gtin, product, own_hash, DATE '{_NIGHT}' AS night FROM made UNION ALL SELECT * FROM was WHERE offer_id NOT IN (SELECT offer_id FROM made)""")
def q09_log(spark, sf_dir):
    """The log of reattached offers after one more night."""
    texts = {k: run_text(spark, sf_dir, f"WITH {OFFER} {text}") for k, text in (("offers", _OFFERS_TO_MOVE), ("units", _UNITS), ("linked", _LINKED), ("refused", _REFUSED), ("log", _LOG))}
    moved = reattach.moves(texts["offers"], texts["units"], texts["linked"], texts["refused"], offers_most=1_000_000)
    return reattach.logged(texts["log"], moved, _NIGHT)
