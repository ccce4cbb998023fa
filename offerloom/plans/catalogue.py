"""Queries of the comparison site and of its operation (survey Q31 to Q57 and Q60 to Q67)."""

from offerloom.functions import text as t
from offerloom.plans.dialect import AS_OF, OFFER, plan

#: Cheapest and dearest merchant of each product, each merchant by its own lowest price.
SPREAD = f"""{OFFER}, per AS (SELECT product_id, merchant_id, min(cents) AS cents FROM offer WHERE coalesce(in_stock, TRUE) GROUP BY product_id, merchant_id),
spread AS (SELECT product_id, min(cents) AS low, max(cents) AS high, count(*) AS merchants FROM per GROUP BY product_id)"""
#: Attributes of products in long form, from several sources.
FACTS = """fact AS (
  SELECT l_partkey AS product, CASE l_linenumber % 4 WHEN 0 THEN 'weight' WHEN 1 THEN 'shell' WHEN 2 THEN 'norm' ELSE 'vents' END AS name, CASE l_suppkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'web' ELSE 'feed' END AS source, max(CAST(l_quantity AS BIGINT)) AS value
  FROM lineitem GROUP BY 1, 2, 3)"""


@plan("q31_merchant_gap")
def _(d):
    return f"""WITH {SPREAD}, {AS_OF}, g AS (SELECT s.product_id, p_brand, p_name, low, high, {d.bucket("100 - 100 * low / CAST(high AS DOUBLE)", "5", "20", "4")} AS band, md5(concat({d.string("s.product_id")}, {d.string("day")})) AS h FROM spread s JOIN part ON p_partkey = s.product_id, today WHERE merchants >= 2 AND high <= 2 * low AND high >= 1.15 * low AND high - low >= 2500),
one AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY high - low DESC, product_id) AS m FROM g), b AS (SELECT *, row_number() OVER (PARTITION BY band, p_brand ORDER BY h) AS k FROM one WHERE m = 1), r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY k, h) AS place FROM b)
SELECT band, CAST(place AS BIGINT) AS place, product_id, low, high FROM r WHERE place <= 8"""


@plan("q32_new_arrivals")
def _(d):
    return f"""WITH {OFFER}, f AS (SELECT product_id, brand, min(seen) AS first_seen FROM offer GROUP BY product_id, brand), bounds AS (SELECT min(first_seen) AS loaded FROM f),
n AS (SELECT f.* FROM f CROSS JOIN bounds WHERE first_seen > loaded), r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY first_seen DESC, product_id) AS k FROM n)
SELECT product_id, brand, first_seen FROM r ORDER BY k, first_seen DESC, product_id LIMIT 48"""


@plan("q33_true_price_drops")
def _(d):
    return f"""WITH {OFFER}, {AS_OF}, h AS (SELECT product_id, merchant_id, seen, min(wide) AS cents FROM offer GROUP BY product_id, merchant_id, seen),
w AS (SELECT h.*, row_number() OVER (PARTITION BY product_id, merchant_id ORDER BY seen) AS a, row_number() OVER (PARTITION BY product_id, merchant_id ORDER BY seen DESC) AS z FROM h, today WHERE seen >= day - INTERVAL 2000 DAY),
pair AS (SELECT x.product_id, x.merchant_id, x.cents AS before, y.cents AS now FROM w x JOIN w y ON y.product_id = x.product_id AND y.merchant_id = x.merchant_id AND y.z = 1 WHERE x.a = 1 AND y.a > 1),
low AS (SELECT product_id, min(now) AS low FROM pair GROUP BY product_id)
SELECT p.product_id, p.merchant_id, p.before, p.now FROM pair p JOIN low ON low.product_id = p.product_id AND p.now = low.low
WHERE p.now <= 0.9 * p.before AND p.now >= 0.45 * p.before AND p.before - p.now >= 2000 AND NOT EXISTS (SELECT 1 FROM h, today WHERE h.product_id = p.product_id AND h.merchant_id = p.merchant_id AND h.seen < day - INTERVAL 2000 DAY AND h.cents = p.now)"""


@plan("q34_same_barcode_deals")
def _(d):
    return f"""WITH {SPREAD}, g AS (SELECT product_id, p_brand, low, high, 1 - low / CAST(high AS DOUBLE) AS discount FROM spread JOIN part ON p_partkey = product_id WHERE merchants >= 2 AND high <= 1.9 * low AND low >= 1500 AND low <= 0.9 * high), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY discount DESC, product_id) AS k FROM g)
SELECT product_id, p_brand, low, high FROM r WHERE k <= 3"""


@plan("q35_similar_items")
def _(d):
    return f"""WITH {SPREAD}, me AS (SELECT p_brand AS b, p_type AS c, p_size AS s, low AS l FROM spread JOIN part ON p_partkey = product_id WHERE product_id = 21), r AS (SELECT product_id, p_brand, p_name, low, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY low, product_id) AS k FROM spread JOIN part ON p_partkey = product_id JOIN me ON p_type = c WHERE product_id <> 21 AND low BETWEEN 0.75 * l AND 1.25 * l)
SELECT product_id, p_brand, low FROM r CROSS JOIN me WHERE k = 1 ORDER BY p_brand IS DISTINCT FROM b, abs(low - l) / CAST(l AS DOUBLE), product_id LIMIT 12"""


@plan("q36_price_curve")
def _(d):
    return f"""WITH {OFFER}, r AS (SELECT product_id, seen, cents, merchant_id, row_number() OVER (PARTITION BY product_id, seen ORDER BY cents, merchant_id, offer_id) AS k FROM offer) SELECT product_id, seen, cents, merchant_id FROM r WHERE k = 1"""


def filtered(where: str) -> str:
    return f"""{SPREAD}, listed AS (SELECT product_id, p_brand AS brand, p_type AS category, p_size AS size, p_name AS name, low, high, merchants FROM spread JOIN part ON p_partkey = product_id WHERE {where})"""


@plan("q37_filtered_listing")
def _(d):
    return f"""WITH {filtered("p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_size BETWEEN 5 AND 40")} SELECT product_id, brand, low, total FROM listed CROSS JOIN (SELECT count(*) AS total FROM listed WHERE low <= 150000) n WHERE low <= 150000 ORDER BY low, product_id LIMIT 48"""


@plan("q38_facets_own_criterion_lifted")
def _(d):
    return f"""WITH {filtered("TRUE")}
SELECT 'brand' AS facet, brand AS value, count(*) AS n FROM listed WHERE category = 'PROMO' AND size <= 25 GROUP BY brand
UNION ALL SELECT 'category', category, count(*) FROM listed WHERE brand = 'Brand#5' AND size <= 25 GROUP BY category
UNION ALL SELECT 'size', {d.string("size")}, count(*) FROM listed WHERE brand = 'Brand#5' AND category = 'PROMO' GROUP BY size HAVING count(*) >= 1
UNION ALL SELECT 'word', word, count(DISTINCT product_id) FROM (SELECT product_id, {d.unnest(d.split("name", " "))} AS word FROM listed WHERE brand = 'Brand#5') w GROUP BY word"""


@plan("q39_category_tree_counts")
def _(d):
    return f"""WITH {OFFER}, leaf AS (SELECT s_nationkey AS id, count(DISTINCT product_id) AS n FROM offer JOIN supplier ON s_suppkey = merchant_id WHERE live GROUP BY s_nationkey)
SELECT r_name AS root, n_name AS leaf, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY r_regionkey) AS BIGINT) AS root_n FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN leaf ON leaf.id = n_nationkey"""


@plan("q40_keyword_search")
def _(d):
    x = t.search_text("concat(p_brand, ' ', p_name, ' ', p_type)", d)
    return f"""WITH s AS (SELECT p_partkey AS id, {x} AS body FROM part), q AS (SELECT {d.unnest(d.array("'red'", "'ring'"))} AS word), hit AS (SELECT id, word FROM s JOIN q ON contains(body, word))
SELECT id FROM hit GROUP BY id HAVING count(DISTINCT word) = (SELECT count(*) FROM q)"""


@plan("q41_suggest_matrix")
def _(d):
    return """SELECT p_brand AS brand, p_type AS department, count(*) AS n FROM part GROUP BY p_brand, p_type HAVING count(*) >= 2"""


@plan("q41_in_brand_similarity")
def _(d):
    sim = t.trigram_similarity("w", "'widgt'", d)
    return f"""WITH w AS (SELECT p_partkey, p_name, {d.unnest(d.split("p_name", " "))} AS w FROM part WHERE p_brand = 'Brand#4'), s AS (SELECT p_partkey, max({sim}) AS similarity FROM w GROUP BY p_partkey)
SELECT p_partkey, similarity FROM s ORDER BY similarity DESC, p_partkey LIMIT 8"""


@plan("q42_barcode_lookup")
def _(d):
    return f"""WITH {OFFER}, r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY live DESC, seen DESC, offer_id) AS k FROM offer WHERE product_id IN (1, 17, 40)) SELECT product_id, offer_id, live, seen FROM r WHERE k = 1"""


@plan("q43_best_source_per_attribute")
def _(d):
    return f"""WITH {FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY product, name ORDER BY CASE source WHEN 'manual' THEN 1 WHEN 'web' THEN 2 ELSE 3 END, value) AS k, count(DISTINCT CASE WHEN source <> 'manual' THEN value END) AS kinds FROM fact GROUP BY product, name, source, value)
SELECT product, name, source, value FROM r WHERE k = 1 AND NOT (name = 'shell' AND source <> 'manual')""".replace(", count(DISTINCT CASE WHEN source <> 'manual' THEN value END) AS kinds FROM fact GROUP BY product, name, source, value", " FROM fact")


@plan("q44_comparison_table")
def _(d):
    return f"""WITH {FACTS}, v AS (SELECT product, name, max(value) AS value FROM fact WHERE product IN (3, 6, 9) GROUP BY product, name)
SELECT name, max(value) FILTER (WHERE product = 3) AS first, max(value) FILTER (WHERE product = 6) AS second, max(value) FILTER (WHERE product = 9) AS third, max(value) AS best, count(DISTINCT value) > 1 AS differs FROM v GROUP BY name"""


@plan("q45_scores")
def _(d):
    return f"""WITH {FACTS}, v AS (SELECT product, max(value) FILTER (WHERE name = 'weight' AND source = 'manual') AS lab, max(value) FILTER (WHERE name = 'shell') AS shell, max(value) FILTER (WHERE name = 'norm' AND source = 'web') AS norm, count(DISTINCT name) AS present FROM fact GROUP BY product),
s AS (SELECT product, present, CASE WHEN lab IS NOT NULL AND (shell IS NOT NULL OR norm IS NOT NULL) THEN CAST(5 * lab + 3 * coalesce(shell, 0) + 2 * coalesce(norm, 0) AS DOUBLE) / (5 + CASE WHEN shell IS NULL THEN 0 ELSE 3 END + CASE WHEN norm IS NULL THEN 0 ELSE 2 END) END AS protection, 5 + 5 * present / CAST(4 AS DOUBLE) AS equipment FROM v)
SELECT product, protection, equipment, CASE WHEN protection IS NOT NULL THEN (2 * protection + equipment) / 3 END AS global FROM s"""


@plan("q46_attribute_distribution")
def _(d):
    return f"""WITH {SPREAD}, {FACTS} SELECT name, value % 10 AS value, count(*) AS products, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY low) AS DOUBLE) AS median_low FROM fact JOIN spread ON product_id = product WHERE source = 'feed' GROUP BY name, value % 10"""


@plan("q47_offer_table")
def _(d):
    return f"""WITH {OFFER}, g AS (SELECT product_id, merchant_id, cents, {d.join_set("CASE WHEN position > 2 THEN lpad(concat('', size), 2, '0') END", " ")} AS sizes, count(*) AS lines FROM offer WHERE live GROUP BY product_id, merchant_id, cents)
SELECT product_id, merchant_id, cents, sizes, lines, CAST(row_number() OVER (PARTITION BY product_id ORDER BY cents, merchant_id, sizes) AS BIGINT) AS place FROM g"""


@plan("q49_buyable_sizes")
def _(d):
    return f"""WITH {OFFER}, b AS (SELECT DISTINCT brand, category, size, CASE WHEN size <= 9 THEN 'letters' ELSE 'numbers' END AS scale FROM offer WHERE live AND coalesce(in_stock, TRUE)), n AS (SELECT brand, category, scale, count(*) AS sizes FROM b GROUP BY brand, category, scale)
SELECT brand, category, scale, sizes FROM n WHERE sizes >= 5"""


@plan("q50_price_alerts")
def _(d):
    return f"""WITH {OFFER}, best AS (SELECT product_id, min(cents) AS cents FROM offer WHERE live AND coalesce(in_stock, TRUE) GROUP BY product_id),
alert AS (SELECT c_custkey AS id, c_custkey % 2000 AS product_id, CASE WHEN c_custkey % 3 = 0 THEN CAST(floor(c_acctbal * 20) AS BIGINT) END AS target, CASE WHEN c_custkey % 3 = 1 THEN 95000 + c_custkey END AS reference, CASE WHEN c_custkey % 4 = 0 THEN 90000 END AS last_notified FROM customer)
SELECT a.id, b.cents, CASE WHEN a.last_notified IS NOT NULL AND b.cents >= a.last_notified THEN FALSE WHEN a.target IS NOT NULL THEN b.cents <= a.target WHEN a.reference IS NOT NULL THEN b.cents < a.reference ELSE TRUE END AS notify FROM alert a JOIN best b ON b.product_id = a.product_id"""


@plan("q51_incomplete_products")
def _(d):
    return f"""WITH {FACTS}, n AS (SELECT p_partkey AS product, count(DISTINCT name) AS present FROM part LEFT JOIN fact ON product = p_partkey GROUP BY p_partkey)
SELECT product, present, CASE WHEN present = 4 THEN 'complete' WHEN present > 0 THEN 'partial' ELSE 'empty' END AS state FROM n"""


@plan("q52_catalogue_health")
def _(d):
    return f"""WITH {OFFER} SELECT 'offers' AS metric, count(*) AS n FROM offer UNION ALL SELECT 'live offers', count(*) FROM offer WHERE live UNION ALL SELECT 'products', count(DISTINCT product_id) FROM offer UNION ALL SELECT 'single merchant', count(*) FROM (SELECT product_id FROM offer GROUP BY product_id HAVING count(DISTINCT merchant_id) = 1) a
UNION ALL SELECT 'duplicate keys', count(*) FROM (SELECT sku FROM offer GROUP BY sku HAVING count(*) > 1) b UNION ALL SELECT 'several brands', count(*) FROM (SELECT sku FROM offer GROUP BY sku HAVING count(DISTINCT brand) > 1) c UNION ALL SELECT 'wide gap', count(*) FROM (SELECT product_id FROM offer GROUP BY product_id HAVING max(wide) >= 5 * min(wide)) e
UNION ALL SELECT 'unknown stock', count(*) FROM offer WHERE in_stock IS NULL"""


@plan("q53_operations_dashboard")
def _(d):
    return f"""WITH {OFFER}, m AS (SELECT merchant_id, count(*) AS n, count(*) FILTER (WHERE live) AS live, max(seen) AS last_seen, count(*) FILTER (WHERE NOT coalesce(in_stock, TRUE)) AS out FROM offer GROUP BY merchant_id), l AS (SELECT merchant_id, offer_id, row_number() OVER (PARTITION BY merchant_id ORDER BY seen DESC, offer_id) AS k FROM offer)
SELECT s_name, m.n, m.live, m.out, m.last_seen, l.offer_id AS latest FROM supplier LEFT JOIN m ON m.merchant_id = s_suppkey LEFT JOIN l ON l.merchant_id = s_suppkey AND l.k = 1""".replace(" AS out ", " AS sold_out ").replace("m.out", "m.sold_out")


@plan("q54_external_measurements")
def _(d):
    return f"""WITH lab(brand, model, stars) AS (VALUES ('Brand#1', 'red ring', 4), ('Brand#1', 'ring', 3), ('Brand#2', 'widget', 5), ('Brand#3', 'small bolt', 2)),
m AS (SELECT p_partkey, stars, model, row_number() OVER (PARTITION BY p_partkey ORDER BY length(model) DESC) AS k FROM part JOIN lab ON brand = p_brand AND contains(concat(' ', p_name, ' '), concat(' ', model, ' ')) WHERE NOT {d.matches("p_name", "\\b(jet|cross)\\b")})
SELECT p_partkey, model, stars FROM m WHERE k = 1"""


@plan("q55_price_gap_exploration")
def _(d):
    return f"""WITH {OFFER}, s AS (SELECT product_id, count(*) AS offers, count(DISTINCT merchant_id) AS merchants, min(wide) AS low, max(wide) AS high FROM offer WHERE wide > 0 GROUP BY product_id), f AS (SELECT *, high / CAST(low AS DOUBLE) AS ratio FROM s WHERE merchants >= 2)
SELECT product_id, offers, low, high, ratio FROM f WHERE ratio >= 10 ORDER BY ratio DESC, product_id"""


@plan("q56_shelf_pickers")
def _(d):
    return f"""WITH {SPREAD}, f AS (SELECT product_id, p_type AS family, p_brand, merchants, high - low AS gap FROM spread JOIN part ON p_partkey = product_id), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY merchants DESC, gap DESC, product_id) AS k FROM f)
SELECT family, CAST(k AS BIGINT) AS k, product_id, p_brand FROM r WHERE k <= 6"""


@plan("q57_sample_with_seed")
def _(d):
    return f"""SELECT doc_id, source, length(text) AS chars, {d.matches("text", "(?i)licen[sc]e")} AS hit FROM documents ORDER BY md5(concat({d.string("doc_id")}, '-7')), doc_id LIMIT 25""".replace("length(text)", d.chars("text"))


@plan("q60_gauges_from_content")
def _(d):
    return f"""SELECT event_id, CAST({d.field("props", "k")} AS BIGINT) AS gauge, CASE WHEN CAST({d.field("props", "k")} AS BIGINT) >= 66 THEN 'high' WHEN CAST({d.field("props", "k")} AS BIGINT) >= 33 THEN 'mid' ELSE 'low' END AS profile FROM events"""


@plan("q61_material_override")
def _(d):
    cond = "p_name RLIKE motif" if d.spark else "regexp_matches(p_name, motif)"
    return f"""WITH o(motif, action, value) AS (VALUES ('red ring', 'delete', ''), ('ring', 'set', 'carbon'), ('widget', 'replace', 'fibre')), base AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN 'plastic' END AS shell, p_name FROM part),
m AS (SELECT p_partkey, action, value, row_number() OVER (PARTITION BY p_partkey ORDER BY length(motif) DESC) AS k FROM base JOIN o ON {cond})
SELECT b.p_partkey, CASE m.action WHEN 'delete' THEN NULL WHEN 'set' THEN coalesce(b.shell, m.value) WHEN 'replace' THEN m.value ELSE b.shell END AS shell FROM base b LEFT JOIN m ON m.p_partkey = b.p_partkey AND m.k = 1"""


@plan("q62_lowest_recorded_price")
def _(d):
    return f"""WITH {OFFER}, {AS_OF} SELECT product_id, min(cents) AS low, min_by(seen, concat(lpad({d.string("cents")}, 12, '0'), {d.string("seen")})) AS on_day FROM offer, today WHERE seen >= day - INTERVAL 730 DAY GROUP BY product_id"""


@plan("q63_operational_monitor")
def _(d):
    return f"""WITH {OFFER}, {AS_OF}, n AS (SELECT merchant_id, count(*) FILTER (WHERE live) AS live, count(*) FILTER (WHERE live AND seen < day - INTERVAL 100 DAY) AS before, {d.days("max(day)", "max(seen)")} AS age FROM offer, today GROUP BY merchant_id)
SELECT merchant_id, live, age, (live - before) / CAST(greatest(before, 1) AS DOUBLE) AS variation, age > 30 OR live < 0.7 * before AS alarm FROM n"""


@plan("q64_owner_corrections")
def _(d):
    return f"""WITH {FACTS}, fix(product, name, value, hidden) AS (VALUES (3, 'weight', 1, FALSE), (6, 'shell', 2, FALSE), (9, 'norm', 3, TRUE))
SELECT f.product, f.name, f.source, CASE WHEN x.product IS NOT NULL THEN x.value ELSE f.value END AS value, coalesce(x.hidden, FALSE) AS hidden FROM fact f LEFT JOIN fix x ON x.product = f.product AND x.name = f.name"""


@plan("q66_product_page_figures")
def _(d):
    return f"""WITH {OFFER}, p AS (SELECT product_id, min(cents) FILTER (WHERE coalesce(in_stock, TRUE)) AS low, max(cents) FILTER (WHERE coalesce(in_stock, TRUE)) AS high, max(wide) AS list, count(DISTINCT sku) AS skus, max(seen) AS latest FROM offer WHERE live GROUP BY product_id)
SELECT product_id, low, greatest(high, CASE WHEN product_id % 2 = 0 THEN list END) AS top, CASE WHEN low <= 0.97 * high THEN CAST(floor(100 - 100 * low / CAST(high AS DOUBLE)) AS BIGINT) END AS shown_discount, high - low AS saving, CASE WHEN skus = 1 THEN 'single' ELSE 'several' END AS reference, latest FROM p"""


@plan("q67_search_routing")
def _(d):
    return f"""WITH typed(q) AS (VALUES ('3760000000017'), ('brand1'), ('promo'), ('red ring'), ('zzz')), b AS (SELECT DISTINCT lower(replace(p_brand, '#', '')) AS brand, lower(p_type) AS kind FROM part)
SELECT q, CASE WHEN {d.matches("q", "^[0-9]{8,14}$")} THEN 'barcode' WHEN q IN (SELECT brand FROM b) THEN 'brand page' WHEN q IN (SELECT kind FROM b) THEN 'department page' ELSE 'listing' END AS route FROM typed"""
