"""Predicates, joins, aggregates, windows, sorts and set operations of the catalogue (survey sections 2.1 to 2.7)."""

from offerloom.plans.dialect import AS_OF, OFFER, plan


# Sources and sinks -------------------------------------------------------------------------------------------------


@plan("a05_known_key_scan")
def _(d):
    return f"""WITH {OFFER}
SELECT offer_id, merchant_id, cents FROM offer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = merchant_id AND s_acctbal > 5000)"""


@plan("a09_json_field_scan")
def _(d):
    return f"""SELECT event_id, {d.field("props", "k")} AS k, coalesce({d.field("props", "missing")}, 'none') AS missing FROM events"""


@plan("a11_html_fields")
def _(d):
    return f"""SELECT page_id, {d.extract("html", "<title>([^<]*)</title>", 1)} AS title, {d.extract("html", '<html lang="([a-z]+)"', 1)} AS lang,
  {d.size(d.extract_all("html", "<a href="))} AS links FROM pages"""


@plan("a13_scrape_gate")
def _(d):
    return f"""SELECT count(*) AS pages, count(*) FILTER (WHERE title <> '') AS filled, count(*) > 0 AND 2 * count(*) FILTER (WHERE title <> '') >= count(*) AS accepted
FROM (SELECT {d.extract("html", "<title>([^<]*)</title>", 1)} AS title FROM pages) p"""


@plan("a14_page_text")
def _(d):
    plain = d.gsub(d.gsub(d.gsub("html", "<(script|style)[^>]*>[^<]*</(script|style)>", " "), "<[^>]*>", " "), "[ \\t\\r\\n]+", " ")
    return f"""SELECT page_id, md5(trim({plain})) AS text_md5, {d.chars(f"trim({plain})")} AS text_chars FROM pages"""


@plan("a16_inline_values")
def _(d):
    return f"""WITH {OFFER}, codes(merchant_id, verdict) AS (VALUES (1, 'synthetic'), (3, 'trusted'), (5, 'synthetic'))
SELECT verdict, count(*) AS offers, min(cents) AS low FROM offer JOIN codes ON codes.merchant_id = offer.merchant_id GROUP BY verdict"""


@plan("a17_zipped_arrays")
def _(d):
    if d.spark:
        pairs = "SELECT inline(arrays_zip(array(1, 2, 3), array('a', 'b', 'c'))) AS (n, label)"
    else:
        pairs = "SELECT unnest([1, 2, 3]) AS n, unnest(['a', 'b', 'c']) AS label"
    return f"""WITH {OFFER}, pairs AS ({pairs})
SELECT label, count(*) AS offers FROM offer JOIN pairs ON position = n GROUP BY label"""


@plan("a18_upsert_latest_wins")
def _(d):
    return f"""WITH {OFFER},
old AS (SELECT sku, offer_id, cents, seen FROM offer WHERE NOT live),
fresh AS (SELECT sku, offer_id, cents, seen FROM offer WHERE live),
best AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY seen DESC, offer_id) AS n FROM fresh)
SELECT sku, offer_id, cents, seen, TRUE AS updated FROM best WHERE n = 1
UNION ALL
SELECT sku, offer_id, cents, seen, FALSE AS updated FROM old WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.sku = old.sku)"""


@plan("a19_insert_if_absent")
def _(d):
    return f"""WITH {OFFER}, old AS (SELECT DISTINCT product_id, size FROM offer WHERE live AND merchant_id < 40), fresh AS (SELECT DISTINCT product_id, size FROM offer)
SELECT product_id, size, FALSE AS inserted FROM old
UNION ALL
SELECT product_id, size, TRUE AS inserted FROM fresh WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.product_id = fresh.product_id AND o.size = fresh.size)"""


@plan("a20_conditional_upsert")
def _(d):
    return f"""WITH {OFFER},
old AS (SELECT product_id, max(cents) AS cents, count(*) % 3 = 0 AS locked FROM offer WHERE NOT live GROUP BY product_id),
fresh AS (SELECT product_id, max(cents) AS cents FROM offer WHERE live GROUP BY product_id)
SELECT coalesce(o.product_id, f.product_id) AS product_id, CASE WHEN o.locked OR f.cents IS NULL THEN o.cents ELSE f.cents END AS cents, coalesce(o.locked, FALSE) AS locked
FROM old o FULL JOIN fresh f ON f.product_id = o.product_id"""


@plan("a28_active_by_expiry")
def _(d):
    return f"""WITH {AS_OF}
SELECT o_orderkey, o_orderpriority FROM orders, today WHERE CAST(o_orderdate AS DATE) >= today.day - INTERVAL 900 DAY AND o_orderpriority LIKE '1%'"""


@plan("a29_dimension_sync")
def _(d):
    return f"""WITH {OFFER}, seen AS (SELECT merchant_id, count(*) AS offers FROM offer GROUP BY merchant_id)
SELECT s_suppkey AS merchant_id, lower(s_name) AS label, coalesce(offers, 0) AS offers, s_acctbal > 0 AS shown FROM supplier LEFT JOIN seen ON merchant_id = s_suppkey"""


# Predicates --------------------------------------------------------------------------------------------------------


@plan("b01_first_present_alias")
def _(d):
    return f"""SELECT event_id, coalesce(nullif(trim({d.field("props", "size")}), ''), nullif(trim({d.field("props", "k")}), ''), event_type) AS value FROM events"""


@plan("b02_scope_rejection")
def _(d):
    return f"""WITH {OFFER}
SELECT category, count(*) AS kept FROM offer
WHERE category NOT IN ('PROMO') AND NOT {d.matches("title", "(^| )(ring|bolt)( |$)")} AND NOT ({d.matches("brand", "#2[0-9]")} AND size > 45) GROUP BY category"""


@plan("b03_complete_rows")
def _(d):
    return f"""WITH {OFFER} SELECT count(*) AS complete FROM offer WHERE nullif(title, '') IS NOT NULL AND nullif(brand, 'Brand#1') IS NOT NULL AND sku IS NOT NULL"""


@plan("b04_first_match_decision")
def _(d):
    return f"""WITH {OFFER}, ref AS (SELECT product_id, avg(CAST(wide AS DOUBLE)) AS mid FROM offer GROUP BY product_id)
SELECT reason, count(*) AS offers FROM (
  SELECT CASE WHEN o.product_id % 97 = 0 THEN 'bad code' WHEN o.brand = 'Brand#3' AND o.merchant_id % 2 = 0 THEN 'brand clash'
    WHEN o.wide < 0.25 * r.mid OR o.wide > 4 * r.mid THEN 'price out of range' WHEN o.product_id % 5 = 0 THEN 'known code'
    WHEN o.live THEN 'already admitted' WHEN o.category IN ('PROMO', 'SMALL') THEN 'out of category' WHEN o.size > 48 THEN 'no parent' ELSE 'held category' END AS reason
  FROM offer o JOIN ref r ON r.product_id = o.product_id) x GROUP BY reason"""


@plan("b05_showable_offers")
def _(d):
    return f"""WITH {OFFER} SELECT merchant_id, count(*) AS shown FROM offer WHERE live AND product_id IS NOT NULL AND (cents IS NULL OR cents <> 99990) GROUP BY merchant_id"""


@plan("b06_fresh_within_day")
def _(d):
    return f"""WITH {OFFER}, {AS_OF}
SELECT offer_id, seen FROM offer, today WHERE live AND seen >= today.day - INTERVAL 1 DAY"""


@plan("b08_null_safe_inequality")
def _(d):
    return f"""WITH {OFFER} SELECT a.offer_id, a.in_stock, b.in_stock AS other FROM offer a JOIN offer b ON a.sku = b.sku AND a.offer_id < b.offer_id WHERE a.in_stock IS DISTINCT FROM b.in_stock"""


@plan("b09_not_false")
def _(d):
    return f"""WITH {OFFER} SELECT product_id, count(*) FILTER (WHERE coalesce(in_stock, TRUE)) AS buyable, count(*) FILTER (WHERE in_stock) AS declared, count(*) FILTER (WHERE in_stock IS NULL) AS unknown FROM offer GROUP BY product_id"""


@plan("b10_like_patterns")
def _(d):
    return """SELECT p_partkey, p_name FROM part WHERE (p_name LIKE '%widget%' OR p_name ILIKE 'RED%') AND NOT p_brand ILIKE 'brand#1_'"""


@plan("b11_regex_words")
def _(d):
    return f"""SELECT p_partkey, {d.matches("p_name", "(?i)\\bRING\\b")} AS ring, {d.matches("p_brand", "^Brand#1[0-9]$")} AS teen FROM part"""


@plan("b12_literal_contains")
def _(d):
    return """SELECT doc_id FROM documents WHERE contains(text, '%%%') OR contains(text, '_')"""


@plan("b13_relative_band")
def _(d):
    return f"""WITH {OFFER}, ref AS (SELECT product_id, min(wide) AS low FROM offer GROUP BY product_id)
SELECT o.product_id, count(*) AS near FROM offer o JOIN ref r ON r.product_id = o.product_id WHERE o.wide BETWEEN 0.75 * r.low AND 1.25 * r.low GROUP BY o.product_id"""


@plan("b14_any_of_array")
def _(d):
    return f"""WITH {OFFER} SELECT count(*) FILTER (WHERE {d.has(d.array("1", "5", "9"), "size")}) AS some, count(*) FILTER (WHERE NOT {d.has(d.array("1", "5", "9"), "size")}) AS none FROM offer"""


@plan("b15_case_projection")
def _(d):
    return """SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'XS' WHEN p_size <= 20 THEN 'S' WHEN p_size <= 30 THEN 'M' WHEN p_size <= 40 THEN 'L' ELSE 'XL' END AS label,
  CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'letter' ELSE 'number' END AS scale FROM part"""


@plan("b16_gender_facet")
def _(d):
    return f"""WITH g AS (SELECT c_custkey, concat(CASE c_nationkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'H' WHEN 2 THEN 'U' ELSE 'F' END, '-', CASE WHEN c_custkey % 5 = 0 THEN 'E' ELSE 'A' END) AS code FROM customer)
SELECT CASE WHEN code LIKE '%-E' THEN 'child' WHEN code LIKE 'F-%' THEN 'woman' WHEN code IN ('H-A', 'U-A') THEN 'man' END AS facet, count(*) AS n FROM g GROUP BY 1"""


@plan("b17_promo_live")
def _(d):
    return f"""WITH {AS_OF}, code AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS starts, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + INTERVAL 400 DAY END AS ends, o_orderstatus = 'F' AS withdrawn FROM orders)
SELECT id FROM code, today WHERE NOT withdrawn AND starts <= today.day AND (ends IS NULL OR ends >= today.day)"""


@plan("b18_lookup_chain")
def _(d):
    return f"""WITH override AS (SELECT p_partkey AS id, 7 AS category FROM part WHERE p_size = 1), mapped(path, category) AS (VALUES ('PROMO', 3), ('SMALL', 4), ('LARGE', 5))
SELECT p_partkey, coalesce(o.category, m.category, 25) AS category FROM part LEFT JOIN override o ON o.id = p_partkey LEFT JOIN mapped m ON m.path = p_type"""


# Joins -------------------------------------------------------------------------------------------------------------


@plan("c01_inner_fact_to_dimensions")
def _(d):
    return f"""WITH {OFFER} SELECT n_name, count(*) AS offers, sum(cents) AS cents FROM offer JOIN supplier ON s_suppkey = merchant_id JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name""".replace("sum(cents)", "CAST(sum(cents) AS BIGINT)")


@plan("c02_left_composite_key")
def _(d):
    return f"""WITH {OFFER}, first_seen AS (SELECT product_id, merchant_id, min(seen) AS since FROM offer WHERE live GROUP BY product_id, merchant_id)
SELECT o.offer_id, f.since FROM offer o LEFT JOIN first_seen f ON f.product_id = o.product_id AND f.merchant_id = o.merchant_id WHERE NOT o.live"""


@plan("c03_same_code_other_merchant")
def _(d):
    return f"""WITH {OFFER} SELECT a.product_id, count(*) AS pairs FROM offer a JOIN offer b ON b.product_id = a.product_id AND b.merchant_id <> a.merchant_id WHERE a.live AND b.live GROUP BY a.product_id"""


@plan("c04_unordered_pairs")
def _(d):
    return f"""WITH {OFFER}, seen AS (SELECT DISTINCT product_id, category, size % 3 AS kind, merchant_id % 4 AS m FROM offer)
SELECT a.product_id, count(*) AS pairs FROM seen a JOIN seen b ON b.product_id = a.product_id AND b.m > a.m GROUP BY a.product_id"""


@plan("c05_semi_joins")
def _(d):
    return f"""WITH {OFFER} SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM offer WHERE product_id = p_partkey AND in_stock) AND p_partkey IN (SELECT product_id FROM offer WHERE live AND cents < 100000)"""


@plan("c06_anti_joins")
def _(d):
    return f"""WITH {OFFER} SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM offer WHERE merchant_id = s_suppkey AND size = 50 AND position = 7 AND live AND in_stock) AND NOT EXISTS (SELECT 1 FROM offer WHERE merchant_id = s_suppkey AND position = 7 AND size = 1 AND live AND brand = 'Brand#2')"""


@plan("c07_left_null_anti")
def _(d):
    return """SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus = 'P') o ON o_custkey = c_custkey WHERE o_custkey IS NULL"""


@plan("c08_disagreement_semi_join")
def _(d):
    return f"""WITH {OFFER}, sig AS (SELECT offer_id, product_id, CASE WHEN merchant_id % 7 = 0 THEN 'unknown' ELSE brand END AS brand, CASE merchant_id % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'H' ELSE 'U' END AS sex, size % 2 = 0 AS pack, CASE WHEN feed_id % 5 = 0 THEN NULL ELSE 2018 + merchant_id % 2 END AS year FROM offer)
SELECT a.offer_id FROM sig a WHERE EXISTS (SELECT 1 FROM sig b WHERE b.product_id = a.product_id AND b.offer_id <> a.offer_id AND (
  (a.brand <> 'unknown' AND b.brand <> 'unknown' AND a.brand <> b.brand) OR (a.sex <> 'U' AND b.sex <> 'U' AND a.sex <> b.sex) OR a.pack <> b.pack OR (a.year IS NOT NULL AND b.year IS NOT NULL AND a.year <> b.year)))"""


@plan("c09_price_guard_anti_join")
def _(d):
    return f"""WITH {OFFER}, range_of AS (SELECT product_id, min(wide) AS low, max(wide) AS high FROM offer WHERE live GROUP BY product_id)
SELECT offer_id FROM offer o WHERE NOT live AND NOT EXISTS (SELECT 1 FROM range_of r WHERE r.product_id = o.product_id AND (r.high >= 5 * o.wide OR o.wide >= 5 * r.low))"""


@plan("c10_prefix_join")
def _(d):
    return f"""WITH ref AS (SELECT p_partkey AS id, p_brand AS brand, upper({d.gsub("concat(p_name, p_type)", "[^A-Za-z0-9]", "")}) AS k FROM part)
SELECT a.id, count(*) AS n FROM ref a JOIN ref b ON substring(b.k, 1, 8) = substring(a.k, 1, 8) AND b.brand = a.brand AND b.id <> a.id AND (b.k LIKE concat(a.k, '%') OR a.k LIKE concat(b.k, '%')) WHERE {d.chars("a.k")} >= 8 GROUP BY a.id"""


@plan("c11_array_containment_join")
def _(d):
    t = d.split("p_name", " ")
    return f"""WITH w AS (SELECT p_brand AS brand, p_size AS size, p_partkey AS id, {t} AS words FROM part)
SELECT a.id, count(*) AS n FROM w a JOIN w b ON b.brand = a.brand AND b.size = a.size AND b.id <> a.id AND {d.within("a.words", "b.words")} GROUP BY a.id"""


@plan("c12_jaccard_threshold")
def _(d):
    t = d.split("lower(concat(p_name, ' ', p_type))", " ")
    inter, union = d.size(d.intersect("a.words", "b.words")), d.size(d.union("a.words", "b.words"))
    return f"""WITH w AS (SELECT p_brand AS brand, p_size AS size, p_partkey AS id, {t} AS words FROM part)
SELECT a.id, b.id AS other, {inter} AS shared FROM w a JOIN w b ON b.brand = a.brand AND b.size = a.size AND b.id > a.id WHERE {inter} / CAST({union} AS DOUBLE) >= 0.40"""


@plan("c13_min_per_merchant_then_product")
def _(d):
    return f"""WITH {OFFER}, per AS (SELECT product_id, merchant_id, min(cents) AS cents FROM offer WHERE coalesce(in_stock, TRUE) GROUP BY product_id, merchant_id)
SELECT product_id, min(cents) AS low, max(cents) AS high, count(*) AS merchants FROM per GROUP BY product_id"""


@plan("c14_top_one_each")
def _(d):
    return f"""WITH {OFFER}, r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY seen DESC, offer_id) AS n FROM offer WHERE in_stock)
SELECT product_id, offer_id, cents, seen FROM r WHERE n = 1"""


@plan("c15_leave_one_out_median")
def _(d):
    return f"""WITH {OFFER}, o AS (SELECT offer_id, product_id, cents FROM offer WHERE live)
SELECT a.offer_id, a.cents, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY b.cents) AS DOUBLE) AS others FROM o a JOIN o b ON b.product_id = a.product_id AND b.offer_id <> a.offer_id GROUP BY a.offer_id, a.cents"""


@plan("c16_lateral_unnest")
def _(d):
    return f"""SELECT word, count(*) AS n FROM (SELECT {d.unnest(d.split("p_name", " "))} AS word FROM part) w GROUP BY word"""


@plan("c17_single_row_bounds")
def _(d):
    return f"""WITH {OFFER}, bounds AS (SELECT min(seen) AS first_day, max(seen) AS last_day FROM offer)
SELECT product_id, count(*) AS on_first FROM offer CROSS JOIN bounds WHERE seen <= first_day + INTERVAL 30 DAY GROUP BY product_id"""


@plan("c18_category_root")
def _(d):
    return """WITH tree AS (SELECT r_regionkey AS id, CAST(NULL AS INT) AS parent_id, r_name AS name FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name FROM nation)
SELECT c.id, c.name, root.name AS root FROM tree c JOIN tree root ON root.id = coalesce(c.parent_id, c.id)"""


@plan("c19_two_date_self_join")
def _(d):
    return f"""WITH {OFFER}, h AS (SELECT merchant_id, seen, min(cents) AS cents FROM offer GROUP BY merchant_id, seen),
days AS (SELECT merchant_id, max(seen) AS last_day FROM h GROUP BY merchant_id),
prev AS (SELECT h.merchant_id, max(h.seen) AS prev_day FROM h JOIN days ON days.merchant_id = h.merchant_id WHERE h.seen < last_day GROUP BY h.merchant_id)
SELECT a.merchant_id, a.cents AS now, b.cents AS before, a.cents <> b.cents AS changed FROM h a JOIN days ON days.merchant_id = a.merchant_id AND a.seen = last_day JOIN prev ON prev.merchant_id = a.merchant_id JOIN h b ON b.merchant_id = a.merchant_id AND b.seen = prev_day"""


@plan("c20_using")
def _(d):
    return f"""WITH {OFFER}, lo AS (SELECT product_id, min(cents) AS low FROM offer GROUP BY product_id), hi AS (SELECT product_id, max(cents) AS high FROM offer GROUP BY product_id)
SELECT product_id, high - low AS gap FROM lo JOIN hi USING (product_id)"""


@plan("c21_update_and_delete_from")
def _(d):
    return f"""WITH {OFFER}, gone AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0), floor_of AS (SELECT product_id, min(cents) AS low FROM offer GROUP BY product_id)
SELECT o.offer_id, CASE WHEN o.in_stock IS FALSE THEN f.low ELSE o.cents END AS cents FROM offer o JOIN floor_of f ON f.product_id = o.product_id WHERE NOT EXISTS (SELECT 1 FROM gone WHERE s_suppkey = o.merchant_id)"""


@plan("c22_regex_join_longest")
def _(d):
    cond = "p_name RLIKE pattern" if d.spark else "regexp_matches(p_name, pattern)"
    return f"""WITH motif(pattern, label) AS (VALUES ('ring', 'r'), ('red ring', 'rr'), ('^small', 's'), ('bolt$', 'b')),
m AS (SELECT p_partkey, label, row_number() OVER (PARTITION BY p_partkey ORDER BY length(pattern) DESC, label) AS n FROM part JOIN motif ON {cond})
SELECT p_partkey, label FROM m WHERE n = 1"""


@plan("c24_contiguous_tokens")
def _(d):
    return f"""WITH model(model) AS (VALUES ('widget'), ('red widget'), ('small ring'), ('ring')),
m AS (SELECT p_partkey, model, row_number() OVER (PARTITION BY p_partkey ORDER BY length(model) DESC) AS n, count(*) OVER (PARTITION BY p_partkey, length(model)) AS ties
  FROM part JOIN model ON contains(concat(' ', p_name, ' '), concat(' ', model, ' ')))
SELECT p_partkey, model FROM m WHERE n = 1 AND ties = 1"""


@plan("c25_pairs_sharing_nothing")
def _(d):
    return f"""WITH pair AS (SELECT o_custkey AS a, o_orderkey % 1500 AS b FROM orders), used AS (SELECT a AS id FROM pair UNION ALL SELECT b FROM pair), once AS (SELECT id FROM used GROUP BY id HAVING count(*) <= 16)
SELECT a, b FROM pair WHERE EXISTS (SELECT 1 FROM once WHERE id = a) AND EXISTS (SELECT 1 FROM once WHERE id = b)"""


@plan("c26_merge_on_index")
def _(d):
    return """WITH n AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey) SELECT c_custkey, c_mktsegment, orders FROM customer JOIN n ON o_custkey = c_custkey"""


# Aggregates --------------------------------------------------------------------------------------------------------


@plan("d01_basic_group_by")
def _(d):
    return f"""WITH {OFFER} SELECT brand, count(*) AS n, min(cents) AS low, max(cents) AS high, CAST(sum(cents) AS BIGINT) AS total FROM offer GROUP BY brand"""


@plan("d02_count_distinct")
def _(d):
    return f"""WITH {OFFER} SELECT brand, count(DISTINCT merchant_id) AS merchants, count(DISTINCT product_id) AS products FROM offer GROUP BY brand"""


@plan("d03_filtered_aggregates")
def _(d):
    return f"""WITH {OFFER} SELECT merchant_id, count(*) FILTER (WHERE live) AS live, count(DISTINCT brand) FILTER (WHERE in_stock) AS brands, min(cents) FILTER (WHERE in_stock IS NOT FALSE) AS low FROM offer GROUP BY merchant_id"""


@plan("d04_having_ratio")
def _(d):
    return f"""WITH {OFFER} SELECT product_id, min(wide) AS low, max(wide) AS high FROM offer WHERE wide > 0 GROUP BY product_id HAVING count(DISTINCT merchant_id) >= 2 AND max(wide) >= 5 * min(wide) AND count(*) < 40"""


@plan("d05_first_by_order")
def _(d):
    return f"""WITH {OFFER} SELECT product_id, min_by(merchant_id, concat(lpad({d.string("cents")}, 12, '0'), offer_id)) AS cheapest, max_by(merchant_id, concat(lpad({d.string("cents")}, 12, '0'), offer_id)) FILTER (WHERE live) AS dearest_live FROM offer GROUP BY product_id"""


@plan("d06_distinct_ordered_set")
def _(d):
    return f"""WITH {OFFER} SELECT product_id, {d.join_set("merchant_id")} AS merchants FROM offer GROUP BY product_id"""


@plan("d07_distinct_string_agg")
def _(d):
    return f"""SELECT p_brand, {d.join_set("p_type", " / ")} AS types FROM part GROUP BY p_brand"""


@plan("d08_json_of_group")
def _(d):
    item = f"""concat('{{"title":"', title, '","n":', {d.string("n")}, '}}')"""
    return f"""WITH {OFFER}, g AS (SELECT brand, title, count(*) AS n FROM offer GROUP BY brand, title)
SELECT brand, concat('[', {d.join_set(item)}, ']') AS signals FROM g GROUP BY brand"""


@plan("d09_bool_aggregates")
def _(d):
    return f"""WITH {OFFER} SELECT product_id, bool_and(live) AS all_live, bool_or(in_stock) AS any_stock FROM offer GROUP BY product_id"""


@plan("d10_exact_median")
def _(d):
    return f"""WITH {OFFER} SELECT brand, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY cents) AS DOUBLE) AS median, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY wide) FILTER (WHERE live) AS DOUBLE) AS live_median FROM offer GROUP BY brand"""


@plan("d12_mode_larger_wins_ties")
def _(d):
    return f"""WITH {OFFER}, c AS (SELECT merchant_id, size, count(*) AS n FROM offer GROUP BY merchant_id, size), r AS (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY n DESC, size DESC) AS k FROM c)
SELECT merchant_id, size AS mode, n FROM r WHERE k = 1"""


@plan("d13_two_latest_dates")
def _(d):
    return f"""WITH {OFFER}, l AS (SELECT merchant_id, max(seen) AS last_day FROM offer GROUP BY merchant_id)
SELECT o.merchant_id, l.last_day, max(CASE WHEN o.seen < l.last_day THEN o.seen END) AS before FROM offer o JOIN l ON l.merchant_id = o.merchant_id GROUP BY o.merchant_id, l.last_day"""


@plan("d14_unanimity")
def _(d):
    return f"""WITH {OFFER} SELECT sku, min(brand) AS brand, count(*) AS n FROM offer GROUP BY sku HAVING count(DISTINCT brand) = 1 AND count(*) > 1"""


@plan("d15_price_histogram")
def _(d):
    return f"""WITH {OFFER}, top AS (SELECT ceil(percentile_cont(0.95) WITHIN GROUP (ORDER BY cents) / 1000.0) * 1000 AS ceiling FROM offer),
b AS (SELECT {d.bucket("cents", "0", "CAST(ceiling AS BIGINT)", "12")} AS bucket, count(*) AS n FROM offer CROSS JOIN top GROUP BY 1)
SELECT bucket, n, CAST(sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulated FROM b"""


@plan("d16_conditional_pivot")
def _(d):
    return """SELECT user_id, max(value) FILTER (WHERE event_type = 'view') AS views, max(value) FILTER (WHERE event_type = 'click') AS clicks, max(value) FILTER (WHERE event_type = 'purchase') AS purchases FROM events GROUP BY user_id"""


@plan("d17_group_by_expression")
def _(d):
    return """SELECT p_size % 10 AS tens, upper(substring(p_name, 1, 3)) AS head, count(*) AS n FROM part GROUP BY 1, 2"""


@plan("d18_group_by_key_dependents")
def _(d):
    return f"""WITH {OFFER} SELECT s_suppkey, s_name, s_nationkey, count(*) AS offers FROM supplier JOIN offer ON merchant_id = s_suppkey GROUP BY s_suppkey, s_name, s_nationkey"""


@plan("d19_scalar_aggregates_side_by_side")
def _(d):
    return """SELECT (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM supplier) AS suppliers, (SELECT count(DISTINCT o_custkey) FROM orders) AS buyers"""


@plan("d20_residual_count")
def _(d):
    return f"""WITH {OFFER}, own AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 4 END AS value FROM part), covered AS (SELECT coalesce({d.string("value")}, 'none') AS value, count(*) AS n FROM own WHERE p_brand <> 'Brand#7' GROUP BY 1)
SELECT value, n FROM covered UNION ALL SELECT 'uncovered', count(*) - (SELECT CAST(sum(n) AS BIGINT) FROM covered) FROM own"""


@plan("d21_coverage_by_category")
def _(d):
    return f"""WITH {OFFER}, has AS (SELECT product_id, bool_or(in_stock) AS stocked, count(DISTINCT merchant_id) >= 20 AS wide FROM offer GROUP BY product_id)
SELECT p_type, count(*) AS products, count(*) FILTER (WHERE stocked) AS stocked, count(*) FILTER (WHERE wide) AS wide FROM part LEFT JOIN has ON product_id = p_partkey GROUP BY p_type"""


@plan("d22_spread_exploration")
def _(d):
    return f"""WITH {OFFER} SELECT product_id, count(*) AS offers, min(wide) AS low, max(wide) AS high, max(wide) / CAST(min(wide) AS DOUBLE) AS ratio FROM offer WHERE wide > 0 GROUP BY product_id HAVING max(wide) / CAST(min(wide) AS DOUBLE) >= 3"""


@plan("d23_reason_counter")
def _(d):
    return f"""WITH {OFFER} SELECT CASE WHEN size > 40 THEN 'size' WHEN live THEN 'live' ELSE 'other' END AS reason, count(*) AS n FROM offer GROUP BY 1"""


@plan("d24_weighted_mean_of_present")
def _(d):
    return f"""WITH v AS (SELECT user_id, event_type AS part, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 1 END AS weight, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(max(value)) AS BIGINT) END AS grade FROM events GROUP BY user_id, event_type)
SELECT user_id, CAST(sum(weight * grade) AS DOUBLE) / sum(weight) FILTER (WHERE grade IS NOT NULL) AS score, count(grade) AS parts FROM v GROUP BY user_id HAVING count(grade) >= 2 AND bool_or(part = 'purchase' AND grade IS NOT NULL)"""


@plan("d25_tree_roll_up")
def _(d):
    return f"""WITH {OFFER}, leaf AS (SELECT s_nationkey, count(*) AS n, min(cents) FILTER (WHERE category <> 'PROMO') AS low FROM offer JOIN supplier ON s_suppkey = merchant_id GROUP BY s_nationkey)
SELECT 'leaf' AS level, n_name AS name, n, low FROM leaf JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT 'root', r_name, CAST(sum(n) AS BIGINT), min(low) FROM leaf JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name"""


# Windows -----------------------------------------------------------------------------------------------------------


@plan("e01_top_n_per_family")
def _(d):
    return f"""WITH {OFFER}, r AS (SELECT category, offer_id, cents, row_number() OVER (PARTITION BY category ORDER BY cents, offer_id) AS n FROM offer WHERE live) SELECT category, offer_id, cents, CAST(n AS BIGINT) AS n FROM r WHERE n <= 5"""


@plan("e02_round_robin")
def _(d):
    return f"""WITH {OFFER}, r AS (SELECT brand, offer_id, cents, row_number() OVER (PARTITION BY brand ORDER BY cents DESC, offer_id) AS k FROM offer WHERE live), s AS (SELECT *, row_number() OVER (ORDER BY k, cents DESC, offer_id) AS place FROM r WHERE k <= 3)
SELECT CAST(place AS BIGINT) AS place, brand, offer_id FROM s WHERE place <= 40"""


@plan("e03_day_seeded_bands")
def _(d):
    return f"""WITH {OFFER}, {AS_OF}, p AS (SELECT product_id, brand, {d.bucket("min(cents)", "85000", "105000", "4")} AS band FROM offer GROUP BY product_id, brand),
a AS (SELECT p.*, md5(concat({d.string("product_id")}, {d.string("day")})) AS h FROM p, today), b AS (SELECT *, row_number() OVER (PARTITION BY band, brand ORDER BY h) AS n FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY h) AS m FROM b WHERE n = 1)
SELECT band, CAST(m AS BIGINT) AS m, product_id, brand FROM c WHERE m <= 6"""


@plan("e04_gap_ratio")
def _(d):
    return f"""WITH {OFFER}, p AS (SELECT brand, product_id, max(wide) AS wide FROM offer WHERE live GROUP BY brand, product_id),
g AS (SELECT brand, wide / CAST(lag(wide) OVER (PARTITION BY brand ORDER BY wide, product_id) AS DOUBLE) AS ratio FROM p) SELECT brand, max(ratio) AS widest FROM g GROUP BY brand HAVING max(ratio) >= 1.05"""


@plan("e05_filtered_window_count")
def _(d):
    return f"""WITH {OFFER} SELECT offer_id, CAST(sum(CASE WHEN in_stock THEN 1 ELSE 0 END) OVER (PARTITION BY product_id) AS BIGINT) AS stocked FROM offer"""


@plan("e06_four_key_rank")
def _(d):
    return f"""WITH {OFFER}, u AS (SELECT brand, merchant_id, size, count(*) AS n, min(cents) AS low FROM offer GROUP BY brand, merchant_id, size), r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, low, merchant_id, size) AS k FROM u)
SELECT brand, merchant_id, size, n FROM r WHERE k = 1"""


@plan("e07_distinct_on")
def _(d):
    return f"""WITH {OFFER}, r AS (SELECT sku, offer_id, seen, cents, row_number() OVER (PARTITION BY sku ORDER BY seen DESC, cents, offer_id) AS k FROM offer) SELECT sku, offer_id, seen, cents FROM r WHERE k = 1"""


@plan("e08_running_sum")
def _(d):
    return f"""WITH {OFFER}, s AS (SELECT size, count(*) AS n FROM offer GROUP BY size) SELECT size, CAST(sum(n) OVER (ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM s"""


@plan("e09_exactly_one_candidate")
def _(d):
    return f"""WITH {OFFER}, c AS (SELECT sku, product_id, count(*) OVER (PARTITION BY sku) AS n FROM offer) SELECT sku, product_id FROM c WHERE n = 1"""


# Sorts and limits --------------------------------------------------------------------------------------------------


@plan("f01_page_of_listing")
def _(d):
    return f"""WITH {OFFER} SELECT offer_id, cents FROM offer WHERE live ORDER BY cents, offer_id LIMIT 40 OFFSET 80"""


@plan("f02_newest_nulls_last")
def _(d):
    return f"""WITH {OFFER} SELECT product_id, newest FROM (SELECT product_id, max(seen) FILTER (WHERE in_stock AND live AND position = 1) AS newest FROM offer GROUP BY product_id) x ORDER BY newest DESC NULLS LAST, product_id LIMIT 50"""


@plan("f03_discount_order")
def _(d):
    return f"""WITH {OFFER}, p AS (SELECT product_id, min(cents) AS low, max(cents) AS high, max(cents) FILTER (WHERE live) AS list FROM offer GROUP BY product_id)
SELECT product_id, CASE WHEN list >= 1.03 * low THEN 1 - low / CAST(list AS DOUBLE) ELSE 1 - low / CAST(high AS DOUBLE) END AS discount FROM p ORDER BY discount DESC, product_id LIMIT 60"""


@plan("f04_similar_order")
def _(d):
    return f"""WITH {OFFER}, p AS (SELECT product_id, brand, min(cents) AS low, count(*) AS n FROM offer GROUP BY product_id, brand), me AS (SELECT brand AS b, low AS l FROM p WHERE product_id = 11)
SELECT product_id, brand FROM p CROSS JOIN me WHERE product_id <> 11 ORDER BY brand IS DISTINCT FROM b, abs(low - l) / CAST(l AS DOUBLE), n DESC, product_id LIMIT 12"""


@plan("f05_top_k")
def _(d):
    return f"""WITH {OFFER} SELECT brand, count(*) AS n FROM offer WHERE in_stock GROUP BY brand ORDER BY n DESC, brand LIMIT 10"""


@plan("f06_request_order")
def _(d):
    asked = "SELECT pos, id FROM (SELECT posexplode(array(30, 7, 99, 12)) AS (pos, id)) x" if d.spark else "SELECT * FROM (VALUES (0, 30), (1, 7), (2, 99), (3, 12)) x(pos, id)"
    return f"""WITH asked AS ({asked}) SELECT pos, p_partkey, p_name FROM asked JOIN part ON p_partkey = id ORDER BY pos"""


@plan("f07_size_order")
def _(d):
    return f"""WITH s AS (SELECT DISTINCT CASE WHEN p_size <= 5 THEN {d.item(d.array("'XS'", "'S'", "'M'", "'L'", "'XL'"), "p_size")} ELSE {d.string("p_size")} END AS label FROM part)
SELECT label, CAST(row_number() OVER (ORDER BY CASE WHEN {d.matches("label", "^[A-Z]+$")} THEN 0 ELSE 1 END, CASE label WHEN 'XS' THEN 1 WHEN 'S' THEN 2 WHEN 'M' THEN 3 WHEN 'L' THEN 4 WHEN 'XL' THEN 5 END, {d.try_double("label")}) AS BIGINT) AS place FROM s"""


@plan("f08_brand_cap_at_head")
def _(d):
    return f"""WITH {OFFER}, r AS (SELECT offer_id, brand, cents, row_number() OVER (PARTITION BY brand ORDER BY cents, offer_id) AS k FROM offer WHERE live)
SELECT offer_id, brand, k > 2 AS pushed_down FROM r ORDER BY CASE WHEN k > 2 THEN 1 ELSE 0 END, cents, offer_id LIMIT 200"""


@plan("f09_department_interleave")
def _(d):
    return f"""WITH {OFFER}, p AS (SELECT product_id, brand, category, max(seen) AS seen FROM offer GROUP BY product_id, brand, category), b AS (SELECT *, row_number() OVER (PARTITION BY category, brand ORDER BY seen DESC, product_id) AS kb FROM p),
c AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY seen DESC, product_id) AS kc FROM b WHERE kb <= 2) SELECT product_id, category, CAST(row_number() OVER (ORDER BY kc, category) AS BIGINT) AS place FROM c WHERE kc <= 8"""


# Sets --------------------------------------------------------------------------------------------------------------


@plan("g01_union_of_detectors")
def _(d):
    return f"""WITH {OFFER} SELECT sku FROM offer GROUP BY sku HAVING count(DISTINCT brand) > 1 UNION SELECT sku FROM offer GROUP BY sku HAVING max(wide) >= 5 * min(wide) UNION SELECT sku FROM offer GROUP BY sku HAVING count(DISTINCT category) > 1"""


@plan("g02_union_all")
def _(d):
    return f"""WITH {OFFER}, u AS (SELECT merchant_id, cents FROM offer WHERE live UNION ALL SELECT merchant_id, wide FROM offer WHERE NOT live) SELECT merchant_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM u GROUP BY merchant_id"""


@plan("g03_intersect_words")
def _(d):
    return """SELECT p_partkey FROM part WHERE contains(p_name, 'red') INTERSECT SELECT p_partkey FROM part WHERE contains(p_name, 'widget') INTERSECT SELECT p_partkey FROM part WHERE p_size > 5"""


@plan("g04_array_sets")
def _(d):
    a, b = d.split("p_name", " "), d.array("'red'", "'ring'", "'blue'")
    return f"""SELECT p_partkey, {d.size(d.intersect(a, b))} AS shared, {d.size(d.union(a, b))} AS whole, {d.overlap(a, b)} AS meets, {d.within(b, a)} AS inside FROM part"""


@plan("g05_symmetric_difference")
def _(d):
    a, b = d.split("a.p_name", " "), d.split("b.p_name", " ")
    return f"""SELECT a.p_partkey, {d.join(d.sorted(d.union(d.minus(a, b), d.minus(b, a))), " ")} AS differing FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"""


@plan("c23_dictionary_join")
def _(d):
    """Keys of a merchant to products, as one looks a read text's product up."""
    return f"""WITH {OFFER}, known AS (SELECT merchant_id, sku, min(product_id) AS product FROM offer WHERE live GROUP BY merchant_id, sku) SELECT o.offer_id, k.product FROM offer o JOIN known k ON k.merchant_id = o.merchant_id AND k.sku = o.sku WHERE o.position <= 3"""


@plan("d11_medians_of_groups")
def _(d):
    return f"""WITH {OFFER}, p AS (SELECT product_id, category, count(*) AS n, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY cents) AS DOUBLE) AS price FROM offer GROUP BY product_id, category) SELECT category, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY n) AS DOUBLE) AS median_offers, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY price) AS DOUBLE) AS median_price FROM p GROUP BY category"""
