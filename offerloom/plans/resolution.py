"""From offers to products: units, gates, folds, splits, links, audits and their undoing (survey Q1 to Q30, Q58, Q59)."""

from offerloom.functions import text as t
from offerloom.plans.dialect import AS_OF, OFFER, plan

#: Signatures of offers: a product stands for a barcode, and the offer's feed decides what is unknown or contradicts.
SIG = f"""{OFFER}, sig AS (SELECT offer_id, sku, product_id AS gtin, merchant_id, cents, wide, live, in_stock, seen, size, title, feed_id, position,
  CASE WHEN merchant_id % 7 = 0 THEN 'unknown' ELSE brand END AS brand,
  CASE category WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LARGE' THEN 6 WHEN 'ECONOMY' THEN 25 ELSE 7 END AS category,
  CASE WHEN feed_id % 3 = 0 THEN 'U' WHEN product_id % 2 = 0 THEN 'F' ELSE 'H' END AS sex,
  CASE WHEN product_id % 11 = 0 AND feed_id % 50 = 0 THEN 'E' ELSE 'A' END AS age,
  product_id % 13 = 0 AND feed_id % 40 = 0 AS pack,
  CASE WHEN feed_id % 4 = 0 THEN 2019 + product_id % 3 END AS year,
  CASE WHEN feed_id % 5 = 0 THEN '' WHEN feed_id % 5 = 1 THEN 'BK' WHEN product_id % 9 = 0 AND feed_id % 30 = 2 THEN 'WH' ELSE 'BK-RD' END AS colour
  FROM offer)"""


def unit(d) -> str:
    """Barcode units: gates, conflict, and the representative's values.

    Whether known values differ is asked as least <> greatest: several distinct counts in one aggregate would multiply
    the rows before the shuffle, one copy for each."""
    fits = t.colours_compatible("a.colour", "b.colour", d)
    return f"""{SIG},
gates AS (SELECT gtin, coalesce(min(sex) FILTER (WHERE sex <> 'U') <> max(sex) FILTER (WHERE sex <> 'U'), FALSE) OR min(age) <> max(age) OR (bool_or(pack) AND NOT bool_and(pack)) OR coalesce(min(year) <> max(year), FALSE)
    OR coalesce(min(brand) FILTER (WHERE brand <> 'unknown') <> max(brand) FILTER (WHERE brand <> 'unknown'), FALSE) AS mixed,
  min(brand) FILTER (WHERE brand <> 'unknown') AS brand, max(year) AS year, min(sex) FILTER (WHERE sex <> 'U') AS sex, min(age) AS age, bool_or(pack) AS pack, min(CASE WHEN category = 25 THEN 1000 WHEN category BETWEEN 2 AND 5 THEN category ELSE 100 + category END) AS cat,
  max_by(colour, concat(lpad({d.string("length(colour)")}, 3, '0'), colour)) FILTER (WHERE colour <> '') AS colour, min_by(title, concat(lpad({d.string("99 - length(title)")}, 2, '0'), offer_id)) AS title,
  coalesce(min(merchant_id) FILTER (WHERE live AND cents > 0) <> max(merchant_id) FILTER (WHERE live AND cents > 0), FALSE) AS several, max(cents) FILTER (WHERE live AND cents > 0) AS high, min(cents) FILTER (WHERE live AND cents > 0) AS low, count(*) AS n FROM sig GROUP BY gtin),
seen_colours AS (SELECT DISTINCT gtin, colour FROM sig WHERE colour <> ''),
clash AS (SELECT DISTINCT a.gtin FROM seen_colours a JOIN seen_colours b ON b.gtin = a.gtin AND b.colour > a.colour WHERE NOT {fits}),
two AS (SELECT DISTINCT gtin FROM (SELECT gtin, merchant_id FROM sig WHERE colour <> '' GROUP BY gtin, merchant_id HAVING count(DISTINCT colour) > 1) x),
unit AS (SELECT g.gtin, g.n, coalesce(g.brand, 'unknown') AS brand, CASE WHEN g.cat >= 1000 THEN 25 WHEN g.cat >= 100 THEN g.cat - 100 ELSE g.cat END AS category, coalesce(g.colour, '') AS colour, g.year, concat(coalesce(g.sex, 'U'), '-', g.age) AS genre, g.pack, g.title,
  g.mixed OR (g.several AND g.high >= 5 * g.low) OR c.gtin IS NOT NULL OR w.gtin IS NOT NULL AS conflict
  FROM gates g LEFT JOIN clash c ON c.gtin = g.gtin LEFT JOIN two w ON w.gtin = g.gtin)"""


#: Units whose wording decides their product, for the folds and splits.
def model_unit(d) -> str:
    return f"""mu AS (SELECT p_partkey AS gtin, p_brand AS brand, p_size % 4 AS key_size, {d.sorted(d.distinct(d.split("p_name", " ")))} AS toks, CASE WHEN p_partkey % 3 = 0 THEN 'U' WHEN p_size % 2 = 0 THEN 'F' ELSE 'H' END AS sex, p_type AS kind FROM part)"""

#: Changes above which a pass holds its rows for the owner's look, in place of applying them.
REATTACH_MOST, DETACH_OFFERS, DETACH_PRODUCTS = 2000, 150, 40


@plan("q01_normalise_with_breaker")
def _(d):
    return f"""WITH {OFFER}, {AS_OF}, counts AS (SELECT merchant_id, count(*) AS n, count(*) FILTER (WHERE live) AS live, count(*) FILTER (WHERE live AND seen < day - INTERVAL 1500 DAY) AS gone FROM offer, today GROUP BY merchant_id),
r AS (SELECT sku, offer_id, merchant_id, cents, row_number() OVER (PARTITION BY merchant_id, sku ORDER BY seen DESC, offer_id) AS k FROM offer WHERE title IS NOT NULL)
SELECT r.offer_id, r.cents, c.live >= 500 AND 5 * c.gone > c.live AS held FROM r JOIN counts c ON c.merchant_id = r.merchant_id WHERE k = 1"""


@plan("q02_signature")
def _(d):
    title, norm = "concat(p_name, ' ', CASE p_partkey % 2 WHEN 0 THEN 'Homme' ELSE 'noir' END, ' ', p_size)", t.Normal("norm")
    return f"""WITH n AS (SELECT p_partkey, p_brand, p_type, {title} AS title, {t.norm_text(title, d)} AS norm FROM part)
SELECT p_partkey, {t.brand_code('p_brand', {'brand1': 'one'}, d)} AS brand, {t.colour_code(norm, d)} AS colour, {t.genre_age(norm, 'p_type', 'NULL', d)} AS genre, {t.is_pack(norm, d)} AS pack, {t.model_year("title", d)} AS year, norm FROM n"""


@plan("q03_barcode_units")
def _(d):
    return f"WITH {unit(d)} SELECT gtin, n, brand, category, colour, year, genre, pack, conflict, {t.identity_hash('brand', 'category', 'colour', 'year', 'genre', 'pack', chr(39) * 2, d.sorted(d.distinct(d.split('title', ' '))), d)} AS identity FROM unit"


@plan("q04_disagreement_rejection")
def _(d):
    return f"""WITH {unit(d)} SELECT s.offer_id FROM sig s JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) fresh ON fresh.s_suppkey = s.merchant_id WHERE EXISTS (SELECT 1 FROM unit u WHERE u.gtin = s.gtin AND (
  (s.brand <> 'unknown' AND u.brand <> 'unknown' AND s.brand <> u.brand) OR NOT {t.category_tolerant("s.category", "u.category")} OR s.age <> substring(u.genre, 3, 1) OR s.pack <> u.pack OR (s.year IS NOT NULL AND u.year IS NOT NULL AND s.year <> u.year) OR NOT {t.colours_compatible("s.colour", "u.colour", d)}))"""


@plan("q05_fold_unknown_sex")
def _(d):
    key = f"concat(brand, '|', key_size, '|', {d.join('toks', '-')})"
    return f"""WITH {model_unit(d)}, k AS (SELECT gtin, sex, {key} AS k FROM mu), one AS (SELECT k, min(sex) AS sex, min(gtin) AS winner FROM k WHERE sex <> 'U' GROUP BY k HAVING count(DISTINCT sex) = 1)
SELECT k.gtin, CASE WHEN k.sex = 'U' THEN coalesce(one.sex, 'U') ELSE k.sex END AS sex, CASE WHEN k.sex = 'U' AND one.k IS NOT NULL THEN md5(concat(k.k, one.sex)) ELSE md5(concat(k.k, k.sex)) END AS identity FROM k LEFT JOIN one ON one.k = k.k"""


@plan("q06_fold_short_model")
def _(d):
    return f"""WITH mu AS (SELECT p_partkey AS gtin, p_brand AS brand, {d.sorted(d.distinct(d.split("CASE WHEN p_partkey % 2 = 0 THEN concat(p_name, ' ', lower(p_type)) ELSE p_name END", " ")))} AS toks FROM part),
r AS (SELECT brand, gtin, toks, row_number() OVER (PARTITION BY brand ORDER BY {d.size("toks")} DESC, gtin) AS k FROM mu WHERE {d.size("toks")} >= 2), top AS (SELECT brand, toks AS best, gtin AS winner FROM r WHERE k = 1),
c AS (SELECT mu.gtin, mu.brand, md5(concat(mu.brand, {d.join("mu.toks", "-")})) AS identity, top.winner, {d.within("mu.toks", "top.best")} AND {d.size("mu.toks")} < {d.size("top.best")} AS moves FROM mu JOIN top ON top.brand = mu.brand WHERE {d.size("mu.toks")} >= 2),
whole AS (SELECT identity FROM c GROUP BY identity HAVING bool_and(moves))
SELECT c.gtin, CASE WHEN w.identity IS NOT NULL THEN c.winner END AS folded_into FROM c LEFT JOIN whole w ON w.identity = c.identity"""


@plan("q07_split_codes_per_size")
def _(d):
    return f"""WITH u AS (SELECT p_partkey AS gtin, p_size AS size, md5(concat(p_brand, p_name)) AS h FROM part WHERE p_type NOT IN ('SMALL')), s AS (SELECT h FROM u GROUP BY h HAVING count(DISTINCT gtin) / CAST(count(DISTINCT size) AS DOUBLE) >= 1.2)
SELECT u.gtin, CASE WHEN s.h IS NOT NULL THEN md5(concat(u.h, '|', {d.string("u.gtin")})) ELSE u.h END AS identity FROM u LEFT JOIN s ON s.h = u.h"""


@plan("q08_split_by_price_gap")
def _(d):
    return f"""WITH {OFFER}, u AS (SELECT product_id AS gtin, md5(concat(brand, title)) AS h, min(category) AS category, max(wide) AS wide FROM offer WHERE live GROUP BY product_id, brand, title),
g AS (SELECT h, category, wide / CAST(lag(wide) OVER (PARTITION BY h ORDER BY wide, gtin) AS DOUBLE) AS ratio FROM u), cut AS (SELECT h FROM g GROUP BY h HAVING max(CASE WHEN category IN ('SMALL', 'LARGE') THEN ratio / 5 ELSE ratio / 2 END) >= 1)
SELECT u.gtin, CASE WHEN cut.h IS NOT NULL THEN md5(concat(u.h, '|', {d.string("u.gtin")})) ELSE u.h END AS identity FROM u LEFT JOIN cut ON cut.h = u.h"""


@plan("q09_reattach_units")
def _(d):
    return f"""WITH {unit(d)}, holder AS (SELECT gtin, gtin % 400 AS product FROM unit WHERE NOT conflict AND gtin % 3 <> 0 UNION SELECT gtin, gtin % 90 FROM unit WHERE gtin % 50 = 1), load_of AS (SELECT product FROM holder GROUP BY product HAVING count(*) <= 25),
target AS (SELECT u.gtin, min(h.product) AS product FROM unit u JOIN holder h ON h.gtin = u.gtin JOIN load_of l ON l.product = h.product WHERE NOT u.conflict GROUP BY u.gtin HAVING count(DISTINCT h.product) = 1),
cap AS (SELECT count(*) AS n FROM target)
SELECT gtin, product, cap.n > {REATTACH_MOST} AS held FROM target, cap"""


@plan("q10_refusal_reasons")
def _(d):
    return f"""WITH {unit(d)} SELECT CASE WHEN conflict THEN 'conflict' WHEN brand = 'unknown' THEN 'no brand' WHEN category = 25 THEN 'no category' WHEN n > 40 THEN 'too many' ELSE 'accepted' END AS reason, count(*) AS units, CAST(sum(n) AS BIGINT) AS offers, bool_and(pack) AS all_packs FROM unit GROUP BY 1"""


@plan("q11_products_from_units")
def _(d):
    return f"""WITH {unit(d)}, i AS (SELECT *, md5(concat_ws('|', brand, {d.string("category")}, colour, genre, title)) AS identity FROM unit WHERE NOT conflict), r AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY n DESC, gtin) AS k FROM i)
SELECT identity, gtin, title, {t.slug("concat(brand, ' ', title)", "identity", d)} AS slug FROM r WHERE k = 1"""


@plan("q12_link_by_reference_prefix")
def _(d):
    ref = f"upper({d.gsub('concat(title, brand, size)', '[^A-Za-z0-9]', '')})"
    return f"""WITH {OFFER}, p AS (SELECT DISTINCT product_id, brand, size, {ref} AS k FROM offer), o AS (SELECT offer_id, merchant_id, brand, size, concat({ref}, CASE WHEN position = 2 THEN 'X' ELSE '' END) AS k FROM offer WHERE live),
c AS (SELECT o.offer_id, o.merchant_id, p.product_id, count(*) OVER (PARTITION BY o.offer_id) AS candidates FROM o JOIN p ON substring(p.k, 1, 8) = substring(o.k, 1, 8) AND p.brand = o.brand AND p.size = o.size AND (o.k LIKE concat(p.k, '%') OR p.k LIKE concat(o.k, '%')) WHERE length(o.k) >= 8),
r AS (SELECT *, row_number() OVER (PARTITION BY product_id, merchant_id ORDER BY offer_id) AS k FROM c WHERE candidates = 1)
SELECT offer_id, product_id, CAST(0.70 AS DOUBLE) AS confidence FROM r WHERE k = 1"""


@plan("q12_link_exact_identity")
def _(d):
    return f"""WITH {SIG}, p AS (SELECT md5(concat_ws('|', p_brand, p_name, {d.string("p_size")})) AS identity, min(p_partkey) AS product FROM part GROUP BY 1)
SELECT s.offer_id, p.product, CAST(0.80 AS DOUBLE) AS confidence FROM sig s JOIN p ON p.identity = md5(concat_ws('|', s.brand, s.title, {d.string("s.size")})) WHERE s.category <> 25 AND s.merchant_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)"""


@plan("q13_item_group_separation")
def _(d):
    return f"""WITH {OFFER}, u AS (SELECT merchant_id % 20 AS m, sku, md5(concat(brand, title, {d.string("size")})) AS h, category, count(*) AS n, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY wide) AS DOUBLE) AS price FROM offer WHERE live AND wide > 0 GROUP BY 1, sku, brand, title, size, category),
s AS (SELECT a.m, a.sku, a.h, a.category, a.n, a.price, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY b.price) AS DOUBLE) AS others FROM u a JOIN u b ON b.h = a.h AND (b.m <> a.m OR b.sku <> a.sku OR b.category <> a.category) GROUP BY a.m, a.sku, a.h, a.category, a.n, a.price),
f AS (SELECT *, price >= CASE WHEN category IN ('SMALL', 'LARGE') THEN 5 ELSE 3 END * others OR price <= others / CASE WHEN category IN ('SMALL', 'LARGE') THEN 5 ELSE 3 END AS far FROM s),
r AS (SELECT *, sum(CASE WHEN far THEN 0 ELSE 1 END) OVER (PARTITION BY h) AS near, row_number() OVER (PARTITION BY h ORDER BY n DESC, price, m, sku, category) AS k FROM f)
SELECT m, sku, category, h, price, others, far AND NOT (near = 0 AND k = 1) AS separated FROM r"""


@plan("q14_detach_far_offers")
def _(d):
    return f"""WITH {OFFER}, o AS (SELECT offer_id, product_id, category, wide FROM offer WHERE live), m AS (SELECT a.offer_id, a.product_id, a.category, a.wide, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY b.wide) AS DOUBLE) AS others FROM o a JOIN o b ON b.product_id = a.product_id AND b.offer_id <> a.offer_id GROUP BY a.offer_id, a.product_id, a.category, a.wide),
far AS (SELECT * FROM m WHERE wide >= 9 * others OR wide <= others / 9), cap AS (SELECT count(*) AS offers, count(DISTINCT product_id) AS products FROM far)
SELECT offer_id, product_id, cap.offers > {DETACH_OFFERS} OR cap.products > {DETACH_PRODUCTS} AS held FROM far, cap"""


@plan("q15_variants")
def _(d):
    return f"""WITH {OFFER}, v AS (SELECT product_id, size, count(*) FILTER (WHERE live) AS live, count(*) AS n FROM offer GROUP BY product_id, size), made AS (SELECT DISTINCT product_id, CASE WHEN product_id % 9 = 0 THEN size + 1 ELSE size END AS size FROM offer)
SELECT coalesce(v.product_id, made.product_id) AS product_id, coalesce(v.size, made.size) AS size, CASE WHEN v.product_id IS NULL OR v.live = 0 THEN 'prune' WHEN made.product_id IS NULL THEN 'create' ELSE 'keep' END AS action FROM v FULL JOIN made ON made.product_id = v.product_id AND made.size = v.size"""


@plan("q16_conflict_queue")
def _(d):
    item = f"""concat('{{"brand":"', s.brand, '","sex":"', s.sex, '"}}')"""
    return f"""WITH {unit(d)} SELECT s.gtin, count(*) AS offers, concat('[', {d.join_set(item)}, ']') AS signals, TRUE AS quarantined FROM sig s JOIN unit u ON u.gtin = s.gtin WHERE u.conflict GROUP BY s.gtin"""


@plan("q17_standing_invariants")
def _(d):
    fits = t.colours_compatible("a.colour", "b.colour", d)
    return f"""WITH {SIG}, g AS (SELECT gtin, live, CASE WHEN min(brand) FILTER (WHERE brand <> 'unknown') <> max(brand) FILTER (WHERE brand <> 'unknown') THEN 2 ELSE 1 END AS brands, CASE WHEN min(sex) FILTER (WHERE sex <> 'U') <> max(sex) FILTER (WHERE sex <> 'U') THEN 2 ELSE 1 END AS sexes, CASE WHEN min(age) FILTER (WHERE TRUE) <> max(age) FILTER (WHERE TRUE) THEN 2 ELSE 1 END AS ages, CASE WHEN bool_or(pack) AND NOT bool_and(pack) THEN 2 ELSE 1 END AS packs, CASE WHEN min(year) FILTER (WHERE TRUE) <> max(year) FILTER (WHERE TRUE) THEN 2 ELSE 1 END AS years, CASE WHEN min(category) FILTER (WHERE category <> 25) <> max(category) FILTER (WHERE category <> 25) THEN 2 ELSE 1 END AS cats FROM sig GROUP BY gtin, live),
c AS (SELECT DISTINCT gtin, live, colour FROM sig WHERE colour <> ''), k AS (SELECT DISTINCT a.gtin, a.live FROM c a JOIN c b ON b.gtin = a.gtin AND b.live = a.live AND b.colour > a.colour WHERE NOT {fits})
SELECT 'brand' AS rule, live, count(*) FILTER (WHERE brands > 1) AS broken FROM g GROUP BY live UNION ALL SELECT 'sex', live, count(*) FILTER (WHERE sexes > 1) FROM g GROUP BY live UNION ALL SELECT 'age', live, count(*) FILTER (WHERE ages > 1) FROM g GROUP BY live
UNION ALL SELECT 'pack', live, count(*) FILTER (WHERE packs > 1) FROM g GROUP BY live UNION ALL SELECT 'year', live, count(*) FILTER (WHERE years > 1) FROM g GROUP BY live UNION ALL SELECT 'category', live, count(*) FILTER (WHERE cats > 1) FROM g GROUP BY live UNION ALL SELECT 'colour', live, count(*) FROM k GROUP BY live"""


@plan("q18_freshness")
def _(d):
    return f"""WITH {OFFER}, {AS_OF}, history AS (SELECT offer_id, day AS observed_on, cents FROM offer, today WHERE live AND seen >= day - INTERVAL 300 DAY),
p AS (SELECT product_id, min(cents) FILTER (WHERE live AND seen >= day - INTERVAL 300 DAY AND coalesce(in_stock, TRUE)) AS min_cents, bool_or(live AND seen >= day - INTERVAL 300 DAY) AS fresh FROM offer, today GROUP BY product_id)
SELECT product_id, min_cents, CASE WHEN coalesce(fresh, FALSE) THEN 'active' ELSE 'stale' END AS status, (SELECT count(*) FROM history) AS appended FROM p"""


@plan("q19_product_stats")
def _(d):
    key = f"concat(lpad({d.string('cents')}, 12, '0'), offer_id)"
    return f"""WITH {OFFER} SELECT product_id, count(*) FILTER (WHERE live) AS offers, count(DISTINCT merchant_id) FILTER (WHERE live) AS merchants, min(cents) FILTER (WHERE live AND coalesce(in_stock, TRUE) AND shown) AS low, max(cents) FILTER (WHERE live AND shown) AS high,
  min_by(merchant_id, {key}) FILTER (WHERE live AND coalesce(in_stock, TRUE) AND shown) AS cheapest, max_by(merchant_id, {key}) FILTER (WHERE live AND shown) AS dearest, max(seen) AS last_seen
FROM offer JOIN (SELECT s_suppkey, s_acctbal > -500 AS shown FROM supplier) s ON s_suppkey = merchant_id GROUP BY product_id"""


@plan("q21_name_links")
def _(d):
    key = d.join(d.sorted(d.keep(d.distinct(d.split("concat(p_name, ' ', lower(p_type))", " ")), "w", "w NOT IN ('ring', 'small', 'large', 'promo', 'economy')")), "-")
    return f"""WITH k AS (SELECT p_partkey, p_brand, p_size % 5 AS s, {key} AS k FROM part), g AS (SELECT p_brand, s, k, min(p_partkey) AS survivor, count(*) AS n FROM k GROUP BY p_brand, s, k HAVING count(*) BETWEEN 2 AND 25)
SELECT k.p_partkey, g.survivor FROM k JOIN g ON g.p_brand = k.p_brand AND g.s = k.s AND g.k = k.k WHERE k.p_partkey <> g.survivor"""


@plan("q22_merge_and_undo")
def _(d):
    return f"""WITH {OFFER}, merge AS (SELECT p_partkey AS id, p_partkey - p_partkey % 10 AS survivor FROM part WHERE p_partkey % 10 IN (1, 2)), undone AS (SELECT id FROM merge WHERE id % 100 = 1),
live_merge AS (SELECT id, survivor FROM merge WHERE NOT EXISTS (SELECT 1 FROM undone WHERE undone.id = merge.id))
SELECT coalesce(m.survivor, o.product_id) AS product, count(*) AS offers, count(m.id) AS moved FROM offer o LEFT JOIN live_merge m ON m.id = o.product_id GROUP BY 1"""


@plan("q23_brand_alias_proposals")
def _(d):
    return f"""WITH {OFFER}, b AS (SELECT sku, min(brand) AS a, max(brand) AS b FROM offer GROUP BY sku HAVING count(DISTINCT brand) = 2), n AS (SELECT a, b, count(*) AS codes FROM b GROUP BY a, b HAVING count(*) >= 3)
SELECT a, b, codes FROM n ORDER BY codes DESC, a, b LIMIT 200"""


@plan("q24_short_long_pairs")
def _(d):
    a, b = "a.toks", "b.toks"
    return f"""WITH {OFFER}, m AS (SELECT product_id AS id, brand, size, {d.distinct(d.split("CASE WHEN product_id % 2 = 0 THEN concat(title, ' pro') ELSE title END", " "))} AS toks, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY cents) AS DOUBLE) AS price FROM offer GROUP BY product_id, brand, size, title),
p AS (SELECT a.id AS short_id, b.id AS long_id, count(*) OVER (PARTITION BY a.id) AS na, count(*) OVER (PARTITION BY b.id) AS nb FROM m a JOIN m b ON b.brand = a.brand AND b.size = a.size AND b.id <> a.id AND {d.within(a, b)} AND {d.size(b)} = {d.size(a)} + 1 AND {d.join(d.minus(b, a), " ")} IN ('pro', 'evo') AND greatest(a.price, b.price) <= 1.5 * least(a.price, b.price))
SELECT short_id, long_id FROM p WHERE na = 1 AND nb = 1"""


@plan("q25_group_verdict")
def _(d):
    return f"""WITH {SIG}, g AS (SELECT gtin % 500 AS grp, count(DISTINCT gtin) AS products, count(DISTINCT colour) FILTER (WHERE colour <> '') AS colours, bool_and(colour <> '') AS coloured, count(DISTINCT sex) FILTER (WHERE sex <> 'U') AS sexes, count(DISTINCT age) AS ages, count(DISTINCT year) AS years,
  max(cents) / CAST(min(cents) AS DOUBLE) AS ratio FROM sig GROUP BY 1), s AS (SELECT grp, max(n) AS same_size FROM (SELECT gtin % 500 AS grp, size, count(DISTINCT gtin) AS n FROM sig GROUP BY 1, size) x GROUP BY grp)
SELECT g.grp, CASE WHEN colours > 1 OR sexes > 1 OR ages > 1 OR years > 1 OR same_size > 1 OR ratio > 3 THEN 'refuse' WHEN coloured AND ratio <= 1.5 THEN 'safe' WHEN same_size = 1 THEN 'probable' ELSE 'doubtful' END AS verdict, products FROM g JOIN s ON s.grp = g.grp"""


@plan("q26_cut_by_size")
def _(d):
    bare = t.title_without_size("concat(p_name, ' - ', p_size)", d)
    return f"""WITH p AS (SELECT p_partkey AS id, p_brand AS brand, p_type AS kind, p_size AS size, p_retailprice AS price, {bare} AS bare FROM part),
c AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON b.brand = a.brand AND b.kind = a.kind AND b.bare = a.bare AND b.id > a.id AND b.size <> a.size AND greatest(a.price, b.price) < 1.3 * least(a.price, b.price)),
n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM c UNION ALL SELECT b FROM c) x GROUP BY id)
SELECT c.a, c.b FROM c JOIN n na ON na.id = c.a JOIN n nb ON nb.id = c.b WHERE na.n = 1 AND nb.n = 1"""


@plan("q27_separate_references")
def _(d):
    return f"""WITH {OFFER}, r AS (SELECT offer_id, product_id, merchant_id, {d.extract("concat(title, ' ', lpad(concat('', 10000000 + (product_id * 7 + position % 2)), 8, '0'))", "\\b([0-9]{8,12})\\b", 1)} AS ref FROM offer WHERE live),
g AS (SELECT product_id, min(ref) AS keeps FROM r GROUP BY product_id HAVING count(DISTINCT ref) > 1)
SELECT r.offer_id, r.product_id, CASE WHEN r.ref = g.keeps THEN 'stays' ELSE 'moves' END AS verdict FROM r JOIN g ON g.product_id = r.product_id""".replace("{8,12}", "{8,12}")


@plan("q28_price_gap_control")
def _(d):
    return f"""WITH {OFFER}, per AS (SELECT product_id, merchant_id, min(cents) AS cents, count(*) AS codes, count(DISTINCT title) AS titles FROM offer WHERE live GROUP BY product_id, merchant_id),
g AS (SELECT product_id, max(cents) / CAST(min(cents) AS DOUBLE) AS ratio, max(codes) AS codes, bool_or(codes > 1 AND titles > 1) AS two FROM per GROUP BY product_id HAVING count(*) >= 2 AND max(cents) >= 1.15 * min(cents)), was AS (SELECT p_partkey AS id, p_partkey % 6 = 0 AS decided FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(g.product_id, was.id) AS product_id, CASE WHEN g.product_id IS NULL THEN 'kept' WHEN g.two OR g.ratio >= 2 THEN 'strong' WHEN g.codes > 1 THEN 'medium' ELSE 'weak' END AS severity FROM g FULL JOIN was ON was.id = g.product_id WHERE g.product_id IS NOT NULL OR was.decided"""


@plan("q30_feed_vitality")
def _(d):
    return f"""WITH {OFFER}, l AS (SELECT merchant_id, max(seen) AS last_day FROM offer GROUP BY merchant_id), b AS (SELECT o.merchant_id, l.last_day, max(CASE WHEN o.seen < l.last_day THEN o.seen END) AS prev_day FROM offer o JOIN l ON l.merchant_id = o.merchant_id GROUP BY o.merchant_id, l.last_day),
n AS (SELECT b.merchant_id, count(*) FILTER (WHERE o.seen = b.last_day) AS arrived, count(*) FILTER (WHERE o.seen = b.prev_day) AS before, count(DISTINCT o.cents) FILTER (WHERE o.seen IN (b.last_day, b.prev_day)) AS prices FROM b JOIN offer o ON o.merchant_id = b.merchant_id GROUP BY b.merchant_id)
SELECT merchant_id, arrived, before, prices, arrived = 0 AND before = 0 OR prices <= 1 AS frozen FROM n"""


@plan("q58_purge_new_merchant")
def _(d):
    return f"""WITH {SIG}, broken AS (SELECT gtin FROM sig GROUP BY gtin HAVING min(age) <> max(age) OR (bool_or(pack) AND NOT bool_and(pack)))
SELECT s.offer_id, CASE WHEN b.gtin IS NOT NULL AND s.merchant_id % 10 = 0 THEN 'rejected' ELSE 'linked' END AS status FROM sig s LEFT JOIN broken b ON b.gtin = s.gtin"""


@plan("q59_reset_matching_state")
def _(d):
    return f"""WITH {OFFER}, operator_rows AS (SELECT s_suppkey AS merchant_id, s_acctbal > 9000 AS held FROM supplier)
SELECT o.offer_id, CASE WHEN r.held THEN 'held by operator' ELSE 'unmatched' END AS status, CAST(CASE WHEN r.held THEN o.product_id END AS BIGINT) AS product_id FROM offer o JOIN operator_rows r ON r.merchant_id = o.merchant_id"""
