"""Scalar functions and text classification over stand-in columns (survey sections 2.8 and 2.9)."""

from offerloom.functions import text as t
from offerloom.plans.dialect import AS_OF, plan

#: A title with colour, sex, year and size words, made of a part's columns.
TITLE = """title AS (SELECT p_partkey AS id, p_brand AS brand, p_size AS size, p_retailprice AS price,
  concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' Homme' WHEN 1 THEN ' Femme' WHEN 2 THEN ' Éclair III' ELSE ' junior pack' END, ' ', CASE WHEN p_partkey % 3 = 0 THEN concat('20', 15 + p_partkey % 13) ELSE 'noir mat' END, ' - ', p_size) AS title FROM part)"""
GTIN = """code AS (SELECT p_partkey AS id, concat('3760', lpad(concat('', p_partkey % 500), 8, '0'), p_partkey % 10) AS gtin FROM part)"""


def over_titles(name: str, **columns):
    """A plan of expressions over the titles."""
    plan(name)(lambda d: f"WITH {TITLE} SELECT id, {', '.join(f'{f(d)} AS {c}' for c, f in columns.items())} FROM title")


plan("h01_norm_text")(lambda d: f"SELECT doc_id, md5({t.norm_text('text', d)}) AS norm_md5 FROM documents")
ALIASES = {"brand1": "one", "brand12": "twelve", "brand25": "twelve"}
plan("h02_brand_alias")(lambda d: f"SELECT p_partkey, {t.brand_code('p_brand', ALIASES, d)} AS code, {t.brand_known('p_brand', ALIASES, d)} AS known FROM part")


@plan("h03_colour_code")
def _(d):
    words = ["noir mat", "blanc / rouge", "noire", "noir blanche", "bleu navy brillant", "verte fluo", "titane carbone", "gris anthracite", "mat", "irisé multicolore", ""]
    raw = f"CASE p_partkey % {len(words)} {' '.join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(words))} END"
    return f"SELECT p_partkey, {t.colour_code(raw, d)} AS colour, {t.first_colour(raw, d)} AS first FROM part"


@plan("h04_genre_age")
def _(d):
    sex = "CASE p_partkey % 5 WHEN 0 THEN 'Male' WHEN 1 THEN 'weiblich' WHEN 2 THEN 'Unisexe' WHEN 3 THEN 'bg_BG:x' END"
    age = "CASE p_size % 4 WHEN 0 THEN 'Kids' WHEN 1 THEN 'adulte' WHEN 2 THEN 'all' END"
    return f"WITH {TITLE}, fed AS (SELECT p_partkey AS id, {sex} AS sex, {age} AS age FROM part) SELECT id, {t.genre_age('title', 'sex', 'age', d)} AS code FROM title JOIN fed USING (id)"


over_titles("h05_model_year", year=lambda d: t.model_year("title", d))
over_titles("h06_is_pack", pack=lambda d: t.is_pack("title", d))
plan("h07_valid_gtin")(lambda d: f"WITH {GTIN} SELECT id, gtin, {t.valid_gtin('gtin', d)} AS valid FROM code")
plan("h52_comparable_gtin")(lambda d: f"WITH {GTIN} SELECT id, {t.comparable_gtin(chr(39) + '0' + chr(39) + ' || gtin', d)} AS comparable FROM code")


@plan("h08_size_code")
def _(d):
    raw = "CASE p_partkey % 16 WHEN 0 THEN 'xxl' WHEN 1 THEN concat('', p_size, ' cm') WHEN 2 THEN concat('EU ', p_size) WHEN 3 THEN concat(p_size, '/', p_size + 1, ' ans') WHEN 4 THEN concat(p_size, ',5') WHEN 5 THEN 'Taille unique' WHEN 6 THEN concat('Taille ', p_size) WHEN 7 THEN 'S (55/56 cm)' WHEN 8 THEN 'Short XL' WHEN 9 THEN 'Noir' WHEN 10 THEN concat(p_size, '.5 US') WHEN 11 THEN concat('', p_size) WHEN 12 THEN '' END"
    link = "CASE WHEN p_partkey % 16 = 13 THEN concat('https://x.example/taille-', p_size) END"
    title = "CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, ' - ', p_size) WHEN p_partkey % 3 = 1 THEN concat(p_name, ' - mesh') END"
    mpn = "CASE p_partkey % 2 WHEN 0 THEN concat('LEH.07.039.', p_partkey, '/S') ELSE concat(p_partkey, 'XL') END"
    cand, source = t.size_candidate("raw", "title", "link", "mpn", d)
    return f"WITH fed AS (SELECT p_partkey, {raw} AS raw, {link} AS link, {title} AS title, {mpn} AS mpn FROM part), found AS (SELECT p_partkey, {cand} AS cand, {source} AS source FROM fed), coded AS (SELECT p_partkey, source, {t.size_code('cand', 'source', d)} AS size FROM found) SELECT p_partkey, size, CASE WHEN size <> '' THEN source ELSE '' END AS source FROM coded"


@plan("h09_model_tokens")
def _(d):
    toks = d.sorted(d.keep(t.words("title", d), "w", f"w NOT IN ('homme', 'femme', 'junior', 'pack', 'noir', 'mat') AND NOT {d.matches('w', '^[0-9]+$')}"))
    ref = d.extract("lower(title)", "\\b([a-z]+[0-9]+[a-z0-9]*)\\b", 1)
    return f"WITH {TITLE}, m AS (SELECT id, {toks} AS toks, {ref} AS ref FROM title) SELECT id, {d.join('toks', '-')} AS tokens, ref, CASE WHEN ref <> '' THEN 'strong' WHEN {d.size('toks')} >= 2 THEN 'medium' WHEN {d.size('toks')} = 1 THEN 'weak' ELSE 'empty' END AS strength FROM m"


plan("h10_base_sku")(lambda d: f"SELECT p_partkey, {t.base_sku(chr(34) * 0 + 'concat(p_brand, ' + chr(39) + '-' + chr(39) + ', lpad(concat(' + chr(39) * 2 + ', p_size), 2, ' + chr(39) + '0' + chr(39) + '))', d)} AS base FROM part")


@plan("h11_price_text")
def _(d):
    raw = "CASE p_partkey % 5 WHEN 0 THEN concat('EUR ', p_partkey, ',50') WHEN 1 THEN concat('1.', lpad(concat('', p_partkey % 1000), 3, '0'), ',99 €') WHEN 2 THEN concat('2,', lpad(concat('', p_partkey % 1000), 3, '0'), '.5') WHEN 3 THEN '0,00' ELSE 'sur devis' END"
    return f"SELECT p_partkey, {t.money(raw, d)} AS cents FROM part"


plan("h12_in_stock")(lambda d: f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {t.in_stock("CASE l_returnflag WHEN 'A' THEN 'En stock' WHEN 'R' THEN 'Épuisé' ELSE 'soon' END", d)} AS stock FROM lineitem")


@plan("h13_sale_is_live")
def _(d):
    day = "CAST(o_orderdate AS DATE)"
    window = f"CASE o_orderkey % 4 WHEN 0 THEN concat({d.string(day)}, '/') WHEN 1 THEN concat('/', {d.string(day)}) WHEN 2 THEN concat({d.string(day)}, 'T00:00/2001-06-01T00:00') ELSE 'soon' END"
    return f"WITH {AS_OF} SELECT o_orderkey, {t.sale_is_live(window, 'today.day', d)} AS live FROM orders, today"


plan("h14_json_price")(lambda d: f"SELECT event_id, CAST({d.field('props', 'k')} AS BIGINT) * 100 AS cents FROM events")
plan("h15_effective_price")(lambda d: f"SELECT p_partkey, {t.effective_price('CAST(floor(p_retailprice * 100) AS BIGINT)', 'CASE WHEN p_size > 20 THEN CAST(p_size AS BIGINT) * 3000 END', 'p_partkey % 2 = 0', 90000)} AS cents FROM part")


@plan("h16_url_unwrap")
def _(d):
    wrapped = "concat('https://go.example/c?id=', page_id, '&url=', replace(replace(url, '&', '%26'), '?', '%3F'))"
    return f"SELECT page_id, replace(replace({t.query_parameter(wrapped, 'url', d)}, '%26', '&'), '%3F', '?') AS target FROM pages"


plan("h17_merchant_key")(lambda d: f"SELECT page_id, {t.merchant_key("CASE WHEN page_id % 2 = 0 THEN concat('p', page_id) ELSE ' ' END", 'url', d)} AS merchant_key FROM pages")
plan("h18_category_path")(lambda d: f"SELECT p_partkey, {t.category_path('p_type', "CASE WHEN p_size > 25 THEN ' ' ELSE 'Large sizes' END", 'p_name')} AS path FROM part")


@plan("h19_colour_from_image")
def _(d):
    image = "concat('https://img.example/', replace(p_name, ' ', '-'), '-red-black.jpg')"
    name = d.extract(image, "/([^/]*)[.]jpg$", 1)
    field, seen = t.colour_code("p_name", d), t.colour_code(name, d)
    return f"WITH c AS (SELECT p_partkey, {field} AS field, {seen} AS seen FROM part) SELECT p_partkey, CASE WHEN field <> seen AND {d.within(t.colour_parts('field', d), t.colour_parts('seen', d))} THEN seen ELSE field END AS colour FROM c"


@plan("h20_identity_hash")
def _(d):
    return f"WITH {TITLE}, m AS (SELECT id, brand, size, title, {d.sorted(t.words('title', d))} AS toks FROM title) SELECT id, {t.identity_hash('brand', 'size', t.colour_code('title', d), t.model_year('title', d), t.genre_age('title', 'brand', 'NULL', d), t.is_pack('title', d), 'CAST(NULL AS VARCHAR)' if not d.spark else 'CAST(NULL AS STRING)', 'toks', d)} AS h FROM m"


plan("h21_split_hash")(lambda d: f"WITH {GTIN} SELECT id, md5(concat(md5({d.string('id % 50')}), '|', gtin)) AS by_code, md5(concat(md5({d.string('id % 50')}), '|prix|', {d.string('id % 9')}, '|', gtin)) AS by_price FROM code")
over_titles("h22_slug", slug=lambda d: t.slug("title", f"md5({d.string('id')})", d))


@plan("h23_initcap")
def _(d):
    each = d.map(d.split("title", " "), "w", "concat(upper(substring(w, 1, 1)), lower(substring(w, 2)))")
    return f"WITH {TITLE} SELECT id, {d.join(each, ' ')} AS shown FROM title"


plan("h24_canonical_size")(lambda d: f"SELECT p_partkey, {t.canonical_size("CASE p_partkey % 3 WHEN 0 THEN concat('xl', p_size) WHEN 1 THEN concat('T', p_size) ELSE concat('', p_size) END", d)} AS size FROM part")
plan("h25_declared_size")(lambda d: "SELECT p_partkey, coalesce(CASE WHEN p_size % 5 = 0 THEN 'override' END, CASE WHEN p_size % 3 = 0 THEN 'feed' END, CASE WHEN p_size % 7 = 0 AND p_partkey % 2 = 0 THEN 'borrowed' END) AS source FROM part")


@plan("h26_final_size")
def _(d):
    return """WITH s AS (SELECT p_partkey, p_brand, p_type, p_size, bool_or(p_size < 34) OVER (PARTITION BY p_brand, p_type) AS waist FROM part)
SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'TU' WHEN p_type = 'LARGE' AND p_size BETWEEN 50 AND 65 THEN concat('EU', p_size) WHEN p_type = 'SMALL' AND waist AND p_size >= 36 THEN NULL ELSE concat('', p_size) END AS size FROM s"""


plan("h27_borrow_size")(lambda d: f"WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'XXL' WHEN 1 THEN 'XXXL' ELSE concat('M', p_size) END AS raw FROM part) SELECT p_partkey, CASE raw WHEN 'XXL' THEN '2XL' WHEN 'XXXL' THEN '3XL' ELSE nullif({d.extract('raw', '^(XS|S|M|L|XL)', 1)}, '') END AS size FROM s")
plan("h28_unaccent")(lambda d: f"SELECT doc_id, md5({t.unaccent('text', d)}) AS plain_md5 FROM documents")
plan("h29_search_text")(lambda d: f"SELECT doc_id, md5({t.search_text('text', d)}) AS search_md5 FROM documents")


#: What a visitor typed, and the likeness above which a word counts as found.
TYPED, FOUND_AT = ("widge", "red"), 0.5


@plan("h30_trigram_search")
def _(d):
    """Titles in which every typed word is found, by the sum of their likenesses."""
    each = ", ".join(f"{t.strict_word_similarity(f"'{w}'", 'title', d)} AS s{k}" for k, w in enumerate(TYPED))
    every, total = (x.join(f"s{k}{y}" for k in range(len(TYPED))) for x, y in ((" AND ", f" > {FOUND_AT}"), (" + ", "")))
    return f"WITH n AS (SELECT p_partkey, {t.norm_text('p_name', d)} AS title FROM part), s AS (SELECT p_partkey, {each} FROM n) SELECT p_partkey, {total} AS similarity FROM s WHERE {every}"


plan("h31_near_words")(lambda d: f"WITH w AS (SELECT DISTINCT {d.unnest(d.split('p_name', ' '))} AS w FROM part), typed(q) AS (VALUES ('rde'), ('rnig'), ('wiget'), ('blolt'), ('smal')) SELECT q, w FROM typed JOIN w ON {t.near_word('q', 'w', d)}")
plan("h32_edge_helpers")(lambda d: f"SELECT p_partkey, left(p_name, 3) AS head, right(p_brand, 2) AS tail, {d.item(d.split('p_name', ' '), 1)} AS first_word, translate(p_brand, '#B', '-b') AS moved, replace(p_type, 'A', '') AS thin, rtrim(concat(p_name, '  ')) AS bare FROM part")
plan("h33_price_digits")(lambda d: f"SELECT p_partkey, CAST({d.gsub(f"concat('EUR ', {d.string('CAST(floor(p_retailprice) AS BIGINT)')}, ' ttc')", '[^0-9]')} AS BIGINT) AS euros FROM part")
plan("h34_array_helpers")(lambda d: f"WITH w AS (SELECT p_partkey, {d.split('p_name', ' ')} AS w FROM part) SELECT p_partkey, {d.size('w')} AS n, {d.join('w', '+')} AS joined, {d.item('w', 2)} AS second, {d.size(d.keep('w', 'x', f"x <> {chr(39)}red{chr(39)}"))} AS others FROM w")
plan("h35_colour_inclusion")(lambda d: f"WITH {TITLE}, c AS (SELECT id, {t.colour_code('title', d)} AS colour FROM title) SELECT a.id, a.colour, {t.colours_compatible('a.colour', 'b.colour', d)} AS fits FROM c a JOIN c b ON b.id = a.id + 1")
plan("h36_category_tolerance")(lambda d: f"SELECT a.p_partkey, {t.category_tolerant('a.p_size % 7', 'b.p_size % 7')} AS tolerant FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
plan("h37_greatest_least")(lambda d: "SELECT p_partkey, greatest(p_size, 10) / CAST(least(p_size, 10) AS DOUBLE) AS ratio FROM part")
plan("h38_width_bucket")(lambda d: f"SELECT p_partkey, {d.bucket('CAST(p_size AS BIGINT)', '5', '45', '8')} AS bucket FROM part")
plan("h39_seeded_order")(lambda d: f"SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY md5(concat({d.string('p_partkey')}, '2024-01-15'))) AS BIGINT) AS place FROM part")
plan("h40_round_half_up")(lambda d: "SELECT p_partkey, CAST(round(CAST(p_size * 1.125 AS DECIMAL(12, 4)), 2) AS DECIMAL(12, 2)) AS rounded FROM part")


@plan("h41_date_arithmetic")
def _(d):
    day = "CAST(o_orderdate AS DATE)"
    return f"WITH {AS_OF} SELECT o_orderkey, {d.days('today.day', day)} AS age, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS year, {day} >= today.day - INTERVAL 365 DAY AS recent FROM orders, today"


plan("h42_utc_day")(lambda d: "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
plan("h43_json_fields")(lambda d: f"""SELECT event_id, {d.field("concat('{\"kind\": \"', event_type, '\"}')", "kind")} AS kind FROM events""")
plan("h44_french_price")(lambda d: f"SELECT p_partkey, {t.french_price('CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT)', d)} AS shown FROM part")
plan("h45_discount_level")(lambda d: f"SELECT p_partkey, {t.discount_level('p_size')} AS level FROM part")


@plan("h46_nice_ticks")
def _(d):
    return f"""WITH b AS (SELECT p_brand, CAST(floor(min(p_retailprice)) AS BIGINT) AS low, CAST(ceil(max(p_retailprice)) AS BIGINT) AS high FROM part GROUP BY p_brand),
s AS (SELECT p_brand, low, high, CASE WHEN high - low > 500 THEN 200 WHEN high - low > 100 THEN 50 ELSE 10 END AS step FROM b)
SELECT p_brand, {d.unnest(d.sequence("CAST(floor(low / CAST(step AS DOUBLE)) AS BIGINT)", "CAST(ceil(high / CAST(step AS DOUBLE)) AS BIGINT)"))} AS tick, step FROM s"""


plan("h47_adjacent_gtins")(lambda d: f"WITH {GTIN} SELECT a.id, {t.adjacent_gtins('a.gtin', 'b.gtin')} AS near FROM code a JOIN code b ON b.id = a.id + 1")


@plan("h48_query_words")
def _(d):
    return f"""WITH typed AS (SELECT DISTINCT concat(p_name, CASE p_partkey % 4 WHEN 0 THEN 's femme' WHEN 1 THEN 's noirs' WHEN 2 THEN ' homme' ELSE ' rouges' END) AS q FROM part), w AS (SELECT q, {d.unnest(d.split("q", " "))} AS w FROM typed)
SELECT q, w, CASE WHEN w IN ('femme', 'homme') THEN 'sex' WHEN {t.lookup(d.gsub('w', 's$'), t.COLOURS)} IS NOT NULL THEN 'colour' ELSE 'word' END AS kind, {d.gsub("w", "s$")} AS singular FROM w"""


@plan("h49_brand_recognition")
def _(d):
    return f"""WITH b AS (SELECT DISTINCT lower({d.gsub("p_brand", "#", "")}) AS brand FROM part), typed(q) AS (VALUES ('brand1'), ('brnad12'), ('brand2'), ('brand2x'), ('zzz')),
c AS (SELECT q, brand, CASE WHEN brand = q THEN 1 WHEN brand LIKE concat(q, '%') THEN 2 ELSE 3 END AS tier FROM typed JOIN b ON brand = q OR brand LIKE concat(q, '%') OR {t.near_word("q", "brand", d)}),
r AS (SELECT *, min(tier) OVER (PARTITION BY q) AS best, count(*) OVER (PARTITION BY q, tier) AS n FROM c)
SELECT q, min(brand) AS brand, min(tier) AS tier FROM r WHERE tier = best AND (tier < 3 OR n = 1) GROUP BY q"""


plan("h51_secret_masking")(lambda d: f"SELECT page_id, {t.masked("concat('GET https://user:pw@', replace(replace(url, 'http://', ''), 'https://', ''), '&token=abc', page_id, ' failed')", d)} AS line FROM pages")
plan("h53_colour_closure")(lambda d: f"SELECT word, code FROM (SELECT w.word, {t.lookup('w.word', t.COLOURS)} AS code FROM (SELECT DISTINCT {d.unnest(d.split('p_name', ' '))} AS word FROM part) w) x WHERE code IS NOT NULL")
plan("h54_filter_codes")(lambda d: f"WITH {TITLE}, c AS (SELECT id, {t.colour_code('title', d)} AS code FROM title) SELECT id, {d.matches('code', '^[A-Z]{2}([-|][A-Z]{2,3})*$')} AS fine, {d.item(d.split(d.item(d.split('code', '|'), 1), '-'), 1)} AS first_colour FROM c")
plan("h55_size_sort_key")(lambda d: f"WITH s AS (SELECT p_partkey, CASE WHEN p_size <= 9 THEN {d.item(d.array(*map(repr, t.LETTER_SIZES)), 'p_size')} ELSE {d.string('p_size')} END AS label FROM part) SELECT p_partkey, CAST({t.size_sort_key('label', d)} AS DOUBLE) AS sort_key FROM s")
over_titles("h56_title_without_size", bare=lambda d: t.title_without_size("title", d))
over_titles("h57_title_words", words=lambda d: d.join(d.sorted(t.words("title", d)), " "))


# Classification ----------------------------------------------------------------------------------------------------

#: Ordered rules: the first pattern that a text matches decides.
RULES = (("ring", 4), ("widget", 2), ("bolt|screw|nut", 7), ("red|blue", 9), ("small|large", 12))


def classified(x: str, d) -> str:
    return f"CASE {' '.join(f'WHEN {d.matches(x, p)} THEN {c}' for p, c in RULES)} ELSE 25 END"


plan("x01_ordered_rules")(lambda d: f"SELECT p_partkey, CASE WHEN {classified('lower(p_type)', d)} <> 25 THEN {classified('lower(p_type)', d)} ELSE {classified('p_name', d)} END AS category FROM part")


@plan("x02_map_unseen_paths")
def _(d):
    return f"""WITH known(path) AS (VALUES ('PROMO'), ('SMALL')), paths AS (SELECT DISTINCT concat(p_type, ' > ', p_name) AS path, p_type FROM part)
SELECT path, {classified("path", d)} AS category, CASE WHEN {classified("path", d)} = 25 THEN 0.10 ELSE 0.60 END AS confidence FROM paths p WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.path = p.p_type)""".replace("THEN 0.10 ELSE 0.60", "THEN CAST(0.10 AS DOUBLE) ELSE CAST(0.60 AS DOUBLE)")


plan("x03_coarse_bucket_reread")(lambda d: f"SELECT p_partkey, CASE WHEN p_type = 'STANDARD' THEN {classified('p_name', d)} ELSE 1 END AS category FROM part")


@plan("x04_cascade_with_neighbours")
def _(d):
    return f"""WITH c AS (SELECT p_partkey, p_brand, p_size, p_name, {classified("p_name", d)} AS own FROM part), n AS (SELECT p_brand, p_size, min(own) AS sole FROM c WHERE own <> 25 GROUP BY p_brand, p_size HAVING count(DISTINCT own) = 1)
SELECT p_partkey, CASE WHEN contains(p_name, 'bolt') THEN 7 WHEN sole IS NOT NULL AND own = 25 THEN sole ELSE own END AS category FROM c LEFT JOIN n USING (p_brand, p_size)"""


@plan("x06_propagate_unanimous")
def _(d):
    return f"""WITH c AS (SELECT p_partkey, p_brand, CASE WHEN p_size <= 2 THEN {classified("p_name", d)} END AS decided FROM part), u AS (SELECT p_brand, min(decided) AS sole FROM c WHERE decided IS NOT NULL GROUP BY p_brand HAVING count(DISTINCT decided) = 1)
SELECT p_partkey, coalesce(decided, sole, 25) AS category FROM c LEFT JOIN u USING (p_brand)"""


@plan("x07_borrow_from_trusted")
def _(d):
    return """WITH o AS (SELECT l_partkey AS code, l_suppkey AS m, l_linenumber AS size, l_suppkey % 3 = 0 AS trusted FROM lineitem), parent AS (SELECT code, m FROM o GROUP BY code, m HAVING count(*) > 1),
lent AS (SELECT code, min(size) AS size FROM o WHERE trusted AND NOT EXISTS (SELECT 1 FROM parent p WHERE p.code = o.code AND p.m = o.m) GROUP BY code HAVING count(DISTINCT size) = 1)
SELECT o.code, o.m, count(*) AS n, min(lent.size) AS size FROM o JOIN lent USING (code) WHERE NOT trusted GROUP BY o.code, o.m"""


plan("x08_all_parts_reclassify")(lambda d: "SELECT l_suppkey AS product, bool_and(p_size < 49) AS move FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'O' GROUP BY l_suppkey")


@plan("x09_helmet_attributes")
def _(d):
    x = "text"
    return f"""SELECT doc_id, {d.matches(x, "(?i)\\bthe\\b.{{0,60}}\\bwith\\b")} AS prepared, {d.matches(x, "(?i)sun|soleil")} AS visor, CAST(nullif({d.extract(x, "\\b([0-9]{3,4}) ?g\\b", 1)}, '') AS BIGINT) AS weight, {d.size(d.extract_all(x, "(?i)\\bvent"))} AS vents FROM documents""".replace("{{0,60}}", "{0,60}")


@plan("x14_merge_readings")
def _(d):
    return """WITH r AS (SELECT l_partkey AS product, l_suppkey % 5 AS source, CASE WHEN l_linenumber < 3 THEN NULL ELSE l_linenumber END AS value, l_returnflag AS safety FROM lineitem),
f AS (SELECT product, min_by(value, source * 100 + value) AS value FROM r WHERE value IS NOT NULL GROUP BY product), s AS (SELECT product, CASE WHEN count(DISTINCT safety) = 1 THEN min(safety) END AS safety FROM r GROUP BY product)
SELECT s.product, f.value, s.safety FROM s LEFT JOIN f USING (product)"""


plan("x15_season_and_material")(lambda d: f"SELECT doc_id, CASE WHEN {d.matches('text', '(?i)\\b(winter|hiver)\\b')} THEN 'winter' WHEN {d.matches('text', '(?i)\\b(summer|ete|été)\\b')} THEN 'summer' END AS season, {d.join(d.sorted(d.distinct(d.extract_all('lower(text)', '\\b(carbon|leather|cuir|textile)\\b'))), ',')} AS materials FROM documents")
plan("x25_past_year_code")(lambda d: f"WITH c AS (SELECT o_orderkey, concat('CODE', extract(YEAR FROM o_orderdate)) AS code, o_orderstatus = 'P' AS dated FROM orders) SELECT o_orderkey, NOT dated AND {d.extract('code', '(20[0-9]{2}|19[0-9]{2})$', 1)} < '2000' AS rejected FROM c")


@plan("x16_promo_codes")
def _(d):
    code = d.extract_all("text", "\\b[A-Za-z]{1,8}[0-9]{1,3}\\b")
    return f"""WITH c AS (SELECT doc_id, {d.unnest(code)} AS code FROM documents) SELECT doc_id, code, count(*) AS n, max(CASE WHEN {d.matches("code", "[05]$")} THEN 2 ELSE 1 END) AS score FROM c WHERE code NOT IN ('ISO9001') GROUP BY doc_id, code"""


@plan("x19_withdraw_unseen")
def _(d):
    return """WITH old AS (SELECT o_orderkey AS code, o_custkey % 50 AS merchant FROM orders WHERE o_orderkey % 2 = 0), answered AS (SELECT DISTINCT o_custkey % 50 AS merchant FROM orders WHERE o_custkey % 50 < 30), fresh AS (SELECT o_orderkey AS code, o_custkey % 50 AS merchant FROM orders WHERE o_orderkey % 3 = 0)
SELECT code, merchant FROM old WHERE EXISTS (SELECT 1 FROM answered a WHERE a.merchant = old.merchant) AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.code = old.code AND f.merchant = old.merchant)"""


plan("x20_cited_passage")(lambda d: f"WITH c AS (SELECT doc_id, {t.norm_text('text', d)} AS said FROM documents), b AS (SELECT item_id, {t.norm_text('text', d)} AS cited FROM benchmark) SELECT doc_id, item_id FROM c JOIN b ON contains(said, cited)")
plan("x21_reference_numbers")(lambda d: f"SELECT doc_id, {d.join(d.sorted(d.distinct(d.extract_all('text', '\\b[0-9]{8,12}\\b'))), ',')} AS refs FROM documents")


@plan("x22_two_articles")
def _(d):
    a, b = d.split("x.title", " "), d.split("y.title", " ")
    return f"""WITH {TITLE} SELECT x.id, {d.size(d.keep(d.union(d.minus(a, b), d.minus(b, a)), "w", f"NOT {d.matches('w', '^[0-9]+$')}"))} > 0 AS two FROM title x JOIN title y ON y.id = x.id + 8"""


plan("x23_word_position")(lambda d: f"SELECT p_partkey, CASE WHEN {d.position('p_name', chr(39) + 'ring' + chr(39))} = 0 THEN 'no ring' WHEN {d.position('p_name', chr(39) + 'red' + chr(39))} BETWEEN 1 AND {d.position('p_name', chr(39) + 'ring' + chr(39))} THEN 'red first' ELSE 'ring first' END AS verdict FROM part")


@plan("a10_description_unescaped")
def _(d):
    x = "html"
    for entity, mark in (("&copy;", "(c)"), ("&middot;", "."), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{mark}')"
    return f"SELECT page_id, md5({x}) AS plain_md5 FROM pages"


@plan("a12_reseller_pages")
def _(d):
    return f"""SELECT page_id, {d.extract("url", "^https?://([^/]+)/", 1)} AS host, {d.extract("url", "/([a-z]{2})/([0-9]+)", 2).replace("{2}", "{2}")} AS item, {d.size(d.extract_all("html", "<p>"))} AS paragraphs, {d.chars(d.extract("html", "<article>(.*)</article>", 1))} AS article_chars FROM pages"""


@plan("a15_json_source")
def _(d):
    return f"""WITH j AS (SELECT event_id, concat('{{"id": ', event_id, ', "kind": "', event_type, '"}}') AS doc FROM events) SELECT event_id, {d.field("doc", "kind")} AS kind, CAST({d.field("doc", "id")} AS BIGINT) AS id FROM j"""


@plan("a21_refreshed_statistics")
def _(d):
    return """WITH s AS (SELECT l_partkey AS product, count(*) AS offers, max(l_shipdate) AS latest FROM lineitem GROUP BY l_partkey) SELECT p_partkey, coalesce(offers, 0) AS offers, CAST(latest AS DATE) AS latest FROM part LEFT JOIN s ON product = p_partkey"""


@plan("a26_sitemap_rows")
def _(d):
    return f"""SELECT concat('/p/', {t.slug("p_name", f"md5({d.string('p_partkey')})", d)}) AS path, CASE WHEN p_size > 25 THEN 'weekly' ELSE 'daily' END AS changes FROM part WHERE p_retailprice > 0"""


@plan("h50_legacy_urls")
def _(d):
    path = "concat('/', p_type, '/', p_partkey, '-', replace(p_name, ' ', '_'), '.html')"
    return f"""WITH u AS (SELECT p_partkey, {path} AS path FROM part) SELECT p_partkey, CASE WHEN {d.matches("path", "^/PROMO/")} THEN '/bons-plans' WHEN {d.matches("path", "/[0-9]+-[a-z_]+[.]html$")} THEN concat('/p/', {d.extract("path", "/([0-9]+)-", 1)}) ELSE '/' END AS target FROM u"""


@plan("x05_ordered_splitter")
def _(d):
    return f"""SELECT p_partkey, CASE WHEN {d.matches("p_name", "^small.*ring$")} THEN 'ring, small' WHEN {d.matches("p_name", "ring|bolt")} AND p_size > 30 THEN 'hardware, large' WHEN {d.matches("p_name", "ring|bolt")} THEN 'hardware' WHEN p_type = 'PROMO' THEN 'promotion' END AS part_of FROM part"""


@plan("x24_one_text_per_product")
def _(d):
    return f"""WITH s AS (SELECT l_partkey AS product, CASE l_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS source, concat('poids ', CAST(l_quantity AS INT) * 40, ' g') AS body, l_orderkey, l_linenumber FROM lineitem),
r AS (SELECT product, source, body, row_number() OVER (PARTITION BY product ORDER BY source, body, l_orderkey, l_linenumber) AS k FROM s) SELECT product, source, CAST({d.extract("body", "([0-9]+) g", 1)} AS BIGINT) AS weight FROM r WHERE k = 1"""


@plan("q54_reseller_matching")
def _(d):
    a, b = d.split("p_name", " "), d.split("model", " ")
    bare = d.keep(a, "w", "w NOT IN ('red', 'blue', 'green', 'small', 'large')")
    return f"""WITH sold(model) AS (VALUES ('ring'), ('widget'), ('bolt'), ('ring widget')), p AS (SELECT p_partkey, {bare} AS words FROM part),
m AS (SELECT p_partkey, model, {d.size(b)} AS n, row_number() OVER (PARTITION BY p_partkey ORDER BY {d.size(b)} DESC, model) AS k, count(*) OVER (PARTITION BY p_partkey, {d.size(b)}) AS ties FROM p JOIN sold ON {d.within(b, "words")}) SELECT p_partkey, model FROM m WHERE k = 1 AND ties = 1"""


@plan("q65_oldest_task_first")
def _(d):
    return """WITH t AS (SELECT event_id, event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events) SELECT event_type, event_id FROM t WHERE k = 1"""
