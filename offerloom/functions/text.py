"""Scalar functions of the catalogue as SQL expressions, for Spark and, with the oracle's dialect, for its checks.

Each takes SQL expressions (a column's name or more) and returns one; col() turns it into a Column. All stay inside
whole-stage code generation but for those on arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom.plans.dialect import SparkDialect

SPARK = SparkDialect()

# Colour codes with the words that mean them.
COLOUR_WORDS = {
    "BK": "noir black nero schwarz", "WH": "blanc white bianco weiss perle", "RD": "rouge red rosso", "BL": "bleu blue blu navy azur",
    "YE": "jaune yellow giallo gelb", "GN": "vert green verde kaki khaki army olive", "GY": "gris grey gray grigio anthracite nardo gunmetal",
    "OR": "orange", "PK": "rose pink", "PU": "violet purple lila", "BR": "marron brown chocolat cognac", "BG": "beige sable sand ivoire",
    "GD": "or gold dore oro", "SI": "argent silver chrome alu aluminium", "TI": "titane titanium titan", "BZ": "bronze", "CB": "carbone carbon carbonio",
    "CHAM": "cameleon chameleon irise", "MULTI": "multicolore multicolor multi",
}
# Words that count as a colour only where none of the above occurs.
LATE_COLOUR_WORDS = {"BK": "noire", "WH": "blanche", "GN": "verte", "GY": "grise", "BL": "bleue", "PU": "violette", "GD": "doree", "SI": "argentee argente"}
# Finishes.
FINISH_WORDS = {"MAT": "mat mate matte matt opaco", "GLO": "brillant gloss glossy lucido shiny", "FLU": "fluo fluorescent hiviz"}
# Sexes and ages as feeds write them.
FEED_SEX = {"H": "male homme men man herren uomo mannlich hombre", "F": "female femme women woman damen donna weiblich mujer", "U": "unisex unisexe uni mixte"}
FEED_AGE = {"A": "adult adulte adults adulti", "E": "kids kid enfant child children junior youth newborn infant toddler baby kinder"}
# Words of titles that tell sex, age and bundles.
FEMALE = "femme|women|woman|lady|ladies|donna|wmn|damen|mesdames|stella"
MALE = "homme|men|man|herren|uomo"
CHILD = "enfant|kid|kids|kinder|junior|jr|youth|child|bimbo|cadet|baby"
PACK = "\\b(pack|bundle|combo|multipack)\\b|\\blot de\\b"
GIFT_DEVICE = "\\b(intercom|bluetooth|cardo|sena|masque|ecran|sacoche)\\b"


def by_word(table: dict[str, str]) -> dict[str, str]:
    return {word: code for code, words in table.items() for word in words.split()}


COLOURS, LATE_COLOURS, FINISHES = map(by_word, (COLOUR_WORDS, LATE_COLOUR_WORDS, FINISH_WORDS))
STOCK_YES = ("in stock", "in_stock", "instock", "available", "1", "yes", "true", "oui", "en stock")
STOCK_NO = ("out of stock", "out_of_stock", "outofstock", "unavailable", "0", "no", "false", "non", "epuise")
LETTER_SIZES = ("XXS", "XS", "S", "M", "L", "XL", "2XL", "3XL", "4XL")


def col(expression: str) -> Column:
    return F.expr(expression)


def lookup(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())} END"


def unaccent(x, d=SPARK):
    return d.folded(x)


def ascii_text(x, d=SPARK):
    """Compatibility forms taken apart (ligatures, fractions, full widths), marks and what has no ASCII form left out.

    ASCII texts, also such that are so once single letters are replaced, skip what is left of it."""
    rest = d.gsub(d.spelt("one"), "[^\\x00-\\x7F]")
    letters = f"translate({x}, '{d.letters[0]}', '{d.letters[1]}')"
    return f"CASE WHEN {d.ascii(x)} THEN {x} ELSE {d.bound(letters, 'one', f'CASE WHEN {d.ascii("one")} THEN one ELSE {rest} END')} END"


class Normal(str):
    """A column that holds a normal form already, so that functions of a text do not work it out again."""


def norm_text(x, d=SPARK):
    """Lower-case ASCII, II and III as numbers, one space between runs of letters and digits; null gives the empty text."""
    if isinstance(x, Normal):
        return str(x)
    plain = f"lower({ascii_text(f"coalesce({x}, '')", d)})"
    numbered = d.gsub(d.gsub("low", "\\biii\\b", "3"), "\\bii\\b", "2")
    return f"trim({d.gsub(d.bound(plain, 'low', f"CASE WHEN contains(low, 'ii') THEN {numbered} ELSE low END"), '[^a-z0-9]+', ' ')})"


def search_text(x, d=SPARK):
    """Lower case without accents and without marks that people leave out."""
    return f"""translate(lower({d.folded(x)}), '-._/()[]"', '')"""


def words(x, d=SPARK):
    return d.distinct(d.split(norm_text(x, d), " "))


def brand_code(x, aliases: dict[str, str], d=SPARK):
    """The canonical code of a brand: letters and digits alone, and the alias they have, if any."""
    bare = f"replace({norm_text(x, d)}, ' ', '')"
    return f"coalesce({lookup(bare, aliases)}, {bare})"


def brand_known(x, aliases: dict[str, str], d=SPARK):
    return f"({lookup(f"replace({norm_text(x, d)}, ' ', '')", aliases)} IS NOT NULL)"


def _codes(x, table, d):
    return d.keep(d.map(d.split(norm_text(x, d), " "), "w", lookup("w", table)), "c", "c IS NOT NULL")


def colour_code(x, d=SPARK):
    """Base codes of the colour words, sorted and joined by -, then | and finish codes; empty without any base."""
    base, late, finish = (d.join(d.sorted(d.distinct(_codes(x, t, d))), "-") for t in (COLOURS, LATE_COLOURS, FINISHES))
    found = f"coalesce(nullif({base}, ''), {late})"
    return f"CASE WHEN {found} = '' OR {finish} = '' THEN {found} ELSE concat({found}, '|', {finish}) END"


def first_colour(x, d=SPARK):
    """The code of the first colour word; empty without any."""
    return f"coalesce({d.item(_codes(x, COLOURS, d), 1)}, {d.item(_codes(x, LATE_COLOURS, d), 1)}, '')"


def colour_parts(x, d=SPARK):
    return d.split(f"replace({x}, '|', '-')", "-")


def colours_compatible(a, b, d=SPARK):
    """Unknown, or one's parts contain the other's."""
    return f"({a} = '' OR {b} = '' OR {d.within(colour_parts(a, d), colour_parts(b, d))} OR {d.within(colour_parts(b, d), colour_parts(a, d))})"


def genre_age(title, feed_sex="NULL", feed_age="NULL", d=SPARK):
    """Sex of the title before that of the feed, U if neither says; E where either says child, else the feed's age or A."""
    t = norm_text(title, d)
    sex = f"CASE WHEN {d.matches(t, f'\\b({FEMALE})\\b')} THEN 'F' WHEN {d.matches(t, f'\\b({MALE})\\b')} THEN 'H' END"
    feed, age = (lookup(norm_text(f"CAST({x} AS {'STRING' if d.spark else 'VARCHAR'})", d), by_word(t)) for x, t in ((feed_sex, FEED_SEX), (feed_age, FEED_AGE)))
    return f"concat(coalesce({sex}, {feed}, 'U'), '-', CASE WHEN {d.matches(t, f'\\b({CHILD})\\b')} THEN 'E' ELSE coalesce({age}, 'A') END)"


def model_year(x, d=SPARK):
    return f"CAST(nullif({d.extract(x, '\\b(20(1[89]|2[0-9]))\\b', 1)}, '') AS INT)"


def is_pack(x, d=SPARK):
    """A bundle of several articles (a kit or a set is one article), or a gift with a device."""
    t = norm_text(x, d)
    return f"({d.matches(t, PACK)} OR ({d.matches(t, '\\boffert\\b')} AND {d.matches(t, GIFT_DEVICE)}))"


def valid_gtin(x, d=SPARK):
    """8, 12, 13 or 14 digits, not all zero, with a right GS1 check digit."""
    full = f"lpad({x}, 14, '0')"
    total = " + ".join(f"{3 if k % 2 else 1} * CAST(substring({full}, {k}, 1) AS INT)" for k in range(1, 15))
    digits = d.matches(x, "^([0-9]{8}|[0-9]{12,14})$")
    return f"coalesce(CASE WHEN {digits} AND NOT {d.matches(x, '^0+$')} THEN ({total}) % 10 = 0 ELSE FALSE END, FALSE)"


def comparable_gtin(x, d=SPARK):
    return f"CASE WHEN {valid_gtin(x, d)} THEN ltrim({x}, '0') END" if not d.spark else f"CASE WHEN {valid_gtin(x, d)} THEN trim(LEADING '0' FROM {x}) END"


_LETTERS = "XXS|XS|S|M|L|XL|XXL|XXXL|2XL|3XL|4XL"


def _numbers(low: int, high: int) -> str:
    return "|".join(map(str, range(low, high + 1)))


# What a size may look like once it is in capitals without marks, in order, and its code; {} is the shape's group.
_FIT_LETTERS = "XXS|XS|S|M|L|XL|XXL|[2-6]XL"
_CUT_WORDS = "SHORT|LONG|COURT|REGULAR|STANDARD|KING"
HEAD_CM, SHOE_EU = (53, 65), (35, 52)
SIZE_SHAPES = (
    ("(XXS|XS|S|M|L|XL|[2-6]XL|TU)", "{}"),
    ("TAILLE([0-9]{1,2})", "{}"),
    ("((?:XXS|XS|S|M|L|XL|[2-4]XL)[0-9]{4})CM", "{}"),
    (f"({_numbers(*HEAD_CM)})", "{}CM"),
    (f"({_numbers(*SHOE_EU)})", "EU{}"),
    (f"({'|'.join(w.upper() for w in sorted(COLOURS | LATE_COLOURS))})", ""),
    (f"(?:{_CUT_WORDS})({_FIT_LETTERS})", "{}"),
    (f"({_FIT_LETTERS})(?:{_CUT_WORDS})", "{}"),
)
SIZE_NAMES = {"XXL": "2XL", "XXXL": "3XL", "XXXXL": "4XL", "XXXXXL": "5XL", "XXXXXXL": "6XL", "TAILLEUNIQUE": "TU", "ONESIZE": "TU", "UNI": "TU"}
#: The greatest age, the years that a range of ages may span, and the characters kept of what has no shape.
AGE_MOST, AGE_SPAN, SIZE_CHARS = 16, 2, 24
#: What stands at a reference's end for its size, in order, and what of it stays.
SKU_TAILS = ((f"[-_ ](?:{_LETTERS}|TU|{_numbers(34, 65)})", ""), (f"([0-9])(?:{_LETTERS})", "\\1"))


def base_sku(x, d=SPARK):
    """The reference without the first kind of tail that it has; kept whole if that is all."""
    whole = f"trim(coalesce({x}, ''))"
    cut = f"CASE {' '.join(f"WHEN {d.matches(whole, f'(?i){tail}$')} THEN {d.gsub(whole, f'(?i){tail}$', rest)}" for tail, rest in SKU_TAILS)} ELSE {whole} END"
    return f"coalesce(nullif({cut}, ''), {whole})"


def _size_sources(raw, title, link, mpn, d):
    piece = d.matches(f"trim({mpn})", r"^[A-Za-z]{2,4}([.][A-Za-z0-9]+){2,}(/[0-9]+)?/[A-Za-z]{1,3}$")
    yield "feed", f"nullif(trim({raw}), '')"
    yield "url", f"nullif({d.extract(link, '(?i)taille[-/ ]([a-z0-9]{1,4})', 1)}, '')"
    yield "title", f"nullif({d.extract(title, '(?i)-[ ]+([a-z0-9]{1,4}) *$', 1)}, '')"
    yield "mpn", f"CASE WHEN NOT {piece} THEN nullif({d.extract(mpn, '(?i)[-_ /0-9](xxs|xs|s|m|l|xl|xxl|xxxl|2xl|3xl|4xl|tu|t[0-9]{1,2})$', 1)}, '') END"


def size_candidate(raw, title="NULL", link="NULL", mpn="NULL", d=SPARK):
    """(text, source): the first of feed, link, title and manufacturer's reference that holds a size's text."""
    kind = "STRING" if d.spark else "VARCHAR"
    found = list(_size_sources(*(f"CAST({x} AS {kind})" for x in (raw, title, link, mpn)), d))
    return f"coalesce({', '.join(x for _, x in found)}, '')", f"CASE {' '.join(f"WHEN {x} IS NOT NULL THEN '{name}'" for name, x in found)} ELSE '' END"


def _age_range(cand, d):
    """(condition, code) of two ages a short span apart."""
    both = "^ *([0-9]{1,2}) *[/-] *([0-9]{1,2}) *(?:[aA][nN][sS]?)? *$"
    first, last = (f"TRY_CAST({d.extract(cand, both, k)} AS INT)" for k in (1, 2))
    return f"{first} >= 1 AND {first} < {last} AND {last} <= {AGE_MOST} AND {last} - {first} <= {AGE_SPAN}", f"concat({d.string(first)}, '-', {d.string(last)}, 'ANS')"


def _decimal_size(cand, d):
    """(condition, code) of a size with a decimal: with its unit, or as a shoe's where it can be one."""
    shape = "(?i)^ *(?:taille *)?([0-9]{1,2}) *[.,] *([0-9]) *(eu|us|uk|mm)? *$"
    whole, part, unit = (d.extract(cand, shape, k) for k in (1, 2, 3))
    number = f"TRY_CAST({whole} AS INT)"
    code = f"concat({d.string(number)}, ',', {part})"
    return f"{whole} <> ''", f"CASE WHEN {unit} <> '' THEN concat({code}, upper({unit})) WHEN {number} BETWEEN {SHOE_EU[0]} AND {SHOE_EU[1]} THEN concat('EU', {code}) ELSE {code} END"


def size_code(cand, source="'feed'", d=SPARK):
    """A candidate's code: of two ages, of a decimal, or by the first of SIZE_SHAPES; what has none is kept, but for words
    without a digit out of a title. Empty where there is no size."""
    bare = f"upper({d.gsub(cand, '[^A-Za-z0-9]')})"
    named = f"coalesce({lookup(bare, SIZE_NAMES)}, {bare})"
    shapes = []
    for shape, code in SIZE_SHAPES:
        before, _, after = code.partition("{}")
        shapes.append((d.matches("nm", f"^{shape}$"), f"concat('{before}', {d.extract('nm', f'^{shape}$', 1)}, '{after}')" if "{}" in code else f"'{code}'"))
    shapes.append((f"{source} = 'title' AND NOT {d.matches('nm', '[0-9]')}", "''"))
    cases = lambda rules: " ".join(f"WHEN {when} THEN {code}" for when, code in rules)
    shaped = d.bound(named, "nm", f"CASE {cases(shapes)} ELSE substring(nm, 1, {SIZE_CHARS}) END")
    return f"CASE {cases([_age_range(cand, d), _decimal_size(cand, d)])} ELSE {shaped} END"


def canonical_size(x, d=SPARK):
    return d.gsub(d.gsub(f"upper({x})", "^(XXS|XS|S|M|L|XL|[2-9]XL)[0-9]+$", "\\1"), "^T([0-9]+)$", "\\1")


def size_sort_key(x, d=SPARK):
    letters = " ".join(f"WHEN '{s}' THEN {n}" for n, s in enumerate(LETTER_SIZES))
    return f"coalesce(CASE {x} {letters} END, 100 + {d.try_double(d.extract(x, '([0-9]+)', 1))}, 1000)"


def money(x, d=SPARK):
    """Cents of a price text: the last separator followed by one or two digits is the decimal mark; null for zero or no price."""
    t = d.extract(x, "([0-9][0-9.,  ]*)", 1)
    whole = d.gsub(d.gsub(t, "[.,][0-9]{1,2} *$"), "[^0-9]")
    part = d.extract(t, "[.,]([0-9]{1,2}) *$", 1)
    cents = f"TRY_CAST(concat({whole}, rpad({part}, 2, '0')) AS BIGINT)"
    return f"nullif({cents}, 0)"


def in_stock(x, d=SPARK):
    t = f"lower(trim({d.folded(x)}))"
    return f"CASE WHEN {t} IN ({', '.join(map(repr, STOCK_YES))}) THEN TRUE WHEN {t} IN ({', '.join(map(repr, STOCK_NO))}) THEN FALSE END"


def sale_is_live(window, day, d=SPARK):
    """An ISO window start/end with open ends; what cannot be read counts as live."""
    a, b = d.try_date(f"substring({d.item(d.split(window, '/'), 1)}, 1, 10)"), d.try_date(f"substring({d.item(d.split(window, '/'), 2)}, 1, 10)")
    return f"(coalesce({a} <= {day}, TRUE) AND coalesce({b} >= {day}, TRUE))"


def effective_price(list_cents, sale_cents, live, sentinel=999900):
    clean = f"nullif({list_cents}, {sentinel})"
    return f"CASE WHEN {live} AND {sale_cents} IS NOT NULL AND ({clean} IS NULL OR {sale_cents} < {clean}) THEN {sale_cents} ELSE {clean} END"


def query_parameter(url, name, d=SPARK):
    return f"nullif({d.extract(url, f'[?&]{name}=([^&#]*)', 1)}, '')"


def bare_url(url, d=SPARK):
    """Scheme, query and fragment off, host in lower case, no slash at the end."""
    t = d.gsub(d.gsub(url, "^[A-Za-z]+://"), "[?#].*$")
    return d.gsub(f"concat(lower({d.extract(t, '^([^/]*)', 1)}), {d.extract(t, '^[^/]*(.*)$', 1)})", "/+$")


def merchant_key(sku, url, d=SPARK):
    return f"coalesce(nullif(trim({sku}), ''), concat('u:', md5({bare_url(url, d)})))"


def category_path(*levels):
    return f"concat_ws(' > ', {', '.join(f"nullif(trim({x}), '')" for x in levels)})"


def identity_hash(brand, category, colour, year, genre, pack, ref, tokens, d=SPARK):
    parts = (f"coalesce({brand}, '')", f"coalesce({d.string(category)}, '')", f"coalesce({colour}, '')", f"coalesce({d.string(year)}, '')", f"coalesce({genre}, '')", f"CASE WHEN {pack} THEN '1' ELSE '0' END", f"concat(coalesce({ref}, ''), ':', {d.join(tokens, '-')})")
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def slug(x, identity, d=SPARK):
    body = d.gsub(f"substring({d.gsub(f'lower({d.folded(x)})', '[^a-z0-9]+', '-')}, 1, 80)", "^-+|-+$")
    return f"concat({body}, '-', substring({identity}, 1, 8))"


def discount_level(percent):
    return f"CASE WHEN {percent} > 35 THEN 'red' WHEN {percent} >= 20 THEN 'orange' ELSE 'sober' END"


def category_tolerant(a, b):
    """Equal, unknown (25), or the parent 1 with one of its children 2 to 5."""
    return f"({a} = {b} OR {a} = 25 OR {b} = 25 OR ({a} = 1 AND {b} BETWEEN 2 AND 5) OR ({b} = 1 AND {a} BETWEEN 2 AND 5))"


def adjacent_gtins(a, b):
    return f"(substring({a}, 1, 9) = substring({b}, 1, 9) AND abs(CAST(substring({a}, 1, 12) AS BIGINT) - CAST(substring({b}, 1, 12) AS BIGINT)) <= 20)"


def masked(x, d=SPARK):
    return d.gsub(d.gsub(x, "(key|token|password|secret)=[^&\\s]+", "\\1=***"), "://[^/@\\s]+@", "://***@")


def title_without_size(x, d=SPARK):
    return f"trim({d.gsub(f'lower({x})', '[ ,-]+(taille )?(xxs|xs|s|m|l|xl|xxl|[2-4]xl|[0-9]{1,2})$')})"


def trigrams(x, d=SPARK):
    """Distinct three-letter pieces of a padded word."""
    padded = f"concat('  ', {x}, ' ')"
    return d.distinct(d.map(d.sequence("1", f"CAST({d.chars(padded)} - 2 AS INT)"), "i", f"substring({padded}, CAST(i AS INT), 3)"))


def trigram_similarity(a, b, d=SPARK):
    x, y = trigrams(a, d), trigrams(b, d)
    return f"({d.size(d.intersect(x, y))} / CAST({d.size(d.union(x, y))} AS DOUBLE))"


def strict_word_similarity(typed, text, d=SPARK):
    """The best trigram similarity of a typed word with a run of whole words of a text (its normal form): 0 to 1."""
    words = d.split(text, " ")
    n = f"CAST({d.size('ws')} AS INT)"
    run = "slice(ws, i, j - i + 1)" if d.spark else "list_slice(ws, i, j)"
    of_run = d.distinct(f"flatten({d.map(run, 'v', trigrams('v', d))})")
    both, whole = d.size(d.intersect("tq", of_run)), d.size(d.union("tq", of_run))
    best = d.map(d.sequence("1", n), "i", d.map(d.sequence("i", n), "j", f"{both} / CAST({whole} AS DOUBLE)"))
    top = f"{'array_max' if d.spark else 'list_max'}(flatten({best}))"
    # the words and the typed word's trigrams are bound once, as single elements of an array
    bound = d.map(d.array(words), "ws", d.item(d.map(d.array(trigrams(typed, d)), "tq", top), 1))
    return f"coalesce({d.item(bound, 1)}, 0.0)"


def near_word(a, b, d=SPARK):
    """Damerau-Levenshtein distance of one at most: one edit, or two neighbours swapped."""
    swapped = f"exists(sequence(1, char_length({a}) - 1), i -> concat(substring({a}, 1, i - 1), substring({a}, i + 1, 1), substring({a}, i, 1), substring({a}, i + 2)) = {b})"
    if not d.spark:
        swapped = f"len(list_filter(range(1, length({a})), lambda i: concat(substring({a}, 1, i - 1), substring({a}, i + 1, 1), substring({a}, i, 1), substring({a}, i + 2)) = {b})) > 0"
    return f"({d.edit(a, b)} <= 1 OR (length({a}) = length({b}) AND length({a}) >= 2 AND {swapped}))"


def french_price(cents, d=SPARK):
    """1 234,56 €."""
    euros = f"CAST(floor({cents} / 100) AS BIGINT)"
    text = d.string(euros)
    grouped = f"CASE WHEN {euros} >= 1000 THEN concat(substring({text}, 1, CAST(length({text}) AS INT) - 3), ' ', substring({text}, CAST(length({text}) AS INT) - 2, 3)) ELSE {text} END"
    return f"concat({grouped}, ',', lpad({d.string(f'CAST({cents} % 100 AS BIGINT)')}, 2, '0'), ' €')"
