"""Text functions against values taken from their rules, in both dialects."""

import duckdb
import pytest

from offerloom.functions import text as t
from offerloom.plans.dialect import OracleDialect, SparkDialect

ALIASES = {"alpinestars": "alpinestars", "astars": "alpinestars", "shoei": "shoei", "gprexhaust": "gpr"}

CASES = {
    "norm": (t.norm_text, [("Casque intégral Shoei GT-Air II", "casque integral shoei gt air 2"), ("Blousón III", "blouson 3"), ("cœur ﬁn ½ été straße", "cur fin 12 ete strae"), ("été VIII", "ete viii"), ("Ｆｕｌｌ №1", "full no1"), (None, ""), ("", "")]),
    "brand": (lambda x, d: t.brand_code(x, ALIASES, d), [("ALPINESTARS", "alpinestars"), ("A-Stars", "alpinestars"), ("GPR Exhaust", "gpr"), ("Obscure Brand & Co", "obscurebrandco")]),
    "known": (lambda x, d: t.brand_known(x, ALIASES, d), [("A-Stars", True), ("Obscure", False)]),
    "colour": (t.colour_code, [("noir mat", "BK|MAT"), ("Noir Brillant", "BK|GLO"), ("rouge / blanc / noir", "BK-RD-WH"), ("noir blanche", "BK"), ("Bulle noire", "BK"), ("verte bleue", "BL-GN"), ("marron", "BR"), ("argenté", "SI"), ("mat", ""), ("taille unique", ""), ("", "")]),
    "first": (t.first_colour, [("rouge noir", "RD"), ("noire", "BK"), ("rien", "")]),
    "pack": (t.is_pack, [("pack casque gants", True), ("lot de 2 disques de frein", True), ("casque shoei intercom sena offert", True), ("kit chaine ek 520", False), ("set de joints", False), ("lot disques", False)]),
    "sku": (t.base_sku, [("168075199XS", "168075199"), ("168075199-M", "168075199"), ("ABC123", "ABC123"), ("AB-12", "AB-12"), ("A08-12D1-A02-07", "A08-12D1-A02-07"), ("BRACKET-44", "BRACKET"), ("-XL", "-XL"), (None, "")]),
}
SIZES = [
    (("XL", None, None, None), ("XL", "feed")), (("", None, "https://x/produit?taille-m", None), ("M", "url")), (("", "Bottes noir - 44", None, None), ("EU44", "title")), (("", "BNS TECH-2", None, None), ("", "")),
    (("", "Blouson - MESH", None, None), ("", "")), (("", "Couronne JT - 520", None, None), ("520", "title")), (("", None, None, None), ("", "")), (("", None, None, "BRAKECONTROL"), ("", "")), (("", None, None, "168075199-XL"), ("XL", "mpn")),
    (("", None, None, "168075199XL"), ("XL", "mpn")), (("", None, None, "LEH.07.039.12200/S"), ("", "")), (("", None, None, "LEH.07.039.118/30/S"), ("", "")), (("", None, None, "3301520/S"), ("S", "mpn")), (("", None, None, "20190067-NO-T6"), ("T6", "mpn")),
    (("4/5", None, None, None), ("4-5ANS", "feed")), (("10/11 ans", None, None, None), ("10-11ANS", "feed")), (("34/32", None, None, None), ("3432", "feed")), (("XXXXXXL", None, None, None), ("6XL", "feed")), (("Taille 9,5", None, None, None), ("9,5", "feed")),
    (("44,5", None, None, None), ("EU44,5", "feed")), (("9.5 US", None, None, None), ("9,5US", "feed")), (("Taille 8", None, None, None), ("8", "feed")), (("S (55/56 cm)", None, None, None), ("S5556", "feed")), (("57", None, None, None), ("57CM", "feed")),
    (("Noir", None, None, None), ("", "")), (("Short XL", None, None, None), ("XL", "feed")), (("M court", None, None, None), ("M", "feed")), (("one size", None, None, None), ("TU", "feed")), (("---", None, None, None), ("", "")),
]
PEOPLE = [(("blouson femme stella", None, None), "F-A"), (("bottes enfant gaerne", None, None), "U-E"), (("blouson", "male", None), "H-A"), (("veste", "female", "adult"), "F-A"), (("gants enfant", None, "adult"), "U-E"), (("gants", None, "youth"), "U-E"), (("blouson femme", "male", None), "F-A"), (("casque", "bg_BG:Унисекс", None), "U-A")]


def quoted(x):
    return "CAST(NULL AS VARCHAR(99))" if x is None else "'" + x + "'"


def answers(spark, expressions):
    """Values of SQL expressions by Spark; d decides which engine a text is for."""
    return lambda d: list(spark.sql(f"SELECT {', '.join(f'{e(d)} AS c{k}' for k, e in enumerate(expressions))}").first()) if d.spark else list(duckdb.sql(f"SELECT {', '.join(f'{e(d)} AS c{k}' for k, e in enumerate(expressions))}").fetchall()[0])


@pytest.mark.parametrize("d", [SparkDialect(), OracleDialect()], ids=["spark", "oracle"])
@pytest.mark.parametrize("name", CASES)
def test_function(spark, name, d):
    f, cases = CASES[name]
    assert answers(spark, [lambda d, x=x: f(quoted(x), d) for x, _ in cases])(d) == [want for _, want in cases]


@pytest.mark.parametrize("d", [SparkDialect(), OracleDialect()], ids=["spark", "oracle"])
def test_sizes(spark, d):
    found = []
    for given, _ in SIZES:
        cand, source = t.size_candidate(*map(quoted, given), d)
        found.append(tuple(answers(spark, [lambda d, c=cand, s=source: t.size_code(c, s, d), lambda d, c=cand, s=source: f"CASE WHEN {t.size_code(c, s, d)} <> '' THEN {s} ELSE '' END"])(d)))
    assert found == [want for _, want in SIZES]


@pytest.mark.parametrize("d", [SparkDialect(), OracleDialect()], ids=["spark", "oracle"])
def test_people(spark, d):
    assert answers(spark, [lambda d, g=g: t.genre_age(*map(quoted, g), d) for g, _ in PEOPLE])(d) == [want for _, want in PEOPLE]


@pytest.mark.parametrize("d", [SparkDialect(), OracleDialect()], ids=["spark", "oracle"])
def test_strict_word_similarity(spark, d):
    """By the definition: shared three-letter pieces over all pieces of the typed word and the best run of whole words."""
    cases = [("widget", "red widget", 1.0), ("widge", "a widget b", 5 / 8), ("ara", "ostara vest", 2 / 9), ("blanky", "ixon blanky", 1.0), ("x", "", 0.0)]
    got = answers(spark, [lambda d, q=q, x=x: t.strict_word_similarity(f"'{q}'", f"'{x}'", d) for q, x, _ in cases])(d)
    assert [round(float(g), 6) for g in got] == [round(w, 6) for _, _, w in cases]
