"""The code finder and the grammar around a code, on literal texts."""

import datetime

import pytest
from pyspark.sql import functions as F

from offerloom.operators import promo

FOUND = {
    # the seven ways to introduce a code
    "Cette semaine : CODE ROUE15 - ACTIF sur les pneus": {"ROUE15": 50},
    "On paie sans taxe avec le code TVA aujourd'hui": {"TVA": 45},
    "Moins cher avec le code : ROULE20 partout": {"ROULE20": 40},
    "Moins cher avec le code promo ROULE20 partout": {"ROULE20": 40},
    "Notre code promo : PNEUS12 du moment": {"PNEUS12": 30},
    "Le bon code : PNEUS13": {"PNEUS13": 25},
    "Au panier, saisissez le code PNEUS14.": {"PNEUS14": 25},
    "CODE PNEUS15": {"PNEUS15": 10},
    "CODE 30YRS Code copié": {"30YRS": 10},
    # no codes
    "Donnez votre CODE POSTAL ici": {}, "CODE PROMO CADEAUX": {}, "code promo promotionnel du mois": {}, "CODE ROUES": {}, "CODE PNEU": {}, "CODE 2026": {}, "code PNEUS15": {}, "LE CODE-BARRES": {}, "CODE, PNEUS15": {}, "CODE ABC": {},
    # vetoes
    "CODE PNEUS15 désormais inactif": {}, "CODE PNEUS15 GANTS ET CASQUES": {}, "avec le code PNEUS15 GANTS ET CASQUES": {"PNEUS15": 40},
    "Offre terminée. Moins cher avec le code PNEUS15": {}, "Moins cher avec le code PNEUS15 " + "mot " * 100 + "offre  terminée": {}, "Moins cher avec le code PNEUS15 " + "mot " * 180 + "offre terminée": {"PNEUS15": 40},
    "Inscription : gagnez avec le code PNEUS15": {}, "Pour votre PREMIÈRE COMMANDE avec le code PNEUS15": {}, "Newsletter " + "mot " * 30 + "avec le code PNEUS15": {"PNEUS15": 40},
    # a title before a sure code; the best reading of a code
    "Code Promo CITROUILLE puis rabais avec le code TVA": {"TVA": 45}, "Code Promo CITROUILLE " + "mot " * 110 + "avec le code TVA": {"CITROUILLE": 30, "TVA": 45}, "avec le code TVA puis Code Promo CITROUILLE": {"CITROUILLE": 30, "TVA": 45},
    "CODE PNEUS15 en haut ; en bas avec le code PNEUS15": {"PNEUS15": 40},
    "sans rien": {}, "": {}, "code": {}, "CODE PROMO": {}, "\U0001f600 é CODE PNEUS15": {"PNEUS15": 10},
}


def test_codes_of_texts(spark):
    texts = list(FOUND)
    pages = spark.createDataFrame([*enumerate(texts), (-1, None)], "page long, body string").withColumn("at", F.lit("clash")).withColumn("score", F.lit(1))
    got = {}
    for r in promo.find_codes(pages, "page", "body").collect():
        assert r.context[r.place :].startswith(r.code) and texts[r.page][r["at"] :].startswith(r.code)
        got.setdefault(texts[r.page], {})[r.code] = r.score
    assert {t: got.get(t, {}) for t in texts} == FOUND
    assert promo.find_codes(pages.limit(0), "page", "body").count() == 0


def test_each_code_has_its_own_validity_discount_and_conditions(spark):
    day = datetime.date
    text = "Pneus -12 % avec le code PNEUS12 du mardi 2 au 9 mars, du 2 mars au samedi 13 mars, hors promotions. " + "mot " * 60 + "Dès 79,5 € d'achat 10 € offerts, jusqu'au : 2026-03-18 23:59 avec le code GANTS10, non cumulable"
    found = promo.described(promo.find_codes(spark.createDataFrame([(1, text)], "page long, body string"), "page", "body"), F.lit("2026-03-01").cast("date"))
    assert {r.code: (r.starts, r.ends, r.discount, r.conditions) for r in found.collect()} == {
        "PNEUS12": (day(2026, 3, 2), day(2026, 3, 13), "-12 % avec le code PNEUS12", "dès 79,5 € d'achat · hors promotions · non cumulable"),
        "GANTS10": (None, day(2026, 3, 18), "10 € de remise avec le code GANTS10", "dès 79,5 € d'achat · non cumulable"),
    }
    codes = spark.createDataFrame([("FETE25", None), ("FETE25", day(2026, 11, 9)), ("FETE26", None), ("TOP20", None)], "code string, ends date")
    assert [r[0] for r in codes.select(promo.last_years(F.col("code"), F.col("ends"), F.lit("2026-10-27").cast("date"))).collect()] == [True, False, False, False]


@pytest.mark.parametrize("text, want", [
    ("du 30/01/26 au 2.2.2026", ((2026, 1, 30), (2026, 2, 2))), ("du lundi 20 décembre au 5 janvier", ((2026, 12, 20), (2027, 1, 5))), ("du 1er févr. 2027 jusque tard et au 3 mars", ((2027, 2, 1), (2027, 3, 3))),
    ("du 3 mars " + "x" * 50 + " au 4 mars", (None, None)), ("jusqu’au dimanche 8 mars inclus", (None, (2026, 3, 8))), ("jusqu'au 3 janvier", (None, None)), ("jusqu'au 31/09/2026", (None, None)), ("jusqu'au 12 brumaire", (None, None)), ("du 12 au 13", (None, None)), ("", (None, None)),
])
def test_validity_statements(text, want):
    got = promo.window_at(text, 0, datetime.date(2026, 2, 15))
    assert got == tuple(x and datetime.date(*x) for x in want)


@pytest.mark.parametrize("text, want", [
    ("15 % de réduction CODE1", "-15 % avec le code CODE1"), ("16.67% Rabatt CODE1", "-16,67 % avec le code CODE1"), ("- 5 % du CODE1 -9 %", "-9 % avec le code CODE1"), ("coton 80 % CODE1", "Code promo CODE1"), ("100 EUR de remise CODE1", "100 € de remise avec le code CODE1"),
    ("129,00 € CODE1", "Code promo CODE1"), ("-30 % " + "x " * 90 + "CODE1", "Code promo CODE1"), ("-30 % sans lui", "-30 % avec le code CODE1"),
])
def test_discounts(text, want):
    assert promo.nearest_discount(text, "CODE1") == want


@pytest.mark.parametrize("text, want", [
    ("à partir de 50 EUR", "dès 50 € d'achat"), ("minimum d'achat de 30 €", "dès 30 € d'achat"), ("commande minimum 99.90€", "dès 99,90 € d'achat"), ("Hors articles déjà remisés", "hors articles déjà remisés"), ("hors taxe", ""), ("non-cumulable", ""), ("profitez", ""), ("", ""),
])
def test_conditions(text, want):
    assert promo.conditions_of(text) == want
