"""Promotional codes in page text: where they stand, how sure they are, how long they hold, what they give and ask.

`readings` is a table function: it gives every place where a code may stand, with its offset and a score for the words
that lead to it. All that follows is columns and windows over those rows: the text around each, the vetoes, the best
reading of each code, and titles beside a sure code. What stands near a code is read from tokens (numbers, words, marks)
by a small grammar: dates and what joins them, amounts and what they are of.
"""

from __future__ import annotations

import datetime
import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scores of the ways to introduce a code; words, stems and limits of the rules.
ACTIVE, WITH_SHORT, WITH, NAMED, COLON, ASKED, BARE = 50, 45, 40, 30, 25, 25, 10
ASKING = ("saisis", "saisissez", "utilise", "utilisez", "entrez", "renseignez")
#: Words that shops write in capitals beside "code".
NOT_CODES = tuple(
    "PROMO PROMOS PROMOTION PROMOTIONS PROMOTIONNEL PROMOTIONNELS CODES CODE REDUC REDUCTION REDUCTIONS REMISE REMISES ACTIF ACTIVE INACTIF VALABLE CLIENT CLIENTS POSTAL POSTALE CADEAU CADEAUX "
    "ACHAT ACHATS PANIER COMMANDE LIVRAISON GRATUIT GRATUITE OFFERT OFFERTS OFFRE OFFRES SOLDES DESTOCKAGE MOTO MOTOS CASQUE CASQUES BLOUSON GANTS BOTTES EQUIPEMENT EQUIPEMENTS MERCI AVEC SANS TOUT TOUTE TOUTES "
    "TOUS VOTRE NOTRE DANS POUR LORS ETRE BIEN PLUS SEUL SEULE FOIS JOUR JOURS SEMAINE MOIS ANNEE SAISON MAGASIN MAGASINS SERVICE CONTACT NEWSLETTER SUIVANT SUIVANTS SUIVANTE DETAIL DETAILS CONDITION CONDITIONS "
    "UTILISATION BARRE BARRES TVA CGV FRAIS TOTAL PRIX EUROS PARTIR CUMULABLE MARQUE MARQUES SELECTION".split()
)
#: Codes for an account or a first order are no offers to compare.
PERSONAL = ("newsletter", "inscription", "inscris", "inscrivant", "parrain", "bienvenue", "première commande", "premiere commande")
#: Characters before and after the code's start: its context, and what is near.
CONTEXT, NEAR = (260, 640), (90, 170)
#: Characters after a code's start in which the page may take it back, and before a sure code in which a weak one is its title.
TAKEN_BACK, TITLE = 40, 400
MONTHS = {"janvier": 1, "janv": 1, "fevrier": 2, "fevr": 2, "fev": 2, "mars": 3, "avril": 4, "avr": 4, "mai": 5, "juin": 6, "juillet": 7, "juil": 7, "aout": 8, "septembre": 9, "sept": 9, "octobre": 10, "oct": 10, "novembre": 11, "nov": 11, "decembre": 12, "dec": 12}
WEEKDAYS = ("lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche")
#: Days ahead up to which a year that nobody wrote is believed.
HORIZON = 210
#: Characters between the two ends of a range.
RANGE_GAP = 40
#: Characters before and after a code in which its discount may stand.
DISCOUNT = (80, 120)


def page_text(html: Column) -> Column:
    """Visible text: scripts, styles and tags off, entities of spaces and ampersands resolved, white space collapsed."""
    plain = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</\1>", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"<[^>]*>", " "), r"&nbsp;|&#160;", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"&amp;", "&"), r"\s+", " "))


@functools.lru_cache(1 << 16)
def fold(word: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


_WORDS = re.compile(r"\w+")
_CODE = re.compile(r"\bcode\b", re.I)


class Reading(NamedTuple):
    code: str
    score: int
    at: int
    #: The next word, where only white space lies between.
    then: str


def readings_of(text: str) -> Iterator[Reading]:
    """Each place where a word follows "code", scored by what leads to it; the word is in capitals and figures."""
    for found in _CODE.finditer(text):
        before = [m for m in _WORDS.finditer(text, max(0, found.start() - NEAR[0]), found.start())][-2:]
        words = [*before, found, *itertools.islice(_WORDS.finditer(text, found.end()), 3)]
        k = len(before)

        def gap(j: int) -> str:
            """What stands between the words j - 1 and j, white space as one space."""
            return " ".join(text[words[j - 1].end() : words[j].start()].split()) if 0 < j < len(words) else "|"

        named = k + 1 < len(words) and fold(words[k + 1][0]) == "promo" and gap(k + 1) == ""
        at = k + 1 + named
        if at >= len(words) or gap(at) not in ("", ":"):
            continue
        code, colon = words[at][0], gap(at) == ":"
        if not re.fullmatch("[A-Z0-9]{3,20}", code):
            continue
        led = fold(before[0][0]) if len(before) == 2 and gap(2) == "" == gap(1) and fold(before[1][0]) == "le" else ""
        following = words[at + 1][0] if at + 1 < len(words) else ""
        ways = [
            (ACTIVE, not named and not colon and fold(following) == "actif" and gap(at + 1) in ("", "-", "–", "—")),
            (WITH_SHORT, led == "avec" and not named and len(code) == 3 and code.isalpha()),
            (WITH, led == "avec"), (NAMED, named), (COLON, colon and not named), (ASKED, led in ASKING and not named), (BARE, found[0] == "CODE" and not colon and not named),
        ]
        fitting = [score for score, fits in ways if fits and (len(code) > 3 or score == WITH_SHORT)]
        if fitting:
            yield Reading(code, max(fitting), words[at].start(), following if gap(at + 1) == "" else "")


def readings(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code, score, at, then, context, near, after): a row for each reading, by a function over Arrow batches.

    at counts code points from 0; context and near are what stands around the code, after what begins with it. So a page's
    text goes no further than this function, and no row of it has to meet its page again."""
    kind = pages.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, *r, *(page[max(0, r.at - before) : r.at + after] for before, after in (CONTEXT, NEAR, (0, TAKEN_BACK)))) for n, page in enumerate(batch.column(1).to_pylist()) if page for r in readings_of(page)]
            row, code, score, at, then, *around = zip(*found) if found else [[]] * 8
            strings = [pa.array(x, pa.string()) for x in (then, *around)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(code, pa.string()), pa.array(score, pa.int32()), pa.array(at, pa.int32()), *strings], [key, "code", "score", "at", "then", "context", "near", "after"])

    return pages.select(key, text).mapInArrow(read, f"`{key}` {kind}, code string, score int, at int, then string, context string, near string, after string")


def find_codes(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code, score, at, context, place): the best reading of each code of a page; place is where the code stands in its context.

    Readings fall that are ordinary words, figures alone, or short words without a figure (not where "avec le code" makes
    them sure); that the page takes back, ends, or keeps for a newsletter or a first order; weak ones in front of further
    capitals, which are headings; and weak ones shortly before a sure code, which are its title."""
    rows = readings(pages, key, text).withColumn("place", F.least("at", F.lit(CONTEXT[0])))
    word = F.col("code").isin(*NOT_CODES) | ((F.length("code") < 6) & ~F.col("code").rlike("[0-9]"))
    vetoes = ((F.col("score") < WITH_SHORT) & word) | F.col("code").rlike("^[0-9]+$") | F.contains(F.upper("after"), F.lit("INACTIF"))
    vetoes = vetoes | ((F.col("score") < WITH) & F.col("then").rlike(r"^\p{Lu}{2}")) | F.col("context").rlike(r"(?i)offre\s+termin") | F.lower("near").rlike("|".join(PERSONAL))
    best = rows.where(~vetoes).groupBy(key, "code").agg(F.max_by(F.struct("score", "at", "context", "place"), F.struct("score", -F.col("at"))).alias("r")).select(key, "code", "r.*")
    sure = f"min(if(score >= {WITH_SHORT}, at, null)) over (partition by `{key}` order by at range between 1 following and {TITLE - 1} following)"
    return best.withColumn("sure", F.expr(sure)).where(f"score > {NAMED} or sure is null").drop("sure")


def codes(pages: DataFrame, key: str, text: str) -> DataFrame:
    return find_codes(pages, key, text).select(key, "code", "score")


class Token(NamedTuple):
    start: int
    end: int
    text: str

    @property
    def number(self) -> bool:
        return self.text[0].isdigit()


_TOKENS = re.compile(r"[0-9]+|[^\W\d_]+|\S")


def tokens(text: str, start: int = 0, end: int | None = None) -> list[Token]:
    """Numbers, folded words and marks of a part of a text, with their places in the whole."""
    return [Token(m.start(), m.end(), fold(m[0]) or m[0]) for m in _TOKENS.finditer(text, start, len(text) if end is None else end)]


class Date(NamedTuple):
    day: int
    month: int
    year: int | None

    def within(self, year: int) -> datetime.date | None:
        try:
            return datetime.date(self.year or year, self.month, self.day)
        except ValueError:  # a 31st of a short month
            return None


class Cursor:
    """Reads phrases of tokens from one place on; a reader that does not fit leaves the place as it was."""

    def __init__(self, of: list[Token], at: int = 0):
        self.of, self.at = of, at

    def peek(self, ahead: int = 0) -> str:
        return self.of[self.at + ahead].text if self.at + ahead < len(self.of) else ""

    def any(self, *words: str) -> bool:
        """Passes one of the words, if it stands here."""
        fits = self.peek() in words
        self.at += fits
        return fits

    def number(self, *digits: int) -> str:
        """Passes a number with one of the counts of digits."""
        text = self.peek()
        if not text.isdigit() or not text.isascii() or len(text) not in digits:
            return ""
        self.at += 1
        return text

    def decimal(self, *digits: int) -> str:
        """Passes a number with perhaps one or two decimals, nothing between; a comma parts them."""
        whole = self.number(*digits)
        if whole and self.at + 1 < len(self.of) and self.peek() in (".", ",") and self.peek(1).isdigit() and len(self.peek(1)) <= 2 and self.of[self.at - 1].end == self.of[self.at].start and self.of[self.at].end == self.of[self.at + 1].start:
            whole += f",{self.peek(1)}"
            self.at += 2
        return whole

    def date(self) -> Date | None:
        """Day, month and perhaps year, in figures either way round or with the month's name, a weekday before it passed over."""
        begin = self.at
        self.any(*WEEKDAYS)
        year = self.number(4)
        if year:
            parts = [self.number(1, 2) for mark in "--" if self.any(mark)]
            if len(parts) == 2 and all(parts):
                return Date(int(parts[1]), int(parts[0]), int(year))
        elif day := self.number(1, 2):
            if self.any("/", ".", "-"):
                month = self.number(1, 2)
                if month and self.any("/", ".", "-") and (year := self.number(2, 3, 4)):
                    return Date(int(day), int(month), int(year) + 2000 * (len(year) < 4))
            else:
                self.any("er")
                if month := MONTHS.get(self.peek()):
                    self.at += 1
                    self.any(".")
                    year = self.number(4)
                    return Date(int(day), month, int(year) if year else None)
        self.at = begin
        return None


def validities(of: list[Token], today: datetime.date) -> Iterator[tuple[int, int, tuple[datetime.date | None, datetime.date | None]]]:
    """(where it begins, 0 for a range and 1 for an end alone, (start, end)) of each statement of a validity.

    A year that nobody wrote is that of the range's start, or today's; a range's end before its start is a year later,
    and so is a lone end that has passed, unless that lies beyond the horizon."""
    for k, token in enumerate(of):
        here = Cursor(of, k + 1)
        if token.text == "du" and (first := here.date()):
            stop = of[here.at - 1].end + RANGE_GAP
            for j in range(here.at, len(of)):
                if of[j].start > stop:
                    break
                there = Cursor(of, j + 1)
                if of[j].text == "au" and (last := there.date()):
                    start = first.within(today.year)
                    end = last.within(first.year or today.year)
                    if start and end and end < start and not last.year:
                        end = last.within(end.year + 1)
                    yield token.start, 0, (start, end)
                    break
        elif token.text.startswith("jusqu"):
            here.any("'", "’")
            if here.any("au"):
                here.any(":")
                if last := here.date():
                    end = last.within(today.year)
                    if end and not last.year and end < today:
                        later = last.within(today.year + 1)
                        end = later if later and (later - today).days <= HORIZON else None
                    yield token.start, 1, (None, end)


def window_at(text: str, at: int, today: datetime.date) -> tuple[datetime.date | None, datetime.date | None]:
    """Start and end of the validity that stands nearest to a place, on either side."""
    return _nearest(tokens(text, max(0, at - CONTEXT[0]), at + CONTEXT[1]), at, today)


def _nearest(of: list[Token], at: int, today: datetime.date) -> tuple[datetime.date | None, datetime.date | None]:
    found = [x for x in validities(of, today) if any(x[2])]
    return min(found, key=lambda x: (abs(x[0] - at), x[1]))[2] if found else (None, None)


def nearest_window(text: str | None, code: str, today: datetime.date) -> tuple[datetime.date | None, datetime.date | None]:
    """Start and end of the validity next to the code's first mention."""
    return window_at(text or "", max(0, (text or "").lower().find(code.lower())), today)


def discounts(of: list[Token]) -> Iterator[tuple[int, str]]:
    """(where it begins, what it says) of each discount: a percentage with a minus or with what it is of, or an amount given."""
    for k, token in enumerate(of):
        minus = token.text == "-"
        here = Cursor(of, k + minus)
        decimals = k > 1 and of[k - 1].text in (".", ",") and of[k - 2].number and of[k - 2].end == of[k - 1].start and of[k - 1].end == token.start
        if not minus and (not token.number or decimals):
            continue
        share = here.decimal(1, 2)
        if share and here.any("%"):
            if not minus:
                here.any("de")
            if minus or here.peek() in ("remise", "reduction", "rabatt", "off", "sur"):
                yield token.start, f"-{share} %"
        elif not minus:
            here = Cursor(of, k)
            if (amount := here.number(1, 2, 3)) and here.any("€", "eur"):
                if here.any("offert", "offerts") or here.any("de") and here.any("remise", "reduction"):
                    yield token.start, f"{amount} € de remise"


def nearest_discount(text: str, code: str) -> str:
    """The discount stated nearest to the code as a label; without one near it the code alone, as a figure from elsewhere may be another article's."""
    return _labelled(tokens(text), text.find(code), code)


def _labelled(of: list[Token], at: int, code: str) -> str:
    zone = of if at < 0 else [t for t in of if t.start >= at - DISCOUNT[0] and t.end <= at + len(code) + DISCOUNT[1]]
    found = [(abs(start - max(0, at)), said) for start, said in discounts(zone)]
    return f"{min(found)[1]} avec le code {code}" if found else f"Code promo {code}"


def conditions_of(text: str) -> str:
    """What decides whether a code is taken: the least order, what is left out, and whether it adds to others."""
    return _conditions(text, tokens(text))


def _conditions(text: str, of: list[Token]) -> str:
    least = without = alone = ""
    for k, token in enumerate(of):
        here = Cursor(of, k + 1)
        if token.text == "des" or token.text == "a" and here.any("partir") and here.any("de") or token.text == "minimum":
            if token.text == "minimum":
                if here.any("d") and here.any("'", "’"):
                    here.any("achat")
                here.any("de")
            if not least and (amount := here.decimal(*range(1, 8))) and here.any("€", "eur"):
                least = f"dès {amount} € d'achat"
        elif token.text == "hors" and not without:
            if here.any("soldes", "promo", "promos", "promotion", "promotions") or here.any("article", "articles") and here.any("deja") and here.any("remise", "remises"):
                without = text[token.start : of[here.at - 1].end].lower()
        elif token.text == "non" and here.any("cumulable"):
            alone = "non cumulable"
    return " · ".join(x for x in (least, without, alone) if x)


def validity(text: Column, code: Column, as_of: Column) -> Column:
    """struct(starts, ends): the validity stated nearest to the code's first mention."""

    @F.pandas_udf("starts date, ends date")
    def read(texts: pd.Series, found: pd.Series, days: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([nearest_window(*row) for row in zip(texts, found, days)], columns=["starts", "ends"], dtype=object)

    return read(text, code, as_of)


def discount_label(text: Column, code: Column) -> Column:
    """The label of the discount nearest to the code's first mention."""

    @F.pandas_udf("string")
    def label(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([nearest_discount(t or "", c) for t, c in zip(texts, found)], dtype=object)

    return label(text, code)


def conditions(text: Column) -> Column:
    @F.pandas_udf("string")
    def said(texts: pd.Series) -> pd.Series:
        return pd.Series([conditions_of(t or "") for t in texts], dtype=object)

    return said(text)


def described(found: DataFrame, as_of: Column) -> DataFrame:
    """The rows of find_codes with starts, ends, discount and conditions, from one reading of each context."""

    @F.pandas_udf("starts date, ends date, discount string, conditions string")
    def read(contexts: pd.Series, places: pd.Series, found: pd.Series, days: pd.Series) -> pd.DataFrame:
        rows = [(*_nearest(of, at, day), _labelled(of, at, code), _conditions(text, of)) for text, at, code, day in zip(contexts, places, found, days) for of in (tokens(text),)]
        return pd.DataFrame(rows, columns=["starts", "ends", "discount", "conditions"], dtype=object)

    # dealt out by hand: rows are few bytes and much work, of which adaptive planning knows nothing
    width = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return found.repartition(width, "code", "at", "context").withColumn("said", read("context", "place", "code", as_of)).select("*", "said.*").drop("said")


def last_years(code: Column, ends: Column, as_of: Column) -> Column:
    """A code without an end that carries the year before this one in its name."""
    return ends.isNull() & F.endswith(F.upper(code), F.lpad(((F.year(as_of) - 1) % 100).cast("string"), 2, "0"))


def live_codes(state: DataFrame, found: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """state without the codes not seen again, of merchants whose pages answered, and with the newly found ones."""
    gone = state.join(answered.select(key).distinct(), key, "left_semi").join(found.select(key, "code"), [key, "code"], "left_anti").select(key, "code")
    kept = state.join(gone, [key, "code"], "left_anti")
    return kept.unionByName(found.join(kept.select(key, "code"), [key, "code"], "left_anti").select(*state.columns))
