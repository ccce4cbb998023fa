"""One query text for two engines: the differences between Spark SQL and the oracle's dialect, function by function.

A plan is written once as a function of a dialect. Spark runs it over views of the tables that it names; the oracle is
the same text in the other dialect, so every result is checked by an engine that shares no code with Spark.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _ascii_forms() -> tuple[tuple[str, str], dict[str, str]]:
    """Characters with an ASCII form by compatibility decomposition: those of one letter, and the others, by the Unicode tables."""
    forms = {chr(c): unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() for c in (*range(0xA0, 0x2200), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F))}
    forms = {c: f for c, f in forms.items() if f and f != "'" and "\\" not in f}
    one = {c: f for c, f in forms.items() if len(f) == 1}
    return ("".join(one), "".join(one.values())), {c: f for c, f in forms.items() if len(f) > 1 and f.strip()}


class Dialect:
    letters, several = _ascii_forms()

    def spelt(self, x):
        """Characters that stand for several letters, spelt out; texts without one are passed on as they are."""
        known = self.literal_map(self.several)
        return f"CASE WHEN {self.matches(x, f'[{"".join(self.several)}]')} THEN {self.join(self.map(self.digits(x), 'ch', f"coalesce({self.item(known, 'ch')}, ch)"), '')} ELSE {x} END"


    def bound(self, x, name, body):
        """body with x worked out once, under a name."""
        return self.item(self.map(self.array(x), name, body), 1)


class SparkDialect(Dialect):
    spark = True

    def ascii(self, x):
        return f"(octet_length({x}) = char_length({x}))"

    def literal_map(self, table):
        return f"map({', '.join(f"'{k}', '{v}'" for k, v in table.items())})"

    def gsub(self, x, pattern, by=""):
        return f"regexp_replace({x}, r'{pattern}', '{re.sub(chr(92) * 2 + r'(\d)', r'$\1', by)}')"

    def matches(self, x, pattern):
        return f"({x} RLIKE r'{pattern}')"

    def extract(self, x, pattern, group=0):
        return f"regexp_extract({x}, r'{pattern}', {group})"

    def extract_all(self, x, pattern):
        return f"regexp_extract_all({x}, r'{pattern}', 0)"

    def split(self, x, sep):
        return f"split({x}, r'{re.escape(sep)}')"

    def item(self, array, i):
        return f"try_element_at({array}, {i})"

    def size(self, array):
        return f"CAST(size({array}) AS BIGINT)"

    def unnest(self, array):
        return f"explode({array})"

    def join_set(self, x, sep=","):
        return f"array_join(array_sort(collect_set(CAST({x} AS STRING))), '{sep}')"

    def join(self, array, sep):
        return f"array_join({array}, '{sep}')"

    def sorted(self, array):
        return f"array_sort({array})"

    def distinct(self, array):
        return f"array_distinct({array})"

    def array(self, *items):
        return f"array({', '.join(items)})"

    def intersect(self, a, b):
        return f"array_intersect({a}, {b})"

    def union(self, a, b):
        return f"array_union({a}, {b})"

    def minus(self, a, b):
        return f"array_except({a}, {b})"

    def overlap(self, a, b):
        return f"arrays_overlap({a}, {b})"

    def within(self, a, b):
        """All of a is in b."""
        return f"(size(array_except({a}, {b})) = 0)"

    def has(self, array, x):
        return f"array_contains({array}, {x})"

    def map(self, array, x, body):
        return f"transform({array}, {x} -> {body})"

    def keep(self, array, x, body):
        return f"filter({array}, {x} -> {body})"

    def bucket(self, x, low, high, n):
        return f"CAST(width_bucket({x}, {low}, {high}, {n}) AS BIGINT)"

    def days(self, later, earlier):
        return f"CAST(datediff({later}, {earlier}) AS BIGINT)"

    def seconds(self, later, earlier):
        return f"timestampdiff(SECOND, {earlier}, {later})"

    def chars(self, x):
        return f"CAST(char_length({x}) AS BIGINT)"

    def sequence(self, a, b):
        return f"sequence({a}, {b})"

    def position(self, x, y):
        return f"CAST(locate({y}, {x}) AS BIGINT)"

    def field(self, json, key):
        return f"get_json_object({json}, '$.{key}')"

    def digits(self, x):
        return f"split({x}, '')"

    def string(self, x):
        return f"CAST({x} AS STRING)"

    def try_double(self, x):
        return f"try_cast({x} AS DOUBLE)"

    def try_date(self, x):
        return f"try_to_date({x}, 'yyyy-MM-dd')"

    def edit(self, a, b):
        return f"CAST(levenshtein({a}, {b}) AS BIGINT)"

    def folded(self, x):
        return f"translate({x}, '{ACCENTED}', '{PLAIN}')"


class OracleDialect(Dialect):
    spark = False

    def ascii(self, x):
        return f"(strlen({x}) = length({x}))"

    def literal_map(self, table):
        return f"MAP {{{', '.join(f"'{k}': '{v}'" for k, v in table.items())}}}"

    def gsub(self, x, pattern, by=""):
        return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    def matches(self, x, pattern):
        return f"regexp_matches({x}, '{pattern}')"

    def extract(self, x, pattern, group=0):
        return f"regexp_extract({x}, '{pattern}', {group})"

    def extract_all(self, x, pattern):
        return f"regexp_extract_all({x}, '{pattern}')"

    def split(self, x, sep):
        return f"string_split({x}, '{sep}')"

    def item(self, array, i):
        return f"({array})[{i}]"

    def size(self, array):
        return f"CAST(len({array}) AS BIGINT)"

    def unnest(self, array):
        return f"unnest({array})"

    def join_set(self, x, sep=","):
        return f"coalesce(array_to_string(list_sort(list(DISTINCT CAST({x} AS VARCHAR)) FILTER (WHERE {x} IS NOT NULL)), '{sep}'), '')"

    def join(self, array, sep):
        return f"array_to_string({array}, '{sep}')"

    def sorted(self, array):
        return f"list_sort({array})"

    def distinct(self, array):
        return f"list_distinct({array})"

    def array(self, *items):
        return f"[{', '.join(items)}]"

    def intersect(self, a, b):
        return f"list_intersect({a}, {b})"

    def union(self, a, b):
        return f"list_distinct(list_concat({a}, {b}))"

    def minus(self, a, b):
        return f"list_filter(list_distinct({a}), lambda e: NOT list_contains({b}, e))"

    def overlap(self, a, b):
        return f"list_has_any({a}, {b})"

    def within(self, a, b):
        return f"list_has_all({b}, {a})"

    def has(self, array, x):
        return f"list_contains({array}, {x})"

    def map(self, array, x, body):
        return f"list_transform({array}, lambda {x}: {body})"

    def keep(self, array, x, body):
        return f"list_filter({array}, lambda {x}: {body})"

    def bucket(self, x, low, high, n):
        return f"CAST(CASE WHEN {x} < {low} THEN 0 WHEN {x} >= {high} THEN {n} + 1 ELSE floor(({x} - {low}) * {n} / CAST({high} - {low} AS DOUBLE)) + 1 END AS BIGINT)"

    def days(self, later, earlier):
        return f"CAST(date_diff('day', {earlier}, {later}) AS BIGINT)"

    def seconds(self, later, earlier):
        return f"CAST(trunc(epoch({later}) - epoch({earlier})) AS BIGINT)"

    def chars(self, x):
        return f"CAST(length({x}) AS BIGINT)"

    def sequence(self, a, b):
        return f"range({a}, ({b}) + 1)"

    def position(self, x, y):
        return f"CAST(strpos({x}, {y}) AS BIGINT)"

    def field(self, json, key):
        return f"nullif(regexp_extract({json}, '\"{key}\": *\"?([^\",}}]*)', 1), '')"

    def digits(self, x):
        return f"string_split({x}, '')"

    def string(self, x):
        return f"CAST({x} AS VARCHAR)"

    def try_double(self, x):
        return f"TRY_CAST({x} AS DOUBLE)"

    def try_date(self, x):
        return f"TRY_CAST({x} AS DATE)"

    def edit(self, a, b):
        return f"CAST(levenshtein({a}, {b}) AS BIGINT)"

    def folded(self, x):
        return f"translate({x}, '{ACCENTED}', '{PLAIN}')"


#: Accented Latin letters and their plain forms, one to one.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

#: Offers out of lineitem and part: the stand-in of a merchant's feed. Money is in whole cents, so sums are exact.
OFFER = """offer AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS offer_id, concat_ws('-', l_orderkey, l_linenumber) AS sku,
    l_partkey AS product_id, l_suppkey AS merchant_id, l_orderkey AS feed_id, l_linenumber AS position,
    p_brand AS brand, p_type AS category, p_size AS size, p_name AS title,
    CAST(floor(p_retailprice * (1 - l_discount) * (1 + l_tax) * 100 + 0.5) AS BIGINT) AS cents,
    CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS wide,
    CASE l_returnflag WHEN 'R' THEN FALSE WHEN 'A' THEN TRUE END AS in_stock,
    l_linestatus = 'O' AS live, CAST(l_shipdate AS DATE) AS seen
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""
#: The day as of which a query looks at the offers: the last in the data.
AS_OF = "today AS (SELECT CAST(max(l_shipdate) AS DATE) AS day FROM lineitem)"

_PLANS: dict[str, Callable] = {}
_FRAMES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_TEXTS: dict[str, str] = {}


def plan(name: str):
    """Registers a text that is a function of the dialect."""

    def register(text: Callable):
        assert name not in _PLANS and name not in _FRAMES, name
        _PLANS[name] = text
        return text

    return register


def frame(name: str, oracle: str | Callable | None = None):
    """Registers a DataFrame function (spark, sf_dir) with an oracle text, or a function of the oracle's dialect."""

    def register(f: Callable):
        assert name not in _PLANS and name not in _FRAMES, name
        _FRAMES[name] = f
        if oracle is not None:
            _TEXTS[name] = oracle(OracleDialect()) if callable(oracle) else oracle
        return f

    return register


def runs(name: str):
    """Lets a DataFrame function (spark, sf_dir) answer a registered plan, whose text stays its oracle."""

    def register(f: Callable):
        assert name in _PLANS and name not in _FRAMES, name
        _FRAMES[name] = f
        return f

    return register


def run_text(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs Spark SQL over the tables of a folder that it names, under view names of their own: the user's views stay."""
    for t in TABLES:
        own = f"offerloom_{t}_{zlib.crc32(sf_dir.encode()):08x}"
        # keywords are in capitals and aliases are not: a table without an alias keeps its name as one
        text, n = re.subn(rf"\b(FROM|JOIN)\s+{t}\b(\s+(?:AS\s+)?[a-z])?", lambda m: f"{m[1]} {own}{m[2] or f' AS {t}'}", text)  # noqa: B023
        if n:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(own)
    return spark.sql(text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = {name: (lambda spark, sf_dir, text=text: run_text(spark, sf_dir, text(SparkDialect()))) for name, text in _PLANS.items()}
    return made | _FRAMES


def oracle_sql() -> dict[str, str]:
    return {name: text(OracleDialect()) for name, text in _PLANS.items()} | _TEXTS
