"""Operator 2, quality rules: repetition measures of a text, and cross-document line frequency. DataFrame functions only.

Lines are normalised (lower case, runs of white space as one space, ends trimmed), hashed and counted per host. A line
is boilerplate of its host when more distinct documents of the host have it than the limit: host_percent of the host's
distinct documents, and least_docs at least. Documents with the same set of lines are one document to these counts, so
exact copies do not make each other boilerplate (which copy stays is for near-dedup to say). Every boilerplate line is
removed, from whatever document: clean_text holds the other lines as they stood. A document that this depletes, of whose
words under keep_percent remain, is rejected.

Counting is a grouped count with map-side partial sums, so a hot line is a number for each task; only occurrences of
lines above the limit are joined back, on keys that AQE may split or, where the written table of those lines is small
enough for Spark's own limit, without a shuffle.

Defined cases: null and empty texts have no words and no lines, so base_failed is true; a null host is a host of its
own; a null doc_id stays null; repeated rows are one document to the counts and each gives its own result row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import table, written

LEAST_DOCS, HOST_PERCENT, KEEP_PERCENT = 5, 2, 66
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8

_WS = r"[\\x20\\x09-\\x0D]+"
_HASHES = ", ".join(f"hashes[i + {k}]" if k else "hashes[i]" for k in range(WINDOW))

_CLEAN = r"array_join(filter(split(row.text, '\n'), l -> not array_contains(gone, xxhash64(trim(regexp_replace(lower(l), '[\\x20\\x09\\x0B-\\x0D]+', ' '))))), '\n')"


def measures(docs: DataFrame) -> DataFrame:
    """The row, doc_id, host, print (a hash of the text) and the base measures of every row."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).selectExpr("row", "cast(row.doc_id as bigint) as doc_id", "coalesce(row.source, '') as host", "coalesce(row.text, '') as text")
    rows = rows.selectExpr("row", "doc_id", "host", "text", "xxhash64(text) as print", f"filter(split(text, '{_WS}'), w -> w <> '') as words", r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]') as lines")
    rows = rows.selectExpr(
        "row", "doc_id", "host", "print",
        "cast(size(words) as bigint) as n_words",
        "cast(length(array_join(words, '')) as bigint) as word_chars",
        "cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '')) as bigint) as n_symbols",
        "cast(size(lines) - size(array_distinct(lines)) as bigint) as n_dup_lines",
        "transform(words, w -> xxhash64(w)) as hashes",
    )
    rows = rows.selectExpr("*", f"case when n_words >= {WINDOW} then transform(sequence(0, cast(n_words as int) - {WINDOW}), i -> xxhash64({_HASHES})) else array(0L) end as windows").drop("hashes")
    # only a text with an equal pair of windows pays for the sort that finds their places
    rows = rows.selectExpr("*", "case when size(array_distinct(windows)) < size(windows) then sort_array(transform(windows, (w, i) -> struct(w as w, i as i))) else array() end as places").drop("windows")
    rows = rows.selectExpr("*", "sort_array(transform(filter(places, (x, k) -> (k > 0 and places[k - 1].w = x.w) or (k + 1 < size(places) and places[k + 1].w = x.w)), x -> x.i)) as twice").drop("places")
    covered = f"aggregate(twice, named_struct('last', -{WINDOW}, 'sum', 0), (a, i) -> named_struct('last', i, 'sum', a.sum + least({WINDOW}, i - a.last)), a -> a.sum)"
    rows = rows.selectExpr("*", f"cast({covered} as bigint) as n_repeat_words").drop("twice")
    return rows.selectExpr("*", f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words as base_failed")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, host, print, and the normalised non-empty lines of each row."""
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "coalesce(source, '') as host", "xxhash64(coalesce(text, '')) as print", r"split(regexp_replace(lower(coalesce(text, '')), '[\\x20\\x09\\x0B-\\x0D]+', ' '), '\n') as raw")
    return rows.selectExpr("doc_id", "host", "print", "filter(transform(raw, l -> trim(l)), l -> l <> '') as lines")


def boilerplate_words(docs: DataFrame, least_docs: int = LEAST_DOCS, host_percent: int = HOST_PERCENT) -> DataFrame:
    """Words in boilerplate lines, and those lines' hashes, of each document (doc_id, host, print) that has any."""
    lines = lines_of(docs).selectExpr("*", "xxhash64(sort_array(array_distinct(lines))) as kind")
    # a line in few rows cannot be in many documents: only the others' occurrences are looked at one by one
    counted = lines.selectExpr("host", "explode(array_distinct(transform(lines, l -> xxhash64(l)))) as line").groupBy("host", "line").agg(F.count("*").alias("docs"))
    shared = written(counted.where(f"docs > {int(least_docs)}").selectExpr("host as h", "line as l"), "shared-lines")
    each = lines.selectExpr("doc_id", "host", "print", "kind", "posexplode(transform(lines, l -> struct(xxhash64(l) as line, length(l) - length(replace(l, ' ', '')) + 1 as words))) as (pos, x)")
    each = each.selectExpr("doc_id", "host", "print", "kind", "pos", "x.line as line", "x.words as words")
    found = written(each.join(shared, F.expr("host = h and line = l"), "left_semi").groupBy("doc_id", "host", "print", "kind", "pos", "line", "words").count().drop("count"), "shared-occurrences")
    kinds = found.select("host", "line", "kind").distinct().groupBy("host", "line").agg(F.count("*").alias("kinds")).where(f"kinds > {int(least_docs)}")
    hosts = written(lines.where("size(lines) > 0").select("host", "kind").distinct().groupBy("host").agg(F.count("*").alias("docs")), "host-documents")
    above = kinds.join(hosts.selectExpr("host as h", "docs"), F.expr("host = h")).where(f"100 * kinds > {int(host_percent)} * docs")
    boilerplate = written(above.selectExpr("host as h", "line as l"), "boilerplate-lines")
    return found.join(boilerplate, F.expr("host = h and line = l"), "left_semi").groupBy("doc_id", "host", "print").agg(F.sum("words").cast("bigint").alias("removed_words"), F.collect_set("line").alias("gone"))


def judged(docs: DataFrame, least_docs: int = LEAST_DOCS, host_percent: int = HOST_PERCENT, keep_percent: int = KEEP_PERCENT) -> DataFrame:
    """The row, its base measures, words in boilerplate lines, verdict, and the text without those lines."""
    removed = boilerplate_words(docs, least_docs, host_percent).selectExpr("doc_id as d", "host as h", "print as p", "removed_words", "gone")
    rows = measures(docs).join(removed, F.expr("doc_id <=> d and host = h and print = p"), "left")
    rows = rows.withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    # one expression of both sides of the join: a filter on it must not move below, where the measures would be worked out anew
    return rows.selectExpr("*", f"case when base_failed then false else 100 * (n_words - removed_words) >= {keep_percent} * n_words end as kept", f"case when gone is null then row.text else {_CLEAN} end as clean_text")


def line_rules(docs: DataFrame, least_docs: int = LEAST_DOCS, host_percent: int = HOST_PERCENT, keep_percent: int = KEEP_PERCENT) -> DataFrame:
    """Base measures, words in boilerplate lines, the verdict and the cleaned text of every row."""
    return judged(docs, least_docs, host_percent, keep_percent).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "clean_text")


def cleaned(docs: DataFrame, least_docs: int = LEAST_DOCS, host_percent: int = HOST_PERCENT, keep_percent: int = KEEP_PERCENT) -> DataFrame:
    """The kept rows, in the columns of docs, with their cleaned text (and its length as n_chars, where lines went)."""
    given = {"text": "clean_text", "n_chars": "case when gone is null then row.n_chars else cast(length(clean_text) as bigint) end"}
    return judged(docs, least_docs, host_percent, keep_percent).where("kept").selectExpr(*(f"{given.get(c, f'row.`{c}`')} as `{c}`" for c in docs.columns))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents")).drop("clean_text")  # the oracle's columns


QUERIES = {"op2_line_frequency": op2_line_frequency}
SQL = {
    "op2_line_frequency": rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS raw,
    list_filter(list_transform(string_split(regexp_replace(lower(text), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)), lambda l: trim(l)), lambda l: l <> '') AS lines
  FROM d),
base AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(raw) - len(list_distinct(raw)) AS BIGINT) AS n_dup_lines
  FROM w),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS v
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS n FROM win) WHERE n >= 2),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(0, 8)) AS j FROM twice) GROUP BY doc_id),
l AS (
  SELECT doc_id, host, line, len(string_split(line, ' ')) AS words
  FROM (SELECT doc_id, host, unnest(lines) AS line FROM w)),
k AS (SELECT doc_id, host, list_sort(list_distinct(lines)) AS kind FROM w WHERE len(lines) > 0),
hosts AS (SELECT host, count(DISTINCT kind) AS docs FROM k GROUP BY host),
boiler AS (
  SELECT host, line FROM (SELECT host, unnest(kind) AS line, kind FROM (SELECT DISTINCT host, kind FROM k)) JOIN hosts USING (host)
  GROUP BY host, line HAVING count(*) > greatest({LEAST_DOCS}, any_value(docs) * {HOST_PERCENT} / 100)),
removed AS (SELECT doc_id, CAST(sum(words) AS BIGINT) AS n FROM l JOIN boiler USING (host, line) GROUP BY doc_id)
SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  (b.n_words < {MIN_WORDS} OR 100 * coalesce(rep.n, 0) > {REPEAT_PERCENT} * b.n_words) AS base_failed,
  (NOT (b.n_words < {MIN_WORDS} OR 100 * coalesce(rep.n, 0) > {REPEAT_PERCENT} * b.n_words)
    AND 100 * (b.n_words - coalesce(removed.n, 0)) >= {KEEP_PERCENT} * b.n_words) AS kept,
  coalesce(removed.n, 0) AS removed_words
FROM base b LEFT JOIN rep USING (doc_id) LEFT JOIN removed USING (doc_id)
"""
}
