"""Operator 13, fill-in-middle: a parallel automaton scan finds token ends, also in documents that many tasks share.

Tokens are a run of white space with the word after it, or the white space that ends a text. A two-state automaton (in
white space, in a word) reads UTF-8 bytes: white space is ASCII, so every other byte belongs to a word, and a token ends
where white space follows a word and where the text ends. A chunk of a text becomes the automaton's transition function
(the state after it for each state before it) and, for each state before it, the number of token ends in it. Two
neighbouring chunks compose to such a pair again, associatively, so a scan over a document's chunks gives the state and
the number of tokens before each chunk; the chunk that holds a cut is then found by its number, and the cut inside it by
its own scan.

A text of up to chunk_bytes is one chunk, and is cut where it is read. A longer one is written to the shared folder once;
its chunks are dealt to tasks by number, and each task sends back a few numbers for each chunk. They are composed for each
document (a string holds less than 2 GiB, so some 32 thousand chunks at most), the chunks that hold the two cuts are
picked by a join, and only their texts are looked into again. The whole text of a long document is in one task when its
chunks are cut and when its output, which is one string, is put together, and never more of them than a batch.

Defined cases: a null text is empty; an empty text has no tokens and is plain; a null doc_id hashes as an empty string;
repeated rows each give a row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import lean_batches, shuffle_width, table, written
from offerloom.llm.subword import runs

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK_BYTES = 1 << 16
FIM_PERCENT, SPM_PERCENT, SEED = 50, 80, 42
SPACE, WORD = 0, 1

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True

FORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_FACTS = "doc_id long, text string, plain boolean, spm boolean, h1 long, h2 long"


def facts(docs: DataFrame, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, text, whether a text stays plain or is suffix-first, and the two numbers that choose its cuts."""
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "coalesce(text, '') as text")
    rows = rows.withColumn("hex", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256))
    h = [f"cast(conv(substr(hex, {8 * k + 1}, 8), 16, 10) as bigint)" for k in range(4)]
    marked = " or ".join(f"contains(text, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    return rows.selectExpr("doc_id", "text", f"text = '' or {marked} or {h[2]} % 100 >= {int(fim_percent)} as plain", f"{h[3]} % 100 < {int(spm_percent)} as spm", f"{h[0]} as h1", f"{h[1]} as h2")


def scanned(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte is white space, and the places of token ends of words within data (white space after a word)."""
    white = _WHITE[data]
    return white, np.flatnonzero(white[1:] & ~white[:-1]) + 1


def transition(data: np.ndarray) -> tuple[tuple[int, int], tuple[int, int]]:
    """A chunk's states after it, and token ends in it, for the states before it: (SPACE, WORD). An end at the chunk's first byte is that of a word before it."""
    if not len(data):
        return (SPACE, WORD), (0, 0)
    white, ends = scanned(data)
    after = SPACE if white[-1] else WORD
    return (after, after), (len(ends), len(ends) + int(white[0]))


def prefixes(states: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For chunks in order: the transition function and counts of all chunks up to each, by doubling steps of the associative composition."""
    states, counts = states.copy(), counts.copy()
    step = 1
    while step < len(states):
        first, second = (states[:-step], counts[:-step]), (states[step:], counts[step:])
        counts[step:], states[step:] = first[1] + np.take_along_axis(second[1], first[0], 1), np.take_along_axis(second[0], first[0], 1)
        step *= 2
    return states, counts


def cuts(h1: int, h2: int, n: int) -> tuple[int, int]:
    return min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))


def arranged(text: memoryview, a: int, b: int, spm: bool) -> bytes:
    """The output of a text that is cut at the bytes a and b."""
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    return b"".join((s, text[b:], p, text[:a], m, text[a:b]) if spm else (p, text[:a], s, text[b:], m, text[a:b]))


def _texts(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of all texts of a batch, and where each begins and ends in them."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return memoryview(data) if data is not None else memoryview(b""), offsets


def _formed(ids: pa.Array, n: list, forms: list, chars: list, outputs: list) -> pa.RecordBatch:
    cols = [ids, pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array([c[0] for c in chars], pa.int64()), pa.array([c[1] for c in chars], pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _chars(data: np.ndarray) -> int:
    """Code points in UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def short(rows: DataFrame) -> DataFrame:
    """Texts of one chunk, cut where they are read: all texts of a batch are scanned at once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            view, at = _texts(batch.column("text"))
            data = np.frombuffer(view, np.uint8)[at[0] : at[-1]]
            at, view = at - at[0], view[at[0] : at[-1]]
            white, ends = scanned(data)
            first = np.searchsorted(ends, at[:-1], "right")  # an end at a text's first byte is no end of its own
            inner = np.maximum(np.searchsorted(ends, at[1:], "left") - first, 0)  # an empty text may lie on an end
            n, forms, chars, outputs = [], [], [], []
            for a, b, e, k, plain, spm, h1, h2 in zip(at[:-1].tolist(), at[1:].tolist(), first.tolist(), inner.tolist(), *(batch.column(c).to_pylist() for c in ("plain", "spm", "h1", "h2"))):
                total = k + (b > a)  # the text's end ends a token, too
                n.append(total)
                if plain:
                    forms.append("plain"), chars.append((None, None)), outputs.append(bytes(view[a:b]))
                    continue
                x, y = (a if c == 0 else b if c == total else int(ends[e + c - 1]) for c in cuts(h1, h2, total))
                forms.append("spm" if spm else "psm")
                chars.append((_chars(data[a:x]), _chars(data[x:y])))
                outputs.append(arranged(view[a:b], x - a, y - a, spm))
            yield _formed(batch.column("doc_id"), n, forms, chars, outputs)

    return rows.mapInArrow(cut, FORMED)


def chunked(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """(row, chunk, data): the chunks of each text, as bytes; a chunk may begin within a character."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view, at = _texts(batch.column("text"))
            for row, a, b in zip(batch.column("row").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                for k, start in enumerate(range(a, b, chunk_bytes)):
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([k], pa.int32()), pa.array([bytes(view[start : min(b, start + chunk_bytes)])], pa.binary())], ["row", "chunk", "data"])

    return rows.select("row", "text").mapInArrow(cut, "row long, chunk int, data binary")


def summaries(chunks: DataFrame) -> DataFrame:
    """Each chunk's transition function, token ends by state before it, and code points."""

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(*(x for pair in transition(data) for x in pair), _chars(data)) for data in (np.frombuffer(d.as_buffer(), np.uint8) for d in batch.column("data"))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("chunk"), *(pa.array(c, pa.int64()) for c in zip(*found))], ["row", "chunk", "after_space", "after_word", "ends_space", "ends_word", "chars"])

    return chunks.mapInArrow(sum_up, "row long, chunk int, after_space long, after_word long, ends_space long, ends_word long, chars long")


def picked(sums: DataFrame, rows: DataFrame) -> DataFrame:
    """For each row its number of tokens, and for each cut the chunk that holds it and what comes before that chunk."""

    def resolve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("chunk", kind="stable")
        states, counts = prefixes(part[["after_space", "after_word"]].to_numpy(np.int64), part[["ends_space", "ends_word"]].to_numpy(np.int64))
        ends, state = counts[:, SPACE], states[:, SPACE]  # a text begins as if after white space
        total = int(ends[-1]) + 1
        chars = part["chars"].to_numpy().cumsum()
        own = part.iloc[0]
        out = []
        for side, want in enumerate(cuts(int(own.h1), int(own.h2), total)):
            # the text's end ends the last token, after all chunks
            at = 0 if want == 0 else len(ends) - 1 if want == total else int(np.searchsorted(ends, want, "left"))
            before = (0, 0, SPACE) if at == 0 else (int(ends[at - 1]), int(chars[at - 1]), int(state[at - 1]))
            out.append((int(own.row), total, side, int(part["chunk"].iloc[at]), -1 if want == 0 else -2 if want == total else want - before[0], before[1], before[2]))
        return pd.DataFrame(out, columns=["row", "n", "side", "chunk", "nth", "chars_before", "state"])

    asked = sums.join(rows.select("row", "h1", "h2"), "row")
    return asked.groupBy("row").applyInPandas(resolve, "row long, n long, side int, chunk int, nth long, chars_before long, state int")


def located(picks: DataFrame, chunks: DataFrame, chunk_bytes: int) -> DataFrame:
    """(row, n, side, at, chars): the byte and the code point of each cut, from the chunk that holds it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, n, side, chunk, nth, before, state, data in zip(*(batch.column(c) for c in ("row", "n", "side", "chunk", "nth", "chars_before", "state", "data"))):
                data, nth = np.frombuffer(data.as_buffer(), np.uint8), nth.as_py()
                white, ends = scanned(data)
                if state.as_py() == WORD and white[0]:
                    ends = np.concatenate([[0], ends])
                place = 0 if nth == -1 else len(data) if nth == -2 else int(ends[nth - 1])
                out.append((row.as_py(), n.as_py(), side.as_py(), chunk.as_py() * chunk_bytes + place, before.as_py() + _chars(data[:place])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["row", "n", "side", "at", "chars"])

    return picks.join(chunks, ["row", "chunk"]).select("row", "n", "side", "chunk", "nth", "chars_before", "state", "data").mapInArrow(find, "row long, n long, side int, at long, chars long")


def long(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """Texts of several chunks, whose cuts are found by tasks that share them."""
    stored = written(rows.withColumn("row", F.monotonically_increasing_id()), "long-texts")
    width = shuffle_width(rows.sparkSession)
    dealt = chunked(stored, chunk_bytes).repartition(width, "row", "chunk")
    picks = written(picked(summaries(dealt), stored), "chunks-with-cuts")
    side = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    found = located(picks, chunked(stored, chunk_bytes), chunk_bytes).groupBy("row").agg(F.max("n").alias("n"), side(0, "at").alias("a"), side(1, "at").alias("b"), side(0, "chars").alias("p_chars"), side(1, "chars").alias("m_chars"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            view, at = _texts(batch.column("text"))
            n, forms, chars, outputs = batch.column("n").to_pylist(), [], [], []
            for s, e, plain, spm, a, b, p, m in zip(at[:-1].tolist(), at[1:].tolist(), *(batch.column(c).to_pylist() for c in ("plain", "spm", "a", "b", "p_chars", "m_chars"))):
                forms.append("plain" if plain else "spm" if spm else "psm")
                chars.append((None, None) if plain else (p, m - p))
                outputs.append(bytes(view[s:e]) if plain else arranged(view[s:e], a, b, spm))
            yield _formed(batch.column("doc_id"), n, forms, chars, outputs)

    return stored.join(found, "row").select("doc_id", "text", "plain", "spm", "n", "a", "b", "p_chars", "m_chars").mapInArrow(put, FORMED)


def fill_in_middle(docs: DataFrame, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Each text as prefix-suffix-middle (psm), suffix-prefix-middle (spm) or as it is (plain); returns doc_id, n, form, prefix_chars, middle_chars, output."""
    lean_batches(docs.sparkSession)
    rows = facts(docs, fim_percent, spm_percent, seed)
    size = F.octet_length("text")
    return short(rows.where(size <= chunk_bytes)).unionByName(long(rows.where(size > chunk_bytes), chunk_bytes))


#: The text that an output and its form came from; a formed text holds no marker of its own.
RESTORED = f"""case form when 'plain' then output
  when 'psm' then concat(split(output, '<[PSM]>')[1], split(output, '<[PSM]>')[3], split(output, '<[PSM]>')[2])
  else concat(split(output, '<[PSM]>')[2], split(output, '<[PSM]>')[3], split(output, '<[PSM]>')[1]) end"""


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "n", "form", "prefix_chars", "middle_chars", "sha2(cast(output as binary), 256) as output_sha256", f"sha2(cast({RESTORED} as binary), 256) as restored_sha256")


QUERIES = {"op13_fill_middle": op13_fill_middle}
SQL = {
    "op13_fill_middle": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
  FROM documents),
k AS (
  SELECT doc_id, text, tokens, len(tokens) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(tokens) + 1) AS u, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(tokens) + 1) AS v,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
        OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
c AS (
  SELECT *, array_to_string(tokens[1:least(u, v)], '') AS p, array_to_string(tokens[least(u, v) + 1:greatest(u, v)], '') AS m,
    array_to_string(tokens[greatest(u, v) + 1:n], '') AS s
  FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""
}
