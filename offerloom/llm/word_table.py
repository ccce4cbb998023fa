"""Operator 8, BPE encoding and decoding through a table of distinct words.

Words are what lies between white space (line feeds and spaces). Documents form blocks; each block's distinct words are
dealt to word partitions by a hash. A word partition encodes each of its distinct words once, and the ids go back to the
blocks that asked, as lists in the order of the words. There the ids of each distinct word are joined with the
vocabulary's pieces, once, and a document is put together by its words' positions: its ids are those of its words one
after the other, and its decoding joins their pieces by single spaces, as the library does for a file without a decoder.

A row for each word in place of lists is the plainer join (encode_and_decode_by_rows), but one side of its first join was
measured at 3.8 times the input; the lists, sorted and compressed, stay under 1.5 times with the texts. For the same reason
blocks are not written as a table: both scans cut them alike, and a word that a second scan should find elsewhere is
encoded where it is found.

Defined cases: null and empty texts give no ids and decode to the empty text; a null doc_id stays null; repeated rows
give repeated results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import table
from offerloom.llm.subword import encoder, tokenizer_path
from offerloom.llm.word_blocks import BLOCK_CHARS, met, opened, squeeze, text_blocks, unsqueeze, word_lists, word_parts

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def words_of(text: bytes) -> list[bytes]:
    return text.replace(b"\n", b" ").split(b" ")


def distinct_words(docs: Iterable[tuple[int | None, bytes]]) -> dict[bytes, int]:
    found: set[bytes] = set()
    for _, text in docs:
        found.update(words_of(text))
    found.discard(b"")
    return dict.fromkeys(found, 1)


def encode_words(lists: DataFrame, path: str, parts: int) -> DataFrame:
    """For each list its words' ids, in order: their sizes, then all ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        known: dict[bytes, bytes] = {}  # the partition's distinct words
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("words")):
                packed = packed.as_py()
                words = unsqueeze(packed).split(b"\n")
                new = [w for w in words if w not in known]
                if new:
                    ids, offsets = enc.many(pa.array([w.decode() for w in new]))
                    known.update(zip(new, cut(ids.tobytes(), (4 * np.diff(offsets)).tolist(), 0)))
                given = [*map(known.__getitem__, words)]
                sizes = np.fromiter(map(len, given), "<u4", len(given))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([packed], pa.binary()), pa.array([squeeze(sizes.tobytes() + b"".join(given))], pa.binary())], ["block", "words", "given"])

    return lists.select("part", "block", "words").repartition(parts, "part").mapInArrow(encode, "block long, words binary, given binary")


def cut(raw: bytes, sizes: list[int], at: int) -> list[bytes]:
    return [raw[a : a + n] for n, a in zip(sizes, itertools.accumulate(sizes, initial=at))]


class Held(dict):
    """A block's words and their ids; a word that its replies lack is encoded here."""

    def __init__(self, enc):
        super().__init__({b"": b""})
        self.enc = enc

    def __missing__(self, word: bytes) -> bytes:
        return self.enc.ids(word.decode())


class Forms(dict):
    """Pieces of packed ids, joined once for each distinct word of a block."""

    def __init__(self, pieces: list[bytes]):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, ids: bytes) -> bytes:
        form = self[ids] = b" ".join(map(self.pieces.__getitem__, array("I", ids)))
        return form


def encode_and_decode(docs: DataFrame, path: str, with_values: bool = False) -> DataFrame:
    """Digests of each document's ids and of their decoding; with_values adds ids (packed unsigned 32 bits) and text."""
    packed = text_blocks(docs)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = word_parts(docs.sparkSession, chars // BLOCK_CHARS)
    told = encode_words(word_lists(packed, parts, distinct_words), path, parts)
    schema = ENCODED + (", ids binary, decoded string" if with_values else "")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string())

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        pieces = [(enc.lib.id_to_token(i) or "").encode() for i in range(enc.lib.get_vocab_size(with_added_tokens=True))]
        now, ids_of, forms = None, Held(enc), Forms(pieces)
        for batch in batches:
            for n in range(batch.num_rows):
                block, role, words, given, known, texts = (batch.column(k)[n].as_py() for k in ("block", "role", "words", "given", "docs", "texts"))
                if block != now:
                    now, ids_of, forms = block, Held(enc), Forms(pieces)
                if role == 0:
                    names, raw = unsqueeze(words).split(b"\n"), unsqueeze(given)
                    ids_of.update(zip(names, cut(raw, np.frombuffer(raw, "<u4", len(names)).tolist(), 4 * len(names))))
                    continue
                out: list[tuple] = []
                for doc, text in opened(known, texts):
                    each = [i for i in map(ids_of.__getitem__, words_of(text)) if i]  # a word may have no ids
                    ids, decoded = b"".join(each), b" ".join(map(forms.__getitem__, each))
                    row = (doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
                    out.append(row + (ids, decoded.decode()) if with_values else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [f.split()[0] for f in schema.split(", ")])

    return met(told, packed).mapInArrow(assemble, schema)


def encode_and_decode_by_rows(docs: DataFrame, path: str) -> DataFrame:
    """The same with a row for each word: split by Spark, each distinct word encoded once, its ids joined back by the
    word's place, and pieces joined to ids by the id. Its figures are in README: several shuffles of all words as rows."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = rows.select("row", F.posexplode(F.split("text", "[ \n]")).alias("place", "word")).where("word <> ''")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids, offsets = enc.many(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["w", "ids"])

    table_of = words.select(F.col("word").alias("w")).distinct().mapInArrow(encode, "w string, ids array<int>")
    held = words.join(table_of, F.expr("word = w")).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "ids"))).alias("of"))
    encoded = rows.select("row", "doc_id").join(held.select(F.col("row").alias("r"), F.flatten(F.transform("of", lambda x: x["ids"])).alias("ids")), F.expr("row = r"), "left")
    encoded = encoded.select("row", "doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    lib = encoder(path).lib
    pieces = docs.sparkSession.createDataFrame([(i, lib.id_to_token(i) or "") for i in range(lib.get_vocab_size(with_added_tokens=True))], "id int, piece string")
    spelt = encoded.select("row", F.posexplode("ids").alias("place", "i")).join(pieces, F.expr("i = id")).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("of"))
    whole = encoded.join(spelt.select(F.col("row").alias("r"), F.array_join(F.transform("of", lambda x: x["piece"]), " ").alias("decoded")), F.expr("row = r"), "left")
    low = "transform(ids, i -> concat(lpad(hex(i & 255), 2, '0'), lpad(hex(shiftright(i, 8) & 255), 2, '0'), lpad(hex(shiftright(i, 16) & 255), 2, '0'), lpad(hex(shiftright(i, 24) & 255), 2, '0')))"
    return whole.selectExpr("doc_id", "cast(size(ids) as bigint) as n_tokens", f"sha2(unhex(array_join({low}, '')), 256) as ids_sha256", "sha2(cast(coalesce(decoded, '') as binary), 256) as decoded_sha256")


def op8_bpe_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES = {"op8_bpe_word_table": op8_bpe_word_table}
SQL: dict[str, str] = {}
