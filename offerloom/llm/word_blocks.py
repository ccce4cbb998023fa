"""Joins between the distinct words of a corpus and the blocks of documents that use them, in packed rows.

A block is a run of documents of one input partition, up to a bound of characters. Its distinct words are dealt to
word partitions by a hash and travel as one compressed list for each (block, word partition); what belongs to each word
travels back in the list's order. So each distinct word of a partition is handled once, however many blocks use it,
and the shuffles carry a few bytes for each distinct word of a block instead of a row for each word of the text.
Memory is bounded by one block, or by the distinct words of one word partition, whose number follows the number of
blocks (PART_BLOCKS) and spark.sql.shuffle.partitions, whichever asks for more.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import lean_batches, shuffle_width

#: Characters of text after which a block ends; a longer text is a block of its own.
BLOCK_CHARS = 12_000_000

#: Blocks for each word partition, so that partitions grow with the corpus as the words do.
PART_BLOCKS = 4

LISTS = "part int, block long, words binary, counts binary"
BLOCKS = "block long, role int, words binary, given binary, docs binary, texts binary"


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def blocks(batches: Iterable[pa.RecordBatch], chars: int = BLOCK_CHARS) -> Iterator[tuple[int, list, list[str]]]:
    """(block, doc_ids, texts) of a partition's rows; a block's name is a hash of its documents."""
    size, ids, texts = 0, [], []
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            ids.append(doc)
            texts.append(text)
            size += len(text)
            if size >= chars:
                yield _name(ids, texts), ids, texts
                size, ids, texts = 0, [], []
    if ids:
        yield _name(ids, texts), ids, texts


def _name(ids: list, texts: list[str]) -> int:
    h = xxhash.xxh3_64(repr(ids))
    for text in texts:
        h.update(text)
    return h.intdigest() - (1 << 63)


def _source(docs: DataFrame) -> DataFrame:
    lean_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))


def deal(block: int, found: dict[bytes, int], parts: int) -> Iterator[pa.RecordBatch]:
    """A block's words as one packed list for each word partition."""
    dealt: dict[int, list[bytes]] = defaultdict(list)
    for word in sorted(found):  # neighbours share their beginnings, which compresses well
        dealt[zlib.crc32(word) % parts].append(word)
    rows = [(p, block, squeeze(b"\n".join(ws)), squeeze(np.fromiter(map(found.__getitem__, ws), "<i8", len(ws)).tobytes())) for p, ws in dealt.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["part", "block", "words", "counts"])


def word_parts(spark: SparkSession, blocks: int) -> int:
    """Word partitions for the words of so many blocks."""
    return max(shuffle_width(spark), blocks // PART_BLOCKS)


def word_lists(packed: DataFrame, parts: int, count: Callable[[Iterable[tuple[int | None, bytes]]], dict[bytes, int]]) -> DataFrame:
    """A packed list of words and counts for each (block, word partition) of text blocks; count gives those of a block's (doc_id, text)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, known, texts in zip(*(batch.column(k).to_pylist() for k in ("block", "docs", "texts"))):
                yield from deal(block, count(opened(known, texts)), parts)

    return packed.select("block", "docs", "texts").mapInArrow(pack, LISTS)


def text_blocks(docs: DataFrame, chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents of each block in one compressed row, role 1."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in blocks(batches, chars):
            raw = [t.encode() for t in texts]
            known = np.asarray([[d or 0, d is not None, len(r)] for d, r in zip(ids, raw)], "<i8").reshape(-1, 3)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block]), "role": pa.array([1], pa.int32()), "words": pa.array([None], pa.binary()), "given": pa.array([None], pa.binary()), "docs": pa.array([squeeze(known.tobytes())], pa.binary()), "texts": pa.array([squeeze(b"".join(raw))], pa.binary())})

    return _source(docs).mapInArrow(pack, BLOCKS)


def met(replies: DataFrame, packed: DataFrame) -> DataFrame:
    """Replies (block, words, given) and the blocks' documents, brought together: a block's replies come before its texts."""
    told = replies.select("block", F.lit(0).alias("role"), "words", "given", F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("texts"))
    return told.unionByName(packed).repartition("block").sortWithinPartitions("block", "role")


def opened(docs: bytes, texts: bytes) -> Iterator[tuple[int | None, bytes]]:
    """doc_id and UTF-8 text of each document of a block."""
    raw, at = unsqueeze(texts), 0
    for doc, known, size in np.frombuffer(unsqueeze(docs), "<i8").reshape(-1, 3).tolist():
        yield (doc if known else None), raw[at : at + size]
        at += size
