"""Operator 5, token files: flat unsigned integers plus 64-bit document offsets, memory-mapped.

Format, for each part K of a set: part-K.bin holds the ids of its documents one after the other as little-endian
unsigned integers (16 bits where the vocabulary allows, else 32); part-K.idx holds, as little-endian 64-bit integers,
the number of documents n, their n ids, a validity byte each, and n + 1 offsets (in ids) into the .bin. Parts follow
each other in ascending doc_id; the first id of part K has the number of all ids in the parts before it, a prefix sum
over one record a part.

Rows are range-partitioned by doc_id, the first 64 characters and the row's number within its input partition (so that
rows which repeat an id, even equal ones, fill as many parts as they need) and sorted inside each part by Spark, then streamed to the files: of a part, only
its ids and sizes are held. A vocabulary too large for the width of the integers is refused. A part is written under a temporary name and renamed, so a repeated task gives the same file again.

Defined cases: a null text is empty (the end id alone); null doc_ids come first; repeated doc_ids follow each other in
the order of their first 64 characters; an empty table gives no part; other columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import lean_batches, scratch, table
from offerloom.llm.files import FileSet
from offerloom.llm.subword import encoder, runs, tokenizer_path

ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
PARTS = "part int, docs long, tokens long"


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, bits: int = 16) -> list[tuple[int, int, int, int]]:
    """Writes all documents; returns (part, base, docs, tokens) in order. The list has a record for each part only."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, kind = encoder(path), np.asarray([end_id], "<u4"), np.dtype(f"<u{bits // 8}")
        if max(end_id, enc.lib.get_vocab_size(with_added_tokens=True) - 1) >> bits:
            raise ValueError(f"the ids of {path} need more than {bits} bits")
        part, files = TaskContext.get().partitionId(), FileSet(folder)
        ids_of, sizes = [], []
        with files.writing(f"part-{part:06d}.bin") as out:
            for batch in runs(batches):
                ids, offsets = enc.many(batch.column(1))
                out.write(np.insert(ids, offsets[1:], end).astype(kind).tobytes())
                ids_of += batch.column(0).to_pylist()
                sizes += (np.diff(offsets) + 1).tolist()
        if not ids_of:
            files.remove(f"part-{part:06d}.bin")
            return
        with files.writing(f"part-{part:06d}.idx") as out:
            n = len(ids_of)
            out.write(np.asarray([n], "<i8").tobytes())
            out.write(np.asarray([d or 0 for d in ids_of], "<i8").tobytes())
            out.write(np.asarray([d is not None for d in ids_of], "u1").tobytes())
            out.write(np.concatenate([[0], np.cumsum(sizes)]).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": pa.array([n]), "tokens": pa.array([sum(sizes)])})

    lean_batches(docs.sparkSession)
    order = ["doc_id", "head", "nth"]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.substring("text", 1, 64).alias("head"), F.monotonically_increasing_id().alias("nth"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    parts = sorted((r.part, r.docs, r.tokens) for r in dealt.mapInArrow(write, PARTS).collect())
    bases = itertools.accumulate((t for _, _, t in parts), initial=0)
    return [(p, base, d, t) for (p, d, t), base in zip(parts, bases)]


def read_token_files(spark: SparkSession, folder: str, parts: list[tuple[int, int, int, int]], bits: int = 16) -> DataFrame:
    """A row for each document, from the memory-mapped files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, kind = FileSet(folder), np.dtype(f"<u{bits // 8}")
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.mapped(f"part-{part:06d}.idx") as raw:
                    n = int(np.frombuffer(raw, "<i8", 1)[0])
                    doc_ids = np.frombuffer(raw, "<i8", n, 8).copy()
                    valid = np.frombuffer(raw, "u1", n, 8 + 8 * n).astype(bool)
                    offsets = np.frombuffer(raw[8 + 9 * n : 16 + 17 * n], "<i8").copy()
                with files.mapped(f"part-{part:06d}.bin") as raw:
                    ids = np.frombuffer(raw, kind)
                    for a in range(0, n, 20_000):
                        b = min(n, a + 20_000)
                        crc = [zlib.crc32(ids[offsets[i] : offsets[i + 1]].astype("<u4")) for i in range(a, b)]
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], mask=~valid[a:b]), pa.array(base + offsets[a:b]), pa.array(np.diff(offsets[a : b + 1])), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    del ids

    if not parts:
        return spark.createDataFrame([], ROWS)
    listed = spark.createDataFrame([(p, base) for p, base, _, _ in parts], "part int, base long")
    return listed.repartitionByRange(len(parts), "part").mapInArrow(read, ROWS)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    parts = write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, folder, parts)


QUERIES = {"op5_token_files": op5_token_files}
SQL: dict[str, str] = {}
