"""Zip archives of delimited feeds as a data source: executors read the members, no one unpacks them.

There is a partition for each text member of each archive, which streams through decompression and parsing, so neither
the archive nor a member is ever whole in memory or on a disk. Paths are of any file system that Arrow knows (file, hdfs,
s3, gs), and so are folders, of which all .zip files are read. The columns that the feed's specification names, and no
others, leave the reader, and so do only the records in its scope; those left out are counted by reason. A member that
lacks a required column fails before it gives a row.
"""

from __future__ import annotations

import csv
import io
import json
import re
import sys
import zipfile
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from offerloom.sources.feeds import DEFAULT_ALIASES, FeedSpec, MissingColumns

BATCH = 5000
#: Why a record is left out; "ragged": its number of fields is not the header's.
RAGGED, CATEGORY, TITLE, INCOMPLETE = "ragged", "category", "title", "incomplete"


@contextmanager
def opened(path: str, mode: str = "r"):
    """A file of any file system that Arrow knows, to read with seeks or to write."""
    system, at = fs.FileSystem.from_uri(path)
    if mode == "w":
        system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_input_file(at) if mode == "r" else system.open_output_stream(at) as file:
        yield file


def archives_of(path: str) -> list[str]:
    """The path itself, or the .zip files of a folder, in order of name."""
    system, at = fs.FileSystem.from_uri(path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    root = path.rstrip("/")
    return [f"{root}/{f.base_name}" for f in sorted(system.get_file_info(fs.FileSelector(at)), key=lambda f: f.path) if f.base_name.lower().endswith(".zip")]


@dataclass
class Member(InputPartition):
    archive: str
    name: str


class ArchiveReader(DataSourceReader):
    def __init__(self, schema, options):
        self.fields = [f.name for f in schema.fields][4:]
        self.paths = json.loads(options["paths"])
        self.spec = FeedSpec(**json.loads(options["spec"]))

    def partitions(self) -> list[Member]:
        found = []
        for archive in (a for p in self.paths for a in archives_of(p)):
            with opened(archive) as file, zipfile.ZipFile(file) as whole:
                found += [Member(archive, n) for n in whole.namelist() if n.lower().endswith((".csv", ".txt"))]
        return found

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        with opened(partition.archive) as file, zipfile.ZipFile(file) as whole, whole.open(partition.name) as raw:
            records = csv.reader(io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace", newline=""), delimiter=self.spec.sep)
            yield from self.scoped(f"{partition.archive}#{partition.name}", records)

    def scoped(self, member: str, records: Iterator[list[str]]) -> Iterator[pa.RecordBatch]:
        header = [h.strip().lower() for h in next(records, [])]
        aliases = {**DEFAULT_ALIASES, **self.spec.aliases}
        places = {f: [header.index(a.lower()) for a in aliases[f] if a.lower() in header] for f in aliases}
        missing = [f for f in self.spec.required if not places[f]]
        if missing:
            raise MissingColumns(f"{member}: no column for {', '.join(missing)}")
        paths, titles = (re.compile(p) if p else None for p in (self.spec.rejected_paths, self.spec.rejected_titles))
        kept: list[tuple] = []
        left_out: Counter = Counter()
        for line, record in enumerate(records):
            if not record:
                continue
            if len(record) != len(header):
                left_out[RAGGED] += 1
                continue
            values = {f: next((v for k in at if (v := record[k].strip(" "))), None) for f, at in places.items()}
            if paths and paths.search((values["category"] or "").lower()):
                left_out[CATEGORY] += 1
            elif titles and titles.search((values["title"] or "").lower()):
                left_out[TITLE] += 1
            elif values["title"] is None or values["url"] is None:
                left_out[INCOMPLETE] += 1
            else:
                kept.append((member, line, None, 1, *(values[f] for f in self.fields)))
                if len(kept) >= BATCH:
                    yield self.batch(kept)
                    kept = []
        kept += [(member, None, reason, n, *[None] * len(self.fields)) for reason, n in sorted(left_out.items())]
        if kept:
            yield self.batch(kept)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.string()] * len(self.fields)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["member", "line", "reason", "records", *self.fields])


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "offer_archives"

    def schema(self) -> str:
        spec = FeedSpec(**json.loads(self.options["spec"]))
        return "member string, line long, reason string, records long, " + ", ".join(f"`{f}` string" for f in {**DEFAULT_ALIASES, **spec.aliases})

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(schema, self.options)


def read_archives(spark: SparkSession, paths: list[str], spec: FeedSpec) -> DataFrame:
    """(member, line, reason, records, the specification's fields): a row for each record in scope (reason null), and one
    for each member and reason with the number of records left out. line counts a member's records from 0."""
    spark.dataSource.register(ArchiveSource)
    given = asdict(spec) | {"aliases": dict(spec.aliases), "required": list(spec.required)}
    return spark.read.format("offer_archives").option("paths", json.dumps(paths)).option("spec", json.dumps(given)).load()
