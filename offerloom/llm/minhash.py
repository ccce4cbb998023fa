"""Operator 7, near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

1. Each document's set of word shingles becomes sorted 64-bit hashes; one pass deals them into bins by range and keeps
   each bin's least, and an empty bin borrows from a bin that a hash of (bin, attempt) picks. Rows of bins give bands.
2. Documents with equal sets are one class from here on, represented by the least doc_id.
3. A bucket's candidates are stars: its least and its greatest representative against all others, so the number of
   pairs follows the number of bucket entries. Each pair is confirmed on full sets.
4. What a star may miss (members alike, but unlike both centres) is settled afterwards. In a bucket whose members are
   still in several components, the largest component is host and the members of others are its guests; every guest is
   compared with all the host's members and with its fellow guests, inside tasks that hold a share of either; a task gives
   the links of a spanning forest of what it holds, so rows follow its members and not their pairs. Then each two members
   of a bucket are in one component or have been compared.

A pair at the threshold of 0.8 escapes all 42 bands of 6 rows with probability 3e-6, a closer pair less often.

Defined cases: null and blank texts have no set, link with nothing and are kept; a null doc_id links with nothing, has
a null component and is kept; rows that repeat a doc_id are one node; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import lean_batches, table, written

ROWS, BANDS = 6, 42
#: Members that meet one copy of their centre's text at most, so that a hot centre's checks spread over tasks.
STAR_SHARE = 256
#: Distinct words whose hashes a worker remembers.
WORD_LIMIT = 150_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(lowered: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; with fewer words, the whole sequence is the one shingle."""
    found = lowered.split()  # on bytes: exactly the ASCII white space
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation minima with optimal densification."""
    edges = np.arange(bins, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // bins + 1)
    at = np.searchsorted(hashes, edges)
    ends = np.append(at[1:], len(hashes))
    out = hashes[np.minimum(at, len(hashes) - 1)]
    full = at < ends
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):
        tries = np.arange(attempt, attempt + 32, dtype=np.uint64)
        picks = (mixed(empty.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + mixed(tries + np.uint64(1))[None, :]) % np.uint64(bins)).astype(np.int64)
        good = full[picks]
        first = good.argmax(1)
        hit = good[np.arange(len(empty)), first]
        out[empty[hit]] = out[picks[hit, first[hit]]]
        empty, attempt = empty[~hit], attempt + 32
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit bucket key for each band."""
    grid = sig.reshape(-1, rows)
    key = mixed(np.arange(1, len(grid) + 1, dtype=np.uint64))
    for k in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, words: int, rows: int, bands: int) -> DataFrame:
    """doc_id, size of the set, a fingerprint of the whole set, and bucket keys (null without a set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, keys = [], [], []
            for text in batch.column(1):
                found = shingle_set((text.as_py() or "").encode().lower(), words)
                sizes.append(len(found))
                prints.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(band_keys(signature(found, rows * bands), rows) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "print", "keys"])
        _hashes.clear()  # a worker goes on to other operators

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, n_shingles long, print binary, keys array<long>")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and the lower-cased text, compressed for the way."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.compress((t.as_py() or "").encode().lower()) for t in batch.column(1)], pa.binary())], ["doc_id", "body"])

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(squeeze, "doc_id long, body binary")


def alike(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(one), len(other)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


def compared(rows: DataFrame, bodies: DataFrame, words: int, percent: int, every: bool) -> DataFrame:
    """Links (a, b) between the rows of role 1 and those of role 0 with the same (lead, share); rows: lead, share, role, doc_id.

    The sets of role 0 are held, those of role 1 streamed. every: the links of a row to all components that the task has
    found so far among its rows (a spanning forest), else a row's first link is enough.
    """
    met = rows.join(bodies, "doc_id").repartition("lead", "share").sortWithinPartitions("lead", "share", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, now, held, above = zstandard.ZstdDecompressor(), None, [], {}

        def top(x: int) -> int:
            while x in above:
                above[x] = x = above.get(above[x], above[x])
            return x

        for batch in batches:
            out: list[tuple[int, int]] = []
            for lead, share, role, doc, body in zip(*(batch.column(k).to_pylist() for k in ("lead", "share", "role", "doc_id", "body"))):
                found = shingle_set(d.decompress(body), words)
                if (lead, share) != now:
                    now, held, above = (lead, share), [], {}
                if role == 0:
                    held.append((doc, found))
                    continue
                for other, its in held:
                    if top(other) != top(doc) and alike(found, its, percent):
                        out.append((other, doc))
                        if not every:
                            break
                        above[top(doc)] = top(other)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[], []])], ["a", "b"])
        _hashes.clear()

    return met.mapInArrow(compare, "a long, b long")


def confirmed(pairs: DataFrame, bodies: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (centre, member) whose full sets reach the similarity; bodies: compressed texts by doc_id."""
    shares = pairs.groupBy("centre").agg(F.ceil(F.count("*") / STAR_SHARE).cast("long").alias("shares"))
    dealt = pairs.join(shares.selectExpr("centre ^ 1 as at", "shares"), F.expr("(centre ^ 1) = at"))
    rows = dealt.selectExpr("centre as lead", "pmod(xxhash64(member), shares) as share", "1 as role", "member as doc_id").union(shares.selectExpr("centre", "explode(sequence(0L, shares - 1))", "0", "centre"))
    return compared(rows, bodies, words, percent, every=False)


def guest_links(shared: DataFrame, found: DataFrame, bodies: DataFrame, words: int, percent: int) -> DataFrame:
    """Links that the stars missed, in buckets whose members are in several components; shared: (bucket, rep, size)."""
    named = found.selectExpr("node ^ 1 as at", "component")
    labelled = shared.where("size > 3").join(named, F.expr("(rep ^ 1) = at"), "left").selectExpr("bucket", "rep", "coalesce(component, rep) as component")
    split = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").selectExpr("bucket ^ 1 as at")
    left = labelled.join(split, F.expr("(bucket ^ 1) = at"), "left_semi")
    sizes = found.groupBy("component").agg(F.count("*").alias("members")).selectExpr("component ^ 1 as at", "members")
    left = written(left.join(sizes, F.expr("(component ^ 1) = at"), "left").selectExpr("bucket", "rep", "component", "coalesce(members, 1L) as members"), "split-buckets")
    hosts = left.groupBy("bucket").agg(F.max(F.struct("members", (-F.col("component")).alias("c"))).alias("x")).selectExpr("bucket ^ 1 as at", "-x.c as host", "x.members as members")
    guests = written(left.select("bucket", "rep", "component").join(hosts, F.expr("(bucket ^ 1) = at")).where("component <> host").select("host", "members", F.col("rep").alias("guest")).distinct(), "guests")
    # a grid for each host: a task holds a share of the guests and streams a share of the host's members and of the guests
    grid = guests.groupBy("host").agg(F.ceil((F.max("members") + F.count("*")) / STAR_SHARE).cast("long").alias("rows"), F.ceil(F.count("*") / STAR_SHARE).cast("long").alias("cols"))
    parties = written(grid, "hosts")
    by_host = parties.selectExpr("host ^ 1 as at", "rows", "cols")
    joined = guests.join(by_host, F.expr("(host ^ 1) = at")).select("host", "guest", "rows", "cols")
    family = found.selectExpr("component as host", "node as member").union(parties.selectExpr("host", "host")).distinct().join(by_host, F.expr("(host ^ 1) = at")).select("host", "member", "rows", "cols")
    held = joined.selectExpr("host as lead", "explode(transform(sequence(0L, rows - 1), i -> i * cols + pmod(xxhash64(guest), cols))) as share", "0 as role", "guest as doc_id")
    rows = held.union(joined.union(family).selectExpr("host", "explode(transform(sequence(0L, cols - 1), j -> pmod(xxhash64(guest, 7), rows) * cols + j))", "1", "guest"))
    return compared(rows, bodies, words, percent, every=True)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, by passing least labels on and jumping along them.

    Each round is a written table; only counts reach the driver.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        told = both.join(labels, F.expr("(a ^ 1) = (node ^ 1)")).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("told"))
        lower = labels.join(told, "node").select("node", F.least("component", "told").alias("mid"), F.col("component").alias("before"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        after = written(lower.join(jump, F.expr("(mid ^ 1) = (via ^ 1)"), "left").select("node", F.least("mid", F.coalesce("far", "mid")).alias("component"), "before"), "labels")
        labels = after.select("node", "component")
        if after.where("component < before").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs."""
    lean_batches(docs.sparkSession)
    signed = written(signatures(docs, words, rows, bands), "signatures")
    classes = written(signed.where("print is not null and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep")), "classes")
    reps = signed.join(classes.select(F.col("print").alias("p"), "rep"), F.expr("print = p and doc_id = rep")).select("rep", "keys")
    members = reps.select("rep", F.explode("keys").alias("bucket")).distinct()
    stars = members.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("size")).where("low <> high")
    stars = written(stars.withColumn("at", F.expr("bucket ^ 1")).drop("bucket"), "stars")
    shared = written(members.join(stars, F.expr("(bucket ^ 1) = at")).select("bucket", "rep", "low", "high", "size"), "buckets")
    if shared.isEmpty():
        return _result(signed, classes, None)
    bodies = written(_packed(docs).join(shared.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "bodies")
    pairs = shared.select(F.col("low").alias("centre"), F.col("rep").alias("member")).union(shared.select(F.col("high"), F.col("rep"))).where("centre <> member")
    found = components(confirmed(written(pairs.distinct(), "pairs"), bodies, words, percent))
    late = written(guest_links(shared.select("bucket", "rep", "size"), found, bodies, words, percent), "late-links")
    if late.isEmpty():
        return _result(signed, classes, found)
    # late links join whole components: what is left to connect is the graph of their names
    at = found.selectExpr("node ^ 1 as at", "component")
    ends = late.join(at, F.expr("(a ^ 1) = at"), "left").selectExpr("coalesce(component, a) as a", "b")
    ends = ends.join(at, F.expr("(b ^ 1) = at"), "left").selectExpr("a", "coalesce(component, b) as b")
    over = written(components(ends), "joined-components")
    nodes = found.union(over.selectExpr("node", "node")).distinct().groupBy("node").agg(F.min("component").alias("component"))
    after = nodes.join(over.selectExpr("node ^ 1 as at", "component as over"), F.expr("(component ^ 1) = at"), "left").selectExpr("node", "coalesce(over, component) as component")
    return _result(signed, classes, written(after, "components"))


def _result(signed: DataFrame, classes: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        named = classes.select(F.col("print").alias("p"), F.col("rep").alias("component"))
    else:
        named = classes.join(found, classes["rep"] == found["node"], "left").select(F.col("print").alias("p"), F.coalesce("component", "rep").alias("component"))
    return (
        signed.select("doc_id", "n_shingles", "print")
        .join(named, (F.hex("print") == F.hex("p")) & F.col("doc_id").isNotNull(), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op7_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


QUERIES = {"op7_minhash_near_dups": op7_minhash_near_dups}
SQL: dict[str, str] = {}
