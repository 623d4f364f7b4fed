"""Exact deduplication behind static binary-fuse filters.

Rows arrive in batches. Each batch that has been taken in is an immutable snapshot: its exact buckets (one for each new digest)
and, shard by shard, a static binary-fuse filter over their digests. The digests of an incoming batch are screened by the
filters of all snapshots; those that a filter lets pass are looked up in that snapshot's exact buckets, and the rest, which are
certainly new, are grouped among themselves and become the next snapshot. Whoever shares a digest with a bucket is checked byte
by byte against the bucket's first text, so a digest alone never decides.

Filters are sharded by digest and meet the incoming digests shard by shard; nothing is broadcast. Groups of any size meet in
joins that can be split and in aggregates with partial sums.

Defined results: null and blank texts normalise to the empty text and are equal. Of equal texts the one with the most code
points in the original stays, then the smallest doc_id; a null doc_id comes last, and rows without one are kept or go together.
Repeated doc_ids are rows of their own. An empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import discard, drop_rows, id_and_text, id_hash, materialise, mix64, passes, read_table, screen_of, split_rows

#: Digests of one filter shard, about; small tables have SHARDS shards all the same.
SHARD_KEYS = 500_000
SHARDS = 32
#: Batches that op9 deals the table into: all but the last have become snapshots when the last one comes.
BATCHES = 3
#: Rows of a bucket that meet a copy of its first text in one part.
PART_ROWS = 512
#: Stands for a bucket all of whose doc_ids are null.
NO_ID = -(1 << 63)


# The filter: three cells in consecutive segments for each key, one byte a cell.


def _cells(keys: np.ndarray, seed: int, bits: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(keys + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    g = mix64(h)
    mask = np.uint64((1 << bits) - 1)
    cells = np.stack([((first + np.uint64(i)) << np.uint64(bits)) + ((g >> np.uint64(20 * i)) & mask) for i in range(3)])
    return cells.astype(np.int64), (h & np.uint64(255)).astype(np.uint8) ^ (g >> np.uint64(56)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> bytes:
    """A static filter of about 9 to 10 bits a key over different 64-bit keys: no false negatives, 1 in 256 false positives."""
    n = len(keys)
    bits = max(2, min(18, math.floor(math.log(max(n, 2)) / math.log(3.33) + 1.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 4)))
    segments = max(1, math.ceil(n * factor / (1 << bits)) - 2 + (n < 1000) * 2)
    for seed in range(1, 200):
        cells, prints = _cells(keys, seed, bits, segments)
        size = (segments + 2) << bits
        count = np.bincount(cells.ravel(), minlength=size)
        index = np.tile(np.arange(n, dtype=np.int64), 3)
        total = np.zeros(size, np.int64)
        np.add.at(total, cells.ravel(), index)
        rounds, open_cells, left = [], np.flatnonzero(count == 1), n
        while len(open_cells):
            key, at = np.unique(total[open_cells], return_index=True)
            rounds.append((key, open_cells[at]))
            left -= len(key)
            gone = cells[:, key].ravel()
            np.subtract.at(count, gone, 1)
            np.subtract.at(total, gone, np.tile(key, 3))
            gone = np.unique(gone)
            open_cells = gone[count[gone] == 1]
        if not left:
            table = np.zeros(size, np.uint8)
            for key, cell in reversed(rounds):
                a, b, c = table[cells[:, key]]
                table[cell] = prints[key] ^ a ^ b ^ c  # the key's own cell still holds 0
            return struct.pack("<III", seed, bits, segments) + table.tobytes()
        segments += 1 + segments // 50
    raise ValueError("keys repeat")


def query_filter(content: bytes, keys: np.ndarray) -> np.ndarray:
    seed, bits, segments = struct.unpack_from("<III", content)
    table = np.frombuffer(content, np.uint8, offset=12)
    cells, prints = _cells(keys, seed, bits, segments)
    a, b, c = table[cells]
    return (a ^ b ^ c) == prints


# Rows and snapshots.


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def text_digest(text: Column) -> Column:
    return F.sha2(normalised(F.coalesce(text, F.lit(""))), 256)


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, digest (sha256 of the normalised text, hexadecimal), n_points (code points of the original)."""
    d = id_and_text(docs)
    return d.select("doc_id", text_digest(F.col("text")).alias("digest"), F.length("text").cast("long").alias("n_points"))


def _key() -> Column:
    """64 bits of the digest, as the filters take them."""
    return F.xxhash64("digest")


@dataclass
class Snapshots:
    """The snapshots taken in so far: exact buckets (snapshot, digest, bucket) and filters (snapshot, shard, content)."""

    shards: int
    buckets: list[DataFrame] = field(default_factory=list)
    filters: list[DataFrame] = field(default_factory=list)

    def shard(self) -> Column:
        return F.pmod(F.hash("digest"), F.lit(self.shards)).cast("int")

    def add(self, buckets: DataFrame) -> None:
        """Freeze buckets (digest, bucket) as the next snapshot and build its filters."""
        k = len(self.buckets)
        frozen = materialise(buckets.select(F.lit(k).alias("snapshot"), "digest", "bucket"), "buckets")
        self.buckets.append(frozen)

        def build(table):
            import pyarrow as pa

            keys = np.unique(table.column("key").to_numpy()).view(np.uint64)
            return pa.table({"snapshot": pa.array([k], pa.int32()), "shard": table.column("shard").slice(0, 1), "content": pa.array([build_filter(keys)], pa.binary())})

        keyed = frozen.select(self.shard().alias("shard"), _key().alias("key"))
        self.filters.append(materialise(keyed.groupBy("shard").applyInArrow(build, "snapshot int, shard int, content binary"), "filters"))

    def screen(self, rows: DataFrame) -> DataFrame:
        """digest and snapshot for each different digest of rows that a snapshot's filter lets pass."""
        filters = self.filters[0]
        for f in self.filters[1:]:
            filters = filters.unionAll(f)

        def look(left, right):
            import pyarrow as pa

            digests, keys = left.column("digest"), left.column("key").to_numpy().view(np.uint64)
            out = [pa.table({"digest": pa.array([], pa.string()), "snapshot": pa.array([], pa.int32())})]
            for k, content in zip(right.column("snapshot").to_pylist(), right.column("content").to_pylist(), strict=True) if len(keys) else ():
                passed = digests.filter(pa.array(query_filter(content, keys))).cast(pa.string())
                out.append(pa.table({"digest": passed, "snapshot": pa.array([k] * len(passed), pa.int32())}))
            return pa.concat_tables(out)

        incoming = rows.select("digest").distinct().select("digest", self.shard().alias("shard"), _key().alias("key"))
        return incoming.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(look, "digest string, snapshot int")

    def lookup(self, rows: DataFrame) -> DataFrame:
        """digest and bucket for each digest of rows that a snapshot has."""
        buckets = self.buckets[0]
        for b in self.buckets[1:]:
            buckets = buckets.unionAll(b)
        return self.screen(rows).join(buckets, ["digest", "snapshot"]).select("digest", "bucket")


def assign(batches: list[DataFrame], snapshots: Snapshots) -> DataFrame:
    """The bucket of every digest: digest, bucket (a row of the first batch that has the digest, the smallest)."""
    for i, batch in enumerate(batches):
        new = batch.groupBy("digest").agg(F.min("doc_id").alias("bucket"))
        if i:
            new = new.join(snapshots.lookup(batch).select("digest"), "digest", "left_anti")
        snapshots.add(new)
    out = snapshots.buckets[0]
    for b in snapshots.buckets[1:]:
        out = out.unionAll(b)
    return out.select("digest", "bucket")


def differing(docs: DataFrame, rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows that share a digest but not the bytes of the bucket's own text: doc_id, bucket, own (the smallest doc_id of their text).

    rows: doc_id, digest of every row. shared: digest, bucket, n (rows) of digests that several rows have. Texts of other rows stay
    where they are read, but for those that the screen of members lets pass by chance. A bucket's first text goes to one part for
    each PART_ROWS of its rows, so that many copies of a text do not meet in one task."""
    screen = materialise(screen_of(rows.join(shared, "digest"), id_hash(F.col("doc_id"))), "screen")
    d = id_and_text(docs).join(F.broadcast(screen), passes(F.col("doc_id")), "left_semi").select("doc_id", normalised(F.col("text")).alias("norm"))
    d = d.withColumn("digest", F.sha2("norm", 256)).join(shared, "digest")
    parts = F.ceil(F.col("n") / F.lit(PART_ROWS)).cast("int")
    d = d.select("bucket", "doc_id", "norm", parts.alias("parts"), F.pmod(F.xxhash64("doc_id", "norm"), parts).cast("int").alias("part"))
    texts = materialise(d, "same-digest")
    first = texts.where("doc_id = bucket").groupBy("bucket").agg(F.min("norm").alias("first_norm"), F.first("parts").alias("parts"))
    first = materialise(first.select("bucket", "first_norm", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "first-texts")
    other = texts.join(first, ["bucket", "part"]).where("norm <> first_norm").select("bucket", "doc_id", "norm")
    own = other.groupBy("bucket", "norm").agg(F.min("doc_id").alias("own"))
    out = materialise(other.join(own, ["bucket", "norm"]).select("doc_id", "bucket", "own"), "differing")
    discard(screen, texts, first)
    return out


def exact_duplicates(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialise(digest_rows(docs), "digests")
    shards = max(SHARDS, math.ceil(rows.count() / SHARD_KEYS))
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    snapshots = Snapshots(shards)
    buckets = materialise(assign([rows.where(turn == i) for i in range(batches)], snapshots), "digest-buckets")
    discard(*snapshots.buckets, *snapshots.filters)
    # A digest of one row has nothing to be checked against.
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialise(buckets.join(sizes, "digest").select("digest", "bucket", "n"), "shared-digests")
    odd = differing(docs, rows, shared)
    placed = rows.join(buckets, "digest")
    if odd.isEmpty():
        placed = placed.withColumn("own", F.col("bucket"))
    else:
        placed = placed.join(odd.dropDuplicates(["doc_id", "bucket"]), ["doc_id", "bucket"], "left").withColumn("own", F.coalesce("own", "bucket"))
    # The group's key is hashed anew, so that rows are aggregated where they are before a group's sums meet.
    placed = placed.select("doc_id", "digest", "n_points", F.xxhash64("own", "digest").alias("key"), "own")
    # Written, so that the join reads both sides from a shuffle and a large group can be split there.
    longest = F.max(F.struct("n_points", (-F.col("doc_id")).alias("neg"))).alias("best")
    best = materialise(placed.groupBy("key", F.coalesce("own", F.lit(NO_ID)).alias("own")).agg(longest, F.count(F.lit(1)).alias("group_size")), "groups")
    placed = placed.withColumn("own", F.coalesce("own", F.lit(NO_ID)))
    keep = -F.col("best.neg")
    return placed.join(best, ["key", "own"]).select("doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("digest").alias("text_sha256"))


def without_copies(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row of each group of equal texts, with all its columns: the one that exact_duplicates() keeps. Rows are told apart by doc_id
    and text, so a text of its own stays whatever other texts its doc_id has. Of rows that are kept with the same doc_id the
    one with the most code points stays, then the first by its text."""
    gone = exact_duplicates(docs, batches).where("not kept").select("doc_id", F.col("text_sha256").alias("digest"))
    return drop_repeated_ids(drop_rows(docs, gone, {"digest": text_digest(F.col("text"))}))


def drop_repeated_ids(docs: DataFrame) -> DataFrame:
    """Of rows with the same doc_id and equal texts one: that with the most code points, then the first by its text."""
    ids = id_and_text(docs).select("doc_id", text_digest(F.col("text")).alias("digest"))
    several = materialise(ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("digest").alias("d")).where("n > d").select("doc_id"), "repeated-ids")
    if several.isEmpty():
        return docs
    rest, again = split_rows(docs, several)
    key = [F.col("doc_id"), text_digest(F.col("text"))]
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(F.length(F.coalesce("text", F.lit("")))), "text"))
    return rest.unionByName(again.withColumn("own place", first).where("`own place` = 1").select(docs.columns))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """For every document the one that stays of its group of equal texts."""
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


#: The same rows in SQL.
OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents
), g AS (
  SELECT doc_id, h, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size
  FROM d WINDOW w AS (PARTITION BY h ORDER BY length(t) DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""
