"""Exact dedup against immutable snapshots, each screened by static binary-fuse filters.

Texts are equal when they are the same after deleting white space (``[\\x20\\x09-\\x0D]``).  A store is a folder of
snapshots that are never changed.  A snapshot holds, for the texts that were new when its batch came in:

* ``texts``   their normalised bytes with digest and 64-bit key (the exact buckets), zstandard-compressed; those that a
  filter took for older ones lie apart until their bytes are checked, and ``checked`` holds what proved new;
* ``filters`` one binary-fuse filter for each shard of about ``SHARD_KEYS`` keys;
* ``groups``  every distinct text of the batch, also of texts that older snapshots hold (``home``): rows, the row that stays.

``ingest`` takes a batch:

1. one pass digests the texts (SHA-256 of the normalised bytes); the batch's own duplicates are grouped by digest;
2. one key for each distinct text is probed against the filters of all snapshots, shard by shard;
3. texts of one row for each group are fetched.  What no filter knows is new, without looking further.  Positives meet the
   exact buckets of that snapshot on the key, and only equal bytes make them members of an older group; the rest
   (false positives) are new as well;
4. new texts, their filters and the batch's groups become the next snapshot.

At scale: text is shuffled once, by digest and id, so a third of all rows with one text or one id spreads.  Copies are
counted by partial aggregation before any shuffle.  Shards and probe blocks have a fixed size, their number grows with the
data.  In the last join, groups with more than one row in ``HOT`` of all (at most ``HOT`` such groups) are broadcast and all
others are shuffled, so no task gets a large group.  Every step is a table in the shared folder.

Null or empty text: the empty text, equal to one of spaces only.  Null ``doc_id``: the smallest id.  Repeated rows: copies, of
which one stays.  Ties: most code points, smallest id, then any one row.  Empty table: an empty snapshot, no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, shared_dir, stored
from .fuse import Fuse

SHARD_KEYS = 8192
PROBE_KEYS = 4 * SHARD_KEYS
HOT = 4096
SPACE = b" \t\n\v\f\r"
ROWS = "row long, doc_id long, n_chars long, digest binary"
TEXTS = "doc_id long, digest binary, text binary"
BUCKETS = "key long, digest binary, text binary"
FILTERS = "shard int, shards int, seed int, segment int, segments int, prints binary"


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _normal(text: bytes | None) -> bytes:
    return (text or b"").translate(None, SPACE)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [hashlib.sha256(_normal(t.as_py())).digest() for t in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())],
                                         names=["row", "doc_id", "n_chars", "digest"])


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each (id, text) once for a task, so that repeated rows are not fetched by the thousand."""
    seen: set[tuple[int | None, bytes]] = set()
    for batch in batches:
        out = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = _normal(text.as_py())
            own = (doc, hashlib.sha256(text).digest())
            if own not in seen:
                seen.add(own)
                out.append((*own, text))
        cols = list(zip(*out)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.binary()))],
                                         names=["doc_id", "digest", "text"])


def digest_rows(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_chars, digest of every row; ``row`` tells repeated rows apart.  Stored."""
    rows = _plain(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id",
                               F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
                               F.col("text").cast("binary").alias("text"))
    return stored(rows.mapInArrow(_digests, ROWS), "dedup-rows")


def own_groups(rows: DataFrame) -> DataFrame:
    """One row for each distinct text of the batch: rows and the row that stays."""
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), "doc_id", "row")).alias("best")
    return rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("rows")).withColumn("key", F.xxhash64("digest"))


def build_filters(keys: DataFrame, n: int) -> DataFrame:
    """``FILTERS``: one for each shard of the keys (column ``key``)."""
    shards = max(1, -(-n // SHARD_KEYS))

    def build(table: pa.Table) -> pa.Table:
        f = Fuse.build(table["key"].to_numpy().view(np.uint64))
        row = (table["shard"][0].as_py(), shards, f.seed, f.segment, f.segments, f.prints.tobytes())
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds)],
                        names=[c.split()[0] for c in FILTERS.split(", ")])

    return keys.select(_shard(shards), "key").groupBy("shard").applyInArrow(build, FILTERS)


def _shard(shards: int) -> Column:
    return F.pmod("key", F.lit(shards)).cast("int").alias("shard")


def screen(keys: DataFrame, filters: DataFrame, n: int) -> DataFrame:
    """The keys (column ``key``, ``n`` of them) that a filter does not exclude."""
    first = filters.select("shards").first()
    if first is None:
        return keys.select("key").where("false")
    # blocks of a fixed size, also where a large batch meets a small snapshot
    blocks = max(1, -(-n // (first["shards"] * PROBE_KEYS)))
    probes = keys.select(_shard(first["shards"]), F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), "key")
    copies = filters.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def probe(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows or not known.num_rows:
            return pa.table([pa.array([], pa.int64())], names=["key"])
        r = known.to_pylist()[0]
        keys_ = asked["key"].to_numpy()
        f = Fuse(r["seed"], r["segment"], r["segments"], np.frombuffer(r["prints"], np.uint8))
        return pa.table([pa.array(keys_[f.holds(keys_.view(np.uint64))], pa.int64())], names=["key"])

    return (probes.groupBy("shard", "block").cogroup(copies.groupBy("shard", "block"))
            .applyInArrow(probe, "key long"))


@dataclass
class Store:
    """Snapshots in a folder that all executors share, in the order in which they came."""

    spark: SparkSession
    path: str
    size: int = 0

    def part(self, k: int, name: str) -> str:
        return f"{self.path}/snapshot-{k:05d}/{name}"

    def read(self, k: int, name: str) -> DataFrame:
        return self.spark.read.parquet(self.part(k, name))

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Take in a batch as the next snapshot; its rows (``ROWS``)."""
        ready(self.spark)
        me = self.size
        rows = digest_rows(docs)
        groups = stored(own_groups(rows), "dedup-groups")
        n = groups.count()
        keys = groups.select("key")
        positive = reduce(DataFrame.unionByName, [
            screen(keys, self.read(k, "filters"), n).withColumn("snapshot", F.lit(k)) for k in range(me)],
            self.spark.createDataFrame([], "key long, snapshot int"))
        positive = stored(positive, "dedup-positive")
        self._fetch(docs, groups, positive)
        asked = self._fetched(me, True)
        member = stored(self._members(asked, positive), "dedup-members")
        (asked.join(member.select("digest"), "digest", "left_anti").select("key", "digest", "text")
         .write.option("compression", "zstd").parquet(self.part(me, "checked")))
        known = self.texts(me).select("key")
        build_filters(known, known.count()).write.parquet(self.part(me, "filters"))
        (groups.join(member, "digest", "left")
         .select("digest", "best", "rows", F.coalesce("home", F.lit(me)).alias("home"))
         .write.parquet(self.part(me, "groups")))
        self.size = me + 1
        return rows

    def texts(self, k: int) -> DataFrame:
        """The exact buckets of a snapshot: key, digest, normalised text."""
        return self._fetched(k, False).unionByName(self.spark.read.schema(BUCKETS).parquet(self.part(k, "checked")))

    def _fetched(self, k: int, positive: bool) -> DataFrame:
        every = self.spark.read.schema(f"{BUCKETS}, positive boolean").parquet(self.part(k, "texts"))
        return every.where(F.col("positive") == positive).select("key", "digest", "text")

    def _fetch(self, docs: DataFrame, groups: DataFrame, positive: DataFrame) -> None:
        """Write key, digest and normalised text of one row for each group, those of positive keys apart."""
        one = (groups.join(positive.select("key").distinct().withColumn("hit", F.lit(True)), "key", "left")
               .select("key", F.col("digest").alias("d"), F.col("best.doc_id").alias("i"),
                       F.coalesce("hit", F.lit(False)).alias("positive")))
        texts = _plain(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_normalised, TEXTS)
        found = (texts.join(one, (texts["digest"] == one["d"]) & texts["doc_id"].eqNullSafe(one["i"]))
                 .select("key", "digest", "text", "positive"))
        found.write.partitionBy("positive").option("compression", "zstd").parquet(self.part(self.size, "texts"))

    def _members(self, asked: DataFrame, positive: DataFrame) -> DataFrame:
        """digest and home of the asked texts whose very bytes a snapshot holds."""
        none = self.spark.createDataFrame([], "digest binary, home int")
        parts = []
        for k in range(self.size):
            mine = asked.join(positive.where(F.col("snapshot") == k).select("key"), "key", "left_semi")
            bucket = self.texts(k).select("key", F.col("text").alias("held"))
            parts.append(mine.join(bucket, "key").where(F.col("text") == F.col("held"))
                         .select("digest", F.lit(k).alias("home")))
        return reduce(DataFrame.unionByName, parts, none).distinct()

    def totals(self) -> DataFrame:
        """batch, digest, keep_id, keep_batch, keep_row, group_size of every text of every batch.  Stored."""
        groups = [self.read(k, "groups").withColumn("batch", F.lit(k)) for k in range(self.size)]
        every = reduce(DataFrame.unionByName, groups)
        best = F.min(F.struct("best.less", "best.doc_id", "batch", "best.row")).alias("b")
        total = every.groupBy("home", "digest").agg(best, F.sum("rows").alias("group_size"))
        out = every.select("batch", "home", "digest").join(total, ["home", "digest"]).select(
            "batch", "digest", F.col("b.doc_id").alias("keep_id"), F.col("b.batch").alias("keep_batch"),
            F.col("b.row").alias("keep_row"), "group_size")
        return stored(out, "dedup-totals")


def report(batches: list[DataFrame], store: Store) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of every batch."""
    rows = reduce(DataFrame.unionByName, [b.withColumn("batch", F.lit(k)) for k, b in enumerate(batches)])
    totals, on = store.totals(), ["batch", "digest"]
    every = rows.count()
    large = totals.where(F.col("group_size") * HOT > every)  # at most HOT groups, each once for a batch
    marked = rows.join(F.broadcast(large.select(*on, F.lit(True).alias("large"))), on, "left")
    hot = marked.where("large").join(F.broadcast(large), on)
    cold = marked.where("large is null").join(totals.where(F.col("group_size") * HOT <= every), on)
    return hot.unionByName(cold).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        ((F.col("batch") == F.col("keep_batch")) & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, batches: int = 2) -> DataFrame:
    """Take in the documents as so many batches (by a hash of the id), each screened by the snapshots before it."""
    store = Store(docs.sparkSession, shared_dir(docs.sparkSession, "dedup-store"))
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    return report([store.ingest(docs.where(batch == k)) for k in range(batches)], store)


#: The same in DuckDB.
SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
