"""Token ids as directly addressable codes: random access to any token without decoding a block.

An id is split into chunks of eight bits.  Level 0 holds the low chunk of every id, level k the k-th chunk of the ids
that need one; a bitmap per level says which ids continue, and a rank directory (ones before each 512-bit block)
turns a position in one level into its position in the next.  Reading token i touches one chunk per level.

File format.  ``write`` produces Parquet files, each row one segment of at most ``segment_tokens`` ids (or one longer
document): ``part, seq, first_token, n_tokens, doc_ids, lengths, codes``.  ``first_token`` counts the ids before it
in its part; parts are ranges of ``doc_id`` in ascending order, and only one total per part (as many as files) is
summed to find where a part starts.  ``doc_ids`` and ``lengths`` are little-endian arrays, ``codes`` is:
``u32 levels, u64 n`` and per level ``u64 count``, chunks (count bytes), bitmap (64-bit words), directory (u32).

At scale: one range exchange of the texts by ``doc_id`` (whole order is the contract), then everything is a stream
over Arrow batches with one segment in memory.  Segments are written to the shared folder, so reading starts from
files, not from recomputed tokens.

Null or empty text: the end id alone.  Null ``doc_id``: first, as one more id.  Repeated rows: in order, one entry
each.  Empty table: no segments, no rows.  Ids up to 2^32 - 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, shared_dir, shuffle_parts, text_bytes
from .tokens import encoder

BLOCK = 512
PART_BYTES = 32 << 20
SEGMENT_TOKENS = 1 << 20
NULL_ID = -(1 << 63)
SEGMENT = ("part int, seq int, first_token long, n_tokens long, doc_ids binary, lengths binary, codes binary")


def encode(ids: np.ndarray) -> bytes:
    """Directly addressable codes of unsigned 32-bit ids."""
    left, out, n = ids.astype(np.uint32), [], len(ids)
    while True:
        more = left > 0xFF
        bits = np.zeros(-(-max(len(left), 1) // BLOCK) * BLOCK, bool)
        bits[:len(left)] = more
        ones = bits.reshape(-1, BLOCK).sum(axis=1)
        rank = np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u4")
        out += [np.uint64(len(left)).tobytes(), (left & np.uint32(0xFF)).astype(np.uint8).tobytes(),
                np.packbits(bits, bitorder="little").tobytes(), rank.tobytes()]
        left = left[more] >> np.uint32(8)
        if not len(left):
            break
    return np.uint32(len(out) // 4).tobytes() + np.uint64(n).tobytes() + b"".join(out)


class Codes:
    """Reads tokens out of ``encode``'s bytes, any position or run, through bitmaps and rank directories."""

    def __init__(self, data: bytes):
        levels, self.n = int(np.frombuffer(data, "<u4", 1)[0]), int(np.frombuffer(data, "<u8", 1, 4)[0])
        at, self.levels = 12, []
        for _ in range(levels):
            count = int(np.frombuffer(data, "<u8", 1, at)[0])
            blocks = -(-max(count, 1) // BLOCK)
            at += 8
            chunk = np.frombuffer(data, np.uint8, count, at)
            at += count
            bitmap = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at)
            at += len(bitmap)
            rank = np.frombuffer(data, "<u4", blocks, at)
            at += 4 * blocks
            self.levels.append((chunk, bitmap, rank))

    @staticmethod
    def _rank(bitmap: np.ndarray, rank: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = i // BLOCK
        before = rank[np.minimum(block, len(rank) - 1)].astype(np.int64)
        lanes = bitmap.reshape(-1, BLOCK // 8)[np.minimum(block, len(rank) - 1)]
        full = (i % BLOCK)[:, None] - np.arange(0, BLOCK, 8)
        mask = np.where(full >= 8, 255, np.where(full > 0, (1 << np.clip(full, 0, 8)) - 1, 0)).astype(np.uint8)
        return before + np.bitwise_count(lanes & mask).sum(axis=1, dtype=np.int64)

    def take(self, i: np.ndarray) -> np.ndarray:
        """Tokens at any positions, one chunk per level each."""
        i = np.asarray(i, np.int64)
        if len(i) and (i.min() < 0 or i.max() >= self.n):
            raise IndexError("token position out of range")
        out, which = np.zeros(len(i), np.uint32), np.arange(len(i))
        for level, (chunk, bitmap, rank) in enumerate(self.levels):
            if not len(i):
                break
            out[which] |= chunk[i].astype(np.uint32) << np.uint32(8 * level)
            on = (bitmap[i >> 3] >> (i & 7).astype(np.uint8)) & 1 == 1
            which, i = which[on], self._rank(bitmap, rank, i[on])
        return out

    def run(self, start: int, stop: int) -> np.ndarray:
        """Tokens start..stop-1: one rank lookup per level, then contiguous chunks."""
        if not 0 <= start <= stop <= self.n:
            raise IndexError("token range out of range")
        out, which = np.zeros(stop - start, np.uint32), np.arange(stop - start)
        for level, (chunk, bitmap, rank) in enumerate(self.levels):
            if start >= stop:
                break
            out[which] |= chunk[start:stop].astype(np.uint32) << np.uint32(8 * level)
            byte = start >> 3
            on = np.unpackbits(bitmap[byte:(stop + 7) >> 3], bitorder="little")[start - 8 * byte:][:stop - start] == 1
            first = int(self._rank(bitmap, rank, np.array([start]))[0])
            which = which[on]
            start, stop = first, first + len(which)
        return out


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = 0, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode all documents in ascending ``doc_id`` order and write the segment files under ``path``."""
    spark = docs.sparkSession
    ready(spark)
    parts = shuffle_parts(spark, text_bytes(docs), PART_BYTES)
    # the text's hash lets the rows of one id (or of none) spread over parts
    ordered = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
               .repartitionByRange(parts, "doc_id", F.xxhash64("text"))
               .sortWithinPartitions("doc_id", F.xxhash64("text"), "text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end, part = encoder(vocabulary), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        seq, first, held, ids, docs_ = 0, 0, 0, [], []

        def segment() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(ids), "<u4")
            lengths = np.array([len(x) // 4 for x in ids], "<i8")
            row = (part, seq, first, len(tokens), np.array(docs_, "<i8").tobytes(), lengths.tobytes(), encode(tokens))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)],
                                              names=[c.split()[0] for c in SEGMENT.split(", ")])

        for batch in batches:
            for doc, own in zip(batch.column(0).to_pylist(), enc.stream(batch.column(1).to_pylist())):
                if held >= segment_tokens:
                    yield segment()
                    seq, first, held, ids, docs_ = seq + 1, first + held, 0, [], []
                ids.append(own + end)
                docs_.append(NULL_ID if doc is None else doc)
                held += len(ids[-1]) // 4
        if ids:
            yield segment()

    ordered.mapInArrow(build, SEGMENT).write.parquet(path)


def checksums(codes: Codes, size: np.ndarray) -> list[int]:
    """Checksum of the ids of each document of a segment, which is decoded once."""
    ids = memoryview(codes.run(0, codes.n).astype("<u4").tobytes())
    ends = np.concatenate(([0], 4 * np.cumsum(size))).tolist()
    return [zlib.crc32(ids[a:b]) for a, b in zip(ends, ends[1:])]


def read(segments: DataFrame) -> DataFrame:
    """One row per document from the files: where its ids start, how many, and their checksum."""
    spark = segments.sparkSession
    ready(spark)
    # one row per part (a file): bounded by the number of files, not by the data
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, first, doc_ids, lengths, data in zip(*(c.to_pylist() for c in batch.columns)):
                docs_, size = np.frombuffer(doc_ids, "<i8"), np.frombuffer(lengths, "<i8")
                at, crc = np.concatenate(([0], np.cumsum(size))), checksums(Codes(data), size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs_, pa.int64(), mask=docs_ == NULL_ID), pa.array(at[:-1] + base + first, pa.int64()),
                     pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return (segments.join(F.broadcast(before), "part").select("base", "first_token", "doc_ids", "lengths", "codes")
            .mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write the files to the shared folder and report every document from what was read back."""
    path = shared_dir(docs.sparkSession, "token-codes")
    write(docs, vocabulary, path, end_id)
    return read(docs.sparkSession.read.schema(SEGMENT).parquet(path))
