"""Best-fit packing of documents into token sequences (vector best fit).

Every open sequence has three residual capacities: tokens, documents and attention cost (the sum of squared piece
lengths).  A piece goes, longest first, to the open sequence that fits under all three and scores best, by the
weighted dot product of demand and residual or by the smallest weighted norm of what would be left; else it opens
a new one.

At scale: tokenizing is map-only and keeps per piece only its length and checksum.  Pieces are dealt round robin
into shards of a fixed number of documents; each shard packs in one task, so the tasks grow in number, not in size,
and the loss against one global packing is at most the last open sequences of each shard.  A piece that fills a
sequence takes one alone.  Nothing is joined, and a lost task is repeated with the same result (the deal depends on
the scan only).

Null or empty texts: the end id alone, one piece.  Null ``doc_id``: kept.  Repeated rows: packed row by row.
Empty table: no rows.  Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, sliced
from .tokens import PARTS, WORDS, encoder, release

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, shard int")
PACKED = ("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
SHARD_DOCS = 16_384


def pieces(docs: DataFrame, vocabulary: str, capacity: int, shards: int, end_id: int = 1,
           with_ids: bool = False, memos: tuple[int, int] = (WORDS, PARTS)) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens; ``with_ids`` adds the token ids (``ids binary``).

    ``memos``: words and parts that a generation of a worker's memos holds; smaller ones take less memory and more time."""
    ready(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end, turn = encoder(vocabulary, *memos), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        for batch in (part for whole in batches for part in sliced(whole)):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), enc.stream(batch.column(1).to_pylist())):
                ids += end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k:k + 4 * capacity]
                    turn += 1
                    rows.append((doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part), turn % shards)
                                + (part,) * with_ids)
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "shard"]
                if with_ids:
                    kinds, names = [*kinds, pa.binary()], [*names, "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, PIECES + ", ids binary" * with_ids)


def best_fit(length: np.ndarray, capacity: int, max_docs: int, max_cost: int, score: str = "norm",
             weights: tuple[float, float, float] = (1.0, 0.05, 0.1)) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece.  Sequences that can take nothing more are closed."""
    order = np.argsort(-length, kind="stable")
    seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    cap, w = np.array([capacity, max_docs, max_cost], float), np.array(weights)
    left, name = np.empty((64, 3)), np.empty(64, np.int64)
    n_open, n_seq = 0, 0
    smallest = float(length.min()) if len(length) else 0.0
    for i in order:
        need = np.array([length[i], 1.0, float(length[i]) ** 2])
        if (need > cap).any():
            raise ValueError("a piece exceeds the capacities of an empty sequence")
        k = -1
        if n_open:
            room = left[:n_open] - need
            fits = (room >= 0).all(axis=1)
            if fits.any():
                if score == "norm":
                    value = ((room / cap) ** 2) @ w
                elif score == "dot":
                    value = -(left[:n_open] / cap) @ (w * need / cap)
                else:
                    raise ValueError(f"unknown score {score!r}")
                k = int(np.argmin(np.where(fits, value, np.inf)))
        if k < 0:
            if n_open == len(left):
                left, name = np.concatenate([left, np.empty_like(left)]), np.concatenate([name, np.empty_like(name)])
            k, n_open, n_seq = n_open, n_open + 1, n_seq + 1
            left[k], name[k] = cap, n_seq - 1
        seq[i], off[i] = name[k], capacity - left[k, 0]
        left[k] -= need
        if left[k, 0] < smallest or left[k, 1] < 1 or left[k, 2] < smallest ** 2:  # nothing more fits: close
            n_open -= 1
            left[k], name[k] = left[n_open], name[n_open]
    return seq, off


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, max_docs: int = 4096, max_cost: int | None = None,
         score: str = "norm", end_id: int = 1, shard_docs: int = SHARD_DOCS, with_ids: bool = False,
         memos: tuple[int, int] = (WORDS, PARTS)) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    ``max_docs`` pieces and ``max_cost`` attention units at most go to a sequence (default: the square of the
    capacity, which no sequence of one document exceeds).  ``with_ids`` carries the token ids for writing.
    """
    shards = max(1, -(-docs.count() // shard_docs))
    rows = pieces(docs, vocabulary, capacity, shards, end_id, with_ids, memos)
    limit = capacity ** 2 if max_cost is None else max_cost

    def place(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
        release()
        # arrival order after a shuffle is not fixed: sort, so that a repeated task gives the same result
        group = group.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        seq, off = best_fit(group["length"].to_numpy(), capacity, max_docs, limit, score)
        group["sequence_id"], group["offset"] = (int(key[0]) << 32) + seq, off
        return group.drop(columns="shard")

    return rows.groupBy("shard").applyInPandas(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * with_ids
        + "sequence_id long, offset long").select(*[c.split()[0] for c in PACKED.split(", ")], *["ids"] * with_ids)
