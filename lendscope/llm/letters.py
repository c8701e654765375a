"""Questions from every document window to all others, in compact letters.

Looking up each word window of a corpus as a row of its own costs many times the text in shuffle.  Here a part (a hash
range of document keys, some megabytes of text) writes one letter per bucket of hash values: the bucket's window
hashes, back to back.  The bucket answers with one byte per hash in the same order, so positions and ids need not
travel: the part derives the same order again when it reads the answer.

The texts are shuffled once by part; that exchange serves every later step of the same plan.  Parts have a fixed size
whatever the input and buckets grow in number with them, but all uses of one hash meet in one bucket: a passage that a
third of all rows share makes its buckets' letters larger than others, by one hash of four bytes for each use.
Everything is a function of the part's sorted rows, so a lost task is repeated with the same letters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts, text_bytes, word_hashes
from .tokens import release

PART_BYTES = 8 << 20
LETTER = "bucket int, part int, data binary"
_KINDS = (pa.int32(), pa.int32(), pa.binary())
_NAMES = ("bucket", "part", "data")


def parted(docs: DataFrame, part_bytes: int = PART_BYTES) -> tuple[DataFrame, int]:
    """(part, doc_id, text) and the number of parts; rows of one document id share a part."""
    n = shuffle_parts(docs.sparkSession, text_bytes(docs), part_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select(F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(n))
                       .cast("int").alias("part"), "doc_id", "text"), n


def sorted_rows(table: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """Ids and UTF-8 texts of a part in a fixed order."""
    rows = sorted(zip(table["doc_id"].to_pylist(), ((t or "").encode("utf-8", "surrogatepass")
                                                    for t in table["text"].to_pylist())),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return [r[0] for r in rows], [r[1] for r in rows]


def part_words(texts: list[bytes], block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and how many each text has; bounded scratch memory."""
    release()
    out, counts, held, size = [], [], [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            out.append(word_hashes(b" ".join(held)))
        held, size = [], 0

    for t in texts:
        counts.append(len(t.split()))
        if t:
            held.append(t)
            size += len(t)
        if size >= block:
            flush()
    flush()
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.array(counts, np.int64)


def whole_windows(counts: np.ndarray, size: int) -> np.ndarray:
    """Positions (in the part's words) where a window of ``size`` words lies within one text."""
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(int(ends[-1]) if len(ends) else 0)
    return np.flatnonzero(left >= size)


def deal(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts hashes by bucket (stable), and where each bucket starts."""
    # the high half chooses the bucket, so that the low half stays as good a hash within it
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def letters(part: int, buckets: int, edges: np.ndarray, data: Callable[[int, int], bytes]) -> pa.Table:
    """One row for each bucket that gets something; ``data`` packs entries a..b of the dealt order."""
    full = [k for k in range(buckets) if edges[k] < edges[k + 1]]
    cols = (full, [part] * len(full), [data(int(edges[k]), int(edges[k + 1])) for k in full])
    return pa.table([pa.array(c, k) for c, k in zip(cols, _KINDS)], names=list(_NAMES))


def no_letters() -> pa.Table:
    return pa.table([pa.array([], k) for k in _KINDS], names=list(_NAMES))


def read_letters(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, part, data) ordered by bucket and part."""
    rows = sorted(zip(table["bucket"].to_pylist(), table["part"].to_pylist(), table["data"].to_pylist()),
                  key=lambda r: r[:2])
    yield from rows


def answers(mail: DataFrame, answer: Callable[[list[int], list[bytes]], list[bytes | None]]) -> DataFrame:
    """Each bucket reads its letters from all parts and writes one answer to each part (None: nothing to say)."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(read_letters(table))
        out = answer([r[1] for r in rows], [r[2] for r in rows])
        kept = [(b, p, a) for (b, p, _), a in zip(rows, out) if a is not None]
        if not kept:
            return no_letters()
        return pa.table([pa.array(c, k) for c, k in zip(zip(*kept), _KINDS)], names=list(_NAMES))

    return mail.groupBy("bucket").applyInArrow(run, LETTER)
