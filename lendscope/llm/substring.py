"""Substring dedup with fixed-block anchors: words repeated from an earlier document are removed.

Every window of ``window`` words holds a whole block of ``block = (window + 1) // 2`` words that starts at a multiple
of the block length in its own document.

1. Anchors.  The non-overlapping blocks of all documents are the index; every rolling block-sized window of all
   documents probes it.  Blocks and probes go to buckets of their hash as four bytes each (31 bits of hash, one bit
   "this is an index block"; see ``letters``); the bucket answers with one bit per probe: its content is an index
   block and stands at two places at least.
2. Extension.  A window can repeat only if it holds an anchored place, so only those windows are compared, by a
   64-bit hash of all their words within a bucket (64 + log2(buckets) bits), with the document id.  The bucket
   answers which of them start in a document with a smaller id as well.  Overlapping repeated windows are maximal
   exact repeats.
3. The words under repeated windows are removed.

At scale: the texts are shuffled once, a probe costs four bytes, candidates about nine; a passage shared by any number
of documents costs each only its own windows (never pairs).  Parts and buckets hold a fixed amount whatever the input.

Windows are judged on the input.  Null or empty text: no words, kept text empty.  Null ``doc_id``: smaller than all
others; rows without an id do not count as earlier than each other.  Rows that repeat a ``doc_id`` are not earlier
than each other either.  Texts shorter than a window: nothing is removed.  Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ready, window_hashes
from .letters import (LETTER, answers, deal, letters, no_letters, part_words, parted, read_letters, sorted_rows,
                      whole_windows)

WINDOW = 13
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
NULL_ID = -(1 << 63)


def _probes(words: np.ndarray, counts: np.ndarray, block: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all rolling blocks of texts that have a window, and their hashes."""
    at = whole_windows(counts, block)
    starts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    at = at[counts[owner[at]] >= window]
    keys = window_hashes(words, block, 1)[at]
    aligned = (at - starts[owner[at]]) % block == 0
    # the lowest bit says whether the place is an index block
    return at, (keys & ~np.uint64(1)) | aligned.astype(np.uint64)


def _anchored(_: list[int], data: list[bytes]) -> list[bytes | None]:
    """One bit per probe: an index block has this content, and the content has two places."""
    sizes = [len(d) // 4 for d in data]
    entry = np.frombuffer(b"".join(data), "<u4")
    order = np.argsort(entry, kind="stable")
    content = entry[order] >> 1
    first = np.concatenate(([True], content[1:] != content[:-1]))
    group = np.cumsum(first) - 1
    good = (np.bincount(group, weights=entry[order] & 1) > 0) & (np.bincount(group) > 1)
    hit = np.empty(len(entry), bool)
    hit[order] = good[group]
    return [np.packbits(h).tobytes() if h.any() else None for h in np.split(hit, np.cumsum(sizes)[:-1])]


def _repeated(_: list[int], data: list[bytes]) -> list[bytes | None]:
    """One bit per candidate window: its words also start in a document with a smaller id."""
    sizes = [int(np.frombuffer(d, "<u4", 1)[0]) for d in data]
    keys = np.concatenate([np.frombuffer(d, "<u8", n, 4) for d, n in zip(data, sizes)])
    docs = np.concatenate([np.cumsum(np.frombuffer(pa.decompress(d[4 + 8 * n:], 8 * n, "zstd", asbytes=True), "<i8"))
                           for d, n in zip(data, sizes)])
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    first = np.concatenate(([True], k[1:] != k[:-1]))
    least = d[first][np.cumsum(first) - 1]
    hit = np.empty(len(keys), bool)
    hit[order] = d > least
    return [np.packbits(h).tobytes() if h.any() else None for h in np.split(hit, np.cumsum(sizes)[:-1])]


def _read_bits(table: pa.Table, order: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The answers of all buckets, in the order of the places asked about."""
    out = np.zeros(len(order), bool)
    for bucket, _, data in read_letters(table):
        a, b = int(edges[bucket]), int(edges[bucket + 1])
        out[order[a:b]] = np.unpackbits(np.frombuffer(data, np.uint8), count=b - a).view(bool)
    return out


def _candidates(words: np.ndarray, counts: np.ndarray, at: np.ndarray, hit: np.ndarray, block: int,
                window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that hold an anchored place, and their hashes."""
    near = np.zeros(len(words) + 1, np.int32)
    first = np.maximum(at[hit] - (window - block), 0)
    np.add.at(near, first, 1)
    np.add.at(near, at[hit] + 1, -1)
    starts = whole_windows(counts, window)
    starts = starts[np.cumsum(near)[starts] > 0]
    return starts, window_hashes(words, window, 2)[starts]


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of every document."""
    return _dedup(docs, window, False)


def kept_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """As ``dedup_substrings``, with ``text string``: the kept words joined by one space."""
    return _dedup(docs, window, True)


def _dedup(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    ready(docs.sparkSession)
    block = (window + 1) // 2
    rows, n = parted(docs)

    def ask(table: pa.Table) -> pa.Table:
        _, texts = sorted_rows(table)
        at, keys = _probes(*part_words(texts), block, window)
        order, edges = deal(keys, n)
        low = keys.astype("<u4")[order]
        return letters(table["part"][0].as_py(), n, edges, lambda a, b: low[a:b].tobytes())

    def extend(docs_: pa.Table, mail: pa.Table) -> pa.Table:
        if not docs_.num_rows or not mail.num_rows:
            return no_letters()
        ids, texts = sorted_rows(docs_)
        words, counts = part_words(texts)
        at, keys = _probes(words, counts, block, window)
        hit = _read_bits(mail, *deal(keys, n))
        starts, keys = _candidates(words, counts, at, hit, block, window)
        order, edges = deal(keys, n)
        owner = np.repeat(np.array([NULL_ID if i is None else i for i in ids], np.int64), counts)[starts][order]
        keys = keys[order]

        def pack(a: int, b: int) -> bytes:
            gaps = np.diff(owner[a:b], prepend=np.int64(0)).astype("<i8")
            return np.uint32(b - a).tobytes() + keys[a:b].tobytes() + pa.compress(gaps.tobytes(), "zstd", asbytes=True)

        return letters(docs_["part"][0].as_py(), n, edges, pack)

    names = [c.split()[0] for c in KEPT.split(", ")] + ["text"] * with_text
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text

    def finish(docs_: pa.Table, mail: pa.Table) -> pa.Table:
        out = []
        if docs_.num_rows:
            ids, texts = sorted_rows(docs_)
            words, counts = part_words(texts)
            gone = np.zeros(len(words) + 1, np.int32)
            if mail.num_rows:
                anchors = mail.filter(pa.array([d[:1] == b"A" for d in mail["data"].to_pylist()]))
                repeats = mail.filter(pa.array([d[:1] == b"R" for d in mail["data"].to_pylist()]))
                if repeats.num_rows:
                    at, keys = _probes(words, counts, block, window)
                    hit = _read_bits(_open(anchors), *deal(keys, n))
                    starts, keys = _candidates(words, counts, at, hit, block, window)
                    dup = starts[_read_bits(_open(repeats), *deal(keys, n))]
                    np.add.at(gone, dup, 1)
                    np.add.at(gone, dup + window, -1)
            stay = np.cumsum(gone)[:len(words)] == 0
            end = 0
            for i, text, count in zip(ids, texts, counts.tolist()):
                own = stay[end:end + count]
                kept = b" ".join(compress(text.split(), own.tolist()))
                out.append((i, count, count - int(own.sum()), hashlib.sha256(kept).hexdigest())
                           + (kept.decode("utf-8", "surrogatepass"),) * with_text)
                end += count
        cols = zip(*out) if out else [[] for _ in names]
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

    by_part = rows.groupBy("part")
    anchors = answers(by_part.applyInArrow(ask, LETTER), _anchored)
    candidates = by_part.cogroup(anchors.groupBy("part")).applyInArrow(extend, LETTER)
    repeats = answers(candidates, _repeated)
    mail = _sealed(anchors, "A").unionByName(_sealed(repeats, "R"))
    return by_part.cogroup(mail.groupBy("part")).applyInArrow(finish, KEPT + ", text string" * with_text)


def _sealed(mail: DataFrame, kind: str) -> DataFrame:
    """Letters with a leading byte that tells two kinds apart."""
    from pyspark.sql import functions as F

    return mail.select("bucket", "part", F.concat(F.lit(kind).cast("binary"), "data").alias("data"))


def _open(mail: pa.Table) -> pa.Table:
    data = pa.array([d[1:] for d in mail["data"].to_pylist()], pa.binary())
    return mail.set_column(mail.schema.get_field_index("data"), "data", data)


#: The same in DuckDB: every window's smallest document, then the words that stay.
SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS pos FROM win JOIN f USING (s) WHERE doc_id > least),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS k, count(*) AS n
         FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
