"""Fill-in-middle over text stored as seekable compressed frames.

A text is stored as independent zstandard frames of ``FRAME_BYTES`` raw bytes with a directory of cumulative counts: raw
bytes, code points and units (lines, ``[^\\n]*\\n|[^\\n]+``) up to the end of each frame.  Any unit is found by a search in
the directory and the decompression of the one frame that holds its end.

The transformation moves frames, not text: the frames in which a cut lies are decompressed and split, all others go into
the output as they are, in the order of the form (``psm``: prefix, suffix, middle; ``spm``: suffix, prefix, middle), with a
small frame for each mark.  The output has the same format, so a reader can seek in it.  Digests stream the ordered frames
one by one; restoring finds the marks in the output's stream and reads the three ranges in the text's order, so the
memory needed beside a document's compressed frames is that of one raw frame.

At scale: three map-only passes (store, transform, digest), no shuffle; the stored frames are a table in the shared folder.

Null or empty text: no unit, no frame, form ``plain``.  A text that holds a mark is ``plain``.  Null ``doc_id``: hashed as the
empty text.  Repeated rows: each is transformed.  Lines longer than a frame span several.  Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, stored

FRAME_BYTES, LEVEL = 1 << 16, 3
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SALT, RATE, SPM_RATE = "7:", 100, 50
#: sizes, points, units: little-endian 64-bit counts up to the end of each frame
_DIRECTORY = "frames array<binary>, sizes binary, points binary, units binary"
STORED = f"doc_id long, marked boolean, {_DIRECTORY}"
OUTPUT = f"doc_id long, n long, form string, prefix_chars long, middle_chars long, {_DIRECTORY}"
DIGESTS = ("doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, "
           "restored_sha256 string")
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
          "array<binary>": pa.list_(pa.binary())}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(cols, kinds)], names=list(names))


def points(raw: bytes) -> int:
    """Code points of a piece of UTF-8, cut anywhere: bytes that do not continue one."""
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


class Frames:
    """Independent frames in order, with the counts up to the end of each."""

    def __init__(self, frames: list[bytes], sizes: list[int], points: list[int], units: list[int]):
        self.frames, self.sizes, self.points, self.units = frames, sizes, points, units

    @classmethod
    def of(cls, text: bytes, frame_bytes: int = FRAME_BYTES) -> Frames:
        out = cls([], [], [], [])
        for a in range(0, len(text), frame_bytes):
            out.add_raw(text[a:a + frame_bytes])
        if out.frames and not text.endswith(b"\n"):
            out.units[-1] += 1  # the last line ends with the text
        return out

    @classmethod
    def read(cls, frames: list[bytes], sizes: bytes, points: bytes, units: bytes) -> Frames:
        return cls(frames, *(np.frombuffer(x, "<i8").tolist() for x in (sizes, points, units)))

    def columns(self) -> tuple[list[bytes], bytes, bytes, bytes]:
        return self.frames, *(np.array(x, "<i8").tobytes() for x in (self.sizes, self.points, self.units))

    def add(self, frame: bytes, size: int, n_points: int, n_units: int) -> None:
        self.frames.append(frame)
        for totals, n in ((self.sizes, size), (self.points, n_points), (self.units, n_units)):
            totals.append((totals[-1] if totals else 0) + n)

    def add_raw(self, raw: bytes) -> None:
        if raw:
            self.add(_compressor().compress(raw), len(raw), points(raw), raw.count(b"\n"))

    def add_part(self, other: Frames, start: int, stop: int) -> None:
        """Append bytes start..stop of another text: whole frames as they are, only cut ones opened."""
        f = bisect_right(other.sizes, start)
        while start < stop:
            low, high = other.sizes[f - 1] if f else 0, other.sizes[f]
            if start == low and stop >= high:
                before = [t[f - 1] if f else 0 for t in (other.points, other.units)]
                self.add(other.frames[f], high - low, other.points[f] - before[0], other.units[f] - before[1])
            else:
                self.add_raw(other.raw(f)[start - low:min(stop, high) - low])
            start, f = min(stop, high), f + 1

    @property
    def size(self) -> int:
        return self.sizes[-1] if self.sizes else 0

    @property
    def n_units(self) -> int:
        return self.units[-1] if self.units else 0

    def raw(self, f: int) -> bytes:
        return _decompressor().decompress(self.frames[f])

    def seek(self, unit: int) -> tuple[int, int]:
        """(bytes, code points) before the end of the first ``unit`` units."""
        if unit <= 0:
            return 0, 0
        if unit >= self.n_units:
            return self.size, self.points[-1] if self.points else 0
        f = bisect_left(self.units, unit)
        left = unit - (self.units[f - 1] if f else 0)
        raw, at = self.raw(f), 0
        for _ in range(left):
            at = raw.index(b"\n", at) + 1
        return (self.sizes[f - 1] if f else 0) + at, (self.points[f - 1] if f else 0) + points(raw[:at])

    def stream(self, start: int = 0, stop: int | None = None) -> Iterator[bytes]:
        """Bytes start..stop, one frame at a time."""
        stop = self.size if stop is None else stop
        f = bisect_right(self.sizes, start)
        while start < stop:
            low = self.sizes[f - 1] if f else 0
            raw = self.raw(f)
            yield raw[start - low:stop - low]
            start, f = min(stop, self.sizes[f]), f + 1

    def find(self, mark: bytes, start: int) -> int:
        """Where ``mark`` first stands at or after ``start``."""
        at, tail = start, b""
        for raw in self.stream(start):
            window = tail + raw
            hit = window.find(mark)
            if hit >= 0:
                return at - len(tail) + hit
            at += len(raw)
            tail = window[-(len(mark) - 1):]
        raise ValueError(f"no {mark!r} in the output")


def _compressor(kept: dict = {}) -> zstandard.ZstdCompressor:  # one for each worker
    return kept.setdefault("c", zstandard.ZstdCompressor(level=LEVEL))


def _decompressor(kept: dict = {}) -> zstandard.ZstdDecompressor:
    return kept.setdefault("d", zstandard.ZstdDecompressor())


def arrange(text: Frames, marked: bool, doc_id: int | None, salt: str = SALT, rate: int = RATE,
            spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, Frames]:
    """(units, form, code points of prefix and middle, the output's frames)."""
    n = text.n_units
    h = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not text.frames or marked or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, a_points), (b, b_points) = text.seek(first), text.seek(second)
    form = "spm" if h4 % 100 < spm_rate else "psm"
    prefix, suffix = (PREFIX, 0, a), (SUFFIX, b, text.size)
    out = Frames([], [], [], [])
    for mark, start, stop in (*((suffix, prefix) if form == "spm" else (prefix, suffix)), (MIDDLE, a, b)):
        out.add_raw(mark)
        out.add_part(text, start, stop)
    return n, form, a_points, b_points - a_points, out


def ordered_ranges(output: Frames, form: str) -> list[tuple[int, int]]:
    """Byte ranges of the output that give the text: prefix, middle, suffix.  The text holds no mark, and no mark can
    begin before and end inside the next one, so the first of each kind is the real one."""
    if form == "plain":
        return [(0, output.size)]
    step = len(PREFIX)
    second = output.find(SUFFIX if form == "psm" else PREFIX, step)
    third = output.find(MIDDLE, second + step)
    one, two, middle = (step, second), (second + step, third), (third + step, output.size)
    return [one, middle, two] if form == "psm" else [two, middle, one]


def digest(chunks: Iterator[bytes]) -> str:
    h = hashlib.sha256()
    for c in chunks:
        h.update(c)
    return h.hexdigest()


def _store(batches: Iterator[pa.RecordBatch], frame_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or b""
            rows.append((doc, any(m in text for m in (PREFIX, SUFFIX, MIDDLE)), *Frames.of(text, frame_bytes).columns()))
        yield _batch(STORED, rows)


def _arrange(batches: Iterator[pa.RecordBatch], **rule) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, marked, *frames in zip(*(c.to_pylist() for c in batch.columns)):
            *facts, out = arrange(Frames.read(*frames), marked, doc, **rule)
            rows.append((doc, *facts, *out.columns()))
        yield _batch(OUTPUT, rows)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, n, form, prefix, middle, *frames in zip(*(c.to_pylist() for c in batch.columns)):
            out = Frames.read(*frames)
            back = (chunk for a, b in ordered_ranges(out, form) for chunk in out.stream(a, b))
            rows.append((doc, n, form, prefix, middle, digest(out.stream()), digest(back)))
        yield _batch(DIGESTS, rows)


def store(docs: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The texts as frames (``STORED``), a table in the shared folder."""
    ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").cast("binary").alias("text"))
    return stored(rows.mapInArrow(partial(_store, frame_bytes=frame_bytes), STORED), "fim-frames")


def fill_in_middle(frames: DataFrame, salt: str = SALT, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Form, cut sizes and the output's frames (``OUTPUT``) of every stored text; ``rate`` percent are not left plain."""
    ready(frames.sparkSession)
    return frames.mapInArrow(partial(_arrange, salt=salt, rate=rate, spm_rate=spm_rate), OUTPUT)


def digests(outputs: DataFrame) -> DataFrame:
    """Digest of every output and of the text restored from it alone (``DIGESTS``)."""
    ready(outputs.sparkSession)
    return outputs.mapInArrow(_digest, DIGESTS)


def output_texts(outputs: DataFrame) -> DataFrame:
    """doc_id, form and the output as one text, for writers that want no frames."""
    ready(outputs.sparkSession)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, form, b"".join(Frames.read(*frames).stream()).decode("utf-8", "replace"))
                    for doc, form, *frames in zip(*(c.to_pylist() for c in batch.columns))]
            yield _batch("doc_id long, form string, text string", rows)

    return outputs.select("doc_id", "form", "frames", "sizes", "points", "units").mapInArrow(
        join, "doc_id long, form string, text string")


#: The same in DuckDB, on whole texts.
SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
    CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT doc_id, n, form, t, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
    array_to_string(u[b + 1:], '') AS suf FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CAST(CASE WHEN form <> 'plain' THEN length(pre) END AS BIGINT) AS prefix_chars,
  CAST(CASE WHEN form <> 'plain' THEN length(mid) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
