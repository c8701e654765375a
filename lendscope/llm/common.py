"""Small helpers shared by the text operators.

Conventions of every operator here: a null text counts as empty, a null ``doc_id`` is an id of its own that sorts
before all others, repeated rows are kept row by row, extra columns are ignored (only the named ones are read) and
an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: ASCII white space of the contracts: space and 0x09-0x0D; ``bytes.split()`` cuts at exactly these.
SPACES = frozenset(b" \t\n\v\f\r")
#: Word bytes of the folded contracts: digits, letters, all of UTF-8 above ASCII; A-Z become a-z, the rest a space.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128)
             else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Workers give freed arrays of this many bytes and more back to the system; else the allocator raises that bound to 32 MB.
RETURNED = 1 << 20
#: Rows go to a Python worker in batches of 10,000, whatever their size: of whole texts, tens of megabytes in the JVM, twice
#: that while its buffers grow, and again in the worker.  A setting of the session's own is left.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package, also where it is not installed (tests, a checkout); bound what they hold."""
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, BATCH_BYTES)
    env = spark.sparkContext.environment
    env.setdefault("MALLOC_MMAP_THRESHOLD_", str(RETURNED))
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, ROOT])


def fold_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def sliced(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batch some rows at a time: Spark's batches have 10,000 rows, of whole texts tens of megabytes as Python strings."""
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def text_bytes(docs: DataFrame) -> int:
    """Size of all texts; sets the number of parts, so that a part's size stays the same at every input size."""
    return docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0


def shuffle_parts(spark: SparkSession, size: int, part_bytes: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes), 1)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's shared checkpoint folder (a local one is made only where none is set, on local)."""
    import tempfile
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="lendscope-llm-")
        spark.sparkContext.setCheckpointDir(top)
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _SCRATCH[-1:]:
        made.append(path)
    return path


#: Paths made inside the innermost ``scratch`` block that is open.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside the block are deleted when it ends: what is needed later must be written to a path of before."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends there, and a lost executor costs no recomputation."""
    path = path or shared_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans now: its cleaner waits until the driver collects its garbage,
    which a driver with a large heap may not do before a job of many rounds has ended."""
    gc.collect()
    spark._jvm.System.gc()


# ---- vectorised hashing of words (numpy, wrapping 64-bit arithmetic)

_R = np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(0xD6E8FEB86659FD93)


def _inverse(r: np.uint64) -> np.uint64:
    return np.uint64(pow(int(r), -1, 1 << 64))


def _powers(r: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, r, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of ``text`` between ASCII white space, in order."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    a, b = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(mix(raw.astype(np.uint64) + np.uint64(1)) * _powers(_R, len(raw)), out=total[1:])
    return mix((total[b] - total[a]) * _powers(_inverse(_R), len(raw))[a] + (b - a).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words; ``salt`` gives independent families."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    r = _S ^ np.uint64((salt * 2) & 0xFFFF)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words + np.uint64(salt)) * _powers(r, len(words)), out=total[1:])
    return mix((total[size:] - total[:n]) * _powers(_inverse(r), n))
