"""Many L2 logistic regressions over one frame, solved together: one Spark job evaluates them all.

``pyspark.ml`` starts a job for each step of each fit.  A grid search fits the same rows with every penalty and fold,
hundreds of fits of about a hundred steps, so that starting jobs costs more than the work in them.  Here the rows lie as
blocks of features in a stored table with a weight (number of copies) per training set, and a job adds up loss and
gradient of every unfinished fit.  The problem, its scaling and the L-BFGS steps are those of ``LogisticRegression``
(features scaled and centred, penalty on the unscaled coefficients, tolerance on the loss), so the solutions agree with
it up to rounding.

The driver gets one array of sums per task (fits x features numbers), never rows of the frame.
"""

from __future__ import annotations

from collections.abc import Collection, Generator, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.session import importable, remove_path, scratch_path

BLOCK_ROWS = 1024
ROWS_PER_FILE = 10_000
CHUNK = 1 << 15  # margins at a time: they stay in a core's cache
MEMORY, VALUES = 10, 20
BLOCK = "x binary, y binary, w binary, bad boolean"

Point = tuple[float, np.ndarray]  # loss and gradient
Solution = tuple[np.ndarray, float]  # coefficients and intercept
Search = Generator[np.ndarray, Point, tuple[np.ndarray, int]]


class StepFailed(Exception):
    """No acceptable step along a direction."""


def blocks(df: DataFrame, rows: int, path: str) -> DataFrame:
    """Blocks of ``features``, ``label`` and ``copies`` (an array with a number per training set), stored under ``path``."""
    spark = df.sparkSession
    importable(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                x, y, w = (c.slice(at, BLOCK_ROWS) for c in batch.columns)
                bad = bool(y.null_count or x.null_count)
                values = [x.flatten().to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False),
                          w.flatten().to_numpy(zero_copy_only=False)]
                raw = [np.ascontiguousarray(v, t).tobytes() for v, t in zip(values, ("<f8", "<f8", "<i4"))]
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.binary()) for r in raw] + [pa.array([bad])],
                                                 names=["x", "y", "w", "bad"])

    plain = df.select(vector_to_array("features"), F.col("label").cast("double"), F.col("copies").cast("array<int>"))
    parts = max(-(-rows // ROWS_PER_FILE), min(spark.sparkContext.defaultParallelism, -(-rows // BLOCK_ROWS)), 1)
    plain.repartition(parts).mapInArrow(pack, BLOCK).write.parquet(path)
    return spark.read.schema(BLOCK).parquet(path)


@contextmanager
def _kept(rows: DataFrame) -> Iterator[RDD]:
    """The stored blocks as (x, y, w), kept by the executors while they are read again and again (on disk, where memory
    ends): a pass is then one small job, without a plan or a scan."""
    kept = rows.select("x", "y", "w").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def _sums(rows: RDD, sets: int, shape: tuple[int, ...], add) -> np.ndarray:
    """Sum of ``add(x, y, w)`` (an array of ``shape``) over all blocks; one array per task reaches the driver."""
    def total(blocks: Iterator[tuple[bytes, bytes, bytes]]) -> Iterator[bytes]:
        out = np.zeros(shape)
        for x, y, w in blocks:
            y = np.frombuffer(y, "<f8")
            out += add(np.frombuffer(x, "<f8").reshape(len(y), -1), y,
                       np.frombuffer(w, "<i4").reshape(len(y), sets).astype(float))
        yield out.tobytes()

    return sum((np.frombuffer(p).reshape(shape) for p in rows.mapPartitions(total).collect()), np.zeros(shape))


def _line_search(value: float, slope: float, first: float, evaluate) -> Generator:
    """A step of the strong Wolfe conditions; ``evaluate`` yields a point and returns its loss and slope."""
    def between(a, b):  # minimum of the cubic through both ends, not too near to either
        if a[0] > b[0]:
            a, b = b, a
        d1 = a[2] + b[2] - 3 * (a[1] - b[1]) / (a[0] - b[0])
        d2 = np.sqrt(d1 * d1 - a[2] * b[2])
        t = b[0] - (b[0] - a[0]) * (b[2] + d2 - d1) / (b[2] - a[2] + 2 * d2)
        low, high = a[0] + 0.1 * (b[0] - a[0]), a[0] + 0.9 * (b[0] - a[0])
        return low if t < low else high if t > high else t

    def zoom(low, high):
        for _ in range(10):
            t = between(low, high)
            c = (t, *(yield from evaluate(t)))
            if c[1] > value + 1e-4 * t * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= 0.9 * abs(slope):
                    return t
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise StepFailed("zoom")

    if slope > 0:
        raise StepFailed("not a descent direction")
    t, low = first, (0.0, value, slope)
    for i in range(10):
        c = (t, *(yield from evaluate(t)))
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and i > 0):
            return (yield from zoom(low, c))
        if abs(c[2]) <= 0.9 * abs(slope):
            return t
        if c[2] >= 0:
            return (yield from zoom(c, low))
        low, t = c, t * 1.5
    raise StepFailed("line search")


def _direction(history: list[tuple[np.ndarray, np.ndarray]], gradient: np.ndarray) -> np.ndarray:
    d, used = gradient.copy(), []
    for s, y in history:
        used.append((s @ d) / (s @ y))
        d -= used[-1] * y
    if history:
        s, y = history[0]
        if not s @ y >= 0:
            raise StepFailed("history")
        d *= (s @ y) / (y @ y)
    for (s, y), a in zip(reversed(history), reversed(used)):
        d += (a - (y @ d) / (s @ y)) * s
    return -d


def lbfgs(start: np.ndarray, max_iter: int, tol: float) -> Search:
    """L-BFGS that yields points, is sent their loss and gradient, and returns the solution and its number of steps."""
    x, steps, failed, history, seen = start, 0, False, [], [np.inf]
    value, gradient = yield x
    initial = value
    while not (steps >= max_iter or len(seen) >= 2 and abs(value - max(seen)) <= tol * initial
               or np.linalg.norm(gradient) <= max(tol * value, 1e-8)):
        known: dict[float, Point] = {}
        try:
            d = _direction(history, gradient)

            def evaluate(t):
                if t not in known:
                    known[t] = yield x + t * d
                return known[t][0], known[t][1] @ d

            t = yield from _line_search(value, gradient @ d, 1.0 if steps else 1 / np.linalg.norm(d), evaluate)
            if t * np.linalg.norm(gradient) < 1e-10:
                raise StepFailed("underflow")
        except StepFailed:
            if failed:
                break
            failed, history = True, []
            continue
        new, (now, slope) = x + t * d, known[t]
        history = [(new - x, slope - gradient), *history][:MEMORY]
        x, value, gradient, steps, failed = new, now, slope, steps + 1, False
        seen = [*seen, value][-VALUES:]
    return x, steps


def solve_logits(df: DataFrame, sets: int, penalties: Sequence[float], rows: int, max_iter: int = 2000,
                 tol: float = 1e-6, only: Collection[tuple[float, int]] | None = None
                 ) -> dict[tuple[float, int], Solution]:
    """Coefficients and intercept by (inverse penalty ``C``, training set); ``only``: of these alone.

    ``df`` has ``rows`` rows of ``features``, ``label`` and ``copies``, an array that says how often each of the ``sets``
    training sets holds the row.  A set that is empty, has one class only, other labels than 0 and 1 or values that are
    not finite is left out, for ``LogisticRegression`` to judge.  Raises if a fit does not converge in ``max_iter`` steps.
    """
    path = scratch_path(df.sparkSession, "logit-blocks")
    try:
        stored = blocks(df, rows, path)
        first = stored.select(F.octet_length("x").alias("x"), F.octet_length("y").alias("y")).first()
        if first is None or not first["x"] or stored.where("bad").limit(1).count():
            return {}
        with _kept(stored) as kept:
            return _solved(kept, first["x"] // first["y"], sets, penalties, max_iter, tol, only)
    finally:
        remove_path(df.sparkSession, path)


def held_hits(df: DataFrame, sets: int, solutions: Sequence[tuple[int, Solution]], rows: int) -> np.ndarray:
    """Per solution: rows it classifies right, rows, right ones of class 1 and rows of class 1, in one pass.

    ``df`` is as in :func:`solve_logits`, with the copies that each set judges; a solution comes with its set."""
    path = scratch_path(df.sparkSession, "logit-blocks")
    which = np.array([k for k, _ in solutions])
    v, b = np.array([c for _, (c, _) in solutions]).T, np.array([i for _, (_, i) in solutions])

    def hits(x, y, w):
        out = np.zeros((len(which), 4))
        for at in _chunks(len(y), len(which)):
            ys, ws = y[at][:, None], w[at][:, which]
            with np.errstate(over="ignore"):
                good = 1 / (1 + np.exp(-(x[at] @ v + b))) >= 0.5
            hit, one = good == (ys == 1), ys == 1
            out += np.column_stack([(ws * hit).sum(0), ws.sum(0), (ws * (hit & one)).sum(0), (ws * one).sum(0)])
        return out

    try:
        with _kept(blocks(df, rows, path)) as stored:
            return _sums(stored, sets, (len(which), 4), hits)
    finally:
        remove_path(df.sparkSession, path)


def _chunks(rows: int, fits: int) -> Iterator[slice]:
    size = max(16, CHUNK // max(1, fits))
    return (slice(i, i + size) for i in range(0, rows, size))


def _solved(rows: RDD, d: int, sets: int, penalties: Sequence[float], max_iter: int, tol: float,
            only: Collection[tuple[float, int]] | None = None) -> dict[tuple[float, int], Solution]:
    def means(x, y, w):  # weight, weight of class 1, weight of other labels, weighted values
        return np.column_stack([w.sum(0), w.T @ (y == 1), w.T @ ((y != 0) & (y != 1)), w.T @ x])

    with np.errstate(all="ignore"):
        n, pos, other, *rest = _sums(rows, sets, (sets, d + 3), means).T
        mean = np.array(rest).T / n[:, None]
        ours = [k for k in range(sets) if n[k] > 1 and 0 < pos[k] < n[k] and not other[k] and np.isfinite(mean[k]).all()]
        if not ours:
            return {}

        def squares(x, y, w):
            return np.array([w[:, k] @ (x - mean[k]) ** 2 for k in ours])

        std = np.zeros((sets, d))
        std[ours] = np.sqrt(_sums(rows, sets, (len(ours), d), squares) / (n[ours, None] - 1))
        inverse = np.where(std > 0, 1 / std, 0.0)

    fits = [(C, k) for k in ours for C in penalties if only is None or (C, k) in only]
    searches: list[Search] = [lbfgs(np.append(np.zeros(d), np.log(pos[k] / (n[k] - pos[k]))), max_iter, tol)
                              for _, k in fits]
    asked = {i: next(s) for i, s in enumerate(searches)}
    out: dict[tuple[float, int], Solution] = {}
    while asked:
        if not all(np.isfinite(p).all() for p in asked.values()):
            raise RuntimeError("a fit left the finite numbers")
        which = np.array([fits[i][1] for i in asked])
        v = np.array([asked[i][:d] * inverse[fits[i][1]] for i in asked]).T
        b = np.array([asked[i][d] - mean[fits[i][1]] @ v[:, r] for r, i in enumerate(asked)])

        def losses(x, y, w):
            out = np.zeros((len(which), d + 2))
            for at in _chunks(len(y), len(which)):
                xs, ys, ws = x[at], (y[at] == 1.0)[:, None].astype(float), w[at][:, which]
                margin = xs @ v
                margin += b
                # ln(1 + e^m) - y m, and its slope
                small = np.exp(-np.abs(margin))
                loss = np.log1p(small)
                slope = np.where(margin >= 0, 1.0, small)
                small += 1
                slope /= small
                slope -= ys
                slope *= ws
                loss += np.maximum(margin, 0)
                margin *= ys
                loss -= margin
                loss *= ws
                out[:, 0] += loss.sum(0)
                out[:, 1] += slope.sum(0)
                out[:, 2:] += slope.T @ xs
            return out

        sums = _sums(rows, sets, (len(which), d + 2), losses)
        row = {i: r for r, i in enumerate(asked)}
        for i in list(asked):
            (C, k), s = fits[i], sums[row[i]]
            c, unscaled = asked[i][:d], asked[i][:d] * inverse[k]
            penalty = 1 / (C * n[k])
            value = s[0] / n[k] + 0.5 * penalty * (unscaled @ unscaled)
            gradient = np.append((s[2:] - mean[k] * s[1]) * inverse[k] / n[k] + penalty * unscaled * inverse[k], s[1] / n[k])
            try:
                asked[i] = searches[i].send((value, gradient))
            except StopIteration as end:
                del asked[i]
                x, steps = end.value
                if steps >= max_iter:
                    raise RuntimeError(f"no convergence within {max_iter} iterations for C={C}") from None
                v = x[:d] * inverse[k]
                out[(C, k)] = v, float(x[d] - mean[k] @ v)
    return out
