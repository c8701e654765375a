"""Exact k-means on integer vectors with ns-bounds.

Every vector keeps an upper bound of the distance to its centroid and one lower bound for each group of centroids, with
the round in which each was evaluated.  The centroids of all rounds are kept (``rounds x k x dims`` integers), so in a
later round a bound is loosened by the norm of the centroid's *total* displacement since that evaluation,
``|c(now) - c(then)|``, which is never more than the sum of the drifts of the rounds between.  Where the bounds no longer
prove the assignment, the distance to the own centroid and to the groups that fail is evaluated again, in integers.

Bounds are doubles and carry a slack far above their rounding, and only a strict inequality skips work, so
assignments, ties (the smaller number) and distances are exact: results equal those of plain rounds.

At scale: a round is one narrow pass over the stored vectors (with their bounds, a fifth of a vector's size) and one
partially aggregated sum per cluster; only ``k`` rows of sums reach the driver.  No vector moves between tasks.  Each
round's state is a table in the shared folder, so a lost executor repeats its own tasks of one round only.

Rows with a null vector, another number of components, or a null, NaN or infinite one are left out.  Null ``vec_id``:
a vector like others, hashed as the empty text.  Repeated rows: each counts.  Fewer vectors than ``k``: as many
centroids.  No vectors: no rows.  Extra columns are ignored.  Components whose squared distances do not fit 64 bits
raise (about 2^27 at 64 dimensions, half a million before scaling); nothing is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, stored

DIMS, SCALE, CLUSTERS, ROUNDS, SALT = 64, 256, 40, 5, "2:"
GROUP = 8
STATE = ("vec_id long, x array<long>, cluster int, distance long, upper double, upper_round int, "
         "lower array<double>, lower_round array<int>, evaluated long")
_KINDS = (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.float64(), pa.int32(),
          pa.list_(pa.float64()), pa.list_(pa.int32()), pa.int64())
_NAMES = [c.split()[0] for c in STATE.split(", ")]
_FAR = np.iinfo(np.int64).max


def integer_vectors(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and integer components ``floor(scale * x)`` of the vectors that are whole and finite."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return embeddings.where((F.size(e) == dims) & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda v: F.floor(v * F.lit(float(scale)))).alias("x"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (int64) of all rows of ``x`` to all rows of ``c``."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if most < 0 or 4 * x.shape[1] * most * most > _FAR:
        raise ValueError(f"a component of {most} is too large for 64-bit squared distances")
    if 4 * x.shape[1] * most * most <= 1 << 53:  # every sum below is an integer that a double holds
        x, c = x.astype(np.float64), c.astype(np.float64)
    near = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    return near.astype(np.int64)


def paired(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of ``x`` to the same row of ``c``."""
    d = x - c
    return (d * d).sum(axis=1)


class Rounds:
    """The centroids of all rounds so far; the last are those of the round that is being assigned."""

    def __init__(self, history: list[np.ndarray], group: int = GROUP):
        self.now, k = history[-1], len(history[-1])
        self.round = len(history) - 1
        self.groups = np.array_split(np.arange(k), -(-k // group))
        self.group_of = np.repeat(np.arange(len(self.groups)), [len(g) for g in self.groups])
        # norm of the total displacement since each earlier round, for one centroid and for the farthest of a group
        self.moved = np.array([np.sqrt(paired(self.now, c).astype(np.float64)) for c in history])
        self.moved_most = np.stack([self.moved[:, g].max(axis=1) for g in self.groups], axis=1)

    def start(self, n: int) -> tuple[np.ndarray, ...]:
        """Bounds that prove nothing: the first round evaluates everything."""
        g = len(self.groups)
        return (np.zeros(n, np.int32), np.full(n, np.inf), np.zeros(n, np.int32), np.full((n, g), -np.inf),
                np.zeros((n, g), np.int32))

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, upper_round: np.ndarray,
               lower: np.ndarray, lower_round: np.ndarray) -> tuple[np.ndarray, ...]:
        """The state after this round, and how many distances each vector needed."""
        cluster, upper, upper_round = cluster.copy(), upper.copy(), upper_round.copy()
        lower, lower_round = lower.copy(), lower_round.copy()
        high = upper + self.moved[upper_round, cluster]
        low = lower - self.moved_most[lower_round, np.arange(len(self.groups))]
        cost = np.zeros(len(x), np.int64)
        todo = np.flatnonzero(~self._proven(high[:, None], low).all(axis=1))
        if not len(todo):
            return cluster, upper, upper_round, lower, lower_round, cost
        rows, own = x[todo], cluster[todo]
        near = np.full((len(todo), len(self.now)), _FAR)
        here = np.arange(len(todo))
        near[here, own] = paired(rows, self.now[own])
        high = np.sqrt(near[here, own].astype(np.float64))
        seen = ~self._proven(high[:, None], low[todo])
        cost[todo] += 1
        for g in range(len(self.groups)):
            self._evaluate(g, np.flatnonzero(seen[:, g]), rows, near)
        best = near.argmin(axis=1)  # the first of equal distances
        # who leaves a centroid needs a lower bound for the group that it now belongs to the rest of
        left = (best != own) & ~seen[here, self.group_of[own]]
        for g in range(len(self.groups)):
            self._evaluate(g, np.flatnonzero(left & (self.group_of[own] == g)), rows, near)
        seen[here[left], self.group_of[own[left]]] = True
        cluster[todo], upper_round[todo] = best, self.round
        upper[todo] = np.sqrt(near[here, best].astype(np.float64))
        rest = near.astype(np.float64)
        rest[near == _FAR] = np.inf
        rest[here, best] = np.inf
        for g, members in enumerate(self.groups):
            again = todo[seen[:, g]]
            lower[again, g] = np.sqrt(rest[seen[:, g]][:, members].min(axis=1))
            lower_round[again, g] = self.round
            cost[again] += len(members)
        return cluster, upper, upper_round, lower, lower_round, cost

    @staticmethod
    def _proven(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return high + 1e-9 * (1 + high) < low - 1e-9 * (1 + np.abs(low))

    def _evaluate(self, g: int, at: np.ndarray, rows: np.ndarray, near: np.ndarray) -> None:
        if len(at):
            near[np.ix_(at, self.groups[g])] = squared(rows[at], self.now[self.groups[g]])


def _matrix(column: pa.Array, kind: type, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, -1)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, m = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * m, pa.int32()), pa.array(values.ravel(), kind.value_type))


def one_round(batches: Iterator[pa.RecordBatch], history: list[np.ndarray], group: int) -> Iterator[pa.RecordBatch]:
    """Vectors (first round) or the state of the round before, to the state of this round."""
    rounds = Rounds(history, group)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        x = _matrix(batch.column(1), np.int64, n)
        if batch.num_columns == 2:
            before, spent = rounds.start(n), np.zeros(n, np.int64)
        else:
            before = (batch.column(2).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_numpy(),
                      _matrix(batch.column(6), np.float64, n), _matrix(batch.column(7), np.int32, n))
            spent = batch.column(8).to_numpy()
        cluster, upper, upper_round, lower, lower_round, cost = rounds.assign(x, *before)
        cols = (batch.column(0), batch.column(1), cluster, paired(x, rounds.now[cluster]), upper, upper_round,
                _lists(lower, _KINDS[6]), _lists(lower_round, _KINDS[7]), spent + cost)
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k)
                                          for c, k in zip(cols, _KINDS)], names=_NAMES)


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise ``floor(sum / count)`` of each cluster's vectors; empty clusters stay."""
    dims = centroids.shape[1]
    rows = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(dims)]).collect()  # at most k rows
    out = centroids.copy()
    for r in rows:
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


def first_centroids(vectors: DataFrame, k: int, salt: str) -> list[np.ndarray]:
    """The vectors of the ``k`` smallest hashes of their ids."""
    rank = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(rank.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return [np.array(r["x"], np.int64) for r in rows]


def kmeans(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, salt: str = SALT,
           group: int = GROUP) -> tuple[DataFrame, list[np.ndarray]]:
    """(state after the last assignment, centroids of every round) of ``vec_id, x``; see the module for the columns.

    ``evaluated`` counts the distances that a vector needed in all rounds (``(rounds + 1) * k`` without bounds)."""
    spark = vectors.sparkSession
    ready(spark)
    vectors = stored(vectors, "kmeans-vectors")
    first = first_centroids(vectors, k, salt)
    if not first:
        return spark.createDataFrame([], STATE), []
    history = [np.stack(first)]
    if np.abs(history[0]).max() >= 1 << 40:  # before sums of squares can wrap
        raise ValueError("a component is too large for 64-bit squared distances")
    state = vectors
    for _ in range(rounds + 1):
        # centroids of all rounds: rounds * k * dims integers, whatever the data
        state = stored(state.mapInArrow(partial(one_round, history=list(history), group=group), STATE), "kmeans-state")
        if len(history) <= rounds:
            history.append(moved_centroids(state, history[-1]))
    return state, history


def cluster(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
            salt: str = SALT) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector kept."""
    state, history = kmeans(integer_vectors(embeddings, dims, scale), k, rounds, salt)
    spark = embeddings.sparkSession
    sums = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    rows = [(c, sums[c], sum(sums.values()),
             hashlib.sha256(",".join(map(str, history[-1][c].tolist())).encode()).hexdigest()) for c in sorted(sums)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most k rows
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT) -> str:
    """The same in DuckDB, one pair of expressions for each round and no bounds."""
    parts = [f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e:
  CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS cluster, x AS c FROM (
  SELECT sha256('{salt}' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT {k}))"""]
    for t in range(rounds + 1):
        parts.append(f"""a{t} AS MATERIALIZED (SELECT vec_id, x, r.cluster AS cluster, r.d AS d FROM (
  SELECT vec_id, x, (SELECT min(struct_pack(d := list_sum(list_transform(list_zip(x, c),
    lambda z: (z[1] - z[2]) * (z[1] - z[2]))), cluster := cluster)) FROM c{t}) AS r FROM v))""")
        if t < rounds:
            parts.append(f"""m{t} AS (SELECT cluster, i, CAST(sum(x[i]) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n
  FROM a{t}, range(1, {dims + 1}) AS r(i) GROUP BY cluster, i),
n{t} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM m{t} GROUP BY cluster),
c{t + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(n{t}.c, o.c) AS c FROM c{t} AS o LEFT JOIN n{t} USING (cluster))""")
    return ",\n".join(parts) + f"""
SELECT vec_id, cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""
