"""First-row-per-key operators that stay safe when one key is huge.

Neither function runs a window over a whole key group: ``dedup_first`` is
an aggregate (partial ``min`` on each map task, so a hot key is reduced
before the shuffle), and ``first_k_per_key`` ranks at most ``k`` rows per key
and map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep one row per ``keys``: the first by ``order`` (ties: smallest row).

    Models a primary key on load, where a repeated key is skipped and the
    first row kept.  Implemented as ``min(struct(order..., rest...))`` per
    key, which Spark partially aggregates before the shuffle.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                      *[F.col(c).alias(c) for c in rest])
    firsts = df.groupBy(*keys).agg(F.min(packed).alias("_first"))
    cols = []
    for c in df.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in order:
            cols.append(F.col(f"_first._o{order.index(c)}").alias(c))
        else:
            cols.append(F.col(f"_first.{c}").alias(c))
    return firsts.select(*cols)


def first_k_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str], k: int,
                    rank_col: str = "rank", salt_buckets: int = 64) -> DataFrame:
    """Rows ranked 1..k within each key by ``order`` (ascending).

    Spark cuts each map task's rows to the first ``k`` per key before the
    exchange, so a key holding a third of all rows brings ``k`` rows per task.
    Where that is switched off for this ``k`` (``windowGroupLimitThreshold``),
    rows are first ranked within ``(key, salt)``, the salt a hash of the row.
    ``order`` must be a total order (include a unique column) for
    deterministic output.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = list(order)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    if k <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        return df.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(salt_buckets))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    survivors = (df.withColumn("_salt", salt)
                   .withColumn("_r1", F.row_number().over(w1))
                   .filter(F.col("_r1") <= k)
                   .drop("_r1", "_salt"))
    return (survivors.withColumn(rank_col, F.row_number().over(w2))
                     .filter(F.col(rank_col) <= k))
