"""Global match / mismatch audit between two attributes of joined tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_audit(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``left`` ⟕ ``right`` on ``key``; count rows where ``a = b`` and the rest.

    A NULL on either side counts as a mismatch.  One global aggregate: each
    task emits two partial counts, so nothing large reaches one task.
    """
    j = left.select(key, a).join(right.select(key, b), on=key, how="left")
    same = F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return j.agg(F.count_if(same).alias("match_"), F.count_if(~same).alias("mismatch"))
