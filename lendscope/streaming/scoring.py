"""Incremental pre-approval scoring on a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame

from lendscope.plans import decide as D
from lendscope.plans import model as ML
from lendscope.plans.prep import FEATURE_COLUMNS, select_features


def score_stream(stream: DataFrame, models: Sequence[Model], cut: float,
                 features: Sequence[str] = FEATURE_COLUMNS, key: str = "account_id",
                 approve: float = D.APPROVE_THRESHOLD) -> DataFrame:
    """Tier each arriving account with the bagged models.

    ``cut`` is the pre-approval score fixed on the batch pool (a quantile
    cannot be recomputed per micro-batch without changing its meaning).
    Works on batch frames too.
    """
    x = ML.assemble(select_features(stream, features, keep=(key,)), features, label=None,
                    keep=(key,))
    scored = ML.score(models, x)
    cols = [f"score_{i}" for i in range(len(models))]
    avg = D.average_scores(scored, cols)
    return D.decide(avg, "avg_score", approve=approve, cut=cut)
