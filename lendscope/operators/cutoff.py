"""Cutoff join: keep only events dated strictly before their key's cutoff.

Leakage guard for the training mart: transactions and cards count only if
they happened before the account's loan.  Keys without a cutoff use a fixed
default date, so every later row of a no-loan account is dropped too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.functions.dates import NO_LOAN_CUTOFF, date_literal


def earlier(ts: Column, limit: Column) -> Column:
    """``ts < limit``, false for null: the plain comparison lets the optimizer add "not null" filters below the joins, which
    decode the date of every event once more."""
    return F.coalesce(ts < limit, F.lit(False))


def before_cutoff(events: DataFrame, cutoffs: DataFrame, key: str = "account_id",
                  ts: str = "date_", cut: str = "date_",
                  default: str = NO_LOAN_CUTOFF, colocated: bool = False) -> DataFrame:
    """Rows of ``events`` with ``ts < coalesce(cutoff(key), default)``.

    A left equi-join on ``key`` followed by a filter; the coalesce keeps the
    join outer, so keys without a cutoff are compared to ``default``.  If a
    key had several cutoffs its events would be repeated once per cutoff
    (the source's behaviour); :func:`assert_one_cutoff` checks that.

    The key of the result is an expression equal to the key, so that a rollup
    by it cannot reuse the join's partitioning: it combines its rows in the
    join's tasks, which adaptive execution may then split for a hot key, and
    only partial aggregates are shuffled.  (With the plain key the rollup
    would run in the join's tasks, unsplit, on all rows of the key.)
    ``colocated`` keeps the plain key, for inputs that are stored bucketed by
    it: then neither join nor rollup moves a row.
    """
    c = cutoffs.select(F.col(key), F.col(cut).alias("_cutoff"))
    limit = F.coalesce(F.col("_cutoff"), date_literal(default))
    kept = events.join(c, on=key, how="left").filter(earlier(F.col(ts), limit)).drop("_cutoff")
    return kept if colocated else kept.withColumn(key, F.array_max(F.array(F.col(key))))


def link_limits(links: DataFrame, cutoffs: DataFrame, link_key: str, key: str = "account_id",
                cut: str = "date_", default: str = NO_LOAN_CUTOFF) -> DataFrame:
    """``link_key``, ``key`` and ``_limit``, the date before which an event of that link counts."""
    c = cutoffs.select(F.col(key), F.col(cut).alias("_cutoff"))
    return links.select(link_key, key).join(c, on=key, how="left").select(
        link_key, key, F.coalesce(F.col("_cutoff"), date_literal(default)).alias("_limit"))


def before_cutoff_linked(events: DataFrame, links: DataFrame, cutoffs: DataFrame, link_key: str,
                         key: str = "account_id", ts: str = "date_", cut: str = "date_",
                         default: str = NO_LOAN_CUTOFF) -> DataFrame:
    """:func:`before_cutoff` for events that name their key through a link row.

    Cutoffs are joined to the links, which are fewer than the events, and
    events move once, by ``link_key``: the filter and the partial aggregates
    of a rollup run where events meet their link.  Events without a link have
    no key and are dropped; with several, they count for each.
    """
    limits = link_limits(links, cutoffs, link_key, key, cut, default)
    kept = events.join(limits, on=link_key, how="inner").filter(earlier(F.col(ts), F.col("_limit")))
    return kept.select(key, *events.columns)


def assert_one_cutoff(cutoffs: DataFrame, key: str = "account_id") -> None:
    """Raise if any key has more than one cutoff (one aggregate, no collect)."""
    dup = cutoffs.groupBy(key).count().filter(F.col("count") > 1).limit(1).count()
    if dup:
        raise ValueError(f"more than one cutoff for some {key}")
