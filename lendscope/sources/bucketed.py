"""Bank tables stored bucketed and sorted by account in the session's catalog.

A mart joins five tables and four rollups on the account.  Written once with
the same number of buckets, sorted by account inside, they need no exchange
below those joins afterwards: a task reads one bucket of every table.  Cards
get their account from the link row and owner and user are paired when the
tables are written, as both hang on other keys.

The number of buckets is fixed at writing: choose it so that a bucket of the
transactions fits an executor's memory comfortably (an account's rows share a
bucket; a table whose hot account does not fit is better left unbucketed, see
``operators/cutoff.py``).
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from lendscope.plans.mart import KEY, build_mart, cards_before_loan, client_account, link_cards
from lendscope.operators.cutoff import before_cutoff
from lendscope.operators.rollup import card_rollup, rollup_by_category, txn_rollup
from lendscope.sources.tables import BankTables


@dataclass
class BucketedTables:
    """Tables by account (``district`` is a small dimension and not bucketed).

    cards are linked: they carry ``account_id`` and ``_linked``.
    """

    loans: DataFrame
    accounts: DataFrame
    client_account: DataFrame
    orders: DataFrame
    trans: DataFrame
    cards: DataFrame
    district: DataFrame


def save_bucketed(t: BankTables, path: str, prefix: str, buckets: int, literal: bool = False) -> None:
    """Write the tables under ``path`` as ``<prefix>_<table>`` of the catalog."""
    parts = {"loans": t.loans, "accounts": t.accounts, "client_account": client_account(t, literal), "orders": t.orders,
             "trans": t.trans, "cards": link_cards(t.cards, t.card_links)}
    for name, df in parts.items():
        # one task for each bucket, so that a bucket is one sorted file
        (df.repartition(buckets, KEY).write.mode("overwrite").option("path", f"{path.rstrip('/')}/{name}")
         .bucketBy(buckets, KEY).sortBy(KEY).saveAsTable(f"{prefix}_{name}"))
    t.district.write.mode("overwrite").option("path", f"{path.rstrip('/')}/district").saveAsTable(f"{prefix}_district")


def load_bucketed(spark: SparkSession, prefix: str) -> BucketedTables:
    return BucketedTables(**{f.name: spark.table(f"{prefix}_{f.name}") for f in fields(BucketedTables)})


def bucketed_rollups(t: BucketedTables, cutoff: bool, literal: bool = False) -> dict[str, DataFrame]:
    """The rollups of ``plans.mart.rollups`` over buckets: no row moves."""
    trans = before_cutoff(t.trans, t.loans, KEY, ts="date_", colocated=True) if cutoff else t.trans
    cards = cards_before_loan(t.cards, t.loans, colocated=True) if cutoff else t.cards
    return {
        "client_account": t.client_account,
        "orders": rollup_by_category(t.orders, KEY, "k_symbol", "amount"),
        "trans": txn_rollup(trans, KEY, literal_balance=literal),
        "cards": card_rollup(cards, None, KEY, per_type=literal),
    }


def mart_bucketed(t: BucketedTables, root: str = "accounts", cutoff: bool = True, literal: bool = False) -> DataFrame:
    """The mart of :func:`lendscope.plans.mart.build_mart` over bucketed tables."""
    return build_mart(t, root, cutoff, literal, rolled=bucketed_rollups(t, cutoff, literal))
