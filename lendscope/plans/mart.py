"""Feature marts: one row per root key, rollups left-joined on ``account_id``.

Physical shape: every rollup is an aggregate keyed (hash-partitioned) by
``account_id``; the root is shuffled once on the same key and the joins
stack on that one partitioning.  The district dimension is the only
broadcast, and only after its row count is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.functions.dates import date_literal, days_between, years_between
from lendscope.operators.cutoff import assert_one_cutoff, before_cutoff, before_cutoff_linked, earlier, link_limits
from lendscope.operators.entities import link_clients, pair_roles
from lendscope.operators.rollup import card_rollup, rollup_by_category, txn_rollup
from lendscope.sources.tables import BankTables

KEY = "account_id"
# Upper bound on the rows of a dimension we are willing to broadcast.
BROADCAST_MAX_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint only when ``df`` provably has at most ``max_rows`` rows.

    The check is ``limit(max_rows + 1).count()``, which stops early on a big
    input; above the bound the join is left to the planner (sort-merge, or
    a runtime broadcast by adaptive execution if it turns out small).
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def link_cards(cards: DataFrame, links: DataFrame, link_key: str = "disp_id") -> DataFrame:
    """Cards left-joined to their link row (adds ``account_id``, ``_linked``)."""
    l = links.select(link_key, KEY, F.lit(True).alias("_linked"))
    return cards.join(l, on=link_key, how="left")


def cards_before_loan(linked_cards: DataFrame, loans: DataFrame, colocated: bool = False) -> DataFrame:
    """Cards issued before the account's loan (or the default cutoff).

    Cards without a link row have no cutoff at all and are dropped.
    """
    return before_cutoff(linked_cards.filter(F.col("_linked")), loans, KEY, ts="issued", colocated=colocated)


def cards_before_loan_linked(cards: DataFrame, links: DataFrame, loans: DataFrame, link_key: str = "disp_id") -> DataFrame:
    """:func:`cards_before_loan` from cards and their links: cards move once, by the link."""
    return before_cutoff_linked(cards, links, loans, link_key, KEY, ts="issued")


def trans_before_loan(t: BankTables) -> DataFrame:
    """Transactions dated before the account's loan (or the default cutoff).

    Through links, if there are any: cutoffs join the links and transactions move once, in their raw form.
    """
    if t.trans_of is None:
        return before_cutoff(t.trans, t.loans, KEY, ts="date_")
    dated = t.trans_of(link_limits(t.trans_links, t.loans, "link_id", KEY))
    return dated.filter(earlier(F.col("date_"), F.col("_limit"))).select(KEY, *[c for c in t.trans.columns if c != KEY])


def client_account(t: BankTables, literal: bool = False) -> DataFrame:
    return pair_roles(link_clients(t.disp, t.clients), literal=literal)


def rollups(t: BankTables, cutoff: bool, literal: bool = False) -> dict[str, DataFrame]:
    """The per-account rollups a mart joins, all keyed by ``account_id``."""
    trans = trans_before_loan(t) if cutoff else t.trans
    cards = (cards_before_loan_linked(t.cards, t.card_links, t.loans) if cutoff
             else link_cards(t.cards, t.card_links))
    return {
        "client_account": client_account(t, literal),
        "orders": rollup_by_category(t.orders, KEY, "k_symbol", "amount"),
        "trans": txn_rollup(trans, KEY, literal_balance=literal),
        "cards": card_rollup(cards, None, KEY, per_type=literal),
    }


LOAN_COLUMNS = [
    ("loan_id", "loan_id"), ("date_", "date_loan"), ("amount", "amount_loan"),
    ("duration", "duration_loan"), ("payments", "payments_loan"), ("status_", "status_loan"),
    ("current", "current_loan"), ("good_status", "good_status_loan"),
]


def as_of(loan_date: str, pool_date: str | None) -> Column:
    """The loan's date, or the pool's reference date where there is no loan."""
    return F.col(loan_date) if pool_date is None else F.coalesce(F.col(loan_date), date_literal(pool_date))


def build_mart(t: BankTables, root: str = "accounts", cutoff: bool = True,
               literal: bool = False, tenure: bool | None = None,
               district_max_rows: int = BROADCAST_MAX_ROWS, rolled: dict[str, DataFrame] | None = None,
               pool_date: str | None = None) -> DataFrame:
    """Wide feature mart.

    root     ``'accounts'`` (every account, loan or not) or ``'loans'``
    cutoff   roll up transactions and cards only before the account's loan
    literal  source-text quirks: the client count replaces the user id, and
             cards are grouped per (account, type)
    tenure   add ``days_with_bank`` and ``age_at_loan`` (default: account root)
    rolled   the rollups, where they are made elsewhere (default: :func:`rollups`)
    pool_date  date as of which tenure and age of accounts without a loan are
             taken (default: none, they stay NULL as in the source, and the
             fill plan turns them into 0, which no training row has)
    """
    tenure = (root == "accounts") if tenure is None else tenure
    if cutoff:
        assert_one_cutoff(t.loans, KEY)  # several loans would repeat the account's rows
    r = rollups(t, cutoff, literal) if rolled is None else rolled
    loans = t.loans.select(KEY, *[F.col(a).alias(b) for a, b in LOAN_COLUMNS])
    accts = t.accounts.select(KEY, "district_id", F.col("frequency").alias("freq_dep_acc"),
                              F.col("date_").alias("date_account"))
    base = (accts.join(loans, KEY, "left") if root == "accounts"
            else loans.join(accts, KEY, "left"))
    for name in ("client_account", "orders", "trans", "cards"):
        base = base.join(r[name], KEY, "left")
    dist = t.district.withColumnRenamed("district_id", "district_id_demo")
    base = base.join(broadcast_if_small(dist, district_max_rows),
                     F.col("district_id") == F.col("district_id_demo"), "left")

    ca = [c for c in r["client_account"].columns if c != KEY]
    head = [KEY, "loan_id", "client_id", "district_id", "date_loan", "amount_loan",
            "duration_loan", "payments_loan", "status_loan", "current_loan",
            "good_status_loan", "freq_dep_acc", "date_account"]
    cols = [F.col(c) for c in head]
    if tenure:
        cols.append(days_between(as_of("date_loan", pool_date), "date_account").alias("days_with_bank"))
    cols.append(F.col("client_district_id"))
    cols.append(F.col("birth_date").alias("bday_client"))
    if tenure:
        cols.append(years_between(as_of("date_loan", pool_date), "birth_date").alias("age_at_loan"))
    cols.append(F.col("sex").alias("sex_client"))
    cols += [F.col(c) for c in ca
             if c not in ("client_id", "client_district_id", "birth_date", "sex")]
    for name in ("orders", "trans", "cards"):
        cols += [F.col(c) for c in r[name].columns if c != KEY]
    cols += [F.col(c) for c in dist.columns]
    return base.select(*cols)


def mart_loans(t: BankTables, literal: bool = False) -> DataFrame:
    """Loan-rooted mart over all history."""
    return build_mart(t, root="loans", cutoff=False, literal=literal)


def mart_accounts(t: BankTables, literal: bool = False) -> DataFrame:
    """Account-rooted mart over all history, with tenure and age."""
    return build_mart(t, root="accounts", cutoff=False, literal=literal)


def mart_cutoff(t: BankTables, literal: bool = False) -> DataFrame:
    """Account-rooted mart over rows dated before each account's loan."""
    return build_mart(t, root="accounts", cutoff=True, literal=literal)


def tenure_age(t: BankTables, pool_date: str | None = None) -> DataFrame:
    """Days with the bank and owner's age at the loan (or at ``pool_date``), per account."""
    ca = client_account(t).select(KEY, "birth_date")
    j = (t.accounts.select(KEY, F.col("date_").alias("date_account"))
         .join(t.loans.select(KEY, F.col("date_").alias("date_loan")), KEY, "left")
         .join(ca, KEY, "left"))
    until = as_of("date_loan", pool_date)
    return j.select(KEY, days_between(until, "date_account").alias("days_with_bank"),
                    years_between(until, "birth_date").alias("age_at_loan"))
