"""Mergeable day states of the transaction rollup.

One row per (account, day) holds partials from which every transaction
statistic can be finished, over any set of days: counts, the two long halves
of exact decimal sums, sums of squares, minima and maxima.  States of several
days merge by adding (or by min / max), so one read of the transactions
serves

* the all-history rollup and the before-loan rollup together
  (:func:`txn_rollup_both`), and
* a rollup as of every loan of an account, however many it has
  (:func:`asof_rollup`): running totals over the account's days.

At scale: the transactions are read once and combined before the first
shuffle, which is by account *and* day, so an account that holds a third of
all rows spreads over its days; afterwards an account has at most one row per
calendar day, which bounds every later join, group and window.

Amounts and balances are decimals of at most 15 digits, as in the tables
(others raise).  Rows without a date count for the whole history and are
before no loan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from lendscope.functions.dates import NO_LOAN_CUTOFF, date_literal
from lendscope.operators.rollup import _HALF, OPERATION_COUNTS, _fast, count_when, unscaled

DEC = DecimalType(15, 2)
SIDES = ("credit", "withdrawl")
KEY, DAY = "account_id", "date_"


def _amount_partials(x: Column, name: str) -> dict[str, Column]:
    """Non-NULL count, sum in two halves of its cents, and sum of squares."""
    u = unscaled(x, DEC)
    low = F.pmod(u, F.lit(_HALF))
    return {f"cnt_{name}": F.count(x), f"low_{name}": F.sum(low),
            f"high_{name}": F.sum(((u - low) / F.lit(_HALF)).cast("long")),
            f"squares_{name}": F.sum(x.cast("double") * x.cast("double"))}


def _partials(amount: Column) -> dict[str, Column]:
    out = {"n": F.count(F.lit(1))}
    for side in SIDES:
        hit = F.col("type_") == side
        out[f"n_{side}"] = count_when(hit)
        out |= _amount_partials(F.when(hit, amount), side)
    for name, op in OPERATION_COUNTS.items():
        out[name] = count_when(F.col("operation") == op)
    balance = F.col("balance").try_cast(DEC)
    out |= _amount_partials(balance, "balance")
    return out | {"min_balance": F.min(balance), "max_balance": F.max(balance), "n_neg_balance": count_when(balance < 0),
                  "min_text": F.min("balance"), "max_text": F.max("balance")}


#: Every column of a state but the key and the day.
STATE = (
    "n", *[f"{p}_{s}" for s in SIDES for p in ("n", "cnt", "low", "high", "squares")], *OPERATION_COUNTS,
    *[f"{p}_balance" for p in ("cnt", "low", "high", "squares")],
    "min_balance", "max_balance", "n_neg_balance", "min_text", "max_text")


def _merge(name: str) -> Callable[[Column], Column]:
    return F.min if name.startswith("min_") else F.max if name.startswith("max_") else F.sum


def day_states(trans: DataFrame, key: str = KEY, day: str = DAY) -> DataFrame:
    """``key, day`` and the partials of that day's transactions."""
    kind = trans.schema["amount"].dataType
    if not (_fast(kind) and kind.scale == DEC.scale):
        raise TypeError(f"day states need amounts of decimal(p<=15,{DEC.scale}), not {kind.simpleString()}")
    return trans.groupBy(key, day).agg(*[c.alias(n) for n, c in _partials(F.col("amount")).items()])


def merge_states(when: Column | None = None, prefix: str = "") -> list[Column]:
    """Aggregates that merge the states of a group (of those rows where ``when`` holds)."""
    return [_merge(n)(F.col(n) if when is None else F.when(when, F.col(n))).alias(f"{prefix}{n}") for n in STATE]


def statistics(prefix: str = "", out_prefix: str = "", literal_balance: bool = False) -> list[Column]:
    """The 21 statistics of a merged state whose columns begin with ``prefix``; all NULL where it has no row."""
    def c(name: str) -> Column:
        return F.col(f"{prefix}{name}")

    def total(name: str) -> Column:
        cents = c(f"high_{name}").cast("decimal(28,0)") * F.lit(_HALF).cast("decimal(9,0)") + c(f"low_{name}").cast("decimal(28,0)")
        return F.when(c(f"cnt_{name}") > 0, (cents.cast("decimal(25,0)") / F.lit(100)).cast("decimal(25,2)"))

    def average(name: str) -> Column:
        return F.try_divide(total(name).cast("double"), c(f"cnt_{name}"))

    def deviation(name: str) -> Column:
        variance = F.try_divide(c(f"squares_{name}"), c(f"cnt_{name}")) - average(name) * average(name)
        return F.when(c(f"cnt_{name}") > 0, F.sqrt(F.greatest(variance, F.lit(0.0))))

    def total_or_zero(side: str) -> Column:
        # rows of the other side count as zero; a group of this side's rows alone, all without amount, has no sum
        none = (c(f"cnt_{side}") == 0) & (c(f"n_{side}") == c("n"))
        return F.when(~none, F.coalesce(total(side), F.lit(0).cast("decimal(25,2)")))

    lo, hi = (c("min_text").try_cast(DEC), c("max_text").try_cast(DEC)) if literal_balance else (c("min_balance"), c("max_balance"))
    out: dict[str, Column] = {"n_trans": c("n")}
    for side in SIDES:
        out |= {f"n_{side}_trans": c(f"n_{side}"), f"sum_{side}_trans": total_or_zero(side),
                f"avg_{side}_trans": average(side), f"std_{side}_trans": deviation(side)}
    out |= {name: c(name) for name in OPERATION_COUNTS}
    out |= {f"total_{side}s_amount": total(side) for side in SIDES}
    out |= {"avg_balance": average("balance"), "std_balance": deviation("balance"), "min_balance": lo, "max_balance": hi,
            "n_neg_balance": c("n_neg_balance")}
    some = c("n") > 0
    return [F.when(some, v).alias(f"{out_prefix}{k}") for k, v in out.items()]


def _cutoffs(loans: DataFrame, key: str, cut: str, default: str) -> DataFrame:
    return loans.select(F.col(key), F.coalesce(F.col(cut), date_literal(default)).alias("_cutoff"))


def rollup_states(states: DataFrame, key: str = KEY, literal_balance: bool = False) -> DataFrame:
    """The all-history rollup from day states (columns of ``txn_rollup``)."""
    return states.groupBy(key).agg(*merge_states()).select(key, *statistics(literal_balance=literal_balance))


def txn_rollup_both(trans: DataFrame, loans: DataFrame, key: str = KEY, day: str = DAY, cut: str = DAY,
                    default: str = NO_LOAN_CUTOFF, prefix: str = "cut_", literal_balance: bool = False) -> DataFrame:
    """All-history and before-loan statistics of every account with transactions, from one read of them.

    The before-loan columns begin with ``prefix`` and are NULL where no
    transaction is dated before the account's loan (or the default date).
    One loan per account; :func:`asof_rollup` takes several.
    """
    dated = day_states(trans, key, day).join(_cutoffs(loans, key, cut, default), key, "left")
    before = F.col(day) < F.coalesce("_cutoff", date_literal(default))
    merged = dated.groupBy(key).agg(*merge_states(), *merge_states(before, "before_"))
    return merged.select(key, *statistics("", "", literal_balance), *statistics("before_", prefix, literal_balance))


def asof_rollup(trans: DataFrame, loans: DataFrame, key: str = KEY, loan_key: str = "loan_id", day: str = DAY,
                cut: str = DAY, default: str = NO_LOAN_CUTOFF, literal_balance: bool = False) -> DataFrame:
    """``key, loan_key`` and the statistics of the account's transactions dated before that loan, one row per loan.

    An account may have any number of loans: its day states and its loans
    stand in one order of dates, a loan before the states of its own day, and
    running totals of the states reach every loan.  NULL where the account
    has no earlier transaction.
    """
    states = day_states(trans, key, day).where(F.col(day).isNotNull())
    marks = loans.select(F.col(key), F.coalesce(F.col(cut), date_literal(default)).alias(day), F.col(loan_key))
    events = (states.withColumn("_is_state", F.lit(1))
              .unionByName(marks.withColumn("_is_state", F.lit(0)), allowMissingColumns=True))
    so_far = Window.partitionBy(key).orderBy(day, "_is_state").rowsBetween(Window.unboundedPreceding, 0)
    # an account has at most one state per calendar day, whatever its rows
    running = events.select(key, loan_key, "_is_state", *[_merge(n)(F.col(n)).over(so_far).alias(n) for n in STATE])
    return running.where(F.col("_is_state") == 0).select(key, loan_key, *statistics(literal_balance=literal_balance))
