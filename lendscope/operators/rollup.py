"""Child-table rollups to one row per account.

Every rollup is one ``groupBy(key).agg(...)`` with conditional aggregates,
so Spark runs a partial aggregate on each map task (a hot account is
combined before the shuffle) and a final aggregate after one shuffle on the
key.  All rollups share the key, so the mart joins reuse their partitioning.

Means of decimal amounts are ``double(sum) / count``: the sum is exact and
one division follows, which is both fast and reproducible bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# Order symbols and the column suffix used for each.
ORDER_CATEGORIES = {
    "housing": "housing",
    "loan": "loan",
    "insur": "insurance",
    "leas": "leasing",
}
# Card types counted per account.
CARD_TYPES = ("gold", "classic", "junior")
# Transaction operations counted per account.
OPERATION_COUNTS = {
    "n_cash_deposit": "cash_credit",
    "n_bank_collection": "bank_collection",
    "n_cash_withdrawl": "cash_withdrawl",
    "n_bank_remit": "bank_remittance",
    "n_card_withdrawl": "card_withdrawl",
}


def mean(x: Column, dec: DecimalType | None = None) -> Column:
    """Mean of the non-NULL values: ``double(sum(x)) / count(x)``, the sum exact."""
    return F.try_divide(exact_sum(x, dec).cast("double"), F.count(x))


def _fast(dec: DecimalType | None) -> bool:
    return isinstance(dec, DecimalType) and dec.precision <= 15


#: Units of the low half of a split amount.
_HALF = 10 ** 8


def unscaled(x: Column, dec: DecimalType) -> Column:
    """Exact unscaled integer of a decimal with precision <= 15 (e.g. cents).

    ``|x| * 10^s < 10^15 < 2^53``, so the double product is within far less
    than 0.5 of the integer and ``floor(. + 0.5)`` recovers it exactly.
    """
    return F.floor(x.cast("double") * F.lit(float(10 ** dec.scale)) + F.lit(0.5))


def exact_sum(x: Column, dec: DecimalType | None = None) -> Column:
    """``sum(x)`` with Spark's result type ``decimal(p + 10, s)``.

    For decimals of precision <= 15 two long buffers hold the sums of the
    high and the low digits (each part below 10^8, so 9 * 10^10 rows fit a
    buffer) instead of one BigDecimal; the halves meet again in decimal.
    """
    if not _fast(dec):
        return F.sum(x)
    p = min(38, dec.precision + 10)
    u = unscaled(x, dec)
    low = F.pmod(u, F.lit(_HALF))
    high = ((u - low) / F.lit(_HALF)).cast("long")
    total = (F.sum(high).cast("decimal(28,0)") * F.lit(_HALF).cast("decimal(9,0)")
             + F.sum(low).cast("decimal(28,0)")).cast(f"decimal({p},0)")
    return (total / F.lit(10 ** dec.scale)).cast(f"decimal({p},{dec.scale})")


def std_pop(x: Column) -> Column:
    """Population standard deviation (a single value gives 0.0)."""
    return F.stddev_pop(x.cast("double"))


def count_when(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def sum_when(cond: Column, x: Column, default_zero: bool,
             dec: DecimalType | None = None) -> Column:
    """``sum(if(cond, x, 0))`` or, with ``default_zero=False``, ``sum(if(cond, x, NULL))``."""
    if default_zero:
        return exact_sum(F.when(cond, x).otherwise(F.lit(0)), dec)
    return exact_sum(F.when(cond, x), dec)


def _dtype(df: DataFrame, col: str) -> DecimalType | None:
    dt = df.schema[col].dataType
    return dt if isinstance(dt, DecimalType) else None


def rollup_by_category(df: DataFrame, key: str = "account_id", cat: str = "k_symbol",
                       amount: str = "amount", categories: dict[str, str] | None = None,
                       prefix: str = "orders") -> DataFrame:
    """Count / mean / population deviation overall and per category.

    Output: ``n_{prefix}, avg_{prefix}_amount, std_{prefix}_amount`` and for
    each ``label -> value`` in ``categories``: ``n_{prefix}_{label},
    avg_{prefix}_{label}, std_{prefix}_{label}``.
    """
    categories = ORDER_CATEGORIES if categories is None else categories
    x = F.col(amount)
    dec = _dtype(df, amount)
    aggs = [F.count(F.lit(1)).alias(f"n_{prefix}"),
            mean(x, dec).alias(f"avg_{prefix}_amount"),
            std_pop(x).alias(f"std_{prefix}_amount")]
    for label, value in categories.items():
        hit = F.col(cat) == value
        aggs += [count_when(hit).alias(f"n_{prefix}_{label}"),
                 mean(F.when(hit, x), dec).alias(f"avg_{prefix}_{label}"),
                 std_pop(F.when(hit, x)).alias(f"std_{prefix}_{label}")]
    return df.groupBy(key).agg(*aggs)


def balance_aggs(balance: str = "balance", literal: bool = False) -> list[Column]:
    """Balance statistics on a text balance column.

    Intent: the text is converted to ``decimal(15,2)`` first.  Literal: ``min``
    and ``max`` compare the text itself (``'900' > '1000'``) and are
    converted afterwards, as a server that stores the balance as text does.
    """
    b = F.col(balance).try_cast("decimal(15,2)")
    if literal:
        lo = F.min(F.col(balance)).try_cast("decimal(15,2)")
        hi = F.max(F.col(balance)).try_cast("decimal(15,2)")
    else:
        lo, hi = F.min(b), F.max(b)
    return [mean(b, DecimalType(15, 2)).alias("avg_balance"),
            std_pop(b).alias("std_balance"),
            lo.alias("min_balance"),
            hi.alias("max_balance"),
            count_when(b < 0).alias("n_neg_balance")]


def txn_rollup(df: DataFrame, key: str = "account_id", literal_balance: bool = False) -> DataFrame:
    """The 21 per-account transaction statistics."""
    amt = F.col("amount")
    dec = _dtype(df, "amount")
    credit = F.col("type_") == "credit"
    withdrawal = F.col("type_") == "withdrawl"
    aggs = [F.count(F.lit(1)).alias("n_trans"),
            count_when(credit).alias("n_credit_trans"),
            sum_when(credit, amt, True, dec).alias("sum_credit_trans"),
            mean(F.when(credit, amt), dec).alias("avg_credit_trans"),
            std_pop(F.when(credit, amt)).alias("std_credit_trans"),
            count_when(withdrawal).alias("n_withdrawl_trans"),
            sum_when(withdrawal, amt, True, dec).alias("sum_withdrawl_trans"),
            mean(F.when(withdrawal, amt), dec).alias("avg_withdrawl_trans"),
            std_pop(F.when(withdrawal, amt)).alias("std_withdrawl_trans")]
    aggs += [count_when(F.col("operation") == op).alias(name)
             for name, op in OPERATION_COUNTS.items()]
    aggs += [sum_when(credit, amt, False, dec).alias("total_credits_amount"),
             sum_when(withdrawal, amt, False, dec).alias("total_withdrawls_amount")]
    aggs += balance_aggs("balance", literal_balance)
    return df.groupBy(key).agg(*aggs)


def balance_stats(df: DataFrame, key: str = "account_id", literal: bool = False) -> DataFrame:
    """Only the balance part of :func:`txn_rollup`."""
    return df.groupBy(key).agg(*balance_aggs("balance", literal))


#: log2 of a distinct-count sketch's registers: a relative error of about 0.8 %, 8 KB at most.
SKETCH_LG = 14


def distinct_sketch(df: DataFrame, keys: list[str], value: str, out: str = "sketch", lg: int = SKETCH_LG) -> DataFrame:
    """One mergeable sketch of the distinct ``value`` for each group, e.g. by account and month."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(F.col(value), F.lit(lg)).alias(out))


def merge_sketches(sketches: DataFrame, keys: list[str], out: str = "n_distinct", sketch: str = "sketch") -> DataFrame:
    """Distinct counts of wider groups from stored sketches, without the rows they were made of."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg(sketch)).alias(out))


def card_rollup(cards: DataFrame, links: DataFrame | None = None, key: str = "account_id",
                link_key: str = "disp_id", per_type: bool = False, approximate: bool = False) -> DataFrame:
    """Distinct cards and cards per type, per account.

    Cards are left-joined to their link rows for the account (pass
    ``links=None`` when ``cards`` already carry ``key``).  With
    ``per_type=True`` the grouping also includes the card type, which yields
    one row per (account, type) as the source's grouping does.
    ``approximate`` counts distinct cards by a sketch of bounded size instead
    of shuffling every distinct id (error about 0.8 %; off by default).
    """
    joined = (cards if links is None
              else cards.join(links.select(link_key, key), on=link_key, how="left"))
    t = F.col("type_")
    distinct = (F.hll_sketch_estimate(F.hll_sketch_agg("card_id", F.lit(SKETCH_LG))) if approximate
                else F.count_distinct(F.col("card_id")))
    aggs = [distinct.alias("n_cards")]
    aggs += [count_when(t == ct).alias(f"n_cards_{ct}") for ct in CARD_TYPES]
    group = [key, "type_"] if per_type else [key]
    out = joined.groupBy(*group).agg(*aggs)
    return out.drop("type_") if per_type else out
