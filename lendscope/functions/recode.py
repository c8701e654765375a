"""Code recoding, character stripping and loan status flags.

``recode`` is a single CASE expression (codegen'd, no map lookup per row).
In ``literal`` mode it reproduces the source's chain of text replacements on
values that still carry their double quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Source codes and the labels they are recoded to.  They must
# equal the source data's codes, so they are stated here as plain text, in
# the order the recodes are applied.
# ---------------------------------------------------------------------------
FREQUENCY_CODES = {
    "POPLATEK MESICNE": "monthly",
    "POPLATEK TYDNE": "weekly",
    "POPLATEK PO OBRATU": "after_transaction",
}
DISP_TYPE_CODES = {
    "DISPONENT": "USER",
}
ORDER_SYMBOL_CODES = {
    "POJISTNE": "insurance",
    "SIPO": "housing",
    "LEASING": "leasing",
    "UVER": "loan",
}
TRANS_TYPE_CODES = {
    "PRIJEM": "credit",
    "VYDAJ": "withdrawl",
    "VYBER": "withdrawl",
}
OPERATION_CODES = {
    "VYBER KARTOU": "card_withdrawl",
    "VKLAD": "cash_credit",
    "PREVOD Z UCTU": "bank_collection",
    "VYBER": "cash_withdrawl",
    "PREVOD NA UCET": "bank_remittance",
}
TRANS_SYMBOL_CODES = {
    "POJISTNE": "insurance",
    "SLUZBY": "statement",
    "UROK": "intrestcredit",
    "SANKC. UROK": "intrest_nbal",
    "SIPO": "housing",
    "DUCHOD": "oldage_pension",
    "UVER": "loan",
}
# Loan status letters: running loans are C and D, good loans are A and C.
CURRENT_STATUSES = ("C", "D")
GOOD_STATUSES = ("A", "C")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_chars(c, chars: str = '"\r') -> Column:
    """Delete every occurrence of each character in ``chars``."""
    return F.translate(_col(c), chars, "")


def recode(c, mapping: dict[str, str], literal: bool = False) -> Column:
    """Replace whole codes by labels; unknown values pass through unchanged.

    ``literal=True`` applies the replacements one after another as substring
    replacements of the quoted codes (``'"CODE"'``), as the source's nested
    ``replace`` calls do on unquoted-at-load text.  Because every quoted code
    carries both quotes, no code is a substring of another and the two modes
    agree on clean input.
    """
    col = _col(c)
    if literal:
        out = col
        for code, label in mapping.items():
            out = F.replace(out, F.lit(f'"{code}"'), F.lit(label))
        return out
    expr = None
    for code, label in mapping.items():
        expr = (F.when(col == code, F.lit(label)) if expr is None
                else expr.when(col == code, F.lit(label)))
    return expr.otherwise(col) if expr is not None else col


def recode_disp_type(c, literal: bool = False) -> Column:
    """Link role: strip CR and quotes, then DISPONENT -> USER."""
    col = strip_chars(c, '\r"')
    if literal:
        return F.replace(col, F.lit("DISPONENT"), F.lit("USER"))
    return recode(col, DISP_TYPE_CODES)


def strip_account_zeros(c, literal: bool = False) -> Column:
    """Counterparty account cleanup.

    Literal: delete every ``0`` digit (what the source text does).  Intent:
    only a bare ``'0'`` (the placeholder for "no account") becomes empty.
    """
    col = strip_chars(c, "\r")
    if literal:
        return F.replace(col, F.lit("0"), F.lit(""))
    return F.when(col == "0", F.lit("")).otherwise(col)


def add_status_flags(df: DataFrame, status: str = "status_",
                     current: str = "current", good: str = "good_status") -> DataFrame:
    """Add 0/1 ``current`` and ``good`` flags derived from the status letter."""
    s = strip_chars(status, '"')
    return (df.withColumn(status, s)
              .withColumn(current, F.when(F.col(status).isin(*CURRENT_STATUSES), 1).otherwise(0))
              .withColumn(good, F.when(F.col(status).isin(*GOOD_STATUSES), 1).otherwise(0)))
