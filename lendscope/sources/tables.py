"""The typed bank tables every plan in the library consumes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass
class BankTables:
    """Typed, recoded tables (one attribute per source extract).

    loans       loan_id, account_id, date_, amount, duration, payments, status_,
                current, good_status
    accounts    account_id, district_id, frequency, date_
    disp        disp_id, client_id, account_id, type_          (client <-> account)
    clients     client_id, district_id, birth_number, birth_date, sex
    orders      order_id, account_id, amount, k_symbol          (standing orders)
    trans       trans_id, account_id, date_, type_, operation, amount, balance
    cards       card_id, disp_id, type_, issued
    card_links  disp_id, account_id   (link rows cards hang off; ``disp`` for
                bank extracts)
    district    district_id, district_name, region, <numeric attributes>

    Where transactions name their account through a link row (else both are None):

    trans_links link_id, account_id
    trans_of    function of such link rows, with or without further columns: their transactions, typed as ``trans``
                and with those further columns
    """

    loans: DataFrame
    accounts: DataFrame
    disp: DataFrame
    clients: DataFrame
    orders: DataFrame
    trans: DataFrame
    cards: DataFrame
    card_links: DataFrame
    district: DataFrame
    trans_links: DataFrame | None = None
    trans_of: Callable[[DataFrame], DataFrame] | None = None
