"""Bank tables derived from the TPC-H-like test tables.

The test tables carry no bank data, so each bank notion is defined on them
(see FIXTURES.md §3).  Every stand-in first produces the *raw* text form an
extract would have (codes, ``YYMMDD`` dates, birth numbers) and then runs
the library's own recodes, date and birth decoding; numbers are cast plainly
(the lenient typing has queries of its own).  All of them are lazy
projections, joins and aggregates of the test tables: nothing is stored, a
query reads the tables it needs, and its work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.functions.birth import birth_number_from_date, decode_birth
from lendscope.functions.dates import format_yymmdd, format_yymmdd_time, parse_yymmdd, parse_yymmdd_time
from lendscope.functions.recode import (FREQUENCY_CODES, OPERATION_CODES, ORDER_SYMBOL_CODES,
                                        TRANS_TYPE_CODES, add_status_flags, recode)
from lendscope.operators.dedup import dedup_first, first_k_per_key
from lendscope.sources.tables import BankTables

# Stand-in definitions (our own test mapping, not source values): which test
# value plays which raw bank code.
SEGMENT_FREQUENCY = {
    "AUTOMOBILE": "POPLATEK TYDNE",
    "BUILDING": "POPLATEK MESICNE",
    "FURNITURE": "POPLATEK PO OBRATU",
    "HOUSEHOLD": "POPLATEK MESICNE",
    "MACHINERY": "POPLATEK MESICNE",
}
EVENT_SYMBOL = {"view": "SIPO", "click": "UVER", "purchase": "POJISTNE", "signup": "LEASING",
                "error": " "}
RETURNFLAG_TYPE = {"R": "PRIJEM", "A": "VYDAJ", "N": "VYBER"}
FLAG_STATUS_OPERATION = {"RF": "VKLAD", "RO": "PREVOD Z UCTU", "AF": "VYBER KARTOU",
                         "AO": "VYBER", "NF": "PREVOD NA UCET"}
PART_TYPE_CARD = {"ECONOMY": "classic", "STANDARD": "junior", "PROMO": "gold"}
LOAN_PRIORITY = "1-URGENT"
BALANCE_OFFSET = 50000
N_DISTRICTS = 25


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Read one test table, pruned to ``cols`` (pruning reaches the scan)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def _map(c: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr.otherwise(c if default is None else default)


# ---------------------------------------------------------------------------
# raw extracts (text columns, as a CSV reader would return them)
# ---------------------------------------------------------------------------

def raw_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First urgent order per customer as a raw loan row (all text)."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate",
                   "o_totalprice", "o_orderstatus", "o_orderpriority")
    first = dedup_first(o.filter(F.col("o_orderpriority") == LOAN_PRIORITY)
                         .drop("o_orderpriority"),
                        ["o_custkey"], ["o_orderdate", "o_orderkey"])
    duration = (F.lit(12) * (F.lit(1) + F.col("o_orderkey") % 5)).cast("int")
    cents = F.floor(F.col("o_totalprice") * 100 / duration)
    payments = (cents.cast("decimal(12,0)") / 100).cast("decimal(10,2)")
    status = (F.when(F.col("o_orderstatus") == "F", "A")
               .when(F.col("o_orderstatus") == "O", "C")
               .when(F.col("o_orderkey") % 2 == 0, "B").otherwise("D"))
    return first.select(
        F.col("o_orderkey").cast("string").alias("loan_id"),
        F.col("o_custkey").cast("string").alias("account_id"),
        format_yymmdd("o_orderdate").alias("date"),
        F.floor("o_totalprice").cast("string").alias("amount"),
        duration.cast("string").alias("duration"),
        payments.cast("string").alias("payments"),
        status.alias("status"))


def raw_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    o = read_table(spark, sf_dir, "orders", "o_custkey", "o_orderdate")
    opened = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("_opened"))
    j = c.join(opened, c.c_custkey == opened.o_custkey, "left")
    return j.select(
        F.col("c_custkey").cast("string").alias("account_id"),
        F.col("c_nationkey").cast("string").alias("district_id"),
        _map(F.col("c_mktsegment"), SEGMENT_FREQUENCY).alias("frequency"),
        format_yymmdd("_opened").alias("date"))


def _owner_user_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    return first_k_per_key(o, "o_custkey", ["o_orderdate", "o_orderkey"], 2, "rank")


def raw_disp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner = first order of a customer, user (``DISPONENT``) = second."""
    t = _owner_user_orders(spark, sf_dir)
    return t.select(
        F.col("o_orderkey").cast("string").alias("disp_id"),
        F.col("o_orderkey").cast("string").alias("client_id"),
        F.col("o_custkey").cast("string").alias("account_id"),
        F.when(F.col("rank") == 1, "OWNER").otherwise("DISPONENT").alias("type"))


def raw_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients of the owner/user links; even keys are women (month + 50)."""
    t = _owner_user_orders(spark, sf_dir)
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    # null-safe, and no null customers: the links are then ranked by the same plan as in raw_disp, and only once
    j = t.join(c.filter(F.col("c_custkey").isNotNull()), t.o_custkey.eqNullSafe(c.c_custkey), "inner")
    district = F.when(F.col("o_orderkey") % 10 == 0,
                      (F.col("c_nationkey") + 1) % N_DISTRICTS).otherwise(F.col("c_nationkey"))
    return j.select(
        F.col("o_orderkey").cast("string").alias("client_id"),
        birth_number_from_date(F.col("o_orderdate"), F.col("o_orderkey") % 2 == 0)
        .alias("birth_number"),
        district.cast("string").alias("district_id"))


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    return e.select(
        F.col("event_id").cast("string").alias("order_id"),
        F.col("user_id").cast("string").alias("account_id"),
        F.col("value").cast("string").alias("amount"),
        _map(F.col("event_type"), EVENT_SYMBOL).alias("k_symbol"))


def standin_trans_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders link line items (transactions) to their customer (account)."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    return o.select(F.col("o_orderkey").alias("link_id"), F.col("o_custkey").alias("account_id"))


def raw_trans(spark: SparkSession, sf_dir: str, links: DataFrame | None = None, decoded: bool = False) -> DataFrame:
    """Line items of the linked orders (default: all); further columns of ``links`` follow.

    ``decoded``: the date is read from its text, as ``date_``, before the join, so that a test on it needs no second look
    at the text."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice",
                    "l_returnflag", "l_linestatus", "l_shipdate")
    li = li.withColumn("date", format_yymmdd("l_shipdate")).drop("l_shipdate")
    if decoded:
        li = li.withColumn("date_", parse_yymmdd("date")).drop("date")
    o = standin_trans_links(spark, sf_dir) if links is None else links
    j = li.join(o, li.l_orderkey == o.link_id, "inner")
    amount = F.col("l_extendedprice").cast("decimal(15,2)")
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("trans_id"),
        F.col("account_id").cast("string").alias("account_id"),
        "date_" if decoded else "date",
        _map(F.col("l_returnflag"), RETURNFLAG_TYPE).alias("type"),
        _map(F.concat("l_returnflag", "l_linestatus"), FLAG_STATUS_OPERATION, F.lit(""))
        .alias("operation"),
        amount.cast("string").alias("amount"),
        (amount - BALANCE_OFFSET).cast("string").alias("balance"),
        *_further(o))


def _further(links: DataFrame) -> list[Column]:
    return [F.col(c) for c in links.columns if c not in ("link_id", "account_id")]


def raw_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey",
                    "l_shipdate")
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_type")
    p = p.filter(F.col("p_type").isin(*PART_TYPE_CARD))
    j = li.join(p, li.l_partkey == p.p_partkey, "inner")
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("card_id"),
        F.col("l_orderkey").cast("string").alias("disp_id"),
        _map(F.col("p_type"), PART_TYPE_CARD).alias("type"),
        format_yymmdd_time("l_shipdate").alias("issued"))


# ---------------------------------------------------------------------------
# typed tables
# ---------------------------------------------------------------------------

def standin_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw_loans(spark, sf_dir)
    typed = r.select(
        F.col("loan_id").cast("bigint"), F.col("account_id").cast("bigint"),
        parse_yymmdd("date").alias("date_"), F.col("amount").cast("bigint"),
        F.col("duration").cast("int"), F.col("payments").cast("decimal(10,2)"),
        F.col("status").alias("status_"))
    return add_status_flags(typed)


def standin_every_loan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All urgent orders of every customer as loans: accounts with several."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return o.filter(F.col("o_orderpriority") == LOAN_PRIORITY).select(
        F.col("o_orderkey").alias("loan_id"), F.col("o_custkey").alias("account_id"),
        parse_yymmdd(format_yymmdd("o_orderdate")).alias("date_"))


def standin_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw_accounts(spark, sf_dir)
    return r.select(F.col("account_id").cast("bigint"), F.col("district_id").cast("int"),
                    recode("frequency", FREQUENCY_CODES).alias("frequency"),
                    parse_yymmdd("date").alias("date_"))


def standin_disp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendscope.functions.recode import recode_disp_type
    r = raw_disp(spark, sf_dir)
    return r.select(F.col("disp_id").cast("bigint"), F.col("client_id").cast("bigint"),
                    F.col("account_id").cast("bigint"), recode_disp_type("type").alias("type_"))


def standin_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw_clients(spark, sf_dir)
    typed = r.select(F.col("client_id").cast("bigint"), F.col("birth_number"),
                     F.col("district_id").cast("int"))
    return decode_birth(typed)


def standin_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw_orders(spark, sf_dir)
    return r.select(F.col("order_id").cast("bigint"), F.col("account_id").cast("bigint"),
                    F.col("amount").cast("decimal(12,2)"),
                    recode("k_symbol", ORDER_SYMBOL_CODES).alias("k_symbol"))


def standin_trans(spark: SparkSession, sf_dir: str, links: DataFrame | None = None) -> DataFrame:
    r = raw_trans(spark, sf_dir, links, decoded=True)
    return r.select(F.col("trans_id").cast("bigint"), F.col("account_id").cast("bigint"), "date_",
                    recode("type", TRANS_TYPE_CODES).alias("type_"),
                    recode("operation", OPERATION_CODES).alias("operation"),
                    F.col("amount").cast("decimal(15,2)"), F.col("balance"),
                    *([] if links is None else _further(links)))


def standin_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw_cards(spark, sf_dir)
    return r.select(F.col("card_id").cast("bigint"), F.col("disp_id").cast("bigint"),
                    F.col("type").alias("type_"), parse_yymmdd_time("issued").alias("issued"))


def standin_card_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    return o.select(F.col("o_orderkey").alias("disp_id"), F.col("o_custkey").alias("account_id"))


def standin_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    cust = (read_table(spark, sf_dir, "customer", "c_nationkey")
            .groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("_nc")))
    supp = (read_table(spark, sf_dir, "supplier", "s_nationkey")
            .groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("_ns")))
    j = (n.join(r, n.n_regionkey == r.r_regionkey, "inner")
          .join(cust, n.n_nationkey == cust.c_nationkey, "left")
          .join(supp, n.n_nationkey == supp.s_nationkey, "left"))
    return j.select(F.col("n_nationkey").alias("district_id"),
                    F.col("n_name").alias("district_name"),
                    F.col("r_name").alias("region"),
                    F.coalesce("_nc", F.lit(0)).alias("n_inhab"),
                    F.coalesce("_ns", F.lit(0)).alias("n_cities"))


def standin_tables(spark: SparkSession, sf_dir: str) -> BankTables:
    return BankTables(
        loans=standin_loans(spark, sf_dir),
        accounts=standin_accounts(spark, sf_dir),
        disp=standin_disp(spark, sf_dir),
        clients=standin_clients(spark, sf_dir),
        orders=standin_orders(spark, sf_dir),
        trans=standin_trans(spark, sf_dir),
        cards=standin_cards(spark, sf_dir),
        card_links=standin_card_links(spark, sf_dir),
        district=standin_district(spark, sf_dir),
        trans_links=standin_trans_links(spark, sf_dir),
        trans_of=lambda links: standin_trans(spark, sf_dir, links))


def standin_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three score columns and a 0/1 label per order (evaluation stand-in)."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice",
                   "o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("account_id"),
        (F.col("o_totalprice") / 500000).alias("score_0"),
        ((F.col("o_totalprice") % 250000) / 250000).alias("score_1"),
        ((F.col("o_custkey") % 100).cast("double") / 100).alias("score_2"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("good_status_loan"))
