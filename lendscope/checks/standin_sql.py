"""The stand-in bank tables written as DuckDB SQL (used by the oracle).

Each CTE computes directly from typed columns what the Spark stand-ins
compute through the raw-text load path, so a match checks both the load
functions and the operators built on them.
"""

from __future__ import annotations

STANDIN_CTES = {
    "loans": """
    loans AS (
      SELECT o_orderkey AS loan_id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS date_,
             CAST(floor(o_totalprice) AS BIGINT) AS amount,
             CAST(12 * (1 + o_orderkey % 5) AS INTEGER) AS duration,
             CAST(CAST(floor(o_totalprice * 100 / CAST(12 * (1 + o_orderkey % 5) AS INTEGER))
                       AS BIGINT) * 0.01 AS DECIMAL(10,2)) AS payments,
             st AS status_,
             CASE WHEN st IN ('C', 'D') THEN 1 ELSE 0 END AS current,
             CASE WHEN st IN ('A', 'C') THEN 1 ELSE 0 END AS good_status
      FROM (SELECT *,
                   CASE WHEN o_orderstatus = 'F' THEN 'A' WHEN o_orderstatus = 'O' THEN 'C'
                        WHEN o_orderkey % 2 = 0 THEN 'B' ELSE 'D' END AS st,
                   row_number() OVER (PARTITION BY o_custkey
                                      ORDER BY o_orderdate, o_orderkey) AS rn
            FROM orders WHERE o_orderpriority = '1-URGENT') u
      WHERE rn = 1)""",
    "accounts": """
    accounts AS (
      SELECT c_custkey AS account_id, c_nationkey AS district_id,
             CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'weekly' WHEN 'BUILDING' THEN 'monthly'
                  WHEN 'FURNITURE' THEN 'after_transaction' WHEN 'HOUSEHOLD' THEN 'monthly'
                  WHEN 'MACHINERY' THEN 'monthly' ELSE c_mktsegment END AS frequency,
             CAST(op.opened AS DATE) AS date_
      FROM customer
      LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS opened FROM orders GROUP BY o_custkey) op
        ON op.o_custkey = c_custkey)""",
    "ranked_orders": """
    ranked_orders AS (
      SELECT o_orderkey, o_custkey, o_orderdate,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rnk
      FROM orders)""",
    "disp": """
    disp AS (
      SELECT o_orderkey AS disp_id, o_orderkey AS client_id, o_custkey AS account_id,
             CASE WHEN rnk = 1 THEN 'OWNER' ELSE 'USER' END AS type_
      FROM ranked_orders WHERE rnk <= 2)""",
    "clients": """
    clients AS (
      SELECT o_orderkey AS client_id,
             strftime(o_orderdate, '%y')
               || lpad(CAST(month(o_orderdate) + CASE WHEN o_orderkey % 2 = 0 THEN 50 ELSE 0 END
                            AS VARCHAR), 2, '0')
               || strftime(o_orderdate, '%d') AS birth_number,
             CAST(CASE WHEN o_orderkey % 10 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END
                  AS INTEGER) AS district_id,
             CAST(try_strptime('19' || strftime(o_orderdate, '%y%m%d'), '%Y%m%d') AS DATE)
               AS birth_date,
             CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex
      FROM ranked_orders JOIN customer ON c_custkey = o_custkey
      WHERE rnk <= 2)""",
    "sorders": """
    sorders AS (
      SELECT event_id AS order_id, user_id AS account_id, CAST(value AS DECIMAL(12,2)) AS amount,
             CASE event_type WHEN 'view' THEN 'housing' WHEN 'click' THEN 'loan'
                  WHEN 'purchase' THEN 'insurance' WHEN 'signup' THEN 'leasing'
                  WHEN 'error' THEN ' ' ELSE event_type END AS k_symbol
      FROM events)""",
    "trans": """
    trans AS (
      SELECT l_orderkey * 10 + l_linenumber AS trans_id, o_custkey AS account_id,
             CAST(l_shipdate AS DATE) AS date_,
             CASE l_returnflag WHEN 'R' THEN 'credit' WHEN 'A' THEN 'withdrawl'
                  WHEN 'N' THEN 'withdrawl' ELSE l_returnflag END AS type_,
             CASE l_returnflag || l_linestatus WHEN 'RF' THEN 'cash_credit'
                  WHEN 'RO' THEN 'bank_collection' WHEN 'AF' THEN 'card_withdrawl'
                  WHEN 'AO' THEN 'cash_withdrawl' WHEN 'NF' THEN 'bank_remittance'
                  ELSE '' END AS operation,
             CAST(l_extendedprice AS DECIMAL(15,2)) AS amount,
             CAST(CAST(l_extendedprice AS DECIMAL(15,2)) - 50000 AS VARCHAR) AS balance
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""",
    "cards": """
    cards AS (
      SELECT l_orderkey * 10 + l_linenumber AS card_id, l_orderkey AS disp_id,
             CASE p_type WHEN 'ECONOMY' THEN 'classic' WHEN 'STANDARD' THEN 'junior'
                  WHEN 'PROMO' THEN 'gold' END AS type_,
             CAST(l_shipdate AS DATE) AS issued
      FROM lineitem JOIN part ON p_partkey = l_partkey
      WHERE p_type IN ('ECONOMY', 'STANDARD', 'PROMO'))""",
    "card_links": """
    card_links AS (SELECT o_orderkey AS disp_id, o_custkey AS account_id FROM orders)""",
    "district": """
    district AS (
      SELECT n_nationkey AS district_id, n_name AS district_name, r_name AS region,
             coalesce(nc.n, 0) AS n_inhab, coalesce(ns.n, 0) AS n_cities
      FROM nation JOIN region ON r_regionkey = n_regionkey
      LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) nc
        ON nc.c_nationkey = n_nationkey
      LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ns
        ON ns.s_nationkey = n_nationkey)""",
    "scores": """
    scores AS (
      SELECT o_orderkey AS account_id, o_totalprice / 500000 AS score_0,
             (o_totalprice % 250000) / 250000 AS score_1,
             CAST(o_custkey % 100 AS DOUBLE) / 100 AS score_2,
             CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS good_status_loan
      FROM orders)""",
}


def with_standins(select_sql: str, extra_ctes: str = "") -> str:
    """Prefix a query with every stand-in CTE (unused ones cost nothing)."""
    ctes = ",".join(STANDIN_CTES.values())
    if extra_ctes:
        ctes += "," + extra_ctes
    return f"WITH {ctes}\n{select_sql}"
