"""DuckDB SQL equal in meaning to each registered Spark query.

Conventions shared with :mod:`lendscope.checks.queries`:
* means of decimal amounts are ``CAST(sum(x) AS DOUBLE) / count(x)``;
* population deviations are rounded to 4 decimals on both sides;
* integer counts are ``count`` / ``count_if`` (BIGINT on both sides).
"""

from __future__ import annotations

from lendscope.checks.standin_sql import with_standins
from lendscope.functions.recode import TRANS_SYMBOL_CODES

NO_LOAN = "DATE '1999-12-31'"


def _mean(x: str) -> str:
    return f"CAST(sum({x}) AS DOUBLE) / count({x})"


def _std(x: str) -> str:
    return f"round(stddev_pop(CAST({x} AS DOUBLE)), 4)"


def _balance_sql(literal: bool = False) -> str:
    b = "TRY_CAST(balance AS DECIMAL(15,2))"
    if literal:
        lo = "TRY_CAST(min(balance) AS DECIMAL(15,2))"
        hi = "TRY_CAST(max(balance) AS DECIMAL(15,2))"
    else:
        lo, hi = f"min({b})", f"max({b})"
    return f"""{_mean(b)} AS avg_balance, {_std(b)} AS std_balance,
      {lo} AS min_balance, {hi} AS max_balance, count_if({b} < 0) AS n_neg_balance"""


def txn_rollup_sql(src: str, literal: bool = False) -> str:
    cr = "CASE WHEN type_ = 'credit' THEN amount END"
    wd = "CASE WHEN type_ = 'withdrawl' THEN amount END"
    ops = [("n_cash_deposit", "cash_credit"), ("n_bank_collection", "bank_collection"),
           ("n_cash_withdrawl", "cash_withdrawl"), ("n_bank_remit", "bank_remittance"),
           ("n_card_withdrawl", "card_withdrawl")]
    op_sql = ",\n      ".join(f"count_if(operation = '{v}') AS {n}" for n, v in ops)
    return f"""SELECT account_id,
      count(*) AS n_trans,
      count_if(type_ = 'credit') AS n_credit_trans,
      CAST(sum(CASE WHEN type_ = 'credit' THEN amount ELSE 0 END) AS DECIMAL(25,2)) AS sum_credit_trans,
      {_mean(cr)} AS avg_credit_trans,
      {_std(cr)} AS std_credit_trans,
      count_if(type_ = 'withdrawl') AS n_withdrawl_trans,
      CAST(sum(CASE WHEN type_ = 'withdrawl' THEN amount ELSE 0 END) AS DECIMAL(25,2)) AS sum_withdrawl_trans,
      {_mean(wd)} AS avg_withdrawl_trans,
      {_std(wd)} AS std_withdrawl_trans,
      {op_sql},
      CAST(sum({cr}) AS DECIMAL(25,2)) AS total_credits_amount,
      CAST(sum({wd}) AS DECIMAL(25,2)) AS total_withdrawls_amount,
      {_balance_sql(literal)}
    FROM {src} GROUP BY account_id"""


def symbol_rollup_sql(src: str = "sorders") -> str:
    parts = [f"count(*) AS n_orders", f"{_mean('amount')} AS avg_orders_amount",
             f"{_std('amount')} AS std_orders_amount"]
    for label, value in [("housing", "housing"), ("loan", "loan"), ("insur", "insurance"),
                         ("leas", "leasing")]:
        x = f"CASE WHEN k_symbol = '{value}' THEN amount END"
        parts += [f"count_if(k_symbol = '{value}') AS n_orders_{label}",
                  f"{_mean(x)} AS avg_orders_{label}", f"{_std(x)} AS std_orders_{label}"]
    return f"SELECT account_id, {', '.join(parts)} FROM {src} GROUP BY account_id"


def card_rollup_sql(src: str, per_type: bool = False) -> str:
    group = "account_id, type_" if per_type else "account_id"
    return f"""SELECT account_id, count(DISTINCT card_id) AS n_cards,
      count_if(type_ = 'gold') AS n_cards_gold, count_if(type_ = 'classic') AS n_cards_classic,
      count_if(type_ = 'junior') AS n_cards_junior
    FROM {src} GROUP BY {group}"""


TRANS_BEFORE = f"""
    trans_before AS (
      SELECT t.trans_id, t.account_id, t.date_, t.type_, t.operation, t.amount, t.balance
      FROM trans t LEFT JOIN loans l ON l.account_id = t.account_id
      WHERE t.date_ < coalesce(l.date_, {NO_LOAN}))"""
CARDS_LINKED = """
    cards_linked AS (
      SELECT c.card_id, c.disp_id, c.type_, c.issued, k.account_id
      FROM cards c LEFT JOIN card_links k ON k.disp_id = c.disp_id)"""
CARDS_BEFORE = f"""
    cards_before AS (
      SELECT c.card_id, c.disp_id, c.type_, c.issued, k.account_id
      FROM cards c JOIN card_links k ON k.disp_id = c.disp_id
      LEFT JOIN loans l ON l.account_id = k.account_id
      WHERE c.issued < coalesce(l.date_, {NO_LOAN}))"""
EXTRA = ",".join([TRANS_BEFORE, CARDS_LINKED, CARDS_BEFORE])


def q(select_sql: str) -> str:
    return with_standins(select_sql, EXTRA)


def _both_sql() -> str:
    return f"""SELECT h.*, b.* EXCLUDE (cut_account_id) FROM ({txn_rollup_sql('trans')}) h
      LEFT JOIN (SELECT COLUMNS('(.*)') AS 'cut_\\1' FROM ({txn_rollup_sql('trans_before')})) b
      ON b.cut_account_id = h.account_id"""


def _asof_sql() -> str:
    rows = """(SELECT t.* EXCLUDE (account_id), k.loan_id AS account_id FROM trans t
      JOIN every_loan k ON k.account_id = t.account_id AND t.date_ < k.date_)"""
    return f""", every_loan AS (SELECT o_orderkey AS loan_id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS date_
        FROM orders WHERE o_orderpriority = '1-URGENT')
      SELECT k.account_id, k.loan_id, r.* EXCLUDE (account_id) FROM every_loan k
      LEFT JOIN ({txn_rollup_sql(rows)}) r ON r.account_id = k.loan_id"""


def rollup_oracles() -> dict[str, str]:
    return {
        "txn_rollup_both": q(_both_sql()),
        "asof_loan_rollup": q(_asof_sql()),
        "cutoff_txn": q("SELECT * FROM trans_before"),
        "txn_rollup": q(txn_rollup_sql("trans")),
        "cutoff_txn_rollup": q(txn_rollup_sql("trans_before")),
        "symbol_rollup": q(symbol_rollup_sql()),
        "balance_stats": q(f"SELECT account_id, {_balance_sql()} FROM trans GROUP BY account_id"),
        "balance_stats_text": q(
            f"SELECT account_id, {_balance_sql(True)} FROM trans GROUP BY account_id"),
        "card_rollup": q(card_rollup_sql("cards_linked")),
        "card_rollup_by_type": q(card_rollup_sql("cards_linked", per_type=True)),
        "cutoff_card": q("SELECT * FROM cards_before"),
        "cutoff_card_rollup": q(card_rollup_sql("cards_before")),
    }


# ---------------------------------------------------------------------------
# load, recode and entity queries
# ---------------------------------------------------------------------------

CLIENT_DISP = """
    client_disp AS (
      SELECT d.account_id, d.client_id, c.district_id, d.type_, c.birth_date, c.sex
      FROM disp d LEFT JOIN clients c ON c.client_id = d.client_id)"""


def pair_sql(literal: bool = False) -> str:
    n_col = "n.n_clients AS user_client_id" if literal else "n.n_clients, u.client_id AS user_client_id"
    return f"""SELECT o.account_id, o.client_id, o.district_id AS client_district_id,
      o.birth_date, o.sex, {n_col}, u.district_id AS user_district_id,
      u.birth_date AS user_bday, u.sex AS user_sex
    FROM (SELECT * FROM client_disp WHERE type_ = 'OWNER') o
    LEFT JOIN (SELECT * FROM client_disp WHERE type_ = 'USER') u ON u.account_id = o.account_id
    LEFT JOIN (SELECT account_id, count(*) AS n_clients FROM client_disp GROUP BY account_id) n
      ON n.account_id = o.account_id"""


MART_CTES = ",".join([
    CLIENT_DISP,
    f"\n    client_account AS ({pair_sql()})",
    f"\n    orders_account AS ({symbol_rollup_sql()})",
    f"\n    trans_account AS ({txn_rollup_sql('trans')})",
    f"\n    trans_before_account AS ({txn_rollup_sql('trans_before')})",
    f"\n    cards_account AS ({card_rollup_sql('cards_linked')})",
    f"\n    cards_before_account AS ({card_rollup_sql('cards_before')})",
    f"\n    client_account_literal AS ({pair_sql(literal=True)})",
    f"\n    trans_account_literal AS ({txn_rollup_sql('trans', literal=True)})",
    f"\n    cards_account_literal AS ({card_rollup_sql('cards_linked', per_type=True)})",
])


def qm(select_sql: str) -> str:
    return with_standins(select_sql, EXTRA + "," + MART_CTES)


def mart_sql(root: str = "accounts", cutoff: bool = True, literal: bool = False) -> str:
    tenure = root == "accounts"
    trans = "trans_before_account" if cutoff else "trans_account"
    cards = "cards_before_account" if cutoff else "cards_account"
    pairs, counted = "client_account", "ca.n_clients, "
    if literal:
        trans, cards, pairs, counted = "trans_account_literal", "cards_account_literal", "client_account_literal", ""
    key = "a.account_id" if root == "accounts" else "l.account_id"
    frm = ("accounts a LEFT JOIN loans l ON l.account_id = a.account_id" if root == "accounts"
           else "loans l LEFT JOIN accounts a ON a.account_id = l.account_id")
    days = ("CAST(datediff('day', a.date_, l.date_) AS INTEGER) AS days_with_bank,"
            if tenure else "")
    age = ("CAST(datediff('day', ca.birth_date, l.date_) / 365 AS DECIMAL(12,4)) AS age_at_loan,"
           if tenure else "")
    return f"""SELECT {key} AS account_id, l.loan_id, ca.client_id, a.district_id,
      l.date_ AS date_loan, l.amount AS amount_loan, l.duration AS duration_loan,
      l.payments AS payments_loan, l.status_ AS status_loan, l.current AS current_loan,
      l.good_status AS good_status_loan, a.frequency AS freq_dep_acc, a.date_ AS date_account,
      {days}
      ca.client_district_id, ca.birth_date AS bday_client,
      {age}
      ca.sex AS sex_client, {counted}ca.user_client_id, ca.user_district_id,
      ca.user_bday, ca.user_sex,
      o.* EXCLUDE (account_id), t.* EXCLUDE (account_id), c.* EXCLUDE (account_id),
      d.district_id AS district_id_demo, d.district_name, d.region, d.n_inhab, d.n_cities
    FROM {frm}
    LEFT JOIN {pairs} ca ON ca.account_id = {key}
    LEFT JOIN orders_account o ON o.account_id = {key}
    LEFT JOIN {trans} t ON t.account_id = {key}
    LEFT JOIN {cards} c ON c.account_id = {key}
    LEFT JOIN district d ON d.district_id = a.district_id"""


# columns of the account-rooted mart on the stand-ins (for the shape query)
MART_COLUMNS = 13 + 1 + 2 + 1 + 6 + 15 + 21 + 4 + 5


def more_oracles() -> dict[str, str]:
    return {
        "birth_parse": q("SELECT client_id, birth_number, district_id, birth_date, sex FROM clients"),
        "link_clients": qm("SELECT * FROM client_disp"),
        "role_filter": qm("SELECT * FROM client_disp WHERE type_ = 'USER'"),
        "owner_user_pair": qm(pair_sql()),
        "owner_user_pair_literal": qm(pair_sql(literal=True)),
        "dedup_first": q("""SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
              ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                       l_discount, l_tax, l_returnflag, l_linestatus) AS rn
            FROM lineitem) WHERE rn = 1"""),
        "status_flags": q("SELECT loan_id, status_, current, good_status FROM loans"),
        "load_time_date": q("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date_ FROM orders"),
        "card_issue_date": q("""SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS issued
            FROM lineitem"""),
        "conform_lenient": q("""SELECT p_partkey, p_size AS size,
              CAST(0 AS INTEGER) AS kind,
              CAST(p_retailprice AS DECIMAL(10,2)) AS price,
              CAST(round(p_retailprice) AS INTEGER) AS price_int,
              CAST(1 AS INTEGER) AS _rejects
            FROM part"""),
        "conform_large_ids": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0
              ELSE CAST('9' || lpad(CAST(o_orderkey AS VARCHAR), 17, '0') AS BIGINT) END AS big_id,
              CAST(o_orderkey % 3 = 0 AS INTEGER) AS _rejects FROM orders""",
        "conform_bad_numbers": """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 4 THEN o_orderkey + 1 ELSE 0 END
              AS INTEGER) AS n, CAST(o_orderkey % 5 < 3 AS INTEGER) AS _rejects FROM orders""",
        "conform_float32": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(CAST(CAST(
              CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS FLOAT) AS DOUBLE) END AS amount,
              CAST(o_orderkey % 7 = 0 AS INTEGER) AS _rejects FROM orders""",
        "conform_char": """SELECT o_orderkey, rtrim(substr(o_orderpriority, 1, 8)) AS fixed, o_orderstatus AS padded,
              substr(o_orderpriority, 1, 5) AS varying,
              CAST(length(o_orderpriority) > 8 AS INTEGER) + CAST(length(o_orderpriority) > 5 AS INTEGER) AS _rejects
            FROM orders""",
        "birth_parse_bad": """SELECT o_orderkey, CASE k WHEN 0 THEN '' WHEN 3 THEN '70ab13'
                ELSE strftime(dt, '%y') || lpad(CAST(month(dt) + CASE WHEN woman THEN 50 ELSE 0 END AS VARCHAR), 2, '0')
                  || strftime(dt, '%d') END AS birth_number,
              CASE WHEN k NOT IN (0, 3) THEN TRY_CAST('19' || strftime(dt, '%y-%m-%d') AS DATE) END AS birth_date,
              CASE WHEN k NOT IN (0, 3) THEN CASE WHEN woman THEN 'F' ELSE 'M' END END AS sex
            FROM (SELECT o_orderkey, o_orderkey % 6 AS k, o_orderkey % 2 = 0 AS woman, CAST(o_orderdate AS DATE) AS dt
                  FROM orders)""",
        "recode_trans_symbol": f"""SELECT l_orderkey, l_linenumber, l_partkey, s AS k_symbol,
              CASE WHEN s = ' ' THEN '" "' ELSE s END AS literal
            FROM (SELECT *, CASE l_partkey % {len(TRANS_SYMBOL_CODES) + 1}
                    {" ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(TRANS_SYMBOL_CODES.values()))}
                    ELSE ' ' END AS s FROM lineitem)""",
        "account_zeros": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 OR o_custkey = 0 THEN ''
                ELSE CAST(o_custkey AS VARCHAR) END AS account_,
              CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE replace(CAST(o_custkey AS VARCHAR), '0', '') END
                AS account_literal FROM orders""",
        "strip_chars": q("SELECT c_custkey, c_mktsegment AS segment FROM customer"),
        "recode_3": q("SELECT account_id, frequency FROM accounts"),
        "recode_literal": q("SELECT account_id, frequency FROM accounts"),
        "recode_many": q("SELECT trans_id, account_id, type_, operation FROM trans"),
        "recode_disp_type": q("SELECT disp_id, type_ FROM disp"),
        "mart_loans": qm(mart_sql("loans", cutoff=False)),
        "mart_accounts": qm(mart_sql("accounts", cutoff=False)),
        "mart_cutoff": qm(mart_sql("accounts", cutoff=True)),
        "mart_accounts_literal": qm(mart_sql("accounts", cutoff=False, literal=True)),
        "mart_loans_literal": qm(mart_sql("loans", cutoff=False, literal=True)),
        "mart_bucketed": qm(mart_sql("accounts", cutoff=True)),
        "mart_sorted": qm(mart_sql("accounts", cutoff=True) + " ORDER BY 1"),
        "mart_head": qm(mart_sql("accounts", cutoff=True) + " ORDER BY 1 LIMIT 5"),
        "mart_roundtrip": qm(mart_sql("accounts", cutoff=True)),
        "mart_shape": qm(f"""SELECT count(*) AS n_rows, {MART_COLUMNS} AS n_columns
            FROM ({mart_sql('accounts', cutoff=True)})"""),
        "district_match": qm("""SELECT
              count_if(coalesce(a.district_id = ca.client_district_id, false)) AS match_,
              count_if(NOT coalesce(a.district_id = ca.client_district_id, false)) AS mismatch
            FROM accounts a LEFT JOIN client_account ca ON ca.account_id = a.account_id"""),
        "tenure_age": qm("""SELECT a.account_id,
              CAST(datediff('day', a.date_, l.date_) AS INTEGER) AS days_with_bank,
              CAST(datediff('day', ca.birth_date, l.date_) / 365 AS DECIMAL(12,4)) AS age_at_loan
            FROM accounts a LEFT JOIN loans l ON l.account_id = a.account_id
            LEFT JOIN client_account ca ON ca.account_id = a.account_id"""),
        "tenure_age_pool": qm("""SELECT a.account_id,
              CAST(datediff('day', a.date_, coalesce(l.date_, DATE '1999-01-01')) AS INTEGER) AS days_with_bank,
              CAST(datediff('day', ca.birth_date, coalesce(l.date_, DATE '1999-01-01')) / 365 AS DECIMAL(12,4)) AS age_at_loan
            FROM accounts a LEFT JOIN loans l ON l.account_id = a.account_id
            LEFT JOIN client_account ca ON ca.account_id = a.account_id"""),
    }




# ---------------------------------------------------------------------------
# feature preparation and decisions
# ---------------------------------------------------------------------------

MART_CUT = f"\n    mart AS ({mart_sql('accounts', cutoff=True)})"
S_AVG = """
    s AS (SELECT *, (score_0 + score_1 + score_2) / 3 AS avg_score FROM scores)"""
Q95 = "(SELECT quantile_cont(avg_score, 0.95) FROM s)"
D68 = "CAST(0.68 AS DOUBLE)"
LABELS = """(SELECT o_orderkey AS account_id,
                    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS good_status_loan
             FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) lb"""


def qp(select_sql: str) -> str:
    return with_standins(select_sql, EXTRA + "," + MART_CTES + "," + MART_CUT + "," + S_AVG)


# The source's feature list and its null-fill and cast lists.
FEATURES = [
    "n_orders", "avg_orders_amount", "std_orders_amount", "n_orders_housing",
    "avg_orders_housing", "std_orders_housing", "n_orders_insur", "avg_orders_insur",
    "std_orders_insur", "n_orders_leas", "avg_orders_leas", "std_orders_leas", "n_trans",
    "n_credit_trans", "sum_credit_trans", "avg_credit_trans", "std_credit_trans",
    "n_withdrawl_trans", "sum_withdrawl_trans", "avg_withdrawl_trans", "std_withdrawl_trans",
    "n_cash_deposit", "n_bank_collection", "n_cash_withdrawl", "n_bank_remit",
    "n_card_withdrawl", "total_credits_amount", "total_withdrawls_amount", "avg_balance",
    "std_balance", "min_balance", "max_balance", "n_neg_balance", "n_cards", "n_cards_gold",
    "n_cards_classic", "n_cards_junior", "days_with_bank", "age_at_loan",
    "freq_dep_acc_monthly", "freq_dep_acc_weekly"]
INT_FILL = [
    "n_orders_housing", "n_orders_loan", "n_orders_insur", "n_orders_leas", "n_credit_trans",
    "n_withdrawl_trans", "n_cash_deposit", "n_bank_collection", "n_cash_withdrawl",
    "n_bank_remit", "n_card_withdrawl", "n_neg_balance", "current_loan", "good_status_loan"]
FLOATS = [
    "avg_orders_leas", "std_orders_leas", "sum_credit_trans", "avg_credit_trans",
    "sum_withdrawl_trans", "avg_withdrawl_trans", "total_credits_amount",
    "total_withdrawls_amount", "min_balance", "max_balance", "n_cards_gold", "n_cards_classic",
    "n_cards_junior"]
DUMMIES = """CASE WHEN freq_dep_acc = 'monthly' THEN 1 ELSE 0 END AS freq_dep_acc_monthly,
      CASE WHEN freq_dep_acc = 'weekly' THEN 1 ELSE 0 END AS freq_dep_acc_weekly,
      CASE WHEN sex_client = 'M' THEN 1 ELSE 0 END AS sex_client_M,
      CASE WHEN user_sex = 'M' THEN 1 ELSE 0 END AS user_sex_M"""
TRAIN = """
    prepared AS (SELECT *, {dummies} FROM mart),
    labelled AS (SELECT account_id, CAST(coalesce(CAST(good_status_loan AS DOUBLE), 0) AS INTEGER)
                   AS good_status_loan,
                   substr(md5(CAST(account_id AS VARCHAR) || '#1'), 1, 8) < '40000000' AS is_test
                 FROM prepared WHERE loan_id IS NOT NULL),
    train AS (SELECT account_id, good_status_loan FROM labelled WHERE NOT is_test),
    cnt AS (SELECT good_status_loan, count(*) AS n FROM train GROUP BY 1),
    top AS (SELECT max(n) AS m FROM cnt)""".format(dummies=DUMMIES)


def qt(select_sql: str) -> str:
    return with_standins(select_sql,
                         EXTRA + "," + MART_CTES + "," + MART_CUT + "," + S_AVG + "," + TRAIN)


def hist_sql(src: str, x: str, bins_case: str, by: str | None = None) -> str:
    g = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    on_by = f"s2.{by} = g.{by} AND " if by else ""
    return f"""SELECT * FROM (WITH h AS (SELECT {g}{x} AS x FROM {src} WHERE {x} IS NOT NULL),
      mm AS (SELECT {g}min(x) AS lo0, max(x) AS hi0 FROM h {grp}),
      e AS (SELECT {g}CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
                   CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi, {bins_case} AS nb FROM mm),
      gb AS (SELECT {g}lo, hi, nb, unnest(range(0, nb)) AS bin FROM e),
      g AS (SELECT {g}bin, CAST(bin AS DOUBLE) * ((hi - lo) / nb) + lo AS bin_lo,
                   CASE WHEN bin = nb - 1 THEN hi
                        ELSE CAST(bin + 1 AS DOUBLE) * ((hi - lo) / nb) + lo END AS bin_hi,
                   bin = nb - 1 AS last FROM gb)
    SELECT {g.replace(by + ',', 'g.' + by + ',') if by else ''}g.bin, g.bin_lo, g.bin_hi,
           count(s2.x) AS count
    FROM g LEFT JOIN h s2 ON {on_by}s2.x >= g.bin_lo AND (s2.x < g.bin_hi OR (g.last AND s2.x <= g.bin_hi))
    GROUP BY ALL)"""


def report_sql(truth: str, pred: str) -> str:
    return f"""SELECT * FROM (WITH d AS (SELECT {truth} AS t, {pred} AS p FROM s),
      cls AS (SELECT t AS c FROM d UNION SELECT p FROM d),
      per AS (SELECT c, (SELECT count(*) FROM d WHERE t = c) AS support,
                     (SELECT count(*) FROM d WHERE p = c) AS predicted,
                     (SELECT count(*) FROM d WHERE t = c AND p = c) AS tp FROM cls),
      pm AS (SELECT CAST(c AS VARCHAR) AS class_label,
                    CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / predicted END AS precision,
                    CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END AS recall,
                    CASE WHEN predicted + support = 0 THEN 0.0
                         ELSE CAST(2 * tp AS DOUBLE) / (predicted + support) END AS f1_score,
                    support, tp FROM per)
    SELECT class_label, precision, recall, f1_score, support FROM pm
    UNION ALL SELECT 'accuracy', NULL, NULL, CAST(sum(tp) AS DOUBLE) / sum(support),
                     CAST(sum(support) AS BIGINT) FROM pm
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score),
                     CAST(sum(support) AS BIGINT) FROM pm
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
                     sum(recall * support) / sum(support), sum(f1_score * support) / sum(support),
                     CAST(sum(support) AS BIGINT) FROM pm)"""


#: Accounts with a loan and their class, and the fold of one by its rank in the class (follows a WITH clause).
LABELLED_MART = ", lm AS (SELECT account_id, CAST(good_status_loan AS INTEGER) AS label FROM mart WHERE loan_id IS NOT NULL)"
_FOLD = """CAST((row_number() OVER (PARTITION BY label
  ORDER BY md5(CAST(account_id AS VARCHAR) || '#7919'), account_id) - 1) % 5 AS INTEGER)"""


def newton_sql(steps: int = 12) -> str:
    """Newton's method for a penalised logistic regression on one feature (C = 1), a common expression for each step."""
    parts = ["""xy AS MATERIALIZED (SELECT coalesce(days_with_bank, 0) / CAST(1000 AS DOUBLE) AS x,
        CAST(good_status_loan AS DOUBLE) AS y FROM mart WHERE loan_id IS NOT NULL)""",
             "b0 AS MATERIALIZED (SELECT CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS b)"]
    for k in range(steps):
        parts.append(f"""b{k + 1} AS MATERIALIZED (SELECT w - (hbb * gw - hwb * gb) / (hww * hbb - hwb * hwb) AS w,
          b - (hww * gb - hwb * gw) / (hww * hbb - hwb * hwb) AS b
        FROM (SELECT w, b, sum((p - y) * x) + w AS gw, sum(p - y) AS gb, sum(p * (1 - p) * x * x) + 1 AS hww,
                sum(p * (1 - p) * x) AS hwb, sum(p * (1 - p)) AS hbb
              FROM (SELECT w, b, x, y, 1 / (1 + exp(-(w * x + b))) AS p FROM xy, b{k}) GROUP BY w, b))""")
    return f", {', '.join(parts)} SELECT round(w, 4) AS coefficient, round(b, 4) AS intercept FROM b{steps}"


def _fixed_sql() -> str:
    z = " + ".join(f"{1e-7 / (i + 1)!r} * {c}" for i, c in enumerate(FEATURES))
    xs = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) AS {c}" for c in FEATURES)
    return f"""SELECT account_id, round(s0, 9) AS score_0, round(s1, 9) AS score_1, round((s0 + s1) / 2, 9) AS avg_score
      FROM (SELECT account_id, 1 / (1 + exp(-({z} - 0.5))) AS s0, 1 / (1 + exp(({z}) - 0.25)) AS s1
            FROM (SELECT account_id, {xs} FROM prepared))"""


def prep_oracles() -> dict[str, str]:
    feats = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) AS {c}" for c in FEATURES)
    ints = ", ".join(f"CAST(coalesce(CAST({c} AS DOUBLE), 0) AS INTEGER) AS {c}" for c in INT_FILL)
    floats = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FLOATS)
    tiers = f"""SELECT account_id, avg_score,
        CASE WHEN avg_score >= {Q95} THEN 'pre_approve' WHEN avg_score >= {D68} THEN 'approve'
             ELSE 'deny' END AS tier FROM s"""
    return {
        "split_labelled": qp("SELECT account_id, loan_id IS NOT NULL AS labelled FROM mart"),
        "get_dummies": qp(f"SELECT account_id, {DUMMIES} FROM mart"),
        "fill_cast": qp(f"SELECT account_id, {ints}, {floats} FROM mart"),
        "feature_select": qt(f"SELECT account_id, {feats} FROM prepared"),
        "train_test_split": qt("SELECT account_id, is_test FROM labelled"),
        "oversample_ratio": qt("""SELECT account_id, good_status_loan FROM (
              SELECT t.account_id, t.good_status_loan,
                     (m // n) + CASE WHEN CAST(('0x' || substr(md5(CAST(t.account_id AS VARCHAR) || '#0'), 1, 8)) AS BIGINT)
                                          / 4294967296.0 < CAST(m % n AS DOUBLE) / n THEN 1 ELSE 0 END AS copies
              FROM train t JOIN cnt USING (good_status_loan), top)
            , unnest(range(0, copies)) AS r(i)"""),
        "oversample_exact": qt("""SELECT account_id, good_status_loan FROM (
              SELECT t.account_id, t.good_status_loan,
                     (m // n) + CASE WHEN row_number() OVER (PARTITION BY t.good_status_loan ORDER BY
                       md5(CAST(t.account_id AS VARCHAR) || '#0'), t.account_id) <= m % n THEN 1 ELSE 0 END AS copies
              FROM train t JOIN cnt USING (good_status_loan), top)
            , unnest(range(0, copies)) AS r(i)"""),
        "oversample_random": qt("""SELECT account_id, good_status_loan FROM (
              SELECT rk.account_id, rk.good_status_loan, 1 + coalesce(times, 0) AS copies FROM (
                SELECT account_id, good_status_loan, row_number() OVER (PARTITION BY good_status_loan ORDER BY
                  md5(CAST(account_id AS VARCHAR) || '#0'), account_id) - 1 AS k FROM train) rk
              LEFT JOIN (SELECT good_status_loan, CAST(('0x' || substr(md5(CAST(i AS VARCHAR) || '#'
                  || CAST(good_status_loan AS VARCHAR) || '#0'), 1, 8)) AS BIGINT) % n AS k, count(*) AS times
                FROM (SELECT good_status_loan, n, unnest(range(0, m - n)) AS i FROM cnt, top) GROUP BY ALL) dr
              USING (good_status_loan, k))
            , unnest(range(0, copies)) AS r(i)"""),
        "assemble_sum": qt(f"""SELECT account_id, CAST({len(FEATURES)} AS INTEGER) AS n_features, {" + ".join(
            f"coalesce(CAST({c} AS DOUBLE), 0)" for c in FEATURES)} AS total FROM prepared"""),
        "fixed_scores": qt(_fixed_sql()),
        "logit_one_feature": qp(newton_sql()),
        "cv_folds_stratified": qp(f"{LABELLED_MART} SELECT account_id, label, {_FOLD} AS fold FROM lm"),
        "cv_folds_resampled": qp(f"""{LABELLED_MART},
            lc AS (SELECT label, count(*) AS n FROM lm GROUP BY label),
            rk AS (SELECT account_id, label, row_number() OVER (PARTITION BY label
              ORDER BY md5(CAST(account_id AS VARCHAR) || '#0'), account_id) - 1 AS k FROM lm),
            dr AS (SELECT label, CAST(('0x' || substr(md5(CAST(i AS VARCHAR) || '#' || CAST(label AS VARCHAR) || '#0'),
                1, 8)) AS BIGINT) % n AS k, count(*) AS times
              FROM (SELECT label, n, unnest(range(0, (SELECT max(n) FROM lc) - n)) AS i FROM lc) GROUP BY ALL),
            cp AS (SELECT account_id, label FROM (SELECT account_id, label, 1 + coalesce(times, 0) AS copies
              FROM rk LEFT JOIN dr USING (label, k)), unnest(range(0, copies)) AS r(i))
            SELECT label, fold, count(*) AS n_rows FROM (SELECT label, {_FOLD} AS fold FROM cp) GROUP BY ALL"""),
        "class_weights": qt("""SELECT good_status_loan, n AS n_class,
              CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n) AS weight FROM cnt"""),
        "predict_inverted": qp("""SELECT account_id, avg_score,
              CASE WHEN avg_score < 0.5 THEN 1 ELSE 0 END AS y_hat FROM s"""),
        "average_scores": qp("SELECT account_id, score_0, score_1, score_2, avg_score FROM s"),
        "average_scores_literal": qp("""SELECT account_id, score_0, score_1, score_2,
              (score_1 + score_2) / 2 AS avg_score FROM s"""),
        "score_pivot": qp("SELECT account_id, score_0, score_1, score_2 FROM scores"),
        "score_label_join": qp(f"""SELECT s.account_id, s.avg_score, lb.good_status_loan
              FROM s JOIN {LABELS} ON lb.account_id = s.account_id"""),
        "score_label_left": qp(f"""SELECT s.account_id, s.avg_score, lb.good_status_loan
              FROM s LEFT JOIN {LABELS} ON lb.account_id = s.account_id"""),
        "threshold_confusion": qp(f"""SELECT
              count_if(good_status_loan = 1 AND avg_score >= {D68}) AS true_good,
              count_if(good_status_loan = 0 AND avg_score >= {D68}) AS false_good,
              count_if(good_status_loan = 0 AND avg_score < {D68}) AS true_bad,
              count_if(good_status_loan = 1 AND avg_score < {D68}) AS false_bad FROM s"""),
        "roc_table": qp("""SELECT i AS step, CAST(i AS DOUBLE) * CAST(0.01 AS DOUBLE) AS crit,
              count_if(good_status_loan = 0 AND avg_score > CAST(i AS DOUBLE) * CAST(0.01 AS DOUBLE))
                / count_if(good_status_loan = 0) AS FalsePositive,
              count_if(good_status_loan = 1 AND avg_score > CAST(i AS DOUBLE) * CAST(0.01 AS DOUBLE))
                / count_if(good_status_loan = 1) AS TruePositive
            FROM range(0, 101) g(i), s GROUP BY i"""),
        "roc_points": qp("""SELECT * FROM (SELECT i AS step, CAST(i AS DOUBLE) * CAST(0.01 AS DOUBLE) AS crit,
              count_if(good_status_loan = 0 AND avg_score > CAST(i AS DOUBLE) * CAST(0.01 AS DOUBLE))
                / count_if(good_status_loan = 0) AS FalsePositive,
              count_if(good_status_loan = 1 AND avg_score > CAST(i AS DOUBLE) * CAST(0.01 AS DOUBLE))
                / count_if(good_status_loan = 1) AS TruePositive
            FROM range(0, 101) g(i), s GROUP BY i) WHERE step IN (50, 68, 90)"""),
        "classification_report": qp(report_sql(
            "good_status_loan", "CASE WHEN avg_score >= 0.5 THEN 1 ELSE 0 END")),
        "classification_report_swapped": qp(report_sql(
            "CASE WHEN avg_score >= 0.5 THEN 1 ELSE 0 END", "good_status_loan")),
        "score_quantile": qp("""SELECT round(quantile_cont(avg_score, 0.95), 9) AS q95,
              count(avg_score) AS n_scores FROM s"""),
        "high_confidence": qp("""SELECT count_if(avg_score >= 0.99) AS n_best,
              count_if(avg_score < 0.99) AS n_others FROM s"""),
        "preapprove_list": qp(f"SELECT account_id, avg_score FROM s WHERE avg_score >= {Q95}"),
        "decision_tiers": qp(tiers),
        "decision_tiers_literal": qp(f"""SELECT *, avg_score >= {Q95} AS pre_approve,
              avg_score >= {D68} AND avg_score < {Q95} AS approve, avg_score < {D68} AS deny
            FROM s"""),
        "tier_counts": qp(f"SELECT tier, count(*) AS n_accounts FROM ({tiers}) GROUP BY tier"),
        "score_histogram": qp(hist_sql("s", "avg_score", "22")),
        "tier_histogram": qp(hist_sql(
            f"({tiers})", "avg_score",
            "CASE tier WHEN 'pre_approve' THEN 2 WHEN 'approve' THEN 5 ELSE 15 END", by="tier")),
        "class_profile": qp("""SELECT feature, good_status_loan, count(value) AS n, min(value) AS min,
              round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
              round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max
            FROM (SELECT good_status_loan, f.feature, f.value FROM mart,
                    unnest([{'feature': 'n_neg_balance', 'value': CAST(n_neg_balance AS DOUBLE)},
                            {'feature': 'min_balance', 'value': CAST(min_balance AS DOUBLE)},
                            {'feature': 'avg_balance', 'value': CAST(avg_balance AS DOUBLE)},
                            {'feature': 'std_balance', 'value': CAST(std_balance AS DOUBLE)},
                            {'feature': 'avg_orders_housing', 'value': CAST(avg_orders_housing AS DOUBLE)}
                           ]) AS u(f)
                  WHERE loan_id IS NOT NULL)
            GROUP BY ALL"""),
    }


def oracle_sql() -> dict[str, str]:
    out = rollup_oracles()
    out.update(more_oracles())
    out.update(prep_oracles())
    return out
