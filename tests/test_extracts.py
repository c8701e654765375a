import datetime as dt
import os

import pytest

from lendscope.plans import mart as M
from lendscope.sources.extracts import load_bank_tables, load_rejects, read_extract

# Invented records; only the column names and the code words are the bank's.
FILES = {
    "loan": ['"loan_id";"account_id";"date";"amount";"duration";"payments";"status"',
             '900;71;930412;24000;24;1000.00;"B"', '900;71;930801;1;12;1.00;"A"',
             '901;72;930509;60000;12;5000.00;"A"'],
    "account": ['"account_id";"district_id";"frequency";"date"',
                '71;5;"POPLATEK MESICNE";930301', '72;6;"POPLATEK TYDNE";050102',
                '73;5;"POPLATEK PO OBRATU";961130'],
    "disp": ['"disp_id";"client_id";"account_id";"type"', '11;21;71;"OWNER"', '12;22;71;"DISPONENT"',
             '13;23;72;"OWNER"', '14;24;73;"OWNER"'],
    "client": ['"client_id";"birth_number";"district_id"', '21;"615917";5', '22;"580402";6',
               '23;"775521";6', '24;"490830";5', '24;"490830";9'],
    "order": ['"order_id";"account_id";"bank_to";"account_to";"amount";"k_symbol"',
              '801;71;"AA";"11112222";150.50;"SIPO"', '802;71;"BB";"33334444";1000.00;"UVER"',
              '803;72;"CC";"55556666";75.25;" "'],
    "card": ['"card_id";"disp_id";"type";"issued"', '31;11;"classic";930930 00:00:00',
             '32;13;"gold";950606 00:00:00', '33;14;"junior";980215 00:00:00'],
    "district": ["A1;A2;A3;A4;A5;A6;A7;A8;A9;A10;A11;A12;A13;A14;A15;A16",
                 '5;"Northtown";"North";500000;1;2;3;1;1;90.5;9000;1.10;1.20;100;2000;2100',
                 '6;"Southvale";"South";40000;9;8;7;6;5;33.3;7000;2.50;2.60;90;?;400'],
}


def _write(d):
    for name, lines in FILES.items():
        with open(os.path.join(d, f"{name}.asc"), "w", newline="") as f:
            f.write("".join(line + "\r\n" for line in lines))


def test_read_extract_intent_and_literal(spark, tmpdir_path):
    _write(tmpdir_path)
    p = os.path.join(tmpdir_path, "disp.asc")
    cols = ["disp_id", "client_id", "account_id", "type_"]
    assert read_extract(spark, p, cols).orderBy("disp_id").first().type_ == "OWNER"
    assert read_extract(spark, p, cols, literal=True).orderBy("disp_id").first().type_ == '"OWNER"\r'


def test_bank_tables_from_extracts(spark, tmpdir_path):
    _write(tmpdir_path)
    for literal in (False, True):
        t = load_bank_tables(spark, tmpdir_path, literal=literal, allow_missing={"trans"})
        loans = {r.loan_id: r for r in t.loans.collect()}
        assert len(loans) == 2 and loans[900].status_ == "B" and loans[900].amount == 24000
        assert loans[901].good_status == 1 and loans[900].date_ == dt.date(1993, 4, 12)
        acc = {r.account_id: r for r in t.accounts.collect()}
        assert acc[72].frequency == "weekly" and acc[72].date_ == dt.date(2005, 1, 2)
        assert sorted(r.type_ for r in t.disp.collect()) == ["OWNER", "OWNER", "OWNER", "USER"]
        assert t.clients.count() == 4
        dist = {r.district_id: r for r in t.district.collect()}
        assert dist[6].n_crimes_95 == 0 and str(dist[6].urban_ratio) == "33.3"
        mart = {r.account_id: r for r in M.mart_cutoff(t).collect()}
        assert len(mart) == 3
        assert mart[71].n_clients == 2 and mart[71].user_sex == "M" and mart[71].sex_client == "F"
        assert mart[71].n_orders == 2 and mart[71].n_orders_housing == 1
        # cards of accounts 71 and 72 were issued after their loans; account 73 has no loan
        # and its card (1998-02-15) is before the default cutoff
        assert mart[71].n_cards is None and mart[72].n_cards is None and mart[73].n_cards == 1
        full = {r.account_id: r for r in M.mart_accounts(t).collect()}
        assert full[71].n_cards == 1 and full[72].n_cards == 1
        assert mart[71].days_with_bank == (dt.date(1993, 4, 12) - dt.date(1993, 3, 1)).days


def test_missing_extracts_raise_and_uri_paths_work(spark, tmpdir_path):
    _write(tmpdir_path)
    with pytest.raises(FileNotFoundError, match="trans"):
        load_bank_tables(spark, tmpdir_path)
    t = load_bank_tables(spark, f"file://{tmpdir_path}", allow_missing={"trans"})
    assert t.accounts.count() == 3 and t.trans.count() == 0
    os.remove(os.path.join(tmpdir_path, "card.asc"))
    with pytest.raises(FileNotFoundError, match="card"):
        load_bank_tables(spark, tmpdir_path, allow_missing={"trans", "card"})


def test_rejects_per_table(spark, tmpdir_path):
    _write(tmpdir_path)
    got = {r.extract: (r.n_rows, r.n_rejected_rows, r.n_rejects) for r in load_rejects(spark, tmpdir_path).collect()}
    assert got["district"] == (2, 1, 1) and got["loan"] == (3, 0, 0) and "trans" not in got
