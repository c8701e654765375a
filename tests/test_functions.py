import datetime as dt

from pyspark.sql import functions as F

from lendscope.functions.birth import decode_birth
from lendscope.functions.casts import conform, fill_cast
from lendscope.functions.dates import parse_yymmdd, parse_yymmdd_time, years_between
from lendscope.functions.recode import (FREQUENCY_CODES, add_status_flags, recode,
                                        recode_disp_type, strip_account_zeros)


def test_two_digit_years_pivot_at_70(spark):
    df = spark.createDataFrame([("930101",), ("050228",), ("700101",), ("691231",), ("bad",),
                                ("",)], "s string")
    got = [r[0] for r in df.select(parse_yymmdd("s")).collect()]
    assert got == [dt.date(1993, 1, 1), dt.date(2005, 2, 28), dt.date(1970, 1, 1),
                   dt.date(2069, 12, 31), None, None]


def test_date_with_time_drops_time(spark):
    df = spark.createDataFrame([("931107 00:00:00",)], "s string")
    assert df.select(parse_yymmdd_time("s")).first()[0] == dt.date(1993, 11, 7)


def test_birth_number_month_plus_50_is_female(spark):
    df = spark.createDataFrame([("706213",), ("450204",)], "birth_number string")
    rows = decode_birth(df).collect()
    assert (rows[0].birth_date, rows[0].sex) == (dt.date(1970, 12, 13), "F")
    assert (rows[1].birth_date, rows[1].sex) == (dt.date(1945, 2, 4), "M")


def test_birth_number_literal_keeps_quotes(spark):
    df = spark.createDataFrame([('"706213"',)], "birth_number string")
    assert decode_birth(df, literal=True).first().birth_date == dt.date(1970, 12, 13)


def test_recode_intent_and_literal_agree_on_clean_codes(spark):
    df = spark.createDataFrame([("POPLATEK MESICNE",), ("POPLATEK PO OBRATU",), ("other",)],
                               "f string")
    intent = [r[0] for r in df.select(recode("f", FREQUENCY_CODES)).collect()]
    quoted = F.concat(F.lit('"'), F.col("f"), F.lit('"'))
    literal = [r[0] for r in df.select(recode(quoted, FREQUENCY_CODES, literal=True)).collect()]
    assert intent == ["monthly", "after_transaction", "other"]
    assert literal == ["monthly", "after_transaction", '"other"']


def test_disp_type_strips_cr_and_quotes(spark):
    df = spark.createDataFrame([('"DISPONENT"\r',), ('"OWNER"\r',)], "t string")
    assert [r[0] for r in df.select(recode_disp_type("t")).collect()] == ["USER", "OWNER"]


def test_account_zeros_literal_deletes_every_zero(spark):
    df = spark.createDataFrame([("0",), ("10203040\r",)], "a string")
    intent = [r[0] for r in df.select(strip_account_zeros("a")).collect()]
    literal = [r[0] for r in df.select(strip_account_zeros("a", literal=True)).collect()]
    assert intent == ["", "10203040"]
    assert literal == ["", "1234"]


def test_status_flags(spark):
    df = spark.createDataFrame([('"A"',), ("B",), ("C",), ("D",)], "status_ string")
    rows = add_status_flags(df).collect()
    assert [(r.status_, r.current, r.good_status) for r in rows] == [
        ("A", 0, 1), ("B", 0, 0), ("C", 1, 1), ("D", 1, 0)]


def test_conform_is_lenient_and_counts_rejects(spark):
    df = spark.createDataFrame([("3.08", "12.50", "930101", "x"), ("abc", "", "991399", "y")],
                               "n string, m string, d string, s string")
    rows = conform(df, {"n": "int", "m": "decimal(10,2)", "d": "yymmdd"}).collect()
    assert rows[0].n == 3 and str(rows[0].m) == "12.50" and rows[0].d == dt.date(1993, 1, 1)
    assert rows[0]._rejects == 0
    assert rows[1].n == 0 and str(rows[1].m) == "0.00" and rows[1].d is None
    assert rows[1]._rejects == 2


def test_fill_cast(spark):
    df = spark.createDataFrame([(None, None), (2, 1.5)], "a int, b double")
    rows = fill_cast(df, ["a"], ["b"]).collect()
    assert rows[0].a == 0 and rows[0].b is None and rows[1].a == 2


def test_years_between_is_decimal_4(spark):
    df = spark.createDataFrame([(dt.date(2000, 1, 1), dt.date(1950, 6, 1))], "a date, b date")
    v = df.select(years_between("a", "b")).first()[0]
    days = (dt.date(2000, 1, 1) - dt.date(1950, 6, 1)).days
    assert str(v) == f"{days / 365:.4f}" == "49.6192"
