import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lendscope.functions.casts import conform
from lendscope.operators.rollup import card_rollup, distinct_sketch, merge_sketches
from lendscope.sources import standins as S
from lendscope.sources.bucketed import load_bucketed, mart_bucketed, save_bucketed
from lendscope.sources.extracts import load_bank_tables, load_checked, load_rejects
from lendscope.sources.marts import load_mart, overwrite_partitions, replace, save, save_sorted
from test_extracts import _write


def test_literal_types(spark):
    raw = spark.createDataFrame([("0.1", "abcd  ", "abcdef", 1), ("x", "ab   ", "  a", 2), (None, None, None, 3), ("1e99", "", "", 4)],
                                "f string, c string, v string, k int")
    got = [tuple(r) for r in conform(raw, {"f": "float32", "c": "char(3)", "v": "varchar(4)"}, details="why").sort("k").collect()]
    assert got[0][:3] == (0.10000000149011612, "abc", "abcd") and got[0][4] == 2
    assert [tuple(x) for x in got[0][5]] == [("c", "abcd  "), ("v", "abcdef")]
    assert got[1][:3] == (0.0, "ab", "  a") and [tuple(x) for x in got[1][5]] == [("f", "x")]
    assert got[2][:3] == (0.0, None, None) and got[2][4] == 0 and got[2][5] == []


def test_single_precision_mean_differs_from_double(spark):
    raw = spark.createDataFrame([("3372.70",), ("7266.00",)], "amount string")
    single, double = (conform(raw, {"amount": t}).agg(F.avg("amount")).first()[0] for t in ("float32", "double"))
    assert single == 5319.3499755859375 and double == 5319.35


@pytest.mark.parametrize("literal", [False, True])
def test_checked_load_reports_what_the_second_read_would(spark, tmpdir_path, literal):
    _write(tmpdir_path)
    t, report = load_checked(spark, tmpdir_path, f"{tmpdir_path}/typed", literal, allow_missing={"trans"})
    again = {r["extract"]: (r.n_rows, r.n_rejected_rows, r.n_rejects) for r in load_rejects(spark, tmpdir_path, literal).collect()}
    assert {k: (m["n_rows"], m["n_rejected_rows"], m["n_rejects"]) for k, m in report.metrics.items()} == again
    rejects = report.rejects.collect()
    assert len(rejects) == sum(m["n_rejects"] for m in report.metrics.values())
    assert ("district", "n_crimes_95", "?") in {(r["extract"], r["column"], r["raw"]) for r in rejects}
    plain = load_bank_tables(spark, tmpdir_path, literal, allow_missing={"trans"})
    for name in ("loans", "accounts", "disp", "clients", "orders", "cards", "district"):
        a, b = getattr(t, name), getattr(plain, name)
        assert a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name
    # nothing is read from the extracts any more
    for name in os.listdir(tmpdir_path):
        if name.endswith(".asc"):
            open(os.path.join(tmpdir_path, name), "w").close()
    assert t.loans.count() == 2 and report.rejects.count() == len(rejects)


def test_mart_over_buckets_moves_no_row(spark, tmpdir_path):
    from lendscope.plans.mart import mart_cutoff
    tables = S.standin_tables(spark, SF_SMALL)
    save_bucketed(tables, tmpdir_path, "test_bucketed", 4)
    out = mart_bucketed(load_bucketed(spark, "test_bucketed"))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, ("-1", "false")):
        spark.conf.set(n, v)
    try:
        out = mart_bucketed(load_bucketed(spark, "test_bucketed"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and plan.count("SortMergeJoin") >= 5
        want = mart_cutoff(tables)
        digits = [F.round(c, 6).alias(c) if c.startswith("std_") else F.col(c) for c in want.columns]
        a, b = out.select(*digits), want.select(*digits)
        assert out.columns == want.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)


def test_overwriting_one_year_leaves_the_others(spark, tmpdir_path):
    path = f"{tmpdir_path}/mart"
    df = spark.range(30).select("id", (F.col("id") % 3 + 1993).cast("int").alias("year"), F.lit("old").alias("state"))
    save(df, path, ["year"])
    stored = load_mart(spark, path)
    # reads what it replaces
    overwrite_partitions(stored.where("year = 1994 and id < 20").withColumn("state", F.lit("new")), path, ["year"], ["id"])
    now = {(r["year"], r["state"]): r["n"] for r in load_mart(spark, path).groupBy("year", "state").agg(F.count("*").alias("n")).collect()}
    assert now == {(1993, "old"): 10, (1994, "new"): 7, (1995, "old"): 10}
    assert [n for n in os.listdir(tmpdir_path) if n != "mart"] == []


def test_replacing_a_table_that_is_read(spark, tmpdir_path):
    path = f"{tmpdir_path}/t"
    replace(spark.range(5), path)
    replace(load_mart(spark, path).select((F.col("id") * 2).alias("id")), path)
    assert sorted(r["id"] for r in load_mart(spark, path).collect()) == [0, 2, 4, 6, 8]
    with pytest.raises(Exception):  # a plan that fails leaves the table as it was
        replace(load_mart(spark, path).select(F.raise_error(F.lit("no")).cast("long").alias("id")), path)
    assert load_mart(spark, path).count() == 5 and not [n for n in os.listdir(tmpdir_path) if "before" in n]


def test_sorted_files_hold_consecutive_ranges(spark, tmpdir_path):
    rnd = random.Random(2)
    rows = [(None if rnd.random() < 0.02 else rnd.choice([7, rnd.randrange(10_000)]), i) for i in range(8000)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(5)
    save_sorted(df, tmpdir_path + "/s", ["k"], 6, spread=["i"])
    files = spark.read.parquet(tmpdir_path + "/s").select("k", "i", F.input_file_name().alias("f")).toPandas()
    order = lambda k, i: (k == k and k is not None, k if k == k else 0, i)
    spans = sorted((min(order(k, i) for k, i in zip(g.k, g.i)), max(order(k, i) for k, i in zip(g.k, g.i)), len(g))
                   for _, g in files.groupby("f"))
    assert len(spans) >= 5 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert max(n for _, _, n in spans) < 8000 / 3  # the hot key is cut over files
    for _, g in files.groupby("f"):
        keys = [order(k, i) for k, i in zip(g.k, g.i)]
        assert keys == sorted(keys)


def test_distinct_sketches_merge_and_stay_close(spark):
    n = 1_000_000
    cards = spark.range(2 * n).select((F.col("id") % 3 % 2).cast("int").alias("account_id"), (F.col("id") % 12).alias("month"),
                                      (F.col("id") % n).alias("card_id"), F.lit("gold").alias("type_"))
    exact = {r.account_id: r.n_cards for r in card_rollup(cards).collect()}
    near = {r.account_id: r.n_cards for r in card_rollup(cards, approximate=True).collect()}
    monthly = distinct_sketch(cards, ["account_id", "month"], "card_id")
    merged = {r.account_id: r.n_distinct for r in merge_sketches(monthly, ["account_id"]).collect()}
    for a, e in exact.items():
        assert abs(near[a] - e) < 0.02 * e and abs(merged[a] - e) < 0.02 * e
