import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscope.functions.birth import decode_birth
from lendscope.functions.casts import conform
from lendscope.operators.cutoff import before_cutoff
from lendscope.operators import quantile
from lendscope.operators.quantile import exact_quantiles, key_value, order_key, order_statistics
from lendscope.operators.rollup import exact_sum, mean, txn_rollup
from lendscope.plans.decide import class_profile, histogram
from lendscope.plans.prep import oversample
from pyspark.sql.types import DecimalType


def test_million_values_with_heavy_ties(spark):
    n = 1_100_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") % 1000) / 10.0).alias("v"))
    got = exact_quantiles(df, "v", [0.0, 0.5, 0.9, 1.0])[()]
    values = sorted(7.0 if i % 3 == 0 else (i % 1000) / 10.0 for i in range(n))

    def want(p):
        pos = p * (n - 1)
        lo = int(pos)
        hi = min(lo + (pos > lo), n - 1)
        return values[lo] + (values[hi] - values[lo]) * (pos - lo)

    assert all(abs(got[p] - want(p)) < 1e-9 for p in got)


def test_order_statistics_of_longs_and_groups(spark):
    rnd = random.Random(4)
    rows = [(g, rnd.choice([-2 ** 63, 2 ** 63 - 1, 2 ** 62 + rnd.randrange(50), rnd.randrange(9)])) for g in ("a", None)
            for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, v long")
    ranks = {("a",): {0, 10, 150, 299}, (None,): {5, 200}}
    got = order_statistics(df, "v", ranks, ["g"])
    for (g,), wanted in ranks.items():
        own = sorted(v for k, v in rows if k == g)
        assert got[(g,)] == {r: own[r] for r in wanted}


def doubles(seed, n):
    """Finite doubles of every magnitude, from random bit patterns, next to neighbours and ends of the range."""
    rnd = random.Random(seed)
    out = [0.0, -0.0, 5e-324, -5e-324, 2.0 ** -1022, 2.0 ** -1022 - 5e-324, 1.7976931348623157e308, -1.7976931348623157e308]
    for e in (-1074, -1023, -1022, -1, 0, 1, 52, 53, 1023):
        out += [2.0 ** e, -2.0 ** e, math.nextafter(2.0 ** e, math.inf), math.nextafter(2.0 ** e, 0.0)]
    while len(out) < n:
        x = struct.unpack("<d", rnd.randbytes(8))[0]
        if math.isfinite(x):
            out.append(x)
    return out


def test_order_keys_keep_order_and_value(spark):
    values = [*doubles(1, 4000), math.inf, -math.inf, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [(r.v, r._key) for r in order_key(df, "v").collect()]
    assert all(key_value(k) == v or (v != v and math.isnan(key_value(k))) for v, k in got)
    spark_order = [r.v for r in df.distinct().sort("v").collect()]  # NaN last
    by_key = [key_value(k) for k in sorted({k for _, k in got})]
    assert by_key[:-1] == spark_order[:-1] and math.isnan(by_key[-1]) and math.isnan(spark_order[-1])
    assert all(key_value(k) == v for v, k in ((x, struct.unpack("<q", struct.pack("<d", x))[0]) for x in values if x > 0))


@pytest.mark.parametrize("values", [
    [1.0, 2.0, math.inf], [-1e308, 0.0, 1e308], [1.0, 2.0, math.nan], [-math.inf, math.inf], [math.nan] * 3,
    [1.7976931348623157e308, -1.7976931348623157e308, 5e-324, -5e-324], [1.0, math.nextafter(1.0, 2.0)],
    [0.0, -0.0, 0.0], [3.5], doubles(2, 500), [*doubles(3, 300), *[math.inf] * 50, *[math.nan] * 50, *[-math.inf] * 50]])
def test_any_values_end_in_eight_passes(spark, monkeypatch, values):
    passes = []
    monkeypatch.setattr(quantile, "_pass", lambda *a, run=quantile._pass: passes.append(1) or run(*a))
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    ranks = set(range(len(values))) if len(values) < 20 else set(range(0, len(values), 7))
    got = order_statistics(df, "v", {(): ranks})[()]
    own = sorted(values, key=lambda v: (v != v, v if v == v else 0.0))
    assert set(got) == ranks and all(got[r] == own[r] or (own[r] != own[r] and math.isnan(got[r])) for r in ranks)
    assert len(passes) <= 7  # after the first
    # neighbours that are equal need no interpolation, also where they are infinite
    median = exact_quantiles(df, "v", [0.5])[()][0.5]
    lo, hi = own[(len(own) - 1) // 2], own[len(own) // 2]
    assert median == lo if lo == hi else math.isnan(median) == math.isnan(lo + (hi - lo) / 2)


def test_windows_go_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(quantile, "WINDOWS", 3)
    rows = [(i % 5, float(i * i % 91) - 40) for i in range(400)]
    got = exact_quantiles(spark.createDataFrame(rows, "g int, v double"), "v", [0.1, 0.5, 0.77], ["g"])
    for g in range(5):
        own = [v for k, v in rows if k == g]
        assert all(abs(got[(g,)][p] - np.quantile(own, p)) < 1e-12 for p in (0.1, 0.5, 0.77))


def test_quantiles_of_nothing_and_of_null_groups(spark):
    df = spark.createDataFrame([("a", None), (None, 1.0), (None, math.inf)], "g string, v double")
    assert exact_quantiles(df, "v", [0.5, 1.0], ["g"]) == {(None,): {0.5: math.inf, 1.0: math.inf}}
    assert exact_quantiles(df.limit(0), "v", [0.5]) == {}
    with pytest.raises(TypeError, match="string"):
        order_statistics(df, "g", {(): {0}})


def jobs_of(spark, run):
    spark.sparkContext.setJobGroup("counted", "counted")
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))


def test_class_profile_builds_in_few_jobs(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("good_status_loan"),
                                  *[(F.col("id") * k % 997).alias(f"f{k}") for k in range(1, 6)])
    assert jobs_of(spark, lambda: class_profile(df, [f"f{k}" for k in range(1, 6)])) < 8


def test_sums_beyond_a_long(spark):
    df = spark.range(20_000).select(F.lit("9999999999999.99").cast("decimal(15,2)").alias("x"))
    dec = DecimalType(15, 2)
    got = df.agg(exact_sum(F.col("x"), dec).alias("s"), F.sum("x").alias("t"), mean(F.col("x"), dec).alias("m")).first()
    assert got.s == got.t and got.m == float(got.t) / 20_000
    neg = spark.createDataFrame([("-0.01",), ("-123456789.99",), ("5.00",)], "x string").select(F.col("x").cast(dec).alias("x"))
    assert str(neg.agg(exact_sum(F.col("x"), dec)).first()[0]) == "-123456785.00"


def test_bad_integers_and_birth_numbers(spark):
    raw = spark.createDataFrame([("1234567890123456789", "99999999999"), ("3.6", "NaN"), ("", " 12 ")], "a string, b string")
    got = conform(raw, {"a": "bigint", "b": "int"}).collect()
    assert [tuple(r) for r in got] == [(1234567890123456789, 0, 1), (4, 0, 1), (0, 12, 0)]
    bad = decode_birth(spark.createDataFrame([("",), ("70ab13",), ("706213",)], "birth_number string")).collect()
    assert [r.sex for r in bad] == [None, None, "F"] and bad[1].birth_date is None


def test_null_group_has_its_own_histogram(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 5.0)], "g string, v double")
    got = {(r.g, r.bin): r["count"] for r in histogram(df, "v", 2, by="g").collect()}
    assert got == {(None, 0): 1, (None, 1): 1, ("a", 0): 0, ("a", 1): 1}


def test_oversampling_is_exact_and_stable(spark):
    df = spark.range(1000).select(F.col("id").alias("account_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    for mode in ("exact", "random"):
        a = sorted(map(tuple, oversample(df, "y", "account_id", 3, mode).collect()))
        b = sorted(map(tuple, oversample(df.repartition(7), "y", "account_id", 3, mode).collect()))
        assert a == b and sum(y for _, y in a) == 900 and len(a) == 1800
    copies = [sum(1 for i, y in a if i == k) for k in range(0, 1000, 10)]
    assert min(copies) >= 1 and len(set(copies)) > 3  # drawn with replacement


def test_hot_account_is_combined_before_the_rollup_shuffle(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    old = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, ("-1", "-1", "64k", "32k")):
        spark.conf.set(n, v)
    try:
        t = spark.range(0, 60_000, 1, 8).select(
            F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id") % 500).cast("int").alias("account_id"),
            F.to_date(F.lit("1995-01-01")).alias("date_"), F.lit("credit").alias("type_"), F.lit("cash_credit").alias("operation"),
            (F.col("id") % 100).cast("decimal(15,2)").alias("amount"), F.sha2(F.col("id").cast("string"), 256).alias("balance"))
        loans = spark.range(500).select(F.col("id").cast("int").alias("account_id"), F.to_date(F.lit("1996-01-01")).alias("date_"))
        out = txn_rollup(before_cutoff(t, loans))
        assert out.count() == 500
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        final = plan[:plan.find("Initial Plan")]
        # the join is split for the hot key, and partial aggregates follow it directly
        assert "skew=true" in final
        assert final.count("partial_") > 0 and final.index("partial_") < final.index("SortMergeJoin")
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
