from pyspark.sql import functions as F

from lendscope.plans import prep as P


def test_get_dummies_drops_first_sorted_level(spark):
    df = spark.createDataFrame([(1, "weekly"), (2, "monthly"), (3, "after_transaction"), (4, None)],
                               "account_id int, freq_dep_acc string")
    out = P.get_dummies(df, ["freq_dep_acc"])
    assert out.columns == ["account_id", "freq_dep_acc_monthly", "freq_dep_acc_weekly"]
    assert [tuple(r)[1:] for r in out.orderBy("account_id").collect()] == [(0, 1), (1, 0), (0, 0), (0, 0)]


def test_split_is_stable_under_repartition(spark):
    df = spark.range(5000).withColumnRenamed("id", "account_id")
    a = {r.account_id: r.is_test for r in P.train_test_split(df).collect()}
    b = {r.account_id: r.is_test for r in P.train_test_split(df.repartition(7)).collect()}
    assert a == b
    share = sum(a.values()) / len(a)
    assert 0.22 < share < 0.28


def test_oversample_exact_equalises_classes(spark):
    df = spark.range(1000).select(F.col("id").alias("account_id"),
                                  F.when(F.col("id") % 7 == 0, 0).otherwise(1).alias("good_status_loan"))
    counts = P.class_counts(P.oversample(df, mode="exact", seed=3))
    assert counts[0] == counts[1] == 857


def test_oversample_ratio_near_equal_and_deterministic(spark):
    df = spark.range(3000).select(F.col("id").alias("account_id"),
                                  F.when(F.col("id") % 4 == 0, 0).otherwise(1).alias("good_status_loan"))
    a = P.class_counts(P.oversample(df, seed=1))
    b = P.class_counts(P.oversample(df.repartition(5), seed=1))
    assert a == b and abs(a[0] - a[1]) < 100


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([(i, 1 if i < 3 else 0) for i in range(4)], "account_id int, good_status_loan int")
    w = {r.good_status_loan: r.weight for r in P.class_weights(df).collect()}
    assert w == {1: 4 / (2 * 3), 0: 4 / (2 * 1)}
    ww = {r.account_id: r.weight for r in P.with_class_weights(df).collect()}
    assert ww[0] == 4 / 6 and ww[3] == 2.0
