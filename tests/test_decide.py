import random

import numpy as np
from pyspark.sql import functions as F

from lendscope.plans import decide as D


def _scores(spark, n=2000, seed=1):
    rng = random.Random(seed)
    grid = [i * 0.01 for i in range(101)]
    rows = []
    for i in range(n):
        s = rng.choice(grid) if i % 5 == 0 else rng.random()
        rows.append((i, s, int(rng.random() < s)))
    return spark.createDataFrame(rows, "account_id long, avg_score double, good_status_loan int"), rows


def test_roc_table_equals_brute_force(spark):
    df, rows = _scores(spark)
    roc = {r.step: r for r in D.roc_table(df).collect()}
    bad = [s for _, s, y in rows if y == 0]
    good = [s for _, s, y in rows if y == 1]
    for i in range(101):
        crit = i * 0.01
        assert roc[i].FalsePositive == sum(s > crit for s in bad) / len(bad)
        assert roc[i].TruePositive == sum(s > crit for s in good) / len(good)
    fp = [roc[i].FalsePositive for i in range(101)]
    assert all(a >= b for a, b in zip(fp, fp[1:]))


def test_histogram_equals_numpy(spark):
    df, rows = _scores(spark, seed=3)
    h = sorted((r.bin, r["count"]) for r in D.histogram(df, "avg_score", 22).collect())
    counts, _ = np.histogram([s for _, s, _ in rows], bins=22)
    assert [c for _, c in h] == counts.tolist()


def test_tiers_cover_pool_and_quantile_is_linear(spark):
    df, rows = _scores(spark, seed=4)
    cut = D.preapprove_cut(df)
    assert abs(cut - np.quantile([s for _, s, _ in rows], 0.95)) < 1e-12
    decided = D.decide(df, cut=cut)
    counts = {r.tier: r.n_accounts for r in D.tier_counts(decided).collect()}
    assert sum(counts.values()) == len(rows)
    assert counts["pre_approve"] == sum(s >= cut for _, s, _ in rows)


def test_classification_report_matches_hand_count(spark):
    df, rows = _scores(spark, seed=5)
    pred = D.predict(df, "avg_score", 0.5, "y_hat")
    rep = {r.class_label: r for r in D.classification_report(pred, "good_status_loan", "y_hat").collect()}
    tp = sum(1 for _, s, y in rows if y == 1 and s >= 0.5)
    pp = sum(1 for _, s, _ in rows if s >= 0.5)
    pos = sum(1 for _, _, y in rows if y == 1)
    assert rep["1"].precision == tp / pp and rep["1"].recall == tp / pos
    swapped = {r.class_label: r for r in D.classification_report(
        pred, "good_status_loan", "y_hat", swapped=True).collect()}
    assert swapped["1"].precision == rep["1"].recall


def test_confusion_and_high_confidence(spark):
    df, rows = _scores(spark, seed=6)
    c = D.confusion(df).first()
    assert c.true_good + c.false_good + c.true_bad + c.false_bad == len(rows)
    h = D.high_confidence(df).first()
    assert h.n_best == sum(s >= 0.99 for _, s, _ in rows)


def test_average_and_pivot(spark):
    df = spark.createDataFrame([(1, 0.2, 0.4, 0.6)], "account_id long, score_0 double, score_1 double, score_2 double")
    r = D.average_scores(df, ["score_0", "score_1", "score_2"]).first()
    assert abs(r.avg_score - 0.4) < 1e-15
    r2 = D.average_scores(df, ["score_0", "score_1", "score_2"], drop_first=True).first()
    assert abs(r2.avg_score - 0.5) < 1e-15
    long = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.3)], "account_id long, rep int, score double")
    w = D.score_table(long, n_reps=2).first()
    assert (w.score_0, w.score_1) == (0.1, 0.3)
