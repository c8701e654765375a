import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscope.plans import model as ML


def _planted(spark, n=600):
    df = spark.range(n).select(
        F.col("id").alias("account_id"),
        ((F.col("id") * 37 % 101) / 101.0).alias("x1"),
        ((F.col("id") * 53 % 97) / 97.0).alias("x2"))
    return df.withColumn("good_status_loan", F.when(F.col("x1") + 0.2 * F.col("x2") > 0.6, 1).otherwise(0))


def test_logit_learns_planted_signal_and_is_deterministic(spark):
    data = ML.assemble(_planted(spark), ["x1", "x2"])
    m1 = ML.fit_logit(data, C=100.0)
    m2 = ML.fit_logit(data, C=100.0)
    assert m1.coefficients.toArray().tolist() == m2.coefficients.toArray().tolist()
    scored = ML.score([m1], data)
    acc = scored.select(F.avg(((F.col("score_0") >= 0.5).cast("int") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.85


def test_reg_param_mapping():
    assert ML.reg_param(1.0, 400) == 1 / 400


def test_grid_search_and_forest(spark):
    data = ML.assemble(_planted(spark, 300), ["x1", "x2"])
    res = ML.grid_search(data, [0.01, 10.0], folds=2, metric="recall", seed=0, parallelism=2)
    assert set(res.scores) == {0.01, 10.0} and res.best_C in res.scores
    rf = ML.fit_forest(data, num_trees=5)
    assert rf.transform(data).count() == 300


def test_logit_equals_newton_solution(spark):
    data = ML.assemble(_planted(spark, 300), ["x1", "x2"]).cache()
    rows = data.collect()
    x = np.array([[*r.features.toArray(), 1.0] for r in rows])
    y = np.array([r.label for r in rows])
    for C in (0.1, 10.0):
        w, penalty = np.zeros(3), np.diag([1 / C, 1 / C, 0.0])  # the intercept is free
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ w))
            w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        m = ML.fit_logit(data, C)
        assert np.allclose([*m.coefficients.toArray(), m.intercept], w, atol=2e-3)


def test_unknown_metric_and_missing_convergence_raise(spark):
    data = ML.assemble(_planted(spark, 100), ["x1", "x2"])
    with pytest.raises(ValueError, match="metric"):
        ML.grid_search(data, [0.1, 1.0], folds=2, metric="f1")
    with pytest.raises(RuntimeError, match="convergence"):
        ML.fit_logit(data, 1.0, max_iter=1)


def test_bagged_models_score_and_judge_three_populations(spark):
    from lendscope.checks import queries as Q
    data = ML.assemble(_planted(spark, 300), ["x1", "x2"])
    train, test = data.filter("account_id < 200"), data.filter("account_id >= 200")
    pool = data.drop("label").withColumn("account_id", F.col("account_id") + 1000)
    models = [ML.fit_logit(train, C) for C in (1.0, 100.0)]
    scored = Q._populations(models, train, test, pool).cache()
    rows = scored.toPandas()
    assert rows.groupby("population").size().to_dict() == {"test": 100, "labelled": 300, "pool": 300}
    assert np.allclose(rows.avg_score, (rows.score_0 + rows.score_1) / 2)
    assert rows.good_status_loan.isna().equals(rows.population == "pool")
    for r in Q._per_population(scored, Q.D.confusion).collect():
        x = rows[rows.population == r.population]
        assert r.true_good == ((x.good_status_loan == 1) & (x.avg_score >= 0.68)).sum()
        assert r.true_good + r.false_good + r.true_bad + r.false_bad == len(x)
    assert Q._per_population(scored, Q.D.roc_table).count() == 202
    report = Q._per_population(scored, Q._report).where("class_label = 'accuracy'").collect()
    assert {r.population: r.support for r in report} == {"test": 100, "labelled": 300}
    assert {"bagged_confusion", "bagged_roc", "bagged_report"} <= set(Q.queries())


def test_folds_hold_each_class_share(spark):
    df = _planted(spark, 503).withColumn("label", F.when(F.col("account_id") % 50 == 0, 0.0).otherwise(1.0))
    got = ML.stratified_folds(df, 5, seed=3)
    again = ML.stratified_folds(df.repartition(7), 5, seed=3)
    assert got.columns == [*df.columns, "_fold"] and got.exceptAll(again.select(got.columns)).count() == 0
    sizes = got.groupBy("label", "_fold").count().toPandas()
    for _, part in sizes.groupby("label"):
        assert len(part) == 5 and part["count"].max() - part["count"].min() <= 1
    assert ML.stratified_folds(df.limit(0), 5, seed=3).count() == 0


def _micro_recall(rows, models, C, folds):
    """Hits of both classes over all rows of a fold, averaged over folds."""
    out = []
    for k in range(folds):
        held = [r for r in rows if r["_fold"] == k]
        hits = 0
        for r in held:
            w = models[(C, k)]
            z = w.intercept + w.coefficients.dot(r["features"])
            hits += (1.0 if z >= 0 else 0.0) == r["label"]
        out.append(hits / len(held))
    return sum(out) / folds


def test_first_flow_searches_on_resampled_rows(spark, monkeypatch):
    data = ML.assemble(_planted(spark, 240).withColumn("good_status_loan", F.when(F.col("x1") > 0.8, 1).otherwise(0)),
                       ["x1", "x2"]).cache()
    seen, sizes, models = [], [], {}
    real_over, real_fit = ML.oversample, ML.fit_logit
    monkeypatch.setattr(ML, "oversample", lambda df, *a, **k: seen.append(k["mode"]) or real_over(df, *a, **k))

    def fit(df, C, n=None, **k):
        m = real_fit(df, C, n, **k)
        models[(C, len([1 for c, _ in models if c == C]))] = m
        sizes.append(df.count())
        return m

    monkeypatch.setattr(ML, "fit_logit", fit)
    res = ML.grid_search(data, [0.1, 10.0], folds=3, metric="recall_micro", seed=5, resample_in_fold=False,
                         parallelism=1, oversampling="random")
    assert seen == ["random"]  # once, before the search
    counts = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}
    full = 2 * max(counts.values())
    assert sizes[-1] == full and sum(sizes[:3]) == 2 * full  # three folds of three, each without one
    folds = ML.stratified_folds(real_over(data, "label", "account_id", seed=5, mode="random"), 3, 5 + 7919).collect()
    for C in (0.1, 10.0):
        assert abs(res.scores[C] - _micro_recall(folds, models, C, 3)) < 1e-12


def test_second_flow_keeps_copies_out_of_held_folds(spark, monkeypatch):
    data = ML.assemble(_planted(spark, 200), ["x1", "x2"])
    judged = []
    monkeypatch.setattr(ML, "_metric", lambda scored, m, run=ML._metric: judged.append(scored.count()) or run(scored, m))
    ML.grid_search(data, [1.0, 3.0], folds=4, metric="recall", seed=1, parallelism=1)
    assert len(judged) == 8 and sum(judged) == 2 * 200  # every row once for each C, no copy


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 0.9), (1.0, 0.2), (0.0, 0.7), (0.0, 0.1), (0.0, 0.2)], "label double, p1 double")
    assert [ML._metric(df, m) for m in ("recall", "recall_micro", "accuracy")] == [0.5, 0.6, 0.6]


FLOW = ML.Flow((0.1, 10.0), folds=2, seeds=(0, 105))


def test_stored_bag_is_fitted_once_and_scores_alike(spark, tmpdir_path, monkeypatch):
    data = ML.assemble(_planted(spark, 200), ["x1", "x2"])
    fits = []
    monkeypatch.setattr(ML, "bag_flow", lambda *a, run=ML.bag_flow: fits.append(1) or run(*a))
    first = ML.stored_bag(data, FLOW, tmpdir_path)
    second = ML.stored_bag(data.repartition(5), FLOW, tmpdir_path)  # same rows in another order
    assert len(fits) == 1 and len(first) == len(second) == 2
    fresh = ML.bag(data, FLOW.grid, seeds=FLOW.seeds, folds=2)
    scores = [sorted(map(tuple, ML.score([f.model for f in b], data).drop("label").collect())) for b in (first, second, fresh)]
    assert scores[0] == scores[1] == scores[2]
    assert [(f.best_C, f.scores) for f in second] == [(f.best_C, f.scores) for f in fresh]
    # other rows, and another flow, have bags of their own
    ML.stored_bag(data.filter("account_id > 0"), FLOW, tmpdir_path)
    ML.stored_bag(data, ML.Flow((0.1,), folds=2, seeds=(0,)), tmpdir_path)
    assert len(fits) == 3


def test_a_bag_without_manifest_is_not_read(spark, tmpdir_path):
    data = ML.assemble(_planted(spark, 100), ["x1", "x2"])
    with pytest.raises(FileNotFoundError):
        ML.load_bag(spark, f"{tmpdir_path}/none")
    fits = ML.bag(data, [1.0], seeds=[0, 1])
    ML.save_bag(spark, fits, f"{tmpdir_path}/b", {"made": "here"})
    about = ML.read_manifest(spark, f"{tmpdir_path}/b")
    assert about["made"] == "here" and [r["best_C"] for r in about["repetitions"]] == [1.0, 1.0]


def test_input_facts_see_rows_not_order(spark):
    data = ML.assemble(_planted(spark, 50), ["x1", "x2"])

    def same(a, b):
        (x, p), (y, q) = ML.input_facts(a), ML.input_facts(b)
        return x == y and ML._alike(p, q)

    assert same(data, data.repartition(3))
    assert not same(data, data.filter("account_id <> 7")) and not same(data, data.unionByName(data.limit(1)))
    # the same values at other rows, and other labels
    swapped = ML.assemble(_planted(spark, 50).withColumn("x1", ((49 - F.col("account_id")) * 37 % 101) / 101.0), ["x1", "x2"])
    assert not same(data, swapped) and not same(data, data.withColumn("label", 1 - F.col("label")))
    assert ML.input_facts(data.limit(0))[0]["rows"] == 0


def test_bags_of_other_features_lie_side_by_side(spark, tmpdir_path):
    base = _planted(spark, 120)
    flow = ML.Flow((1.0,), folds=2, seeds=(0,))
    frames = [ML.assemble(base.withColumn("x2", F.col("x2") * k), ["x1", "x2"]) for k in (1.0, 2.0, 1.0)]
    got = [ML.stored_bag(f.withColumn("label", F.col("account_id") % 2 * 1.0), flow, tmpdir_path)[0].model for f in frames]
    a, b, c = (m.coefficients.toArray().tolist() for m in got)
    assert a == c != b and len(__import__("os").listdir(tmpdir_path)) == 2


def test_models_score_in_a_session_that_has_observed(spark):
    from pyspark.sql import Observation
    seen = Observation("before-scoring")
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).count()
    assert seen.get == {"n": 5}
    data = ML.assemble(_planted(spark, 60), ["x1", "x2"])
    assert ML.score([ML.fit_logit(data, 1.0)], data).where("score_0 between 0 and 1").count() == 60
    assert ML.fit_forest(data, num_trees=3).transform(data).where("prediction in (0.0, 1.0)").count() == 60


def test_fits_of_a_grid_share_their_jobs_and_agree_with_single_fits(spark):
    data = ML.assemble(_planted(spark, 400), ["x1", "x2"])
    rows = data.withColumn("copies", F.array(F.when(F.col("account_id") % 3 > 0, 1).otherwise(0),
                                             (F.col("account_id") % 4).cast("int"))).cache()
    sets = [data.where("account_id % 3 > 0"),
            rows.withColumn("again", F.explode(F.expr("sequence(1, copies[1])"))).where("copies[1] > 0")]
    tracker, grid = spark.sparkContext.statusTracker(), [0.01, 0.1, 1.0, 10.0]
    rows.count()
    spark.sparkContext.setJobGroup("together", "together")
    got = ML.solve_logits(rows, 2, grid, 400)
    jobs = len(tracker.getJobIdsForGroup("together"))
    spark.sparkContext.setJobGroup("single", "single")
    for (C, k), (coefficients, intercept) in got.items():
        m = ML.fit_logit(sets[k], C)
        assert np.allclose([*coefficients, intercept], [*m.coefficients.toArray(), m.intercept], rtol=1e-4, atol=1e-5)
    assert set(got) == {(C, k) for C in grid for k in (0, 1)}
    assert jobs < len(tracker.getJobIdsForGroup("single")) / 3
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_sets_that_cannot_be_solved_together_are_left_to_the_library(spark):
    data = ML.assemble(_planted(spark, 60), ["x1", "x2"])
    one = F.when(F.col("label") == 1, 1).otherwise(0)
    got = ML.solve_logits(data.withColumn("copies", F.array(one, F.lit(0), F.lit(1))), 3, [1.0], 60)
    assert set(got) == {(1.0, 2)}
    assert ML.solve_logits(data.withColumn("copies", F.array(F.lit(1))).limit(0), 1, [1.0], 0) == {}
    with pytest.raises(RuntimeError, match="convergence"):
        ML.solve_logits(data.withColumn("copies", F.array(F.lit(1))), 1, [1.0], 60, max_iter=1)


@pytest.mark.parametrize("mode", ["ratio", "exact", "random"])
def test_copies_as_weights_search_like_copied_rows(spark, monkeypatch, mode):
    planted = _planted(spark, 240).withColumn("good_status_loan", F.when(F.col("x1") > 0.7, 1).otherwise(0))
    data = ML.assemble(planted, ["x1", "x2"])
    together = ML.grid_search(data, [0.1, 10.0], folds=3, seed=2, oversampling=mode)
    monkeypatch.setattr(ML, "solve_logits", lambda *a: {})
    single = ML.grid_search(data, [0.1, 10.0], folds=3, seed=2, oversampling=mode)
    assert together.best_C == single.best_C and together.scores == pytest.approx(single.scores, abs=1e-9)


@pytest.mark.parametrize("flow", [
    ML.Flow((0.1, 10.0), folds=2, seeds=(0, 105, 210)),
    ML.Flow((0.1, 10.0), "recall_micro", resample_in_fold=False, oversampling="random", folds=2, seeds=(0, 105, 210))])
def test_repetitions_of_a_bag_share_their_jobs_and_search_like_single_ones(spark, monkeypatch, flow):
    calls = []
    monkeypatch.setattr(ML, "solve_logits", lambda *a, run=ML.solve_logits: calls.append(a) or run(*a))
    data = ML.assemble(_planted(spark, 200).withColumn("good_status_loan", F.when(F.col("x1") > 0.7, 1).otherwise(0)),
                       ["x1", "x2"]).cache()
    together = ML.bag_flow(data, flow)
    assert len(calls) == 2  # the searches of all repetitions, then their refits
    assert calls[0][0].count() == 200  # copies are weights, not rows
    for seed, got in zip(flow.seeds, together):
        one = ML.grid_search(data, flow.grid, flow.folds, flow.metric, seed, resample_in_fold=flow.resample_in_fold,
                             oversampling=flow.oversampling)
        assert got.best_C == one.best_C and got.scores == pytest.approx(one.scores, abs=1e-9)
        assert np.allclose(got.model.coefficients.toArray(), one.model.coefficients.toArray(), rtol=1e-6)
