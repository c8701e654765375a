"""Model fitting and scoring with ``pyspark.ml`` (distributed solvers).

* benchmark random forest (seeded, optionally class-weighted);
* logistic regression with the inverse penalty ``C`` of the source, mapped
  to Spark's ``regParam = 1 / (C * n)`` with no standardisation, which is
  the same optimisation problem;
* grid search with k-fold cross-validation over folds that hold the same
  share of each class.  Two flows, as in the source's two scripts: resample
  the training rows once and search on the copies (``FLOW_FIRST``), or
  resample inside each training fold only, so that copies never leak into a
  held-out fold (``FLOW_SECOND``);
* bagging: repetitions with their own seeds, every repetition's model
  scoring the test, labelled and pool frames in one narrow pass;
* stored bags: models and manifest written once for a training input and a
  flow, and read back by everything that scores with them.

The driver only loops over small parameter grids; the fits of a grid are
solved together, a distributed job for a step of them all (``solver``).
"""

from __future__ import annotations

import itertools
import json
import math
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.session import cut_lineage
from lendscope.plans.prep import FEATURE_COLUMNS, KEY, LABEL, copies_of, oversample, ranked_in_class, repeated
from lendscope.plans.solver import Solution, held_hits, solve_logits

# The source's penalty grids, repetitions and seeds.
C_GRID_FIRST = [1e-5, 3e-5, 1e-4, 3e-4, 1e-3, 3e-3, .01, .03, .1, .3, 1, 3, 10]
C_GRID_SECOND = [1e-3, 3e-3, .01, .03, .1, .3, 1, 3, 10]
N_REPS = 10
SEED_STEP = 105
FOREST_SEED = 400
DEFAULT_FOLDS = 5
ROWS_PER_TASK = 50_000
REPS_AT_ONCE = 4


def assemble(df: DataFrame, cols: Sequence[str] = FEATURE_COLUMNS, label: str | None = LABEL,
             keep: Sequence[str] = (KEY,)) -> DataFrame:
    """``keep`` columns, a ``features`` vector and (optionally) a double ``label``."""
    va = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep")
    out = va.transform(df.fillna(0.0, subset=list(cols)))
    sel = [*keep, "features"]
    if label:
        out = out.withColumn("label", F.col(label).cast("double"))
        sel.append("label")
    return out.select(*sel)


def _without_summary(model: Model, spark: SparkSession) -> Model:
    """The model alone.  Its training summary holds the session, and with it, once a frame was observed in that session
    (``load_checked``), what cannot be sent to tasks: scoring would fail."""
    model._java_obj.setSummary(spark._jvm.scala.Option.empty())
    return model


def fit_forest(train: DataFrame, weight_col: str | None = None, seed: int = FOREST_SEED,
               num_trees: int = 100) -> Model:
    """Random-forest benchmark (``weight_col`` for balanced class weights)."""
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", seed=seed,
                                numTrees=num_trees)
    if weight_col:
        rf.setWeightCol(weight_col)
    return _without_summary(rf.fit(train), train.sparkSession)


def reg_param(C: float, n: float) -> float:
    """Spark ``regParam`` equal to an inverse penalty ``C`` over ``n`` rows."""
    return 1.0 / (C * n)


def fit_logit(train: DataFrame, C: float, n: float | None = None, max_iter: int = 2000, tol: float = 1e-6,
              solved: Solution | None = None) -> Model:
    """L2 logistic regression with inverse penalty ``C``; raises if it does not converge.

    ``solved``: this problem's coefficients and intercept, where :func:`solve_logits` has found them with others'.
    """
    if solved is not None:
        return fixed_logit(train.sparkSession, *solved)
    n = float(train.count()) if n is None else n
    lr = LogisticRegression(featuresCol="features", labelCol="label", regParam=reg_param(C, n),
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol)
    model = lr.fit(train)
    if model.summary.totalIterations >= max_iter:
        raise RuntimeError(f"no convergence within {max_iter} iterations for C={C}")
    return _without_summary(model, train.sparkSession)


def fixed_logit(spark: SparkSession, coefficients: Sequence[float], intercept: float) -> Model:
    """A logistic model with given coefficients, e.g. of a scorecard, to score with like a fitted one."""
    vector = spark._jvm.org.apache.spark.ml.linalg.Vectors.dense(_doubles(spark, coefficients))
    return LogisticRegressionModel(spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        "fixed-logit", vector, float(intercept)))


def _doubles(spark: SparkSession, values: Sequence[float]):
    out = spark.sparkContext._gateway.new_array(spark._jvm.double, len(values))
    for i, v in enumerate(values):
        out[i] = float(v)
    return out


#: ``recall`` is that of class 1; ``recall_micro`` counts the hits of both classes over all rows.
METRICS = ("recall", "recall_micro", "accuracy")


def prob_good(model: Model, df: DataFrame, out: str) -> DataFrame:
    """Add ``out`` = probability of class 1 (one narrow pass)."""
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(
        "rawPrediction", "probability", "prediction")


def _metric(scored: DataFrame, metric: str) -> float:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; use one of {METRICS}")
    pred = F.when(F.col("p1") >= 0.5, 1.0).otherwise(0.0)
    y = F.col("label")
    row = scored.agg(F.count_if(pred == y).alias("hit"), F.count(F.lit(1)).alias("n"),
                     F.count_if((pred == 1.0) & (y == 1.0)).alias("tp"),
                     F.count_if(y == 1.0).alias("pos")).first()
    if metric == "recall":
        return row["tp"] / row["pos"] if row["pos"] else 0.0
    return row["hit"] / row["n"] if row["n"] else 0.0


@dataclass
class SearchResult:
    best_C: float
    model: Model
    scores: dict[float, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Flow:
    """How a repetition searches: grid, folds, metric, and where the oversampling runs."""

    grid: tuple[float, ...]
    metric: str = "recall"
    resample_in_fold: bool = True
    oversampling: str = "ratio"
    folds: int = DEFAULT_FOLDS
    seeds: tuple[int, ...] = tuple(SEED_STEP * i for i in range(N_REPS))


#: The source's first script: resample (draws with replacement), then search for micro-averaged recall on the copies.
FLOW_FIRST = Flow(tuple(C_GRID_FIRST), "recall_micro", resample_in_fold=False, oversampling="random")
#: Its second: the search resamples inside each training fold, for the recall of class 1.
FLOW_SECOND = Flow(tuple(C_GRID_SECOND))


def stratified_folds(df: DataFrame, folds: int, seed: int, label: str = "label", key: str = KEY,
                     out: str = "_fold") -> DataFrame:
    """Add ``out``: fold number ``rank in class (by key hash) mod folds``.

    Every fold holds each class's share up to one row, whatever the sizes.
    Stable under repartitioning; no class is ranked in one task.
    """
    fold = (F.col("_rank") % F.lit(folds)).cast("int").alias(out)
    return ranked_in_class(df, label, key, seed).select(*df.columns, fold)


def _slots(slim: DataFrame, folds: int, seed: int, resample_in_fold: bool, oversampling: str, key: str) -> DataFrame:
    """One row per ``_row`` of ``slim`` (with ``key`` and ``label``): arrays ``taken`` and ``held`` of how often each
    fold's training set and held-out part hold the row, and ``whole``, how often the refit does."""
    def times(which) -> Column:
        return F.array(*[which(k).cast("int") for k in range(folds)])

    if not resample_in_fold:
        dealt = stratified_folds(oversample(slim, "label", key, seed=seed, mode=oversampling), folds, seed + 7919, "label", key)
        held = dealt.groupBy("_row").agg(times(lambda k: F.count_if(F.col("_fold") == k)).alias("held"))
        whole = F.aggregate("held", F.lit(0), lambda a, n: a + n)
        return held.select("_row", F.transform("held", lambda n: whole - n).alias("taken"), "held", whole.alias("whole"))
    dealt = cut_lineage(stratified_folds(slim, folds, seed + 7919, "label", key))
    sets = {k: copies_of(dealt.filter(F.col("_fold") != k), "label", key, seed + k, oversampling) for k in range(folds)}
    whole, n = copies_of(dealt, "label", key, seed, oversampling)
    held = times(lambda k: F.col("_fold") == k).alias("held")
    if oversampling == "ratio":  # every number of copies is an expression on the row's own columns
        return dealt.select("_row", times(lambda k: F.when(F.col("_fold") != k, sets[k][1]).otherwise(0)).alias("taken"),
                            held, n.cast("int").alias("whole"))
    parts = [whole.select("_row", F.lit(folds).alias("_set"), n.cast("int").alias("_n"))]
    parts += [rows.select("_row", F.lit(k), c.cast("int")) for k, (rows, c) in sets.items()]
    found = reduce(DataFrame.union, parts).groupBy("_row").agg(
        times(lambda k: F.coalesce(F.sum(F.when(F.col("_set") == k, F.col("_n"))), F.lit(0))).alias("taken"),
        F.sum(F.when(F.col("_set") == folds, F.col("_n"))).cast("int").alias("whole"))
    return dealt.select("_row", held).join(found, "_row").select("_row", "taken", "held", "whole")


def _searches(train: DataFrame, grid: Sequence[float], folds: int, metric: str, seeds: Sequence[int], resample_in_fold: bool,
              key: str, parallelism: int, oversampling: str, judge_each: bool) -> list[SearchResult]:
    """One grid search per seed, all their fits solved together; ``judge_each``: a job per fit judges the held-out part,
    else one pass judges all."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; use one of {METRICS}")
    # a checkpoint's partitions and their order are fixed, and so are these numbers
    rows = cut_lineage(train).withColumn("_row", F.monotonically_increasing_id())
    slim = rows.select("_row", F.col(key), F.col("label"))
    with ThreadPoolExecutor(max_workers=REPS_AT_ONCE) as pool:
        slots = list(pool.map(lambda s: cut_lineage(_slots(slim, folds, s, resample_in_fold, oversampling, key)), seeds))
    parts = [s.withColumn("_rep", F.lit(i)) for i, s in enumerate(slots)]
    reps = reduce(DataFrame.unionByName, parts).groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("_rep", "taken", "held", "whole"))).alias("_reps"))
    names = [c for c in train.columns]
    data = cut_lineage(rows.join(reps, "_row").select(
        *names, *[F.flatten(f"_reps.{c}").alias(f"_{c}") for c in ("taken", "held")], F.col("_reps.whole").alias("_whole")))
    sets, n = [(s, k) for s in range(len(seeds)) for k in range(folds)], len(seeds) * folds
    row = data.agg(F.count(F.lit(1)), *[F.sum(F.col("_taken")[j]) for j in range(n)],
                   *[F.sum(F.col("_whole")[s]) for s in range(len(seeds))]).first()
    sizes, whole_sizes = [float(v or 0) for v in row[1:n + 1]], [float(v or 0) for v in row[n + 1:]]

    def of(copies: str) -> DataFrame:
        return data.select("features", "label", F.col(copies).alias("copies"))

    def part(copies: str, j: int) -> DataFrame:
        return repeated(data.filter(F.col(copies)[j] > 0), F.col(copies)[j], names)

    def few(df: DataFrame, size: float) -> DataFrame:
        # every solver step is a job: as many tasks as the rows need, not as the shuffle left
        return cut_lineage(df).coalesce(max(1, int(size) // ROWS_PER_TASK))

    results: list[dict[float, float]] = [{} for _ in seeds]
    if len(grid) > 1:
        solved = solve_logits(of("_taken"), n, grid, row[0])
        fit_parts = [part("_taken", j) for j in range(n)]
        for j in range(n):
            if any((C, j) not in solved for C in grid):
                fit_parts[j] = few(fit_parts[j], sizes[j])
        tasks = [(C, j) for C in grid for j in range(n)]
        counts = {} if judge_each else _judged(of("_held"), n, solved, row[0])

        def one(task: tuple[float, int]) -> float:
            if task in counts:
                return _share(counts[task], metric)
            C, j = task
            m = fit_logit(fit_parts[j], C, sizes[j], solved=solved.get(task))
            return _metric(prob_good(m, part("_held", j), "p1"), metric)

        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            for (C, j), v in zip(tasks, pool.map(one, tasks)):
                result = results[sets[j][0]]
                result[C] = result.get(C, 0.0) + v / folds
    best = [max(grid, key=lambda c: (r[c], -c)) if r else grid[0] for r in results]
    wanted = {(C, s) for s, C in enumerate(best)}
    solved = solve_logits(of("_whole"), len(seeds), sorted(set(best)), row[0], 2000, 1e-6, wanted)

    def refit(s: int) -> Model:
        full, known = part("_whole", s), solved.get((best[s], s))
        return fit_logit(full if known else few(full, whole_sizes[s]), best[s], whole_sizes[s], solved=known)

    with ThreadPoolExecutor(max_workers=REPS_AT_ONCE) as pool:
        models = list(pool.map(refit, range(len(seeds))))
    return [SearchResult(C, m, r) for C, m, r in zip(best, models, results)]


def _judged(held: DataFrame, sets: int, solved: dict[tuple[float, int], Solution], rows: int) -> dict[tuple[float, int], list]:
    """Counts of :func:`held_hits` for every fit that is solved."""
    fits = list(solved)
    return dict(zip(fits, held_hits(held, sets, [(k, solved[C, k]) for C, k in fits], rows).tolist())) if fits else {}


def _share(counts: Sequence[float], metric: str) -> float:
    """The metric of one row of :func:`held_hits`."""
    hit, n, tp, pos = counts
    if metric == "recall":
        return tp / pos if pos else 0.0
    return hit / n if n else 0.0


def grid_search(train: DataFrame, grid: Sequence[float], folds: int = DEFAULT_FOLDS,
                metric: str = "recall", seed: int = 0, resample_in_fold: bool = True,
                key: str = KEY, parallelism: int = 8, oversampling: str = "ratio") -> SearchResult:
    """k-fold search over ``C`` on folds stratified by class.

    With ``resample_in_fold`` the oversampling runs inside each training fold
    and on the whole frame for the refit; without it the frame is resampled
    first, and copies are dealt to the folds like other rows (the source's
    first flow).  Copies are weights of the rows they repeat: rows are dealt by
    key and label alone, and features meet the weights once.  All (C, fold) fits
    are solved together (:func:`solve_logits`); fits left out there, and the
    scoring of the held-out folds, are independent Spark jobs from
    ``parallelism`` driver threads, like ``CrossValidator(parallelism=...)``.
    The best ``C`` (ties: the smallest) is refitted on all (resampled) rows.
    ``train`` needs ``key``, ``features`` and ``label``.
    """
    return _searches(train, grid, folds, metric, [seed], resample_in_fold, key, parallelism, oversampling, True)[0]


def bag(train: DataFrame, grid: Sequence[float], reps: int = N_REPS,
        seeds: Sequence[int] | None = None, folds: int = DEFAULT_FOLDS,
        metric: str = "recall", key: str = KEY, resample_in_fold: bool = True,
        oversampling: str = "ratio") -> list[SearchResult]:
    """One grid search per repetition, each with its own seed: the fits of all repetitions share their jobs, and one pass
    judges them."""
    seeds = list(seeds) if seeds is not None else [SEED_STEP * i for i in range(reps)]
    return _searches(train, grid, folds, metric, seeds, resample_in_fold, key, 8, oversampling, False) if seeds else []


def bag_flow(train: DataFrame, flow: Flow, key: str = KEY) -> list[SearchResult]:
    """The bag of a whole flow."""
    return bag(train, flow.grid, seeds=flow.seeds, folds=flow.folds, metric=flow.metric, key=key,
               resample_in_fold=flow.resample_in_fold, oversampling=flow.oversampling)


# ---------------------------------------------------------------------------
# stored bags
# ---------------------------------------------------------------------------

def input_facts(df: DataFrame, key: str = KEY) -> tuple[dict, list[float]]:
    """What tells one training frame from another, in any order of its rows.

    Exact: rows, and a sum of hashes of key and label.  Up to rounding: for
    each feature its sum and its sum weighted by a hash of the key, as the last
    bits of deviations and means depend on the order in which partial
    aggregates met.
    """
    x, weight = vector_to_array("features"), F.xxhash64(F.col(key), F.lit(1)) / F.lit(2.0 ** 63)
    first = df.select(F.size(x).alias("n")).first()
    sums = [s for i in range(first["n"] if first else 0) for s in (F.sum(x[i]), F.sum(x[i] * weight))]
    r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.col(key), "label").cast("decimal(20,0)")), *sums).first()
    return {"rows": r[0], "keys": str(r[1])}, [float(v) for v in r[2:]]


def _alike(a: Sequence[float], b: Sequence[float]) -> bool:
    return len(a) == len(b) and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-6) for x, y in zip(a, b))


def _manifest_path(path: str) -> str:
    return f"{path.rstrip('/')}/manifest"


def save_bag(spark: SparkSession, fits: Sequence[SearchResult], path: str, about: dict) -> None:
    """Write every repetition's model, then the manifest: a bag without manifest is not whole."""
    reps = []
    for i, f in enumerate(fits):
        name = f"model-{i:03d}"
        f.model.write().overwrite().save(f"{path.rstrip('/')}/{name}")
        reps.append({"model": name, "best_C": f.best_C, "scores": sorted(f.scores.items())})
    text = json.dumps({**about, "repetitions": reps}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(_manifest_path(path))


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """What a stored bag says of itself; ``None`` if there is no whole bag at ``path``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{_manifest_path(path)}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return json.loads("".join(r["value"] for r in spark.read.text(_manifest_path(path), wholetext=True).collect()))


def load_bag(spark: SparkSession, path: str) -> list[SearchResult]:
    """The repetitions of a stored bag, in order."""
    about = read_manifest(spark, path)
    if about is None:
        raise FileNotFoundError(f"no whole bag at {path}")
    return [SearchResult(r["best_C"], LogisticRegressionModel.load(f"{path.rstrip('/')}/{r['model']}"),
                         {c: v for c, v in r["scores"]}) for r in about["repetitions"]]


def stored_bag(train: DataFrame, flow: Flow, root: str, key: str = KEY) -> list[SearchResult]:
    """The flow's bag for this very training input: read from ``root`` if it is there, else fitted and written.

    A bag is found by the flow and :func:`input_facts`, so other rows, labels,
    features, grids, seeds or folds never meet it.  ``root`` is a folder that
    driver and executors share.
    """
    spark = train.sparkSession
    exact, sums = input_facts(train, key)
    about = {"input": exact, "flow": json.loads(json.dumps(asdict(flow)))}
    name = f"{root.rstrip('/')}/bag-{uuid.uuid5(uuid.NAMESPACE_OID, json.dumps(about, sort_keys=True)).hex}"
    for k in itertools.count():  # frames with the same rows and labels but other features lie side by side
        path = f"{name}-{k}"
        known = read_manifest(spark, path)
        if known is None:
            save_bag(spark, bag_flow(train, flow, key), path, {**about, "sums": sums})
        if known is None or ({n: known[n] for n in about} == about and _alike(known["sums"], sums)):
            return load_bag(spark, path)


def score(models: Sequence[Model], df: DataFrame, prefix: str = "score_") -> DataFrame:
    """Probability of class 1 from every model, as ``score_0..score_{n-1}``."""
    out = df
    for i, m in enumerate(models):
        out = prob_good(m, out, f"{prefix}{i}")
    return out.drop("features")
