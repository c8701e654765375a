"""Evaluation and decisions on averaged scores.

Everything here is one or two aggregates over the score table; results that
reach the driver are scalars (a quantile, min/max) or tables bounded by
construction (<= 102 ROC buckets, <= k^2 confusion cells, one row per bin).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendscope.operators.quantile import exact_quantile, exact_quantiles

# Decision thresholds and grids of the source.
APPROVE_THRESHOLD = 0.68
PREAPPROVE_QUANTILE = 0.95
HIGH_CONFIDENCE = 0.99
PREDICT_THRESHOLD = 0.5
ROC_STEPS = 100          # thresholds i * 0.01 for i = 0..100
ROC_STEP = 0.01
ROC_POINTS = (50, 68, 90)
PROFILE_FEATURES = ["n_neg_balance", "min_balance", "avg_balance", "std_balance",
                    "avg_orders_housing"]
TIER_BINS = {"pre_approve": 2, "approve": 5, "deny": 15}
POOL_BINS = 22


# ---------------------------------------------------------------------------
# score tables
# ---------------------------------------------------------------------------

def average_scores(df: DataFrame, score_cols: Sequence[str], out: str = "avg_score",
                   drop_first: bool = False) -> DataFrame:
    """Row mean of the score columns, ``(s0 + s1 + ...) / n``.

    ``drop_first=True`` leaves the first column out of the mean, as the
    source's positional slicing does.
    """
    cols = list(score_cols)[1:] if drop_first else list(score_cols)
    total = F.col(cols[0])
    for c in cols[1:]:
        total = total + F.col(c)
    return df.withColumn(out, total / F.lit(float(len(cols))))


def score_table(long_df: DataFrame, key: str = "account_id", rep: str = "rep",
                score: str = "score", n_reps: int | None = None) -> DataFrame:
    """Long ``(key, rep, score)`` -> one row per key with ``score_0..score_{n-1}``.

    The repetition ids are given (``range(n_reps)``), so the pivot needs no
    extra pass to discover them; one aggregation keyed by ``key``.
    """
    if n_reps is None:
        n_reps = long_df.agg(F.max(rep)).first()[0] + 1
    wide = long_df.groupBy(key).pivot(rep, list(range(n_reps))).agg(F.first(score))
    return wide.select(key, *[F.col(str(i)).alias(f"score_{i}") for i in range(n_reps)])


def score_label_join(scores: DataFrame, labels: DataFrame, key: str = "account_id",
                     how: str = "inner") -> DataFrame:
    """Scores joined to labels by key (inner, or left to keep unlabelled rows)."""
    return scores.join(labels, key, how)


def predict(df: DataFrame, score: str = "avg_score", threshold: float = PREDICT_THRESHOLD,
            out: str = "y_hat", inverted: bool = False) -> DataFrame:
    """0/1 prediction: ``score >= threshold`` (``inverted``: ``score < threshold``)."""
    s = F.col(score)
    hit = (s < threshold) if inverted else (s >= threshold)
    return df.withColumn(out, F.when(hit, 1).otherwise(0))


# ---------------------------------------------------------------------------
# threshold analysis
# ---------------------------------------------------------------------------

def confusion(df: DataFrame, score: str = "avg_score", label: str = "good_status_loan",
              crit: float = APPROVE_THRESHOLD) -> DataFrame:
    """One row: true/false good (score >= crit) and true/false bad (< crit)."""
    s, y = F.col(score), F.col(label)
    return df.agg(F.count_if((y == 1) & (s >= crit)).alias("true_good"),
                  F.count_if((y == 0) & (s >= crit)).alias("false_good"),
                  F.count_if((y == 0) & (s < crit)).alias("true_bad"),
                  F.count_if((y == 1) & (s < crit)).alias("false_bad"))


def _grid(i: Column) -> Column:
    return i.cast("double") * F.lit(ROC_STEP)


def roc_bucket(s: Column, steps: int = ROC_STEPS) -> Column:
    """Number of grid thresholds ``i * 0.01`` (i = 0..steps) strictly below ``s``.

    ``floor(s * 100) + 1`` is right up to one step of floating error; one
    correction in each direction against the exact grid values fixes it.
    """
    k = F.least(F.greatest(F.floor(s * F.lit(1.0 / ROC_STEP)) + 1, F.lit(0)), F.lit(steps + 1))
    k = F.when((k >= 1) & (_grid(k - 1) >= s), k - 1).otherwise(k)
    k = F.when((k <= steps) & (_grid(k) < s), k + 1).otherwise(k)
    return k


def roc_table(df: DataFrame, score: str = "avg_score", label: str = "good_status_loan",
              steps: int = ROC_STEPS) -> DataFrame:
    """Share of bad and of good rows with ``score > i * 0.01`` for i = 0..steps.

    One pass: each row is counted in its bucket (the number of thresholds
    below its score), giving at most ``steps + 2`` rows; a running sum over
    those buckets gives every threshold at once.  Never rows x thresholds.
    """
    s, y = F.col(score), F.col(label)
    counts = (df.select(roc_bucket(s, steps).alias("k"), y.alias("y"))
                .groupBy("k").agg(F.count_if(F.col("y") == 0).alias("n_bad"),
                                  F.count_if(F.col("y") == 1).alias("n_good")))
    grid = df.sparkSession.range(0, steps + 2).select(F.col("id").alias("k"))
    full = grid.join(F.broadcast(counts), "k", "left").fillna(0, ["n_bad", "n_good"])
    # running sums over <= steps + 2 bucket rows (bounded; not data rows)
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cum = full.select(
        "k",
        F.sum("n_bad").over(upto).alias("cum_bad"), F.sum("n_good").over(upto).alias("cum_good"),
        F.sum("n_bad").over(every).alias("tot_bad"), F.sum("n_good").over(every).alias("tot_good"))
    return (cum.filter(F.col("k") <= steps)
               .select(F.col("k").alias("step"), _grid(F.col("k")).alias("crit"),
                       ((F.col("tot_bad") - F.col("cum_bad")).cast("double")
                        / F.col("tot_bad")).alias("FalsePositive"),
                       ((F.col("tot_good") - F.col("cum_good")).cast("double")
                        / F.col("tot_good")).alias("TruePositive")))


def roc_points(roc: DataFrame, points: Sequence[int] = ROC_POINTS) -> DataFrame:
    """Operating points picked by integer step (never by float equality)."""
    return roc.filter(F.col("step").isin(*points))


def classification_report(df: DataFrame, truth: str, pred: str, swapped: bool = False) -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy and averages.

    ``swapped=True`` passes (prediction, truth) as the source's call does, so
    precision and recall trade places.  Works from the <= k^2 confusion cells.
    """
    t, p = (pred, truth) if swapped else (truth, pred)
    cells = df.groupBy(F.col(t).alias("t"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    # a cell counts once for its true and once for its predicted class
    sides = cells.select("n", (F.col("t") == F.col("p")).alias("hit"), F.explode(F.array(
        F.struct(F.col("t").alias("c"), F.lit(True).alias("is_truth")),
        F.struct(F.col("p").alias("c"), F.lit(False).alias("is_truth")))).alias("side"))
    per = sides.groupBy("side.c").agg(*[F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias(name) for name, cond in (
        ("support", F.col("side.is_truth")), ("tp", F.col("side.is_truth") & F.col("hit")),
        ("predicted", ~F.col("side.is_truth")))])

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)

    per = per.select(
        F.col("c").cast("string").alias("class_label"),
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1_score"),
        F.col("support"), F.col("tp"))
    n = F.sum("support")
    acc = per.agg(F.lit("accuracy").alias("class_label"),
                  F.lit(None).cast("double").alias("precision"),
                  F.lit(None).cast("double").alias("recall"),
                  (F.sum("tp").cast("double") / n).alias("f1_score"), n.alias("support"))
    macro = per.agg(F.lit("macro avg").alias("class_label"),
                    F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                    F.avg("f1_score").alias("f1_score"), n.alias("support"))
    weighted = per.agg(
        F.lit("weighted avg").alias("class_label"),
        *[(F.sum(F.col(m) * F.col("support")) / n).alias(m)
          for m in ("precision", "recall", "f1_score")],
        n.alias("support"))
    return (per.drop("tp").unionByName(acc).unionByName(macro).unionByName(weighted))


# ---------------------------------------------------------------------------
# decisions on the pool
# ---------------------------------------------------------------------------

def high_confidence(df: DataFrame, score: str = "avg_score",
                    level: float = HIGH_CONFIDENCE) -> DataFrame:
    """One row: accounts at or above ``level`` and the rest."""
    s = F.col(score)
    return df.agg(F.count_if(s >= level).alias("n_best"), F.count_if(s < level).alias("n_others"))


def preapprove_cut(df: DataFrame, score: str = "avg_score",
                   q: float = PREAPPROVE_QUANTILE) -> float | None:
    """The ``q`` quantile of the pool scores (exact, interpolated)."""
    return exact_quantile(df, score, q)


def decide(df: DataFrame, score: str = "avg_score", approve: float = APPROVE_THRESHOLD,
           q: float = PREAPPROVE_QUANTILE, literal: bool = False,
           cut: float | None = None) -> DataFrame:
    """Pre-approve / approve / deny tiers.

    pre-approve: score >= the pool's ``q`` quantile; approve: score >=
    ``approve`` and below it; deny: below ``approve``.  If the quantile is
    itself below ``approve`` an account can meet both the first and the last
    rule: by default pre-approve wins (one ``tier`` column); ``literal=True``
    returns the three flags as the source's three filters compute them.
    """
    cut = preapprove_cut(df, score, q) if cut is None else cut
    s = F.col(score)
    pre = s >= F.lit(cut)
    ok = (s >= approve) & (s < F.lit(cut))
    deny = s < approve
    if literal:
        return df.select("*", pre.alias("pre_approve"), ok.alias("approve"), deny.alias("deny"))
    tier = F.when(pre, "pre_approve").when(s >= approve, "approve").otherwise("deny")
    return df.withColumn("tier", tier)


def preapprove_list(df: DataFrame, score: str = "avg_score", q: float = PREAPPROVE_QUANTILE,
                    key: str = "account_id") -> DataFrame:
    """Accounts scoring at or above the pool's ``q`` quantile."""
    cut = preapprove_cut(df, score, q)
    return df.filter(F.col(score) >= F.lit(cut)).select(key, score)


def tier_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("tier").agg(F.count(F.lit(1)).alias("n_accounts"))


# ---------------------------------------------------------------------------
# distributions
# ---------------------------------------------------------------------------

def _edges(lo: float, hi: float) -> tuple[float, float]:
    return (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)


def _bin_expr(x: Column, lo: Column, hi: Column, bins: Column) -> Column:
    """Equal-width bin of ``x`` on [lo, hi]; the last bin is closed."""
    step = (hi - lo) / bins

    def edge(j: Column) -> Column:
        return F.when(j == bins, hi).otherwise(j.cast("double") * step + lo)

    j = F.least(F.greatest(F.floor((x - lo) / (hi - lo) * bins.cast("double")), F.lit(0)), bins - 1)
    j = F.when(x < edge(j), j - 1).otherwise(j)
    j = F.when((j < bins - 1) & (x >= edge(j + 1)), j + 1).otherwise(j)
    return j


#: A histogram per group is a report: more groups than this raise.
MAX_HISTOGRAMS = 1_000


def histogram(df: DataFrame, col: str, bins: int = POOL_BINS,
              by: str | None = None, bins_by: dict | None = None) -> DataFrame:
    """Counts in equal-width bins over each group's [min, max].

    Rows: ``[by,] bin, bin_lo, bin_hi, count`` for every bin, empty ones
    included.  With ``by``, ``bins_by`` gives each group's bin count.
    """
    x = F.col(col).cast("double")
    keys = [by] if by else []
    ranges = df.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi")).limit(MAX_HISTOGRAMS + 1).collect()
    if len(ranges) > MAX_HISTOGRAMS:
        raise ValueError(f"more than {MAX_HISTOGRAMS} groups")
    spark = df.sparkSession
    rows = []
    for i, r in enumerate(ranges):
        if r["lo"] is not None:
            g = r[by] if by else None
            rows.append((i, g, *_edges(r["lo"], r["hi"]), (bins_by or {}).get(g, bins) if by else bins))
    kind = df.schema[by].dataType.simpleString() if by else "string"
    groups = spark.createDataFrame(rows, f"_i int, _g {kind}, _lo double, _hi double, _n long")
    valued = df.filter(x.isNotNull())
    if by:  # one pass for all groups; the group table has at most MAX_HISTOGRAMS rows
        valued = valued.join(F.broadcast(groups), df[by].eqNullSafe(F.col("_g")))
    else:
        i, _, lo, hi, n = rows[0] if rows else (0, None, 0.0, 1.0, 1)
        valued = valued.withColumns({"_i": F.lit(i), "_lo": F.lit(lo), "_hi": F.lit(hi), "_n": F.lit(n).cast("long")})
    counts = (valued.select("_i", _bin_expr(x, F.col("_lo"), F.col("_hi"), F.col("_n")).alias("bin"))
                    .groupBy("_i", "bin").agg(F.count(F.lit(1)).alias("count")))
    step = (F.col("_hi") - F.col("_lo")) / F.col("_n")
    grid = groups.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("bin"))
    edge_hi = F.when(F.col("bin") == F.col("_n") - 1, F.col("_hi")).otherwise(
        (F.col("bin") + 1).cast("double") * step + F.col("_lo"))
    return (grid.join(counts, ["_i", "bin"], "left").fillna(0, ["count"])
                .select(*([F.col("_g").alias(by)] if by else []), "bin",
                        (F.col("bin").cast("double") * step + F.col("_lo")).alias("bin_lo"),
                        edge_hi.alias("bin_hi"), "count"))


def class_profile(df: DataFrame, features: Sequence[str] = PROFILE_FEATURES,
                  label: str = "good_status_loan") -> DataFrame:
    """count, min, quartiles and max of each feature per class.

    Unpivot to ``(feature, label, value)``, one aggregate for count/min/max,
    and exact quartiles per (feature, class) by distributed refinement.
    """
    stack = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in features)
    long = df.select(F.col(label), F.expr(f"stack({len(features)}, {stack}) AS (feature, value)"))
    base = long.groupBy("feature", label).agg(
        F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"))
    qs = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["feature", label])

    def pick(p: float) -> Column:
        expr = F.lit(None).cast("double")
        for (f, y), vals in qs.items():
            match = (F.col("feature") == F.lit(f)) & (
                F.col(label).isNull() if y is None else (F.col(label) == F.lit(y)))
            expr = F.when(match, F.lit(vals[p])).otherwise(expr)
        return expr

    return base.select("feature", label, "n", "min", pick(0.25).alias("q25"),
                       pick(0.5).alias("q50"), pick(0.75).alias("q75"), "max")
