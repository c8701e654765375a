"""Feature preparation: dummies, casts, labelled/pool split, train/test split,
oversampling and class weights.

Splits and resampling are driven by hashes of the row key and a seed, never
by ``rand()``: results are identical however the data is partitioned and
whichever executor recomputes a lost partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lendscope.functions.casts import fill_cast

# ---------------------------------------------------------------------------
# The model's feature list, and the column lists of the
# null-fill / cast plan, as the source defines them.
# ---------------------------------------------------------------------------
FEATURE_COLUMNS = [
    "n_orders", "avg_orders_amount",
    "std_orders_amount", "n_orders_housing", "avg_orders_housing",
    "std_orders_housing", "n_orders_insur", "avg_orders_insur",
    "std_orders_insur", "n_orders_leas", "avg_orders_leas",
    "std_orders_leas", "n_trans", "n_credit_trans", "sum_credit_trans",
    "avg_credit_trans", "std_credit_trans", "n_withdrawl_trans",
    "sum_withdrawl_trans", "avg_withdrawl_trans", "std_withdrawl_trans",
    "n_cash_deposit", "n_bank_collection", "n_cash_withdrawl",
    "n_bank_remit", "n_card_withdrawl", "total_credits_amount",
    "total_withdrawls_amount", "avg_balance", "std_balance", "min_balance",
    "max_balance", "n_neg_balance", "n_cards", "n_cards_gold",
    "n_cards_classic", "n_cards_junior", "days_with_bank", "age_at_loan",
    "freq_dep_acc_monthly", "freq_dep_acc_weekly",
]
INT_FILL_COLUMNS = [
    "n_orders_housing", "n_orders_loan", "n_orders_insur", "n_orders_leas",
    "n_credit_trans", "n_withdrawl_trans", "n_cash_deposit", "n_bank_collection",
    "n_cash_withdrawl", "n_bank_remit", "n_card_withdrawl", "n_neg_balance",
    "current_loan", "good_status_loan",
]
FLOAT_COLUMNS = [
    "avg_orders_leas", "std_orders_leas", "sum_credit_trans",
    "avg_credit_trans", "sum_withdrawl_trans", "avg_withdrawl_trans",
    "total_credits_amount", "total_withdrawls_amount", "min_balance",
    "max_balance", "n_cards_gold", "n_cards_classic", "n_cards_junior",
]
DUMMY_COLUMNS = ["freq_dep_acc", "sex_client", "user_sex"]
LABEL = "good_status_loan"
KEY = "account_id"
MAX_LEVELS = 1000


def levels_of(df: DataFrame, col: str, max_levels: int = MAX_LEVELS) -> list:
    """Sorted distinct non-NULL values of a categorical column (bounded)."""
    rows = (df.select(col).filter(F.col(col).isNotNull()).distinct()
              .limit(max_levels + 1).collect())
    if len(rows) > max_levels:
        raise ValueError(f"{col}: more than {max_levels} levels")
    return sorted(r[0] for r in rows)


def levels_of_many(df: DataFrame, cols: Sequence[str],
                   max_levels: int = MAX_LEVELS) -> dict[str, list]:
    """Sorted distinct non-NULL values of several columns in one pass."""
    if not cols:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"))
                                for c in cols]))
    rows = (df.select(pairs.alias("p")).select("p.c", "p.v").filter(F.col("v").isNotNull())
              .distinct().limit(max_levels * len(cols) + 1).collect())
    out: dict[str, list] = {c: [] for c in cols}
    for r in rows:
        out[r["c"]].append(r["v"])
    for c, lv in out.items():
        if len(lv) > max_levels:
            raise ValueError(f"{c}: more than {max_levels} levels")
        out[c] = sorted(lv)
    return out


def get_dummies(df: DataFrame, cols: Sequence[str] = DUMMY_COLUMNS,
                levels: dict[str, list] | None = None, drop_first: bool = True) -> DataFrame:
    """0/1 indicator columns ``{col}_{level}`` replacing each column.

    Levels are sorted; with ``drop_first`` the smallest is left out.  A NULL
    gives 0 in every indicator.  Indicators are appended after the remaining
    columns.  Pass ``levels`` to reuse the encoding of a training frame;
    missing ones are found in one distinct pass over all columns.
    """
    levels = dict(levels or {})
    missing = [c for c in cols if c not in levels]
    levels.update(levels_of_many(df, missing))
    keep = [F.col(c) for c in df.columns if c not in cols]
    dummies = []
    for c in cols:
        lv = levels[c]
        if lv is None:
            lv = levels_of(df, c)
        for level in (lv[1:] if drop_first else lv):
            dummies.append(F.when(F.col(c).cast("string") == F.lit(level), 1).otherwise(0)
                           .alias(f"{c}_{level}"))
    return df.select(*keep, *dummies)


def prepare_mart(mart: DataFrame, levels: dict[str, list] | None = None) -> DataFrame:
    """Dummies, then the null-fill / cast plan of the source."""
    d = get_dummies(mart, DUMMY_COLUMNS, levels)
    return fill_cast(d, [c for c in INT_FILL_COLUMNS if c in d.columns],
                     [c for c in FLOAT_COLUMNS if c in d.columns])


def split_labelled(df: DataFrame, key: str = "loan_id") -> tuple[DataFrame, DataFrame]:
    """(rows with ``key`` set, rows without): train/test data and the pool."""
    return df.filter(F.col(key).isNotNull()), df.filter(F.col(key).isNull())


def select_features(df: DataFrame, cols: Sequence[str] = FEATURE_COLUMNS,
                    keep: Sequence[str] = (KEY,), fill: float | None = 0.0) -> DataFrame:
    """Key columns plus the feature list as doubles, NULLs filled."""
    out = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return out.fillna(fill, subset=list(cols)) if fill is not None else out


def hash_prefix(key: Column, seed: int) -> Column:
    """First 8 hex digits of ``md5(key '#' seed)``: a uniform 32-bit draw."""
    return F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}"))), 1, 8)


def hash_fraction(key: Column, seed: int) -> Column:
    """The draw of :func:`hash_prefix` as a double in [0, 1)."""
    return F.conv(hash_prefix(key, seed), 16, 10).cast("double") / F.lit(float(2 ** 32))


def _threshold(fraction: float) -> str:
    return format(min(int(fraction * 2 ** 32), 2 ** 32 - 1), "08x")


def train_test_split(df: DataFrame, key: str = KEY, test_fraction: float = 0.25,
                     seed: int = 1, flag: str = "is_test") -> DataFrame:
    """Add a boolean ``flag``: the row's key hash falls in the test share.

    Narrow (no shuffle), deterministic and stable under repartitioning.
    """
    return df.withColumn(flag, hash_prefix(F.col(key), seed) < F.lit(_threshold(test_fraction)))


def class_counts(df: DataFrame, label: str = LABEL) -> dict:
    """Rows per class (one small aggregate; classes are few)."""
    rows = df.groupBy(label).count().limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        raise ValueError("too many classes")
    return {r[label]: r["count"] for r in rows}


def ranked_in_class(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Add ``_rank``: 0, 1, 2, ... within the class by ``md5(key '#' seed)``, then key.

    No class is sorted in one task: rows are numbered inside 4096 hash ranges,
    and a running sum over the ranges' counts (a bounded table) gives each
    range its offset.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))
    rows = df.withColumn("_h", h).withColumn("_range", F.substring("_h", 1, 3))
    counts = rows.groupBy(label, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # at most 4096 rows per class, and at most MAX_LEVELS classes
    offsets = counts.select(label, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(label, "_range").orderBy("_h", key)
    return (rows.withColumn("_k", F.row_number().over(own)).join(F.broadcast(offsets), [label, "_range"])
            .withColumn("_rank", F.col("_before") + F.col("_k") - 1).drop("_h", "_range", "_before", "_k"))


def drawn_ranks(spark: SparkSession, counts: dict, label: str, seed: int) -> DataFrame:
    """``(label, _rank, _times)``: draws with replacement up to the largest class.

    Draw number i of class c is row ``md5(i '#' c '#' seed) mod n_c`` (first 8
    hex digits), so the draws depend on neither partitions nor executors.
    """
    top, parts = max(counts.values()), []
    for c, n in counts.items():
        h = F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"#{c}#{seed}"))), 1, 8)
        draws = spark.range(top - n).select((F.conv(h, 16, 10).cast("long") % F.lit(n)).alias("_rank"))
        parts.append(draws.groupBy("_rank").agg(F.count(F.lit(1)).alias("_times")).withColumn(label, F.lit(c)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def copies_of(df: DataFrame, label: str = LABEL, key: str = KEY, seed: int = 0,
              mode: str = "ratio") -> tuple[DataFrame, Column]:
    """The rows that :func:`oversample` repeats, and how often; in mode ``ratio`` these rows are ``df`` itself."""
    counts = class_counts(df, label)
    top = max(counts.values(), default=0)
    if mode not in ("ratio", "exact", "random"):
        raise ValueError(f"unknown oversampling mode {mode!r}")
    if not counts:
        return df, F.lit(1)
    if mode == "ratio":
        copies = F.lit(1)
        draw = hash_fraction(F.col(key), seed)
        for c, n in counts.items():
            k, rem = divmod(top, n)
            times = F.lit(k) + (F.when(draw < F.lit(rem / n), 1).otherwise(0) if rem else F.lit(0))
            copies = F.when(F.col(label) == F.lit(c), times).otherwise(copies)
        return df, copies
    out = ranked_in_class(df, label, key, seed)
    if mode == "exact":
        copies = F.lit(1)
        for c, n in counts.items():
            k, rem = divmod(top, n)
            copies = F.when(F.col(label) == F.lit(c), F.lit(k) + F.when(F.col("_rank") < rem, 1).otherwise(0)
                            ).otherwise(copies)
    else:
        out = out.join(drawn_ranks(df.sparkSession, counts, label, seed), [label, "_rank"], "left")
        copies = (1 + F.coalesce("_times", F.lit(0))).cast("int")
    return out, copies


def repeated(rows: DataFrame, copies: Column, cols: Sequence[str]) -> DataFrame:
    """Every row as often as ``copies`` says."""
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).select(*cols)


def oversample(df: DataFrame, label: str = LABEL, key: str = KEY, seed: int = 0,
               mode: str = "ratio") -> DataFrame:
    """Random oversampling of the smaller classes up to the largest one.

    ``ratio``  every row of class c is repeated ``floor(r)`` times plus once
               more when its hash draw is below ``frac(r)``, r = max/n_c: no
               shuffle, deterministic, class sizes equal in expectation.
    ``exact``  ``floor(r)`` copies of every row plus one of the rows that come
               first by hash: class sizes exactly equal.
    ``random`` every row once plus ``max - n_c`` hashed draws with
               replacement: class sizes exactly equal.

    All three depend on key and seed only, never on the partitioning.
    """
    rows, copies = copies_of(df, label, key, seed, mode)
    return repeated(rows, copies, df.columns)


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced class weights ``n / (k * n_c)``: one row per class.

    The total and the class count are two scalars from one small aggregate;
    the table itself is the per-class aggregate (no join).
    """
    counts = class_counts(df, label)
    total, k = sum(counts.values()), len(counts)
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    return per.select(label, "n_class",
                      (F.lit(float(total)) / (F.lit(k) * F.col("n_class"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str = LABEL, weight: str = "weight") -> DataFrame:
    """Attach each row's balanced class weight as a CASE expression (no join)."""
    counts = class_counts(df, label)
    total, k = sum(counts.values()), len(counts)
    expr = F.lit(None).cast("double")
    for c, n in counts.items():
        expr = F.when(F.col(label) == F.lit(c), F.lit(total / (k * n))).otherwise(expr)
    return df.withColumn(weight, expr)
