"""Quality rules: a learned decision list over text statistics (DataFrame functions only).

Sequential covering: a rule is a conjunction of threshold conditions.  Conditions are added while they raise the
information gain on the growing rows, then cut from the end while that raises precision on the pruning rows; a rule
that stays precise on both is kept, its rows are taken away, and the next rule is grown.  The list is emitted as one
ordered conditional expression, so applying it costs a projection.

At scale: statistics are a projection of each whole text (no shuffle); repeated windows are found inside the row by
sorting window hashes.  Rules are fitted on at most ``SAMPLE`` labelled rows (smallest key hashes); each step of the
search is one aggregate over binned values, of which the driver sees only counts per feature and bin.

Null text: no words, base failed.  Null ``doc_id``: kept in the result, never a training row.  Repeated rows: judged
row by row.  No usable labels: no rules, only the base decides.  Empty table: no rows.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SAMPLE, BINS, MAX_RULES, MAX_CONDITIONS = 20_000, 64, 12, 4
#: Least share of rejected labels among the rows of a rule, on growing and on pruning rows; least rows of a rule.
PRECISION, SUPPORT = 0.97, 5
WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbol_share", "bang_share", "upper_share", "mean_word", "dup_line_share", "repeat_share", "words")


class Condition(NamedTuple):
    feature: str
    threshold: float
    above: bool  # value >= threshold, else value < threshold

    def holds(self) -> Column:
        c = F.col(self.feature)
        return c >= self.threshold if self.above else c < self.threshold


Rule = tuple[Condition, ...]


def statistics(docs: DataFrame, window: int = 5) -> DataFrame:
    """The base counts and the features of every text; columns of ``docs`` with other names are kept."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    taken = [c for c in docs.columns if c.lower() not in {*COUNTS, *FEATURES, "base_failed", "kept", "_w", "_g", "_r",
                                                            "_lines"}]
    out = docs.select(*[F.col(f"`{c}`") for c in taken], F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"),
                      F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    n = F.size("_w")
    out = out.withColumn("_g", F.when(n >= window, F.transform(
        F.sequence(F.lit(1), F.greatest(n - (window - 1), F.lit(1))),
        lambda i: F.xxhash64(*[F.element_at("_w", i + j) for j in range(window)]))))
    # most texts repeat no window: only the others pay for the sort
    ranked = F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.array_sort(
        F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("_r", ranked)
    twice = F.sort_array(F.filter(F.transform("_r", lambda x, i: F.when(
        (x["h"] == F.get(F.col("_r"), i - 1)["h"]) | (x["h"] == F.get(F.col("_r"), i + 1)["h"]), x["i"])),
        lambda i: i.isNotNull()))
    out = out.withColumn("_r", F.when(F.col("_r").isNotNull(), twice))
    step = F.transform("_r", lambda p, i: F.least(F.lit(window), F.coalesce(F.get(F.col("_r"), i + 1) - p,
                                                                            F.lit(window))))
    repeats = F.when(F.col("_r").isNotNull(), F.aggregate(step, F.lit(0), lambda a, b: a + b)).otherwise(0)
    length = F.length(F.array_join("_w", ""))

    def only(chars: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")

    out = out.select(
        *[F.col(f"`{c}`") for c in taken], n.cast("long").alias("n_words"), length.cast("long").alias("word_chars"),
        only("#*$%&|<>").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"), F.size("_lines").alias("_lines"), only("!").alias("_bang"),
        only("A-Z").alias("_upper"))
    chars, words, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("word_chars", "n_words", "_lines"))
    out = out.withColumns({
        "symbol_share": F.col("n_symbols") / chars, "bang_share": F.col("_bang") / chars,
        "upper_share": F.col("_upper") / chars, "mean_word": F.col("word_chars") / words,
        "dup_line_share": F.col("n_dup_lines") / lines, "repeat_share": F.col("n_repeat_words") / words,
        "words": F.col("n_words").cast("double"),
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))})
    return out.drop("_lines", "_bang", "_upper")


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Statistics of at most ``sample`` labelled documents that pass the base: reject 0/1, grow 0/1."""
    chosen = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg((1 - F.min("quality")).cast("int").alias("reject"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = text.join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows
    # stored before it is filtered: a filter would be pushed down and repeat the statistics
    return stored(statistics(known).select(
        "reject", (F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(3)) > 0).cast("int").alias("grow"), "base_failed",
        *FEATURES), "quality-training").where(~F.col("base_failed"))


def thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Distinct quantiles of each feature, at most BINS each."""
    at = [k / BINS for k in range(1, BINS)]
    got = rows.select(*[F.percentile_approx(c, at, 10_000).alias(c) for c in FEATURES]).first()
    return {c: sorted({float(v) for v in got[c] or []}) for c in FEATURES}


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    if not p:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """(reject, keep) counts of each feature and bin: the only thing the driver sees of the rows."""
    def bin_of(c: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(v) for v in cuts[c]]).cast("array<double>"), lambda t: t <= F.col(c)))

    bins = F.array(*[bin_of(c) for c in FEATURES])
    got = (rows.select("reject", F.posexplode(bins).alias("f", "bin")).groupBy("f", "bin")
           .agg(F.sum("reject").alias("p"), F.sum(1 - F.col("reject")).alias("n")).collect())
    out = {c: [(0, 0)] * (len(cuts[c]) + 1) for c in FEATURES}
    for r in got:
        out[FEATURES[r["f"]]][r["bin"]] = (r["p"], r["n"])
    return out


def grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    rule: Rule = ()
    for _ in range(MAX_CONDITIONS):
        counts = _counts(rows, cuts)
        p0, n0 = (sum(v[i] for v in counts[FEATURES[0]]) for i in (0, 1))
        if not p0 or not n0:
            break
        best, found = 1e-9, None
        for c in FEATURES:
            p, n = p0, n0
            for k, t in enumerate(cuts[c]):  # rows in bins above k have value >= t
                p, n = p - counts[c][k][0], n - counts[c][k][1]
                for above, (a, b) in ((True, (p, n)), (False, (p0 - p, n0 - n))):
                    if (g := _gain(p0, n0, a, b)) > best:
                        best, found = g, Condition(c, t, above)
        if found is None:
            break
        rule, rows = (*rule, found), rows.where(found.holds())
    return rule


def prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The beginning of the rule that is most precise on the pruning rows, with its (reject, keep) counts."""
    sums, cond = [], F.lit(True)
    for k, c in enumerate(rule):
        cond = cond & c.holds()
        sums += [F.sum(F.when(cond, F.col("reject"))).alias(f"p{k}"), F.sum(F.when(cond, 1 - F.col("reject"))).alias(f"n{k}")]
    got = rows.agg(*sums).first()
    each = [(got[f"p{k}"] or 0, got[f"n{k}"] or 0) for k in range(len(rule))]
    k = max(range(len(rule)), key=lambda k: ((each[k][0] - each[k][1]) / max(1, sum(each[k])), sum(each[k]), -k))
    return rule[:k + 1], *each[k]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    rows = training_rows(docs, labels, sample)
    cuts, rules = thresholds(rows), []
    while len(rules) < MAX_RULES:
        rule = grow(rows.where("grow = 1"), cuts)
        if not rule:
            break
        rule, p, n = prune(rows.where("grow = 0"), rule)
        cond = matches(rule)
        got = rows.where(cond).agg(F.sum("reject").alias("p"), F.count("*").alias("n")).first()
        if (p + n and p < PRECISION * (p + n)) or (got["p"] or 0) < max(SUPPORT, PRECISION * got["n"]):
            break
        rules.append(rule)
        rows = rows.where(~cond)
    return rules


def matches(rule: Rule) -> Column:
    cond = F.lit(True)
    for c in rule:
        cond = cond & c.holds()
    return cond


def verdict(rules: list[Rule]) -> Column:
    """The decision list: the first rule that holds rejects, a document that meets none stays."""
    out = F.when(F.col("base_failed"), False)
    for rule in rules:
        out = out.when(matches(rule), False)
    return out.otherwise(True)


def keep(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The columns and rows of ``docs`` that are kept; no copy of the texts is stored for it.

    The verdict passes through a generator: a filter on what it makes is not pushed below it, so that the statistics are
    computed once and not anew in the filter."""
    flag = "_kept_" + "_".join(docs.columns)  # no column of the input has this name
    judged = statistics(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text"))
    judged = judged.select("_row", verdict(learn(docs, labels, sample)).alias(flag))
    return judged.select("_row", F.explode_outer(F.array(flag)).alias(flag)).where(F.col(flag)).select("_row.*")


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """All columns of ``docs`` with the counts, ``base_failed`` and ``kept``."""
    return statistics(docs).withColumn("kept", verdict(learn(docs, labels, sample))).drop(*FEATURES)
