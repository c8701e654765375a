"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads the test tables (through the stand-ins) and runs the
library's operators over them whole.  Population deviations are rounded to
4 decimals so both engines' last-bit differences cannot show.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.operators.daystates import asof_rollup, txn_rollup_both
from lendscope.operators.rollup import balance_stats, card_rollup, rollup_by_category, txn_rollup
from lendscope.plans.mart import cards_before_loan_linked, link_cards, trans_before_loan
from lendscope.sources import standins as S

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "mart_cutoff"


def finish(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round population-deviation columns (``std_*``) for comparison."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if c.startswith(("std_", "cut_std_")) else F.col(c)
                       for c in df.columns])


def _trans_before(spark, d):
    return trans_before_loan(_tables(spark, d))


def q_cutoff_txn(spark, d):
    return _trans_before(spark, d)


def q_txn_rollup(spark, d):
    return finish(txn_rollup(_tables(spark, d).trans))


def q_cutoff_txn_rollup(spark, d):
    return finish(txn_rollup(_trans_before(spark, d)))


def q_txn_rollup_both(spark, d):
    t = _tables(spark, d)
    return finish(txn_rollup_both(t.trans, t.loans))


def q_asof_loan_rollup(spark, d):
    return finish(asof_rollup(_tables(spark, d).trans, S.standin_every_loan(spark, d)))


def q_symbol_rollup(spark, d):
    return finish(rollup_by_category(_tables(spark, d).orders))


def q_balance_stats(spark, d):
    return finish(balance_stats(_tables(spark, d).trans))


def q_balance_stats_text(spark, d):
    return finish(balance_stats(_tables(spark, d).trans, literal=True))


def _linked_cards(spark, d):
    return link_cards(_tables(spark, d).cards, _tables(spark, d).card_links)


def q_card_rollup(spark, d):
    return card_rollup(_linked_cards(spark, d))


def q_card_rollup_by_type(spark, d):
    return card_rollup(_linked_cards(spark, d), per_type=True)


def _cards_before(spark, d):
    t = _tables(spark, d)
    return cards_before_loan_linked(t.cards, t.card_links, t.loans)


def q_cutoff_card(spark, d):
    return _cards_before(spark, d)


def q_cutoff_card_rollup(spark, d):
    return card_rollup(_cards_before(spark, d))


def _rollup_queries() -> dict[str, Query]:
    return {
        "cutoff_txn": q_cutoff_txn,
        "txn_rollup": q_txn_rollup,
        "cutoff_txn_rollup": q_cutoff_txn_rollup,
        "txn_rollup_both": q_txn_rollup_both,
        "asof_loan_rollup": q_asof_loan_rollup,
        "symbol_rollup": q_symbol_rollup,
        "balance_stats": q_balance_stats,
        "balance_stats_text": q_balance_stats_text,
        "card_rollup": q_card_rollup,
        "card_rollup_by_type": q_card_rollup_by_type,
        "cutoff_card": q_cutoff_card,
        "cutoff_card_rollup": q_cutoff_card_rollup,
    }


# ---------------------------------------------------------------------------
# load, recode and entity queries
# ---------------------------------------------------------------------------

from lendscope.functions.birth import birth_number_from_date, decode_birth  # noqa: E402
from lendscope.functions.casts import conform  # noqa: E402
from lendscope.functions.dates import format_yymmdd, parse_yymmdd, parse_yymmdd_time  # noqa: E402
from lendscope.functions.recode import (FREQUENCY_CODES, OPERATION_CODES,  # noqa: E402
                                        TRANS_SYMBOL_CODES, TRANS_TYPE_CODES, recode, recode_disp_type,
                                        strip_account_zeros, strip_chars)
from lendscope.operators.audit import match_audit  # noqa: E402
from lendscope.operators.dedup import dedup_first  # noqa: E402
from lendscope.operators.entities import link_clients, pair_roles, role_filter  # noqa: E402
from lendscope.plans import mart as M  # noqa: E402
from lendscope.sources.bucketed import load_bucketed, mart_bucketed, save_bucketed  # noqa: E402
from lendscope.sources.marts import load_mart, profile, save  # noqa: E402
from lendscope.session import scratch_path  # noqa: E402


def q_birth_parse(spark, d):
    return _tables(spark, d).clients


def _client_disp(spark, d):
    return link_clients(_tables(spark, d).disp, _tables(spark, d).clients)


def q_link_clients(spark, d):
    return _client_disp(spark, d)


def q_role_filter(spark, d):
    return role_filter(_client_disp(spark, d), "USER")


def q_owner_user_pair(spark, d):
    return pair_roles(_client_disp(spark, d))


def q_owner_user_pair_literal(spark, d):
    return pair_roles(_client_disp(spark, d), literal=True)


def q_dedup_first(spark, d):
    li = S.read_table(spark, d, "lineitem")
    return dedup_first(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])


def q_status_flags(spark, d):
    return _tables(spark, d).loans.select("loan_id", "status_", "current", "good_status")


def q_load_time_date(spark, d):
    o = S.read_table(spark, d, "orders", "o_orderkey", "o_orderdate")
    raw = o.select("o_orderkey", format_yymmdd("o_orderdate").alias("date"))
    return raw.select("o_orderkey", parse_yymmdd("date").alias("date_"))


def q_card_issue_date(spark, d):
    li = S.read_table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate")
    raw = li.select("l_orderkey", "l_linenumber",
                    F.date_format("l_shipdate", "yyMMdd HH:mm:ss").alias("issued"))
    return raw.select("l_orderkey", "l_linenumber", parse_yymmdd_time("issued").alias("issued"))


def q_conform_lenient(spark, d):
    p = S.read_table(spark, d, "part", "p_partkey", "p_size", "p_type", "p_retailprice")
    raw = p.select(F.col("p_partkey").cast("string"), F.col("p_size").cast("string").alias("size"),
                   F.col("p_type").alias("kind"),
                   F.col("p_retailprice").cast("string").alias("price"),
                   F.col("p_retailprice").cast("string").alias("price_int"))
    return conform(raw, {"p_partkey": "bigint", "size": "int", "kind": "int",
                         "price": "decimal(10,2)", "price_int": "int"})


def q_conform_large_ids(spark, d):
    """Ids beyond 2^53, some beyond a long, as text."""
    o = S.read_table(spark, d, "orders", "o_orderkey")
    pad = F.lpad(F.col("o_orderkey").cast("string"), 17, "0")
    raw = o.select(F.col("o_orderkey").cast("string").alias("o_orderkey"),
                   F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("987"), pad))
                   .otherwise(F.concat(F.lit("9"), pad)).alias("big_id"))
    return conform(raw, {"o_orderkey": "bigint", "big_id": "bigint"})


def q_conform_bad_numbers(spark, d):
    """Out of range, not a number, words, empty and rounded integers."""
    o = S.read_table(spark, d, "orders", "o_orderkey", "o_totalprice")
    k = F.col("o_orderkey") % 5
    raw = o.select(F.col("o_orderkey").cast("string").alias("o_orderkey"),
                   F.when(k == 0, "99999999999").when(k == 1, "NaN").when(k == 2, "x1").when(k == 3, "")
                   .otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(".6"))).alias("n"))
    return conform(raw, {"o_orderkey": "bigint", "n": "int"})


def q_conform_float32(spark, d):
    """Order totals as text, kept in single precision; every seventh is no number."""
    o = S.read_table(spark, d, "orders", "o_orderkey", "o_totalprice")
    text = F.col("o_totalprice").cast("decimal(15,2)").cast("string")
    raw = o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(text).alias("amount"))
    return conform(raw, {"amount": "float32"})


def q_conform_char(spark, d):
    """Text cut to the lengths of the source's fixed and variable character types."""
    o = S.read_table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus")
    raw = o.select("o_orderkey", F.col("o_orderpriority").alias("fixed"),
                   F.concat("o_orderstatus", F.lit("      ")).alias("padded"), F.col("o_orderpriority").alias("varying"))
    return conform(raw, {"fixed": "char(8)", "padded": "char(3)", "varying": "varchar(5)"})


def q_birth_parse_bad(spark, d):
    """Birth numbers of all orders, every third one empty or malformed."""
    o = S.read_table(spark, d, "orders", "o_orderkey", "o_orderdate")
    good = birth_number_from_date(F.col("o_orderdate"), F.col("o_orderkey") % 2 == 0)
    k = F.col("o_orderkey") % 6
    raw = o.select("o_orderkey", F.when(k == 0, "").when(k == 3, "70ab13").otherwise(good).alias("birth_number"))
    return decode_birth(raw)


def q_recode_trans_symbol(spark, d):
    """Transaction symbols: shipping modes play the codes."""
    li = S.read_table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    codes = [*TRANS_SYMBOL_CODES, " "]
    code = F.element_at(F.array(*[F.lit(c) for c in codes]), (F.col("l_partkey") % len(codes) + 1).cast("int"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", recode(code, TRANS_SYMBOL_CODES).alias("k_symbol"),
                     recode(F.concat(F.lit('"'), code, F.lit('"')), TRANS_SYMBOL_CODES, literal=True).alias("literal"))


def q_account_zeros(spark, d):
    """Counterparty accounts, both modes; every fourth has none (``0``)."""
    o = S.read_table(spark, d, "orders", "o_orderkey", "o_custkey")
    a = F.when(F.col("o_orderkey") % 4 == 0, "0").otherwise(F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", strip_account_zeros(F.concat(a, F.lit("\r"))).alias("account_"),
                    strip_account_zeros(a, literal=True).alias("account_literal"))


def q_strip_chars(spark, d):
    c = S.read_table(spark, d, "customer", "c_custkey", "c_mktsegment")
    raw = c.select("c_custkey", F.concat(F.lit('"'), "c_mktsegment", F.lit('"\r')).alias("s"))
    return raw.select("c_custkey", strip_chars("s").alias("segment"))


def q_recode_3(spark, d):
    r = S.raw_accounts(spark, d)
    return r.select(F.col("account_id").cast("bigint"),
                    recode("frequency", FREQUENCY_CODES).alias("frequency"))


def q_recode_literal(spark, d):
    r = S.raw_accounts(spark, d)
    quoted = F.concat(F.lit('"'), F.col("frequency"), F.lit('"'))
    return r.select(F.col("account_id").cast("bigint"),
                    recode(quoted, FREQUENCY_CODES, literal=True).alias("frequency"))


def q_recode_many(spark, d):
    r = S.raw_trans(spark, d)
    return r.select(F.col("trans_id").cast("bigint"), F.col("account_id").cast("bigint"),
                    recode("type", TRANS_TYPE_CODES).alias("type_"),
                    recode("operation", OPERATION_CODES).alias("operation"))


def q_recode_disp_type(spark, d):
    r = S.raw_disp(spark, d)
    raw = F.concat(F.lit('"'), F.col("type"), F.lit('"\r'))
    return r.select(F.col("disp_id").cast("bigint"), recode_disp_type(raw).alias("type_"))


def _tables(spark, d):
    return S.standin_tables(spark, d)


def q_mart_loans(spark, d):
    return finish(M.mart_loans(_tables(spark, d)))


def q_mart_accounts(spark, d):
    return finish(M.mart_accounts(_tables(spark, d)))


def q_mart_cutoff(spark, d):
    return finish(M.mart_cutoff(_tables(spark, d)))


def q_mart_accounts_literal(spark, d):
    return finish(M.mart_accounts(_tables(spark, d), literal=True))


def q_mart_loans_literal(spark, d):
    return finish(M.mart_loans(_tables(spark, d), literal=True))


def q_mart_bucketed(spark, d):
    """The cutoff mart over tables written bucketed by account."""
    name = f"lendscope_{uuid.uuid4().hex[:12]}"
    save_bucketed(_tables(spark, d), scratch_path(spark, "bucketed"), name, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return finish(mart_bucketed(load_bucketed(spark, name)))


def q_mart_sorted(spark, d):
    return q_mart_cutoff(spark, d).orderBy("account_id")


def q_mart_head(spark, d):
    return q_mart_cutoff(spark, d).orderBy("account_id").limit(5)


def q_mart_roundtrip(spark, d):
    path = scratch_path(spark, "mart_cutoff")
    save(q_mart_cutoff(spark, d), path)
    return load_mart(spark, path)


def q_mart_shape(spark, d):
    return profile(q_mart_cutoff(spark, d))


def q_district_match(spark, d):
    t = _tables(spark, d)
    return match_audit(t.accounts, M.client_account(t), "account_id", "district_id",
                       "client_district_id")


def q_tenure_age(spark, d):
    t = _tables(spark, d)
    return M.tenure_age(t)


def q_tenure_age_pool(spark, d):
    return M.tenure_age(_tables(spark, d), pool_date="1999-01-01")


def _entity_queries() -> dict[str, Query]:
    return {
        "birth_parse": q_birth_parse,
        "link_clients": q_link_clients,
        "role_filter": q_role_filter,
        "owner_user_pair": q_owner_user_pair,
        "owner_user_pair_literal": q_owner_user_pair_literal,
        "dedup_first": q_dedup_first,
        "status_flags": q_status_flags,
        "load_time_date": q_load_time_date,
        "card_issue_date": q_card_issue_date,
        "conform_lenient": q_conform_lenient,
        "conform_large_ids": q_conform_large_ids,
        "conform_bad_numbers": q_conform_bad_numbers,
        "conform_float32": q_conform_float32,
        "conform_char": q_conform_char,
        "birth_parse_bad": q_birth_parse_bad,
        "recode_trans_symbol": q_recode_trans_symbol,
        "account_zeros": q_account_zeros,
        "strip_chars": q_strip_chars,
        "recode_3": q_recode_3,
        "recode_literal": q_recode_literal,
        "recode_many": q_recode_many,
        "recode_disp_type": q_recode_disp_type,
        "mart_loans": q_mart_loans,
        "mart_accounts": q_mart_accounts,
        "mart_cutoff": q_mart_cutoff,
        "mart_accounts_literal": q_mart_accounts_literal,
        "mart_loans_literal": q_mart_loans_literal,
        "mart_bucketed": q_mart_bucketed,
        "mart_sorted": q_mart_sorted,
        "mart_head": q_mart_head,
        "mart_roundtrip": q_mart_roundtrip,
        "mart_shape": q_mart_shape,
        "district_match": q_district_match,
        "tenure_age": q_tenure_age,
        "tenure_age_pool": q_tenure_age_pool,
    }


# ---------------------------------------------------------------------------
# feature preparation and decisions
# ---------------------------------------------------------------------------

from lendscope.functions.casts import fill_cast as _fill_cast  # noqa: E402
from lendscope.plans import decide as D  # noqa: E402
from lendscope.plans import prep as P  # noqa: E402


def _mart(spark, d):
    return q_mart_cutoff(spark, d)


def _labelled_split(spark, d):
    prepared = P.prepare_mart(_mart(spark, d))
    labelled, _ = P.split_labelled(prepared)
    return P.train_test_split(labelled, "account_id", 0.25, seed=1)


def _train(spark, d):
    return (_labelled_split(spark, d).filter(~F.col("is_test"))
            .select("account_id", "good_status_loan"))


def q_split_labelled(spark, d):
    return _mart(spark, d).select("account_id", F.col("loan_id").isNotNull().alias("labelled"))


def q_get_dummies(spark, d):
    m = _mart(spark, d)
    return P.get_dummies(m).select("account_id", "freq_dep_acc_monthly", "freq_dep_acc_weekly",
                                   "sex_client_M", "user_sex_M")


def q_fill_cast(spark, d):
    return _fill_cast(_mart(spark, d), P.INT_FILL_COLUMNS, P.FLOAT_COLUMNS).select(
        "account_id", *P.INT_FILL_COLUMNS, *P.FLOAT_COLUMNS)


def q_feature_select(spark, d):
    return P.select_features(P.prepare_mart(_mart(spark, d)))


def q_train_test_split(spark, d):
    return _labelled_split(spark, d).select("account_id", "is_test")


def q_oversample_ratio(spark, d):
    return P.oversample(_train(spark, d), "good_status_loan", "account_id", seed=0, mode="ratio")


def q_oversample_exact(spark, d):
    return P.oversample(_train(spark, d), "good_status_loan", "account_id", seed=0, mode="exact")


def q_oversample_random(spark, d):
    return P.oversample(_train(spark, d), "good_status_loan", "account_id", seed=0, mode="random")


def q_predict_inverted(spark, d):
    return D.predict(_scores(spark, d), "avg_score", D.PREDICT_THRESHOLD, "y_hat",
                     inverted=True).select("account_id", "avg_score", "y_hat")


def q_class_weights(spark, d):
    return P.class_weights(_train(spark, d), "good_status_loan")


SCORE_COLS = ["score_0", "score_1", "score_2"]


def _scores(spark, d):
    return D.average_scores(S.standin_scores(spark, d), SCORE_COLS)


def _labels(spark, d):
    o = S.read_table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return (o.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
             .select(F.col("o_orderkey").alias("account_id"),
                     F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
                     .alias("good_status_loan")))


def q_average_scores(spark, d):
    return _scores(spark, d).select("account_id", *SCORE_COLS, "avg_score")


def q_average_scores_literal(spark, d):
    return D.average_scores(S.standin_scores(spark, d), SCORE_COLS, drop_first=True).select(
        "account_id", *SCORE_COLS, "avg_score")


def q_score_pivot(spark, d):
    s = S.standin_scores(spark, d)
    stack = ", ".join(f"{i}, {c}" for i, c in enumerate(SCORE_COLS))
    long = s.select("account_id", F.expr(f"stack({len(SCORE_COLS)}, {stack}) AS (rep, score)"))
    return D.score_table(long, "account_id", "rep", "score", n_reps=len(SCORE_COLS))


def q_score_label_join(spark, d):
    return D.score_label_join(_scores(spark, d).select("account_id", "avg_score"),
                              _labels(spark, d), "account_id", "inner")


def q_score_label_left(spark, d):
    return D.score_label_join(_scores(spark, d).select("account_id", "avg_score"),
                              _labels(spark, d), "account_id", "left")


def q_threshold_confusion(spark, d):
    return D.confusion(_scores(spark, d))


def q_roc_table(spark, d):
    return D.roc_table(_scores(spark, d))


def q_roc_points(spark, d):
    return D.roc_points(D.roc_table(_scores(spark, d)))


def q_classification_report(spark, d):
    s = D.predict(_scores(spark, d), "avg_score", 0.5, "y_hat")
    return D.classification_report(s, "good_status_loan", "y_hat")


def q_classification_report_swapped(spark, d):
    s = D.predict(_scores(spark, d), "avg_score", 0.5, "y_hat")
    return D.classification_report(s, "good_status_loan", "y_hat", swapped=True)


def q_score_quantile(spark, d):
    s = _scores(spark, d)
    cut = D.preapprove_cut(s)
    return s.agg(F.count("avg_score").alias("n_scores")).select(
        F.round(F.lit(cut).cast("double"), 9).alias("q95"), "n_scores")


def q_high_confidence(spark, d):
    return D.high_confidence(_scores(spark, d))


def q_preapprove_list(spark, d):
    return D.preapprove_list(_scores(spark, d))


def q_decision_tiers(spark, d):
    return D.decide(_scores(spark, d)).select("account_id", "avg_score", "tier")


def q_decision_tiers_literal(spark, d):
    return D.decide(_scores(spark, d), literal=True)


def q_tier_counts(spark, d):
    return D.tier_counts(D.decide(_scores(spark, d)))


def q_score_histogram(spark, d):
    return D.histogram(_scores(spark, d), "avg_score", D.POOL_BINS)


def q_tier_histogram(spark, d):
    decided = D.decide(_scores(spark, d))
    return D.histogram(decided, "avg_score", by="tier", bins_by=D.TIER_BINS)


def q_class_profile(spark, d):
    labelled, _ = P.split_labelled(_mart(spark, d))
    prof = D.class_profile(labelled)
    return prof.select(*[F.round(c, 6).alias(c) if c in ("q25", "q50", "q75") else F.col(c)
                         for c in prof.columns])


def _decision_queries() -> dict[str, Query]:
    return {
        "split_labelled": q_split_labelled,
        "get_dummies": q_get_dummies,
        "fill_cast": q_fill_cast,
        "feature_select": q_feature_select,
        "train_test_split": q_train_test_split,
        "oversample_ratio": q_oversample_ratio,
        "class_weights": q_class_weights,
        "oversample_exact": q_oversample_exact,
        "oversample_random": q_oversample_random,
        "predict_inverted": q_predict_inverted,
        "average_scores": q_average_scores,
        "average_scores_literal": q_average_scores_literal,
        "score_pivot": q_score_pivot,
        "score_label_join": q_score_label_join,
        "score_label_left": q_score_label_left,
        "threshold_confusion": q_threshold_confusion,
        "roc_table": q_roc_table,
        "roc_points": q_roc_points,
        "classification_report": q_classification_report,
        "classification_report_swapped": q_classification_report_swapped,
        "score_quantile": q_score_quantile,
        "high_confidence": q_high_confidence,
        "preapprove_list": q_preapprove_list,
        "decision_tiers": q_decision_tiers,
        "decision_tiers_literal": q_decision_tiers_literal,
        "tier_counts": q_tier_counts,
        "score_histogram": q_score_histogram,
        "tier_histogram": q_tier_histogram,
        "class_profile": q_class_profile,
    }


# ---------------------------------------------------------------------------
# models (no SQL equivalent: checked by row counts and by unit tests)
# ---------------------------------------------------------------------------

from pyspark.ml.functions import vector_to_array  # noqa: E402

from lendscope.plans import model as ML  # noqa: E402
from lendscope.session import checkpoint_dir, cut_lineage  # noqa: E402


def _model_frames(spark, d):
    """(train, test, pool) assembled frames from the cutoff mart, checkpointed."""
    prepared = P.prepare_mart(M.mart_cutoff(_tables(spark, d)))
    labelled, pool = P.split_labelled(prepared)
    split = P.train_test_split(P.select_features(labelled, keep=("account_id", "good_status_loan")),
                               "account_id", 0.25, seed=1)
    train = cut_lineage(ML.assemble(split.filter(~F.col("is_test"))))
    test = ML.assemble(split.filter(F.col("is_test")))
    pool_x = ML.assemble(P.select_features(pool), label=None)
    return train, test, pool_x


def _forest_report(model, test):
    return D.classification_report(model.transform(test).select("label", "prediction"), "label", "prediction", swapped=False)


def q_forest_benchmark(spark, d):
    train, test, _ = _model_frames(spark, d)
    return _forest_report(ML.fit_forest(P.with_class_weights(train, "label"), weight_col="weight"), test)


def q_forest_unweighted(spark, d):
    train, test, _ = _model_frames(spark, d)
    return _forest_report(ML.fit_forest(train), test)


def q_logit_fit(spark, d):
    train, _, _ = _model_frames(spark, d)
    m = ML.fit_logit(P.oversample(train, "label", "account_id", seed=0), C=1.0)
    coefs = list(zip(P.FEATURE_COLUMNS, m.coefficients.toArray().tolist()))
    coefs.append(("intercept", float(m.intercept)))
    return spark.createDataFrame(coefs, "feature string, coefficient double")


def _labelled_frame(spark, d):
    """account_id and label of every account with a loan."""
    labelled, _ = P.split_labelled(_mart(spark, d))
    return labelled.select("account_id", F.col("good_status_loan").cast("int").alias("label"))


def q_cv_folds_stratified(spark, d):
    return ML.stratified_folds(_labelled_frame(spark, d), ML.DEFAULT_FOLDS, 7919, out="fold")


def q_cv_folds_resampled(spark, d):
    """Rows of each class in each fold after the first flow's oversampling."""
    copies = P.oversample(_labelled_frame(spark, d), "label", "account_id", seed=0, mode="random")
    dealt = ML.stratified_folds(copies, ML.DEFAULT_FOLDS, 7919, out="fold")
    return dealt.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n_rows"))


def _assembled(spark, d):
    """Every account's feature vector."""
    return ML.assemble(P.select_features(P.prepare_mart(_mart(spark, d))), label=None)


def q_assemble_sum(spark, d):
    """Elements of each feature vector, added in their order."""
    x = vector_to_array("features")
    return _assembled(spark, d).select("account_id", F.size(x).alias("n_features"),
                                       F.aggregate(x, F.lit(0.0), lambda a, v: a + v).alias("total"))


#: Coefficients of the scoring check: 10^-7 / (position + 1).
FIXED_COEFFICIENTS = [1e-7 / (i + 1) for i in range(len(P.FEATURE_COLUMNS))]


def q_fixed_scores(spark, d):
    models = [ML.fixed_logit(spark, FIXED_COEFFICIENTS, -0.5), ML.fixed_logit(spark, [-c for c in FIXED_COEFFICIENTS], 0.25)]
    scored = D.average_scores(ML.score(models, _assembled(spark, d)), ["score_0", "score_1"])
    return scored.select("account_id", *[F.round(c, 9).alias(c) for c in ("score_0", "score_1", "avg_score")])


def q_logit_one_feature(spark, d):
    """Penalised logistic regression of the loan's class on one feature, solved to the fourth decimal."""
    labelled, _ = P.split_labelled(P.prepare_mart(_mart(spark, d)))
    rows = labelled.select("account_id", (F.coalesce("days_with_bank", F.lit(0)) / F.lit(1000.0)).alias("x"), "good_status_loan")
    m = ML.fit_logit(cut_lineage(ML.assemble(rows, ["x"])), C=1.0, tol=1e-12)
    return spark.createDataFrame([(round(float(m.coefficients[0]), 4), round(float(m.intercept), 4))],
                                 "coefficient double, intercept double")


def _search_table(spark, d, flow):
    train, _, _ = _model_frames(spark, d)
    res = ML.grid_search(train, flow.grid, flow.folds, flow.metric, seed=flow.seeds[0],
                         resample_in_fold=flow.resample_in_fold, oversampling=flow.oversampling)
    return [(float(c), float(v), c == res.best_C) for c, v in res.scores.items()]


def q_grid_search(spark, d):
    return spark.createDataFrame(_search_table(spark, d, ML.FLOW_SECOND), "C double, mean_recall double, best boolean")


def q_grid_search_first(spark, d):
    return spark.createDataFrame(_search_table(spark, d, ML.FLOW_FIRST), "C double, mean_recall_micro double, best boolean")


def _populations(models, train, test, pool):
    """Scores of test, all labelled (with ``good_status_loan``) and pool accounts, one row per population and account."""
    cols = [f"score_{i}" for i in range(len(models))]
    parts = []
    for name, df in (("test", test), ("labelled", train.unionByName(test)), ("pool", pool)):
        label = F.col("label") if "label" in df.columns else F.lit(None)
        parts.append(D.average_scores(ML.score(models, df), cols).select(
            F.lit(name).alias("population"), "account_id", label.cast("int").alias("good_status_loan"), *cols, "avg_score"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _bagged(spark, d, flow=ML.FLOW_SECOND):
    """The populations scored by the model of every repetition; all queries of a flow share one stored bag."""
    train, test, pool = _model_frames(spark, d)
    fits = ML.stored_bag(train, flow, f"{checkpoint_dir(spark)}/bags")
    return cut_lineage(_populations([f.model for f in fits], train, test, pool))


def _per_population(scored, evaluate):
    """``evaluate`` of the two labelled populations, one below the other."""
    test, labelled = (evaluate(scored.filter(F.col("population") == p)).withColumn("population", F.lit(p))
                      for p in ("test", "labelled"))
    return test.unionByName(labelled)


def q_bagged_scores(spark, d):
    return _bagged(spark, d)


def q_bagged_confusion(spark, d):
    return _per_population(_bagged(spark, d), D.confusion)


def q_bagged_roc(spark, d):
    return _per_population(_bagged(spark, d), D.roc_table)


def _report(scored):
    return D.classification_report(D.predict(scored), "good_status_loan", "y_hat")


def q_bagged_report(spark, d):
    return _per_population(_bagged(spark, d), _report)


def q_bagged_scores_first(spark, d):
    return _bagged(spark, d, ML.FLOW_FIRST)


def q_bagged_report_first(spark, d):
    return _per_population(_bagged(spark, d, ML.FLOW_FIRST), _report)


def _pool(spark, d):
    return _bagged(spark, d).filter(F.col("population") == "pool")


def q_model_tiers(spark, d):
    return D.tier_counts(D.decide(_pool(spark, d)))


def q_model_preapprove(spark, d):
    return D.preapprove_list(_pool(spark, d))


def q_model_high_confidence(spark, d):
    return D.high_confidence(_pool(spark, d))


def q_model_histogram(spark, d):
    return D.histogram(_pool(spark, d), "avg_score", D.POOL_BINS)


def _model_queries() -> dict[str, Query]:
    return {
        "cv_folds_stratified": q_cv_folds_stratified,
        "cv_folds_resampled": q_cv_folds_resampled,
        "assemble_sum": q_assemble_sum,
        "fixed_scores": q_fixed_scores,
        "logit_one_feature": q_logit_one_feature,
        "forest_benchmark": q_forest_benchmark,
        "forest_unweighted": q_forest_unweighted,
        "logit_fit": q_logit_fit,
        "grid_search": q_grid_search,
        "grid_search_first": q_grid_search_first,
        "bagged_scores": q_bagged_scores,
        "bagged_scores_first": q_bagged_scores_first,
        "bagged_confusion": q_bagged_confusion,
        "bagged_roc": q_bagged_roc,
        "bagged_report": q_bagged_report,
        "bagged_report_first": q_bagged_report_first,
        "model_tiers": q_model_tiers,
        "model_preapprove": q_model_preapprove,
        "model_high_confidence": q_model_high_confidence,
        "model_histogram": q_model_histogram,
    }


def queries() -> dict[str, Query]:
    """Every registered query, by name."""
    out: dict[str, Query] = {}
    for part in (_rollup_queries, _entity_queries, _decision_queries, _model_queries):
        out.update(part())
    return out
