import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "n_trans" in df.columns and "age_at_loan" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["mart_cutoff", "txn_rollup", "owner_user_pair", "roc_table",
                                  "decision_tiers", "oversample_ratio", "recode_many"])
def test_oracle_matches_at_small_scale(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF_SMALL)
    cur = con.execute(E.oracle_sql()[name])
    cols = sorted(sdf.columns)
    assert cols == sorted(d[0] for d in cur.description)
    dnames = [d[0] for d in cur.description]
    norm = lambda v: float(v) if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else v
    srows = sorted((tuple(norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    drows = sorted((tuple(norm(r[dnames.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert srows == drows


def test_plans_have_no_cartesian_or_python(spark):
    for name in ("mart_cutoff", "roc_table", "owner_user_pair", "feature_select"):
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
        assert "ArrowEvalPython" not in plan
