"""Spark query vs its DuckDB twin on sf0.001 (the driver runs all of them
at sf0.01; here a fast cross-section of every module)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, norm

from conftest import SMALL

FAST = ["monthly_report", "budget_alerts", "account_history", "transaction_page", "recent_transactions",
        "due_recurring", "post_recurring", "recurring_balances", "throttle_events", "token_bucket_events",
        "transaction_validation", "amend_transactions_balances", "open_accounts", "cascade_delete",
        "unified_transactions", "dedup_unified", "amount_buckets", "stratified_split_sizes",
        "series_features_nation", "expense_forecast_nation", "cash_flow_summary",
        "fraud_features", "spending_anomaly", "duplicate_payments", "budget_allocation", "budget_tips",
        "financial_health", "classification_report", "fraud_rule_ranking", "forecast_leaderboard",
        "report_prompt_text", "profile_summary"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SMALL, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    rows = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    rel = con.sql(E.oracle_sql()[name])
    ocols = list(rel.columns)
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    orows = sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert rows == orows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "total_income" in df.columns
