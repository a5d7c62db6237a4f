"""Physical-plan properties the operators rely on at scale."""

import __spark_entry__ as E
import pytest

from conftest import SMALL


def _plan(spark, name):
    df = E.queries()[name](spark, SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def test_month_filter_reaches_the_scan(spark):
    p = _plan(spark, "monthly_report")
    scan = [ln for ln in p.split("\n") if "FileScan" in ln and "orders.parquet" in ln][0]
    assert "GreaterThanOrEqual(o_orderdate" in scan.split("PushedFilters:")[1]
    assert "partial_sum" in p  # map-side partial aggregation before the exchange


def test_top_k_uses_partial_group_limit(spark):
    for name in ("recent_transactions", "transaction_page", "throttle_events"):
        p = _plan(spark, name)
        assert "WindowGroupLimit" in p and "Partial" in p, name


def test_sql_operators_stay_in_the_jvm(spark):
    for name in ("budget_alerts", "spending_anomaly", "series_features_nation", "budget_allocation"):
        p = _plan(spark, name)
        assert "Python" not in p and "ArrowEvalPython" not in p, name


def test_tfidf_vocabulary_is_broadcast_only_behind_a_count(spark, monkeypatch):
    from pyspark.sql import functions as F
    from centime.operators import text_features as TF
    from centime.sources.tables import Ledger
    d = Ledger(spark, SMALL).table("documents", "doc_id", "text").select("doc_id", TF.word_tokens("text").alias("tokens"))

    def plan():
        w = TF.tfidf(d, "doc_id", TF.word_ngrams(F.col("tokens"), 1, 3))
        return w._jdf.queryExecution().executedPlan().toString()

    # few terms: the documents move once, their terms never
    p = plan()
    assert "BroadcastHashJoin" in p and p.count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(TF, "FEW_TERMS", 10)
    p = plan()
    assert "SortMergeJoin" in p and "BroadcastHashJoin" not in p


@pytest.fixture
def no_automatic_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_splits_never_gather_a_stratum_in_one_task(spark, no_automatic_broadcast):
    from pyspark.sql import functions as F
    from centime.operators import stats as ST
    d = spark.range(500).select(F.col("id").alias("row_id"), F.when(F.col("id") % 5 > 0, "a").otherwise("b").alias("category"))
    for split, test in ((ST.positional_split(d, ["row_id"]), {"a": None, "b": None}),
                        (ST.stratified_split(d, ["category"], ["row_id"]), {"a": 80, "b": 20})):
        p = split._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p and "hashpartitioning(_all" not in p.split("BroadcastExchange")[0]
        n = dict(split.where("split = 'test'").groupBy("category").count().collect())
        assert sum(n.values()) == 100 and all(v is None or n[c] == v for c, v in test.items())


def test_error_metrics_never_gather_a_group_in_one_task(spark, no_automatic_broadcast):
    from pyspark.sql import functions as F
    from centime.operators import metrics as MT
    d = spark.range(100).select((F.col("id") % 2).alias("category"), F.col("id").cast("double").alias("y"), (F.col("id") + 1.0).alias("p"))
    m = MT.regression_metrics(d, ["category"])
    p = m._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    assert [(r.n, r.mae, r.max_error) for r in m.collect()] == [(50, 1.0, 1.0)] * 2
