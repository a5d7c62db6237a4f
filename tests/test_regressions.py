"""Faults of the first round: each test fails on the code before its fix."""

import datetime as dt
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from centime.operators import forecast as FC
from centime.operators import iforest as IF
from centime.operators import jobs as J
from centime.operators import ledger as L
from centime.operators import mutations as X
from centime.operators import scoring as SC
from centime.operators import series as S
from centime.operators import stats as ST
from centime.plans import unify_queries as UQ
from centime.sources.tables import Ledger
from centime.streaming import jobs as SJ

from conftest import SMALL

NOW = "1998-03-15 12:00:00"
TX = ("id long, user_id long, account_id long, type string, amount double, description string, date timestamp_ntz, "
      "category string, is_recurring boolean, recurring_interval string, last_processed timestamp_ntz, status string")


def tx(spark, *rows):
    return spark.createDataFrame(
        [(i, u, u * 2, t, a, "d", dt.datetime.fromisoformat(d), c, False, None, None, "COMPLETED") for i, (u, t, a, d, c) in enumerate(rows)], TX)


def test_model_is_fitted_on_the_whole_history(spark):
    """200 days: the first 140 spend 100 a day, the last 60 nothing but one row."""
    rows = [(1, "EXPENSE", 100.0, str(dt.date(1997, 1, 1) + dt.timedelta(days=k)), "food") for k in range(140)]
    rows.append((1, "EXPENSE", 50.0, str(dt.date(1997, 1, 1) + dt.timedelta(days=199)), "food"))
    t = tx(spark, *rows)
    sparse = FC.seasonal_fit_sparse(t, ["user_id"]).orderBy("dow").collect()
    full = FC.seasonal_fit(S.daily_series(t, ["user_id"]), ["user_id"]).orderBy("dow").collect()
    assert [tuple(r) for r in sparse] == [tuple(r) for r in full]
    assert sparse[0]["global_mean"] == pytest.approx(14050 / 200)
    tail = S.recent_daily(t, ["user_id"], 60).orderBy("date").collect()
    assert len(tail) == 60 and [r["total_spend"] for r in tail] == [0.0] * 59 + [50.0]


def test_sparse_fit_of_short_spans(spark):
    rows = [(u, "EXPENSE", 10.0 * (k + 1), str(dt.date(1997, 1, 1 + u) + dt.timedelta(days=2 * k)), "food")
            for u in range(1, 6) for k in range(u)]
    t = tx(spark, *rows)
    key = ["user_id", "dow"]
    sparse = FC.seasonal_fit_sparse(t, ["user_id"]).orderBy(*key).collect()
    full = FC.seasonal_fit(S.daily_series(t, ["user_id"]), ["user_id"]).orderBy(*key).collect()
    assert [tuple(r) for r in sparse] == [tuple(r) for r in full]


def test_range_all_ends_today(spark):
    t = tx(spark, (1, "EXPENSE", 5.0, "1990-01-01", "food"), (1, "EXPENSE", 7.0, "1998-03-15T23:00:00", "food"),
           (1, "EXPENSE", 9.0, "1998-03-16", "food"))
    assert L.range_totals(t, NOW, "ALL").first()["total_expense"] == 12.0


def test_report_has_every_category_and_every_user(spark):
    users = spark.createDataFrame([(1, "a", "a@x"), (2, "b", "b@x"), (3, "c", "c@x")], "user_id long, name string, email string")
    t = tx(spark, (1, "EXPENSE", 5.0, "1998-02-03", "housing"), (1, "EXPENSE", 6.5, "1998-02-04", "food"),
           (2, "INCOME", 100.0, "1998-02-05", "salary"))
    rep = {r["user_id"]: r for r in L.monthly_report(users, t, "1998-02-01 00:00:00").collect()}
    assert {k: float(v) for k, v in rep[1]["by_category"].items()} == {"food": 6.5, "housing": 5.0}
    assert rep[2]["by_category"] == {} and rep[2]["total_income"] == 100.0 and rep[3]["transaction_count"] == 0
    text = {r["user_id"]: r["prompt_text"] for r in L.report_prompt(users, t, "1998-02-01 00:00:00").collect()}
    assert text[1].endswith("Expense Categories: food: $6.50, housing: $5.00")
    assert text[2] == "Total Income: $100.00, Total Expenses: $0.00, Net Income: $100.00, Expense Categories: "
    assert set(text) == {1, 2, 3}


def test_tips_count_all_spend_and_no_negative_debt(spark):
    prof = spark.createDataFrame([(1, 1000.0, 0.2, "balanced", -500.0)],
                                 "user_id long, monthly_income double, savings_target_pct double, lifestyle string, debt_obligations double")
    alloc, _ = SC.allocate_budget(prof)
    actual = spark.createDataFrame([(1, "housing", 900.0), (1, "food", 1.0)], "user_id long, category string, amount double")
    tips = [r["tip"] for r in SC.budget_tips(SC.recommend_budget(alloc, actual), alloc, actual, prof).collect()]
    assert tips == ["You are INR 101.00 short of your desired monthly savings target (INR 200.00)."]


def test_ewm_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    y = rng.uniform(0, 100, 300)
    df = spark.createDataFrame([(1, dt.date(2000, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)],
                               "k int, date date, total_spend double")
    got = [r["ewm_mean_30"] for r in S.add_ewm(df, ["k"], block=16).orderBy("date").collect()]
    r = 1 - 2 / 31
    for i in range(1, 300):
        w = r ** np.arange(i - 1, -1, -1)
        assert got[i] == pytest.approx(float((w * y[:i]).sum() / w.sum()), rel=1e-12)


def test_row_ids_are_unique(spark):
    d = UQ.identified_table(spark, SMALL)
    assert d.select("row_id").distinct().count() == d.count()


def test_rank_cut_with_equal_keys(spark):
    df = spark.createDataFrame([(i,) for i in range(100)], "id long").withColumn("g", F.lit(1)).withColumn("k", F.lit(5))
    head = ST.rank_below(df, ["g"], F.col("k"), F.lit(37), ["id"]).filter("in_head").orderBy("id").collect()
    assert [r["id"] for r in head] == list(range(37))


def test_several_requests_of_one_user(spark):
    acc = spark.createDataFrame([(10, 1, "CURRENT", True, 0.0), (11, 1, "SAVINGS", False, 0.0)],
                                "account_id long, user_id long, type string, is_default boolean, balance double")
    two = spark.createDataFrame([(1, 10, 2), (1, 11, 1)], "user_id long, account_id long, seq int")
    assert [r["account_id"] for r in X.set_default(acc, two).filter("is_default").collect()] == [10]
    req = spark.createDataFrame([(20, 2, "CURRENT", "5", False), (21, 2, "SAVINGS", "6", False), (22, 1, "SAVINGS", "7", True),
                                 (23, 1, "SAVINGS", "8", True)],
                                "account_id long, user_id long, type string, balance string, is_default boolean")
    out = X.open_accounts(acc, req)
    assert {r["user_id"]: r["account_id"] for r in out.filter("is_default").collect()} == {1: 23, 2: 20}
    assert out.filter("is_default").count() == 2 and out.count() == 6
    bud = spark.createDataFrame([(1, 5.0, None)], "user_id long, amount double, last_alert_sent timestamp_ntz")
    ask = spark.createDataFrame([(1, 7.0, 1), (1, 6.0, 2), (2, 3.0, 1), (2, 4.0, 2)], "user_id long, amount double, seq int")
    assert {r["user_id"]: r["amount"] for r in X.upsert_budgets(bud, ask).collect()} == {1: 6.0, 2: 4.0}
    usr = spark.createDataFrame([(1, "a", "a@x")], "user_id long, name string, email string")
    new = spark.createDataFrame([(3, "c", "c@x"), (2, "b", "c@x"), (9, "z", "a@x")], "user_id long, name string, email string")
    assert sorted(r["user_id"] for r in X.register_users(usr, new).collect()) == [1, 2]


def test_event_with_a_wrong_user_displaces_none(spark):
    db = Ledger(spark, SMALL)
    t, acc = db.transactions(), db.accounts()
    due = J.due_recurring(t, NOW)
    wrong = due.withColumn("user_id", F.col("user_id") + 1_000_000)
    posted, _, _ = J.post_recurring(t, acc, wrong.unionByName(due), NOW)
    assert posted.count() == due.count()


def test_posting_survives_a_replayed_batch(spark):
    db = Ledger(spark, SMALL)
    t, acc = db.transactions(), db.accounts()
    due = J.due_recurring(t, NOW).cache()
    out = tempfile.mkdtemp(prefix="centime-replay-")
    write = SJ.recurring_batch_writer(t, acc, NOW, out)
    half = due.filter("transaction_id % 2 = 0")
    write(half, 0)
    write(half, 0)  # the same epoch again, after a crash
    write(due, 1)
    posted = spark.read.parquet(os.path.join(out, "posted"))
    assert posted.count() == due.count()
    want, new_acc, upd = J.post_recurring(t, acc, due, NOW)
    delta = {r["account_id"]: r["delta"] for r in SJ.posted_deltas(posted).collect()}
    assert delta == {r["account_id"]: r["delta"] for r in SJ.posted_deltas(want).collect()}
    got = {r["id"]: (r["last_processed"], r["next_recurring_date"]) for r in SJ.advanced_templates(t, posted).collect()}
    assert got == {r["id"]: (r["last_processed"], r["next_recurring_date"]) for r in upd.filter("is_recurring").collect()}


def test_only_a_missing_path_counts_as_empty(spark):
    out = tempfile.mkdtemp(prefix="centime-broken-")
    assert SJ._read_or_empty(spark, os.path.join(out, "none"), "a long").count() == 0
    os.makedirs(os.path.join(out, "bad"))
    with open(os.path.join(out, "bad", "part-0.parquet"), "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        SJ._read_or_empty(spark, os.path.join(out, "bad"), "a long").count()


def test_forest_does_not_depend_on_partitioning(spark):
    df = spark.range(3000).select("id", (F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 31).cast("double").alias("b"))
    one, two = (IF.fit(d, ["a", "b"], "id", n_trees=10, sample_size=64) for d in (df.repartition(2), df.repartition(7)))
    key = ["tree_id", "node"]
    assert one.sort_values(key).reset_index(drop=True).equals(two.sort_values(key).reset_index(drop=True))
    assert set(one[one["node"] == 0]["size"]) == {64}
    few = IF.fit(df.limit(40), ["a", "b"], "id", n_trees=5, sample_size=64)
    assert set(few[few["node"] == 0]["size"]) == {40}


def test_budget_regressors_are_scored_on_every_fold(spark, monkeypatch):
    from centime.operators import trees as TR
    from centime.plans import tree_queries as TQ
    few = {"random_forest": TR.Forest(trees=6, depth=6), "extra_trees": TR.Forest(trees=6, depth=8, random_cuts=True, bootstrap=False),
           "gradient_boosting": TR.Boosting(rounds=6, depth=3, rate=0.3, lam=0.0), "xgboost": TR.Boosting(rounds=6, depth=3, rate=0.3)}
    monkeypatch.setattr(TQ, "BUDGET", few)
    d, _, targets = TQ.budget_rows(spark, "/root/testdata/sf0.001")
    p = TQ.budget_predictions(spark, "/root/testdata/sf0.001").toPandas()
    users, names = d.count(), [*few, "ridge", "ensemble"]
    assert len(p) == users * len(targets) * len(names) and not p["p"].isna().any() and not p.duplicated(["user_id", "target", "model"]).any()
    wide = p.pivot(index=["user_id", "target"], columns="model", values="p")
    vote = 0.5 * wide["extra_trees"] + 0.3 * wide["gradient_boosting"] + 0.2 * wide["xgboost"]
    assert (abs(vote - wide["ensemble"]) < 1e-6 * (1 + abs(vote))).all()
    assert ((p[p.model == "ridge"].y - p[p.model == "ridge"].p).abs().mean()) < p.y.mean()
