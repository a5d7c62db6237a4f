"""Invariants and brute-force checks of the distributed operators."""

import datetime as dt
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from centime.operators import forecast as FC
from centime.operators import jobs as J
from centime.operators import metrics as MT
from centime.operators import mutations as X
from centime.operators import scoring as SC
from centime.operators import series as S
from centime.operators import stats as ST
from centime.sources.tables import Ledger

from conftest import SMALL


def test_exact_quantiles_match_numpy(spark, monkeypatch):
    rng = random.Random(7)
    vals = [float(rng.choice([1, 2, 2, 3, 5, 8, 13])) for _ in range(500)] + [rng.uniform(0, 100) for _ in range(777)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    qs = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    monkeypatch.setattr(ST, "PICK", 40)  # several rounds of narrowing
    monkeypatch.setattr(ST, "BINS", 16)
    got = ST.exact_quantiles(df, "v", qs)
    want = np.quantile(np.array(vals), qs)
    assert np.allclose(got, want, rtol=0, atol=1e-9)


def test_stratified_split_is_exact(spark):
    rows = [(i, "hot" if i % 3 else f"c{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, cat string")
    s = ST.stratified_split(df, ["cat"], ["id"], 0.2, 42)
    got = {r["cat"]: (r["n"], r["t"]) for r in s.groupBy("cat").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect()}
    for cat, (n, t) in got.items():
        assert t == int(np.floor(n * 0.2 + 0.5))
    # the chosen rows are those with the smallest hashes (brute force)
    h = df.withColumn("h", ST.seeded_hash(["id"], 42)).toPandas()
    chosen = set(s.filter(F.col("split") == "test").toPandas()["id"])
    want = set()
    for cat, g in h.groupby("cat"):
        k = int(np.floor(len(g) * 0.2 + 0.5))
        want |= set(g.sort_values("h").head(k)["id"])
    assert chosen == want


def test_keep_first(spark):
    rows = [(1, "a", 2.0, "s2", 3), (2, "a", 2.0, "s1", 9), (3, "a", 2.0, "s1", 4), (4, "b", 1.0, "s9", 1)]
    df = spark.createDataFrame(rows, "rid long, k string, v double, src string, d long")
    got = sorted(r["rid"] for r in ST.keep_first(df, ["k", "v"], ["src", "d"]).collect())
    assert got == [3, 4]


def _brute_dups(rows, window_s=86400):
    out = {}
    for r in rows:
        out[r[0]] = any(q[0] != r[0] and q[1] == r[1] and q[2].lower() == r[2].lower() and abs(q[3] - r[3]) < 0.01
                        and q[4] <= r[4] and q[4] >= r[4] - dt.timedelta(seconds=window_s) for q in rows)
    return out


def test_duplicate_flags_vs_brute_force(spark):
    rng = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        hot = i % 2 == 0  # half the rows share one user, merchant and almost one amount
        amt = round(100.0 + rng.choice([0.0, 0.004, 0.009, 0.01, 0.011, 0.02]), 3) if hot else round(rng.uniform(1, 50), 2)
        rows.append((i, 1 if hot else rng.randint(2, 6), "Shop" if hot else rng.choice(["a", "B", "b"]), amt,
                     base + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 4))))
    df = spark.createDataFrame(rows, "event_id long, user_id long, merchant string, amount double, ts timestamp_ntz")
    got = {r["event_id"]: r["is_duplicate_payment"] for r in SC.duplicate_flags(df).collect()}
    assert got == _brute_dups(rows)


def test_velocity_vs_brute_force(spark):
    rng = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, rng.randint(1, 3), base + dt.timedelta(seconds=rng.randint(0, 4 * 3600))) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    got = {r["event_id"]: r["velocity_1h"] for r in SC.velocity(df).collect()}
    for i, u, t in rows:
        assert got[i] == sum(1 for _, u2, t2 in rows if u2 == u and t - dt.timedelta(hours=1) <= t2 <= t)


def test_rolling_and_ewm_match_pandas(spark):
    rng = np.random.default_rng(1)
    n = 1300
    y = np.round(rng.gamma(2.0, 500.0, n), 2)
    days = pd.date_range("2020-01-01", periods=n, freq="D")
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "date": days.date, "total_spend": y}))
    got = S.add_features(df, ["k"]).orderBy("date").toPandas()
    sh = pd.Series(y).shift(1)
    for w in (7, 14, 30):
        assert np.allclose(got[f"rolling_mean_{w}"].iloc[1:], sh.rolling(w, min_periods=1).mean().iloc[1:], rtol=1e-12)
        assert np.allclose(got[f"rolling_std_{w}"], sh.rolling(w, min_periods=1).std().fillna(0.0), rtol=1e-9, atol=1e-9)
    for span in (7, 30):
        want = sh.ewm(span=span, min_periods=1).mean()
        assert np.allclose(got[f"ewm_mean_{span}"].iloc[1:].astype(float), want.iloc[1:], rtol=0, atol=0.0051)
    assert np.array_equal(got["lag_7"].iloc[7:].to_numpy(), y[:-7])


def test_recurring_posting_is_idempotent(spark):
    db = Ledger(spark, SMALL)
    now = "1998-03-15 12:00:00"
    tx = db.transactions()
    acc = db.accounts()
    ev = J.due_recurring(tx, now)
    posted, acc2, upd = J.post_recurring(tx, acc, ev.unionByName(ev), now)  # duplicated events
    n = posted.count()
    assert n == ev.count() and n > 0
    # replaying the same events against the updated templates posts nothing
    posted2, _, _ = J.post_recurring(upd, acc2, ev, now)
    assert posted2.count() == 0


def test_post_then_delete_restores_balances(spark):
    db = Ledger(spark, SMALL)
    tx, acc = db.transactions(), db.accounts()
    req = tx.limit(0).unionByName(
        tx.filter("status = 'COMPLETED'").limit(50).withColumn("id", F.col("id") + 10 ** 9))
    rows, tx2, acc2, _ = X.post_transactions(tx, acc, req.drop("last_processed").withColumn("last_processed", F.lit(None).cast("timestamp_ntz")))
    _, acc3 = X.bulk_delete(tx2, acc2, rows.select("id", "user_id"))
    a = {r["account_id"]: r["balance"] for r in acc.collect()}
    b = {r["account_id"]: r["balance"] for r in acc3.collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_category_split_sums_to_total(spark):
    tot = spark.createDataFrame([(1, 12345.67), (2, 0.0), (3, 1.01)], "s long, total_predicted_expense double")
    parts = FC.category_split(tot, ["s"]).toPandas()
    for s, g in parts.groupby("s"):
        total = {1: 12345.67, 3: 1.01}[s]
        assert abs(g["amount"].sum() - total) <= 0.01 * len(g)
    assert 2 not in set(parts["s"])


def test_ranking_metrics_vs_brute_force(spark):
    rng = random.Random(11)
    rows = [(rng.choice([0.1, 0.2, 0.2, 0.5, 0.9]), int(rng.random() < 0.3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "score double, label int")
    r = MT.ranking_metrics(df, []).first()
    s = np.array([x for x, _ in rows]); y = np.array([l for _, l in rows])
    ranks = pd.Series(s).rank(method="average").to_numpy()
    P, N = y.sum(), len(y) - y.sum()
    auc = (ranks[y == 1].sum() - P * (P + 1) / 2) / (P * N)
    ap = 0.0
    for v in sorted(set(s), reverse=True):
        cum = s >= v
        ap += (y[s == v].sum() / P) * (y[cum].sum() / cum.sum())
    assert abs(r["roc_auc"] - auc) < 1e-6 and abs(r["average_precision"] - ap) < 1e-6


def test_throttle_admits_ten_per_minute(spark):
    base = dt.datetime(2024, 1, 1, 10, 0)
    rows = [(i, 1, base + dt.timedelta(seconds=i)) for i in range(25)] + [(100, 2, base)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    got = {r["event_id"]: r["admitted"] for r in J.throttle(df).collect()}
    assert sum(got.values()) == 11 and got[100] and got[9] and not got[10]


def test_ranking_metrics_continuous_scores(spark):
    rng = np.random.default_rng(5)
    s = np.round(rng.random(5000), 3)  # ~1000 distinct values with ties
    y = (rng.random(5000) < s * 0.6).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label int")
    r = MT.ranking_metrics(df, [], n_buckets=64).first()
    ranks = pd.Series(s).rank(method="average").to_numpy()
    P, N = y.sum(), len(y) - y.sum()
    auc = (ranks[y == 1].sum() - P * (P + 1) / 2) / (P * N)
    ap = sum((y[s == v].sum() / P) * (y[s >= v].sum() / (s >= v).sum()) for v in np.unique(s))
    assert abs(r["roc_auc"] - auc) < 1e-6 and abs(r["average_precision"] - ap) < 1e-6


def test_quirk_flags_change_results_where_expected(spark):
    db = Ledger(spark, SMALL)
    from centime.operators import ledger as L
    tx = db.transactions()
    strict = L.monthly_stats(tx, "1998-02-01 00:00:00", strict=True).agg(F.sum("transaction_count")).first()[0] or 0
    whole = L.monthly_stats(tx, "1998-02-01 00:00:00", strict=False).agg(F.sum("transaction_count")).first()[0] or 0
    late = tx.filter((F.col("date") > F.expr("TIMESTAMP_NTZ '1998-02-28 00:00:00'"))
                     & (F.col("date") < F.expr("TIMESTAMP_NTZ '1998-03-01 00:00:00'"))).count()
    assert whole - strict == late
    # an account move: the default keeps the ledger-wide balance change equal to the
    # sum of signed differences; strict puts everything on the new account
    pend = tx.filter("status = 'PENDING'").limit(20)
    moved = pend.withColumn("account_id", F.col("user_id") * 2 + (1 - F.col("account_id") % 2))
    acc = db.accounts()
    _, a_def = X.amend_transactions(tx, acc, moved)
    _, a_str = X.amend_transactions(tx, acc, moved, strict=True)
    base = {r["account_id"]: r["balance"] for r in acc.collect()}
    d_def = {r["account_id"]: r["balance"] - base[r["account_id"]] for r in a_def.collect()}
    d_str = {r["account_id"]: r["balance"] - base[r["account_id"]] for r in a_str.collect()}
    assert abs(sum(d_def.values())) < 1e-6          # amounts unchanged: moves net to zero
    old_ids = {r["account_id"] for r in pend.select("account_id").collect()}
    assert all(abs(d_str[a]) < 1e-9 for a in old_ids)  # strict leaves old accounts untouched
    assert any(abs(d_def[a]) > 0 for a in old_ids)
