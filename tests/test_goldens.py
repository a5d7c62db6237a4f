"""Golden values from FIXTURES.md §3 (re-derived from the reference's rules)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from centime.functions.dates import days_to_payday, next_recurring_date
from centime.functions.money import bucket_label
from centime.functions.text import clean_text, parse_insights, text_feature
from centime.functions import dims
from centime.operators import scoring as SC


def test_allocation_goldens(spark):
    rows = [(i, 75000.0, 0.20, ls, 0.0) for i, ls in enumerate(["conservative", "balanced", "growth_oriented", "flexible"])]
    prof = spark.createDataFrame(rows, "user_id long, monthly_income double, savings_target_pct double, lifestyle string, debt_obligations double")
    alloc, bad = SC.allocate_budget(prof)
    got = {r["lifestyle"]: r for r in alloc.collect()}
    want = {
        "conservative": (17142.87, 10714.29, 6428.57, 4285.71, 4285.71, 10285.71, 6857.14),
        "balanced": (15000.00, 9375.00, 5625.00, 3750.00, 3750.00, 13500.00, 9000.00),
        "growth_oriented": (16615.37, 10384.62, 6230.77, 4153.85, 4153.85, 11076.92, 7384.62),
        "flexible": (14666.66, 9166.67, 5500.00, 3666.67, 3666.67, 14000.00, 9333.33),
    }
    order = ["food", "bills", "transport", "healthcare", "education", "shopping", "entertainment"]
    for ls, vals in want.items():
        r = got[ls]
        assert tuple(r[c] for c in order) == vals
        assert r["savings"] == 15000.0
        assert round(sum(r[c] for c in order) + r["savings"], 2) == 75000.0
    assert bad.count() == 0


def test_allocation_rejects_non_positive_income(spark):
    prof = spark.createDataFrame([(1, 0.0, 0.2, "balanced"), (2, -5.0, 0.2, "x")],
                                 "user_id long, monthly_income double, savings_target_pct double, lifestyle string")
    alloc, bad = SC.allocate_budget(prof)
    assert alloc.count() == 0 and bad.count() == 2


def test_health_personas(spark):
    personas = [
        ("high saver", 100000.0, 500000.0, {"food": 12000, "bills": 10000, "transport": 5000, "shopping": 3000, "entertainment": 2000, "healthcare": 2000, "education": 0}, 0.0),
        ("balanced", 75000.0, 120000.0, {"food": 15000, "bills": 12000, "transport": 6000, "shopping": 8000, "entertainment": 5000, "healthcare": 2000, "education": 0}, 5000.0),
        ("spender", 60000.0, 30000.0, {"food": 14000, "bills": 10000, "transport": 4000, "shopping": 20000, "entertainment": 9000, "healthcare": 1000, "education": 0}, 4000.0),
        ("leveraged", 50000.0, 5000.0, {"food": 12000, "bills": 15000, "transport": 4000, "shopping": 6000, "entertainment": 3000, "healthcare": 2000, "education": 0}, 22000.0),
    ]
    rows = [(n, inc, bal, float(sum(e.values())), float(e["shopping"] + e["entertainment"]), float(e["bills"]), d)
            for n, inc, bal, e, d in personas]
    df = spark.createDataFrame(rows, "name string, monthly_income double, current_balance double, total_expenses double, "
                                     "discretionary_spend double, bills_spend double, debt_obligations double")
    got = {r["name"]: r for r in SC.health_score(df).collect()}
    want = {"high saver": (100.0, "A+", "EXCEPTIONAL", 14.7, (100.0, 100.0, 100.0, 100.0, 100.0)),
            "balanced": (94.5, "A+", "EXCEPTIONAL", 2.3, (99.0, 100.0, 96.9, 69.0, 100.0)),
            "spender": (53.7, "D", "CRITICAL", 0.5, (28.3, 100.0, 55.0, 24.2, 46.7)),
            "leveraged": (33.6, "D", "CRITICAL", 0.1, (16.0, 23.0, 100.0, 3.9, 22.0))}
    for n, (score, grade, status, runway, pillars) in want.items():
        r = got[n]
        assert (r["financial_health_score"], r["grade"], r["status"], r["runway_months"]) == (score, grade, status, runway)
        assert (r["savings_rate_score"], r["debt_score"], r["discretionary_score"], r["runway_score"], r["buffer_score"]) == pillars


def _scenarios(spark):
    rows = [
        (1, "grocery", 420.0, "food", 19, 2.0, 1.0, 0.05, 1, 0),
        (2, "jewellery", 85000.0, "shopping", 16, 12.0, 0.9, 0.20, 1, 0),
        (3, "casino", 95000.0, "entertainment", 3, 3200.0, 0.05, 0.95, 2, 1),
        (4, "burst", 12900.0, "shopping", 11, 80.0, 0.40, 0.50, 6, 0),
        (5, "hotel", 11500.0, "transport", 14, 450.0, 0.85, 0.15, 1, 0),
    ]
    return spark.createDataFrame(rows, "event_id long, name string, amount double, category string, hour_of_day int, "
                                       "distance_from_home_km double, device_trust_score double, merchant_risk_score double, "
                                       "velocity_1h int, is_foreign_currency int")


def test_fraud_scenarios(spark):
    ev = _scenarios(spark).withColumn("is_weekend", F.lit(0))
    f = SC.fraud_risk(ev)
    got = {r["name"]: r for r in f.collect()}
    want = {"grocery": (0.646, 0.05, "LOW"), "jewellery": (38.636, 0.45, "MEDIUM"), "casino": (126.667, 0.99, "HIGH"),
            "burst": (5.864, 0.05, "LOW"), "hotel": (25.556, 0.45, "MEDIUM")}
    for n, (ratio, p, tier) in want.items():
        assert (got[n]["amount_to_category_ratio"], got[n]["fraud_probability"], got[n]["risk_level"]) == (ratio, p, tier)


def test_anomaly_scenarios(spark):
    ev = (_scenarios(spark).withColumn("is_weekend", F.lit(0))
          .withColumn("user_id", F.col("event_id")).withColumn("merchant", F.col("name"))
          .withColumn("ts", F.expr("TIMESTAMP_NTZ '2024-01-01 10:00:00'")))
    got = {r["name"]: r for r in SC.spending_anomaly(ev).collect()}
    want = {"grocery": (0.0, "NORMAL"), "jewellery": (0.65, "CRITICAL"), "casino": (0.65, "CRITICAL"),
            "burst": (0.0, "WARNING"), "hotel": (0.65, "CRITICAL")}
    for n, (score, sev) in want.items():
        assert (got[n]["anomaly_score"], got[n]["severity"]) == (score, sev)


def test_reason_texts(spark):
    ev = _scenarios(spark).withColumn("is_weekend", F.lit(0))
    f = SC.fraud_features(ev)
    got = {r["name"]: r["reasons"] for r in f.select("name", SC.reason_texts(f).alias("reasons")).collect()}
    assert got["grocery"] == ["Transaction pattern aligns with normal user behavior."]
    assert got["casino"][0] == "Unusual spend spike: Amount is 126.7x higher than the typical entertainment median (INR 750)."
    assert "Off-hours activity: Transaction initiated at 03:00 hours." in got["casino"]
    assert got["burst"][-1] == "High velocity burst: 6 transactions detected within the last 60 minutes."
    assert "Geo-location deviation: Transaction location is 3,200 km away from registered home base." in got["casino"]


def test_next_recurring_dates(spark):
    rows = [(dt.datetime(2025, 1, 31, 9, 30), "MONTHLY"), (dt.datetime(2024, 2, 29), "YEARLY"),
            (dt.datetime(2024, 2, 29), "MONTHLY"), (dt.datetime(2025, 3, 15), "MONTHLY"),
            (dt.datetime(2025, 3, 15), "DAILY"), (dt.datetime(2025, 3, 15), "WEEKLY"), (dt.datetime(2025, 3, 15), "OTHER")]
    df = spark.createDataFrame(rows, "d timestamp_ntz, iv string")
    got = [r[0] for r in df.select(next_recurring_date("d", "iv")).collect()]
    assert got == [dt.datetime(2025, 3, 3, 9, 30), dt.datetime(2025, 3, 1), dt.datetime(2024, 3, 29),
                   dt.datetime(2025, 4, 15), dt.datetime(2025, 3, 16), dt.datetime(2025, 3, 22), dt.datetime(2025, 3, 15)]


def test_days_to_payday(spark):
    df = spark.createDataFrame([(d,) for d in (1, 15, 16, 30, 31)], "d int")
    assert [r[0] for r in df.select(days_to_payday("d")).collect()] == [0, 14, 14, 0, 0]


def test_bucket_labels(spark):
    edges = F.array(*[F.lit(x) for x in (2.0, 413.74, 1224.82, 3865.45, 12190.88, 149836.1)])
    labels = F.array(*[F.lit(x) for x in dims.BUCKET_LABELS])
    df = spark.createDataFrame([(413.74,), (413.75,), (1e6,), (0.0,), (None,), (float("nan"),)], "v double")
    got = [r[0] for r in df.select(bucket_label("v", edges, labels)).collect()]
    assert got == ["very_low", "low", "very_high", "very_low", "nan", "nan"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("  McDonald's, Inc. ", "Swiggy", "dinner order", None)], "a string, m string, d string, n string")
    r = df.select(clean_text("a"), text_feature("m", "d"), clean_text("n")).first()
    assert r[0] == "mcdonald s inc" and r[1] == "swiggy swiggy dinner order" and r[2] == ""


def test_insight_parsing(spark):
    df = spark.createDataFrame([("```json\n[\"a\"]\n```",), ("not json at all",)], "t string")
    got = [r[0] for r in df.select(parse_insights("t")).collect()]
    assert got[0] == ["a"]
    assert got[1] == dims.FALLBACK_INSIGHTS
