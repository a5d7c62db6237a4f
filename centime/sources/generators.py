"""Seeded synthetic generators (S14-S16), built on ``spark.range`` so the
rows are generated in parallel in the executors.  Used by the model tests;
registered queries read the driver's tables instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import dims
from ..functions.dates import shift_days, ts_lit

# FIXED VALUES: normal-row category mix of the fraud generator, and the
# ledger seeder's amount ranges per category.
FRAUD_CATEGORY_MIX = [("food", 0.28), ("shopping", 0.26), ("transport", 0.18), ("entertainment", 0.10),
                      ("bills", 0.10), ("healthcare", 0.05), ("education", 0.03)]
SEED_RANGES = {
    "INCOME": [("salary", 5000, 8000), ("freelance", 1000, 3000), ("investments", 500, 2000),
               ("other-income", 100, 1000)],
    "EXPENSE": [("housing", 1000, 2000), ("transportation", 100, 500), ("groceries", 200, 600),
                ("utilities", 100, 300), ("entertainment", 50, 200), ("food", 50, 150),
                ("shopping", 100, 500), ("healthcare", 100, 1000), ("education", 200, 1000),
                ("travel", 500, 2000)],
}


def _pick(u, choices):
    """Categorical draw from a uniform column ``u`` and (value, prob) pairs."""
    expr, acc = None, 0.0
    for v, p in choices:
        acc += p
        expr = F.when(u < acc, F.lit(v)) if expr is None else expr.when(u < acc, F.lit(v))
    return expr.otherwise(F.lit(choices[-1][0]))


def fraud_dataset(spark: SparkSession, n: int = 10000, fraud_rate: float = 0.035, seed: int = 42) -> DataFrame:
    """Normal rows around the category benchmarks plus four fraud
    archetypes (amount spike, night-time far away, untrusted device, burst)."""
    df = spark.range(n).withColumn("is_fraud", (F.col("id") < int(n * fraud_rate)).cast("int"))
    u = lambda k: F.rand(seed + k)
    z = lambda k: F.randn(seed + k)
    cat = _pick(u(1), FRAUD_CATEGORY_MIX)
    med = dims.map_expr({k: v[0] for k, v in dims.BASELINES.items()}, cat)
    p95 = dims.map_expr({k: v[2] for k, v in dims.BASELINES.items()}, cat)
    arche = F.floor(u(2) * 4)
    fraud = F.col("is_fraud") == 1
    normal_amt = F.least(F.greatest(F.exp(F.log(med) + 0.65 * z(3)), F.lit(10.0)), p95 * 1.5)
    fraud_amt = F.when(arche == 0, med * (8 + u(4) * 30)).otherwise(med * (1 + u(4) * 6))
    df = df.select(
        "id", "is_fraud", cat.alias("category"),
        F.round(F.when(fraud, fraud_amt).otherwise(normal_amt), 2).alias("amount"),
        F.when(fraud & (arche == 1), F.floor(u(5) * 5)).otherwise(
            F.least(F.greatest(F.floor(15 + 4 * z(6)), F.lit(6)), F.lit(23))).cast("int").alias("hour_of_day"),
        (u(7) < 0.28).cast("int").alias("is_weekend"),
        F.when(fraud & (arche == 1), 300 + u(8) * 3000).otherwise(
            F.least(F.greatest(-8.0 * F.log(u(9)), F.lit(0.5)), F.lit(45.0))).alias("distance_from_home_km"),
        F.when(fraud & (arche == 2), u(10) * 0.3).otherwise(
            F.least(F.greatest(0.92 + 0.08 * z(11), F.lit(0.65)), F.lit(1.0))).alias("device_trust_score"),
        F.when(fraud, 0.5 + u(12) * 0.5).otherwise(0.01 + u(12) * 0.34).alias("merchant_risk_score"),
        F.when(fraud & (arche == 3), 4 + F.floor(u(13) * 6)).otherwise(
            _pick(u(13), [(1, 0.85), (2, 0.12), (3, 0.03)])).cast("int").alias("velocity_1h"),
        F.when(fraud, (u(14) < 0.5).cast("int")).otherwise(F.lit(0)).alias("is_foreign_currency"))
    return df.withColumn("is_anomaly", F.col("is_fraud"))


def user_profiles(spark: SparkSession, n: int = 6000, seed: int = 42) -> DataFrame:
    """Income (log-normal, clipped 15k-400k), savings target, lifestyle
    mix, debt ratio (exponential, clipped 0-0.5), Dirichlet(1) history
    ratios from normalised exponentials."""
    u = lambda k: F.rand(seed + k)
    df = spark.range(n).withColumnRenamed("id", "user_id")
    df = df.select(
        "user_id",
        F.least(F.greatest(F.exp(F.log(F.lit(60000.0)) + 0.6 * F.randn(seed)), F.lit(15000.0)), F.lit(400000.0))
        .alias("monthly_income"),
        (0.05 + u(1) * 0.35).alias("savings_target_pct"),
        _pick(u(2), [("balanced", 0.4), ("conservative", 0.25), ("growth_oriented", 0.2), ("flexible", 0.15)])
        .alias("lifestyle"),
        F.least(-0.1 * F.log(u(3)), F.lit(0.5)).alias("debt_to_income_ratio"),
        *[(-F.log(u(10 + i))).alias(f"_g_{c}") for i, c in enumerate(dims.CATEGORIES)])
    tot = sum((F.col(f"_g_{c}") for c in dims.CATEGORIES[1:]), F.col(f"_g_{dims.CATEGORIES[0]}"))
    for c in dims.CATEGORIES:
        df = df.withColumn(f"hist_ratio_{c}", F.col(f"_g_{c}") / tot)
    df = df.withColumn("debt_obligations", F.col("monthly_income") * F.col("debt_to_income_ratio"))
    return df.drop(*[f"_g_{c}" for c in dims.CATEGORIES])


def ledger_seed(spark: SparkSession, accounts: DataFrame, now: str, days: int = 91, seed: int = 42) -> DataFrame:
    """Per account, days now-90 .. now, 1-3 transactions a day, 40 %
    income, amount uniform in the category's range, described
    'Received/Paid for {category}'."""
    u = lambda k: F.rand(seed + k)
    d = accounts.select("account_id", "user_id").withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    d = d.withColumn("k", F.explode(F.sequence(F.lit(1), (F.floor(u(1) * 3) + 1).cast("int"))))
    d = d.withColumn("type", F.when(u(2) < 0.4, "INCOME").otherwise("EXPENSE")).withColumn("_u", u(3)) \
         .withColumn("_v", u(4))

    def pick(kind):
        opts = SEED_RANGES[kind]
        p = 1.0 / len(opts)
        cat = _pick(F.col("_u"), [(c, p) for c, _, _ in opts])
        lo = _pick(F.col("_u"), [(float(a), p) for _, a, _ in opts])
        hi = _pick(F.col("_u"), [(float(b), p) for _, _, b in opts])
        return cat, lo, hi

    ci, li, hi_i = pick("INCOME")
    ce, le, he = pick("EXPENSE")
    inc = F.col("type") == "INCOME"
    cat = F.when(inc, ci).otherwise(ce)
    lo = F.when(inc, li).otherwise(le)
    hi = F.when(inc, hi_i).otherwise(he)
    date = shift_days(ts_lit(now), F.col("day") - (days - 1))
    return d.select(
        F.xxhash64("account_id", "day", "k", F.lit(seed)).alias("id"), "user_id", "account_id", "type",
        F.round(lo + F.col("_v") * (hi - lo), 2).alias("amount"),
        F.concat(F.when(inc, "Received ").otherwise("Paid for "), cat).alias("description"),
        date.alias("date"), cat.alias("category"), F.lit(False).alias("is_recurring"),
        F.lit(None).cast("string").alias("recurring_interval"), F.lit(None).cast("timestamp_ntz").alias("last_processed"),
        F.lit("COMPLETED").alias("status"))
