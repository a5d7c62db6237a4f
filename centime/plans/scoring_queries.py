"""Scoring queries: fraud and anomaly rules over the risk events, budget
allocation, recommendation and health score over the user profiles
(G1-G8, J6-J8, J14, W7, W11, A22, R1, M1-M3, C4, C6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dims
from ..functions.money import as_number, money
from ..operators import ledger as L
from ..operators import scoring as SC
from ..sources.tables import Ledger
from .oracle_views import M, R, with_views
from .registry import query

REPORT_MONTH = "1998-02-01 00:00:00"


def _case(expr: str, mapping: dict, default: str | None = None) -> str:
    body = " ".join(f"WHEN '{k}' THEN {v!r}" if not isinstance(v, str) else f"WHEN '{k}' THEN '{v}'"
                    for k, v in mapping.items())
    return f"CASE {expr} {body}" + (f" ELSE {default}" if default else "") + " END"


_BCAT = ("CASE WHEN lower(category) IN (" + ", ".join(f"'{c}'" for c in dims.BASELINES) +
         ") THEN lower(category) ELSE 'shopping' END")
_MEDIAN = _case("bcat", {k: float(v[0]) for k, v in dims.BASELINES.items()})
_P95 = _case("bcat", {k: float(v[2]) for k, v in dims.BASELINES.items()})

FEAT_CTES = f"""vel AS (
  SELECT event_id, CAST(COUNT(*) OVER (PARTITION BY user_id ORDER BY ts
                   RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS INTEGER) AS velocity_1h
  FROM v_risk_events),
fb AS (SELECT e.*, v.velocity_1h, {_BCAT} AS bcat FROM v_risk_events e JOIN vel v ON v.event_id = e.event_id),
feat AS (
  SELECT *, {R(f'amount / greatest(1.0, {_MEDIAN})', 3)} AS ratio,
         CASE WHEN hour_of_day >= 23 OR hour_of_day <= 5 THEN 1 ELSE 0 END AS night,
         CAST(isodow(ts) - 1 >= 5 AS INTEGER) AS weekend,
         greatest(0.0, least(1.0, device_trust_score)) AS trust,
         greatest(0.0, least(1.0, merchant_risk_score)) AS mrisk,
         {_P95} AS p95
  FROM fb),
prob AS (
  SELECT *, greatest(0.01, least(0.99, 0.05 + CASE WHEN ratio >= 7.0 THEN 0.40 ELSE 0.0 END
                                             + CASE WHEN night = 1 THEN 0.20 ELSE 0.0 END
                                             + CASE WHEN trust < 0.3 THEN 0.25 ELSE 0.0 END
                                             + CASE WHEN mrisk > 0.6 THEN 0.20 ELSE 0.0 END)) AS p
  FROM feat)"""


# the explanation texts, joined; none of them: the normal-behaviour line
_REASONS = f"""COALESCE(NULLIF(concat_ws(' | ',
  CASE WHEN ratio >= 5.0 THEN 'Unusual spend spike: Amount is ' || CAST({R('ratio', 1)} AS VARCHAR) || 'x higher than the typical '
       || bcat || ' median (INR ' || format('{{:,.0f}}', CAST({_MEDIAN} AS DOUBLE)) || ').' END,
  CASE WHEN NOT (ratio >= 5.0) AND amount >= p95 * 2.0 THEN 'High monetary amount: Transaction (INR '
       || format('{{:,.2f}}', CAST({M('amount')} AS DOUBLE)) || ') significantly exceeds the 95th percentile.' END,
  CASE WHEN night = 1 THEN 'Off-hours activity: Transaction initiated at ' || lpad(CAST(hour_of_day AS VARCHAR), 2, '0') || ':00 hours.' END,
  CASE WHEN trust < 0.35 THEN 'Unrecognized hardware: Transaction performed from a new or untrusted device.' END,
  CASE WHEN distance_from_home_km >= 300.0 THEN 'Geo-location deviation: Transaction location is '
       || format('{{:,.0f}}', distance_from_home_km) || ' km away from registered home base.' END,
  CASE WHEN mrisk >= 0.65 THEN 'High merchant risk: Merchant category or terminal has elevated dispute/fraud risk.' END,
  CASE WHEN is_foreign_currency = 1 THEN 'Cross-border transaction: Payment processed in a foreign currency.' END,
  CASE WHEN COALESCE(velocity_1h, 1) >= 4 THEN 'High velocity burst: ' || CAST(velocity_1h AS VARCHAR)
       || ' transactions detected within the last 60 minutes.' END), ''), 'Transaction pattern aligns with normal user behavior.')"""


def _ev_sql(body: str, extra: str = "") -> str:
    return with_views(body, "v_risk_events", extra_ctes=FEAT_CTES + (",\n" + extra if extra else ""))


def _events(spark, sf_dir) -> DataFrame:
    return Ledger(spark, sf_dir).risk_events()


@query("fraud_features", "G4,J6,D9,M1,M2,W7", oracle=_ev_sql("""
SELECT event_id, bcat AS baseline_category, ratio AS amount_to_category_ratio, night AS is_night_time,
       weekend AS is_weekend, trust AS trust_clipped, mrisk AS merchant_risk_clipped, velocity_1h FROM feat"""))
def q_fraud_features(spark, sf_dir):
    f = SC.fraud_features(_events(spark, sf_dir))
    return f.select("event_id", "baseline_category", "amount_to_category_ratio", "is_night_time", "is_weekend",
                    "trust_clipped", "merchant_risk_clipped", "velocity_1h")


@query("fraud_risk", "G5,G6,G7,P7", oracle=_ev_sql(f"""
SELECT event_id, {R('p', 4)} AS fraud_probability, {R('p * 100.0', 1)} AS fraud_percentage,
       CASE WHEN p >= 0.70 THEN 'HIGH' WHEN p >= 0.30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
       CASE WHEN p >= 0.70 THEN 'BLOCK_TRANSACTION' WHEN p >= 0.30 THEN 'MANUAL_REVIEW' ELSE 'ALLOW' END AS recommended_action,
       CASE WHEN p >= 0.70 THEN 'High probability of unauthorized fraud. Block charge and prompt user verification via OTP/SMS.'
            WHEN p >= 0.30 THEN 'Elevated risk detected. Surface in-app confirmation banner to verify legitimacy.'
            ELSE 'Transaction pattern matches genuine cardholder profile.' END AS action_detail,
       {_REASONS} AS risk_factors
FROM prob"""))
def q_fraud_risk(spark, sf_dir):
    return SC.fraud_risk(_events(spark, sf_dir)).select(
        "event_id", "fraud_probability", "fraud_percentage", "risk_level", "recommended_action", "action_detail",
        F.array_join("risk_factors", " | ").alias("risk_factors"))


@query("anomaly_reason_flags", "G5,R1", oracle=_ev_sql("""
SELECT event_id, ratio >= 5.0 AS r_spend_spike, NOT (ratio >= 5.0) AND amount >= p95 * 2.0 AS r_high_amount,
       night = 1 AS r_off_hours, trust < 0.35 AS r_untrusted_device, distance_from_home_km >= 300.0 AS r_geo_deviation,
       mrisk >= 0.65 AS r_merchant_risk, is_foreign_currency = 1 AS r_cross_border,
       COALESCE(velocity_1h, 1) >= 4 AS r_velocity_burst
FROM feat"""))
def q_reason_flags(spark, sf_dir):
    f = SC.fraud_features(_events(spark, sf_dir))
    return f.select("event_id", *SC.reason_flags(f))


@query("spending_anomaly", "G8,J8", oracle=_ev_sql("""
SELECT event_id, is_duplicate_payment, is_outlier, CASE WHEN is_outlier THEN 0.65 ELSE 0.0 END AS anomaly_score,
       (is_outlier OR is_duplicate_payment OR ratio >= 5.0) AS is_anomaly,
       CASE WHEN is_duplicate_payment OR ratio >= 10.0 THEN 'CRITICAL'
            WHEN is_outlier OR is_duplicate_payment OR ratio >= 5.0 THEN 'WARNING' ELSE 'NORMAL' END AS severity,
       CASE WHEN is_duplicate_payment THEN 'Potential duplicate payment: An identical charge of INR '
            || format('{:,.2f}', CAST(""" + M("amount") + """ AS DOUBLE)) || ' at ''' || merchant || ''' was found in recent transactions. | '
            ELSE '' END || """ + _REASONS + """ AS reasons
FROM (SELECT f.*, (amount > p95 * 2.0 OR ratio >= 6.0) AS is_outlier,
             EXISTS (SELECT 1 FROM v_risk_events q WHERE q.user_id = f.user_id AND lower(q.merchant) = lower(f.merchant)
                     AND abs(q.amount - f.amount) < 0.01 AND q.event_id <> f.event_id AND q.ts <= f.ts
                     AND q.ts >= f.ts - INTERVAL 24 HOUR) AS is_duplicate_payment
      FROM feat f)"""))
def q_spending_anomaly(spark, sf_dir):
    return SC.spending_anomaly(_events(spark, sf_dir)).select(
        "event_id", "is_duplicate_payment", "is_outlier", "anomaly_score", "is_anomaly", "severity",
        F.array_join("reasons", " | ").alias("reasons"))


@query("duplicate_payments", "J8", oracle=with_views("""
SELECT f.event_id, EXISTS (SELECT 1 FROM v_risk_events q WHERE q.user_id = f.user_id AND lower(q.merchant) = lower(f.merchant)
                     AND abs(q.amount - f.amount) < 0.01 AND q.event_id <> f.event_id AND q.ts <= f.ts
                     AND q.ts >= f.ts - INTERVAL 24 HOUR) AS is_duplicate_payment
FROM dupe_src f""", "v_risk_events", extra_ctes="""dupe_src AS (
  SELECT event_id, user_id, ts, merchant, amount FROM v_risk_events
  UNION ALL
  SELECT event_id + 100000000, user_id, ts + INTERVAL 30 MINUTE, upper(merchant), amount + 0.004 FROM v_risk_events
  WHERE is_foreign_currency = 1)"""))
def q_duplicate_payments(spark, sf_dir):
    """Duplicate detection where duplicates exist: every foreign-currency
    event is replayed 30 minutes later, merchant upper-cased, amount +0.004."""
    e = _events(spark, sf_dir).select("event_id", "user_id", "ts", "merchant", "amount", "is_foreign_currency")
    replay = e.filter(F.col("is_foreign_currency") == 1).select(
        (F.col("event_id") + 100000000).alias("event_id"), "user_id",
        (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("ts"), F.upper("merchant").alias("merchant"),
        (F.col("amount") + 0.004).alias("amount"), "is_foreign_currency")
    src = e.unionByName(replay)
    return SC.duplicate_flags(src)


# ------------------------------------------------------------- budgets ---

def _alloc_sql() -> str:
    nr = _case("lifestyle_used", {k: v[0] / (v[0] + v[1]) for k, v in dims.LIFESTYLES.items()})
    parts = []
    for c in dims.ALLOCATION_ORDER:
        bucket = "needs" if dims.CATEGORY_CLASS[c] == "needs" else "wants"
        parts.append(f"{M(f'{bucket} * CAST({dims.CATEGORY_WEIGHTS[c]!r} AS DOUBLE)')} AS a_{c}")
    total = " + ".join(f"a_{c}" for c in dims.ALLOCATION_ORDER)
    lifes = ", ".join(f"'{k}'" for k in dims.LIFESTYLES)
    outs = ", ".join(f"CAST(a_{c} AS DOUBLE) AS {c}" if c != "food" else f"CAST(a_food + ({M('sp')} - ({total})) AS DOUBLE) AS food"
                     for c in dims.CATEGORIES)
    return f"""al0 AS (
  SELECT user_id, monthly_income, debt_obligations,
         CASE WHEN lifestyle IN ({lifes}) THEN lifestyle ELSE 'balanced' END AS lifestyle_used,
         greatest(CAST(0.05 AS DOUBLE), least(CAST(0.6 AS DOUBLE), savings_target_pct)) AS pct_used
  FROM v_profiles WHERE monthly_income > 0),
al1 AS (SELECT *, {M('monthly_income * pct_used')} AS savings FROM al0),
al2 AS (SELECT *, monthly_income - CAST(savings AS DOUBLE) AS sp FROM al1),
al3 AS (SELECT *, sp * ({nr}) AS needs, sp * (CAST(1.0 AS DOUBLE) - ({nr})) AS wants FROM al2),
al4 AS (SELECT *, {", ".join(parts)} FROM al3),
alloc AS (SELECT user_id, monthly_income, debt_obligations, lifestyle_used AS lifestyle, pct_used AS savings_target_pct,
                 {outs}, CAST(savings AS DOUBLE) AS savings FROM al4)"""


def _alloc(spark, sf_dir):
    alloc, _ = SC.allocate_budget(Ledger(spark, sf_dir).profiles())
    return alloc


@query("budget_allocation", "G1,J7,M1,M2", oracle=with_views("SELECT * FROM alloc", "v_profiles",
                                                             extra_ctes=_alloc_sql()))
def q_budget_allocation(spark, sf_dir):
    return _alloc(spark, sf_dir)


def _feb_actual(db: Ledger) -> DataFrame:
    t = db.transactions("1998-02-01", "1998-02-28").filter(
        L.month_window("date", REPORT_MONTH) & (F.col("type") == "EXPENSE"))
    return t.groupBy("user_id", "category").agg(as_number(F.sum(money("amount"))).alias("amount"))


_ACTUAL = f"""act AS (SELECT user_id, category, CAST(SUM({M('amount')}) AS DOUBLE) AS amount FROM v_transactions
        WHERE type = 'EXPENSE' AND date >= TIMESTAMP '1998-02-01 00:00:00' AND date <= TIMESTAMP '1998-02-28 00:00:00'
        GROUP BY user_id, category)"""

_CLASS_SQL = "(VALUES " + ", ".join(f"('{c}', '{dims.CATEGORY_CLASS[c]}')" for c in dims.CATEGORIES) + ") cl(category, type)"


def _rec_sql(body: str, extra: str = "") -> str:
    rec = f"""rec AS (
  SELECT a.user_id, cl.category, a.monthly_income, a.debt_obligations, a.savings,
         {"CASE cl.category " + " ".join(f"WHEN '{c}' THEN a.{c}" for c in dims.CATEGORIES) + " END"} AS recommended_budget,
         cl.type, x.amount AS actual_spend
  FROM alloc a CROSS JOIN {_CLASS_SQL} LEFT JOIN act x ON x.user_id = a.user_id AND x.category = cl.category),
rec2 AS (SELECT *, CAST({M('actual_spend - recommended_budget')} AS DOUBLE) AS variance FROM rec),
rec3 AS (SELECT *, CASE WHEN actual_spend IS NULL THEN NULL WHEN variance > 0.05 * recommended_budget THEN 'OVERSPENT'
                        WHEN variance < -(0.05 * recommended_budget) THEN 'UNDERSPENT' ELSE 'OPTIMAL' END AS status FROM rec2)"""
    return with_views(body, "v_profiles", "v_transactions",
                      extra_ctes=_alloc_sql() + ",\n" + _ACTUAL + ",\n" + rec + (",\n" + extra if extra else ""))


@query("budget_recommendation", "G2,J14,J15", oracle=_rec_sql(f"""
SELECT user_id, category, recommended_budget, {R('recommended_budget / monthly_income * 100', 1)} AS pct_of_income, type,
       actual_spend, variance, status FROM rec3"""))
def q_budget_recommendation(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    return SC.recommend_budget(_alloc(spark, sf_dir), _feb_actual(db))


@query("budget_rule_totals", "A22", oracle=with_views(f"""
SELECT user_id, needs_amount, wants_amount, savings AS savings_amount,
       {R('needs_amount / monthly_income * 100', 1)} AS needs_pct, {R('wants_amount / monthly_income * 100', 1)} AS wants_pct,
       {R('savings / monthly_income * 100', 1)} AS savings_pct
FROM (SELECT *, CAST({' + '.join(M(c) for c in dims.CATEGORIES if dims.CATEGORY_CLASS[c] == 'needs')} AS DOUBLE) AS needs_amount,
             CAST({' + '.join(M(c) for c in dims.CATEGORIES if dims.CATEGORY_CLASS[c] == 'wants')} AS DOUBLE) AS wants_amount
      FROM alloc)""", "v_profiles", extra_ctes=_alloc_sql()))
def q_budget_rule_totals(spark, sf_dir):
    return SC.rule_totals(_alloc(spark, sf_dir))


_TIP_SUMS = """sums AS (
  SELECT a.user_id, a.savings, COALESCE(x.h, 0) AS h,
         a.monthly_income - COALESCE(x.spent, 0.0) - greatest(0.0, COALESCE(a.debt_obligations, 0.0)) AS act_sav
  FROM alloc a LEFT JOIN (SELECT user_id, COUNT(amount) AS h, CAST(SUM(""" + M("amount") + """) AS DOUBLE) AS spent
                          FROM act GROUP BY user_id) x ON x.user_id = a.user_id),
tips AS (
  SELECT user_id, 0 AS tip_rank, 'You are INR ' || format('{:,.2f}', CAST(""" + M("savings - act_sav") + """ AS DOUBLE))
         || ' short of your desired monthly savings target (INR ' || format('{:,.2f}', savings) || ').' AS tip
  FROM sums WHERE h > 0 AND act_sav < savings
  UNION ALL
  SELECT user_id, CAST(rk AS INTEGER), CASE WHEN type = 'wants'
      THEN 'Discretionary spending in ''' || upper(left(category, 1)) || lower(substr(category, 2)) || ''' exceeded recommended budget by INR '
           || format('{:,.2f}', variance) || '. Reallocate this to Savings to optimize cash flow.'
      ELSE 'Essential spending in ''' || upper(left(category, 1)) || lower(substr(category, 2)) || ''' is INR '
           || format('{:,.2f}', variance) || ' higher than standard benchmarks. Look for subscription or utility optimizations.' END
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY variance DESC, list_position(""" + "[" + ", ".join(f"'{c}'" for c in dims.CATEGORIES) + "]" + """, category)) AS rk
        FROM rec3 WHERE status = 'OVERSPENT') WHERE rk <= 2)"""


@query("budget_tips", "G2,W11,C4,C6,R1", oracle=_rec_sql("""
SELECT * FROM tips
UNION ALL
SELECT user_id, 0, 'Spending habits align well with recommended 50/30/20 benchmarks!' FROM alloc
WHERE user_id NOT IN (SELECT user_id FROM tips)""", _TIP_SUMS))
def q_budget_tips(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    alloc, actual = _alloc(spark, sf_dir), _feb_actual(db)
    return SC.budget_tips(SC.recommend_budget(alloc, actual), alloc, actual, db.profiles())


def _health_input(db: Ledger) -> DataFrame:
    act = _feb_actual(db)
    agg = act.groupBy("user_id").agg(
        as_number(F.sum(money("amount"))).alias("total_expenses"),
        as_number(F.sum(F.when(F.col("category").isin("shopping", "entertainment"), money("amount")))).alias("_disc"),
        as_number(F.sum(F.when(F.col("category") == "bills", money("amount")))).alias("_bills"))
    bal = db.accounts().groupBy("user_id").agg(as_number(F.sum(money("balance"))).alias("current_balance"))
    prof = db.profiles().select("user_id", "monthly_income", "debt_obligations")
    j = prof.join(bal, "user_id", "left").join(agg, "user_id", "left")
    return j.select("user_id", "monthly_income", "debt_obligations",
                    F.coalesce("current_balance", F.lit(0.0)).alias("current_balance"),
                    F.coalesce("total_expenses", F.lit(0.0)).alias("total_expenses"),
                    F.coalesce("_disc", F.lit(0.0)).alias("discretionary_spend"),
                    F.coalesce("_bills", F.lit(0.0)).alias("bills_spend"))


def _pw(x: str) -> str:
    return (f"CASE WHEN {x} <= 0.25 THEN 100.0 WHEN {x} <= 0.35 THEN 85.0 + ((0.35 - {x}) / 0.10) * 15.0 "
            f"WHEN {x} <= 0.50 THEN 55.0 + ((0.50 - {x}) / 0.15) * 30.0 WHEN {x} <= 0.70 THEN 25.0 + ((0.70 - {x}) / 0.20) * 30.0 "
            f"ELSE greatest(0.0, 25.0 - ({x} - 0.70) * 50.0) END")


_HEALTH_CTES = f"""hin AS (
  SELECT p.user_id, p.monthly_income, p.debt_obligations, COALESCE(b.bal, 0.0) AS current_balance,
         COALESCE(a.tot, 0.0) AS total_expenses, COALESCE(a.disc, 0.0) AS discretionary_spend, COALESCE(a.bills, 0.0) AS bills_spend
  FROM v_profiles p
  LEFT JOIN (SELECT user_id, CAST(SUM({M('balance')}) AS DOUBLE) AS bal FROM v_accounts GROUP BY user_id) b ON b.user_id = p.user_id
  LEFT JOIN (SELECT user_id, CAST(SUM({M('amount')}) AS DOUBLE) AS tot,
                    CAST(SUM(CASE WHEN category IN ('shopping', 'entertainment') THEN {M('amount')} END) AS DOUBLE) AS disc,
                    CAST(SUM(CASE WHEN category = 'bills' THEN {M('amount')} END) AS DOUBLE) AS bills
             FROM act GROUP BY user_id) a ON a.user_id = p.user_id),
h1 AS (SELECT *, greatest(0.0, current_balance) AS bal2, greatest(0.0, COALESCE(debt_obligations, 0.0)) AS debt2 FROM hin
       WHERE monthly_income > 0),
h2 AS (SELECT *, greatest(-monthly_income, monthly_income - total_expenses - debt2) / monthly_income AS sr,
              (debt2 + bills_spend) / monthly_income AS fo,
              CASE WHEN total_expenses > 0 THEN discretionary_spend / total_expenses ELSE 0.30 END AS dr,
              bal2 / greatest(100.0, total_expenses + debt2) AS rw,
              (monthly_income - total_expenses - debt2) / monthly_income AS nb FROM h1),
h3 AS (SELECT *,
  CASE WHEN sr >= 0.30 THEN 100.0 WHEN sr >= 0.20 THEN 85.0 + ((sr - 0.20) / 0.10) * 15.0
       WHEN sr >= 0.10 THEN 60.0 + ((sr - 0.10) / 0.10) * 25.0 WHEN sr > 0.0 THEN 30.0 + (sr / 0.10) * 30.0
       ELSE greatest(0.0, 30.0 + sr * 50.0) END AS s_s,
  {_pw('fo')} AS d_s, {_pw('dr')} AS c_s,
  CASE WHEN rw >= 6.0 THEN 100.0 WHEN rw >= 3.0 THEN 80.0 + ((rw - 3.0) / 3.0) * 20.0
       WHEN rw >= 1.0 THEN 50.0 + ((rw - 1.0) / 2.0) * 30.0 WHEN rw > 0.0 THEN rw * 50.0 ELSE 0.0 END AS r_s,
  CASE WHEN nb >= 0.20 THEN 100.0 WHEN nb >= 0.05 THEN 70.0 + ((nb - 0.05) / 0.15) * 30.0
       WHEN nb >= 0.0 THEN 50.0 + (nb / 0.05) * 20.0 ELSE greatest(0.0, 50.0 + nb * 100.0) END AS b_s FROM h2),
h4 AS (SELECT *, greatest(0.0, least(100.0, {R('s_s * 0.25 + d_s * 0.25 + c_s * 0.20 + r_s * 0.15 + b_s * 0.15', 1)})) AS score FROM h3)"""


@query("financial_health", "G3,M2,M3", oracle=with_views(f"""
SELECT user_id, monthly_income, debt_obligations, current_balance, total_expenses, discretionary_spend, bills_spend,
       score AS financial_health_score,
       CASE WHEN score >= 90 THEN 'A+' WHEN score >= 80 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' ELSE 'D' END AS grade,
       CASE WHEN score >= 90 THEN 'EXCEPTIONAL' WHEN score >= 80 THEN 'HEALTHY' WHEN score >= 70 THEN 'GOOD'
            WHEN score >= 55 THEN 'NEEDS_ATTENTION' ELSE 'CRITICAL' END AS status,
       {R('rw', 1)} AS runway_months, {R('sr * 100', 1)} AS savings_rate_pct, {R('s_s', 1)} AS savings_rate_score,
       {R('d_s', 1)} AS debt_score, {R('c_s', 1)} AS discretionary_score, {R('r_s', 1)} AS runway_score, {R('b_s', 1)} AS buffer_score,
       COALESCE(NULLIF(concat_ws(' | ',
         CASE WHEN s_s < 70 THEN 'Boost monthly savings rate (currently ' || CAST({R('sr * 100', 1)} AS VARCHAR) || '%) towards 20% by setting up auto-investments.' END,
         CASE WHEN d_s < 70 THEN 'Fixed obligations and debt take up ' || CAST({R('fo * 100', 1)} AS VARCHAR) || '% of income. Target debt paydown to free up cash flow.' END,
         CASE WHEN c_s < 70 THEN 'Discretionary wants account for ' || CAST({R('dr * 100', 1)} AS VARCHAR) || '% of expenses. Trimming non-essentials can quickly raise your score.' END,
         CASE WHEN r_s < 70 THEN 'Emergency liquidity covers ' || CAST({R('rw', 1)} AS VARCHAR) || ' month(s). Aim for at least 3-6 months of expenses (INR '
              || format('{{:,.2f}}', CAST({M('greatest(100.0, total_expenses + debt2) * 3')} AS DOUBLE)) || ').' END), ''),
         'Excellent financial health! Maintain current investment strategy and emergency runway.') AS recommendations
FROM h4""", "v_profiles", "v_accounts", "v_transactions", extra_ctes=_ACTUAL + ",\n" + _HEALTH_CTES))
def q_financial_health(spark, sf_dir):
    return SC.health_score(_health_input(Ledger(spark, sf_dir))).withColumn(
        "recommendations", F.array_join("recommendations", " | "))


@query("profile_summary", "A33", oracle=with_views("""
SELECT COUNT(*) AS rows, min(monthly_income) AS min_income, max(monthly_income) AS max_income,
       quantile_cont(monthly_income, 0.5) AS median_income FROM v_profiles""", "v_profiles"))
def q_profile_summary(spark, sf_dir):
    """Row count, min, max and (exact, distributed) median income."""
    from ..operators import stats as ST
    p = Ledger(spark, sf_dir).profiles()
    med = ST.exact_quantiles(p, "monthly_income", [0.5])[0]
    return p.agg(F.count("*").alias("rows"), F.min("monthly_income").alias("min_income"),
                 F.max("monthly_income").alias("max_income")).withColumn("median_income", F.lit(float(med)))


@query("scaled_profile_features", "L3", oracle=with_views(f"""
SELECT user_id, {", ".join(f"{R(f'(p.{c} - s.m_{c}) / s.s_{c}')} AS z_{c}" for c in ("monthly_income", "savings_target_pct", "debt_obligations"))}
FROM v_profiles p, (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ("monthly_income", "savings_target_pct", "debt_obligations"))}
                    FROM v_profiles) s""", "v_profiles"))
def q_scaled_profile_features(spark, sf_dir):
    """L3: standard scaling with the population deviation, statistics from
    one aggregate joined back as a broadcast one-row table."""
    cols = ["monthly_income", "savings_target_pct", "debt_obligations"]
    p = Ledger(spark, sf_dir).profiles()
    st = p.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    j = p.withColumn("_k", F.lit(1)).join(F.broadcast(st.withColumn("_k", F.lit(1))), "_k")
    from ..functions.money import round_to
    return j.select("user_id", *[round_to((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}"), 6).alias(f"z_{c}") for c in cols])
