"""Daily series, features, forecasting and cash-flow queries (A10-A12,
A16, A17, A19-A21, A27, J9, J10, J15, W1-W8, W10, D5-D8, F14, F21, S13,
T6, G9-G12, L15).

Series: expense spend per customer nation (25 dense series) and per user
(sparse series, the scale axis of the cash-flow projection).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dims
from ..functions.money import as_number, money, round_to
from ..operators import forecast as FC
from ..operators import metrics as MT
from ..operators import series as S
from ..sources.tables import Ledger
from .oracle_views import M, R, with_views
from .registry import query
from ..session import materialize

HORIZON = 30
OFF_EDGE = 0.0000137
LOOKBACK = 60


def nation_tx(db: Ledger) -> DataFrame:
    c = db.table("customer", "c_custkey", "c_nationkey").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("nation"))
    return db.transactions().filter(F.col("type") == "EXPENSE").join(c, "user_id")


def nation_series(spark, sf_dir) -> DataFrame:
    return S.daily_series(nation_tx(Ledger(spark, sf_dir)), ["nation"])


def nation_features(spark, sf_dir) -> DataFrame:
    """All features; sin/cos and the exponential means rounded only here, to
    compare engines whose last bits differ."""
    # the means of few days are short decimals that end in 5: a shift keeps them off the rounding edge
    f = S.drop_burn_in(S.add_features(nation_series(spark, sf_dir), ["nation"], trig_digits=9))
    return f.withColumns({f"ewm_mean_{sp}": round_to(F.col(f"ewm_mean_{sp}") + OFF_EDGE, 4) for sp in S.EWM_SPANS})


# ------------------------------------------------------------ oracle SQL ---

_CAT_SUM = ", ".join(f"SUM(CASE WHEN category = '{c}' THEN {M('amount')} END) AS s_{c}" for c in dims.CATEGORIES)
_CAT_OUT = ", ".join(f"CAST(COALESCE(d.s_{c}, 0) AS DOUBLE) AS {c}_spend" for c in dims.CATEGORIES)


def _ds_cte(src: str, key: str) -> str:
    """Gap-filled daily series CTE ``ds`` over CTE ``src`` (key, date, amount, category)."""
    return f"""daily AS (
  SELECT {key}, CAST(date AS DATE) AS day, SUM({M('amount')}) AS tot, COUNT(amount) AS n, {_CAT_SUM}
  FROM {src} WHERE date IS NOT NULL AND amount IS NOT NULL AND category IS NOT NULL GROUP BY {key}, CAST(date AS DATE)),
span AS (SELECT {key}, min(day) AS lo, max(day) AS hi FROM daily GROUP BY {key}),
spine AS (SELECT {key}, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
ds AS (SELECT s.{key}, s.day AS date, CAST(COALESCE(d.tot, 0) AS DOUBLE) AS total_spend, COALESCE(d.n, 0) AS tx_count,
              {_CAT_OUT}
       FROM spine s LEFT JOIN daily d ON d.{key} = s.{key} AND d.day = s.day)"""


NATION_SRC = """ntx AS (SELECT c.c_nationkey AS nation, t.date, t.amount, t.category
                FROM v_transactions t JOIN customer c ON c.c_custkey = t.user_id WHERE t.type = 'EXPENSE')"""


def _trig(expr: str) -> str:
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,18)), 9) AS DOUBLE)"


def _feat_cte(key: str) -> str:
    w = f"(PARTITION BY {key} ORDER BY date ROWS BETWEEN {{k}} PRECEDING AND 1 PRECEDING)"
    lags = ", ".join(f"LAG(total_spend, {k}) OVER (PARTITION BY {key} ORDER BY date) AS lag_{k}" for k in S.LAGS)
    lists = ", ".join(f"list(total_spend) OVER {w.format(k=k)} AS l{k}" for k in S.ROLLING_WINDOWS)
    mm = ", ".join(f"MIN(total_spend) OVER {w.format(k=k)} AS rolling_min_{k}, MAX(total_spend) OVER {w.format(k=k)} AS rolling_max_{k}"
                   for k in S.ROLLING_WINDOWS)
    means = ", ".join(f"CASE WHEN len(l{k}) > 0 THEN list_reduce(l{k}, lambda a, x: a + x) / len(l{k}) END AS rolling_mean_{k}"
                      for k in S.ROLLING_WINDOWS)
    stds = ", ".join(
        f"CASE WHEN len(l{k}) > 1 THEN sqrt(list_reduce(list_transform(l{k}, lambda x: (x - rolling_mean_{k}) * (x - rolling_mean_{k})), lambda a, b: a + b) / (len(l{k}) - 1)) ELSE 0.0 END AS rolling_std_{k}"
        for k in S.ROLLING_WINDOWS)
    wall = f"(PARTITION BY {key} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    def decayed(x, r):  # plain prefix sums of x * r^-i: within a double's range up to about 2450 days
        return f"SUM({x} * pow({r!r}, -_i)) OVER {wall}"

    ewm = [f"CASE WHEN _i > 0 THEN {R(decayed('total_spend', 1.0 - 2.0 / (sp + 1)) + ' / ' + decayed('1.0', 1.0 - 2.0 / (sp + 1)) + f' + {OFF_EDGE!r}', 4)} END AS ewm_mean_{sp}"
           for sp in S.EWM_SPANS]
    two_pi = repr(2 * 3.141592653589793)
    return f"""f1 AS (
  SELECT *, isodow(date) - 1 AS day_of_week, day(date) AS day_of_month, month(date) AS month, quarter(date) AS quarter,
         CAST(isodow(date) - 1 >= 5 AS INTEGER) AS is_weekend, CAST(day(date) <= 5 AS INTEGER) AS is_month_start,
         CAST(day(date) >= 25 AS INTEGER) AS is_month_end,
         {_trig(f"sin({two_pi} * (isodow(date) - 1) / 7.0)")} AS sin_dow, {_trig(f"cos({two_pi} * (isodow(date) - 1) / 7.0)")} AS cos_dow,
         {_trig(f"sin({two_pi} * month(date) / 12.0)")} AS sin_month, {_trig(f"cos({two_pi} * month(date) / 12.0)")} AS cos_month,
         {_trig(f"sin({two_pi} * day(date) / 31.0)")} AS sin_dom, {_trig(f"cos({two_pi} * day(date) / 31.0)")} AS cos_dom,
         greatest(least(day(date) - 1, 30 - day(date)), 0) AS days_to_payday,
         {lags}, {lists}, {mm}, CAST(ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY date) - 1 AS DOUBLE) AS _i
  FROM ds),
f2 AS (SELECT *, {means} FROM f1),
feat_all AS (SELECT * EXCLUDE ({", ".join(f"l{k}" for k in S.ROLLING_WINDOWS)}, _i), {stds}, {", ".join(ewm)} FROM f2),
feat AS (SELECT * FROM feat_all WHERE lag_30 IS NOT NULL)"""


def _nation_sql(body: str, extra: str = "", recursive: bool = False) -> str:
    ctes = NATION_SRC + ",\n" + _ds_cte("ntx", "nation") + (",\n" + extra if extra else "")
    return with_views(body, "v_transactions", extra_ctes=ctes, recursive=recursive)


# --------------------------------------------------------------- queries ---

@query("daily_series_nation", "A10,A11,J9,J10,F13", oracle=_nation_sql("SELECT * FROM ds"))
def q_daily_series(spark, sf_dir):
    return nation_series(spark, sf_dir)


@query("series_features_nation", "W1,W2,W3,D5,D6,D7,F14,F21", oracle=_nation_sql("SELECT * FROM feat", _feat_cte("nation")))
def q_series_features(spark, sf_dir):
    return nation_features(spark, sf_dir)


@query("series_split_nation", "W8", oracle=_nation_sql("""
SELECT nation, date, CASE WHEN ROW_NUMBER() OVER (PARTITION BY nation ORDER BY date)
                              <= floor(COUNT(*) OVER (PARTITION BY nation) * 0.8) THEN 'train' ELSE 'test' END AS split
FROM feat""", _feat_cte("nation")))
def q_series_split(spark, sf_dir):
    return S.chronological_split(nation_features(spark, sf_dir), ["nation"]).select("nation", "date", "split")


@query("series_cv_blocks", "W10", oracle=_nation_sql("""
SELECT nation, date, CAST(CASE WHEN sz > 0 AND rn > n - sz * 5 THEN floor((rn - (n - sz * 5) - 1) / sz) ELSE -1 END AS INTEGER) AS cv_block
FROM (SELECT nation, date, ROW_NUMBER() OVER (PARTITION BY nation ORDER BY date) AS rn,
             COUNT(*) OVER (PARTITION BY nation) AS n, floor(COUNT(*) OVER (PARTITION BY nation) / 6) AS sz FROM feat)""",
    _feat_cte("nation")))
def q_series_cv_blocks(spark, sf_dir):
    return S.expanding_folds(nation_features(spark, sf_dir), ["nation"]).select("nation", "date", "cv_block")


@query("series_summary_nation", "A17", oracle=_nation_sql(f"""
SELECT nation, min(date) AS start_date, max(date) AS end_date, COUNT(total_spend) AS rows,
       CAST(SUM({M('total_spend')}) AS DOUBLE) / COUNT(total_spend) AS mean, {R('stddev_samp(total_spend)', 4)} AS std
FROM ds GROUP BY nation"""))
def q_series_summary(spark, sf_dir):
    return S.series_summary(nation_series(spark, sf_dir), ["nation"])


@query("recent_history_nation", "S13,T6", oracle=_nation_sql("""
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY nation ORDER BY date DESC) AS rn FROM ds) WHERE rn <= 60""").replace(
    "SELECT * FROM (SELECT *, ROW_NUMBER()", "SELECT * EXCLUDE (rn) FROM (SELECT *, ROW_NUMBER()"))
def q_recent_history(spark, sf_dir):
    return S.recent_history(nation_series(spark, sf_dir), ["nation"], LOOKBACK)


@query("category_shares_user", "A12,J15", oracle=with_views(f"""
SELECT k.user_id, k.category,
       CASE WHEN COALESCE(SUM(p.amt) OVER (PARTITION BY k.user_id), 0) > 0
            THEN CAST(COALESCE(p.amt, 0) AS DOUBLE) / CAST(SUM(p.amt) OVER (PARTITION BY k.user_id) AS DOUBLE) ELSE 0.14 END AS ratio
FROM (SELECT u.user_id, c.category FROM (SELECT DISTINCT user_id FROM v_transactions WHERE type = 'EXPENSE') u,
      (VALUES {", ".join(f"('{c}')" for c in dims.CATEGORIES)}) c(category)) k
LEFT JOIN (SELECT user_id, category, SUM({M('amount')}) AS amt FROM v_transactions WHERE type = 'EXPENSE'
           GROUP BY user_id, category) p ON p.user_id = k.user_id AND p.category = k.category""", "v_transactions"))
def q_category_shares(spark, sf_dir):
    t = Ledger(spark, sf_dir).transactions().filter(F.col("type") == "EXPENSE")
    return S.category_shares(t, ["user_id"])


# --- seasonal baseline: fit on the train split, evaluate on the test split ---

_SPLIT = """sp AS (SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY nation ORDER BY date)
                          <= floor(COUNT(*) OVER (PARTITION BY nation) * 0.8) THEN 'train' ELSE 'test' END AS split FROM feat)"""


def _fit_cte(src: str, key: str, name: str = "mdl") -> str:
    return f"""{name}_gm AS (SELECT {key}, CAST(SUM({M('total_spend')}) AS DOUBLE) / COUNT(total_spend) AS global_mean FROM {src} GROUP BY {key}),
{name}_dm AS (SELECT {key}, isodow(date) - 1 AS dow, CAST(SUM({M('total_spend')}) AS DOUBLE) / COUNT(total_spend) AS dmean
          FROM {src} GROUP BY {key}, isodow(date) - 1),
{name} AS (SELECT g.{key}, d.dow, g.global_mean, COALESCE(x.dmean, g.global_mean) / (g.global_mean + 1e-6) AS multiplier
           FROM {name}_gm g CROSS JOIN range(0, 7) d(dow) LEFT JOIN {name}_dm x ON x.{key} = g.{key} AND x.dow = d.dow)"""


_PRED = """pred AS (SELECT s.nation, s.date, s.total_spend AS y,
                   greatest(0.0, COALESCE(s.rolling_mean_7, m.global_mean) * m.multiplier) AS p
            FROM sp s JOIN mdl m ON m.nation = s.nation AND m.dow = isodow(s.date) - 1 WHERE s.split = 'test')"""


def _seasonal_eval(spark, sf_dir):
    f = materialize(S.chronological_split(nation_features(spark, sf_dir), ["nation"]))
    model = FC.seasonal_model(FC.seasonal_fit(f.filter(F.col("split") == "train"), ["nation"]), ["nation"])
    pred = FC.seasonal_predict(f.filter(F.col("split") == "test"), model, ["nation"])
    return pred.select("nation", "date", F.col("total_spend").alias("y"), F.col("prediction").alias("p"))


@query("seasonal_multipliers", "A16", oracle=_nation_sql(
    "SELECT nation, CAST(dow AS INTEGER) AS dow, global_mean, multiplier FROM mdl",
    _feat_cte("nation") + ",\n" + _SPLIT + ",\n" + _fit_cte("(SELECT * FROM sp WHERE split = 'train')", "nation")))
def q_seasonal_multipliers(spark, sf_dir):
    f = materialize(S.chronological_split(nation_features(spark, sf_dir), ["nation"]))
    return FC.seasonal_fit(f.filter(F.col("split") == "train"), ["nation"]).withColumn("dow", F.col("dow").cast("int"))


@query("seasonal_forecast_eval", "G9,A27,L15", oracle=_nation_sql(f"""
SELECT nation, COUNT(*) AS n, {R('avg(abs(y - p))')} AS mae, {R('sqrt(avg((y - p) * (y - p)))')} AS rmse,
       {R('CASE WHEN sst > 0 THEN 1 - sse / sst END')} AS r2, {R('max(abs(y - p))')} AS max_error,
       {R('COALESCE(avg(CASE WHEN y > 1.0 THEN abs((y - p) / y) END) * 100.0, 0.0)')} AS mape
FROM (SELECT *, SUM((y - p) * (y - p)) OVER (PARTITION BY nation) AS sse,
             SUM((y - ybar) * (y - ybar)) OVER (PARTITION BY nation) AS sst
      FROM (SELECT *, avg(y) OVER (PARTITION BY nation) AS ybar FROM pred))
GROUP BY nation, sse, sst""", _feat_cte("nation") + ",\n" + _SPLIT + ",\n"
    + _fit_cte("(SELECT * FROM sp WHERE split = 'train')", "nation") + ",\n" + _PRED))
def q_seasonal_eval(spark, sf_dir):
    return MT.regression_metrics(_seasonal_eval(spark, sf_dir), ["nation"])


@query("forecast_direction", "W6,L15", oracle=_nation_sql(f"""
SELECT nation, CASE WHEN COUNT(ok) > 0 THEN {R('COUNT(*) FILTER (WHERE ok) / COUNT(ok) * 100.0')} ELSE 0.0 END AS directional_accuracy
FROM (SELECT nation, sign(y - LAG(y) OVER w) = sign(p - LAG(p) OVER w) AS ok FROM pred
      WINDOW w AS (PARTITION BY nation ORDER BY date)) GROUP BY nation""",
    _feat_cte("nation") + ",\n" + _SPLIT + ",\n" + _fit_cte("(SELECT * FROM sp WHERE split = 'train')", "nation")
    + ",\n" + _PRED))
def q_forecast_direction(spark, sf_dir):
    return MT.directional_accuracy(_seasonal_eval(spark, sf_dir), ["nation"], "date")


# --- recursive 30-day projection per nation, model fit on the whole series ---

def _nation_forecast(spark, sf_dir):
    s = materialize(nation_series(spark, sf_dir))
    model = FC.seasonal_model(FC.seasonal_fit(s, ["nation"]), ["nation"])
    return FC.recursive_forecast(s, model, ["nation"], HORIZON, LOOKBACK)


def _rec_ctes(key: str, series: str = "ds") -> str:
    """DuckDB twin of ``recursive_forecast`` (same fold order, same rounding)."""
    return f"""hist AS (SELECT {key}, list(total_spend ORDER BY date) AS h, max(date) AS last_date FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY date DESC) AS rn FROM {series}) WHERE rn <= {LOOKBACK} GROUP BY {key}),
{_fit_cte(series, key, "fm")},
fmodel AS (SELECT {key}, min(global_mean) AS global_mean, list(multiplier ORDER BY dow) AS mults FROM fm GROUP BY {key}),
base AS (SELECT h.{key}, h.h, h.last_date, m.global_mean, m.mults FROM hist h JOIN fmodel m ON m.{key} = h.{key}),
rec({key}, i, h, pred, sd) AS (
  SELECT {key}, 0, h, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM base
  UNION ALL
  SELECT {key}, i + 1, list_append(h, p), p, sd FROM (
    SELECT r.{key}, r.i, r.h, q.p, q.sd FROM rec r JOIN base b ON b.{key} = r.{key},
    LATERAL (SELECT greatest(0.0, CASE WHEN k > 0 THEN m ELSE b.global_mean END
                             * b.mults[isodow(b.last_date + CAST(r.i + 1 AS INTEGER)) - 1 + 1]) AS p,
                    CASE WHEN k > 1 THEN sqrt(list_reduce(list_transform(w7, lambda x: (x - m) * (x - m)), lambda a, c: a + c) / (k - 1))
                         ELSE 0.0 END AS sd
             FROM (SELECT w7, k, CASE WHEN k > 0 THEN list_reduce(w7, lambda a, x: a + x) / k END AS m
                   FROM (SELECT list_slice(r.h, greatest(len(r.h) - 6, 1), len(r.h)) AS w7,
                                len(list_slice(r.h, greatest(len(r.h) - 6, 1), len(r.h))) AS k))) q
    WHERE r.i < {HORIZON})),
fc AS (SELECT r.{key}, CAST(r.i AS INTEGER) AS step, CAST(b.last_date + CAST(r.i AS INTEGER) AS DATE) AS date,
              strftime(b.last_date + CAST(r.i AS INTEGER), '%A') AS day_name,
              CAST({M('r.pred')} AS DOUBLE) AS predicted_spend,
              CAST({M('greatest(0.0, r.pred - 1.28 * r.sd)')} AS DOUBLE) AS lower_bound_80,
              CAST({M('r.pred + 1.28 * r.sd')} AS DOUBLE) AS upper_bound_80
       FROM rec r JOIN base b ON b.{key} = r.{key} WHERE r.i > 0)"""


@query("expense_forecast_nation", "G10,D10", oracle=_nation_sql("SELECT * FROM fc", _rec_ctes("nation"), recursive=True))
def q_expense_forecast(spark, sf_dir):
    return _nation_forecast(spark, sf_dir)


@query("forecast_weekly_nation", "A19", oracle=_nation_sql(f"""
SELECT nation, CAST(floor((step - 1) / 7) + 1 AS INTEGER) AS week_number, min(date) AS start_date, max(date) AS end_date,
       CAST(SUM({M('predicted_spend')}) AS DOUBLE) AS total_spend
FROM fc GROUP BY nation, floor((step - 1) / 7)""", _rec_ctes("nation"), recursive=True))
def q_forecast_weekly(spark, sf_dir):
    return FC.weekly_summary(_nation_forecast(spark, sf_dir), ["nation"])


_SHARES_SQL = "(VALUES " + ", ".join(f"('{c}', {v})" for c, v in dims.FORECAST_SHARES.items()) + ") sh(category, share)"


@query("forecast_categories_nation", "G11,A20", oracle=_nation_sql(f"""
SELECT nation, category, CAST({M('amt / cat_total * tot')} AS DOUBLE) AS amount, {R('amt / cat_total * 100.0', 1)} AS percentage
FROM (SELECT *, CAST(SUM({M('amt')}) OVER (PARTITION BY nation) AS DOUBLE) AS cat_total FROM (
        SELECT t.nation, t.tot, sh.category, CAST({M('t.tot * sh.share')} AS DOUBLE) AS amt
        FROM (SELECT nation, CAST(SUM({M('predicted_spend')}) AS DOUBLE) AS tot FROM fc GROUP BY nation) t, {_SHARES_SQL}))
WHERE cat_total > 0""", _rec_ctes("nation"), recursive=True))
def q_forecast_categories(spark, sf_dir):
    tot = FC.forecast_totals(_nation_forecast(spark, sf_dir), ["nation"], HORIZON)
    return FC.category_split(tot, ["nation"])


@query("forecast_totals_nation", "G10,A19", oracle=_nation_sql(f"""
SELECT nation, min(date) AS start_date, max(date) AS end_date, CAST(SUM({M('predicted_spend')}) AS DOUBLE) AS total_predicted_expense,
       CAST({M(f'CAST(SUM({M("predicted_spend")}) AS DOUBLE) / {HORIZON}')} AS DOUBLE) AS daily_average_expense
FROM fc GROUP BY nation""", _rec_ctes("nation"), recursive=True))
def q_forecast_totals(spark, sf_dir):
    return FC.forecast_totals(_nation_forecast(spark, sf_dir), ["nation"], HORIZON)


# --- per-user cash flow: model of the whole history, recursion from the last 60 days ---

def cash_params(db: Ledger) -> DataFrame:
    prof = db.profiles().select("user_id", "monthly_income")
    bal = db.accounts().groupBy("user_id").agg(as_number(F.sum(money("balance"))).alias("current_balance"))
    pay = F.when(F.col("user_id") % 3 == 0, 1).when(F.col("user_id") % 3 == 1, 15).otherwise(30)
    return prof.join(bal, "user_id").withColumn("payday", pay)


def _user_cash_flow(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    spent = db.transactions().filter((F.col("type") == "EXPENSE") & F.col("category").isNotNull())
    model = FC.seasonal_model(FC.seasonal_fit_sparse(spent, ["user_id"]), ["user_id"])
    daily = materialize(FC.recursive_forecast(S.recent_daily(spent, ["user_id"], LOOKBACK), model, ["user_id"], HORIZON, LOOKBACK))
    return FC.cash_flow(daily, cash_params(db), ["user_id"])


USER_SRC = "utx AS (SELECT user_id, date, amount, category FROM v_transactions WHERE type = 'EXPENSE')"

CASH_PARAMS = f"""params AS (
  SELECT p.user_id, p.monthly_income, b.current_balance,
         CASE WHEN p.user_id % 3 = 0 THEN 1 WHEN p.user_id % 3 = 1 THEN 15 ELSE 30 END AS payday
  FROM v_profiles p JOIN (SELECT user_id, CAST(SUM({M('balance')}) AS DOUBLE) AS current_balance FROM v_accounts GROUP BY user_id) b
    ON b.user_id = p.user_id),
traj AS (
  SELECT f.user_id, f.step, f.date, p.current_balance, f.predicted_spend,
         CASE WHEN day(f.date) = p.payday OR (p.payday > 28 AND f.date = last_day(f.date)) THEN {M('p.monthly_income')}
              ELSE CAST(0 AS DECIMAL(18,2)) END AS inc
  FROM fc f JOIN params p ON p.user_id = f.user_id),
traj2 AS (SELECT *, inc - {M('predicted_spend')} AS net,
                 {M('current_balance')} + SUM(inc - {M('predicted_spend')}) OVER (PARTITION BY user_id ORDER BY step
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bal FROM traj)"""


def _user_sql(body: str) -> str:
    ctes = USER_SRC + ",\n" + _ds_cte("utx", "user_id") + ",\n" + _rec_ctes("user_id") + ",\n" + CASH_PARAMS
    return with_views(body, "v_users", "v_accounts", "v_transactions", "v_profiles", extra_ctes=ctes, recursive=True)


@query("cash_flow_trajectory", "G12,W4,D8", oracle=_user_sql("""
SELECT user_id, step, date, CAST(inc AS DOUBLE) AS income, predicted_spend AS expense, CAST(net AS DOUBLE) AS net_flow,
       CAST(bal AS DOUBLE) AS projected_balance FROM traj2"""))
def q_cash_flow_trajectory(spark, sf_dir):
    traj, _ = _user_cash_flow(spark, sf_dir)
    return traj


@query("cash_flow_summary", "G12,A21,W4,W5,M3", oracle=_user_sql(f"""
SELECT user_id, initial_balance, CAST(ti AS DOUBLE) AS projected_total_income, CAST(te AS DOUBLE) AS projected_total_expense,
       CAST(ti - te AS DOUBLE) AS projected_net_savings, rate AS savings_rate_pct, CAST(fin AS DOUBLE) AS final_projected_balance,
       CAST(least({M('initial_balance')}, mn) AS DOUBLE) AS minimum_projected_balance, first_deficit_date,
       CASE WHEN first_deficit_date IS NOT NULL THEN 'Risk of Cash Deficit' WHEN rate >= 20.0 THEN 'Healthy Surplus'
            ELSE 'Tight Budget' END AS health_status,
       CASE WHEN first_deficit_date IS NOT NULL THEN 'Alert: Projected balance goes negative around ' || CAST(first_deficit_date AS VARCHAR)
                 || '. Consider reducing discretionary spending.'
            WHEN rate >= 20.0 THEN 'Excellent! Projected savings rate is ' || CAST(CAST(rate AS DOUBLE) AS VARCHAR)
                 || '%. You have room to allocate funds towards savings or investments.'
            ELSE 'Moderate cash flow. Projected savings rate is ' || CAST(CAST(rate AS DOUBLE) AS VARCHAR) || '%. Monitor high-spend categories.' END
         AS recommendation
FROM (SELECT user_id, min(current_balance) AS initial_balance, SUM(inc) AS ti, SUM({M('predicted_spend')}) AS te,
             arg_max(bal, step) AS fin, min(bal) AS mn, min(CASE WHEN bal < 0 THEN date END) AS first_deficit_date,
             CASE WHEN SUM(inc) > 0 THEN {R('CAST(SUM(inc) - SUM(' + M('predicted_spend') + ') AS DOUBLE) / CAST(SUM(inc) AS DOUBLE) * 100.0', 1)}
                  ELSE 0.0 END AS rate
      FROM traj2 GROUP BY user_id)"""))
def q_cash_flow_summary(spark, sf_dir):
    _, summary = _user_cash_flow(spark, sf_dir)
    return summary

