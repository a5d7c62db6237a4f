"""Forecasting and cash-flow operators.

Many series are forecast at once: each series' recent history (at most
``lookback`` values) becomes one row, and the recursive h-step projection
runs in ``mapInPandas`` with numpy over all series of an Arrow batch at
once (a 7-value state per series), so millions of series run in parallel
on whatever executors hold their rows.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DateType, DoubleType, IntegerType, StructField, StructType

from ..functions import dims
from ..functions.dates import day_name, is_payday
from ..functions.money import as_number, money, round_to
from .series import recent_history

EPS = 1e-6
BAND_Z = 1.28


def seasonal_fit(train: DataFrame, keys: list[str], target: str = "total_spend",
                 date: str = "date") -> DataFrame:
    """Per series the global mean and the 7 day-of-week multipliers
    mean(y | dow) / (global mean + 1e-6); a weekday without data gets the
    global mean.  Means come from exact decimal sums."""
    dow = F.weekday(date)
    gm = train.groupBy(*keys).agg((as_number(F.sum(money(target))) / F.count(target)).alias("global_mean"))
    dm = train.groupBy(*keys, dow.alias("dow")).agg(
        (as_number(F.sum(money(target))) / F.count(target)).alias("_dm"))
    spine = gm.withColumn("dow", F.explode(F.sequence(F.lit(0), F.lit(6))))
    j = spine.join(dm, keys + ["dow"], "left")
    return j.select(*keys, "dow", "global_mean",
                    (F.coalesce("_dm", "global_mean") / (F.col("global_mean") + EPS)).alias("multiplier"))


def seasonal_fit_sparse(daily: DataFrame, keys: list[str], amount: str = "amount", date: str = "date") -> DataFrame:
    """A16 from transactions instead of a gap-filled series: days without rows
    count as zero, and how often each weekday falls between a series' first and
    last day follows from the two dates, so no calendar is materialised."""
    t = daily.filter(F.col(date).isNotNull() & F.col(amount).isNotNull() & ~F.isnan(amount))
    day = F.to_date(date)
    per = t.groupBy(*keys, F.weekday(day).alias("dow")).agg(
        F.sum(money(amount)).alias("_s"), F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    span = per.groupBy(*keys).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("_s").alias("_all"))
    span = span.withColumn("_n", F.datediff("_hi", "_lo") + 1).withColumn("global_mean", as_number("_all") / F.col("_n"))
    spine = span.withColumn("dow", F.explode(F.sequence(F.lit(0), F.lit(6))))
    ahead = F.pmod(F.col("dow") - F.weekday("_lo"), F.lit(7))
    times = F.when(ahead < F.col("_n"), F.floor((F.col("_n") - 1 - ahead) / 7) + 1)
    j = spine.join(per.select(*keys, "dow", "_s"), keys + ["dow"], "left")
    mean = as_number(F.coalesce("_s", F.lit(0).cast("decimal(18,2)"))) / times
    return j.select(*keys, "dow", "global_mean",
                    (F.coalesce(mean, "global_mean") / (F.col("global_mean") + EPS)).alias("multiplier"))


def seasonal_model(fit: DataFrame, keys: list[str]) -> DataFrame:
    """One row per series: global mean and the multipliers as an array
    indexed by weekday (Monday first)."""
    return fit.groupBy(*keys).agg(
        F.first("global_mean").alias("global_mean"),
        F.transform(F.sort_array(F.collect_list(F.struct("dow", "multiplier"))), lambda s: s["multiplier"])
        .alias("multipliers"))


def seasonal_predict(features: DataFrame, model: DataFrame, keys: list[str],
                     date: str = "date") -> DataFrame:
    """base = rolling_mean_7, else the series' global mean; times the
    weekday multiplier; floored at 0."""
    j = features.join(model, keys, "inner")
    base = F.coalesce(F.col("rolling_mean_7"), F.col("global_mean"))
    mult = F.element_at(F.col("multipliers"), F.weekday(date) + 1)
    return j.withColumn("prediction", F.greatest(F.lit(0.0), base * mult)).drop("global_mean", "multipliers")


def seasonal_fit_folds(f: DataFrame, keys: list[str], target: str = "total_spend", date: str = "date",
                       block: str = "cv_block") -> DataFrame:
    """A16 refitted for every expanding fold (W10) from one pass: exact sums by
    block and weekday, added up over the earlier blocks, so that fold ``k`` has
    the model of all rows before it.  One row a series and fold."""
    days = f.groupBy(*keys, block, F.weekday(date).alias("dow")).agg(F.sum(money(target)).alias("_s"), F.count(target).alias("_n"))
    wide = days.groupBy(*keys, block).pivot("dow", list(range(7))).agg(F.first("_s").alias("s"), F.first("_n").alias("n"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{d}_{c}": F.sum(f"{d}_{c}").over(before) for d in range(7) for c in "sn"}
    w = wide.withColumns(sums).where(F.col(block) >= 0)
    s = [F.coalesce(F.col(f"{d}_s"), F.lit(0).cast("decimal(38,2)")) for d in range(7)]
    n = [F.coalesce(F.col(f"{d}_n"), F.lit(0)) for d in range(7)]
    total, count = s[0], n[0]
    for d in range(1, 7):
        total, count = total + s[d], count + n[d]
    w = w.withColumn("global_mean", F.when(count > 0, as_number(total) / count)).where("global_mean is not null")
    mean = [F.when(F.coalesce(F.col(f"{d}_n"), F.lit(0)) > 0, as_number(F.col(f"{d}_s")) / F.col(f"{d}_n")) for d in range(7)]
    mults = [F.coalesce(m, F.col("global_mean")) / (F.col("global_mean") + EPS) for m in mean]
    return w.select(*keys, block, "global_mean", F.array(*mults).alias("multipliers"))


def seasonal_predict_folds(f: DataFrame, keys: list[str], date: str = "date", block: str = "cv_block") -> DataFrame:
    """G9 on every validation row, by the model of the rows before its fold."""
    model = seasonal_fit_folds(f, keys, date=date, block=block)
    return seasonal_predict(f.where(F.col(block) >= 0), model, [*keys, block], date)


def _project_batches(keys: list[str], horizon: int):
    """Vectorised recursion for a batch of series (numpy inside the task).

    The state is the 7 latest values per series, oldest first, NaN-padded on
    the left for short histories.  Sums are accumulated left to right from
    0, exactly like the SQL folds, so results are bit-identical."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            st = pdf[[f"h{j}" for j in range(7)]].to_numpy(dtype=float)
            gm = pdf["global_mean"].to_numpy(dtype=float)
            mults = pdf[[f"m{j}" for j in range(7)]].to_numpy(dtype=float)
            dow0 = pd.to_datetime(pdf["last_date"]).dt.weekday.to_numpy()
            rows = np.arange(n)
            preds, sds = np.empty((horizon, n)), np.empty((horizon, n))
            for i in range(1, horizon + 1):
                valid = ~np.isnan(st)
                k = valid.sum(axis=1)
                tot = np.zeros(n)
                for j in range(7):
                    tot = np.where(valid[:, j], tot + st[:, j], tot)
                with np.errstate(invalid="ignore", divide="ignore"):
                    m = tot / k
                base = np.where(k > 0, m, gm)
                pred = np.maximum(0.0, base * mults[rows, (dow0 + i) % 7])
                ssd = np.zeros(n)
                for j in range(7):
                    d = st[:, j] - m
                    ssd = np.where(valid[:, j], ssd + d * d, ssd)
                with np.errstate(invalid="ignore", divide="ignore"):
                    sd = np.where(k > 1, np.sqrt(ssd / (k - 1)), 0.0)
                preds[i - 1], sds[i - 1] = pred, sd
                st[:, :-1] = st[:, 1:]
                st[:, -1] = pred
            out = {c: np.repeat(pdf[c].to_numpy(), horizon) for c in keys}
            out["last_date"] = np.repeat(pdf["last_date"].to_numpy(), horizon)
            out["step"] = np.tile(np.arange(1, horizon + 1, dtype=np.int32), n)
            out["pred"] = preds.T.reshape(-1)
            out["sd"] = sds.T.reshape(-1)
            yield pd.DataFrame(out)
    return run


def recursive_forecast(series: DataFrame, model: DataFrame, keys: list[str], horizon: int = 30,
                       lookback: int = 60, target: str = "total_spend", date: str = "date") -> DataFrame:
    """H-day recursive projection of the seasonal model.

    Each step predicts from the 7 latest values (history plus earlier
    predictions, which are appended unrounded), with an 80 % band of
    +/- 1.28 x the sample std of those 7 values, floored at 0.  Output: one
    row per (series, step) with the rounded prediction and band.
    """
    hist = recent_history(series.select(*keys, date, target), keys, min(lookback, 7), date)  # a step reads 7 values
    last = F.sort_array(F.collect_list(F.struct(date, target)))
    g = hist.groupBy(*keys).agg(F.max(date).alias("last_date"),
                                F.transform(last, lambda s: s[target].cast("double")).alias("_h"))
    g = g.join(model, keys, "inner")
    # one column a value: the 7 latest, oldest first, and the 7 weekday multipliers
    g = g.select(*keys, "last_date", "global_mean",
                 *[F.try_element_at("_h", F.size("_h") - F.lit(6 - j)).alias(f"h{j}") if j == 6 else
                   F.when(F.size("_h") >= 7 - j, F.try_element_at("_h", F.greatest(F.size("_h") - F.lit(6 - j), F.lit(1)))).alias(f"h{j}")
                   for j in range(7)],
                 *[F.element_at("multipliers", j + 1).alias(f"m{j}") for j in range(7)])

    schema = StructType([f for f in g.schema.fields if f.name in keys] + [
        StructField("last_date", DateType()), StructField("step", IntegerType()),
        StructField("pred", DoubleType()), StructField("sd", DoubleType())])
    res = g.mapInPandas(_project_batches(keys, horizon), schema)
    d = F.date_add("last_date", F.col("step"))
    pred, sd = F.col("pred"), F.col("sd")
    return res.select(*keys, "step", d.alias("date"), day_name(d).alias("day_name"),
                    as_number(money(pred)).alias("predicted_spend"),
                    as_number(money(F.greatest(F.lit(0.0), pred - BAND_Z * sd))).alias("lower_bound_80"),
                    as_number(money(pred + BAND_Z * sd)).alias("upper_bound_80"))


def weekly_summary(daily: DataFrame, keys: list[str]) -> DataFrame:
    """7-day chunks of the horizon: number, first/last date, total."""
    wk = (F.floor((F.col("step") - 1) / 7) + 1).cast("int")
    return daily.groupBy(*keys, wk.alias("week_number")).agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"),
        as_number(F.sum(money("predicted_spend"))).alias("total_spend"))


def forecast_totals(daily: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """Total and daily average of the rounded daily predictions."""
    return daily.groupBy(*keys).agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"),
        as_number(F.sum(money("predicted_spend"))).alias("total_predicted_expense")) \
        .withColumn("daily_average_expense", as_number(money(F.col("total_predicted_expense") / horizon)))


def category_split(totals: DataFrame, keys: list[str], shares: dict | None = None) -> DataFrame:
    """G11 + A20: fallback shares applied to the total, then normalised so
    the parts add up to the total (amount 2 dp, percentage 1 dp).

    The fixed share list is exploded on each series row (no join); a zero
    total yields no rows."""
    sh = shares or dims.FORECAST_SHARES
    arr = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(v).alias("share")) for c, v in sh.items()])
    e = totals.select(*keys, "total_predicted_expense", F.explode(arr).alias("c"))
    e = e.select(*keys, "total_predicted_expense", F.col("c.category").alias("category"),
                 as_number(money(F.col("total_predicted_expense") * F.col("c.share"))).alias("_amt"))
    tot = F.sum(money("_amt")).over(Window.partitionBy(*keys)) if keys else F.sum(money("_amt")).over(Window.partitionBy())
    e = e.withColumn("_cat_total", as_number(tot)).filter(F.col("_cat_total") > 0)
    ratio = F.col("_amt") / F.col("_cat_total")
    return e.select(*keys, "category",
                    as_number(money(ratio * F.col("total_predicted_expense"))).alias("amount"),
                    round_to(ratio * 100.0, 1).alias("percentage"))


def cash_flow(daily: DataFrame, params: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Balance trajectory and summary per series.

    ``params`` has (keys, monthly_income, current_balance, payday).  Income
    is credited on the payday (or on the month's last day when payday > 28);
    the balance is the start plus a running sum of net flow; the minimum
    includes the start; the first negative day is reported.
    """
    j = daily.join(params, keys, "inner")
    income = F.when(is_payday("date", F.col("payday")), money("monthly_income")).otherwise(F.lit(0).cast("decimal(18,2)"))
    j = j.withColumn("_inc", income).withColumn("_net", F.col("_inc") - money("predicted_spend"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("step") \
        .rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("_bal", money("current_balance") + F.sum("_net").over(w))
    traj = j.select(*keys, "step", "date", as_number("_inc").alias("income"),
                    F.col("predicted_spend").alias("expense"), as_number("_net").alias("net_flow"),
                    as_number("_bal").alias("projected_balance"))
    s = j.groupBy(*keys).agg(
        F.first("current_balance").alias("initial_balance"),
        F.sum("_inc").alias("_ti"), F.sum(money("predicted_spend")).alias("_te"),
        F.max_by("_bal", "step").alias("_final"), F.min("_bal").alias("_min"),
        F.min(F.when(F.col("_bal") < 0, F.col("date"))).alias("first_deficit_date"))
    rate = F.when(F.col("_ti") > 0, round_to(as_number(F.col("_ti") - F.col("_te")) / as_number("_ti") * 100.0, 1)
                  ).otherwise(F.lit(0.0))
    summary = s.select(
        *keys, "initial_balance",
        as_number("_ti").alias("projected_total_income"), as_number("_te").alias("projected_total_expense"),
        as_number(F.col("_ti") - F.col("_te")).alias("projected_net_savings"),
        rate.alias("savings_rate_pct"),
        as_number("_final").alias("final_projected_balance"),
        as_number(F.least(money("initial_balance"), F.col("_min"))).alias("minimum_projected_balance"),
        "first_deficit_date")
    summary = summary.withColumn(
        "health_status",
        F.when(F.col("first_deficit_date").isNotNull(), "Risk of Cash Deficit")
         .when(F.col("savings_rate_pct") >= 20.0, "Healthy Surplus").otherwise("Tight Budget"))
    rate = F.col("savings_rate_pct").cast("string")
    summary = summary.withColumn("recommendation", F.when(
        F.col("first_deficit_date").isNotNull(),
        F.concat(F.lit("Alert: Projected balance goes negative around "), F.col("first_deficit_date").cast("string"),
                 F.lit(". Consider reducing discretionary spending."))
    ).when(F.col("savings_rate_pct") >= 20.0,
           F.concat(F.lit("Excellent! Projected savings rate is "), rate,
                    F.lit("%. You have room to allocate funds towards savings or investments."))
    ).otherwise(F.concat(F.lit("Moderate cash flow. Projected savings rate is "), rate,
                         F.lit("%. Monitor high-spend categories."))))
    return traj, summary
