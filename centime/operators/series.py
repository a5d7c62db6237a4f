"""Daily spend series and their features (A10-A12, A17, J9, J10, J15, W1-W3,
W8, W10, D5-D7, F14, F21, S13).

A series is keyed by any set of columns (a user, a nation, or none for one
global series).  Raw transactions are first aggregated to one row per
(series, day) — partial aggregation, so a hot series costs one row per day —
and every window afterwards runs over that small daily table, partitioned by
the series key (never an unpartitioned window).

Money sums are exact decimals; rolling means and deviations are computed from
exact decimal sums, so the results do not depend on how partitions combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dims
from ..functions.dates import calendar_features
from ..functions.money import as_number, money, round_to

LAGS = [1, 2, 3, 7, 14, 21, 30]
ROLLING_WINDOWS = [7, 14, 30]
EWM_SPANS = (7, 30)
EWM_BLOCK = 512


def feature_names() -> list[str]:
    """the 35 model features, in the reference's order."""
    names = ["day_of_week", "day_of_month", "month", "quarter", "is_weekend", "is_month_start",
             "is_month_end", "sin_dow", "cos_dow", "sin_month", "cos_month", "sin_dom", "cos_dom",
             "days_to_payday"]
    names += [f"lag_{k}" for k in LAGS]
    for w in ROLLING_WINDOWS:
        names += [f"rolling_mean_{w}", f"rolling_std_{w}", f"rolling_min_{w}", f"rolling_max_{w}"]
    return names + ["ewm_mean_7", "ewm_mean_30"]


def daily_series(tx: DataFrame, keys: list[str], date: str = "date", amount: str = "amount",
                 category: str = "category") -> DataFrame:
    """Per series and calendar day: total spend, count and
    spend per canonical category; days without rows between the series'
    first and last day are filled with zeros.

    Category spends are conditional sums in the same aggregate (no pivot
    job, no second join); the calendar spine is generated per series with
    ``sequence`` and joined back on (series, day).
    """
    d = (tx.filter(F.col(date).isNotNull() & F.col(amount).isNotNull() & ~F.isnan(amount)
                   & F.col(category).isNotNull())
         .withColumn("day", F.to_date(date)))
    aggs = [F.sum(money(amount)).alias("_tot"), F.count(amount).alias("tx_count")]
    aggs += [F.sum(F.when(F.col(category) == c, money(amount))).alias(f"_{c}") for c in dims.CATEGORIES]
    daily = d.groupBy(*keys, "day").agg(*aggs)
    span = daily.groupBy(*keys).agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"))
    spine = span.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias("day"))
    j = spine.join(daily, keys + ["day"], "left") if keys else spine.join(daily, ["day"], "left")
    zero = F.lit(0).cast("decimal(18,2)")
    out = [*[F.col(k) for k in keys], F.col("day").alias("date"),
           as_number(F.coalesce("_tot", zero)).alias("total_spend"),
           F.coalesce("tx_count", F.lit(0)).cast("long").alias("tx_count")]
    out += [as_number(F.coalesce(f"_{c}", zero)).alias(f"{c}_spend") for c in dims.CATEGORIES]
    return j.select(*out)


def _w(keys, order="date"):
    return Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)


def _fold_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def _sq_dev(m: Column):
    def step(a, x):
        return a + (x - m) * (x - m)
    return step


def add_features(series: DataFrame, keys: list[str], target: str = "total_spend", date: str = "date",
                 trig_digits: int | None = None) -> DataFrame:
    """14 calendar, 7 lag, 12 rolling and 2 EWM columns.

    Rolling statistics use the previous ``k`` rows (min_periods 1, std of a
    single value = 0); the frame's values (at most 30) are collected and
    folded in row order, so the result does not depend on how Spark splits
    the work.  The mean becomes a column before the deviations are folded,
    so each fold runs once per row.  ``trig_digits`` rounds the sin/cos
    columns, for comparing engines.
    """
    w = _w(keys, date)
    cols = [F.col("*"), *calendar_features(date, trig_digits=trig_digits)]
    cols += [F.lag(target, k).over(w).alias(f"lag_{k}") for k in LAGS]
    for k in ROLLING_WINDOWS:
        frame = w.rowsBetween(-k, -1)
        cols += [F.collect_list(target).over(frame).alias(f"_l{k}"),
                 F.min(target).over(frame).alias(f"rolling_min_{k}"),
                 F.max(target).over(frame).alias(f"rolling_max_{k}")]
    out = add_ewm(series, keys, target, date).select(*cols)
    for k in ROLLING_WINDOWS:
        lst = F.col(f"_l{k}")
        out = out.withColumn(f"rolling_mean_{k}", F.when(F.size(lst) > 0, _fold_sum(lst) / F.size(lst)))
    for k in ROLLING_WINDOWS:
        lst, m = F.col(f"_l{k}"), F.col(f"rolling_mean_{k}")
        ssd = F.aggregate(lst, F.lit(0.0), _sq_dev(m))
        out = out.withColumn(f"rolling_std_{k}", F.when(F.size(lst) > 1, F.sqrt(ssd / (F.size(lst) - 1)))
                             .otherwise(F.lit(0.0)))
    return out.drop(*[f"_l{k}" for k in ROLLING_WINDOWS])


def add_ewm(df: DataFrame, keys: list[str], target: str = "total_spend", date: str = "date",
            spans=EWM_SPANS, block: int = EWM_BLOCK) -> DataFrame:
    """Adjusted exponentially weighted mean of all previous rows, weights
    (1-a)^i, a = 2/(span+1), unrounded.

    O(n) with plain window sums: row i of a series sits in block b = i div B;
    x_j is stored scaled by r^(bB - j) (<= r^-(B-1), no overflow), and the sum
    over all earlier blocks is carried from block to block,

        carry_b = r^B * (carry_(b-1) + scaled total of block b-1),
        num_i   = r^(i-1-bB) * (carry_b + running scaled sum of block b before i)

    (one value per block and series, n / B of them), and den likewise with x = 1.
    """
    w = _w(keys, date)
    d = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_b", F.floor(F.col("_i") / block).cast("int"))
    sums = []
    for s in spans:
        scale = F.pow(F.lit(1.0 - 2.0 / (s + 1)), F.col("_b") * block - F.col("_i"))
        d = d.withColumn(f"_u{s}", F.col(target) * scale).withColumn(f"_v{s}", scale)
        sums += [f"_u{s}", f"_v{s}"]
    totals = d.groupBy(*keys, "_b").agg(*[F.sum(c).alias(c) for c in sums])
    per = totals.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_b", *sums))).alias("_t"))
    state = F.struct(*[F.lit(0.0).alias(c) for c in sums])

    def step(acc, t):
        last = F.element_at(acc, -1)
        nxt = F.struct(*[(F.lit((1.0 - 2.0 / (int(c[2:]) + 1)) ** block) * (last[c] + t[c])).alias(c) for c in sums])
        return F.concat(acc, F.array(nxt))

    carry = F.aggregate("_t", F.array(state), step)
    per = per.select(*keys, F.posexplode(carry).alias("_b", "_x"))
    per = per.select(*keys, "_b", *[F.col("_x")[c].alias(f"_carry{c}") for c in sums])
    d = d.join(per, [*keys, "_b"])
    wb = Window.partitionBy(*keys, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    for s in spans:
        f = F.pow(F.lit(1.0 - 2.0 / (s + 1)), F.col("_i") - 1 - F.col("_b") * block)
        num, den = (f * (F.col(f"_carry_{c}{s}") + F.coalesce(F.sum(f"_{c}{s}").over(wb), F.lit(0.0))) for c in "uv")
        d = d.withColumn(f"ewm_mean_{s}", F.when(F.col("_i") > 0, num / den))
    return d.drop("_i", "_b", *sums, *[f"_carry{c}" for c in sums])


def drop_burn_in(features: DataFrame) -> DataFrame:
    """rows whose 30-day lag is not yet available are dropped."""
    return features.filter(F.col("lag_30").isNotNull())


def chronological_split(df: DataFrame, keys: list[str], test_ratio: float = 0.2,
                        date: str = "date") -> DataFrame:
    """Per series, the first int(n*(1-r)) days train, the rest test."""
    w = _w(keys, date)
    n = F.count("*").over(Window.partitionBy(*keys)) if keys else F.count("*").over(Window.partitionBy())
    return df.withColumn("split", F.when(F.row_number().over(w) <= F.floor(n * (1 - test_ratio)), "train")
                         .otherwise("test"))


def expanding_folds(df: DataFrame, keys: list[str], n_splits: int = 5, date: str = "date") -> DataFrame:
    """Expanding-window CV blocks.  size = n div (n_splits+1); fold i
    (0-based) validates on rows (n-(n_splits-i)*size, n-(n_splits-i-1)*size]
    and trains on everything before; ``cv_block`` is the validation fold of a
    row or -1 for rows only ever used for training."""
    w = _w(keys, date)
    n = F.count("*").over(Window.partitionBy(*keys)) if keys else F.count("*").over(Window.partitionBy())
    size = F.floor(n / (n_splits + 1))
    rn = F.row_number().over(w)
    first = n - size * n_splits
    return df.withColumn("cv_block", F.when((size > 0) & (rn > first),
                                            F.floor((rn - first - 1) / size)).otherwise(-1).cast("int"))


def series_summary(series: DataFrame, keys: list[str], target: str = "total_spend",
                   date: str = "date") -> DataFrame:
    """first/last day, days, mean (exact decimal sum) and sample std
    (rounded to 4 decimals) per series."""
    g = series.groupBy(*keys).agg(F.min(date).alias("start_date"), F.max(date).alias("end_date"),
                                  F.count(target).alias("rows"), F.sum(money(target)).alias("_s"),
                                  F.stddev_samp(target).alias("_sd"))
    return g.select(*keys, "start_date", "end_date", "rows",
                    (as_number("_s") / F.col("rows")).alias("mean"),
                    round_to("_sd", 4).alias("std"))


def recent_history(series: DataFrame, keys: list[str], lookback_days: int = 60,
                   date: str = "date") -> DataFrame:
    """The last ``lookback_days`` rows of each series.  The
    row_number filter runs as a per-partition group limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(date).desc()) if keys else Window.orderBy(F.col(date).desc())
    return series.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= lookback_days).drop("_rn")


def recent_daily(tx: DataFrame, keys: list[str], lookback_days: int = 60, date: str = "date",
                 amount: str = "amount") -> DataFrame:
    """S13/T6 from transactions: the last ``lookback_days`` days of each gap-filled
    series (fewer if it is shorter), days without rows as zero.  Only those days
    are generated and summed, whatever the length of the history."""
    t = tx.filter(F.col(date).isNotNull() & F.col(amount).isNotNull() & ~F.isnan(amount)).withColumn("_day", F.to_date(date))
    span = t.groupBy(*keys).agg(F.min("_day").alias("_lo"), F.max("_day").alias("_hi"))
    span = span.select(*keys, F.greatest("_lo", F.date_sub("_hi", lookback_days - 1)).alias("_from"), "_hi")
    daily = (t.join(span.select(*keys, "_from"), keys).filter(F.col("_day") >= F.col("_from"))
             .groupBy(*keys, "_day").agg(F.sum(money(amount)).alias("_s")))
    spine = span.select(*keys, F.explode(F.sequence("_from", "_hi")).alias("_day"))
    return spine.join(daily, [*keys, "_day"], "left").select(
        *keys, F.col("_day").alias("date"), as_number(F.coalesce("_s", F.lit(0).cast("decimal(18,2)"))).alias("total_spend"))


def category_shares(tx: DataFrame, keys: list[str], amount: str = "amount", category: str = "category",
                    default_share: float = 0.14) -> DataFrame:
    """Each canonical category's share of the key's total spend;
    categories without spend get 0, a key with zero total gets
    ``default_share`` everywhere.  The (key x category) spine is built by
    exploding the fixed category list on each key (no join)."""
    per = tx.groupBy(*keys, category).agg(F.sum(money(amount)).alias("_amt"))
    spine = tx.select(*keys).distinct().withColumn(
        category, F.explode(F.array(*[F.lit(c) for c in dims.CATEGORIES])))
    j = spine.join(per, keys + [category], "left")
    tot = F.sum("_amt").over(Window.partitionBy(*keys)) if keys else F.sum("_amt").over(Window.partitionBy())
    amt = F.coalesce(F.col("_amt"), F.lit(0).cast("decimal(18,2)"))
    return j.select(*keys, category,
                    F.when(F.coalesce(tot, F.lit(0)) > 0, as_number(amt) / as_number(tot))
                    .otherwise(F.lit(default_share)).alias("ratio"))
