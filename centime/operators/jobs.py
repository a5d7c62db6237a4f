"""Scheduled ledger jobs as set-based batch operators.

The reference loops over users or events one at a time (one query per
user, one event per due template).  Here each job is one plan over all
users: a filter, a few key-partitioned aggregates and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dims
from ..functions.dates import is_new_month, next_recurring_date, shift_days, ts_lit
from ..functions.money import as_number, money, round_to, signed_amount
from ..functions.text import recurring_description, truncated_one_decimal
from . import ledger as L


def with_next_date(tx: DataFrame) -> DataFrame:
    """Derive ``next_recurring_date`` where the table does not store it:
    recurring rows advance from their last processing time, else from their date."""
    if "next_recurring_date" in tx.columns:
        return tx
    base = F.coalesce(F.col("last_processed"), F.col("date"))
    nxt = F.when(F.col("is_recurring") & F.col("recurring_interval").isNotNull(),
                 next_recurring_date(base, F.col("recurring_interval")))
    return tx.withColumn("next_recurring_date", nxt)


def due_recurring(tx: DataFrame, now: str) -> DataFrame:
    """One event (transaction_id, user_id) per due template."""
    t = with_next_date(tx)
    return t.filter(L.due_recurring_predicate(now)).select(
        F.col("id").alias("transaction_id"), "user_id")


def post_recurring(tx: DataFrame, accounts: DataFrame, events: DataFrame, now: str,
                   run_id: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Process due-recurring events as one set.

    Returns (posted copies, accounts with new balances, updated templates).
    Events are de-duplicated on (transaction_id, user_id), so that one with a
    wrong user displaces no valid one, and the template is re-checked (F12), so replaying a batch posts each template once.  ``run_id`` (the
    processing clock by default) makes the posted row id deterministic.
    """
    run = run_id or now
    ev = events.select(F.col("transaction_id").alias("id"), "user_id").dropDuplicates(["id", "user_id"])
    t = with_next_date(tx)
    due = (t.join(ev, ["id", "user_id"], "left_semi")
           .filter(L.is_due(now)))
    posted = due.select(
        F.xxhash64(F.col("id"), F.lit(run)).alias("id"),
        F.col("id").alias("source_id"),
        "user_id", "account_id", "type", "amount",
        recurring_description("description").alias("description"),
        ts_lit(now).alias("date"), "category",
        F.lit(False).alias("is_recurring"),
        F.lit(None).cast("string").alias("recurring_interval"),
        F.lit("COMPLETED").alias("status"))
    delta = posted.groupBy("account_id").agg(F.sum(signed_amount("type", money("amount"))).alias("delta"))
    new_acc = (accounts.join(delta, "account_id", "left")
               .withColumn("balance", as_number(money("balance") + F.coalesce("delta", F.lit(0).cast("decimal(18,2)"))))
               .drop("delta"))
    touched = due.select("id").withColumn("_hit", F.lit(True))
    upd = (t.join(touched, "id", "left")
           .withColumn("last_processed", F.when(F.col("_hit"), ts_lit(now)).otherwise(F.col("last_processed")))
           .withColumn("next_recurring_date",
                       F.when(F.col("_hit"), next_recurring_date(ts_lit(now), F.col("recurring_interval")))
                        .otherwise(F.col("next_recurring_date")))
           .drop("_hit"))
    return posted, new_acc, upd


def alert_window_start(now: str) -> Column:
    """Day 1 of the month at the current time of day (the reference's
    ``setDate(1)`` keeps the clock)."""
    n = ts_lit(now)
    return shift_days(n, -(F.dayofmonth(n) - 1))


def budget_alerts(budgets: DataFrame, users: DataFrame, accounts: DataFrame, tx: DataFrame,
                  now: str, threshold_pct: float = dims.BUDGET_ALERT_THRESHOLD_PCT) -> tuple[DataFrame, DataFrame]:
    """Alerts to send and the budgets with ``last_alert_sent`` updated.

    Spend is the default account's EXPENSE total from the window start on,
    aggregated per account before the join.
    """
    d = L.default_account(accounts, only_default=True).select("user_id", "account_id")
    spend = (tx.filter((F.col("type") == "EXPENSE") & (F.col("date") >= alert_window_start(now)))
             .groupBy("user_id", "account_id").agg(F.sum(money("amount")).alias("spend")))
    j = (budgets.join(users.select("user_id", "email", "name"), "user_id")
         .join(d, "user_id")
         .join(spend, ["user_id", "account_id"], "left"))
    total = as_number(F.coalesce("spend", F.lit(0).cast("decimal(18,2)")))
    pct = total / F.col("amount") * 100
    fire = (pct >= threshold_pct) & (F.col("last_alert_sent").isNull()
                                     | is_new_month("last_alert_sent", ts_lit(now)))
    j = j.withColumn("_total", total).withColumn("_pct", pct).withColumn("_fire", fire)
    alerts = j.filter("_fire").select(
        "user_id", "email", "account_id",
        F.col("amount").alias("budget_amount"),
        F.col("_total").alias("total_expenses"),
        round_to(F.col("_pct"), 6).alias("percentage_used"),
        truncated_one_decimal("amount").alias("budget_amount_text"),
        truncated_one_decimal("_total").alias("total_expenses_text"),
        ts_lit(now).alias("alert_sent_at"))
    updated = (budgets.join(alerts.select("user_id", F.lit(True).alias("_sent")), "user_id", "left")
               .withColumn("last_alert_sent",
                           F.when(F.col("_sent"), ts_lit(now)).otherwise(F.col("last_alert_sent")))
               .drop("_sent"))
    return alerts, updated


def throttle(events: DataFrame, limit: int = dims.THROTTLE_LIMIT_PER_MINUTE,
             key: str = "user_id", ts: str = "ts", id_col: str = "event_id",
             unit: str = "minute") -> DataFrame:
    """Admit at most ``limit`` events per key per period window.

    The first ``limit`` events of each (key, window) are found with a
    row_number filter, which Spark turns into a per-partition group limit
    before the shuffle, so a hot key ships at most ``limit`` rows per task;
    the flag is joined back on the event id.
    """
    win = F.date_trunc(unit, F.col(ts))
    w = Window.partitionBy(key, "_win").orderBy(F.col(ts), F.col(id_col))
    admitted = (events.select(key, ts, id_col, win.alias("_win"))
                .withColumn("_rn", F.row_number().over(w))
                .filter(F.col("_rn") <= limit)
                .select(id_col, F.lit(True).alias("admitted")))
    return (events.join(admitted, id_col, "left")
            .withColumn("admitted", F.coalesce("admitted", F.lit(False))))
