"""Ledger and feature tables over the driver's parquet files.

``Ledger`` maps the TPC-H-like tables onto the ledger schema (users,
accounts, budgets, transactions, purchases, profiles, risk events).  Each
view selects only the columns it needs, so parquet scans are pruned, and
date-bounded readers add a filter on the raw stored column so it is pushed
into the scan (row-group skipping) before the derived timestamp is built.
"""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import ts_lit

# Fixed evaluation clock of the fixture data.
FIXTURE_NOW = "1998-03-15 12:00:00"
FIXTURE_REPORT_MONTH = "1998-02-01"


class Ledger:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    # -- base tables --------------------------------------------------------
    def table(self, name: str, *cols: str) -> DataFrame:
        df = self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
        return df.select(*cols) if cols else df

    # -- fixture views ------------------------------------------------------
    def users(self) -> DataFrame:
        c = self.table("customer", "c_custkey", "c_name")
        return c.select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("name"),
            F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"))

    def accounts(self) -> DataFrame:
        """Two accounts per user; one user in ten has no default account."""
        c = self.table("customer", "c_custkey", "c_acctbal")
        c = c.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
        return c.select(
            (F.col("c_custkey") * 2 + F.col("k")).alias("account_id"),
            F.col("c_custkey").alias("user_id"),
            F.when(F.col("k") == 0, "CURRENT").otherwise("SAVINGS").alias("type"),
            ((F.col("k") == 0) & (F.col("c_custkey") % 10 != 9)).alias("is_default"),
            F.col("c_acctbal").alias("balance"))

    def budgets(self) -> DataFrame:
        c = self.table("customer", "c_custkey").filter(F.col("c_custkey") % 5 != 0)
        return c.select(
            F.col("c_custkey").alias("user_id"),
            (F.lit(50000.0) + (F.col("c_custkey") % 20) * 25000.0).alias("amount"),
            F.when(F.col("c_custkey") % 4 == 0, ts_lit("1998-03-02 06:00:00"))
             .when(F.col("c_custkey") % 4 == 1, ts_lit("1998-02-20 06:00:00"))
             .alias("last_alert_sent"))

    def transactions(self, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
        """Ledger transactions.

        ``date_from``/``date_to`` ('YYYY-MM-DD') bound the stored order date
        with one day of slack (the derived timestamp adds < 24 h), so the
        filter reaches the parquet scan; callers still apply their exact
        timestamp predicate.
        """
        o = self.table("orders", "o_orderkey", "o_custkey", "o_orderstatus",
                       "o_totalprice", "o_orderdate", "o_orderpriority")
        if date_from:
            lo = _dt.date.fromisoformat(date_from) - _dt.timedelta(days=1)
            o = o.filter(F.col("o_orderdate") >= ts_lit(f"{lo} 00:00:00"))
        if date_to:
            hi = _dt.date.fromisoformat(date_to) + _dt.timedelta(days=1)
            o = o.filter(F.col("o_orderdate") <= ts_lit(f"{hi} 00:00:00"))
        k = F.col("o_orderkey")
        income = F.col("o_orderstatus") == "F"
        return o.select(
            k.alias("id"),
            F.col("o_custkey").alias("user_id"),
            (F.col("o_custkey") * 2 + k % 2).alias("account_id"),
            F.when(income, "INCOME").otherwise("EXPENSE").alias("type"),
            F.col("o_totalprice").alias("amount"),
            F.when(k % 11 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.when(income, "Received ").otherwise("Paid for "),
                                 F.col("o_orderpriority"))).alias("description"),
            (F.col("o_orderdate") + F.make_dt_interval(hours=(k % 24).cast("int"))).alias("date"),
            F.element_at(F.array(*[F.lit(c) for c in
                                   ["food", "shopping", "transport", "entertainment",
                                    "bills", "healthcare", "education"]]),
                         (k % 7).cast("int") + 1).alias("category"),
            (k % 10 == 0).alias("is_recurring"),
            F.when(k % 40 == 0, "DAILY").when(k % 40 == 10, "WEEKLY")
             .when(k % 40 == 20, "MONTHLY").when(k % 40 == 30, "YEARLY").alias("recurring_interval"),
            F.when((k % 10 == 0) & (k % 3 != 0), F.col("o_orderdate")).alias("last_processed"),
            F.when(F.col("o_orderpriority") == "5-LOW", "PENDING")
             .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "FAILED")
             .otherwise("COMPLETED").alias("status"))

    def purchases(self) -> DataFrame:
        """Line items as card purchases (stands in for the finance source)."""
        li = self.table("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                        "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
        p = self.table("part", "p_partkey", "p_name", "p_type")
        s = self.table("supplier", "s_suppkey", "s_name")
        j = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
        return j.select(
            "l_orderkey", "l_linenumber",
            F.col("s_name").alias("merchant"),
            F.col("p_name").alias("description"),
            F.col("l_extendedprice").alias("amount"),
            F.lower("p_type").alias("native_category"),
            F.col("l_shipdate").alias("date"),
            F.when(F.col("l_returnflag") == "R", "Credit").otherwise("Debit").alias("transaction_type"),
            F.col("l_linestatus").alias("source"))

    def category_map(self) -> DataFrame:
        # 'promo' is deliberately absent so those rows are dropped as unmapped.
        return self.spark.createDataFrame(
            [("economy", "food"), ("standard", "bills"), ("small", "transport"),
             ("medium", "shopping"), ("large", "healthcare")],
            "native_category string, category string")

    def profiles(self) -> DataFrame:
        u = self.users().select("user_id")
        return u.select(
            "user_id",
            (F.lit(20000.0) + (F.col("user_id") % 50) * 2500.0).alias("monthly_income"),
            (F.lit(0.05) + (F.col("user_id") % 12) * 0.05).alias("savings_target_pct"),
            F.element_at(F.array(*[F.lit(x) for x in
                                   ["conservative", "balanced", "growth_oriented", "flexible", "other"]]),
                         (F.col("user_id") % 5).cast("int") + 1).alias("lifestyle"),
            ((F.col("user_id") % 9) * 1500.0).alias("debt_obligations"))

    def risk_events(self) -> DataFrame:
        e = self.table("events", "event_id", "user_id", "ts", "event_type", "value", "props")
        k = F.expr("try_cast(regexp_extract(props, '[0-9]+', 0) AS DOUBLE)")
        return e.select(
            "event_id", "user_id", "ts",
            (F.col("value") * 100).alias("amount"),
            F.when(F.col("event_type") == "purchase", "shopping")
             .when(F.col("event_type") == "view", "entertainment")
             .when(F.col("event_type") == "click", "food")
             .when(F.col("event_type") == "signup", "education")
             .otherwise("unknown").alias("category"),
            F.concat(F.lit("m"), (F.col("event_id") % 20).cast("string")).alias("merchant"),
            F.hour("ts").cast("int").alias("hour_of_day"),
            (k * 10).alias("distance_from_home_km"),
            (F.lit(1.0) - k / 100).alias("device_trust_score"),
            ((F.col("event_id") % 100) / 100.0).alias("merchant_risk_score"),
            F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_foreign_currency"))
