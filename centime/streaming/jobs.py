"""Stream forms of the ledger jobs and of the transaction scoring
(P1-P3, P5, P7).

Sources are any streaming DataFrame (a parquet/Kafka source in production,
a file source with ``availableNow`` in tests).  Writes go through
``foreachBatch`` with idempotent logic: every batch is de-duplicated and
anti-joined against what earlier batches wrote, so a replayed micro-batch
(after an executor or driver failure) produces no second posting or alert.
Checkpoints belong in the cluster's shared checkpoint folder.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.money import money, signed_amount
from ..operators import jobs as J
from ..operators import scoring as SC
from ..session import scratch_path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system for ``path`` has it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table, or an empty one before the first batch.  Only a missing path
    counts as empty: any other failure must fail the batch, or it would post twice."""
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def recurring_batch_writer(tx: DataFrame, accounts: DataFrame, now: str, out_dir: str):
    """P2 as a ``foreachBatch`` function.

    A micro-batch of (transaction_id, user_id) events is de-duplicated, events
    that other epochs posted for this run (``source_id`` in the posted table) are
    dropped, and the rest are posted set-based with ``post_recurring``.

    The postings are the only table written, one folder per epoch that a replay
    overwrites: a batch is there or not, there is nothing between two writes to
    lose.  Balance changes and advanced templates are derived from it
    (``posted_deltas``, ``advanced_templates``).
    """
    posted_path = os.path.join(out_dir, "posted")

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        ev = batch.select("transaction_id", "user_id").dropDuplicates(["transaction_id", "user_id"])
        done = _read_or_empty(spark, posted_path, "source_id long, run string, epoch long")
        done = done.filter((F.col("run") == now) & (F.col("epoch") != epoch_id))
        ev = ev.join(done.select(F.col("source_id").alias("transaction_id")), "transaction_id", "left_anti")
        posted, _, _ = J.post_recurring(tx, accounts, ev, now)
        (posted.withColumn("run", F.lit(now)).write.mode("overwrite")
         .parquet(os.path.join(posted_path, f"epoch={epoch_id}")))

    return write


def posted_deltas(posted: DataFrame) -> DataFrame:
    """Balance change of each account from the posted table, exact."""
    return posted.groupBy("account_id").agg(F.sum(signed_amount("type", money("amount"))).alias("delta"))


def advanced_templates(tx: DataFrame, posted: DataFrame) -> DataFrame:
    """The recurring templates with the clock of their last posting."""
    last = posted.groupBy(F.col("source_id").alias("id")).agg(F.max("date").alias("_at"))
    t = tx.filter("is_recurring").join(last, "id", "left")
    return J.with_next_date(t.withColumn("last_processed", F.coalesce("_at", "last_processed")).drop("_at"))


def throttle_stream(stream: DataFrame, limit: int = 10, watermark: str = "1 minute") -> DataFrame:
    """P3 stream form: per (user, 1-minute window) counts, with the admitted
    and deferred split (update mode; windows close at the watermark)."""
    s = stream.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    g = s.groupBy("user_id", F.window("ts", "1 minute")).agg(F.count("*").alias("events"))
    return g.select("user_id", F.col("window.start").alias("minute"), "events",
                    F.least(F.col("events"), F.lit(limit)).alias("admitted"),
                    F.greatest(F.col("events") - limit, F.lit(0)).alias("deferred"))


def score_stream(stream: DataFrame, watermark: str = "1 hour", derive_velocity: bool = False) -> DataFrame:
    """Rule-based fraud scoring of a transaction stream.

    Replays of the same event id inside the watermark are dropped; the
    per-row features and rules are stateless column expressions.  The 1-hour
    velocity is derived with per-user state (``derive_velocity``), taken from
    the event, or 1.  Events later than the watermark are dropped by the
    de-duplication state.
    """
    s = (stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
         .dropDuplicatesWithinWatermark(["event_id"]))
    if derive_velocity:
        from .rate_limit import velocity_stream
        s = velocity_stream(s, watermarked=True)
    elif "velocity_1h" not in s.columns:
        s = s.withColumn("velocity_1h", F.lit(1))
    f = SC.fraud_features(s, with_velocity=False)
    p = SC.fraud_probability(f)
    return f.select("event_id", "user_id", "ts", "amount", "amount_to_category_ratio", *SC.risk_tier(p))


def budget_alert_batch_writer(budgets: DataFrame, users: DataFrame, accounts: DataFrame, now: str,
                              out_dir: str):
    """P5 as a ``foreachBatch`` function over a stream of new transactions.

    New rows are appended to the transaction log; alerts are recomputed for
    the users present in the batch only (semi-join), and users already
    alerted this month (alert log) are skipped, so replays send nothing
    twice."""
    tx_path = os.path.join(out_dir, "transactions")
    alert_path = os.path.join(out_dir, "alerts")

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        (batch.withColumn("month", F.trunc(F.to_date("date"), "MM")).write.mode("append")
         .partitionBy("month").parquet(tx_path))
        touched = batch.select("user_id").distinct()
        month = F.trunc(F.to_date(F.expr(f"TIMESTAMP_NTZ '{now}'")), "MM")
        # this month's folders and this batch's users only, then one row per id
        log = spark.read.schema(batch.schema.add("month", "date")).parquet(tx_path)
        tx = (log.filter(F.col("month") >= month).drop("month").join(touched, "user_id", "left_semi")
              .dropDuplicates(["id"]))
        sent = _read_or_empty(spark, alert_path, "user_id long, alert_month date")
        b = (budgets.join(touched, "user_id", "left_semi")
             .join(sent.filter(F.col("alert_month") == month).select("user_id"), "user_id", "left_anti"))
        alerts, _ = J.budget_alerts(b, users, accounts, tx, now)
        alerts = alerts.withColumn("alert_month", month).withColumn("epoch", F.lit(epoch_id))
        alerts.write.mode("append").parquet(alert_path)

    return write


def default_checkpoint(spark: SparkSession, name: str) -> str:
    """Streaming checkpoint under the cluster's shared checkpoint folder."""
    return scratch_path(spark, f"stream-{name}")
