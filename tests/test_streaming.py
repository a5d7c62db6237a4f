"""Streaming forms: batch result == stream result; replays are idempotent."""

import datetime as dt
import os
import random
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from centime.operators import jobs as J
from centime.operators import scoring as SC
from centime.sources.tables import Ledger
from centime.streaming import jobs as SJ
from centime.streaming import rate_limit as RL

from conftest import SMALL

NOW = "1998-03-15 12:00:00"


def _replay_py(rows, capacity, refill, interval_s):
    out, state = {}, {}
    for eid, uid, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        tokens, clock = state.get(uid, (capacity, None))
        t = int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
        if clock is None:
            clock, tokens = t, capacity
        elif t >= clock + interval_s * 1_000_000:
            k = (t - clock) // (interval_s * 1_000_000)
            tokens = min(capacity, tokens + refill * k)
            clock += k * interval_s * 1_000_000
        ok = tokens >= 1
        tokens -= 1 if ok else 0
        state[uid] = (tokens, clock)
        out[eid] = ok
    return out


def _burst_rows(n=600, seed=2):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    return [(i, 1 if i % 3 else rng.randint(2, 4), base + dt.timedelta(seconds=rng.randint(0, 5 * 3600))) for i in range(n)]


def test_token_bucket_batch_matches_replay(spark):
    rows = _burst_rows()
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    for cap, ref in ((10, 10), (10, 4)):
        got = {r["event_id"]: r["admitted"] for r in RL.token_bucket(df, cap, ref, 3600).collect()}
        assert got == _replay_py(rows, cap, ref, 3600)


def _write_parts(spark, rows, schema, parts):
    d = tempfile.mkdtemp(prefix="centime-src-")
    rows = sorted(rows, key=lambda r: r[2])
    size = (len(rows) + parts - 1) // parts
    for p in range(parts):
        chunk = rows[p * size:(p + 1) * size]
        if chunk:
            spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(d)
    return d


def test_token_bucket_stream_equals_batch(spark):
    rows = _burst_rows(300, seed=4)
    schema = "event_id long, user_id long, ts timestamp_ntz"
    src = _write_parts(spark, rows, schema, 3)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = tempfile.mkdtemp(prefix="centime-out-")
    q = (RL.token_bucket_stream(stream, 10, 4, 3600).writeStream.format("parquet")
         .option("checkpointLocation", os.path.join(out, "ckpt")).option("path", os.path.join(out, "data"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["event_id"]: r["admitted"] for r in spark.read.parquet(os.path.join(out, "data")).collect()}
    assert got == _replay_py(rows, 10, 4, 3600)


def test_recurring_stream_is_idempotent(spark):
    db = Ledger(spark, SMALL)
    tx, acc = db.transactions(), db.accounts()
    due = J.due_recurring(tx, NOW)
    n_due = due.count()
    src = tempfile.mkdtemp(prefix="centime-due-")
    due.write.mode("append").parquet(src)
    due.write.mode("append").parquet(src)  # the same events delivered twice
    out = tempfile.mkdtemp(prefix="centime-post-")
    stream = spark.readStream.schema(due.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (stream.writeStream.foreachBatch(SJ.recurring_batch_writer(tx, acc, NOW, out))
         .option("checkpointLocation", os.path.join(out, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    posted = spark.read.parquet(os.path.join(out, "posted"))
    assert posted.count() == n_due and posted.select("source_id").distinct().count() == n_due


def test_score_stream_equals_batch(spark):
    ev = Ledger(spark, SMALL).risk_events().withColumn("velocity_1h", F.lit(1))
    src = tempfile.mkdtemp(prefix="centime-ev-")
    ev.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    out = tempfile.mkdtemp(prefix="centime-score-")
    q = (SJ.score_stream(stream).writeStream.format("parquet").option("path", os.path.join(out, "d"))
         .option("checkpointLocation", os.path.join(out, "c")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["event_id"]: (r["fraud_probability"], r["risk_level"]) for r in spark.read.parquet(os.path.join(out, "d")).collect()}
    want = {r["event_id"]: (r["fraud_probability"], r["risk_level"])
            for r in SC.fraud_risk(ev.withColumn("is_weekend", F.lit(0))).collect()}
    assert got == want


def test_budget_alert_writer_is_idempotent(spark):
    db = Ledger(spark, SMALL)
    tx = db.transactions(date_from="1998-03-01")
    out = tempfile.mkdtemp(prefix="centime-alerts-")
    w = SJ.budget_alert_batch_writer(db.budgets(), db.users(), db.accounts(), NOW, out)
    w(tx, 0)
    w(tx, 1)  # replay
    alerts = spark.read.parquet(os.path.join(out, "alerts"))
    batch_alerts, _ = J.budget_alerts(db.budgets(), db.users(), db.accounts(), tx, NOW)
    assert alerts.count() == batch_alerts.count()
    assert alerts.select("user_id").distinct().count() == alerts.count()


def test_throttle_stream_counts(spark):
    base = dt.datetime(2024, 1, 1, 10, 0)
    rows = [(i, 1, base + dt.timedelta(seconds=2 * i)) for i in range(40)]
    schema = "event_id long, user_id long, ts timestamp_ntz"
    src = _write_parts(spark, rows + [(999, 1, base + dt.timedelta(hours=2))], schema, 1)
    out = tempfile.mkdtemp(prefix="centime-thr-")
    stream = spark.readStream.schema(schema).parquet(src)
    q = (SJ.throttle_stream(stream).writeStream.format("memory").queryName("thr_out").outputMode("update")
         .option("checkpointLocation", os.path.join(out, "c")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r["minute"], r["admitted"], r["deferred"]) for r in spark.sql("SELECT * FROM thr_out").collect()}
    assert (dt.datetime(2024, 1, 1, 10, 0), 10, 20) in got and (dt.datetime(2024, 1, 1, 10, 1), 10, 0) in got


def test_velocity_stream_equals_batch(spark):
    ev = Ledger(spark, SMALL).risk_events().select("event_id", "user_id", "ts")
    rows = [tuple(r) for r in ev.collect()]
    src = _write_parts(spark, rows, "event_id long, user_id long, ts timestamp_ntz", 4)
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp_ntz") \
        .option("maxFilesPerTrigger", 1).parquet(src)
    out = tempfile.mkdtemp(prefix="centime-vel-")
    q = (RL.velocity_stream(stream).writeStream.format("parquet").option("path", os.path.join(out, "d"))
         .option("checkpointLocation", os.path.join(out, "c")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["event_id"]: r["velocity_1h"] for r in spark.read.parquet(os.path.join(out, "d")).collect()}
    want = {r["event_id"]: r["velocity_1h"] for r in SC.velocity(ev).collect()}
    assert got == want


def test_score_stream_with_stateful_velocity(spark):
    ev = Ledger(spark, SMALL).risk_events()
    src = tempfile.mkdtemp(prefix="centime-ev2-")
    ev.orderBy("ts").coalesce(1).write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    out = tempfile.mkdtemp(prefix="centime-score2-")
    q = (SJ.score_stream(stream, derive_velocity=True).writeStream.format("parquet").option("path", os.path.join(out, "d"))
         .option("checkpointLocation", os.path.join(out, "c")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["event_id"]: (r["fraud_probability"], r["risk_level"]) for r in spark.read.parquet(os.path.join(out, "d")).collect()}
    want = {r["event_id"]: (r["fraud_probability"], r["risk_level"])
            for r in SC.fraud_risk(ev.withColumn("is_weekend", F.lit(0))).collect()}
    assert got == want


def test_token_bucket_carry_over_matches_replay(spark):
    """Random logs, long pauses, many blocks, and a user with a third of the rows; refill below capacity."""
    import random
    from centime.streaming import rate_limit as RL
    rng = random.Random(9)
    rows, t = [], {}
    for i in range(3000):
        user = 1 if i % 3 == 0 else rng.randrange(2, 40)
        t[user] = t.get(user, rng.randrange(10**6)) + rng.choice([1, 5, 30, 60, 61, 400, 20000])
        rows.append((i, user, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t[user])))
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").repartition(5)
    for cap, ref, every, block in ((7, 2, 60, 4), (3, 1, 600, 512), (5, 0, 60, 3)):
        old, RL.BLOCK = RL.BLOCK, block
        try:
            got = {r.event_id: r.admitted for r in RL.token_bucket(df, cap, ref, every).collect()}
        finally:
            RL.BLOCK = old
        want = {}
        for user in t:
            mine = sorted((ts, i) for i, u, ts in rows if u == user)
            us = [int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1e6) for ts, _ in mine]
            admitted, _, _ = RL._replay(us, float(cap), None, cap, ref, every * 1_000_000)
            want.update({i: a for (_, i), a in zip(mine, admitted)})
        assert got == want
