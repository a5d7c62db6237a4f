"""Per-user token bucket over an event log (P4), batch and streaming.

Semantics (chosen, the reference delegates it to a library): capacity C,
R tokens added per whole elapsed interval I counted from the user's first
request (the refill clock advances by whole intervals), 1 token per request,
denied requests cost nothing.

Batch: when R >= C every elapsed interval refills the bucket completely, so a
request is admitted iff it is among the first C of its user's interval
``floor((ts - first_ts) / I)`` — a per-(user, interval) rank filter that
Spark evaluates with a group limit before the shuffle.  For R < C tokens
carry over: a refill and the requests of an interval each map the tokens x to
clamp(x + a, lo, hi), and such maps compose to one of their kind.  A user's
intervals are cut into blocks of ``BLOCK``; each block becomes one map, the maps
of a user's blocks give the tokens each block begins with, and inside a block the
tokens of every interval follow.  No task holds a user's events.

Streaming: ``applyInPandasWithState`` keeps (tokens, refill clock) per user;
each micro-batch's events are replayed in time order.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import dims

OUT_SCHEMA = "event_id long, user_id long, ts timestamp, admitted boolean"
STATE_SCHEMA = "tokens double, clock long"
BLOCK = 512  # intervals with requests that a task looks at together, at most


def _replay(ts_us, tokens: float, clock: int | None, capacity: int, refill: int, interval_us: int):
    admitted = []
    for t in ts_us:
        if clock is None:
            clock = t
            tokens = float(capacity)
        elif t >= clock + interval_us:
            k = (t - clock) // interval_us
            tokens = min(float(capacity), tokens + refill * k)
            clock += k * interval_us
        if tokens >= 1.0:
            tokens -= 1.0
            admitted.append(True)
        else:
            admitted.append(False)
    return admitted, tokens, clock


def token_bucket(events: DataFrame, capacity: int = dims.TOKEN_BUCKET_CAPACITY,
                 refill: int = dims.TOKEN_BUCKET_REFILL, interval_s: int = dims.TOKEN_BUCKET_INTERVAL_SEC,
                 key: str = "user_id", ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """Batch form: every event with ``admitted``."""
    interval_us = interval_s * 1_000_000
    t_us = F.unix_micros(F.col(ts).cast("timestamp"))
    if refill >= capacity:
        first = events.groupBy(key).agg(F.min(t_us).alias("_t0"))
        e = events.select(key, ts, id_col, t_us.alias("_t")).join(first, key)
        e = e.withColumn("_iv", F.floor((F.col("_t") - F.col("_t0")) / interval_us))
        w = Window.partitionBy(key, "_iv").orderBy("_t", id_col)
        ok = (e.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= capacity)
              .select(id_col, F.lit(True).alias("admitted")))
        return events.join(ok, id_col, "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))

    first = events.groupBy(key).agg(F.min(t_us).alias("_t0"))
    e = events.select(key, id_col, t_us.alias("_t")).join(first, key)
    e = e.withColumn("_iv", F.floor((F.col("_t") - F.col("_t0")) / interval_us))
    w = Window.partitionBy(key, "_iv").orderBy("_t", id_col)
    head = e.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= capacity)
    ok = head.join(available(e, key, capacity, refill), [key, "_iv"]).filter(F.col("_rn") <= F.col("_tokens"))
    return events.join(ok.select(id_col, F.lit(True).alias("admitted")), id_col, "left") \
        .withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def _clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, low), high)


def available(events: DataFrame, key: str, capacity: int, refill: int, block: int | None = None) -> DataFrame:
    """(key, _iv, _tokens): the whole tokens at hand when an interval's first request comes, for
    events (key, _iv) whose intervals ``_iv`` count from 0 for each key."""
    block = block or BLOCK
    low, high = F.lit(0).cast("long"), F.lit(capacity).cast("long")
    n = events.groupBy(key, "_iv").agg(F.count("*").alias("n")).withColumn("_b", F.floor(F.col("_iv") / block))
    lists = n.groupBy(key, "_b").agg(F.array_sort(F.collect_list(F.struct("_iv", "n"))).alias("xs"))

    def then(f, a):  # the map f followed by x -> clamp(x + a, 0, capacity)
        return F.struct((f["a"] + a).alias("a"), _clamp(f["lo"] + a, low, high).alias("lo"), _clamp(f["hi"] + a, low, high).alias("hi"))

    start = F.col("_b") * block
    none = F.struct(low.alias("a"), low.alias("lo"), high.alias("hi"))

    def step(acc, x):
        after = then(then(acc["f"], (x["_iv"] - acc["at"]) * refill), -x["n"])
        return F.struct(after.alias("f"), x["_iv"].alias("at"))

    maps = lists.withColumn("m", F.aggregate("xs", F.struct(none.alias("f"), start.cast("long").alias("at")), step,
                                             lambda acc: then(acc["f"], ((F.col("_b") + 1) * block - acc["at"]) * refill)))
    per = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_b", "m"))).alias("ms"))  # one entry a block

    def enter(acc, x):  # refills of the blocks without a request, then the block itself
        tokens = _clamp(acc["x"] + (x["_b"] - acc["b"]) * (block * refill), low, high)
        out = _clamp(tokens + x["m"]["a"], x["m"]["lo"], x["m"]["hi"])
        entry = F.struct(x["_b"].alias("_b"), tokens.alias("x0"))
        return F.struct((x["_b"] + 1).alias("b"), out.alias("x"), F.concat(acc["out"], F.array(entry)).alias("out"))

    first = F.struct(low.alias("b"), high.alias("x"), F.array().cast("array<struct<_b:bigint,x0:bigint>>").alias("out"))
    begin = per.select(key, F.inline(F.aggregate("ms", first, enter, lambda acc: acc["out"])))

    def serve(acc, x):
        tokens = _clamp(acc["x"] + (x["_iv"] - acc["at"]) * refill, low, high)
        entry = F.struct(x["_iv"].alias("_iv"), tokens.alias("_tokens"))
        return F.struct(x["_iv"].alias("at"), F.greatest(tokens - x["n"], low).alias("x"), F.concat(acc["out"], F.array(entry)).alias("out"))

    empty = F.array().cast("array<struct<_iv:bigint,_tokens:bigint>>")
    inside = lists.join(begin, [key, "_b"])
    served = F.aggregate("xs", F.struct(start.cast("long").alias("at"), F.col("x0").alias("x"), empty.alias("out")), serve, lambda acc: acc["out"])
    return inside.select(key, F.inline(served))


def token_bucket_stream(stream: DataFrame, capacity: int = dims.TOKEN_BUCKET_CAPACITY,
                        refill: int = dims.TOKEN_BUCKET_REFILL,
                        interval_s: int = dims.TOKEN_BUCKET_INTERVAL_SEC) -> DataFrame:
    """Streaming form over (event_id, user_id, ts): keyed state per user."""
    interval_us = interval_s * 1_000_000

    def fn(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True)
        pdf["_t"] = pdf["ts"].astype("datetime64[us]").astype("int64")
        pdf = pdf.sort_values(["_t", "event_id"])
        if state.exists:
            tokens, clock = state.get
        else:
            tokens, clock = float(capacity), None
        adm, tokens, clock = _replay(pdf["_t"].tolist(), tokens, clock, capacity, refill, interval_us)
        state.update((float(tokens), int(clock)))
        yield pd.DataFrame({"event_id": pdf["event_id"].values, "user_id": pdf["user_id"].values,
                            "ts": pdf["ts"].values, "admitted": adm})

    s = stream.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return s.groupBy("user_id").applyInPandasWithState(fn, OUT_SCHEMA, STATE_SCHEMA, "append",
                                                       GroupStateTimeout.NoTimeout)


VELOCITY_STATE = "times array<long>"


def velocity_stream(stream: DataFrame, window_s: int = 3600, watermarked: bool = False) -> DataFrame:
    """W7 / P7 stream form (all input columns kept, ``velocity_1h`` added):
    per event, the user's events in [ts - window, ts] (itself and same-time
    peers included, as in the batch range frame).

    State per user = sorted timestamps.  With a watermark on the stream
    (``watermarked``) they are kept back to watermark - window, so that an event
    that is late but still admitted is counted in full, and a user without events
    for a window after the watermark is forgotten; without one, back to a window
    before the newest event, for ever."""
    window_us = window_s * 1_000_000

    def fn(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches), ignore_index=True)
        t = pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        known = np.array(state.get[0] if state.exists else [], np.int64)
        times = np.sort(np.concatenate([known, t]))
        pdf["velocity_1h"] = (np.searchsorted(times, t, side="right")
                              - np.searchsorted(times, t - window_us, side="left")).astype("int32")
        newest = int(times[-1])
        oldest = min(state.getCurrentWatermarkMs() * 1000, newest) if watermarked else newest
        state.update((times[np.searchsorted(times, oldest - window_us):].tolist(),))
        if watermarked:
            state.setTimeoutTimestamp(max(newest // 1000 + window_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pdf

    s = stream if watermarked else stream.withColumn("ts", F.col("ts").cast("timestamp"))  # a cast would hide the watermark
    if "velocity_1h" in s.columns:
        s = s.drop("velocity_1h")
    out_schema = StructType(list(s.schema.fields) + [StructField("velocity_1h", IntegerType())])
    timeout = GroupStateTimeout.EventTimeTimeout if watermarked else GroupStateTimeout.NoTimeout
    return s.groupBy("user_id").applyInPandasWithState(fn, out_schema, VELOCITY_STATE, "append", timeout)
