"""Operator 11, sharding by proportional stratified interleaving, with
DataFrame functions only.

Rows of each stratum (a document's source) are ranked in a seeded shuffle; row
r of a stratum of n rows has the fractional rank (r + u) / n, with u between 0
and 1 drawn from a hash of the stratum so that strata of few rows don't meet
in one place.  All rows sorted by fractional rank are cut into shards whose
row counts are at most one apart.  Between two fractional ranks each stratum
has its share to within one row; the cuts, which go by row counts, lie off
equal fractional ranks only by the sum of these roundings.

A stratum may hold a third of all rows, so no window runs over one.  Both
sorts are range partitionings: a row's position in its partition, plus one
offset a partition (and stratum), is its rank.  The tables of offsets have at
most (partitions + strata) and (partitions) rows.  The row number breaks ties,
so equal rows don't meet in one partition either.

Defined results: the law is ``rows``; equal texts are not kept together (a
group of copies may be larger than a shard); null text has no bytes, a null
source is a stratum, a null id takes part in the shuffle by its text; repeated
rows are rows; with fewer rows than shards some shards stay empty; an empty
table gives an empty table; all columns are kept inside ``doc``, whatever
their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path
from .common import written

SEED = 20_240_611


def shard_path(spark: SparkSession) -> str:
    return scratch_path(spark, f"shards-{uuid.uuid4().hex}")


def _sorted(df: DataFrame, order: list[str], keep: list[str], name: str) -> DataFrame:
    """``keep`` of all rows with the partition of the sorted order (``part``) and the place in it (``nth``), written."""
    place = F.monotonically_increasing_id()
    s = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*keep, place.alias("place"))
    return written(s, name).select(*keep, F.shiftright("place", 33).alias("part"), (F.col("place") % (1 << 33)).alias("nth"))


def fractional_ranks(rows: DataFrame, seed: int) -> DataFrame:
    """(row, uid, stratum, shuffled) -> (row, uid, stratum, rank), rank from 0 to below 1 in each stratum."""
    s = _sorted(rows, ["stratum", "shuffled", "row", "uid"], ["stratum", "row", "uid"], "shard-strata")
    runs = s.groupBy("part", "stratum").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("stratum")
    before = F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("part", "stratum", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(w).alias("total"))
    start = F.pmod(F.xxhash64(F.lit(seed), "stratum"), F.lit(1 << 20)) / float(1 << 20)
    return s.join(written(runs, "shard-runs"), ["part", "stratum"]).select(
        "row", "uid", "stratum", ((F.col("nth") + F.col("shift") + start) / F.col("total")).alias("rank"))


def places(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """(row, uid, stratum, shuffled) -> (row, shard, slot)."""
    s = _sorted(fractional_ranks(rows, seed), ["rank", "stratum", "row", "uid"], ["row"], "shard-order")
    n = s.groupBy("part").agg(F.count("*").alias("n"))
    w = Window.orderBy("part")  # a row a partition
    n = written(n.select("part", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total")), "shard-offsets")
    at = s.join(n, "part").select("row", "total", (F.col("nth") + F.col("before")).alias("at"))
    at = at.withColumn("shard", F.expr(f"(at * {shards}) div total"))
    return at.select("row", F.col("shard").cast("int").alias("shard"),
                     (F.col("at") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).alias("slot"))


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
           stratum_col: str = "source", seed: int = SEED) -> DataFrame:
    """(doc, shard, slot) for every row of ``docs``: ``doc`` has its columns."""
    rows = docs.select(F.struct("*").alias("doc")).select("doc", F.unhex(F.md5(F.to_json("doc").cast("binary"))).alias("row"))
    keys = rows.select("row", F.monotonically_increasing_id().alias("uid"),
                       F.to_json(F.struct(F.col("doc")[stratum_col].alias("s"))).alias("stratum"),
                       F.xxhash64(F.lit(seed), F.col("doc")[id_col], F.col("doc")[text_col]).alias("shuffled"))
    at = places(written(keys, "shard-keys"), shards, seed)
    return rows.dropDuplicates(["row"]).join(at, "row").select("doc", "shard", "slot")


def write(docs: DataFrame, path: str, shards: int = 24, **columns) -> DataFrame:
    """The shards as folders of Parquet files at ``path``, each file a stretch of
    slots in order; returns their rows, read back: (doc, slot, shard)."""
    a = assign(docs, shards, **columns)
    out = a.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    out.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(a.schema).parquet(path)
