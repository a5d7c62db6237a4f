"""Connected components of an undirected edge list by alternating star
contractions: every node hands its neighbours the smallest node it knows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long"))).first()
    return tuple(r)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v) -> (node, label): the smallest node reachable, for every node
    that has a link to another one.

    Each round keeps at most the number of edges it began with; a hub's rows
    meet one written minimum, so that AQE may split them as a skewed join.
    The rounds needed grow with the logarithm of the longest chain.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), name)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, name)
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))))
        e = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
