"""Operator 3, exact dedup, with DataFrame functions only.

Texts are equal when identical after every run of white space became one
space.  A copied text may own a third of all rows, so equal digests are not
simply brought together by a shuffle:

1. every row's digest is written once (id, row number, digest; no text);
2. a Misra-Gries sketch (``approx_top_k``: frequent-items counters, merged
   from partial sketches) names at most ``HEAVY`` digests that may be frequent;
3. their winners are verified by an exact count and minimum (partial
   aggregates, one row a task and digest) and broadcast: at most ``HEAVY``
   rows, whatever the input, so rows of hot digests are settled on the map side;
4. all remaining digests go through an ordinary shuffle.  None of them holds
   more than about 1 / ``TRACKED`` of the rows.

Defined results: null text counts as empty; of equal texts the smallest id
stays (a null id sorts after all others); a repeated (id, text) row is a copy
like any other, one of them stays; an empty table gives an empty table; other
columns are ignored by ``annotate`` and kept by ``dedup``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

HEAVY = 256  # frequent digests at most, the bound of what is broadcast
TRACKED = 4096  # counters of the Misra-Gries sketch


def digest(text):
    """Lower-case hex SHA-256 of the text with white-space runs as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


def frequent(d: DataFrame) -> DataFrame:
    """Digests that the sketch finds frequent: at most ``HEAVY`` rows."""
    top = d.agg(F.expr(f"approx_top_k(digest, {HEAVY}, {TRACKED})").alias("top"))
    return top.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("digest"))


def _settle(digests: DataFrame) -> DataFrame:
    """(id, row, digest) -> also keep_id, group_size, kept."""
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row"))
    hot = written(frequent(digests), "dedup-frequent")
    winners = (digests.join(F.broadcast(hot), "digest", "left_semi")
               .groupBy("digest").agg(F.min(order).alias("win"), F.count("*").alias("group_size")))
    winners = written(winners, "dedup-winners")
    heavy = digests.join(F.broadcast(winners), "digest")
    w = Window.partitionBy("digest")
    light = (digests.join(F.broadcast(hot), "digest", "left_anti")
             .withColumn("win", F.min(order).over(w)).withColumn("group_size", F.count("*").over(w)))
    cols = ["id", "row", "digest", F.col("win.id").alias("keep_id"), "group_size",
            (F.col("row") == F.col("win.row")).alias("kept")]
    return heavy.select(*cols).unionByName(light.select(*cols))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, digest."""
    d = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
                    digest(F.col(text_col)).alias("digest"))
    return _settle(written(d, "dedup-digests")).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns unchanged."""
    tagged = written(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "dedup-rows")
    d = tagged.select(F.col("doc")[id_col].alias("id"), "row", digest(F.col("doc")[text_col]).alias("digest"))
    kept = _settle(written(d, "dedup-digests")).where("kept").select("row")
    return tagged.join(kept, "row", "left_semi").select("doc.*")
