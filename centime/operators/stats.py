"""Distributed statistics helpers: exact quantiles, exact per-group rank
cut-offs, keep-first de-duplication, profiling (A14, A23-A25, U2-U8, W9).

None of them sorts a whole group in one task or collects what grows with it:
* exact quantiles count rows in value ranges and narrow the range of a rank
  until it holds at most ``PICK`` rows;
* rank cut-offs count rows per (group, bucket of the order key) and sort the
  rows of the one bucket that straddles the cut-off, to find the key there;
* keep-first de-duplication is a ``min_by`` aggregate, combined map-side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

BUCKET_ROWS = 500_000  # rows of a group that a task sorts at most, about
BINS = 2048  # value ranges counted at once for a rank
PICK = 100_000  # rows among which a rank is picked on the driver


# ------------------------------------------------------------- quantiles ---

def exact_quantiles(df: DataFrame, col: str, probs: list[float]) -> list[float]:
    """Linear-interpolation quantiles (pandas/numpy 'linear', DuckDB
    ``quantile_cont``) of a numeric column, exact.

    Every rank has a value range that holds it.  A pass counts the rows of each
    range in ``BINS`` equal parts and narrows the range to the least and greatest
    value of the part with the rank; a range of at most ``PICK`` rows is fetched
    as (value, count) and the rank read off.  What reaches the driver is bounded
    by the number of ranks, not by the data.
    """
    v = materialize(df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")))
    n, low, high = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if n == 0:
        return [float("nan")] * len(probs)
    targets = []
    for q in probs:
        pos = q * (n - 1)
        lo = int(math.floor(pos))
        targets.append((lo, min(lo + 1, n - 1), pos - lo))
    values: dict[int, float] = {}
    # rank -> (least value, greatest value, rows below, rows inside)
    open_ = {r: (low, high, 0, n) for lo, hi, _ in targets for r in (lo, hi)}
    while open_:
        for r in [r for r, (lo, hi, _, _) in open_.items() if lo == hi]:
            values[r] = open_.pop(r)[0]
        if not open_:
            break
        spans = sorted({s for s in open_.values()})
        few = {s for s in spans if s[3] <= PICK}
        found: dict[tuple, list] = {s: [] for s in spans}
        inside = [F.col("v").between(s[0], s[1]) for s in spans]
        part = F.array(*[F.when(c, F.struct(
            F.lit(i).alias("i"),
            (F.col("v") if s in few else F.least(F.floor((F.col("v") - s[0]) / ((s[1] - s[0]) / BINS)), F.lit(BINS - 1)).cast("double")).alias("b")))
            for i, (s, c) in enumerate(zip(spans, inside))])
        rows = (v.select("v", F.explode(F.array_compact(part)).alias("p")).groupBy("p.i", "p.b")
                .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("i", "b").collect())
        for x in rows:
            found[spans[x["i"]]].append(x)
        for r, s in list(open_.items()):
            below = s[2]
            for x in found[s]:
                if r < below + x["n"]:
                    open_[r] = (x["lo"], x["hi"], below, x["n"])
                    break
                below += x["n"]
    return [values[lo] + (values[hi] - values[lo]) * frac for lo, hi, frac in targets]


# ------------------------------------------------------------ rank cuts ---

KEY_BITS = 60


def _key_bucket(key: Column, n_buckets: int) -> Column:
    """Order-preserving bucket of a ``seeded_hash``."""
    return F.floor(key.cast("double") / (2.0 ** KEY_BITS / n_buckets)).cast("long")


def _buckets(n: int) -> int:
    return max(64, -(-n // BUCKET_ROWS) * 4)


def rank_below(df: DataFrame, partition_cols: list[str], order_key: Column, cutoff: Column, tie: list[str]) -> DataFrame:
    """Flag ``in_head`` = the row's 1-based rank within its partition (by
    ``order_key``, a ``seeded_hash``, then by the ``tie`` columns) is
    <= ``cutoff`` (a column computed per partition, e.g. from its size).

    The input is written once.  Rows are counted per (partition, bucket of the
    key); the rows of the bucket that straddles the cut-off, and of no other, are
    numbered, which gives the partition's last key inside.  All rows then compare
    with that key.  The number of buckets follows from the row count.  What is known
    of a partition is one row, broadcast: partitions are few (classes, or the whole
    table), and dealt by them the rows of each would meet in one task.
    """
    pc = [F.col(c) for c in partition_cols]
    k = materialize(df.withColumn("_ok", order_key.cast("long")).withColumn("_cut", cutoff.cast("long")))
    buckets = _buckets(k.count())
    k = k.withColumn("_b", _key_bucket(F.col("_ok"), buckets))
    per = k.groupBy(*pc, "_b").agg(F.count("*").alias("_n"), F.max("_cut").alias("_c"))
    w = Window.partitionBy(*pc).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    last = per.filter((F.col("_before") < F.col("_c")) & (F.col("_before") + F.col("_n") >= F.col("_c")))
    key = F.struct("_ok", *tie)
    inside = k.join(F.broadcast(last.select(*pc, "_b", "_before")), [*partition_cols, "_b"])
    rn = F.row_number().over(Window.partitionBy(*pc, "_b").orderBy("_ok", *tie)) + F.col("_before")
    edge = inside.withColumn("_rn", rn).filter(F.col("_rn") == F.col("_cut")).select(*pc, key.alias("_edge"))
    return (k.join(F.broadcast(edge), partition_cols, "left")
            .select(*[F.col(c) for c in df.columns], F.coalesce(key <= F.col("_edge"), F.lit(False)).alias("in_head")))


def _size_row(df: DataFrame) -> DataFrame:
    """The row count as a one-row table, broadcast (its size is one row), so
    joining it never moves the big side."""
    return F.broadcast(df.agg(F.count("*").alias("_size")).withColumn("_all", F.lit(1)))


def seeded_hash(cols: list[str], seed: int) -> Column:
    """A deterministic pseudo-random order key of 60 bits (replaces a seeded
    shuffle, U8); any engine with MD5 can reproduce it."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def stratified_split(df: DataFrame, strata: list[str], key_cols: list[str], test_fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """U4: per stratum, exactly round(test_fraction * n) rows go to 'test'
    (those with the smallest seeded hash), the rest to 'train'."""
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_size"))
    d = df.join(F.broadcast(sizes), strata, "inner")  # a row a stratum
    flagged = rank_below(d, strata, seeded_hash(key_cols, seed), F.round(F.col("_size") * test_fraction), key_cols)
    return flagged.withColumn("split", F.when(F.col("in_head"), "test").otherwise("train")).drop("in_head", "_size")


def positional_split(df: DataFrame, key_cols: list[str], test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Seeded shuffle then positional cut: the first int(n*(1-f)) rows
    are 'train' (no strata)."""
    d = df.withColumn("_all", F.lit(1)).join(_size_row(df), "_all")
    flagged = rank_below(d, ["_all"], seeded_hash(key_cols, seed), F.floor(F.col("_size") * (1 - test_fraction)), key_cols)
    return flagged.withColumn("split", F.when(F.col("in_head"), "train").otherwise("test")).drop("in_head", "_size", "_all")


def group_split(df: DataFrame, group_col: Column, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Whole groups (e.g. lower(merchant)) go to one side; round(f * groups)
    groups, chosen by seeded hash, form 'test'.  Distinct groups are ranked
    with the same bucketed cut, then joined back."""
    g = df.select(group_col.alias("_g")).distinct()
    g = g.withColumn("_all", F.lit(1)).join(_size_row(g), "_all")
    flagged = rank_below(g, ["_all"], seeded_hash(["_g"], seed), F.round(F.col("_size") * test_fraction), ["_g"])
    sides = flagged.select("_g", F.when(F.col("in_head"), "test").otherwise("train").alias("split"))
    return df.withColumn("_g", group_col).join(sides, "_g", "inner").drop("_g")


def stratified_folds(df: DataFrame, label: str, key_cols: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """fold = (rank within label by seeded hash - 1) mod k, with
    k = max(2, min(k, smallest class)).  The rank is exact per label but
    computed from bucket counts plus a window inside each bucket, whose size
    doesn't grow with the input."""
    d = materialize(df.withColumn("_ok", seeded_hash(key_cols, seed)))
    sizes = d.groupBy(label).count().agg(F.min("count"), F.sum("count")).first()
    kk = max(2, min(k, int(sizes[0] or 0)))
    d = d.withColumn("_b", _key_bucket(F.col("_ok"), _buckets(int(sizes[1] or 0))))
    per = d.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    d = d.join(per.drop("_n"), [label, "_b"])
    rn = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_ok", *key_cols)) + F.col("_before")
    return d.withColumn("fold", ((rn - 1) % kk).cast("int")).drop("_ok", "_b", "_before")


def hash_folds(df: DataFrame, key_cols: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Unstratified shuffled folds, fold = pmod(hash, k)."""
    return df.withColumn("fold", (seeded_hash(key_cols, seed) % k).cast("int"))


# ---------------------------------------------------------- de-dup etc. ---

def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per ``keys``, the first by ``order`` (deterministic).

    ``min_by`` over a struct is a partial aggregate: duplicates are reduced
    map-side, so a key repeated in a third of the rows does not pile up in
    one task.
    """
    others = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in others]), F.struct(*[F.col(c) for c in order])).alias("_r"))
    return g.select(*keys, *[F.col("_r")[c].alias(c) for c in others])


def profile(df: DataFrame, label: str | None = None) -> DataFrame:
    """Null count per column and duplicate-row count in one aggregate."""
    aggs = [F.count("*").alias("rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in df.columns]
    aggs += [F.count_distinct(F.struct(*[F.col(c) for c in df.columns])).alias("_distinct")]
    p = df.agg(*aggs)
    return p.withColumn("duplicate_rows", F.col("rows") - F.col("_distinct")).drop("_distinct")


def distinct_count(df: DataFrame, by: list[str], col: Column, exact: bool = True) -> DataFrame:
    """Distinct values per group (exact, or HyperLogLog++ when not)."""
    f = F.count_distinct(col) if exact else F.approx_count_distinct(col)
    return df.groupBy(*by).agg(f.alias("distinct_values"))
