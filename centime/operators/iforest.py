"""Isolation forest on Spark.

Every tree is grown from exactly ``sample_size`` rows (all rows of a smaller
table).  The pool they are drawn from holds the ``n_trees * sample_size`` rows
with the smallest hash of their id, so the forest is the same for any
partitioning; pool (bounded) and grown forest (n_trees x <= 2 * sample_size
nodes) are broadcast, trees grow in parallel tasks, and every row is scored in
``mapInPandas`` batches: s = 2^(-E[h(x)] / c(sample size of the tree)).  The outlier
threshold is the (1 - contamination) quantile of the scores, which are written
once and read for threshold and flags.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import materialize

EULER = 0.5772156649015329
NODE_SCHEMA = ("tree_id int, node int, feature int, threshold double, left int, right int, size long, "
               "depth int")


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful search in a BST of n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(tree_id: int, x: np.ndarray, max_depth: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed * 100003 + tree_id)
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, -1, None)]
    while stack:
        idx, depth, parent, side = stack.pop()
        me = len(nodes)
        nodes.append([tree_id, me, -1, 0.0, -1, -1, len(idx), depth])
        if parent >= 0:
            nodes[parent][4 if side == "l" else 5] = me
        if depth >= max_depth or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if cand.size == 0:
            continue
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < t]
        right = idx[sub[:, f] >= t]
        nodes[me][2], nodes[me][3] = f, t
        stack.append((right, depth + 1, me, "r"))
        stack.append((left, depth + 1, me, "l"))
    return [tuple(n) for n in nodes]


def fit(df: DataFrame, features: list[str], id_col: str, n_trees: int = 200, sample_size: int = 256,
        seed: int = 42) -> pd.DataFrame:
    """Grow the forest; returns the node table (small, bounded) on the driver."""
    spark, want, top = df.sparkSession, n_trees * sample_size, 1 << 30
    n = df.count()
    h = F.xxhash64(id_col, F.lit(seed))
    pool = df.select(h.alias("_h"), *[F.col(c).cast("double").alias(c) for c in features])
    if n > 2 * want:  # a share that holds about twice the pool, cut in the tasks
        pool = pool.filter(F.pmod("_h", F.lit(top)) < int(top * 2 * want / n))
    pool = pool.orderBy(F.pmod("_h", F.lit(top)), "_h").limit(want).toPandas()
    x = np.nan_to_num(pool[features].to_numpy(dtype=float))
    psi = min(sample_size, len(x))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    shared = spark.sparkContext.broadcast(x)

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf["id"]:
                rows = np.random.default_rng((seed, int(t))).choice(len(shared.value), psi, replace=False)
                yield pd.DataFrame(_grow(int(t), shared.value[rows], max_depth, seed),
                                   columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])

    if not psi:
        return pd.DataFrame(columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])
    return spark.range(n_trees).mapInPandas(grow, NODE_SCHEMA).toPandas()


def score(df: DataFrame, forest: pd.DataFrame, features: list[str], out: str = "anomaly_score") -> DataFrame:
    """Score every row with the broadcast forest (vectorised per batch)."""
    trees = []
    for _, t in forest.groupby("tree_id"):
        t = t.sort_values("node")
        trees.append((t["feature"].to_numpy(), t["threshold"].to_numpy(), t["left"].to_numpy(),
                      t["right"].to_numpy(), t["size"].to_numpy(), t["depth"].to_numpy()))
    bc = df.sparkSession.sparkContext.broadcast(trees)
    schema = StructType(list(df.schema.fields) + [StructField(out, DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest_ = bc.value
        for pdf in batches:
            x = np.nan_to_num(pdf[features].to_numpy(dtype=float))
            total = np.zeros(len(pdf))
            for feat, thr, left, right, size, depth in forest_:
                node = np.zeros(len(pdf), dtype=int)
                for _ in range(int(depth.max()) + 1):
                    f = feat[node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    go_left = np.zeros(len(pdf), dtype=bool)
                    rows = np.flatnonzero(inner)
                    go_left[rows] = x[rows, f[rows]] < thr[node[rows]]
                    node = np.where(inner, np.where(go_left, left[node], right[node]), node)
                total += (depth[node] + c_factor(size[node])) / (float(c_factor([size[0]])[0]) or 1.0)
            pdf[out] = np.power(2.0, -total / max(len(forest_), 1))
            yield pdf

    return df.mapInPandas(run, schema)


def flag_outliers(scored: DataFrame, contamination: float, col: str = "anomaly_score") -> DataFrame:
    """Rows whose score is at or above the (1 - contamination) quantile."""
    scored = materialize(scored)
    thr = scored.agg(F.percentile_approx(col, 1.0 - contamination, 100000)).first()[0]
    return scored.withColumn("is_outlier", F.col(col) >= F.lit(thr))
