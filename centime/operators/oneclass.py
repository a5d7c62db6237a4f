"""One-class outlier model with an RBF kernel.

The kernel is replaced by ``width`` random Fourier features z(x) with z(x) . z(y) ~
exp(-gamma |x - y|^2).  The nu one-class problem then asks for the shortest vector w
among the weighted means of z whose row weights are at most 1 / (nu n).  Steps of
conditional gradient find it: the best such mean against w takes the nu n rows of lowest
w . z(x), and w moves towards it as far as its length shrinks.

A step is one pass: tasks sum z by bins of w . z(x), the sums are added up in Spark, and
only ``BINS`` x ``width`` numbers reach the driver.  Where the bin at the cut is taken in
part, its rows share the weight; that mean is allowed too, so no step can go wrong,
and the bins close in on the cut from step to step.  The steps end when the gap, which bounds
how far |w|^2 / 2 is from its least, is under ``tol`` |w|^2, or after ``steps`` passes.

Defined results: a missing or NaN feature counts as the column's mean; a constant column
is 0 if scaled; ``nu`` is at least one row's share; an empty table gives a model that
scores 0; repeated rows get equal scores; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import written

BINS = 64
CHUNK = 4096  # rows whose features are held at once


@dataclass
class OneClass:
    features: list[str]
    mean: np.ndarray  # what a missing value becomes
    shift: np.ndarray
    scale: np.ndarray
    turn: np.ndarray  # features x width / 2
    w: np.ndarray
    gap: float = 0.0

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = (np.where(np.isnan(x), self.mean, x) - self.shift) * self.scale
        angle = x @ self.turn
        return np.concatenate([np.cos(angle), np.sin(angle)], axis=1) / np.sqrt(angle.shape[1])  # of length 1


def _matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in features]).astype(float)


def _start(df: DataFrame, features: list[str], scaled: list[str], width: int, seed: int) -> tuple[OneClass, int]:
    col = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in features}
    stats = df.agg(F.count("*").alias("n"), *[f(col[c]).alias(f"{k}_{i}") for i, c in enumerate(features)
                                              for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean, dev = (np.array([stats[f"{k}_{i}"] or 0.0 for i in range(len(features))]) for k in "ms")
    is_scaled = np.isin(features, scaled)
    shift = np.where(is_scaled, mean, 0.0)
    scale = np.where(is_scaled, np.where(dev > 0, 1.0 / np.where(dev > 0, dev, 1.0), 0.0), 1.0)
    m, s = (mean - shift) * scale, dev * scale
    spread = float(np.mean(s ** 2 + m ** 2) - np.mean(m) ** 2)  # variance of all entries
    gamma = 1.0 / (len(features) * spread) if spread > 0 else 1.0
    rng = np.random.default_rng(seed)
    turn = rng.normal(size=(len(features), width // 2)) * np.sqrt(2.0 * gamma)
    return OneClass(features, mean, shift, scale, turn, np.zeros(turn.shape[1] * 2)), stats["n"]


def _binned(rows: DataFrame, model: OneClass, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sum of z) of each bin of w . z(x)."""
    width = len(model.w)

    def run(batches):
        n, total = np.zeros(BINS), np.zeros((BINS, width))
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                z = model.lift(_matrix(batch.slice(at, CHUNK), model.features))
                k = np.searchsorted(edges, z @ model.w)
                n += np.bincount(k, minlength=BINS)
                total += (k == np.arange(BINS)[:, None]).astype(float) @ z
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(np.column_stack([n, total])[used]), pa.list_(pa.float64()))], ["bin", "sums"])

    sums = rows.mapInArrow(run, "bin int, sums array<double>").select("bin", F.posexplode("sums").alias("pos", "s"))
    out = np.zeros((BINS, width + 1))
    for bin_, pos, s in sums.groupBy("bin", "pos").agg(F.sum("s")).collect():
        out[bin_, pos] = s
    return out[:, 0], out[:, 1:]


def fit(df: DataFrame, features: list[str], nu: float, scaled: list[str] | None = None, width: int = 256,
        steps: int = 60, tol: float = 0.01, seed: int = 42) -> OneClass:
    """The model of all rows of ``df``; ``scaled`` columns (default: all) are standardised."""
    model, n = _start(df, features, features if scaled is None else scaled, width, seed)
    if not n:
        return model
    nu = min(1.0, max(nu, 1.0 / n))
    rows = written(df.select(*[F.col(c).cast("double").alias(c) for c in features]), "one-class")
    _, total = _binned(rows, model, np.linspace(-1, 1, BINS - 1))
    model.w = total.sum(axis=0) / n
    cut, half = 0.0, 1.0
    for _ in range(steps):
        edges = np.linspace(cut - half, cut + half, BINS - 1)
        count, total = _binned(rows, model, edges)
        part = np.clip(nu * n - (np.cumsum(count) - count), 0, count) / np.maximum(count, 1)
        lowest = part @ total / (nu * n)
        way = model.w - lowest
        model.gap = float(model.w @ way)
        at = int(np.flatnonzero(part)[-1])
        inside = 0 < at < BINS - 1
        if model.gap <= tol * float(model.w @ model.w) and inside and half < 0.05:
            break
        model.w = model.w - np.clip(model.gap / max(float(way @ way), 1e-12), 0, 1) * way
        cut = edges[min(at, BINS - 2)]
        half = half * 2 if not inside else half / 2 if half > 0.02 else half
    return model


def score(df: DataFrame, model: OneClass, out: str = "anomaly_score") -> DataFrame:
    """``df`` with minus w . z(x): the higher, the stranger."""
    schema = df.drop(out).withColumn(out, F.lit(0.0)).schema

    def run(batches):
        for batch in batches:
            s = [-(model.lift(_matrix(batch.slice(at, CHUNK), model.features)) @ model.w) for at in range(0, batch.num_rows, CHUNK)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.empty(0), *s]), pa.float64())],
                                             [*batch.schema.names, out])

    return df.drop(out).mapInArrow(run, schema)
