"""One-class model (L9) against a dense kernel solution, and its edges."""

import numpy as np
from pyspark.sql import functions as F

from centime.operators import iforest as IF
from centime.operators import oneclass as OC
from centime.plans.registry import load_all

from conftest import SMALL


def dense_scores(x: np.ndarray, nu: float, steps: int = 4000) -> np.ndarray:
    """w . phi(x) of the nu one-class problem with the exact kernel, by conditional gradient on row weights."""
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    gamma = 1.0 / (x.shape[1] * x.var())
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    n = len(x)
    a = np.full(n, 1.0 / n)
    for _ in range(steps):
        f = k @ a
        s, left = np.zeros(n), 1.0
        for i in np.argsort(f):
            s[i] = min(left, 1.0 / (nu * n))
            left -= s[i]
            if left <= 0:
                break
        d = s - a
        a = a + np.clip(-(d @ f) / max(d @ k @ d, 1e-15), 0, 1) * d
    return k @ a


def ranks(v):
    return np.argsort(np.argsort(v))


def test_scores_follow_the_dense_solution(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(380, 3)), rng.uniform(-7, 7, size=(20, 3))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double").repartition(5)
    model = OC.fit(df, ["a", "b", "c"], 0.1, width=2048)
    got = np.array([r[0] for r in OC.score(df, model).orderBy("id").select("anomaly_score").collect()])
    want = -dense_scores(x, 0.1)
    assert np.corrcoef(ranks(got), ranks(want))[0, 1] > 0.97
    low = np.argsort(want)[-40:]
    assert len(set(low) & set(np.argsort(got)[-40:])) >= 36
    assert model.gap <= 0.05 * float(model.w @ model.w)


def test_share_of_flagged_rows_is_nu(spark):
    t = load_all()["one_class_scores"].build(spark, SMALL)
    n, flagged = t.agg(F.count("*"), F.count_if("is_outlier")).first()
    share = spark.read.parquet(f"{SMALL}/events.parquet").agg(F.avg((F.col("event_type") == "error").cast("double"))).first()[0]
    assert n == spark.read.parquet(f"{SMALL}/events.parquet").count()
    assert abs(flagged / n - share) < 0.01


def test_edges(spark):
    schema = "id long, a double, b double, anomaly_score string"
    empty = spark.createDataFrame([], schema)
    assert OC.score(empty, OC.fit(empty, ["a", "b"], 0.1)).count() == 0
    rows = spark.createDataFrame([(i, 1.0 * (i % 5), 3.0, "x") for i in range(50)] + [(50, None, float("nan"), "x"), (51, 90.0, 3.0, "x")], schema)
    got = {r["id"]: r["anomaly_score"] for r in OC.score(rows, OC.fit(rows, ["a", "b"], 0.0, steps=8)).collect()}
    assert len(got) == 52 and all(np.isfinite(v) for v in got.values())
    assert got[0] == got[5] and got[51] == max(got.values())
