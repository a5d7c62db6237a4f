"""Ridge models from summed products, and seasonal models of every fold, against refits."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from centime.operators import forecast as FC
from centime.operators import linear as LN
from centime.operators import series as S


def refit(x, y, alpha):
    """Ridge on standardised features with a free intercept."""
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 0, sd, 1.0)
    z = (x - mean) / sd
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean(0)))
    return lambda a: (a - mean) / sd @ beta + y.mean(0)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) * [1.0, 100.0, 1e4] + [0.0, 5e5, 7.0]
    x[:, 2] = np.round(x[:, 2])
    y = np.stack([x @ [3.0, 0.1, -0.002] + rng.normal(size=300), x[:, 0] ** 2], 1)
    return [(i, i % 5, i // 60, *map(float, x[i]), 1.0, float(y[i, 0]), float(y[i, 1])) for i in range(300)], x, y


def test_ridge_of_other_folds_and_earlier_blocks(spark, rows):
    data, x, y = rows
    x = np.concatenate([x, np.ones((300, 1))], 1)  # a constant feature
    d = spark.createDataFrame(data, "i long, fold int, block int, a double, b double, c double, one double, y double, z double").repartition(4)
    names = ["a", "b", "c", "one"]
    v = d.select("i", "fold", "block", LN.vector(names, ["y", "z"], {"b": 5e5}).alias("v"))
    other = LN.ridge(LN.of_other_folds(LN.products(v, ["fold"]), [], "fold"), ["fold"], 4, 10.0)
    earlier = LN.ridge(LN.of_earlier_blocks(LN.products(v, ["block"]), [], "block"), ["block"], 4, 10.0)
    which = np.arange(300)
    for key, model, seen in (("fold", other, lambda k: which % 5 != k), ("block", earlier, lambda k: which // 60 < k)):
        got = {r.i: (r[key], r.predictions) for r in LN.predict(v, model, [key]).collect()}
        assert len(got) == (300 if key == "fold" else 240)
        for k in {k for k, _ in got.values()}:
            want = refit(x[seen(k)], y[seen(k)], 10.0)(x)
            for i in [i for i, (f, _) in got.items() if f == k]:
                assert got[i][1] == pytest.approx(want[i], rel=1e-6, abs=1e-6)


def test_seasonal_model_of_every_fold(spark):
    start = dt.date(2024, 1, 1)
    data = [(s, start + dt.timedelta(days=i), float((i * 7 + s) % 13) + 0.25, None) for s in (1, 2) for i in range(40 + s)]
    d = S.expanding_folds(spark.createDataFrame(data, "s int, date date, total_spend double, rolling_mean_7 double"), ["s"])
    got = {(r.s, r.cv_block): (r.global_mean, r.multipliers) for r in FC.seasonal_fit_folds(d, ["s"]).collect()}
    assert len(got) == 10
    for (s, k), (mean, mults) in got.items():
        one = FC.seasonal_model(FC.seasonal_fit(d.where((F.col("s") == s) & (F.col("cv_block") < k)), ["s"]), ["s"]).first()
        assert (mean, mults) == (pytest.approx(one.global_mean), pytest.approx(one.multipliers))
    assert FC.seasonal_predict_folds(d, ["s"]).count() == d.where("cv_block >= 0").count()
