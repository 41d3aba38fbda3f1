"""Landmark kernel ridge against the full kernel in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumstat.operators import kernels


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 3))
    y = np.sin(x[:, 0] * 2) + x[:, 1] ** 2 + rng.normal(size=240) * 0.05
    rows = [(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame([*rows, (900, None, 1.0), (901, [0.0, 0.0, 0.0], None)], "id int, v array<double>, y double").repartition(4)


def predicted(model, df):
    return {r.id: r.p for r in df.select("id", model.predict("v").alias("p")).collect()}


def test_all_rows_as_landmarks_is_the_full_kernel(data):
    x, y, df = data
    model = kernels.fit(df, "id", "v", "y", landmarks=1000, alpha=0.5)
    gamma = 1 / (3 * x.var())
    assert abs(model.gamma - gamma) < 1e-9
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    want = k @ np.linalg.solve(k + 0.5 * np.eye(len(x)), y - y.mean()) + y.mean()
    got = predicted(model, df)
    assert got[900] is None and got[901] is not None
    assert max(abs(got[i] - want[i]) for i in range(240)) < 1e-6


def test_error_falls_with_landmarks(data):
    x, y, df = data
    rng = np.random.default_rng(9)
    t = rng.normal(size=(150, 3))
    truth = np.sin(t[:, 0] * 2) + t[:, 1] ** 2
    test = df.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(t)], "id int, v array<double>")
    err = []
    for n in (4, 30, 240):
        got = predicted(kernels.fit(df, "id", "v", "y", n, 0.1), test)
        err.append(np.mean([(got[i] - truth[i]) ** 2 for i in range(150)]))
    assert err[0] > err[1] > err[2] and err[2] < 0.25 * truth.var()


def test_refused_and_constant(data):
    _, _, df = data
    with pytest.raises(ValueError):
        kernels.fit(df.filter("y is null"), "id", "v", "y")
    same = df.filter("id < 50").withColumn("v", F.array(F.lit(1.0), F.lit(1.0)))
    model = kernels.fit(same, "id", "v", "y")
    assert abs(predicted(model, same)[3] - model.mean) < 1e-9
