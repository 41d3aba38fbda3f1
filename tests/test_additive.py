"""Boosted additive shapes against boosting over rows in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumstat.operators import additive


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(700, 4))
    x[:, 3] = np.round(x[:, 3])  # ties: empty bins
    y = np.sin(x[:, 0]) + 0.5 * x[:, 1] + rng.normal(size=700) * 0.3
    d = spark.createDataFrame([(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id int, v array<double>, y double").repartition(3)
    return d.cache(), x, y


def by_rows(x, y, bins, rounds, rate, monotone):
    """One residual per row, updated feature by feature."""
    edges = [np.quantile(c, np.arange(1, bins) / bins) for c in x.T]
    cell = np.stack([(c[:, None] > e).sum(axis=1) for c, e in zip(x.T, edges, strict=True)], axis=1)
    shapes = np.zeros((x.shape[1], bins))
    mean = y.mean()
    for _ in range(rounds):
        for f in range(x.shape[1]):
            resid = y - mean - shapes[np.arange(x.shape[1]), cell].sum(axis=1)
            n = np.bincount(cell[:, f], minlength=bins)
            shapes[f] += rate * np.divide(np.bincount(cell[:, f], resid, bins), n, out=np.zeros(bins), where=n > 0)
            if f in monotone:  # min-max form of the monotone fit
                w, v, s = n, shapes[f].copy(), monotone[f]
                full = np.flatnonzero(w)
                fit = {j: max(min(np.average(s * v[full[a : b + 1]], weights=w[full[a : b + 1]]) for b in range(i, len(full))) for a in range(i + 1)) for i, j in enumerate(full)}
                last = fit[full[0]]
                for j in range(bins):
                    last = fit.get(j, last)
                    shapes[f][j] = s * last
    n = np.stack([np.bincount(c, minlength=bins) for c in cell.T])
    off = (shapes * n).sum(axis=1) / len(y)
    return mean + off.sum(), shapes - off[:, None], cell


@pytest.mark.parametrize("monotone", [{}, {0: 1, 1: -1, 3: 1}])
def test_shapes_equal_boosting_over_rows(data, monotone):
    d, x, y = data
    got = additive.additive_shapes(d, "v", 4, "y", 6, 25, 0.3, monotone)
    rows = got.collect()
    mean, shapes, cell = by_rows(x, y, 6, 25, 0.3, monotone)
    assert np.allclose([r.shape for r in rows], shapes.ravel(), atol=1e-9) and abs(rows[0].intercept - mean) < 1e-9
    p = additive.additive_predict(d, "v", got).orderBy("id").collect()
    assert np.allclose([r.prediction for r in p], mean + shapes[np.arange(4), cell].sum(axis=1), atol=1e-9)
    imp = {r.feature: r.importance for r in additive.shape_importance(got).collect()}
    assert np.allclose([imp[f] for f in range(4)], np.abs(shapes[np.arange(4), cell]).mean(axis=0), atol=1e-9)


def test_a_planted_effect_keeps_its_sign(data):
    d, x, y = data
    free = additive.additive_shapes(d, "v", 4, "y", 8, 60, 0.2)
    held = additive.additive_shapes(d, "v", 4, "y", 8, 60, 0.2, {0: 1, 1: 1, 2: -1})
    steps = lambda s, f: np.diff([r.shape for r in s.orderBy("feature", "bin").collect() if r.feature == f])
    assert (steps(held, 1) >= -1e-12).all() and steps(held, 1).sum() > 1 and (steps(held, 0) >= -1e-12).all()
    assert (steps(free, 0) < -1e-6).any() or (steps(free, 2) > 1e-6).any()
    assert (steps(held, 2) <= 1e-12).all()


def test_nulls_and_no_rows(spark, data):
    d, x, y = data
    more = d.unionByName(spark.createDataFrame([(9999, None, 1.0), (9998, [1.0, 2.0, 3.0, 4.0], None)], d.schema))
    a, b = (additive.pair_counts(k.withColumn("c", additive.bin_numbers("v", [[0.0]] * 4)), "c", 4, 2, "y") for k in (d, more.filter("v is not null")))
    assert np.allclose(a, b)
    none = additive.additive_shapes(d.limit(0), "v", 4, "y", 3, 5)
    assert none.agg(F.sum("n"), F.max(F.abs("shape"))).first()[:] == (0, 0.0)
    with pytest.raises(ValueError, match="cells"):
        additive.pair_counts(d, "v", 500, 16, "y")
