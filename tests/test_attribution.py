"""Tree attributions against sums over all subsets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest

from quorumstat.operators import attribution as at
from quorumstat.operators import models


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    x[:, 5] = np.round(x[:, 5])
    y = x[:, 0] * x[:, 1] + np.sin(2 * x[:, 2]) + 0.3 * x[:, 5]
    d = spark.createDataFrame([(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id int, v array<double>, y double").repartition(3).cache()
    return d, x


def value(trees, row, known):
    """The trees' value for a row of which some features are known, by walking each leaf's path."""
    return sum(leaf.value * np.prod([float(leaf.holds(row[None], f)[0]) if f in known else leaf.share[f] for f in leaf.bounds]) for t in trees for leaf in t)


def by_subsets(trees, row, dim):
    out = np.zeros(dim)
    for i in range(dim):
        rest = [j for j in range(dim) if j != i]
        for s in range(dim):
            w = factorial(s) * factorial(dim - 1 - s) / factorial(dim)
            for known in combinations(rest, s):
                out[i] += w * (value(trees, row, {*known, i}) - value(trees, row, set(known)))
    return out


@pytest.mark.parametrize("algo, kw", [("forest", {"trees": 4, "depth": 4}), ("boosting", {"trees": 6})])
def test_equal_to_all_subsets(data, algo, kw):
    d, x = data
    m = models.fit(models.vectors(d, "v"), algo, **kw)
    got = at.tree_attributions(m, d.select("id", "v"), d, "v", 6).orderBy("id").collect()
    pred = {r.id: r.pred for r in models.score(m, models.vectors(d, "v"), ["id"]).collect()}
    mean = np.mean(list(pred.values()))
    for r in got:
        assert abs(r.base - mean) < 1e-9 and abs(sum(r.attributions) + r.base - pred[r.id]) < 1e-9
    trees, n = at.with_shares(at.leaves(m), d, "v")
    assert n == 400
    for i in (0, 17, 230):
        assert np.allclose(got[i].attributions, by_subsets(trees, x[i], 6), atol=1e-9)


def test_shares_by_a_plain_walk(data):
    """A leaf's shares multiply to the share of the background that it holds."""
    d, x = data
    m = models.fit(models.vectors(d, "v"), "forest", trees=3, depth=5)
    trees, _ = at.with_shares(at.leaves(m), d, "v")
    for t in trees:
        held = [np.logical_and.reduce([leaf.holds(x, f) for f in leaf.bounds]).mean() for leaf in t]
        assert np.allclose(held, [np.prod(list(leaf.share.values())) for leaf in t]) and abs(sum(held) - 1) < 1e-12


def test_nulls_no_rows_and_other_backgrounds(spark, data):
    d, x = data
    m = models.fit(models.vectors(d, "v"), "boosting", trees=3)
    none = at.tree_attributions(m, d.limit(0), d, "v", 6)
    assert none.count() == 0 and none.columns == [*d.columns, "attributions", "base"]
    few = d.filter("id < 3")  # some ways have no row
    got = at.tree_attributions(m, d.unionByName(spark.createDataFrame([(9999, None, 0.0)], d.schema)), few, "v", 6).collect()
    pred = {r.id: r.pred for r in models.score(m, models.vectors(d, "v"), ["id"]).collect()}
    assert len(got) == 400
    assert all(abs(sum(r.attributions) + r.base - pred[r.id]) < 1e-9 for r in got)
    s = {r.feature: r for r in at.attribution_summary(at.tree_attributions(m, d, d, "v", 6)).collect()}
    assert max(s, key=lambda f: s[f].importance) in (0, 1, 2) and s[4].importance < s[2].importance
