"""Operators without a SQL twin against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumstat.operators import linear, resample, slopes, timeline
from quorumstat.operators.stats import spearman


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    n, d = 240, 6
    mix = rng.normal(size=(d, d))
    x = rng.normal(size=(n, d)) @ mix
    y = x @ rng.normal(size=d) + rng.normal(size=n) * 2
    c = np.arange(n) % 3
    df = spark.createDataFrame([(int(i), f"c{c[i]}", "A" if c[i] < 2 else "B", x[i].tolist(), float(y[i]), int(i // 3 % 4)) for i in range(n)],
                               "id int, corpus string, domain string, v array<double>, y double, fold int")
    return df.cache(), x, y, c


def ridge_loo(x, y, alphas):
    mu, sd = x.mean(0), x.std(0)
    z = (x - mu) / sd
    best = None
    for a in alphas:
        k = z.T @ z + a * np.eye(z.shape[1])
        h = 1 / len(y) + np.einsum("ij,jk,ik->i", z, np.linalg.inv(k), z)
        b = np.linalg.solve(k, z.T @ (y - y.mean()))
        e = ((y - y.mean() - z @ b) / (1 - h)) ** 2
        if best is None or e.sum() < best[0]:
            best = (e.sum(), a, b / sd, y.mean() - mu @ (b / sd))
    return best[1:]


def test_ridge_cv(corpus):
    df, x, y, _ = corpus
    a, b0, b = linear.ridge_cv(df, "v", 6, "y")
    ra, rb, rb0 = ridge_loo(x, y, linear.ALPHAS)
    assert a == pytest.approx(ra) and np.allclose(b, rb) and b0 == pytest.approx(rb0)


def test_ridge_oof_equals_refits(corpus):
    df, x, y, c = corpus
    got = {r["id"]: r["pred"] for r in linear.ridge_oof(df, "corpus", "fold", "id", "v", 6, "y").collect()}
    fold = np.arange(len(y)) // 3 % 4
    for k in range(3):
        for f in range(4):
            tr, te = (c == k) & (fold != f), (c == k) & (fold == f)
            _, b, b0 = ridge_loo(x[tr], y[tr], linear.ALPHAS)
            for i in np.flatnonzero(te):
                assert got[i] == pytest.approx(b0 + x[i] @ b)


def test_few_shot_counts(corpus):
    df = corpus[0]
    r = linear.few_shot(df, "corpus", "id", "v", 6, "y", [10, 20], 2, "fs").collect()
    assert len(r) == 6 * 2 * 2 and all(-1 <= x["rho"] <= 1 for x in r)


def test_coral_matches_covariance(corpus):
    df, x, _, c = corpus
    a, _ = linear.coral(df.filter("corpus = 'c0'"), df.filter("corpus = 'c1'"), "v", 6, 1e-9)
    z = np.array([r["aligned"] for r in a.orderBy("id").collect()])
    assert np.allclose(np.cov(z, rowvar=False), np.cov(x[c == 1], rowvar=False), atol=1e-5)
    assert np.allclose(z.mean(0), x[c == 1].mean(0))


def test_coral_sweep_equals_direct_alignment(corpus):
    df, x, y, c = corpus
    got = {(r["source"], r["target"], r["method"], r["standardised"]): r["rho"] for r in linear.coral_sweep(
        df, "corpus", "domain", "id", "v", 6, "y", [0.1]).collect()}
    assert len(got) == 6 * 5
    for std in (False, True):
        a, b = linear.coral(df.filter("corpus = 'c0'"), df.filter("corpus = 'c2'"), "v", 6, 0.1, std)
        z = np.array([r["aligned"] for r in a.orderBy("id").collect()])
        t = np.array([r["aligned"] for r in b.orderBy("id").collect()])
        _, w, w0 = ridge_loo(z, y[c == 0], linear.ALPHAS)
        rank = lambda v: np.argsort(np.argsort(v))
        want = np.corrcoef(rank(w0 + t @ w), rank(y[c == 2]))[0, 1]
        assert got[("c0", "c2", "coral", str(std))] == pytest.approx(want, abs=1e-6)


def test_subspace_dimensions(corpus):
    df = corpus[0]
    a, b = linear.subspace_align(df.filter("domain = 'A'"), df.filter("domain = 'B'"), "v", 6, 3)
    assert {r[0] for r in a.select(F.size("aligned")).collect()} == {3} and b.count() == 80


def test_decoding_finds_a_planted_signal(spark):
    rng = np.random.default_rng(5)
    rows = []
    for u in range(4):
        for i in range(60):
            v = rng.normal(size=5)
            rows.append((u, u * 100 + i, v.tolist(), float(v[0] * (2 if u < 2 else 0) + rng.normal())))
    d = spark.createDataFrame(rows, "unit int, key int, v array<double>, y double")
    r = {x["unit"]: x for x in linear.decode_units(d, "unit", "key", "v", 5, "y", 5, 5, 19, "dec").collect()}
    assert min(r[0]["rho"], r[1]["rho"]) > 0.6 and r[0]["p"] == pytest.approx(0.05)
    assert max(abs(r[2]["rho"]), abs(r[3]["rho"])) < 0.5


def test_cubic_order_control(skewed):
    d = timeline.control_order(skewed.withColumn("o", F.col("ts") / 1e5), ["unit"], "o", "x", "y", 3).filter("unit = 0").toPandas()
    for c in "xy":
        want = d[c] - np.polyval(np.polyfit(d["o"], d[c], 3), d["o"])
        assert np.allclose(d[f"{c}_r"], want, atol=1e-6)


def test_personalisation_gain_naive(skewed):
    d = skewed.select("unit", "x", "y").toPandas()
    gains = []
    for u, g in d.groupby("unit"):
        o = d[d.unit != u]
        pop = np.polyfit(o.x, o.y, 1)[0]
        own, base = [], []
        for j in range(len(g)):
            r = g.drop(g.index[j])
            dx, dy = g.x.iloc[j] - r.x.mean(), g.y.iloc[j] - r.y.mean()
            own.append((dy - np.polyfit(r.x, r.y, 1)[0] * dx) ** 2)
            base.append((dy - pop * dx) ** 2)
        gains.append(np.mean(base) - np.mean(own))
    got = slopes.personalisation_gain(skewed, "unit", "x", "y", 10, 5, "g").collect()[0]
    assert got["n"] == len(gains) and got["mean"] == pytest.approx(np.mean(gains), abs=1e-6)


def test_phase_surrogates_leave_nothing(spark, skewed):
    d = timeline.numbered(skewed, ["unit"], ["ts", "key"], F.col("ts"))
    r = resample.phase_null(d, "unit", "idx", "x", "y", 9, "ph").collect()[0]
    assert r["n_null"] == 9 and abs(r["null_mean"]) < 0.1 and r["obs"] > 0.3 and r["p"] == pytest.approx(0.1)


def test_normal_p(spark):
    from quorumstat.functions.core import norm_p_two_sided

    r = spark.createDataFrame([(0.0,), (1.959964,), (-1.959964,)], "z double").select(norm_p_two_sided("z").alias("p")).collect()
    assert [round(x["p"], 6) for x in r] == [1.0, 0.05, 0.05]


def test_spearman_against_pandas(skewed):
    got = {r["unit"]: r["rho"] for r in spearman(skewed, ["unit"], "value", "y").collect()}
    d = skewed.toPandas()
    for u, g in d.groupby("unit"):
        want = np.corrcoef(g["value"].rank(), g["y"].rank())[0, 1]
        assert got[u] == pytest.approx(want, abs=1e-8)
