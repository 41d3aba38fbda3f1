"""Prominence of peaks against a walk to either side."""

import numpy as np
import pytest
from test_peaks import brute, frame

from quorumstat.operators import prominence as pm


def walk(x, top):
    bases = []
    for side in (x[:top][::-1], x[top + 1:]):
        low = x[top]
        for v in side:
            if v is None:
                continue
            if v > x[top]:
                break
            low = min(low, v)
        bases.append(low)
    return x[top] - max(bases)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(11)
    up = [float(i if i % 2 else -i) for i in range(400)]
    made = {"noise": rng.normal(size=900).tolist(), "walk": np.cumsum(rng.normal(size=800)).round(1).tolist(),
            "steps": rng.integers(0, 4, 700).astype(float).tolist(), "stairs": up, "spike": [0.0, 1e6, 0.0, *up], "down": [*up[::-1], 0.0, 1e6, 0.0],
            "level": [0.0, 2.0] * 150 + [0.0], "flat": [1.0] * 50, "one": [1.0], "hill": [0.0, 1.0, 0.0], None: rng.normal(size=300).tolist()}
    holes = rng.integers(0, 5, 300).astype(float).tolist()
    for i in [0, 50, 51, *range(120, 200)]:
        holes[i] = None
    return made | {"holes": holes}


@pytest.mark.parametrize("rows,least,height,distance,block", [
    ("60", 0.0, None, 1, 16), ("1000000", 0.0, None, 1, 16), ("1000000", 1.5, 0.5, 3, 64), ("1000000", 1.0, None, 1, pm.BLOCK)])
def test_equals_the_walk(spark, series, rows, least, height, distance, block):
    spark.conf.set("quorumstat.chunkRows", rows)
    try:
        d = pm.prominent_peaks(frame(spark, series), ["unit"], "idx", "x", least, height, distance, block)
        got = sorted((r.unit or "", r.idx, r.x, r.prominence) for r in d.collect())
    finally:
        spark.conf.unset("quorumstat.chunkRows")
    want = [(k or "", i, x[i], walk(x, i)) for k, x in series.items() for i in brute(x, height, distance)]
    assert got == sorted(w for w in want if w[3] >= least)
    assert len(got) > 100


def test_look_left_at_random():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 64, 100):
        v = rng.integers(0, 9, n).astype(float)
        pos, h = rng.integers(0, n + 1, 50), rng.integers(0, 9, 50).astype(float)
        m, none = pm.look_left(v, pos, h)
        for p, t, a, o in zip(pos, h, m, none):
            higher = np.flatnonzero(v[:p] > t)
            start = higher[-1] + 1 if len(higher) else 0
            assert a == min([t, *v[start:p]]) and o == (start == 0)


def test_empty(spark):
    d = spark.createDataFrame([], "unit string, idx long, x double")
    assert pm.prominent_peaks(d, ["unit"], "idx", "x", 0.0).collect() == []


def test_integer_keys_and_no_keys(spark):
    x = [0.0, 3.0, 1.0, 5.0, 2.0, 4.0, 0.0]
    d = spark.createDataFrame([(k, i, v) for k in (1, None) for i, v in enumerate(x)], "unit int, idx long, x double")
    got = sorted((r.unit or 0, r.idx, r.prominence) for r in pm.prominent_peaks(d, ["unit"], "idx", "x", 0.0, block=2).collect())
    assert got == [(k, i, p) for k in (0, 1) for i, p in ((1, 2.0), (3, 5.0), (5, 2.0))]
