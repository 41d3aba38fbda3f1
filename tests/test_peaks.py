"""Peaks against a plain loop: plateaus, ties, borders of blocks, staircases."""

import numpy as np
import pytest

from quorumstat.operators import peaks


def brute(x, height, distance):
    tops, i = [], 0
    while i < len(x):
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        ends = (x[i - 1] if i else None, x[j + 1] if j + 1 < len(x) else None)
        if x[i] is not None and all(e is not None and e < x[i] for e in ends):
            tops.append((i + j) // 2)
        i = j + 1
    tops = [t for t in tops if height is None or x[t] >= height]
    left = []
    for t in sorted(tops, key=lambda t: (x[t], t), reverse=True):
        if all(abs(t - k) >= distance for k in left):
            left.append(t)
    return sorted(left)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(5)
    made = {"noise": rng.normal(size=900).tolist(), "steps": rng.integers(0, 4, 900).astype(float).tolist(),
            "stairs": [float(i if i % 2 else -i) for i in range(400)], "down": [float(-i if i % 2 else -900 - i) for i in range(400)],
            "flat": [1.0] * 50, "one": [1.0], "hill": [0.0, 1.0, 0.0], "tie": [0.0, 2.0, 0.0, 2.0, 0.0, 2.0, 0.0], None: rng.normal(size=120).tolist()}
    holes = rng.integers(0, 3, 200).astype(float).tolist()
    holes[0] = holes[50] = holes[51] = None
    return made | {"holes": holes}


def frame(spark, series):
    return spark.createDataFrame([(k, i, v) for k, x in series.items() for i, v in enumerate(x)], "unit string, idx long, x double").repartition(5)


@pytest.mark.parametrize("rows,height,distance,block", [("60", 0.5, 2, peaks.BLOCK), ("1000000", None, 1, 64), ("1000000", None, 5, 100), ("1000000", None, 5, 16), ("60", None, 5, 16), ("1000000", None, 5, peaks.BLOCK)])
def test_equals_the_loop(spark, series, rows, height, distance, block):
    spark.conf.set("quorumstat.chunkRows", rows)
    try:
        got = sorted(((r.unit or "", r.idx, r.x) for r in peaks.find_peaks(frame(spark, series), ["unit"], "idx", "x", height, distance, block).collect()))
    finally:
        spark.conf.unset("quorumstat.chunkRows")
    assert got == sorted((k or "", i, x[i]) for k, x in series.items() for i in brute(x, height, distance))


def test_open_peaks_wait():
    """A staircase longer than the block: nothing is settled wrongly, the top is settled first."""
    i, v = np.arange(0, 100, 2), np.arange(50.0)
    part = peaks.settle(i, v, np.zeros(50, bool), 5, 0, 101)
    assert set(part.tolist()) <= {peaks.KEPT, peaks.OUT, peaks.UNSURE}
    assert part[-1] == peaks.UNSURE and (part[:-3] == peaks.UNSURE).all()
    assert (peaks.settle(i, v, np.zeros(50, bool), 5, -10, 200) != peaks.UNSURE).all()


def test_missing_and_empty(spark):
    d = spark.createDataFrame([], "unit string, idx long, x double")
    assert peaks.find_peaks(d, ["unit"], "idx", "x", 0.0, 3).collect() == []
    x = [0.0, float("nan"), 3.0, 1.0, float("inf"), 1.0, 2.0, 1.0]
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "unit string, idx long, x double")
    assert [(r.idx, r.x) for r in peaks.find_peaks(d, ["unit"], "idx", "x").collect()] == [(6, 2.0)]
