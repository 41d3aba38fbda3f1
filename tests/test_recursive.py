"""Zero-phase filters against a sample-by-sample loop, whole and in blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumstat.operators import recursive as rc


def loop(x, b, a, s):
    """Difference equation, one sample after the other."""
    y, s = [], list(s)
    for v in x:
        out = b[0] * v + s[0]
        s = [b[i + 1] * v - a[i + 1] * out + (s[i + 1] if i + 1 < len(s) else 0.0) for i in range(len(s))]
        y.append(out)
    return y


def both_ways(x, b, a):
    pad = 3 * len(a)
    rest, s = [], 0.0
    for k in range(len(a) - 1, 0, -1):  # state of a constant one: tails of b - a * gain
        s = s + b[k] - a[k] * (sum(b) / sum(a))
        rest.insert(0, s)
    e = [2 * x[0] - v for v in x[pad:0:-1]] + list(x) + [2 * x[-1] - v for v in x[-2:-pad - 2:-1]]
    y = loop(e, b, a, [r * e[0] for r in rest])[::-1]
    return loop(y, b, a, [r * y[0] for r in rest])[::-1][pad:-pad]


def test_gain_of_the_design():
    for order in (1, 2, 3, 4):
        for kind in ("low", "high"):
            b, a = rc.butter(order, 3.0, 50.0, kind)
            gain = lambda hz: abs(np.polyval(b, np.exp(2j * math.pi * hz / 50)) / np.polyval(a, np.exp(2j * math.pi * hz / 50)))
            w = lambda hz: math.tan(math.pi * hz / 50) / math.tan(math.pi * 3 / 50)
            for hz in (0.5, 3.0, 11.0):
                ratio = w(hz) if kind == "low" else 1 / w(hz)
                assert abs(gain(hz) - 1 / math.sqrt(1 + ratio ** (2 * order))) < 1e-9
    with pytest.raises(ValueError):
        rc.butter(2, 30.0, 50.0)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    made = {f"n{n}": rng.normal(size=n).cumsum() for n in (1, 9, 10, 11, 40, 64, 65, 128, 200, 1000)}
    return made | {None: np.sin(np.arange(150) / 7), "flat": np.full(80, 2.5)}


def frame(spark, series):
    rows = [(k, i, float(v), f"{k}-{i}") for k, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "unit string, idx long, x double, tag string").repartition(5)


@pytest.mark.parametrize("block", [13, 64, 100, rc.BLOCK])
@pytest.mark.parametrize("kind,order", [("low", 2), ("high", 2), ("low", 1)])
def test_equals_the_loop(spark, series, block, kind, order):
    b, a = rc.butter(order, 1.0, 20.0, kind)
    got = {(r.unit, r.idx): r for r in rc.zero_phase(frame(spark, series), ["unit"], "idx", "x", b, a, "y", ("tag",), block).collect()}
    assert len(got) == sum(map(len, series.values()))
    for k, x in series.items():
        want = both_ways(list(x), b, a) if len(x) > 3 * len(a) else [None] * len(x)
        for i, v in enumerate(want):
            r = got[k, i]
            assert r.tag == f"{k}-{i}"
            assert (r.y is None) if v is None else abs(r.y - v) < 1e-9


def test_gaps_in_values_blank_the_series(spark):
    rows = [(k, i, None if (k, i) == ("a", 70) else float("inf") if (k, i) == ("c", 3) else float(i % 7)) for k in "abc" for i in range(120)]
    d = spark.createDataFrame(rows, "unit string, idx long, x double")
    b, a = rc.butter(2, 1.0, 20.0)
    got = rc.zero_phase(d, ["unit"], "idx", "x", b, a, "y", block=32)
    n = {r.unit: (r.n, r.v) for r in got.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("v")).collect()}
    assert n == {"a": (120, 0), "b": (120, 120), "c": (120, 0)}


def test_empty_and_refused(spark):
    b, a = rc.butter(2, 1.0, 20.0)
    d = spark.createDataFrame([], "unit string, idx long, x double")
    assert rc.zero_phase(d, ["unit"], "idx", "x", b, a).collect() == []
    with pytest.raises(ValueError):
        rc.zero_phase(d, ["unit"], "idx", "x", b, a, block=9)


def test_a_long_series_in_blocks(spark):
    """300,001 samples: default blocks against one block."""
    d = spark.range(300_001).select(F.lit("u").alias("unit"), F.col("id").alias("idx"), (F.sin(F.col("id") * 0.01) + F.cos(F.col("id") * 1.3)).alias("x"))
    b, a = rc.butter(2, 0.05, 50.0, "high")
    got = rc.zero_phase(d, ["unit"], "idx", "x", b, a, "y").toPandas().sort_values("idx")["y"].to_numpy()
    i = np.arange(300_001)
    want = np.array(both_ways((np.sin(i * 0.01) + np.cos(i * 1.3)).tolist(), b, a))
    assert np.abs(got - want).max() < 1e-7


def test_slow_and_fast_add_up(spark, series):
    d = rc.slow_fast(frame(spark, series), ["unit"], "idx", "x", 1.0, 20.0)
    assert d.filter(F.abs(F.col("tonic") + F.col("phasic") - F.col("x")) > 1e-9).isEmpty()
    assert d.filter("unit = 'flat' and abs(phasic) > 1e-9").isEmpty()
