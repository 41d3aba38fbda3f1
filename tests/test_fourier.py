"""Distributed transforms against numpy, for lengths with and without divisors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumstat.functions.core import u01
from quorumstat.operators import fourier


def frame(spark, series, tag=False):
    rows = [(k, len(x), t, float(np.real(v)), float(np.imag(v))) for k, x in series.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "unit string, n long, t long, re double, im double").repartition(4)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(8)
    return {f"n{n}": rng.normal(size=n) + 1j * rng.normal(size=n) for n in (1, 2, 3, 5, 8, 64, 97, 360, 1009, 2048)} | {"flat": np.full(50, 3.0), None: np.arange(40.0)}


def test_dft_equals_numpy(spark, series, monkeypatch):
    want = {(k, t): v for k, x in series.items() for t, v in enumerate(np.fft.fft(x))}
    for df in (fourier.dft(frame(spark, series), ["unit"]), fourier.whole(frame(spark, series), ["unit"])):
        got = {(r.unit, r.t): complex(r.re, r.im) for r in df.collect()}
        assert got.keys() == want.keys()
        assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_small_blocks(series):
    """The three steps by hand with blocks of a few numbers."""
    import pyarrow as pa

    for n in (5, 97, 360):
        x = series[f"n{n}"]
        size, m, q = fourier.shape(n)
        assert size >= 2 * n - 1 and m * q == size
        old, fourier.BLOCK = fourier.BLOCK, 4 * m
        try:
            t = np.arange(n)
            def by(parts, c):
                whole = pa.concat_tables(parts)
                return [whole.filter(pa.compute.equal(whole.column(c), v)) for v in whole.column(c).unique()]
            one = []
            for r in range(m):
                mine = t[t % m == r]
                at, z = np.append(mine, -1), np.append(x[mine], 0)
                one.append(fourier._first(pa.table({"unit": ["a"] * len(at), "n": [n] * len(at), "_r": [r] * len(at), "t": at, "re": z.real.copy(), "im": z.imag.copy()}), ["unit"]))
            two = [fourier._second(p, ["unit"]) for p in by(one, "_b")]
            out = pa.concat_tables([fourier._third(p, ["unit"]) for p in by(two, "_b")]).sort_by("t")
        finally:
            fourier.BLOCK = old
        assert np.abs(out.column("re").to_numpy() + 1j * out.column("im").to_numpy() - np.fft.fft(x)).max() < 1e-9


@pytest.mark.parametrize("n", [1, 2, 7, 90, 331])
def test_surrogates_keep_the_spectrum(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    d = frame(spark, {"a": x, "b": x[::-1]}).drop("im")
    made = [{(r.unit, r.rep, r.t): r.re for r in fourier.surrogates(d, ["unit"], 3, u01("s", "unit", "rep", "_k"), most).collect()} for most in (10**6, 0)]
    assert made[0].keys() == made[1].keys() and len(made[0]) == 6 * n
    assert max(abs(made[0][k] - made[1][k]) for k in made[0]) < 1e-9
    for unit, own in (("a", x), ("b", x[::-1])):
        for rep in range(3):
            y = np.array([made[1][unit, rep, t] for t in range(n)])
            assert np.allclose(np.abs(np.fft.fft(y)), np.abs(np.fft.fft(own)), atol=1e-9)
            assert n < 7 or np.abs(y - own).max() > 1e-3


def test_no_task_holds_a_long_series(spark):
    """200,003 points (a prime): largest group of every step, and numpy's values."""
    n = 200_003
    x = spark.range(n).select(F.lit("u").alias("unit"), F.lit(n).alias("n"), F.col("id").alias("t"), F.sin(F.col("id") * 0.37).alias("re"), F.lit(0.0).alias("im"))
    got = fourier.dft(x, ["unit"]).toPandas().sort_values("t")
    assert len(got) == n
    want = np.fft.fft(np.sin(np.arange(n) * 0.37))
    assert np.abs(got["re"].to_numpy() + 1j * got["im"].to_numpy() - want).max() < 1e-9 * np.abs(want).max()
    size, m, q = fourier.shape(10_000_000)
    assert max(q, m * max(1, fourier.BLOCK // m), q * max(1, fourier.BLOCK // q)) < 10_000_000 / 64
