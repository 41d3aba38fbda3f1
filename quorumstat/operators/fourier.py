"""Discrete Fourier transforms of series of any length, none of which has to fit into a task.

A series is rows (keys, t, re, im) with t from 0. ``dft`` writes the transform of length n as a
convolution with a chirp (t * k = (t^2 + k^2 - (k - t)^2) / 2), whose length M is a power of
two, and does that by the four-step scheme over M = m * q:

1. by residue t mod m: a transform of q points, times the twiddle factors;
2. by blocks of frequencies: a transform of m points for each, times the chirp's own
   transform (its residues are made in step 1, from their formula), and back over m points;
3. by blocks of residues: back over q points, times the chirp.

A task holds q, or m times a block, or q times a block of numbers: some 100,000 for ten million
points. Angles are reduced as integers before they become floats, so errors stay near 1e-12.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers that a block of step 2 or 3 holds, about.
BLOCK = 1 << 17


def shape(n: int) -> tuple[int, int, int]:
    """(M, m, q) of the convolution for a series of n points."""
    p = max(2, (2 * n - 2).bit_length())
    return 1 << p, 1 << p // 2, 1 << (p - p // 2)


def chirp(t: np.ndarray, n: int) -> np.ndarray:
    """exp(i pi t^2 / n); t^2 is taken modulo 2n in integers (t below 2^31)."""
    return np.exp(1j * np.pi * ((t.astype(np.int64) ** 2) % (2 * n)) / n)


def twiddle(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """exp(-2 pi i a b / size)."""
    return np.exp(-2j * np.pi * ((a.astype(np.int64) * b.astype(np.int64)) % size) / size)


def _keys(t: pa.Table, keys: list[str], rows: int) -> dict:
    return {k: pa.array([t.column(k)[0].as_py()] * rows, t.schema.field(k).type) for k in keys}


def _lists(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    flat = np.ascontiguousarray(x, dtype=float)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def _matrix(t: pa.Table, re: str, im: str, order: np.ndarray) -> np.ndarray:
    def part(c: str) -> np.ndarray:
        return t.column(c).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)[order]

    return part(re) + 1j * part(im)


def _first(t: pa.Table, keys: list[str]) -> pa.Table:
    """Step 1 for one residue of one series: spectra of the data and of the chirp, in blocks of frequencies."""
    n, r = t.column("n")[0].as_py(), t.column("_r")[0].as_py()
    size, m, q = shape(n)
    at = np.arange(q, dtype=np.int64) * m + r
    x = np.zeros(q, dtype=complex)
    pos = t.column("t").to_numpy()
    there = pos >= 0  # a row before the start stands for a residue without points
    pos = pos[there]
    x[pos // m] = (t.column("re").to_numpy()[there] + 1j * t.column("im").to_numpy()[there]) * np.conj(chirp(pos, n))
    back = np.minimum(at, size - at)
    c = np.where(back < n, chirp(np.minimum(back, n), n), 0)
    turn = twiddle(np.full(q, r), np.arange(q), size)
    width = min(q, max(1, BLOCK // m))
    a, b = (np.fft.fft(x) * turn).reshape(-1, width), (np.fft.fft(c) * turn).reshape(-1, width)
    k = len(a)
    return pa.table(_keys(t, keys, k) | {"n": pa.array([n] * k, pa.int64()), "_b": pa.array(np.arange(k), pa.int64()), "_r": pa.array([r] * k, pa.int64()),
                                         "ar": _lists(a.real), "ai": _lists(a.imag), "br": _lists(b.real), "bi": _lists(b.imag)})


def _second(t: pa.Table, keys: list[str]) -> pa.Table:
    """Step 2 for a block of frequencies: product of both transforms, and the first half of the way back."""
    n, block = t.column("n")[0].as_py(), t.column("_b")[0].as_py()
    size, m, q = shape(n)
    order = np.argsort(t.column("_r").to_numpy())
    a, b = _matrix(t, "ar", "ai", order), _matrix(t, "br", "bi", order)
    c = np.fft.ifft(np.fft.fft(a, axis=0) * np.fft.fft(b, axis=0), axis=0)  # residue of the result x frequency mod q
    freq = block * a.shape[1] + np.arange(a.shape[1])
    c = c * np.conj(twiddle(np.arange(m)[:, None], freq[None, :], size))
    width = min(m, max(1, BLOCK // q))
    rows = c.reshape(m // width, -1)
    k = len(rows)
    return pa.table(_keys(t, keys, k) | {"n": pa.array([n] * k, pa.int64()), "_b": pa.array(np.arange(k), pa.int64()), "_f": pa.array([block] * k, pa.int64()), "cr": _lists(rows.real), "ci": _lists(rows.imag)})


def _third(t: pa.Table, keys: list[str]) -> pa.Table:
    """Step 3 for a block of residues: the rest of the way back, and the chirp."""
    n, block = t.column("n")[0].as_py(), t.column("_b")[0].as_py()
    size, m, q = shape(n)
    order = np.argsort(t.column("_f").to_numpy())
    width = min(m, max(1, BLOCK // q))
    c = np.concatenate([x.reshape(width, -1) for x in _matrix(t, "cr", "ci", order)], axis=1)
    out = np.fft.ifft(c, axis=1)
    at = (np.arange(q)[None, :] * m + block * width + np.arange(width)[:, None]).ravel()
    keep = at < n
    at = at[keep]
    value = out.ravel()[keep] * np.conj(chirp(at, n))
    return pa.table(_keys(t, keys, len(at)) | {"n": pa.array([n] * len(at), pa.int64()), "t": pa.array(at), "re": value.real.copy(), "im": value.imag.copy()})


def dft(series: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, t, re, im): the transform, sum over s of x[s] exp(-2 pi i s t / n).

    ``series`` has keys, n (points of the series, all of them there), t, re and im.
    """
    kinds = {f.name: f.dataType.simpleString() for f in series.schema.fields}
    head = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n long"])
    bits = F.greatest(F.lit(2), F.length(F.bin(2 * F.col("n") - 2)))
    m = F.pow(F.lit(2.0), F.floor(bits / 2)).cast("long")
    x = series.select(*keys, F.col("n").cast("long").alias("n"), F.col("t").cast("long").alias("t"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    # Every residue has a task's row, also where the series is shorter than m.
    stubs = x.filter("t = 0").select(*keys, "n", F.explode(F.sequence(F.lit(0).cast("long"), m - 1)).alias("_r"), F.lit(-1).cast("long").alias("t"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    rows = x.withColumn("_r", F.col("t") % m).unionByName(stubs)
    lists = "array<double>"
    one = rows.groupBy(*keys, "n", "_r").applyInArrow(lambda t: _first(t, keys), f"{head}, _b long, _r long, ar {lists}, ai {lists}, br {lists}, bi {lists}")
    two = one.groupBy(*keys, "n", "_b").applyInArrow(lambda t: _second(t, keys), f"{head}, _b long, _f long, cr {lists}, ci {lists}")
    return two.groupBy(*keys, "n", "_b").applyInArrow(lambda t: _third(t, keys), f"{head}, t long, re double, im double")


def idft_real(spectrum: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, t, re): the real series of a spectrum; the transform of the conjugate, conjugated and divided by n."""
    return dft(spectrum.withColumn("im", -F.col("im")), keys).select(*keys, "n", "t", (F.col("re") / F.col("n")).alias("re"))


def random_phases(spectrum: DataFrame, phase: Column) -> DataFrame:
    """Each frequency keeps its size and gets the phase (in turns), its mirror image the opposite one.

    The mean and, for an even length, the highest frequency keep their value.
    """
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    angle = 2 * F.lit(np.pi) * phase * F.when(2 * F.col("t") < F.col("n"), 1.0).otherwise(-1.0)
    own = (F.col("t") == 0) | (2 * F.col("t") == F.col("n"))
    return spectrum.withColumns({"re": F.when(own, F.col("re")).otherwise(size * F.cos(angle)), "im": F.when(own, F.col("im")).otherwise(size * F.sin(angle))})


def whole(series: DataFrame, keys: list[str], backward: bool = False) -> DataFrame:
    """The same as ``dft`` (``backward``: ``idft_real``) for series that fit into a task."""
    kinds = {f.name: f.dataType.simpleString() for f in series.schema.fields}
    head = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n long", "t long", "re double"])

    def transform(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("t").to_numpy())
        z = t.column("re").to_numpy()[order] + 1j * t.column("im").to_numpy()[order]
        out = np.fft.ifft(z) if backward else np.fft.fft(z)
        n = len(z)
        cols = _keys(t, keys, n) | {"n": pa.array([n] * n, pa.int64()), "t": pa.array(np.arange(n)), "re": out.real.copy()}
        return pa.table(cols if backward else cols | {"im": out.imag.copy()})

    return series.select(*keys, "t", F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im")).groupBy(*keys).applyInArrow(transform, head if backward else f"{head}, im double")


def surrogates(series: DataFrame, keys: list[str], n: int, draw: Column, most: int, rep: str = "rep") -> DataFrame:
    """(keys, rep, n, t, re): n real series of the same spectrum with random phases.

    ``draw`` gives the phase from ``rep``, the keys and ``_k``, the frequency or its mirror
    image, whichever is lower. Series of more than ``most`` points are transformed in slices;
    the way of the transform doesn't touch the draws.
    """
    from ..functions.core import spread

    x = series.withColumn("im", F.lit(0.0))
    both = whole(x.filter(F.col("n") <= most), keys).unionByName(dft(x.filter(F.col("n") > most), keys))
    many = spread(both).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(rep), F.least("t", F.col("n") - F.col("t")).alias("_k"))
    turned = random_phases(many, draw).drop("_k")
    names = [*keys, rep]
    return whole(turned.filter(F.col("n") <= most), names, True).unionByName(idft_real(turned.filter(F.col("n") > most), names))
