"""Zero-phase recursive filters of series of any length.

A recursive filter is a linear state recurrence s' = A s + B x, y = C s + D x, run forward and
then backward over the result. A series is cut into blocks of consecutive samples. What a block
does to a state that enters it is an affine map: A^L for the state and one vector for its
samples, in both directions. One pass over the blocks yields these vectors; composing the maps
along a series yields the state that enters each block from either side; a second pass over the
same blocks writes the values. Samples are shuffled once, and the join by block brings a few
numbers to each.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import nan_to_null
from .ordered import meet

#: Samples of a block, and of the pieces that one matrix product covers.
BLOCK, PIECE = 1 << 16, 64


def butter(order: int, cut: float, rate: float, kind: str = "low") -> tuple[list[float], list[float]]:
    """Coefficients (b, a) of a low- or high-pass filter with a maximally flat pass band.

    Poles on the half circle, warped so that ``cut`` is where it should be, mapped by
    z = (2 + p) / (2 - p); the gain is one at rest (low) or at half the rate (high).
    """
    if not (0 < cut < rate / 2 and order >= 1 and kind in ("low", "high")):
        raise ValueError("needs order >= 1, 0 < cut < rate / 2 and kind low or high")
    unit = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    warped = 2.0 * np.tan(np.pi * cut / rate)
    p = warped * unit if kind == "low" else warped / unit
    a = np.poly((2 + p) / (2 - p)).real
    zero = -1.0 if kind == "low" else 1.0
    b = np.poly(np.full(order, zero))
    return (b * np.polyval(a, -zero) / np.polyval(b, -zero)).tolist(), a.tolist()


class Recurrence:
    """The state form of (b, a), with its powers at hand."""

    def __init__(self, b, a):
        n = max(len(a), len(b))
        b, a = (np.pad(np.asarray(v, float), (0, n - len(v))) / a[0] for v in (b, a))
        d = self.dim = n - 1
        self.A = np.eye(d, k=1)
        self.A[:, 0] -= a[1:]
        self.B, self.D = b[1:] - a[1:] * b[0], b[0]
        self.rest = np.linalg.solve(np.eye(d) - self.A, self.B)  # state of a constant input of one
        self.pad = 3 * n
        p = [np.eye(d)]
        for _ in range(PIECE):
            p.append(self.A @ p[-1])
        self.step = p[PIECE]
        self.seen = np.array([m[0] for m in p[:PIECE]])  # output of a state, by distance
        self.push = np.array([m @ self.B for m in p[:PIECE]])[::-1]  # state left by a sample of a piece
        h = np.concatenate([[self.D], self.push[::-1][:-1, 0]])
        lag = np.arange(PIECE)[:, None] - np.arange(PIECE)[None, :]
        self.kernel = np.where(lag >= 0, h[np.maximum(lag, 0)], 0.0).T

    def power(self, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.A, n)

    def run(self, x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, state behind the last sample) from the state ``s``."""
        whole = len(x) // PIECE
        m = x[: whole * PIECE].reshape(whole, PIECE)
        left, states = m @ self.push, np.empty((whole, self.dim))
        for i in range(whole):
            states[i] = s
            s = self.step @ s + left[i]
        y = np.empty(len(x))
        y[: whole * PIECE] = (m @ self.kernel + states @ self.seen.T).ravel()
        for i in range(whole * PIECE, len(x)):
            y[i] = s[0] + self.D * x[i]
            s = self.A @ s + self.B * x[i]
        return y, s

    def echo(self, n: int) -> np.ndarray:
        """Backward state behind n values that a forward state alone gave: the sum of
        A^k B C A^k over k < n, by doubling."""
        if n == 1:
            return np.outer(self.B, np.eye(self.dim)[0])
        half = self.echo(n // 2)
        p = self.power(n // 2)
        h = half + p @ half @ p
        if n % 2:
            p = self.power(n - 1)
            h = h + p @ np.outer(self.B, np.eye(self.dim)[0]) @ p
        return h


@lru_cache(maxsize=16)
def _recurrence(b: tuple, a: tuple) -> Recurrence:
    return Recurrence(b, a)


def _enter(g: pd.DataFrame, r: Recurrence) -> tuple[list, list]:
    """States that enter the blocks of one series, from the left and from the right.

    Ends are extended by ``pad`` samples mirrored through the end point, and both runs start
    at rest at the outermost value.
    """
    n, k = int(g["_n"].sum()), len(g)
    if n <= r.pad:
        return [[np.nan] * r.dim] * k, [[np.nan] * r.dim] * k
    head, tail = np.asarray(g["_head"].iloc[0]), np.concatenate(g["_tail"].iloc[-r.pad - 1:].tolist())[-r.pad - 1:]
    before, behind = 2 * head[0] - head[:0:-1], 2 * tail[-1] - tail[-2::-1]
    _, s = r.run(before, r.rest * before[0])
    powers = {m: (r.power(m), r.echo(m)) for m in set(g["_n"].astype(int))}
    sizes, fwd, bwd = g["_n"].astype(int).tolist(), g["_fwd"].tolist(), g["_bwd"].tolist()
    left = []
    for m, e in zip(sizes, fwd):
        left.append(s)
        s = powers[m][0] @ s + e
    y, _ = r.run(behind, s)
    _, s = r.run(y[::-1], r.rest * y[-1])
    right = [None] * k
    for i in range(k - 1, -1, -1):
        right[i] = s
        power, echo = powers[sizes[i]]
        s = power @ s + bwd[i] + echo @ left[i]
    return [v.tolist() for v in left], [v.tolist() for v in right]


def zero_phase(df: DataFrame, by: list[str], idx: str, x: str, b: list[float], a: list[float],
               out: str = "filtered", keep: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """The filter (b, a) forward and backward along ``idx`` (0, 1, ... in each series).

    Returns by, idx, ``keep`` and ``out``. A series with a null, NaN or infinite value, or with
    no more samples than the extension of 3 * max(len(a), len(b)), gets NULL throughout. A NULL
    series key is a series of its own. Every task holds blocks of ``block`` samples, and one of
    them the few numbers per block of a series.
    """
    spec = tuple(map(float, b)), tuple(map(float, a))
    pad = 3 * max(len(b), len(a))
    if block <= pad:
        raise ValueError(f"blocks need more than {pad} samples")
    # places come from idx, so rows of a block need no other number
    rows = df.select(*by, F.floor(F.col(idx) / F.lit(block)).alias("_blk"),
                     F.struct(F.col(idx).alias("i"), F.col(x).cast("double").alias("x"), *[F.col(c).alias(f"k{n}") for n, c in enumerate(keep)]).alias("_r"))
    blocks = rows.groupBy(*by, "_blk").agg(F.array_sort(F.collect_list("_r")).alias("_s"))
    blocks = blocks.withColumn("_x", F.transform("_s", lambda r: F.coalesce(r["x"], F.lit(float("nan")))))
    shape = T.StructType([T.StructField("_fwd", T.ArrayType(T.DoubleType())), T.StructField("_bwd", T.ArrayType(T.DoubleType()))])

    @F.pandas_udf(shape)
    def ends(xs: pd.Series) -> pd.DataFrame:
        r = _recurrence(*spec)
        got = []
        for v in xs:
            y, f = r.run(np.asarray(v, float), np.zeros(r.dim))
            got.append((f.tolist(), r.run(y[::-1], np.zeros(r.dim))[1].tolist()))
        return pd.DataFrame(got, columns=["_fwd", "_bwd"])

    @F.pandas_udf("array<double>")
    def values(xs: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
        r = _recurrence(*spec)
        return pd.Series([r.run(r.run(np.asarray(v, float), np.asarray(p, float))[0][::-1], np.asarray(q, float))[0][::-1]
                          for v, p, q in zip(xs, left, right)])

    few = blocks.select(*by, "_blk", F.size("_x").alias("_n"), F.slice("_x", 1, pad + 1).alias("_head"),
                        F.slice("_x", F.greatest(F.size("_x") - pad, F.lit(1)), F.lit(pad + 1)).alias("_tail"), ends("_x").alias("_e"))
    few = few.select(*by, "_blk", "_n", "_head", "_tail", "_e.*")
    keys = [f for f in few.select(*by, "_blk").schema.fields]
    entry = T.StructType([*keys, T.StructField("_l", T.ArrayType(T.DoubleType())), T.StructField("_t", T.ArrayType(T.DoubleType()))])

    def enter(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_blk").reset_index(drop=True)
        left, right = _enter(g, _recurrence(*spec))
        return g[[*by, "_blk"]].assign(_l=left, _t=right)

    j = meet(blocks, few.groupBy(*by).applyInPandas(enter, entry), [*by, "_blk"], "inner")
    j = j.select(*by, F.arrays_zip(F.col("_s"), values("_x", "_l", "_t").alias("_y")).alias("_z"))
    j = j.select(*by, F.explode("_z").alias("_z"))
    return j.select(*by, F.col("_z._s.i").alias(idx), *[F.col(f"_z._s.k{n}").alias(c) for n, c in enumerate(keep)],
                    nan_to_null(F.col("_z._y")).alias(out))


def slow_fast(df: DataFrame, by: list[str], idx: str, x: str, cut: float, rate: float, order: int = 2,
              keep: tuple[str, ...] = ()) -> DataFrame:
    """``phasic`` is the zero-phase high pass at ``cut``, ``tonic`` the rest."""
    b, a = butter(order, cut, rate, "high")
    d = zero_phase(df, by, idx, x, b, a, "phasic", (*keep, x))
    return d.withColumn("tonic", F.col(x) - F.col("phasic"))
