"""Window functions on regular and time-stamped series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import corr, div, with_row
from .ordered import avg_ranks, fits, quantiles, row_numbers, scan
from .stats import spearman


def within_z(df: DataFrame, unit: list[str], cols: list[str], eps: float = 0.0) -> DataFrame:
    """Z inside each unit with the sample SD. ``eps=0``: zero SD gives NULL;
    otherwise SD + eps divides. Aggregate and join back, so a huge unit never sits in
    one task."""
    s = df.groupBy(*unit).agg(*[e for c in cols for e in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    den = lambda c: F.nullif(F.col(f"_s_{c}"), F.lit(0.0)) if eps == 0 else F.col(f"_s_{c}") + eps
    j = df.join(s, unit)
    return j.withColumns({f"{c}_z": (F.col(c) - F.col(f"_m_{c}")) / den(c) for c in cols}).drop(
        *[f"_{k}_{c}" for c in cols for k in "ms"])


def global_z(df: DataFrame, cols: list[str], eps: float = 1e-9) -> DataFrame:
    """Z over the whole table (one-row broadcast)."""
    s = df.agg(*[e for c in cols for e in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    j = with_row(df, s)
    return j.withColumns({f"{c}_z": (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + eps) for c in cols}).drop(
        *[f"_{k}_{c}" for c in cols for k in "ms"])


def pct_rank(df: DataFrame, by: list[str], c: str, out: str = "pct") -> DataFrame:
    """Average rank over the group's count (not ``percent_rank``)."""
    r = avg_ranks(df, by, {"avg_rank": c})
    n = df.filter(F.col(c).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return r.join(n, by).withColumn(out, F.col("avg_rank") / F.col("_n")).drop("_n")


def diff(df: DataFrame, by: list[str], order: list[str], pos, x: str, out: str = "diff") -> DataFrame:
    """First difference along the order."""
    return scan(df, by, order, pos, {"_p": ("lag", x)}).withColumn(out, F.col(x) - F.col("_p")).drop("_p")


def numbered(df: DataFrame, by: list[str], order: list[str], pos, out: str = "idx") -> DataFrame:
    """Regular 0-based index along the order."""
    return row_numbers(df, by, order, pos, out).withColumn(out, F.col(out) - 1)


def lag_scan(df: DataFrame, by: list[str], idx: str, x: str, y: str, lags: list[int], min_rows: int = 20) -> DataFrame:
    """Spearman of the differences of x[i] and y[i + lag], per series and lag.

    Lags are equi joins on (series, index), so no series has to fit one task.
    """
    s = df.select(*by, idx, x, y)
    nxt = s.select(*by, (F.col(idx) - 1).alias(idx), F.col(x).alias("_x1"), F.col(y).alias("_y1"))
    d = s.join(nxt, [*by, idx]).select(*by, idx, (F.col("_x1") - F.col(x)).alias("dx"), (F.col("_y1") - F.col(y)).alias("dy"))
    ys = d.select(*by, F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"), F.col(idx).alias("_i"), "dy")
    ys = ys.select(*by, "lag", (F.col("_i") - F.col("lag")).alias(idx), "dy")
    j = d.select(*by, idx, "dx").join(ys, [*by, idx])
    return spearman(j, [*by, "lag"], "dx", "dy", small=fits(df, by)).filter(F.col("n") >= min_rows - 1)


def best_lag(scan_table: DataFrame) -> DataFrame:
    """Lag with the largest mean absolute rho (the shortest on ties)."""
    m = scan_table.groupBy("lag").agg(F.avg(F.abs("rho")).alias("mean_abs_rho"), F.count("rho").alias("n_series"))
    top = m.agg(F.max_by("lag", F.struct(F.round("mean_abs_rho", 9), -F.col("lag"))).alias("best_lag"))
    return with_row(m, top)


def ac1(df: DataFrame, by: list[str], order: list[str], pos, x: str, min_rows: int = 5) -> DataFrame:
    """Lag-1 autocorrelation, NULL below ``min_rows``."""
    d = scan(df, by, order, pos, {"_p": ("lag", x)})
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.count(F.lit(1)) >= min_rows, corr(F.when(F.col("_p").isNotNull(), F.col(x)), "_p")).alias("ac1"))


def gaps(df: DataFrame, by: list[str], ts: str, order: list[str], max_gap: float) -> DataFrame:
    """(start, end) of consecutive samples further apart than ``max_gap``."""
    d = scan(df, by, order, F.col(ts), {"_p": ("lag", ts)})
    return d.filter(F.col(ts) - F.col("_p") > max_gap).select(*by, F.col("_p").alias("gap_start"), F.col(ts).alias("gap_end"))


def local_stats(df: DataFrame, by: list[str], key: str, t: str, x: str, half: float) -> DataFrame:
    """Statistics of x within ``half`` (both ends closed) of every row's time.

    A range frame inside (by, time bucket). Buckets are eight half-widths long and carry a
    margin from their neighbours, so a long series is spread over its buckets and no pairs
    of rows are written.
    """
    wide = F.lit(8.0 * half)
    at = lambda s: F.floor((F.col(t) + F.lit(s)) / wide)
    d = df.select(*by, key, t, x, at(0.0).alias("_home"),
                  F.explode(F.array_distinct(F.array(at(-half), at(0.0), at(half)))).alias("_b"))
    part = ", ".join(f"`{c}`" for c in [*by, "_b"])
    h = f"CAST({half!r} AS DOUBLE)"  # a fractional range frame exists in SQL text only
    over = f"OVER (PARTITION BY {part} ORDER BY `{t}` RANGE BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    aggs = {"n": "count(1)", "mean": f"avg(`{x}`)", "std": f"stddev_pop(`{x}`)", "min": f"min(`{x}`)", "max": f"max(`{x}`)"}
    d = d.select(*by, key, "_home", "_b", *[F.expr(f"{e} {over}").alias(n) for n, e in aggs.items()])
    return d.filter(F.col("_b") == F.col("_home")).drop("_b", "_home")


def detrend(df: DataFrame, by: list[str], t: str, x: str, out: str = "detrended") -> DataFrame:
    """Minus the OLS line over t (aggregate and join back)."""
    f = df.groupBy(*by).agg(F.regr_slope(x, t).alias("_b"), F.regr_intercept(x, t).alias("_a"))
    return df.join(f, by).withColumn(out, F.col(x) - F.col("_a") - F.col("_b") * F.col(t)).drop("_a", "_b")


def tonic_phasic(df: DataFrame, by: list[str], key: str, ts: str, x: str, seconds: float) -> DataFrame:
    """W10 (re-aimed): slow part = centred moving mean, fast part = the rest.

    Not numerically equal to a high-pass filter.
    """
    m = local_stats(df, by, key, ts, x, seconds / 2.0).select(*by, key, F.col("mean").alias("tonic"))
    return df.join(m, [*by, key]).withColumn("phasic", F.col(x) - F.col("tonic"))


def peak_rate(df: DataFrame, by: list[str], key: str, ts: str, x: str, floor: float, gap: float) -> DataFrame:
    """W11 (re-aimed): local maxima within +-gap above a floor, per hour of span."""
    m = local_stats(df, by, key, ts, x, gap).select(*by, key, F.col("max").alias("_mx"))
    j = df.join(m, [*by, key])
    s = j.groupBy(*by).agg(
        F.count_if((F.col(x) >= floor) & (F.col(x) == F.col("_mx"))).alias("n_peaks"),
        (F.max(ts) - F.min(ts)).alias("_span"))
    return s.select(*by, "n_peaks", div(F.col("n_peaks") * 3600.0, "_span").alias("rate"))


def event_rate(df: DataFrame, by: list[str], ts: str, order: list[str], lo: float, hi: float, min_share: float,
               min_n: int = 2) -> DataFrame:
    """60 / mean interval over plausible intervals, if enough of them are plausible."""
    d = scan(df, by, order, F.col(ts), {"_p": ("lag", ts)}).withColumn("_rr", F.col(ts) - F.col("_p"))
    d = d.filter(F.col("_rr").isNotNull())
    ok = (F.col("_rr") > lo) & (F.col("_rr") < hi)
    s = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok"), F.avg(F.when(ok, F.col("_rr"))).alias("_m"))
    good = (F.col("n_ok") >= min_n) & (F.col("n_ok") / F.nullif(F.col("n"), F.lit(0)) >= min_share)
    return s.select(*by, "n", "n_ok", F.when(good, div(F.lit(60.0), "_m")).alias("rate"))


def _interp(t, t0, x0, t1, x1):
    """Linear between two neighbours, clamped where one side is missing."""
    return F.when(x0.isNull(), x1).when(x1.isNull(), x0).otherwise(
        x0 + F.coalesce((x1 - x0) * div(t - t0, t1 - t0), F.lit(0.0)))


def resample_linear(df: DataFrame, by: list[str], ts: str, x: str, step: float) -> DataFrame:
    """Linear interpolation onto the grid of multiples of ``step`` inside the span.

    The grid is a generator; neighbours come from a merged time line scanned both ways.
    """
    span = df.groupBy(*by).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    grid = span.select(*by, F.explode(F.sequence(F.floor(F.col("_lo") / step), F.floor(F.col("_hi") / step))).alias("_g"))
    grid = grid.select(*by, (F.col("_g") * F.lit(float(step))).alias("_t"), F.lit(1).alias("_s"), F.lit(True).alias("_grid"))
    pts = df.groupBy(*by, F.col(ts).alias("_t")).agg(F.avg(x).alias("_x")).select(
        *by, "_t", F.lit(0).alias("_s"), F.lit(False).alias("_grid"), F.struct("_t", "_x").alias("_p"))
    m = grid.unionByName(pts, allowMissingColumns=True)
    m = scan(m, by, ["_t", "_s"], F.col("_t"), {"_b": ("last", "_p")})
    m = scan(m, by, ["_t", "_s"], F.col("_t"), {"_a": ("last", "_p")}, reverse=True).filter(F.col("_grid"))
    v = _interp(F.col("_t"), F.col("_b._t"), F.col("_b._x"), F.col("_a._t"), F.col("_a._x"))
    return m.select(*by, F.col("_t").alias(ts), v.alias(x))


def interpolate_bad(df: DataFrame, by: list[str], idx: str, x: str, lo: float, hi: float, max_bad: float = 0.5) -> DataFrame:
    """Samples outside (lo, hi] are interpolated over the index; series with too
    large a bad share are dropped."""
    bad = (F.col(x) <= lo) | (F.col(x) > hi)
    ok = df.groupBy(*by).agg(F.avg(bad.cast("int")).alias("_share")).filter(F.col("_share") <= max_bad).select(*by)
    d = df.join(ok, by, "left_semi").withColumn("is_bad", bad)
    d = d.withColumn("_p", F.when(~bad, F.struct(F.col(idx).cast("double").alias("t"), F.col(x).alias("x"))))
    d = scan(d, by, [idx], F.col(idx), {"_b": ("last", "_p")})
    d = scan(d, by, [idx], F.col(idx), {"_a": ("last", "_p")}, reverse=True)
    v = _interp(F.col(idx).cast("double"), F.col("_b.t"), F.col("_b.x"), F.col("_a.t"), F.col("_a.x"))
    return d.withColumn("filled", F.when(F.col("is_bad"), v).otherwise(F.col(x))).drop("_p", "_a", "_b")


def response_kernel(dt: float, dur: float, tau1: float, tau2: float) -> list[float]:
    """Two-exponential response, negative part cut, unit area."""
    h = [max(math.exp(-i * dt / tau2) - math.exp(-i * dt / tau1), 0.0) for i in range(math.ceil(dur / dt))]
    s = sum(h) + 1e-12
    return [v / s for v in h]


def convolve(df: DataFrame, by: list[str], idx: str, x: str, kernel: list[float], out: str = "conv") -> DataFrame:
    """Causal convolution along the index, cut to the series.

    Every sample is sent to the positions it reaches (kernel length is fixed) and summed
    there, so partial sums combine before the shuffle.
    """
    hs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(h)).alias("h")) for i, h in enumerate(kernel)])
    d = df.select(*by, F.col(idx), F.col(x), F.explode(hs).alias("_h"))
    s = d.groupBy(*by, (F.col(idx) + F.col("_h.i")).alias(idx)).agg(F.sum(F.col(x) * F.col("_h.h")).alias(out))
    return df.join(s, [*by, idx])


def block_mean(df: DataFrame, by: list[str], idx: str, x: str, step: int) -> DataFrame:
    """Means of ``step`` consecutive samples, an incomplete tail dropped."""
    s = df.groupBy(*by, F.floor(F.col(idx) / step).alias("block")).agg(F.avg(x).alias(x), F.count(F.lit(1)).alias("_n"))
    return s.filter(F.col("_n") == step).drop("_n")


def habituation(df: DataFrame, by: list[str], order: list[str], pos, x: str) -> DataFrame:
    """Spearman of the measure with the trial number."""
    small = fits(df, by)
    d = row_numbers(df, by, order, pos, "trial", small=small)
    return spearman(d, by, "trial", x, small=small)


def deviation(df: DataFrame, item: list[str], value: str, out: str = "deviation") -> DataFrame:
    """Value minus the item's mean."""
    m = df.groupBy(*item).agg(F.avg(value).alias("_m"))
    return df.join(m, item).withColumn(out, F.col(value) - F.col("_m")).drop("_m")


def median_split(df: DataFrame, unit: list[str], q: str) -> DataFrame:
    """Above the global median (``hi_global``) and above the unit's (``hi_within``)."""
    d = with_row(df, quantiles(df, [], q, {"_g": 0.5})).join(quantiles(df, unit, q, {"_u": 0.5}), unit)
    return d.withColumns({"hi_global": F.col(q) > F.col("_g"), "hi_within": F.col(q) > F.col("_u")}).drop("_g", "_u")


def _solver(size: int, rhs: int):
    """Vectorised solve of one small linear system per row (numpy, batched).

    Input: the matrix and the right-hand sides as one flat array; singular systems give
    NULLs.
    """
    @F.pandas_udf("array<double>")
    def solve(flat: pd.Series) -> pd.Series:
        a = np.array(flat.tolist(), dtype=float).reshape(len(flat), size + rhs, size)
        m, r = a[:, :size, :], np.swapaxes(a[:, size:, :], 1, 2)
        ok = np.abs(np.linalg.det(m)) > 1e-9
        out = np.full((len(flat), size, rhs), np.nan)
        if ok.any():
            out[ok] = np.linalg.solve(m[ok], r[ok])
        out = np.swapaxes(out, 1, 2).reshape(len(flat), -1)
        return pd.Series([None if not k else list(v) for k, v in zip(ok, out)])

    return solve


def control_order(df: DataFrame, by: list[str], order: str, x: str, y: str, degree: int = 1) -> DataFrame:
    """Order polynomial projected out of x and y inside each unit.

    Degree 1 uses the regression aggregates; higher degrees solve the normal equations
    per unit from moment sums of the centred, scaled order.
    """
    if degree == 1:
        f = df.groupBy(*by).agg(
            F.regr_slope(x, order).alias("_bx"), F.regr_intercept(x, order).alias("_ax"),
            F.regr_slope(y, order).alias("_by"), F.regr_intercept(y, order).alias("_ay"))
        o = F.col(order)
        return df.join(f, by).withColumns({
            f"{x}_r": F.col(x) - F.col("_ax") - F.col("_bx") * o,
            f"{y}_r": F.col(y) - F.col("_ay") - F.col("_by") * o}).drop("_ax", "_bx", "_ay", "_by")
    c = df.groupBy(*by).agg(F.avg(order).alias("_om"), F.stddev_pop(order).alias("_os"))
    d = df.join(c, by).withColumn("_o", div(F.col(order) - F.col("_om"), "_os"))
    pw = lambda k: F.lit(1.0) if k == 0 else F.pow("_o", F.lit(float(k)))
    m = d.groupBy(*by).agg(
        *[F.sum(pw(k)).alias(f"_m{k}") for k in range(2 * degree + 1)],
        *[F.sum(pw(k) * F.col(v)).alias(f"_{n}{k}") for n, v in (("x", x), ("y", y)) for k in range(degree + 1)])
    k = degree + 1
    flat = [F.col(f"_m{i + j}").cast("double") for i in range(k) for j in range(k)]
    flat += [F.col(f"_{n}{j}").cast("double") for n in "xy" for j in range(k)]
    m = m.select(*by, _solver(k, 2)(F.array(*flat)).alias("_c"))
    m = m.select(*by, *[F.col("_c")[q * k + i].alias(f"_c{n}{i}") for q, n in enumerate("xy") for i in range(k)])
    j = d.join(m, by)
    fit = lambda n: sum((F.col(f"_c{n}{k}") * pw(k) for k in range(1, degree + 1)), F.col(f"_c{n}0"))
    return j.withColumns({f"{x}_r": F.col(x) - fit("x"), f"{y}_r": F.col(y) - fit("y")}).select(*df.columns, f"{x}_r", f"{y}_r")


def sampling_rate(df: DataFrame, by: list[str], ts: str, order: list[str]) -> DataFrame:
    """One over the median step."""
    small = fits(df, by)
    d = scan(df, by, order, F.col(ts), {"_p": ("lag", ts)}, small=small).withColumn("_d", F.col(ts) - F.col("_p"))
    q = quantiles(d.filter(F.col("_d").isNotNull()), by, "_d", {"median_step": 0.5}, small)
    return q.withColumn("rate", div(F.lit(1.0), "median_step"))


def decimate(df: DataFrame, by: list[str], order: list[str], pos, k: int) -> DataFrame:
    """Every k-th sample, the first one kept."""
    return row_numbers(df, by, order, pos, "_rn").filter((F.col("_rn") - 1) % k == 0).drop("_rn")


def block_range(df: DataFrame, by: list[str], ts: str, x: str, size: float, step: float, first: int = 50) -> DataFrame:
    """Max - min in a window of ``size`` every ``step`` from the unit's start; the
    median over the first blocks."""
    t0 = df.groupBy(*by).agg(F.min(ts).alias("_t0"))
    d = df.join(t0, by).withColumn("_o", F.col(ts) - F.col("_t0"))
    d = d.withColumn("_k", F.floor(F.col("_o") / step)).filter(
        (F.col("_k") < first) & (F.col("_o") - F.col("_k") * step < size))
    r = d.groupBy(*by, "_k").agg((F.max(x) - F.min(x)).alias("_r"))  # at most `first` blocks per unit
    return r.groupBy(*by).agg(F.percentile("_r", F.lit(0.5)).alias("median_range"), F.count(F.lit(1)).alias("n_blocks"))


