"""Peaks of series of any length, by height and by distance.

A peak is a sample, or the middle of a run of equal samples, with a lower one on either side.
Where peaks stand closer than ``distance``, the highest stays and puts out its neighbours, then
the next highest one that is left, and so on. That order of decisions is local: a task settles a
block of a series together with a margin, except for peaks whose fate hangs on what lies beyond
the margin. These wait for the next round, in which their neighbours have been settled. The
highest open peak of a series is settled in every round, so the rounds end; there are two or three
unless the peaks form a staircase that is longer than a block. Series no longer than a block are
worked on whole, many at a time, behind one shuffle (``packed``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import nan_to_null
from ..sources.sinks import cut
from . import packed
from .ordered import fits, scan

#: Samples that a block covers, at least.
BLOCK = 1 << 16
OPEN, KEPT, OUT, UNSURE = range(4)


def local_maxima(df: DataFrame, by: list[str], idx: str, x: str) -> DataFrame:
    """(by, idx, x) of every peak; of a run of equal samples the middle, left of it if even.

    NULL, NaN and infinite values are missing, and beside a missing value there is no peak, nor
    at the ends of a series. A NULL series key is a series of its own.
    """
    d = df.select(*by, F.col(idx).cast("long").alias("_i"), nan_to_null(x).alias("_v"))
    small = fits(d, by)
    once = (lambda t: t) if small else (lambda t: cut(t, "runs"))  # slices read their input several times
    d = once(scan(d, by, ["_i"], "_i", {"_p": ("lag", "_v")}, small=small))
    d = d.withColumn("_new", F.when(F.col("_v").eqNullSafe(F.col("_p")), 0).otherwise(1))
    d = scan(d, by, ["_i"], "_i", {"_run": ("sum", "_new")}, small=small)
    runs = d.groupBy(*by, "_run").agg(F.min("_i").alias("_a"), F.max("_i").alias("_z"), F.max("_v").alias("_v"))
    runs = scan(once(runs), by, ["_run"], "_run", {"_l": ("lag", "_v")}, small=small)
    runs = scan(once(runs), by, ["_run"], "_run", {"_r": ("lag", "_v")}, small=small, reverse=True)
    top = (F.col("_l") < F.col("_v")) & (F.col("_r") < F.col("_v"))
    return runs.filter(top).select(*by, F.floor((F.col("_a") + F.col("_z")) / 2).alias(idx), F.col("_v").alias(x))


def settle(i: np.ndarray, v: np.ndarray, kept: np.ndarray, distance: int, lo: int, hi: int) -> np.ndarray:
    """State of every peak, if those outside of [lo, hi) are unknown. ``i`` ascends."""
    state = np.where(kept, KEPT, OPEN)
    a = np.searchsorted(i, i - distance, side="right")
    z = np.searchsorted(i, i + distance, side="left")
    inside = (i - distance + 1 >= lo) & (i + distance - 1 < hi)
    for p in np.lexsort((i, v))[::-1]:  # the highest first, of equal ones the later
        if state[p] == KEPT:
            continue
        near = state[a[p]:z[p]]
        if (near == KEPT).any():
            state[p] = OUT
        elif inside[p] and not (near == UNSURE).any():
            state[p] = KEPT
        else:
            state[p] = UNSURE
    return state


def thin(peaks: DataFrame, by: list[str], idx: str, x: str, distance: int, block: int = BLOCK) -> DataFrame:
    """Peaks left when none may be closer than ``distance`` to a higher one that stays."""
    if distance <= 1:
        return peaks
    margin = 8 * distance
    width = max(block, margin)
    t = peaks.select(*by, F.col(idx).cast("long").alias("_i"), F.col(x).cast("double").alias("_v"), F.lit(False).alias("_kept"))
    schema = T.StructType([*t.select(*by).schema.fields, T.StructField("_i", T.LongType()), T.StructField("_v", T.DoubleType()),
                           T.StructField("_kept", T.BooleanType())])

    def one_block(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_i", ignore_index=True)
        start = int(g["_blk"].iloc[0]) * width
        i = g["_i"].to_numpy()
        state = settle(i, g["_v"].to_numpy(), g["_kept"].to_numpy(dtype=bool), distance, start - margin, start + width + margin)
        mine = (i >= start) & (i < start + width) & (state != OUT)
        return g.loc[mine, [*by, "_i", "_v"]].assign(_kept=state[mine] == KEPT)

    at = lambda s: F.floor((F.col("_i") + F.lit(s)) / F.lit(width))
    while True:
        d = t.withColumn("_blk", F.explode(F.array_distinct(F.array(at(-margin), at(0), at(margin)))))
        t = cut(d.groupBy(*by, "_blk").applyInPandas(one_block, schema), "peaks")
        if t.filter(~F.col("_kept")).isEmpty():
            return t.select(*by, F.col("_i").alias(idx), F.col("_v").alias(x))


def whole(df: DataFrame, by: list[str], idx: str, block: int) -> bool:
    """True if every series fits a block and has keys that batches can be cut by."""
    return packed.plain(df, by, idx) and fits(df, by, block)


def whole_peaks(df: DataFrame, by: list[str], idx: str, x: str, height: float | None, distance: int,
                more: Callable[..., np.ndarray] | None = None) -> DataFrame:
    """``find_peaks`` of series that fit a block. ``more(v, starts, a, z)`` adds the prominence
    from all samples, the series' first rows, and the first and last row of every peak."""
    types = dict(df.dtypes)
    d = df.select(*by, F.col(idx).cast("long").alias("_i"), nan_to_null(x).alias("_v")).filter(F.col("_i").isNotNull())

    def fn(t, starts):
        i, v = t.column("_i").to_numpy(), t.column("_v").to_numpy()  # NULL is NaN
        new = np.append(True, (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1])))
        new[starts] = True
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(v)) - 1
        g = packed.group_of(starts, len(v))[a]
        there = g[1:] == g[:-1]
        top = np.append(False, there & (v[a][:-1] < v[a][1:])) & np.append(there & (v[a][1:] < v[a][:-1]), False)
        if height is not None:
            top &= v[a] >= height
        a, z, g = a[top], z[top], g[top]
        at = (i[a] + i[z]) // 2
        if distance > 1 and len(at):
            step = np.append(distance, np.where(g[1:] == g[:-1], np.minimum(np.diff(at), distance), distance))
            pos = np.cumsum(step)  # as far apart as the peaks, where that matters
            alone = (step >= distance) & np.append(step[1:] >= distance, True)
            kept = settle(pos, v[a], alone, distance, 0, pos[-1] + distance) == KEPT
            a, z, at = a[kept], z[kept], at[kept]
        if not len(at):
            return
        cols = {idx: at, x: v[a]} | ({"prominence": more(v, starts, a, z)} if more else {})
        keys = t.select(by).take(pa.array(a)).combine_chunks()
        yield pa.RecordBatch.from_arrays([*[keys.column(b).combine_chunks() for b in by], *map(pa.array, cols.values())], [*by, *cols])

    schema = ", ".join([*[f"`{b}` {types[b]}" for b in by], f"`{idx}` bigint, `{x}` double", *(["prominence double"] if more else [])])
    return packed.whole_groups(d, by, fn, schema, ["_i"])


def find_peaks(df: DataFrame, by: list[str], idx: str, x: str, height: float | None = None, distance: int = 1,
               block: int = BLOCK) -> DataFrame:
    """(by, idx, x) of the peaks of at least ``height``, thinned to ``distance`` samples."""
    if whole(df, by, idx, block):
        return whole_peaks(df, by, idx, x, height, distance)
    p = local_maxima(df, by, idx, x)
    if height is not None:
        p = p.filter(F.col(x) >= F.lit(float(height)))
    return thin(p, by, idx, x, distance, block)
