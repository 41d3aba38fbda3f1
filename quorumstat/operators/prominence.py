"""How far peaks stand out of a series of any length.

From a peak one looks to either side up to the nearest higher sample, or to the end of the series;
the prominence is the height above the higher one of the two lowest samples seen. Samples lie in
blocks. A task answers what ends inside its block; a peak without a higher sample there looks up
the first block with a higher maximum in the list of block maxima and minima. In that block only the
records seen from its border count (its staircase): the lowest record above the peak holds the
lowest sample before it, which is a running value over peaks and records in order of height. So
a block that many peaks look into is cut like any other large group. Series no longer than a block
are worked on whole, many at a time, where each begins and ends with an endless height.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import nan_to_null
from ..sources.sinks import cut
from .ordered import meet, scan, union_all
from .peaks import BLOCK, find_peaks, whole, whole_peaks

PEAK, STAIR, WHOLE = range(3)
LEFT, RIGHT = range(2)


def look_left(v: np.ndarray, pos: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest of ``h`` and the samples before ``pos`` up to one above ``h``; is there none such?"""
    top, low = [v], [v]
    while 2 << (len(top) - 1) <= len(v):
        half = 1 << (len(top) - 1)
        top.append(np.maximum(top[-1][:-half], top[-1][half:]))
        low.append(np.minimum(low[-1][:-half], low[-1][half:]))
    at, m = pos.copy(), h.copy()
    for k in reversed(range(len(top))):
        start = at - (1 << k)
        step = np.flatnonzero(start >= 0)
        step = step[top[k][start[step]] <= h[step]]
        m[step] = np.minimum(m[step], low[k][start[step]])
        at[step] = start[step]
    return m, at == 0


def stairs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples higher than all before them, and the lowest sample before each."""
    best = np.concatenate([[-np.inf], np.maximum.accumulate(v)[:-1]])
    least = np.concatenate([[np.inf], np.minimum.accumulate(v)[:-1]])
    new = v > best
    return v[new], least[new]


def block_width(df: DataFrame, by: list[str], idx: str, block: int) -> int:
    """At least the root of the longest series: its list of blocks then is no longer than a block,
    and the lists that all blocks get together hold no more numbers than the series."""
    span = df.groupBy(*by).agg((F.max(idx) - F.min(idx) + 1).alias("n")).agg(F.max("n")).first()[0]
    return max(block, math.isqrt(int(span or 1)) + 1)


def prominences(samples: DataFrame, peaks: DataFrame, by: list[str], idx: str, x: str, block: int = BLOCK) -> DataFrame:
    """(by, idx, x, prominence) of ``peaks`` (by, idx, x) among ``samples``.

    NULL, NaN and infinite samples are passed over. A NULL series key is a series of its own.
    """
    width = block_width(samples, by, idx, block)
    d = union_all([samples.select(*by, F.col(idx).cast("long").alias("_i"), nan_to_null(x).alias("_v"), F.lit(False).alias("_top")),
                   peaks.select(*by, F.col(idx).cast("long").alias("_i"), F.col(x).cast("double").alias("_v"), F.lit(True).alias("_top"))])
    d = d.filter(F.col("_v").isNotNull()).withColumn("_blk", F.floor(F.col("_i") / F.lit(width)))
    keys = d.select(*by).schema.fields

    def schema(**types) -> T.StructType:
        return T.StructType([*keys, *[T.StructField(n, t) for n, t in types.items()]])

    def in_block(g: pd.DataFrame) -> pd.DataFrame:
        s = g[~g["_top"].astype(bool)].sort_values("_i")
        p = g[g["_top"].astype(bool)]
        i, v, pi, h = s["_i"].to_numpy(), s["_v"].to_numpy(), p["_i"].to_numpy(), p["_v"].to_numpy()
        parts = []
        for side in (LEFT, RIGHT):
            pos = np.searchsorted(i, pi, "left") if side == LEFT else len(i) - np.searchsorted(i, pi, "right")
            m, none = look_left(v if side == LEFT else v[::-1], pos, h)
            parts.append(pd.DataFrame({"_kind": PEAK, "_side": side, "_i": pi, "_v": h, "_m": m, "_open": none}))
            r, least = stairs(v[::-1] if side == LEFT else v) if len(v) else (v, v)
            parts.append(pd.DataFrame({"_kind": STAIR, "_side": side, "_i": -1, "_v": r, "_m": least, "_open": False}))
        if len(v):
            parts.append(pd.DataFrame({"_kind": [WHOLE], "_side": LEFT, "_i": -1, "_v": v.max(), "_m": v.min(), "_open": False}))
        out = pd.concat([q for q in parts if len(q)], ignore_index=True)
        for c in [*by, "_blk"]:
            out[c] = pd.Series([g[c].iloc[0]] * len(out), dtype=g[c].dtype)
        return out[[*by, "_blk", "_kind", "_side", "_i", "_v", "_m", "_open"]]

    seen = cut(d.groupBy(*by, "_blk").applyInPandas(in_block, schema(
        _blk=T.LongType(), _kind=T.IntegerType(), _side=T.IntegerType(), _i=T.LongType(), _v=T.DoubleType(), _m=T.DoubleType(),
        _open=T.BooleanType())), "blocks")
    here = seen.filter(F.col("_kind") == PEAK)
    asking = here.filter("_open").select(*by, "_blk", "_side", "_i", "_v")
    lists = seen.filter(F.col("_kind") == WHOLE).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_blk", "_v", "_m"))).alias("_all"))
    lists = lists.select(*by, F.col("_all._blk").alias("_at"), F.col("_all._v").alias("_tops"), F.col("_all._m").alias("_lows"))
    lists = meet(asking.select(*by, "_blk").distinct(), lists, by)
    lists = lists.select([F.col(c).alias(c) for c in lists.columns])  # columns of its own beside those of ``asking``

    def over_blocks(q: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        q = q.reset_index(drop=True)
        m, to = np.full(len(q), np.inf), pd.array([None] * len(q), dtype="Int64")
        at, tops, lows = (np.asarray(of[c].iloc[0]) for c in ("_at", "_tops", "_lows"))
        own = q["_blk"].iloc[0]
        for side in (LEFT, RIGHT):
            there = np.flatnonzero(at < own)[::-1] if side == LEFT else np.flatnonzero(at > own)
            mine = np.flatnonzero(q["_side"].to_numpy() == side)
            if not len(there) or not len(mine):
                continue
            passed = np.searchsorted(np.maximum.accumulate(tops[there]), q["_v"].to_numpy()[mine], "right")
            m[mine] = np.concatenate([[np.inf], np.minimum.accumulate(lows[there])])[passed]
            found = passed < len(there)
            to[mine[found]] = at[there[passed[found]]]
        return q[[*by, "_side", "_i", "_v"]].assign(_m=m, _to=to)

    far = cut(asking.groupBy(*by, "_blk").cogroup(lists.groupBy(*by, "_blk")).applyInPandas(over_blocks, schema(
        _side=T.IntegerType(), _i=T.LongType(), _v=T.DoubleType(), _m=T.DoubleType(), _to=T.LongType())), "far")

    none = F.lit(None).cast("double")
    asked = far.filter(F.col("_to").isNotNull()).select(*by, "_side", F.col("_to").alias("_blk"), (-F.col("_v")).alias("_down"), F.lit(0).alias("_w"), "_i", none.alias("_m"))
    steps = seen.filter(F.col("_kind") == STAIR).select(*by, "_side", "_blk", (-F.col("_v")).alias("_down"), F.lit(1).alias("_w"), "_i", "_m")
    met = scan(union_all([asked, steps]), [*by, "_side", "_blk"], ["_down", "_w", "_i"], "_down", {"_least": ("last", "_m")})
    met = met.filter(F.col("_w") == 0).select(*by, "_side", "_i", (-F.col("_down")).alias("_v"), F.col("_least").alias("_m"))

    every = union_all([here.select(*met.columns), far.select(*met.columns), met])
    sides = every.groupBy(*by, "_i", "_side").agg(F.max("_v").alias("_v"), F.min("_m").alias("_m"))
    out = sides.groupBy(*by, "_i").agg(F.max("_v").alias(x), F.max("_m").alias("_base"))
    return out.select(*by, F.col("_i").alias(idx), x, (F.col(x) - F.col("_base")).alias("prominence"))


def in_series(v: np.ndarray, starts: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Prominence of peaks (first row, last row) among the samples of their series; NaN is passed over."""
    edge = np.zeros(len(v) + 1, int)
    edge[starts] = 1
    edge = np.cumsum(edge[:-1])  # walls up to here
    known = ~np.isnan(v)
    before = np.cumsum(known) - known  # samples up to here
    wall = np.full(known.sum() + len(starts) + 1, np.inf)
    wall[before[known] + edge[known]] = v[known]
    base = np.full(len(a), -np.inf)
    for high, pos in ((wall, before[a] + edge[a]), (wall[::-1], len(wall) - 1 - before[z] - edge[z])):
        base = np.maximum(base, look_left(high, pos, v[a])[0])
    return v[a] - base


def prominent_peaks(df: DataFrame, by: list[str], idx: str, x: str, prominence: float, height: float | None = None,
                    distance: int = 1, block: int = BLOCK) -> DataFrame:
    """Peaks by height, then distance, then at least ``prominence`` above their surroundings."""
    if whole(df, by, idx, block):
        return whole_peaks(df, by, idx, x, height, distance, in_series).filter(F.col("prominence") >= F.lit(float(prominence)))
    tops = cut(find_peaks(df, by, idx, x, height, distance, block), "tops")
    return prominences(df, tops, by, idx, x, block).filter(F.col("prominence") >= F.lit(float(prominence)))
