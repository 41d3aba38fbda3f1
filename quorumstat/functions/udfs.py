"""The UDF surface (D1-D4): vectorised scalar, grouped map, grouped aggregate, table function.

D1 is ``norm_p_two_sided``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import norm_p_two_sided  # noqa: F401


def grouped_slope(df: DataFrame, unit: str, x: str, y: str) -> DataFrame:
    """Least-squares slope per unit as a grouped map; NULL for a constant x.

    A grouped map holds a unit's rows in one task. Each task therefore first folds its Arrow
    batches to five sums per unit, and only those sums are grouped.
    """
    kind = dict(df.dtypes)[unit]
    sums = ["n", "sx", "sy", "sxx", "sxy"]

    def fold(frames):
        for f in frames:
            f = f.dropna(subset=["_x", "_y"]).assign(n=1.0, sx=lambda d: d["_x"], sy=lambda d: d["_y"], sxx=lambda d: d["_x"] ** 2, sxy=lambda d: d["_x"] * d["_y"])
            yield f.groupby(unit, dropna=False, as_index=False)[sums].sum()

    def slope(g: pd.DataFrame) -> pd.DataFrame:
        n, sx, sy, sxx, sxy = g[sums].sum()
        d = n * sxx - sx * sx
        return pd.DataFrame({unit: g[unit].iloc[:1], "n": [int(n)], "slope": [(n * sxy - sx * sy) / d if d > 0 else None]})

    slim = df.select(unit, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    part = slim.mapInPandas(fold, f"`{unit}` {kind}, " + ", ".join(f"{s} double" for s in sums))
    return part.groupBy(unit).applyInPandas(slope, f"`{unit}` {kind}, n long, slope double")


@F.pandas_udf(T.DoubleType())
def centred_p(obs: pd.Series, null: pd.Series) -> float:
    """D3: two-sided p measured from the null's median (one null per group: replicates)."""
    v = null.dropna().to_numpy(float)
    if not len(v):
        return float("nan")
    c = float(np.median(v))
    return float((1 + (np.abs(v - c) >= abs(obs.iloc[0] - c) - 1e-9).sum()) / (1 + len(v)))


@F.udtf(returnType=T.StructType([T.StructField("k", T.IntegerType()), T.StructField("w", T.DoubleType())]))
class Grid:
    """Every (k, w) of two axes given as lists."""

    def eval(self, ks: list, ws: list):
        for k in ks:
            for w in ws:
                yield int(k), float(w)
