"""Column helpers: keyed random numbers, safe ratios, rounding, time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

chi2_95 = 3.841458820694124


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c) -> Column:
    """Round to 6 places.

    The small shift keeps exact decimal ties (means of 2-decimal values) off the
    rounding border, where summation order would decide; + 0.0 removes -0.0.
    """
    return F.round(col(c).cast("double") + F.lit(3.3e-10), 6) + F.lit(0.0)


def r4(c) -> Column:
    return F.round(col(c).cast("double"), 4) + F.lit(0.0)


def div(a, b) -> Column:
    """a / b, NULL when b is 0 (ANSI mode would raise)."""
    return col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))


def corr(x, y) -> Column:
    """Pearson correlation, NULL for a constant column."""
    return F.covar_samp(col(x), col(y)) / F.nullif(
        F.stddev_samp(col(x)) * F.stddev_samp(col(y)), F.lit(0.0)
    )


def nan_to_null(c) -> Column:
    """NaN and infinities become NULL so that aggregates skip them."""
    c = col(c).cast("double")
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, c)


def seconds(ts) -> Column:
    """Timestamp as double seconds. Wall-clock columns are read as UTC."""
    return F.unix_micros(col(ts).cast("timestamp")) / F.lit(1e6)


def u01(seed, *keys) -> Column:
    """Portable uniform draw in [0, 1): first 32 bits of md5(seed|key|...)."""
    parts = [F.lit(str(seed))] + [
        (col(k) if isinstance(k, (str, Column)) else F.lit(k)).cast("string") for k in keys
    ]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10)
    return h.cast("double") / F.lit(4294967296.0)


def normal(seed, *keys) -> Column:
    """Standard normal draw (Box-Muller on two keyed uniforms), 6 places."""
    a = F.lit(1.0) - u01(seed, *keys, F.lit("a"))
    b = u01(seed, *keys, F.lit("b"))
    return F.round(F.sqrt(-2.0 * F.log(a)) * F.cos(2.0 * math.pi * b), 6)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the shuffle partitions, whatever their keys.

    Used before rows are multiplied: a small input would otherwise be multiplied inside
    the few tasks that read it. The session's number of shuffle partitions holds, whatever it is.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def replicates(df: DataFrame, n: int, name: str = "rep") -> DataFrame:
    """Every row once per replicate, as a generator rather than a cross join.

    Dealing the rows first moves 1/n of the replicated rows and removes any skew.
    """
    return spread(df).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name))


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row (a one-row broadcast)."""
    return df.join(F.broadcast(one))


def mean_abs(c) -> Column:
    return F.avg(F.abs(col(c)))


def _erf(x: np.ndarray) -> np.ndarray:
    return np.frompyfunc(math.erf, 1, 1)(x).astype(float)


@F.pandas_udf(T.DoubleType())
def norm_p_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value; neither SQL engine has erf."""
    v = z.to_numpy(dtype=float)
    return pd.Series(1.0 - _erf(np.abs(v) / math.sqrt(2.0)))
