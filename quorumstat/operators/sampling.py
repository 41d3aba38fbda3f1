"""Sorts, top-k, keyed samples, random windows and anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.core import div, u01
from .ordered import keyed_order, scan


def top_effects(df: DataFrame, c: str, key: str, n: int) -> DataFrame:
    """K1: the n largest absolute effects (a top-k report)."""
    return df.orderBy(F.abs(c).desc(), key).limit(n)


def topk(df: DataFrame, by: list[str], order: list, k: int, out: str = "rank") -> DataFrame:
    """K2: k rows per group; the rank limit runs before the shuffle."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(out) <= k)


def argmax(df: DataFrame, by: list[str], c: str, tie: str) -> DataFrame:
    """K3: the row with the largest value per cell, smallest tie key first."""
    rest = [x for x in df.columns if x not in by]
    s = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(F.col(c), -F.col(tie))).alias("_r"))
    return s.select(*by, "_r.*")


def sample_k(df: DataFrame, unit: list[str], key: str, k: int, seed, *salt: str) -> DataFrame:
    """K4: k keyed-random rows per unit without replacement (rank limit before the shuffle)."""
    u = u01(seed, *salt, key)
    d = df.withColumn("_u", u)
    w = W.partitionBy(*unit).orderBy("_u", key)
    return d.withColumn("draw", F.row_number().over(w)).filter(F.col("draw") <= k).drop("_u")


def match_counts(df: DataFrame, unit: str, arm: str, arms: tuple, key: str, seed) -> DataFrame:
    """K5: both arms of a unit cut to the smaller arm's count, at random."""
    a, b = arms
    n = df.groupBy(unit).agg(F.count_if(F.col(arm) == a).alias("_a"), F.count_if(F.col(arm) == b).alias("_b"))
    d = df.filter(F.col(arm).isin(a, b))
    r = keyed_order(d, [unit, arm], u01(seed, key), key, "draw", base=d, base_by=[unit, arm])
    m = n.select(unit, F.least("_a", "_b").alias("_k"))
    return r.join(m, unit).filter(F.col("draw") <= F.col("_k")).drop("_k")


def random_window(df: DataFrame, by: list[str], idx: str, m: int, seed) -> DataFrame:
    """K6: m consecutive samples of each series from a keyed random start (0-based idx)."""
    n = df.groupBy(*by).agg((F.max(idx) + 1).alias("_n")).filter(F.col("_n") >= m)
    s = n.withColumn("start", F.floor(u01(seed, *by) * (F.col("_n") - m + 1)))
    return df.join(s, by).filter((F.col(idx) >= F.col("start")) & (F.col(idx) < F.col("start") + m)).drop("_n")


def random_anchors(df: DataFrame, anchors: DataFrame, unit: str, ts: str, seed, pad: float) -> DataFrame:
    """K7: as many uniform anchors per unit as real ones, inside the padded span."""
    span = df.groupBy(unit).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    n = anchors.groupBy(unit).agg(F.count(F.lit(1)).alias("_n"))
    j = span.join(n, unit).filter(F.col("_hi") - F.col("_lo") > 2 * pad)
    e = j.select("*", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("anchor"))
    t = F.col("_lo") + pad + u01(seed, unit, "anchor") * (F.col("_hi") - F.col("_lo") - 2 * pad)
    return e.select(unit, "anchor", t.alias(ts))


def shift_anchors(df: DataFrame, anchors: DataFrame, unit: str, key: str, ts: str, seed) -> DataFrame:
    """K9: all anchors of a unit moved by one random shift, wrapped into its span."""
    span = df.groupBy(unit).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    span = span.withColumn("_w", F.col("_hi") - F.col("_lo")).withColumn("_sh", u01(seed, unit) * F.col("_w"))
    t = F.col("_lo") + F.coalesce(F.try_mod(F.col(ts) - F.col("_lo") + F.col("_sh"), F.col("_w")), F.lit(0.0))
    return anchors.join(span, unit).select(unit, key, t.alias(ts))


def first_crossing(df: DataFrame, by: list[str], x: str, y: str, level: float) -> DataFrame:
    """K8: x at which y first reaches the level, linear between grid points."""
    d = scan(df, by, [x], F.col(x), {"_px": ("lag", x), "_py": ("lag", y)})
    hit = d.filter(F.col(y) >= level).groupBy(*by).agg(
        F.min_by(F.struct(x, y, "_px", "_py"), x).alias("_h"))
    h = lambda c: F.col(f"_h.{c}")
    step = F.greatest(h(y) - h("_py"), F.lit(1e-9))
    v = F.when(h("_px").isNull(), h(x)).otherwise(h("_px") + div(level - h("_py"), step) * (h(x) - h("_px")))
    return df.select(*by).distinct().join(hit, by, "left").select(*by, v.alias("x_at_level"))


def match_survivors(real: DataFrame, control: DataFrame, unit: str, order: str) -> DataFrame:
    """The first n surviving control epochs per unit, n = surviving real epochs."""
    n = real.groupBy(unit).agg(F.count(F.lit(1)).alias("_n"))
    r = scan(control, [unit], [order], F.col(order), {"_rn": ("row", None)})
    return r.join(n, unit).filter(F.col("_rn") <= F.col("_n")).drop("_rn", "_n")
