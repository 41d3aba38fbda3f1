"""Intraclass correlation, split-half reliability and attenuation ceilings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import div, replicates, u01, with_row
from .ordered import few, keyed_order
from .stats import spearman


def icc_cells(cells: DataFrame, by: list[str], item: str) -> DataFrame:
    """A10 from one row (n, s, ss) per (by, item): one-way random-effects ICC.

    NULL below 3 items, 6 rows, or without spare degrees of freedom.
    """
    n, s = F.col("n"), F.col("s")
    c = cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_k"), F.sum(n).alias("_N"), F.sum(s).alias("_S"),
        F.sum("ss").alias("_SS"), F.sum(s * s / n).alias("_B"), F.sum(n * n).alias("_N2"),
    )
    k, N, S = F.col("_k"), F.col("_N"), F.col("_S")
    msb = div(F.col("_B") - S * S / N, k - 1)
    msw = div(F.col("_SS") - F.col("_B"), N - k)
    n0 = div(N - F.col("_N2") / N, k - 1)
    den = msb + (n0 - 1) * msw
    ok = (k >= 3) & (N >= 6) & (N > k) & (den > 0)
    return c.select(*by, k.alias("k"), N.alias("n"), F.when(ok, div(msb - msw, den)).alias("icc"))


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, sum and sum of squares per cell (partial aggregation, no window)."""
    v = F.col(value)
    return df.filter(v.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"))


def icc_oneway(df: DataFrame, by: list[str], item: str, value: str) -> DataFrame:
    """A10: unbalanced one-way ICC of ``value`` over ``item`` inside ``by``."""
    return icc_cells(moments(df, [*by, item], value), by, item)


def reliability_analytic(df: DataFrame, by: list[str], mean: str, sd: str, n: str) -> DataFrame:
    """Single-rater ICC and reliability of n-rater means, capped at 0.999."""
    d = df.filter(F.col(sd).isNotNull() & F.col(mean).isNotNull() & (F.col(n) > 1))
    s = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_items"), F.avg(F.col(sd) * F.col(sd)).alias("_vw"),
        F.var_samp(mean).alias("_vo"), F.avg(n).alias("_n0"))
    vb = F.greatest(F.col("_vo") - F.col("_vw") / F.col("_n0"), F.lit(0.0))
    icc = div(vb, vb + F.col("_vw"))
    s = s.withColumn("icc", icc)
    rel = F.when(F.col("icc") > 0, F.col("_n0") * F.col("icc") / (1 + (F.col("_n0") - 1) * F.col("icc"))).otherwise(0.0)
    return s.select(*by, "n_items", "icc", F.least(rel, F.lit(0.999)).alias("reliability"))


def spearman_brown(r):
    return F.when(F.col(r) > -1, 2 * F.col(r) / (1 + F.col(r)))


def summarise_splits(per_split: DataFrame, min_items: int, by: list[str] | None = None) -> DataFrame:
    """Spearman-Brown per split, then averaged, with p10/p90 over splits."""
    by = by or []
    d = per_split.filter((F.col("n") >= min_items) & F.col("rho").isNotNull()).withColumn("sb", spearman_brown("rho"))
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_splits"), F.avg("rho").alias("raw_mean"), F.avg("sb").alias("spearman_brown"),
        F.percentile("sb", F.lit(0.1)).alias("sb_p10"), F.percentile("sb", F.lit(0.9)).alias("sb_p90"))


def halves_by_unit(df: DataFrame, unit: str, n: int, seed, by: list[str] | None = None) -> DataFrame:
    """(unit, half flags): exact random halves of the units, one array entry per split."""
    by = by or []
    u = df.select(*by, unit).distinct()
    tot = u.groupBy(*by).agg(F.count(F.lit(1)).alias("_t"))
    r = replicates(u, n)
    r = keyed_order(r, [*by, "rep"], u01(seed, "rep", unit), unit, "_rn", base=u, base_by=by)
    r = r.join(tot, by) if by else with_row(r, tot)
    return r.select(*by, unit, "rep", (F.col("_rn") <= F.floor(F.col("_t") / 2)).alias("first"))


def split_half_units(df: DataFrame, item: str, unit: str, value: str, n: int, seed,
                     min_items: int = 10) -> DataFrame:
    """Halves of the units, item means in both halves, Spearman per split.

    Rows are reduced to (unit, item) sums before they meet the splits.
    """
    cells = moments(df, [unit, item], value).drop("ss")
    flags = halves_by_unit(df, unit, n, seed).groupBy(unit).agg(
        F.map_from_entries(F.collect_list(F.struct("rep", "first"))).alias("_h"))  # n entries per unit
    j = cells.join(flags, unit).select(item, "n", "s", F.explode("_h").alias("rep", "first"))
    f = F.col("first")
    m = j.groupBy("rep", item).agg(
        div(F.sum(F.when(f, F.col("s"))), F.sum(F.when(f, F.col("n")))).alias("_a"),
        div(F.sum(F.when(~f, F.col("s"))), F.sum(F.when(~f, F.col("n")))).alias("_b"))
    return summarise_splits(spearman(m, ["rep"], "_a", "_b", small=few(df, item)), min_items)


def split_items(df: DataFrame, item: str, key: str, n: int, seed) -> DataFrame:
    """Rows per split with their random position inside the item and the item size."""
    size = df.groupBy(item).agg(F.count(F.lit(1)).alias("_size"))
    d = df.join(size, item)
    return keyed_order(replicates(d, n), ["rep", item], u01(seed, "rep", key), key, "_rn", base=df, base_by=[item])


def split_half_items(df: DataFrame, item: str, key: str, value: str, n: int, seed, min_rows: int = 2,
                     min_items: int = 3) -> DataFrame:
    """Every item's rows cut into two random halves of equal size."""
    r = split_items(df.filter(F.col(value).isNotNull()), item, key, n, seed).filter(F.col("_size") >= min_rows)
    h = F.floor(F.col("_size") / 2)
    rn, v = F.col("_rn"), F.col(value)
    m = r.groupBy("rep", item).agg(F.avg(F.when(rn <= h, v)).alias("_a"),
                                   F.avg(F.when((rn > h) & (rn <= 2 * h), v)).alias("_b"))
    return summarise_splits(spearman(m, ["rep"], "_a", "_b", small=few(df, item)), min_items)


def split_one_rest(df: DataFrame, item: str, key: str, value: str, n: int, seed, min_items: int = 3) -> DataFrame:
    """One random row of every item against the mean of the others."""
    r = split_items(df.filter(F.col(value).isNotNull()), item, key, n, seed)
    m = r.groupBy("rep", item).agg(F.avg(F.when(F.col("_rn") == 1, F.col(value))).alias("_a"),
                                   F.avg(F.when(F.col("_rn") > 1, F.col(value))).alias("_b"))
    return summarise_splits(spearman(m, ["rep"], "_a", "_b", small=few(df, item)), min_items)


def attenuation(df: DataFrame, rho: str, rx: str, ry: str) -> DataFrame:
    """Ceiling sqrt(rxx * ryy) and the share of it that was reached."""
    cap = F.when(F.col(rx) * F.col(ry) > 0, F.sqrt(F.col(rx) * F.col(ry)))
    return df.withColumn("ceiling", cap).withColumn("share_of_ceiling", div(rho, "ceiling"))
