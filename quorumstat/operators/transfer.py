"""Corpus-to-corpus transfer: alignment, gains, folds and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import u01, with_row
from . import ranged
from .neighbours import knn
from .ordered import fits, keyed_order, meet, row_numbers
from .stats import spearman
from .vectors import doubles


def representation_gain(df: DataFrame, axis: str, algo: str, y: str, a: str, ad: str) -> DataFrame:
    """Gain of the wider representation per axis over all models, and its wins."""
    by = [axis, algo]
    small = fits(df, by)
    if not small and ranged.plain(df, by, y, a, ad):
        g = ranged.spearman(df, by, {"_ra": a, "_rb": ad}, y)
    else:
        ra = spearman(df, by, y, a, "_ra", "_na", small).drop("_na")
        rb = spearman(df, by, y, ad, "_rb", "_nb", small).drop("_nb")
        g = ra.join(rb, by)
    g = g.withColumn("_g", F.col("_rb") - F.col("_ra"))
    return g.groupBy(axis).agg(
        F.count(F.lit(1)).alias("n_algos"), F.min("_g").alias("min_gain"), F.max("_g").alias("max_gain"),
        F.percentile("_g", F.lit(0.5)).alias("median_gain"), F.count_if(F.col("_g") > 0).alias("wins"))


# folds -------------------------------------------------------------------------

def group_folds(df: DataFrame, group: str, k: int, seed) -> DataFrame:
    """M1: (group, fold): whole groups dealt in a snake over their sizes, largest first.

    Equal sizes are ordered by a keyed draw, which also spreads them over rank slices.
    """
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_u", u01(seed, group))
    g = g.withColumn("_o", -F.col("_n"))
    r = row_numbers(g, [], ["_o", "_u", group], F.col("_o") + F.col("_u"), "_rn").withColumn("_i", F.col("_rn") - 1)
    turn, at = F.floor(F.col("_i") / k), F.col("_i") % k
    return r.select(group, F.when(turn % 2 == 0, at).otherwise(k - 1 - at).cast("int").alias("fold"))


def class_vectors(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, _v): rows of each class in every group, classes in order; a null label is a class.

    The class list is a model-sized table; more than 1,000 classes are an error.
    """
    names = [r[0] for r in df.select(label).distinct().orderBy(F.col(label).asc_nulls_first()).limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError(f"{label} has more than 1000 classes")
    no = F.coalesce(*[F.when(F.col(label).eqNullSafe(F.lit(n)), F.lit(i)) for i, n in enumerate(names)], F.lit(-1)).alias("_c")
    cells = df.select(group, no).groupBy(group, "_c").agg(F.count(F.lit(1)).alias("_n"))
    held = cells.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("_c", "_n"))).alias("_m"))
    vector = F.array(*[F.coalesce(F.element_at("_m", F.lit(i)), F.lit(0).cast("long")) for i in range(len(names))]) if names else F.array().cast("array<bigint>")
    return held.select(group, vector.alias("_v"))


def coarse(n: Column) -> Column:
    """Counts below 16 as they are, others by their four leading bits: at most 16 + 8 * 60 values."""
    low = F.greatest(F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int") - 3, F.lit(0))
    return F.concat_ws("x", F.floor(n / F.pow(F.lit(2.0), low)).cast("string"), low.cast("string"))


def stratified_group_folds(df: DataFrame, group: str, label: str, k: int, seed) -> DataFrame:
    """M2: (group, fold): whole groups, class shares alike in all folds.

    Groups of (nearly) equal class counts are exchangeable: they are dealt in a snake, k at a
    time, largest first. What is left, fewer than k groups of each kind of counts, fills the
    folds one by one, largest first: a group goes to the fold whose classes it shares are
    emptiest, which keeps the variance of the class shares over the folds least. The kinds
    number at most ``coarse`` values to the power of the classes, whatever the number of groups,
    and they alone are filled in one task.
    """
    import numpy as np
    import pandas as pd

    g = class_vectors(df, group, label)
    g = g.withColumns({"_n": F.aggregate("_v", F.lit(0).cast("long"), lambda a, x: a + x), "_u": u01(seed, group), "_kind": F.concat_ws(",", F.transform("_v", coarse))})
    g = row_numbers(g.withColumn("_o", -F.col("_n")), ["_kind"], ["_o", "_u", group], F.col("_o") + F.col("_u"), "_rn")
    kinds = g.groupBy("_kind").agg(F.count(F.lit(1)).alias("_k"))
    g = g.join(kinds, "_kind").withColumn("_i", F.col("_rn") - 1)
    turn, at = F.floor(F.col("_i") / k), F.col("_i") % k
    g = g.withColumn("fold", F.when(F.col("_i") < F.col("_k") - F.col("_k") % k, F.when(turn % 2 == 0, at).otherwise(k - 1 - at).cast("int")))
    dealt = g.filter("fold is not null")
    loads = dealt.select("fold", F.posexplode("_v").alias("_c", "_x")).groupBy("fold", "_c").agg(F.sum("_x").alias("_x"))
    name, kind = F.col(group).alias(group), g.schema[group].dataType.simpleString()
    left = g.filter("fold is null").select(name, "_v", "_n", "_u", F.lit(-1).alias("fold"))
    base = loads.groupBy("fold").agg(F.sort_array(F.collect_list(F.struct("_c", "_x"))).alias("_l")).select(
        F.lit(None).cast(kind).alias(group), F.transform("_l", lambda x: x["_x"]).alias("_v"), F.lit(0).cast("long").alias("_n"), F.lit(0.0).alias("_u"), "fold")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.array(pdf["_v"].tolist(), dtype=float).reshape(len(pdf), -1)
        fold = pdf["fold"].to_numpy()
        total = np.maximum(v.sum(axis=0), 1.0)
        load = np.zeros((k, v.shape[1]))
        load[fold[fold >= 0]] = v[fold >= 0]
        rows = np.flatnonzero(fold < 0)
        names = pdf[group].tolist()
        rows = sorted(rows.tolist(), key=lambda r: (-pdf["_n"].iat[r], pdf["_u"].iat[r], names[r] is not None, names[r]))
        out = []
        for r in rows:
            score = np.round(((load * v[r]) / total**2).sum(axis=1), 12)
            best = min(range(k), key=lambda f: (score[f], load[f].sum(), f))
            load[best] += v[r]
            out.append(best)
        return pd.DataFrame({group: pd.Series([names[r] for r in rows], dtype=object), "fold": pd.Series(out, dtype="int32")})

    filled = left.unionByName(base).groupBy().applyInPandas(fill, f"`{group}` {kind}, fold int")
    return dealt.select(group, "fold").unionByName(filled)


def folds(df: DataFrame, how: str, k: int, key: str, label: str | None = None, seed="fold", group: str | None = None) -> DataFrame:
    """M2: ``stratified`` deals rows inside each label (with ``group``: whole groups, see
    ``stratified_group_folds``), ``shuffled`` all rows, ``leave_one_category_out`` makes every
    label value a fold."""
    if how == "leave_one_category_out":
        names = df.agg(F.sort_array(F.collect_set(label)).alias("_l"))  # the categories
        return with_row(df, names).withColumn("fold", (F.array_position("_l", F.col(label)) - 1).cast("int")).drop("_l")
    if group is not None:
        if how != "stratified":
            raise ValueError("group needs stratified folds; group_folds deals groups without labels")
        return meet(df, stratified_group_folds(df, group, label, k, seed), [group], "inner")
    by = [label] if how == "stratified" else []
    r = keyed_order(df, by, u01(seed, key), key, "_rn")
    return r.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_rn")


# neighbours --------------------------------------------------------------------

def knn_regress(train: DataFrame, test: DataFrame, key: str, vec: str, y: str, k: int) -> DataFrame:
    """Mean target of the k nearest training rows."""
    near = knn(test, train, key, key, vec, k)
    ys = train.select(F.col(key).alias(f"{key}_near"), F.col(y).alias("_y"))
    return near.join(ys, f"{key}_near").groupBy(key).agg(F.avg("_y").alias("prediction"), F.avg("distance").alias("mean_distance"))


def applicability(train: DataFrame, test: DataFrame, key: str, vec: str, k: int, z: float) -> DataFrame:
    """Threshold Z * sd + mean of the training rows' mean neighbour distance (self
    left out), and the share of test rows inside."""
    m = lambda d: d.groupBy(key).agg(F.avg("distance").alias("_d"))
    tr = m(knn(train, train, key, key, vec, k, exclude_same=True)).agg(
        F.avg("_d").alias("mean_distance"), F.stddev_pop("_d").alias("sd_distance"))
    tr = tr.withColumn("threshold", z * F.col("sd_distance") + F.col("mean_distance"))
    te = with_row(m(knn(test, train, key, key, vec, k)), tr)
    return te.groupBy("mean_distance", "sd_distance", "threshold").agg(
        F.count(F.lit(1)).alias("n_test"), F.avg((F.col("_d") <= F.col("threshold")).cast("int")).alias("share_inside"))


# second moments ------------------------------------------------------------------

def vector_moments(df: DataFrame, by: list[str], vec: str, dim: int) -> DataFrame:
    """Mean and sample variance of every dimension, one aggregate, no exploding."""
    g = lambda i: F.get(F.col(vec), F.lit(i)).cast("double")
    return df.groupBy(*by).agg(F.array(*[F.avg(g(i)) for i in range(dim)]).alias("mean"),
                               F.array(*[F.var_samp(g(i)) for i in range(dim)]).alias("var"), F.count(F.lit(1)).alias("n"))


def coral_diag(src: DataFrame, tgt: DataFrame, vec: str, dim: int, lam: float, out: str = "aligned") -> DataFrame:
    """Every dimension of the source moved to the target's mean and variance."""
    ms = vector_moments(src, [], vec, dim).select(F.col("mean").alias("_ms"), F.col("var").alias("_vs"))
    mt = vector_moments(tgt, [], vec, dim).select(F.col("mean").alias("_mt"), F.col("var").alias("_vt"))
    d = with_row(with_row(src, ms), mt)
    par = F.arrays_zip(doubles(vec).alias("x"), F.col("_ms").alias("ms"), F.col("_vs").alias("vs"), F.col("_mt").alias("mt"), F.col("_vt").alias("vt"))
    a = F.transform(par, lambda p: (p["x"] - p["ms"]) * F.sqrt((p["vt"] + lam) / (p["vs"] + lam)) + p["mt"])
    return d.withColumn(out, a).drop("_ms", "_vs", "_mt", "_vt")


def zscore_align(df: DataFrame, corpus: str, vec: str, dim: int, eps: float = 1e-9, out: str = "aligned") -> DataFrame:
    """Every corpus standardised by its own mean and SD."""
    m = vector_moments(df, [corpus], vec, dim).select(corpus, F.col("mean").alias("_m"), F.col("var").alias("_v"))
    par = F.arrays_zip(doubles(vec).alias("x"), F.col("_m").alias("m"), F.col("_v").alias("v"))
    return df.join(F.broadcast(m), corpus).withColumn(
        out, F.transform(par, lambda p: (p["x"] - p["m"]) / (F.sqrt(p["v"]) + eps))).drop("_m", "_v")


def binned_effect(df: DataFrame, x: str, y: str, key: str, bins: int) -> DataFrame:
    """M33 (re-aimed): mean of y in equal-count bins of x; stands in for an additive
    glass-box shape and is not numerically equal to one."""
    d = row_numbers(df.filter(F.col(x).isNotNull()), [], [x, key], F.col(x), "_rn")
    d = with_row(d, df.filter(F.col(x).isNotNull()).agg(F.count(F.lit(1)).alias("_n")))
    base, rem = F.floor(F.col("_n") / bins), F.col("_n") % bins
    i, big = F.col("_rn") - 1, (F.col("_n") % bins) * (F.floor(F.col("_n") / bins) + 1)
    b = F.when(i < big, F.floor(i / (base + 1))).otherwise(rem + F.floor((i - big) / F.greatest(base, F.lit(1))))
    return d.withColumn("bin", (b + 1).cast("int")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"))
