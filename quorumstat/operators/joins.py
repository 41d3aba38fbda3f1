"""Joins: validated, defaulted, as-of, tolerance, interval and pair products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import col
from .labels import common
from .ordered import scan


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def join_1to1(a: DataFrame, b: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Equi join that refuses repeated keys on either side."""
    for side, d in (("left", a), ("right", b)):
        if not duplicate_keys(d, key).isEmpty():
            raise ValueError(f"repeated key {key} on the {side} side")
    return a.join(b, key, how)


def left_with_default(a: DataFrame, b: DataFrame, key: str, c: str, prefix: str = "u") -> DataFrame:
    """Left join; a missing ``c`` becomes prefix + key."""
    j = a.join(b, key, "left")
    return j.withColumn(c, F.coalesce(F.col(c), F.concat(F.lit(prefix), F.col(key).cast("string"))))


def keep_keys(df: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is in the set."""
    return df.join(keys.select(*key), key, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not in the set."""
    return df.join(keys.select(*key), key, "left_anti")


def common_sample(tables: list[DataFrame], key: str) -> list[DataFrame]:
    """Every table cut to the keys that all of them have."""
    keys = common(tables, key)
    return [d.join(keys, key, "left_semi") for d in tables]


def _merge(left: DataFrame, right: DataFrame, by: list[str], ts: str, lcols: list[str], rcols: list[str],
           left_first: bool = False) -> DataFrame:
    """Both sides as one time line; ``_s`` orders equal times (right side first by default)."""
    lt, rt = (0, 1) if left_first else (1, 0)
    lid, rid = lcols[0], rcols[0]
    a = left.select(*by, F.col(ts).alias("_t"), F.lit(lt).alias("_s"), F.col(lid).cast("string").alias("_id"),
                    F.lit(True).alias("_left"), F.struct(*lcols).alias("_l"))
    b = right.select(*by, F.col(ts).alias("_t"), F.lit(rt).alias("_s"), F.col(rid).cast("string").alias("_id"),
                     F.lit(False).alias("_left"), F.struct(F.col(ts).alias("_rt"), *rcols).alias("_r"))
    return a.unionByName(b, allowMissingColumns=True)


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], ts: str, lcols: list[str],
                  rcols: list[str]) -> DataFrame:
    """Last right row at or before each left row, with the lead time.

    ``lcols[0]``/``rcols[0]`` are row ids. One merged time line and a running last
    value: no range join. ``bijective`` tells per group whether every left row found
    a right row of its own.
    """
    m = _merge(left, right, by, ts, lcols, rcols)
    s = scan(m, by, ["_t", "_s", "_id"], F.col("_t"), {"_last": ("last", F.col("_r"))})
    d = s.filter(F.col("_left")).select(
        *by, F.col("_t").alias(ts), "_l.*", *[F.col(f"_last.{c}").alias(c) for c in rcols],
        (F.col("_t") - F.col("_last._rt")).alias("lead_s"))
    b = d.groupBy(*by).agg((F.countDistinct(rcols[0]) == F.count(F.lit(1))).alias("bijective"))
    return d.join(b, by)


def nearest_within(left: DataFrame, right: DataFrame, by: list[str], ts: str, lcols: list[str],
                   rcols: list[str], tol: float) -> DataFrame:
    """Nearest right row within the tolerance, the earlier one on equal distance."""
    m = _merge(left, right, by, ts, lcols, rcols)
    order, pos = ["_t", "_s", "_id"], F.col("_t")
    m = scan(m, by, order, pos, {"_b": ("last", F.col("_r"))})
    m = scan(m, by, order, pos, {"_a": ("last", F.col("_r"))}, reverse=True).filter(F.col("_left"))
    db, da = F.col("_t") - F.col("_b._rt"), F.col("_a._rt") - F.col("_t")
    use_b = F.col("_a").isNull() | (F.col("_b").isNotNull() & (db <= da))
    pick = F.when(use_b, F.col("_b")).otherwise(F.col("_a"))
    d = m.select(*by, F.col("_t").alias(ts), "_l.*", pick.alias("_p"))
    d = d.withColumn("distance", F.abs(F.col("_p._rt") - F.col(ts))).filter(F.col("distance") <= tol)
    return d.select(*by, ts, *lcols, *[F.col(f"_p.{c}").alias(c) for c in rcols], "distance")


def close_join(left: DataFrame, right: DataFrame, by: list[str], lts: str, rts: str, eps: float) -> DataFrame:
    """All pairs with |a - b| <= eps. Time buckets of width eps make it an equi join;
    the bucket is part of the key, so one busy unit spreads over many tasks."""
    width = F.lit(max(eps, 1e-9))
    b = F.floor(F.col(lts) / width)
    a = left.withColumn("_b", F.explode(F.sequence(b - 1, b + 1)))
    r = right.withColumn("_b", F.floor(F.col(rts) / width))
    return a.join(r, [*by, "_b"]).filter(F.abs(F.col(lts) - F.col(rts)) <= eps).drop("_b")


def window_join(events: DataFrame, samples: DataFrame, by: list[str], onset: str, ts: str, a: float,
                b: float) -> DataFrame:
    """Samples in [onset + a, onset + b), as an equi join on (by, time bucket).

    A bucket is as wide as the window, so an event meets two buckets at most.
    """
    width = F.lit(float(b - a))
    lo, hi = F.col(onset) + a, F.col(onset) + b
    e = events.withColumn("_b", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
    s = samples.withColumn("_b", F.floor(F.col(ts) / width))
    return e.join(s, [*by, "_b"]).filter((F.col(ts) >= lo) & (F.col(ts) < hi)).drop("_b")


def drop_overlapping(trials: DataFrame, gaps: DataFrame, by: list[str], key: str, onset: str, pre: float,
                     post: float, start: str = "gap_start", end: str = "gap_end") -> DataFrame:
    """Trials whose window (onset + pre, onset + post) overlaps no gap.

    Gaps that start before the window's end are running-maxed by their end on a merged
    time line; the window overlaps one of them exactly if that maximum passes its start.
    """
    t = trials.select(*by, (F.col(onset) + post).alias("_t"), F.lit(0).alias("_s"),
                      F.col(key).cast("string").alias("_id"), F.struct(*[c for c in trials.columns if c not in by]).alias("_row"))
    g = gaps.select(*by, F.col(start).alias("_t"), F.lit(1).alias("_s"), F.col(start).cast("string").alias("_id"),
                    F.col(end).alias("_end"))
    m = t.unionByName(g, allowMissingColumns=True)
    m = scan(m, by, ["_t", "_s", "_id"], F.col("_t"), {"_far": ("max", "_end")}).filter(F.col("_row").isNotNull())
    d = m.select(*by, "_row.*", "_far")
    return d.filter(F.col("_far").isNull() | (F.col("_far") <= F.col(onset) + pre)).drop("_far")


def paired_diff(df: DataFrame, key: list[str], arm: str, a, b, value: str, out: str = "d") -> DataFrame:
    """Value of arm a minus value of arm b per key, complete pairs only."""
    v = F.col(value)
    s = df.groupBy(*key).agg(F.max(F.when(F.col(arm) == a, v)).alias("_a"), F.max(F.when(F.col(arm) == b, v)).alias("_b"))
    return s.withColumn(out, F.col("_a") - F.col("_b")).filter(F.col(out).isNotNull()).drop("_a", "_b")


def ordered_pairs(df: DataFrame, name: str, domain: str) -> DataFrame:
    """Ordered pairs of corpora with a same/cross-domain tag.

    The corpora are a handful of names, collected into one array and exploded twice.
    """
    names = df.select(name, domain).distinct().agg(
        F.sort_array(F.collect_set(F.struct(F.col(name).alias("n"), F.col(domain).alias("d")))).alias("_c"))
    e = names.select("_c", F.explode("_c").alias("_s"))
    e = e.select("_c", "_s", F.explode("_c").alias("_t")).filter(F.col("_s.n") != F.col("_t.n"))
    return e.select(F.col("_s.n").alias("source"), F.col("_t.n").alias("target"),
                    F.col("_s.d").alias("source_domain"), F.col("_t.d").alias("target_domain"),
                    F.when(F.col("_s.d") == F.col("_t.d"), "same-domain").otherwise("cross-domain").alias("domain_match"), "_c")


def sham_source(pairs: DataFrame) -> DataFrame:
    """First corpus in neither role, valid if it lies outside the target's domain."""
    third = F.get(F.filter("_c", lambda x: (x["n"] != F.col("source")) & (x["n"] != F.col("target"))), F.lit(0))
    d = pairs.withColumn("_x", third)
    return d.select("source", "target", "domain_match", F.col("_x.n").alias("third"),
                    (F.col("_x.d") != F.col("target_domain")).alias("sham_valid"))


def with_grid(df: DataFrame, **axes: list) -> DataFrame:
    """Every row for every combination of the parameter axes (generators, no join)."""
    out = df
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out


def mutual(ab: DataFrame, ba: DataFrame, a: str, b: str) -> DataFrame:
    """J14 core: pairs that are each other's best match."""
    return ab.join(ba.select(a, b), [a, b])


def overlap(lo1, hi1, lo2, hi2) -> Column:
    return (col(lo1) < col(hi2)) & (col(hi1) > col(lo2))


