"""Ordered computations inside groups of any size.

A plain window puts a whole group into one task. ``fits`` therefore checks group
sizes first (one aggregate). Where every group has at most ``quorumstat.chunkRows``
rows the plain window runs. Otherwise groups above that size are cut into
order-preserving slices, the window runs per (group, slice), and one carry row per
slice links the slices. Slice borders come from exact counts, minima and maxima
only, so a recomputed task cuts the same way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.core import col

CHUNK_CONF = "quorumstat.chunkRows"
CHUNK_ROWS = 1_000_000


def chunk_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(CHUNK_CONF, str(CHUNK_ROWS)))


def squash(c) -> Column:
    """Order-preserving signed log, so that equal-width slices suit heavy tails (log1p is
    monotone by specification)."""
    v = col(c).cast("double")
    return F.signum(v) * F.log1p(F.abs(v))


def fits(df: DataFrame, by: list[str], most: int | None = None) -> bool:
    """True if every group of ``by`` (the whole table for no keys) fits one slice (and ``most`` rows)."""
    rows = min(chunk_rows(df), most or chunk_rows(df))
    if not by:
        return df.count() <= rows
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows).isEmpty()


def sizes(df: DataFrame, by: list[str]) -> tuple[bool, int]:
    """Whether every group fits one slice, and tasks of at most half a slice for all rows (groups permitting)."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n"), F.sum("_n")).first()
    tasks = -(-2 * (n[1] or 0) // chunk_rows(df))
    return (n[0] or 0) <= chunk_rows(df), max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks)


def few(df: DataFrame, *cols: str) -> bool:
    """True if the number of distinct keys fits one slice."""
    return fits(df.select(*cols).distinct(), [])


def meet(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi join on ``keys`` in which a NULL key meets a NULL key; the keys of ``b`` go."""
    names = {k: f"_b_{i}" for i, k in enumerate(keys)}
    on = reduce(lambda x, y: x & y, [a[k].eqNullSafe(F.col(names[k])) for k in keys])
    return a.join(b.withColumnsRenamed(names), on, how).drop(*names.values())


#: Rows of a big group that are drawn for each of its slices to place the borders.
DRAWN = 24


def _big_groups(df, by, pos, base, base_by):
    """Groups above the slice size: at most total rows / slice size of them.

    Borders are quantiles of a keyed sample of the group's positions, so one position far
    off moves no border. The sample depends on the rows alone; a task that runs again, or
    another use of the plan, gets the same borders.
    """
    rows = chunk_rows(df)
    if base is None:
        g = df.groupBy(*by).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_lo"), F.max("_pos").alias("_hi")
        )
        keys = by
    else:
        keys = base_by
        g = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        g = g.withColumns({"_lo": F.lit(0.0), "_hi": F.lit(1.0)})
    k = F.ceil(F.col("_n") / F.lit(rows)) * 2
    big = g.filter(F.col("_n") > rows).select(
        *keys,
        k.cast("double").alias("_k"),
        F.col("_lo"),
        ((F.col("_hi") - F.col("_lo")) / k).alias("_width"),
    )
    if base is not None:
        return big, keys
    flat = [c for c in df.columns if not df.schema[c].dataType.simpleString().startswith(("map", "variant"))]
    draw = F.pmod(F.xxhash64(*flat), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sized = g.filter(F.col("_n") > rows).select(*keys, (F.lit(float(DRAWN * 2)) / rows).alias("_share"))
    some = (meet(df, F.broadcast(sized), keys, "inner") if keys else df.join(F.broadcast(sized))).filter(draw < F.col("_share"))
    cuts = some.groupBy(*keys).agg(F.array_sort(F.collect_list("_pos")).alias("_all")).select(
        *keys, F.transform(F.sequence(F.lit(1), F.greatest(F.floor(F.size("_all") / DRAWN), F.lit(1)).cast("int")), lambda i: F.get(F.col("_all"), i * DRAWN - 1)).alias("_cuts"))
    big = big.drop("_lo", "_width")
    return (meet(big, cuts, keys) if keys else big.join(cuts, F.lit(True), "left")), keys


def slice_groups(df: DataFrame, by: list[str], pos, base: DataFrame | None = None,
                 base_by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Add the slice number ``_c``. Returns (all rows, rows of sliced groups only).

    ``pos`` must not decrease along the order. With ``base`` the group sizes are
    counted there (before replication) and ``pos`` is taken as uniform on [0, 1).
    """
    d = df.withColumn("_pos", col(pos).cast("double"))
    big, keys = _big_groups(d, by, pos, base, base_by)
    if base is None:
        at = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda b: F.coalesce(b < F.col("_pos"), F.lit(False))))
        c = F.when(F.col("_k").isNotNull(), F.when(F.isnan("_pos"), F.size(F.coalesce("_cuts", F.array().cast("array<double>"))) + 1).otherwise(at)).cast("int")
        drop = ["_k", "_cuts", "_pos"]
    else:
        c, drop = _even(), ["_k", "_lo", "_width", "_pos"]
    if keys:
        both, only = meet(d, F.broadcast(big), keys), meet(d, F.broadcast(big), keys, "inner")
    else:
        one, dd = big.withColumn("_one", F.lit(1)), d.withColumn("_one", F.lit(1))
        both = dd.join(F.broadcast(one), "_one", "left").drop("_one")
        only = dd.join(F.broadcast(one), "_one", "inner").drop("_one")
    return (both.withColumn("_c", c).drop(*drop), only.withColumn("_c", c).drop(*drop))


def _even() -> Column:
    """Slice number by equal widths, for positions that are uniform draws."""
    return F.when(
        F.col("_k").isNotNull(),
        F.coalesce(
            F.least(F.floor((F.col("_pos") - F.col("_lo")) / F.nullif(F.col("_width"), F.lit(0.0))),
                    F.col("_k") - 1),
            F.lit(0.0),
        ),
    ).cast("int")


def _combine(kind, local, carry, first):
    if kind in ("row", "sum"):
        return F.coalesce(local + carry, local, carry)
    if kind == "min":
        return F.least(local, carry)
    if kind == "max":
        return F.greatest(local, carry)
    if kind == "last":
        return F.coalesce(local, carry)
    return F.when(first == 1, carry).otherwise(local)  # lag


def scan(df: DataFrame, by: list[str], order: list[str], pos, outs: dict, *, reverse: bool = False,
         base: DataFrame | None = None, base_by: list[str] | None = None,
         small: bool | None = None) -> DataFrame:
    """Running values along ``order`` inside ``by``, any group size.

    ``outs`` maps an output name to (kind, column) with kind one of ``row`` (row
    number), ``sum``, ``min``, ``max``, ``last`` (last non-null up to here) and
    ``lag`` (previous row). ``reverse`` runs from the end: ``last`` becomes the next
    non-null value and ``lag`` the following row.
    """
    if small is None:
        small = fits(df, by) if base is None else fits(base, base_by)
    if not small:
        every, sliced = slice_groups(df, by, pos, base, base_by)
    keys = by if small else [*by, "_c"]
    direction = [col(o).desc() if reverse else col(o).asc() for o in order]
    w = W.partitionBy(*keys).orderBy(*direction)
    cum = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    slice_order = F.col("_c").desc() if reverse else F.col("_c").asc()
    before = W.partitionBy(*by).orderBy(slice_order).rowsBetween(W.unboundedPreceding, -1)
    edge = F.min_by if reverse else F.max_by
    at = F.struct(*[col(o) for o in order])

    local, summary, carry = [], [], []
    need_first = not small and any(k == "lag" for k, _ in outs.values())
    if need_first:
        local.append(F.row_number().over(w).alias("_first"))
    for name, (kind, c) in outs.items():
        c = None if c is None else col(c)
        if kind == "row":
            lo, su, ca = F.row_number().over(w).cast("long"), F.count(F.lit(1)), F.sum
        elif kind == "sum":
            lo, su, ca = F.sum(c).over(cum), F.sum(c), F.sum
        elif kind == "min":
            lo, su, ca = F.min(c).over(cum), F.min(c), F.min
        elif kind == "max":
            lo, su, ca = F.max(c).over(cum), F.max(c), F.max
        elif kind == "last":
            lo = F.last(c, ignorenulls=True).over(cum)
            su = edge(c, F.when(c.isNotNull(), at))
            ca = lambda x: F.last(x, ignorenulls=True)
        elif kind == "lag":
            lo = F.lag(c, 1).over(w)
            su = edge(F.struct(c.alias("v")), at)
            ca = F.last
        else:
            raise ValueError(kind)
        local.append(lo.alias(name if small else f"_l_{name}"))
        summary.append(su.alias(f"_s_{name}"))
        ov = ca(F.col(f"_s_{name}")).over(before)
        carry.append((ov.getField("v") if kind == "lag" else ov).alias(f"_k_{name}"))

    if small:
        return df.select(*[c for c in df.columns if c not in outs], *local)
    left = every.select("*", *local)
    links = sliced.groupBy(*keys).agg(*summary).select(*keys, *carry)
    out = meet(left, links, keys)
    first = F.col("_first") if need_first else None
    final = [
        _combine(kind, F.col(f"_l_{n}"), F.col(f"_k_{n}"), first).alias(n)
        for n, (kind, _) in outs.items()
    ]
    return out.select(*[c for c in df.columns if c not in outs], *final)


def row_numbers(df, by, order, pos, out="rn", base=None, base_by=None, small=None) -> DataFrame:
    return scan(df, by, order, pos, {out: ("row", None)}, base=base, base_by=base_by, small=small)


def keyed_order(df, by, u: Column, key: str, out="rn", base=None, base_by=None, small=None) -> DataFrame:
    """Row number in the order of a keyed random draw, ties broken by the key."""
    d = df.withColumn("_u", u)
    return row_numbers(d, by, ["_u", key], F.col("_u"), out, base, base_by, small).drop("_u")


def value_counts(df: DataFrame, by: list[str], c: str, weight: str | None = None) -> DataFrame:
    """Distinct values per group with their cumulative count: the sorted histogram."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    v = df.filter(F.col(c).isNotNull()).groupBy(*by, c).agg(n.alias("_m"))
    return scan(v, by, [c], squash(c), {"_cum": ("sum", "_m")}, small=False)


def avg_ranks(df: DataFrame, by: list[str], cols: dict[str, str], weight: str | None = None,
              small: bool | None = None) -> DataFrame:
    """Average rank over ties of each column inside ``by``; NULLs get no rank.

    Groups above the slice size are ranked on the histogram of their distinct
    values, which is then joined back.
    """
    if small is None:
        small = fits(df, by)
    if small:
        one = F.lit(1) if weight is None else F.col(weight)
        new = []
        for name, c in cols.items():
            w = F.when(F.col(c).isNotNull(), one).otherwise(0)
            cum = F.sum(w).over(W.partitionBy(*by).orderBy(c).rangeBetween(W.unboundedPreceding, W.currentRow))
            tie = F.sum(w).over(W.partitionBy(*by, c))
            new.append(F.when(F.col(c).isNotNull(), cum - (tie - 1) / F.lit(2.0)).alias(name))
        return df.select("*", *new)
    out = df
    for name, c in cols.items():
        v = value_counts(df, by, c, weight)
        r = v.select(*by, c, (F.col("_cum") - (F.col("_m") - 1) / F.lit(2.0)).alias(name))
        out = meet(out, r, [*by, c])
    return out.select(*df.columns, *cols)


def quantiles(df: DataFrame, by: list[str], c: str, qs: dict[str, float], small: bool | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group.

    Groups above the slice size are read off the sorted histogram, so no task holds
    all values of a group.
    """
    if small is None:
        small = fits(df, by)
    if small:
        every = F.percentile(c, F.array(*[F.lit(float(q)) for q in qs.values()])).alias("_q")  # one pass, one buffer
        return df.groupBy(*by).agg(every).select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(qs)])
    v = value_counts(df, by, c)
    keys = by
    if not by:
        v, keys = v.withColumn("_g", F.lit(0)), ["_g"]
    tot = v.groupBy(*keys).agg(F.sum("_m").alias("_n"))
    j = meet(v, tot, keys)
    aggs, finals = [], []
    for name, q in qs.items():
        h = F.lit(float(q)) * (F.col("_n") - 1)
        lo = F.floor(h)
        aggs += [
            F.min(F.when(F.col("_cum") >= lo + 1, F.col(c))).alias(f"_a_{name}"),
            F.min(F.when(F.col("_cum") >= lo + 2, F.col(c))).alias(f"_b_{name}"),
            F.max(h - lo).alias(f"_f_{name}"),
        ]
        a, b, f = (F.col(f"_{t}_{name}") for t in "abf")
        finals.append((a + F.coalesce((b - a) * f, F.lit(0.0))).alias(name))
    return j.groupBy(*keys).agg(*aggs).select(*by, *finals)


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)
