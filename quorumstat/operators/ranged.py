"""Rank correlations of groups above the slice size, under one or several weights per row.

One column is ranked on the histogram of its values and meets the rows. Along the other the rows
are dealt in ranges and sorted once; a task streams its range and keeps sums only: those of the runs
of equal values on a batch's borders, and those of what lies between. A run that goes on elsewhere
is put together from these few rows, so a value that many rows share is cut like any other. A
bootstrap replicate is a weight per row (how often it was drawn), not a copy of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.core import u01
from ..sources.sinks import cut
from . import packed
from .ordered import chunk_rows, meet, scan, squash

#: Rows that are worked on at once, and draws that are sorted by block at once.
BATCH, DRAWS = 100_000, 500_000
SUMS = ["_m", "_s", "_xx", "_a", "_b", "_c"]


def plain(df: DataFrame, by: list[str], *cols: str) -> bool:
    """True if keys and numbers have types that batches can be cut and ranked by."""
    types = dict(df.dtypes)
    return all(types[b] in packed.KEYS for b in by) and all(types[c] in packed.NUMBERS for c in cols)


def histogram_ranks(d: DataFrame, by: list[str], x: str, w: str | None, n: int, few: bool, out: str) -> DataFrame:
    """(by, x, out): average ranks of x less their mean, one for each weight (a number without weights)."""
    weights = [F.lit(1)] if w is None else [F.get(w, F.lit(i)) for i in range(n)]
    h = d.groupBy(*by, x).agg(*[F.sum(c).alias(f"_m{i}") for i, c in enumerate(weights)])
    h = h if few else cut(h, "histogram")  # slices read their input several times
    tot = h.groupBy(*by).agg(*[F.sum(f"_m{i}").alias(f"_t{i}") for i in range(n)])
    h = scan(h, by, [x], squash(x), {f"_u{i}": ("sum", f"_m{i}") for i in range(n)}, small=few)
    h = meet(h, tot, by) if by else h.join(F.broadcast(tot))
    r = [F.col(f"_u{i}") - (F.col(f"_m{i}") - 1) / F.lit(2.0) - (F.col(f"_t{i}") + 1) / F.lit(2.0) for i in range(n)]
    return h.select(*by, x, (r[0] if w is None else F.array(*r)).alias(out))


def _matrix(t: pa.Table, c: str, n: int) -> np.ndarray:
    """(n, rows) of a column of numbers or of lists of n numbers."""
    v = t.column(c).combine_chunks()
    v = v.flatten() if pa.types.is_list(v.type) else v
    return np.ascontiguousarray(v.to_numpy(zero_copy_only=False).reshape(-1, n).T)


def border_sums(t: pa.Table, by: list[str], y: str, w: str | None, ranked: list[str], n: int) -> pa.RecordBatch:
    """Sums over the first and the last run of equal y of each group, and over what lies between.

    Ranks count from the start of a part; a row of the result is a (part, weight, ranked column).
    """
    v = t.column(y).to_numpy()
    group = packed._changes(t, by)
    same = v[1:] == v[:-1]
    if v.dtype.kind == "f":
        same |= np.isnan(v[1:]) & np.isnan(v[:-1])
    first = np.append(True, group)
    runs = np.flatnonzero(np.append(True, group | ~same))
    opens = first[runs]
    border = opens | np.append(opens[1:], True)
    new = border | np.append(True, border[:-1])
    parts = np.flatnonzero(new)  # first run of each part
    part = np.cumsum(new) - 1
    at = runs[parts]
    weight = np.ones((1, t.num_rows)) if w is None else _matrix(t, w, n).astype(float)
    rank = [_matrix(t, c, n) for c in ranked]
    known = [~np.isnan(x[0]) for x in rank]
    over = lambda q: np.add.reduceat(q, parts)
    found = []
    for r in range(n):
        for x, ok in zip(rank, known):
            wr = np.where(ok, weight[r], 0.0)
            m = np.add.reduceat(wr, runs)
            before = np.cumsum(m) - m
            local = before - before[parts][part] + (m + 1) / 2.0
            wx = wr * np.where(ok, x[r], 0.0)
            s = np.add.reduceat(wx, runs)
            found.append([over(m), over(s), np.add.reduceat(np.where(ok, wx * x[r], 0.0), at), over(m * local), over(s * local), over(m * local * local)])
    k = len(found)
    rows = pa.array(np.tile(at, k))
    keys = t.select([*by, y]).take(rows)
    return pa.RecordBatch.from_arrays(
        [*[keys.column(i).combine_chunks() for i in range(len(by) + 1)], pa.array(np.tile(border[parts], k)),
         pa.array(np.repeat(np.arange(k), len(at)), pa.int32()), *[pa.array(np.concatenate(c)) for c in zip(*found)]],
        [*by, "_lo", "_run", "_q", *SUMS])


def along(d: DataFrame, by: list[str], ranked: list[str], y: str, w: str | None, n: int, parts: int) -> DataFrame:
    """(by, rep, _j, n, rho): rank correlation of y with the columns of known ranks."""
    types = dict(d.dtypes)
    rows = max(1000, min(BATCH, 40 * BATCH // (n * len(ranked))))
    d = d.select(*by, y, *([w] if w else []), *ranked)
    d = d.repartitionByRange(parts, *by, y, F.xxhash64(*ranked, *([w] if w else []))).sortWithinPartitions(*by, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= rows:
                yield border_sums(pa.Table.from_batches(held), by, y, w, ranked, n)
                held = []
        if sum(h.num_rows for h in held):
            yield border_sums(pa.Table.from_batches(held), by, y, w, ranked, n)

    schema = ", ".join([*[f"`{b}` {types[b]}" for b in by], f"_lo {types[y]}, _run boolean, _q int", *[f"{c} double" for c in SUMS]])
    e = d.mapInArrow(run, schema).groupBy(*by, "_q", "_lo", "_run").agg(*[F.sum(c).alias(c) for c in SUMS])
    whole = W.partitionBy(*by, "_q")
    m = F.col("_m")
    e = e.withColumns({"_n": F.sum("_m").over(whole),
                       "_off": F.coalesce(F.sum("_m").over(whole.orderBy("_lo").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))})
    e = e.withColumn("_off", F.col("_off") - (F.col("_n") + 1) / 2.0)  # ranks less their mean
    off, mid = F.col("_off"), F.col("_off") + (m + 1) / 2.0  # a run has one rank
    xy = F.when(F.col("_run"), F.col("_s") * mid).otherwise(F.col("_b") + off * F.col("_s"))
    yy = F.when(F.col("_run"), m * mid * mid).otherwise(F.col("_c") + 2.0 * off * F.col("_a") + off * off * m)
    s = e.groupBy(*by, "_q").agg(F.sum("_m").alias("n"), F.sum(xy).alias("_xy"), F.sum("_xx").alias("_xx"), F.sum(yy).alias("_yy"))
    k = len(ranked)
    return s.filter(F.col("n") > 0).select(
        *by, F.floor(F.col("_q") / k).cast("int").alias("rep"), (F.col("_q") % k).alias("_j"), F.col("n").cast("long").alias("n"),
        F.round(F.col("_xy") / F.nullif(F.sqrt(F.col("_xx") * F.col("_yy")), F.lit(0.0)), 10).alias("rho"))


def spearman(df: DataFrame, by: list[str], xs: dict[str, str], y: str, w: str | None = None, n: int = 1) -> DataFrame:
    """(by, rep, n, one column per entry of ``xs``): Spearman of y and each x, for each of n weights.

    ``w`` names a list of n whole numbers per row. Rows without y are left out, those without an x
    for that x. Groups are those that every x has.
    """
    df = df.filter(F.col(y).isNotNull())
    sides = list(dict.fromkeys([*xs.values(), y]))
    sizes = df.agg(F.count(F.lit(1)), *[F.approx_count_distinct(F.xxhash64(*by, c)) for c in sides]).first()  # chooses the plan only
    rows = chunk_rows(df)
    few = {c: k <= min(rows // 4, 2 * rows // n) for c, k in zip(sides, sizes[1:])}
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * sizes[0] // rows))
    names = list(xs)
    turned = [o for o in names if not few[xs[o]] and few[y]]  # y is ranked, x sorted
    out = None
    for sort, outs in [(y, [o for o in names if o not in turned]), *[(xs[o], [o]) for o in turned]]:
        if not outs:
            continue
        d = df.filter(F.col(sort).isNotNull())
        rows_of = d
        unknown = F.lit(float("nan")) if w is None else F.array_repeat(F.lit(float("nan")), n)
        for j, o in enumerate(outs):
            x = y if o in turned else xs[o]
            r = histogram_ranks(rows_of.filter(F.col(x).isNotNull()), by, x, w, n, few[x], f"_r{j}")
            d = meet(d, F.broadcast(r) if few[x] else r, [*by, x]).withColumn(f"_r{j}", F.coalesce(f"_r{j}", unknown))
        e = along(d, by, [f"_r{j}" for j in range(len(outs))], sort, w, n, parts)
        e = e.groupBy(*by, "rep").agg(F.count(F.lit(1)).alias("_k"), F.max("n").alias("n"), *[F.max(F.when(F.col("_j") == j, F.col("rho"))).alias(o) for j, o in enumerate(outs)])
        e = e.filter(F.col("_k") == len(outs)).drop("_k")
        out = e if out is None else meet(out, e.drop("n"), [*by, "rep"], "inner")
    return out.select(*by, "rep", "n", *names)


def draw_counts(slots: DataFrame, size: int, n: int, seed) -> DataFrame:
    """``slots`` with ``_w``, how often each of n replicates drew the row, in place of ``_slot``.

    A replicate draws ``size`` of the slots 0 .. size - 1, as ``resample.draws`` does. Draws are
    sent to blocks of slots as lists and counted there beside the rows of the block.
    """
    spark = slots.sparkSession
    width = max(1, min(chunk_rows(slots) // 4, 60 * BATCH // n))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = spark.range(0, size, 1, tasks).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep"))
    drawn = drawn.select(F.floor(u01(seed, "rep", "draw") * F.lit(size)).alias("_slot"), "rep")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(held):
            t = pa.Table.from_batches(held)
            slot, rep = t.column("_slot").to_numpy(), t.column("rep").to_numpy()
            block, code = slot // width, (slot % width) * n + rep
            o = np.argsort(block, kind="stable")
            blocks, first = np.unique(block[o], return_index=True)
            edges = pa.array(np.append(first, len(o)), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(blocks), pa.ListArray.from_arrays(edges, pa.array(code[o], pa.int32()))], ["_blk", "_codes"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= DRAWS:
                yield lists(held)
                held = []
        if sum(h.num_rows for h in held):
            yield lists(held)

    codes = drawn.mapInArrow(deal, "_blk bigint, _codes array<int>")
    mine = slots.withColumn("_blk", F.floor(F.col("_slot") / F.lit(width)))
    kept = [c for c in slots.columns if c != "_slot"]

    def count(rows: pa.Table, codes: pa.Table) -> pa.Table:
        got = np.zeros(width * n, np.int32)
        for c in codes.column("_codes").chunks:
            got += np.bincount(c.flatten().to_numpy(), minlength=width * n).astype(np.int32)
        at = rows.column("_slot").to_numpy() % width
        edges = pa.array(np.arange(len(at) + 1) * n, pa.int32())
        return rows.select(kept).append_column("_w", pa.ListArray.from_arrays(edges, pa.array(got.reshape(width, n)[at].ravel())))

    schema = T.StructType([*[slots.schema[c] for c in kept], T.StructField("_w", T.ArrayType(T.IntegerType()))])
    return mine.groupBy("_blk").cogroup(codes.groupBy("_blk")).applyInArrow(count, schema)
