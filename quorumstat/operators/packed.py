"""Groups that fit one task, several at a time: one shuffle, then numpy over whole groups.

Used where ``ordered.fits`` holds. Rows are dealt and sorted by their group, and a batch with
all the rows of its groups is worked on at once, so many small groups cost no call each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types whose order and equality numpy shares with Spark.
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
KEYS = ("tinyint", "smallint", "int", "bigint", "string", "date", "timestamp", "boolean")


def plain(df: DataFrame, by: list[str], *cols: str) -> bool:
    """True if keys and numbers have types that batches can be cut and ranked by."""
    types = dict(df.dtypes)
    return bool(by) and all(types[b] in KEYS for b in by) and all(types[c] in NUMBERS for c in cols)


def _changes(t: pa.Table, by: list[str]) -> np.ndarray:
    """True where a row's keys differ from the row before (first row left out); NULL equals NULL."""
    out = np.zeros(max(t.num_rows - 1, 0), bool)
    for b in by:
        a = t.column(b).combine_chunks()
        one, two = a[1:], a[:-1]
        out |= pc.fill_null(pc.not_equal(one, two), False).to_numpy(zero_copy_only=False)
        out |= pc.not_equal(pc.is_null(one), pc.is_null(two)).to_numpy(zero_copy_only=False)
    return out


def whole_groups(df: DataFrame, by: list[str], fn: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str,
                 order: list[str] | None = None, add: dict[str, Column] | None = None, tasks: int | None = None) -> DataFrame:
    """``fn(table, starts)`` on tables of whole groups, rows in the given order inside each.

    ``starts`` holds the first row of every group. ``add`` names columns that are worked out
    behind the shuffle. A task holds one batch and its longest group, and sorts its share of the rows:
    with ``tasks`` from ``ordered.sizes`` that share doesn't grow with the table.
    """
    d = (df.repartition(tasks, *by) if tasks else df.repartition(*by)).sortWithinPartitions(*by, *(order or [])).withColumns(add or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the group that may go on
        for b in batches:
            if not b.num_rows:
                continue
            edge = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            at = np.flatnonzero(_changes(pa.Table.from_batches([*edge, b]), by)) + 1 - len(edge)
            if not len(at):
                held.append(b)
                continue
            t = pa.Table.from_batches([*held, b.slice(0, at[-1])])
            before = sum(h.num_rows for h in held)
            starts = np.append(0, at[:-1] + before)
            yield from fn(t, starts.astype(np.int64))
            held = [b.slice(at[-1])]
        if held:
            yield from fn(pa.Table.from_batches(held), np.zeros(1, np.int64))

    return d.mapInArrow(run, schema)


def numbers(t: pa.Table, c: str) -> np.ndarray:
    """A column as numpy numbers; whole numbers stay whole if none is NULL."""
    return t.column(c).to_numpy()


def group_of(starts: np.ndarray, rows: int) -> np.ndarray:
    """The group's number for each row."""
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows)))


def ranks(g: np.ndarray, starts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Average rank over ties inside each group; NaN is one value above all others."""
    o = np.lexsort((x, g))
    xs = x[o]
    new = np.ones(len(x), bool)
    same = xs[1:] == xs[:-1]
    if xs.dtype.kind == "f":
        same |= np.isnan(xs[1:]) & np.isnan(xs[:-1])
    new[1:] = ~same
    new[starts] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    out = np.empty(len(x))
    out[o] = np.repeat((first + last) / 2.0, last - first + 1) - starts[g] + 1.0
    return out


def rank_corr(starts: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spearman of each group, snapped to 10 places (NaN for a constant side), and its rows."""
    g = group_of(starts, len(x))
    n = np.diff(np.append(starts, len(x)))
    mid = ((n + 1) / 2.0)[g]
    a, b = ranks(g, starts, x) - mid, ranks(g, starts, y) - mid
    total = lambda v: np.add.reduceat(v, starts)
    scale = np.sqrt(total(a * a) * total(b * b))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.round(np.where(scale > 0, total(a * b) / scale, np.nan), 10), n


def spearman(df: DataFrame, by: list[str], x: str, y: str, out: str, n: str, tasks: int | None = None) -> DataFrame:
    """A4 for groups that fit a task: each row is shuffled once."""
    types = dict(df.dtypes)
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    schema = ", ".join([*[f"`{b}` {types[b]}" for b in by], f"`{n}` bigint", f"`{out}` double"])

    def fn(t, starts):
        rho, size = rank_corr(starts, numbers(t, "_x"), numbers(t, "_y"))
        keys = t.select(by).take(starts).combine_chunks()
        cols = [keys.column(b).combine_chunks() for b in by]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(size, pa.int64()), pa.array(rho, from_pandas=True)], [*by, n, out])

    return whole_groups(d, by, fn, schema, tasks=tasks)


def draw(*parts) -> float:
    """``core.u01`` of texts, for the few draws that belong to a whole group."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0


def known_ranks(g: np.ndarray, groups: int, x: pa.ChunkedArray) -> np.ndarray:
    """Average ranks as ``ordered.avg_ranks`` gives them: NaN, in place of NULL, for a NULL."""
    at = np.flatnonzero(x.is_valid().to_numpy())
    out = np.full(len(g), np.nan)
    if len(at):
        starts = np.searchsorted(g[at], np.arange(groups))
        out[at] = ranks(g[at], starts, x.to_numpy()[at])
    return out


def corr(g: np.ndarray, groups: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``core.corr`` of each group, with NaN in place of NULL."""
    total = lambda v: np.bincount(g, v, groups)

    def part(ok, *cols):
        n = total(ok.astype(float))
        return n, [np.where(ok, c - (total(np.where(ok, c, 0.0)) / n)[g], 0.0) for c in cols]

    with np.errstate(invalid="ignore", divide="ignore"):
        ka, kb = ~np.isnan(a), ~np.isnan(b)
        (n, (da, db)), (na, (ea,)), (nb, (eb,)) = part(ka & kb, a, b), part(ka, a), part(kb, b)
        scale = np.sqrt(total(ea * ea) / (na - 1)) * np.sqrt(total(eb * eb) / (nb - 1))
        return np.where((scale > 0) & (n > 1), total(da * db) / (n - 1) / scale, np.nan)


def circular_shift(df: DataFrame, by: list[str], idx: str, x: str, y: str, n: int, seed, min_shift: int) -> DataFrame:
    """(by, obs, null_p95, n_null) of ``resample.circular_shift`` for series that fit a task: shifts are never exchanged."""
    types = dict(df.dtypes)
    d = df.select(*by, F.col(idx).cast("bigint").alias("_i"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    for b in by:
        d = d.filter(F.col(b).isNotNull())
    text = F.concat_ws("|", *[F.col(b).cast("string") for b in by])

    def fn(t, starts):
        k, rows = len(starts), t.num_rows
        g, size = group_of(starts, rows), np.diff(np.append(starts, rows))
        i = t.column("_i").to_numpy()
        rx, ry = known_ranks(g, k, t.column("_x")), known_ranks(g, k, t.column("_y"))
        obs = corr(g, k, rx, ry)
        keep = np.flatnonzero(size > 2 * min_shift)
        names = t.column("_t").take(pa.array(starts)).to_pylist()
        v = np.full((k, n), np.nan)
        met = np.zeros(k, bool)
        dense = np.array_equal(i, np.arange(rows) - starts[g])
        for r in range(n):
            sh = np.zeros(k, np.int64)
            sh[keep] = [min_shift + int(draw(seed, r, names[j]) * (size[j] - 2 * min_shift)) for j in keep]
            if dense:
                moved = np.empty(rows)
                moved[starts[g] + (i + sh[g]) % size[g]] = rx
                v[:, r], met[:] = np.abs(corr(g, k, moved, ry)), True
            else:
                there = t.column("_i").is_valid().to_numpy()
                one = pd.DataFrame({"g": g, "i": (i + sh[g]) % size[g], "a": rx})[there]
                m = one.merge(pd.DataFrame({"g": g, "i": i, "b": ry})[there], on=["g", "i"])
                at = m["g"].to_numpy()
                v[:, r] = np.abs(corr(at, k, m["a"].to_numpy(), m["b"].to_numpy()))
                met[at] = True
        keep = keep[met[keep]]
        if len(keep):
            known = (~np.isnan(v[keep])).sum(1)
            high = np.full(len(keep), np.nan)
            high[known > 0] = np.nanquantile(v[keep][known > 0], 0.95, axis=1)
            keys = t.select(by).take(pa.array(starts[keep])).combine_chunks()
            yield pa.RecordBatch.from_arrays([*[keys.column(b).combine_chunks() for b in by], pa.array(obs[keep], from_pandas=True),
                                              pa.array(high, from_pandas=True), pa.array(known, pa.int64())], [*by, "obs", "null_p95", "n_null"])

    schema = ", ".join([*[f"`{b}` {types[b]}" for b in by], "obs double, null_p95 double, n_null bigint"])
    return whole_groups(d, by, fn, schema, ["_i"], {"_t": text})


def series_lists(df: DataFrame, unit: str, idx: str, x: str, y: str) -> DataFrame:
    """One row per unit: ``_i`` (steps of the index), ``_x`` and ``_y`` as lists along the index."""
    types = dict(df.dtypes)
    d = df.select(unit, F.col(idx).cast("bigint").alias("_i"), F.col(x).alias("_x"), F.col(y).alias("_y")).filter(F.col(unit).isNotNull() & F.col("_i").isNotNull())

    def fn(t, starts):
        i = t.column("_i").to_numpy()
        step = np.diff(i, prepend=0)
        step[starts] = i[starts]  # steps repeat, so a shuffle hardly carries them
        edges = pa.array(np.append(starts, t.num_rows), pa.int32())
        cols = [t.column("_x").combine_chunks(), t.column("_y").combine_chunks()]
        yield pa.RecordBatch.from_arrays([t.column(unit).take(pa.array(starts)).combine_chunks(), pa.ListArray.from_arrays(edges, pa.array(step)),
                                          *[pa.ListArray.from_arrays(edges, c) for c in cols]], [unit, "_i", "_x", "_y"])

    return whole_groups(d, [unit], fn, f"`{unit}` {types[unit]}, _i array<bigint>, _x array<{types[x]}>, _y array<{types[y]}>", ["_i"])


def _flat(b: pa.RecordBatch, steps: str, values: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, index, value) of the entries of two list columns."""
    c = b.column(steps)
    size = pc.list_value_length(c).to_numpy()
    row = np.repeat(np.arange(len(size)), size)
    run = np.cumsum(c.flatten().to_numpy())
    base = np.append(0, run)[np.cumsum(size) - size]  # what the lists before add up to
    return row, run - base[row], b.column(values).flatten()


def pair_corr(pairs: DataFrame, rep: str) -> DataFrame:
    """(rep, rho) of rows (rep, _i, _y, _j, _x): Spearman of y and x where the indexes meet."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            (r1, i1, y), (r2, i2, x) = _flat(b, "_i", "_y"), _flat(b, "_j", "_x")
            first = lambda r: np.searchsorted(r, np.arange(b.num_rows))[r]
            if np.array_equal(i1, np.arange(len(r1)) - first(r1)) and np.array_equal(i2, np.arange(len(r2)) - first(r2)):
                both = np.minimum(np.bincount(r1, minlength=b.num_rows), np.bincount(r2, minlength=b.num_rows))
                at1, at2 = np.flatnonzero(i1 < both[r1]), np.flatnonzero(i2 < both[r2])
            else:
                m = pd.DataFrame({"r": r1, "i": i1, "a": np.arange(len(r1))}).merge(pd.DataFrame({"r": r2, "i": i2, "b": np.arange(len(r2))}), on=["r", "i"]).sort_values("r")
                at1, at2 = m["a"].to_numpy(), m["b"].to_numpy()
            known = y.is_valid().to_numpy(zero_copy_only=False)[at1] & x.is_valid().to_numpy(zero_copy_only=False)[at2]
            at1, at2 = at1[known], at2[known]
            if len(at1):
                rows, starts = np.unique(r1[at1], return_index=True)
                rho, _ = rank_corr(starts, y.to_numpy(zero_copy_only=False)[at1], x.to_numpy(zero_copy_only=False)[at2])
                yield pa.RecordBatch.from_arrays([b.column(rep).take(pa.array(rows)), pa.array(rho, from_pandas=True)], [rep, "rho"])

    return pairs.mapInArrow(run, f"`{rep}` int, rho double")


def phase_corr(placed: DataFrame, unit: str, x: str, y: str, n: int, draws: Column) -> DataFrame:
    """(unit, rep, rho) of y and ``n`` surrogates of x with its spectrum, for series that fit a task.

    ``placed`` has n and t = 0 .. n - 1. ``draws`` gives a row's n phases (in turns) from ``_k``, the frequency;
    they are worked out behind the shuffle, for the lower half of the frequencies.
    """
    types = dict(placed.dtypes)
    d = placed.select(unit, "n", "t", F.col(x).cast("double").alias("_x"), F.col(y).alias("_y"))
    half = F.when((F.col("t") > 0) & (2 * F.col("t") < F.col("n")), draws)

    def fn(t, starts):
        rows = t.num_rows
        z = t.column("_x").to_numpy()
        made = np.empty((n, rows))
        drawn = t.column("_u").combine_chunks()
        turns = drawn.flatten().to_numpy().reshape(-1, n).T
        used = 0
        for a, e in zip(starts, np.append(starts[1:], rows)):
            half = np.fft.rfft(z[a:e])
            inner = (e - a - 1) // 2  # frequencies with a mirror image
            angle = 2 * np.pi * turns[:, used:used + inner]
            used += inner
            turned = np.repeat(half[None, :], n, axis=0)
            turned[:, 1:inner + 1] = np.abs(half[1:inner + 1]) * np.exp(1j * angle)
            made[:, a:e] = np.fft.irfft(turned, e - a, axis=1) if e - a > 1 else z[a:e]
        keep = np.flatnonzero(t.column("_y").is_valid().to_numpy())
        if not len(keep):
            return
        v = t.column("_y").to_numpy()[keep]
        groups, first = np.unique(group_of(starts, rows)[keep], return_index=True)
        keys = t.column(unit).take(pa.array(starts[groups])).combine_chunks()
        for r in range(n):
            rho, _ = rank_corr(first, np.round(made[r, keep], 9), v)
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(first), r), pa.int32()), pa.array(rho, from_pandas=True)], [unit, "rep", "rho"])

    return whole_groups(d, [unit], fn, f"`{unit}` {types[unit]}, rep int, rho double", ["t"], {"_k": F.col("t"), "_u": half})
