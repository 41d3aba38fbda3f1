"""Boosted additive shapes (M33): y as a mean plus one step function per feature.

Cyclic boosting changes one feature's shape at a time by the mean residual of each of its bins.
With squared error that mean needs no rows: how often two bins occur together, and the sum
of y in each bin, give it for any shapes. So one pass over the rows counts pairs of bins, and
all rounds run on matrices of model size (features x bins, squared).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import matrices
from .ordered import quantiles

#: Numbers a task holds in its matrix of pair counts at most.
CELLS = 4096


def bin_edges(df: DataFrame, vec: str, dim: int, bins: int) -> list[list[float]]:
    """Inner edges of equal-count bins of every feature (a table of model size)."""
    values = df.select(F.posexplode(F.slice(vec, 1, dim)).alias("feature", "x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    e = quantiles(values, ["feature"], "x", {f"e{i}": i / bins for i in range(1, bins)})
    found = {r["feature"]: [float(r[f"e{i}"]) for i in range(1, bins)] for r in e.collect()}
    return [found.get(f, [0.0] * (bins - 1)) for f in range(dim)]


def bin_numbers(vec: str, edges: list[list[float]]) -> Column:
    """array<int>: the bin of every feature, the number of edges below its value."""
    cell = lambda x, e: F.aggregate(e, F.lit(0), lambda n, v: n + F.when(x > v, 1).otherwise(0))
    return F.array(*[cell(F.get(vec, F.lit(f)), F.array(*[F.lit(v) for v in e])) if e else F.lit(0) for f, e in enumerate(edges)])


def pair_counts(df: DataFrame, cells: str, dim: int, bins: int, y: str) -> np.ndarray:
    """Matrix over [cells, y]: rows in both cells, and the sum of y in each. Rows with a NULL are left out.

    Tasks add up Arrow batches and emit one partial matrix each.
    """
    size = dim * bins
    if size > CELLS:
        raise ValueError(f"{dim} features of {bins} bins: more than {CELLS} cells")
    step = max(1, (1 << 21) // size)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size + 1, size + 1))
        for pdf in batches:
            for lo in range(0, len(pdf), step):
                part = pdf.iloc[lo : lo + step]
                at = np.vstack(part["_c"].to_numpy()).astype(int) + np.arange(dim) * bins
                z = np.zeros((len(part), size + 1))
                z[np.arange(len(part))[:, None], at] = 1.0
                z[:, size] = part["_y"].to_numpy(float)
                total += z.T @ z
        yield pd.DataFrame({"i": np.arange(size + 1, dtype=np.int32), "row": list(total)})

    d = df.select(F.col(cells).alias("_c"), F.col(y).cast("double").alias("_y")).filter(F.col("_y").isNotNull() & F.forall("_c", lambda c: c.isNotNull()))
    p = d.mapInPandas(partial, "i int, row array<double>")
    row = F.array(*[F.sum(F.get("row", F.lit(j))) for j in range(size + 1)])
    m = matrices(p.groupBy(F.lit(0).alias("_all"), "i").agg(row.alias("row")), [])
    return m.get((0,), np.zeros((size + 1, size + 1)))


def isotonic(v: np.ndarray, w: np.ndarray, sign: int) -> np.ndarray:
    """The nearest rising (sign 1) or falling (-1) values, by weight; empty bins take the value before them."""
    out: list[list[float]] = []
    for x, n in zip(sign * v, w, strict=True):
        out.append([x if n else -np.inf, n, 1])
        while len(out) > 1 and out[-1][0] <= out[-2][0]:
            x1, n1, k1 = out.pop()
            x0, n0, k0 = out[-1]
            out[-1] = [(x0 * n0 + x1 * n1) / (n0 + n1) if n1 and n0 else x0 if n0 else max(x0, x1), n0 + n1, k0 + k1]
    flat = np.repeat([x for x, _, _ in out], [k for _, _, k in out])
    finite = flat[np.isfinite(flat)]
    return sign * np.where(np.isfinite(flat), flat, finite[0] if len(finite) else 0.0)


def boost(m: np.ndarray, dim: int, bins: int, rounds: int, rate: float, monotone: dict[int, int] | None = None) -> tuple[float, np.ndarray]:
    """(mean, shapes: features x bins) after so many rounds over all features; each shape has mean 0 over the rows."""
    g, s = m[:-1, :-1], m[:-1, -1]
    n = np.diag(g).copy()
    rows = n[:bins].sum()
    mean = s[:bins].sum() / rows if rows else 0.0
    shape = np.zeros(dim * bins)
    for _ in range(rounds):
        for f in range(dim):
            at = slice(f * bins, (f + 1) * bins)
            left = s[at] - mean * n[at] - g[at] @ shape
            shape[at] += rate * np.divide(left, n[at], out=np.zeros(bins), where=n[at] > 0)
            if monotone and monotone.get(f):
                shape[at] = isotonic(shape[at], n[at], monotone[f])
    shapes = shape.reshape(dim, bins)
    off = (shapes * n.reshape(dim, bins)).sum(axis=1) / rows if rows else np.zeros(dim)
    return float(mean + off.sum()), shapes - off[:, None]


def additive_shapes(df: DataFrame, vec: str, dim: int, y: str, bins: int, rounds: int = 200, rate: float = 0.1, monotone: dict[int, int] | None = None) -> DataFrame:
    """(feature, bin, lo, hi, n, shape, intercept): the effect of every feature in every bin.

    ``monotone`` gives features a sign (1 rising, -1 falling) that their shape keeps. ``lo``
    and ``hi`` are NULL at the outer ends.
    """
    edges = bin_edges(df, vec, dim, bins)
    m = pair_counts(df.withColumn("_cells", bin_numbers(vec, edges)), "_cells", dim, bins, y)
    mean, shapes = boost(m, dim, bins, rounds, rate, monotone)
    n = np.diag(m)[:-1].reshape(dim, bins)
    rows = [(f, b, edges[f][b - 1] if b else None, edges[f][b] if b < bins - 1 else None, int(n[f, b]), float(shapes[f, b]), mean) for f in range(dim) for b in range(bins)]
    return df.sparkSession.createDataFrame(rows, "feature int, bin int, lo double, hi double, n long, shape double, intercept double")


def additive_predict(df: DataFrame, vec: str, shapes: DataFrame, out: str = "prediction") -> DataFrame:
    """Intercept plus every feature's effect, as one expression per row (the shapes are of model size)."""
    rows = shapes.orderBy("feature", "bin").collect()
    edges: dict[int, list[float]] = {}
    effect: dict[int, list[float]] = {}
    for r in rows:
        edges.setdefault(r["feature"], []).extend([r["hi"]] if r["hi"] is not None else [])
        effect.setdefault(r["feature"], []).append(r["shape"])
    cells = bin_numbers(vec, [edges[f] for f in sorted(edges)])
    total = F.lit(rows[0]["intercept"] if rows else 0.0)
    d = df.withColumn("_cells", cells)
    for f in sorted(effect):
        total = total + F.get(F.array(*[F.lit(v) for v in effect[f]]), F.get("_cells", F.lit(f)))
    return d.withColumn(out, total).drop("_cells")


def shape_importance(shapes: DataFrame) -> DataFrame:
    """(feature, importance): mean absolute effect over the rows."""
    return shapes.groupBy("feature").agg((F.sum(F.abs("shape") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("importance"))
