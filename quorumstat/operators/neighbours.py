"""Exact nearest neighbours on vectors.

Rows of the searched side are grouped around pivots; a query row visits a cell only
if the triangle inequality leaves room for a neighbour there. Rows of a cell travel in
blocks of bounded size; numpy ranks one query block against one base block and keeps
the k best per query, so no all-pairs table is written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.core import u01, with_row
from .vectors import distance, doubles

#: Rows of a block, and of a cell where there are many rows: 1 MB of floats with 64 dimensions.
BLOCK = 4096
#: Distances that a task holds at once.
TILE = 1 << 20


def _pivots(df: DataFrame, key: str, vec: str, n: int) -> DataFrame:
    """A keyed sample of n vectors as one array row (n is a constant)."""
    s = df.select(F.col(key).alias("_k"), doubles(vec).alias("v")).withColumn("_u", u01("pivot", "_k"))
    top = s.orderBy("_u", "_k").limit(n)
    a = top.agg(F.sort_array(F.collect_list(F.struct("_u", "_k", "v"))).alias("_p"))
    return a.select(F.transform("_p", lambda x: x["v"]).alias("_p"))


def _near(qs, qx, bs, bx, k: int, skip_same: bool):
    """(row of qs, row of bs, distance) of the k nearest of ``bx`` for every row of ``qx``.

    A matrix product gives squared distances up to its rounding error, which leaves a few
    candidates for each query; these are measured exactly. Rows of ``bs`` ascend.
    """
    qn, bn = np.einsum("ij,ij->i", qx, qx), np.einsum("ij,ij->i", bx, bx)
    d2 = qn[:, None] + bn[None, :] - 2.0 * (qx @ bx.T)
    if skip_same:
        d2[qs[:, None] == bs[None, :]] = np.inf
    take = min(k, len(bs))
    kth = np.partition(d2, take - 1, axis=1)[:, take - 1] if take < len(bs) else d2.max(axis=1)
    # Distances count to 9 places: 2e-9 * distance covers their rounding, the rest the product's.
    slack = 1e-12 * (qn + (bn.max() if len(bn) else 0.0)) * (1 + qx.shape[1] / 64.0)
    kth = kth + 4e-9 * np.sqrt(np.maximum(kth, 0.0) + slack) + 4.0 * slack + 1e-17
    r, c = np.nonzero(~(d2 > kth[:, None]) & ~np.isposinf(d2))
    d = np.empty(len(r))
    for i in range(0, len(r), 1 << 14):
        x = bx[c[i : i + (1 << 14)]] - qx[r[i : i + (1 << 14)]]
        d[i : i + (1 << 14)] = np.sqrt((x * x).sum(axis=1))
    d = np.round(d, 9)
    order = np.lexsort((c, d, r))
    r, c, d = r[order], c[order], d[order]
    first = np.searchsorted(r, np.arange(len(qs)))
    keep = (np.arange(len(r)) - first[r] < k) & np.isfinite(d)
    return r[keep], c[keep], d[keep]


def _block_search(k: int, skip_same: bool, dim_error: str = "vectors differ in length"):
    """Top k of every query row in one (query block, base block) pair, in numpy."""

    def vectors(col, i):
        v = col.slice(i, 1).flatten()
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if len(flat) % max(len(v), 1):
            raise ValueError(dim_error)
        return flat.reshape(len(v), -1)

    def search(batches):
        for t in batches:
            qk, bk, qv, bv = (t.column(n) for n in ("_qs", "_bs", "_qvs", "_bvs"))
            for i in range(t.num_rows):
                qa, ba = qk.slice(i, 1).flatten(), bk.slice(i, 1).flatten()
                bn = ba.to_numpy(zero_copy_only=False)
                order = np.argsort(bn, kind="stable")
                qn, qx, bx = qa.to_numpy(zero_copy_only=False), vectors(qv, i), vectors(bv, i)[order]
                step = max(1, TILE // max(len(bn), 1))
                for at in range(0, len(qn), step):
                    r, c, d = _near(qn[at : at + step], qx[at : at + step], bn[order], bx, k, skip_same)
                    yield pa.RecordBatch.from_arrays([qa.take(pa.array(r + at)), ba.take(pa.array(order[c])), pa.array(d)], names=["_q", "_b", "distance"])

    return search


def knn(queries: DataFrame, base: DataFrame, qkey: str, bkey: str, vec: str, k: int,
        exclude_same: bool = False) -> DataFrame:
    """The k nearest base rows of every query row: (qkey, bkey, distance, rank).

    Ties go to the smaller base key. With ``exclude_same`` a row is not its own
    neighbour (both sides then share their keys). There are 16 to 512 pivots, one for
    about ``BLOCK`` base rows, since a query travels once to every cell it visits. A
    crowded cell is cut into hashed blocks of about ``BLOCK`` rows, so no task holds it
    whole; each pair of blocks yields k rows per query.
    """
    n_base = base.count()
    pivots = min(512, max(16, n_base // BLOCK))
    sent = lambda d: F.col(vec) if dict(d.dtypes)[vec] == "array<float>" else doubles(vec)
    q = queries.select(F.col(qkey).alias("_q"), sent(queries).alias("_qv"))
    b = base.select(F.col(bkey).alias("_b"), sent(base).alias("_bv"))
    need = k + 1 if exclude_same else k
    piv = _pivots(b, "_b", "_bv", pivots)

    def to_pivots(d, v):
        return with_row(d, piv).withColumn("_d", F.transform("_p", lambda p: distance(doubles(v), p))).drop("_p")

    cells = to_pivots(b, "_bv").withColumn("_r", F.array_min("_d")).withColumn(
        "_cell", F.array_position("_d", F.col("_r")).cast("int")).drop("_d")
    w = W.partitionBy("_cell").orderBy("_r", "_b")
    close = cells.select("_cell", "_b", "_r").withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= need)
    reach = close.groupBy("_cell").agg(F.count(F.lit(1)).alias("_have"), F.max("_r").alias("_kth"))
    radius = cells.groupBy("_cell").agg(F.max("_r").alias("_rad"), F.count(F.lit(1)).alias("_size")).join(reach, "_cell")
    table = radius.agg(F.collect_list(F.struct("_cell", "_rad", "_have", "_kth")).alias("_cells"))  # one per pivot

    d = with_row(to_pivots(q, "_qv"), table)
    bound = F.array_min(F.transform(
        F.filter("_cells", lambda c: c["_have"] >= need),
        lambda c: F.element_at("_d", c["_cell"]) + c["_kth"]))
    d = d.withColumn("_ub", F.coalesce(bound, F.lit(float("inf"))))
    visit = F.filter("_cells", lambda c: F.element_at("_d", c["_cell"]) - c["_rad"] <= F.col("_ub") + 1e-9)
    d = d.select("_q", "_qv", F.explode(F.transform(visit, lambda c: c["_cell"])).alias("_cell"))

    def blocks(rows, key, v, sizes, names):
        n = F.ceil(F.col("_size") / F.lit(BLOCK))
        x = rows.join(F.broadcast(sizes), "_cell")  # one row per pivot
        x = x.withColumn("_blk", F.pmod(F.xxhash64(key), n))
        return x.groupBy("_cell", "_blk").agg(F.collect_list(F.struct(key, v)).alias("_s")).select(
            "_cell", F.col(f"_s.{key}").alias(names[0]), F.col(f"_s.{v}").alias(names[1]))

    bb = blocks(cells.select("_cell", "_b", "_bv"), "_b", "_bv", radius.select("_cell", "_size"), ("_bs", "_bvs"))
    visits = d.groupBy("_cell").agg(F.count(F.lit(1)).alias("_size"))
    qb = blocks(d, "_q", "_qv", visits, ("_qs", "_qvs"))
    schema = f"_q {dict(q.dtypes)['_q']}, _b {dict(b.dtypes)['_b']}, distance double"
    j = qb.join(bb, "_cell").drop("_cell").mapInArrow(_block_search(k, exclude_same), schema)
    rk = W.partitionBy("_q").orderBy("distance", "_b")
    out = j.withColumn("rank", F.row_number().over(rk)).filter(F.col("rank") <= k)
    names = (qkey, bkey) if qkey != bkey else (qkey, f"{bkey}_near")
    return out.select(F.col("_q").alias(names[0]), F.col("_b").alias(names[1]), "distance", "rank")
