"""Means that lie on a rounding border or a threshold don't hang on the order of the rows."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd

from __spark_entry__ import queries

PARTS, ROWS = 300, 32


def written(rows, folder, order):
    folder.mkdir()
    rows.iloc[order].to_parquet(folder / "lineitem.parquet", index=False)
    return str(folder)


def test_rank_shift(spark, tmp_path):
    g = np.random.default_rng(5)
    cents = g.integers(9_000_000, 9_000_400, (PARTS, ROWS))
    cents[:, 0] += (16 - cents.sum(axis=1)) % 32  # sums of 16 cents beyond a multiple of 32: means end in 005
    rows = pd.DataFrame({"l_partkey": np.repeat(np.arange(PARTS), ROWS), "l_extendedprice": cents.ravel() / 100.0})
    cents[:, 1] += g.integers(0, 40, PARTS) // 2  # ties at the fifth place and others beside them
    rows = pd.concat([rows.assign(l_linestatus="F"), rows.assign(l_linestatus="O", l_extendedprice=cents.ravel() / 100.0)])
    exact = lambda cents: (Decimal(int(cents)) / 100 / ROWS).quantize(Decimal("0.0001"), ROUND_HALF_UP)
    sums = (rows.l_extendedprice * 100).round().astype(int).groupby([rows.l_linestatus, rows.l_partkey]).sum()
    want = {s: sorted(range(PARTS), key=lambda p: (-exact(sums[s, p]), p)) for s in "FO"}
    for i in range(2):
        got = queries()["A42_rank_shift"](spark, written(rows, tmp_path / str(i), g.permutation(len(rows)))).toPandas().set_index("l_partkey")
        assert got.sort_values("rank_a").index.tolist() == want["F"] and got.sort_values("rank_b").index.tolist() == want["O"]


def test_extreme_labels(spark, tmp_path):
    g = np.random.default_rng(6)
    half = g.integers(1, 9, (PARTS, 10))
    hundredths = g.permuted(np.hstack([half, 9 - half]), axis=1)  # mean 0.045: on the floor
    quantity = np.array([g.permutation([10, 34] * 10) for _ in range(PARTS)])
    rows = pd.DataFrame({"l_partkey": np.repeat(np.arange(PARTS), 20), "l_discount": hundredths.ravel() / 100.0, "l_quantity": quantity.ravel().astype(float)})
    for i in range(2):
        got = queries()["P1_extreme_labels"](spark, written(rows, tmp_path / str(i), g.permutation(len(rows)))).toPandas()
        assert len(got) == PARTS and set(got.category) == {"low"}
