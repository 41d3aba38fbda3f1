"""Stratified group folds: whole groups, class shares near the sequential rule's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumstat.operators import transfer


def table(spark, n_groups, seed=1, hot=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n_groups):
        size = hot if g == 0 and hot else int(rng.integers(1, 9)) if g % 50 else int(rng.integers(60, 200))
        bias = rng.dirichlet([0.6, 0.6, 0.6])
        rows += [(g, "abc"[rng.choice(3, p=bias)]) for _ in range(size)]
    rows += [(None, "a"), (None, None), (7, None)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "key int, grp int, label string")


def sequential(cells, k):
    """Every group in turn, largest first, to the fold whose shares it evens out most."""
    total = np.maximum(sum(cells.values()), 1)
    load = np.zeros((k, len(total)))
    for _, v in sorted(cells.items(), key=lambda x: -x[1].sum()):
        f = min(range(k), key=lambda f: ((load[f] * v / total**2).sum(), load[f].sum()))
        load[f] += v
    return load


@pytest.mark.parametrize("n_groups, hot", [(40, 0), (900, 0), (300, 3000)])
def test_groups_stay_whole_and_shares_are_even(spark, n_groups, hot):
    k, d = 5, table(spark, n_groups, hot=hot).cache()
    got = transfer.folds(d, "stratified", k, "key", "label", "s", "grp")
    assert got.count() == d.count() and got.columns == [*d.columns, "fold"]
    rows = got.collect()
    of = {}
    cells = {}
    names = [None, "a", "b", "c"]
    for r in rows:
        assert of.setdefault(r.grp, r.fold) == r.fold and 0 <= r.fold < k
        cells.setdefault(r.grp, np.zeros(4))[names.index(r.label)] += 1
    load = np.zeros((k, 4))
    for r in rows:
        load[r.fold, names.index(r.label)] += 1
    want = sequential(cells, k)
    largest = max(v.max() for v in cells.values())
    spread = lambda x: x.max(axis=0) - x.min(axis=0)
    assert (spread(load) <= spread(want) + largest).all()


def test_equal_groups_are_dealt_evenly(spark):
    d = spark.range(4000).select("id", (F.col("id") % 1000).alias("g"), F.when(F.col("id") % 2000 < 1000, "x").otherwise("y").alias("l"))
    n = transfer.folds(d, "stratified", 8, "id", "l", "s", "g").groupBy("fold", "l").count().collect()
    assert len(n) == 16 and {r["count"] for r in n} == {250}


def test_slices_give_the_same_folds(spark):
    d = table(spark, 900).cache()
    a = sorted(map(str, transfer.stratified_group_folds(d, "grp", "label", 3, "s").collect()))
    spark.conf.set("quorumstat.chunkRows", "60")
    b = sorted(map(str, transfer.stratified_group_folds(d, "grp", "label", 3, "s").collect()))
    spark.conf.unset("quorumstat.chunkRows")
    assert a == b and len(a) == 901


def test_no_rows(spark):
    assert transfer.folds(table(spark, 3).limit(0), "stratified", 3, "key", "label", "s", "grp").count() == 0
    with pytest.raises(ValueError, match="group"):
        transfer.folds(table(spark, 3), "shuffled", 3, "key", group="grp")
