"""Groups above the slice size give the same answers as plain windows."""

import pytest
from pyspark.sql import functions as F

from quorumstat.operators import joins, ordered, reliability, resample, stats, timeline
from quorumstat.operators.neighbours import knn


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def both(spark, make):
    """The same plan builder with and without slicing."""
    spark.conf.set("quorumstat.chunkRows", "60")
    a = rows(make())
    spark.conf.set("quorumstat.chunkRows", "1000000")
    b = rows(make())
    spark.conf.unset("quorumstat.chunkRows")
    return a, b


CASES = {
    "row": lambda d: ordered.row_numbers(d, ["unit"], ["ts", "key"], F.col("ts")),
    "row_all": lambda d: ordered.row_numbers(d, [], ["ts", "key"], F.col("ts")),
    "lag": lambda d: ordered.scan(d, ["unit"], ["ts", "key"], F.col("ts"), {"p": ("lag", "value")}),
    "lead": lambda d: ordered.scan(d, ["unit"], ["ts", "key"], F.col("ts"), {"p": ("lag", "value")}, reverse=True),
    "last": lambda d: ordered.scan(d.withColumn("v", F.when(F.col("key") % 7 == 0, F.col("x"))), ["unit"], ["ts", "key"], F.col("ts"), {"p": ("last", "v")}),
    "next": lambda d: ordered.scan(d.withColumn("v", F.when(F.col("key") % 7 == 0, F.col("x"))), ["unit"], ["ts", "key"], F.col("ts"), {"p": ("last", "v")}, reverse=True),
    "sum_min_max": lambda d: ordered.scan(d, ["unit"], ["ts", "key"], F.col("ts"), {"s": ("sum", "value"), "a": ("min", "value"), "b": ("max", "value")}),
    "ranks": lambda d: ordered.avg_ranks(d, ["unit"], {"r": "value", "q": "x"}),
    "ranks_all": lambda d: ordered.avg_ranks(d, [], {"r": "value"}),
    "quantiles": lambda d: ordered.quantiles(d, ["unit"], "x", {"a": 0.1, "b": 0.5, "c": 0.9}).select("unit", *[F.round(c, 9) for c in "abc"]),
    "quantiles_all": lambda d: ordered.quantiles(d, [], "value", {"a": 0.25, "b": 0.5}).select(F.round("a", 9), F.round("b", 9)),
    "spearman": lambda d: stats.spearman(d, ["unit"], "value", "x").select("unit", F.round("rho", 8), "n"),
    "keyed": lambda d: reliability.split_items(d.select("unit", "key", "x"), "unit", "key", 2, "s"),
    "permute": lambda d: resample.permute_within(d.select("unit", "key", "x"), ["unit"], "key", ["x"], 2, "s"),
    "bh": lambda d: resample.bh(d.select("unit", "key", F.abs(F.sin("key")).alias("p")), ["unit"], "p", "key").select("key", F.round("q", 9)),
    "bh_mask": lambda d: resample.bh(d.select("key", F.pow(F.abs(F.sin("key")), 4.0).alias("p")), [], "p", "key", "mask", 0.5).select("key", "significant"),
    "wilcoxon": lambda d: resample.wilcoxon(d, ["unit"], "x").select("unit", "n", F.round("w_plus", 6), F.round("z", 8)),
    "gaps": lambda d: timeline.gaps(d, ["unit"], "ts", ["ts", "key"], 500.0),
    "resample": lambda d: timeline.resample_linear(d, ["unit"], "ts", "x", 400.0).select("unit", "ts", F.round("x", 9)),
    "asof": lambda d: joins.asof_backward(
        d.filter("key % 2 = 0").select("unit", "key", "ts"), d.filter("key % 5 = 1").select("unit", F.col("key").alias("k2"), "ts"), ["unit"], "ts", ["key"], ["k2"]),
    "nearest": lambda d: joins.nearest_within(
        d.filter("key % 2 = 0").select("unit", "key", "ts"), d.filter("key % 5 = 1").select("unit", F.col("key").alias("k2"), "ts"), ["unit"], "ts", ["key"], ["k2"], 300.0),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_same_result(spark, skewed, name):
    a, b = both(spark, lambda: CASES[name](skewed))
    assert a == b and len(a) > 0


def test_hot_unit_is_cut(sliced, skewed):
    every, only = ordered.slice_groups(skewed, ["unit"], F.col("ts"))
    sizes = {(r["unit"], r["_c"]): r["n"] for r in every.groupBy("unit", "_c").agg(F.count(F.lit(1)).alias("n")).collect()}
    hot = [n for (u, _), n in sizes.items() if u == 0]
    assert sum(hot) == 1000 and max(hot) < 150
    assert only.count() == sum(n for (u, c), n in sizes.items() if c is not None)


def test_slices_keep_the_order(sliced, skewed):
    every, _ = ordered.slice_groups(skewed.filter("unit = 0"), ["unit"], F.col("ts"))
    s = every.groupBy("_c").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).orderBy("_c").collect()
    assert all(a["hi"] <= b["lo"] for a, b in zip(s, s[1:]))


def test_knn_is_exact_with_a_crowded_cell(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 0.01, (150, 6)), rng.normal(0, 1, (250, 6))])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = {(r["id"], r["rank"]): r["id_near"] for r in knn(d, d, "id", "id", "v", 3, exclude_same=True).collect()}
    dist = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    np.fill_diagonal(dist, np.inf)
    want = np.argsort(dist, axis=1, kind="stable")[:, :3]
    assert got == {(i, k + 1): int(want[i, k]) for i in range(len(x)) for k in range(3)}


@pytest.fixture(scope="module")
def hard(skewed):
    """A NULL group, one time stamp far off, a NaN and NULL values."""
    d = skewed.withColumn("unit", F.when(F.col("unit") != 3, F.col("unit")))
    d = d.withColumn("ts", F.when(F.col("key") == 30, F.lit(1e15)).otherwise(F.col("ts")))
    return d.withColumn("value", F.when(F.col("key") % 13 != 0, F.col("value"))).withColumn("unit", F.when(F.col("key") % 5 != 1, F.col("unit"))).cache()


@pytest.mark.parametrize("name", ["row", "lag", "lead", "last", "next", "sum_min_max", "ranks", "quantiles", "spearman"])
def test_sliced_equals_plain_on_hard_rows(spark, hard, name):
    a, b = both(spark, lambda: CASES[name](hard))
    assert a == b


def test_one_far_position_leaves_no_large_slice(sliced, hard):
    every, _ = ordered.slice_groups(hard, ["unit"], "ts")
    assert every.filter("unit = 0").groupBy("_c").count().agg(F.max("count")).first()[0] < 200
