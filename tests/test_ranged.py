"""Rank correlations of large groups: the same as on plain rows, with ties, weights and missing values."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_packed import exchanged

from quorumstat.functions.core import normal, u01
from quorumstat.operators import ranged, resample, transfer


def table(spark):
    d = spark.range(2500).select(F.col("id").alias("key"), F.when(F.col("id") % 7 != 0, (F.col("id") % 3).cast("int")).alias("unit"),
                                 F.round(normal("v", "id"), 2).alias("many"), F.floor(u01("f", "id") * 6).alias("few"))
    d = d.withColumns({"many": F.when(F.col("key") % 2 == 0, F.lit(0.0)).when(F.col("key") % 31 == 0, F.lit(float("nan"))).otherwise(F.col("many")),
                       "y": F.when(F.col("key") % 17 != 0, F.round(F.col("few") + normal("y", "key"), 3)),
                       "w": F.array(*[F.floor(u01("w", F.lit(i), "key") * 3).cast("int") for i in range(4)])})
    return d.withColumn("few", F.when(F.col("key") % 13 != 0, F.col("few"))).localCheckpoint()


def plain(d, by, x, y, i):
    """Copies of the rows, ranked and correlated by pandas."""
    p = d.toPandas()
    p = p[p[x].notna() | (p[x].apply(lambda v: v is not None) & (x == "many"))]
    p = p[p[y].notna()] if y != "many" else p
    p = p.loc[p.index.repeat(p["w"].apply(lambda w: w[i]))]
    p["_g"] = p["unit"].fillna(-1) if by else 0
    high = lambda s: s.fillna(99.0).rank()  # noqa: E731  NaN is the highest value
    return {g: (len(q), round(high(q[x]).corr(high(q[y])), 8)) for g, q in p.groupby("_g")}


@pytest.mark.parametrize("by,xs,y", [([], ["few"], "y"), (["unit"], ["few"], "y"), (["unit"], ["few", "many"], "y"), (["unit"], ["y"], "few"), ([], ["y"], "many")])
@pytest.mark.parametrize("rows", ["60", "4000"])
def test_weights_are_copies(spark, monkeypatch, by, xs, y, rows):
    d = table(spark)
    monkeypatch.setattr(ranged, "BATCH", 400)
    spark.conf.set("quorumstat.chunkRows", rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = ranged.spearman(d.filter(F.col("few").isNotNull()) if y == "few" else d, by, {x: x for x in xs}, y, "w", 4).collect()
    finally:
        spark.conf.unset("quorumstat.chunkRows")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for x in xs:
        for i in range(4):
            want = plain(d.filter(F.col("few").isNotNull()) if y == "few" else d, by, x, y, i)
            assert {(-1 if r["unit"] is None else r["unit"]) if by else 0: round(r[x], 8) for r in got if r["rep"] == i} == {g: v[1] for g, v in want.items()}


def test_constant_side_is_null(spark, sliced):
    d = spark.range(700).select(F.lit(1.5).alias("x"), F.col("id").cast("double").alias("y"), (F.col("id") % 2).cast("int").alias("g"))
    assert [r["rho"] for r in ranged.spearman(d, ["g"], {"rho": "x"}, "y").collect()] == [None, None]
    assert [r["rho"] for r in ranged.spearman(d, [], {"rho": "y"}, "x").collect()] == [None]


def test_draws_are_counted(spark, sliced):
    s, tot = resample.number(spark.range(500).withColumnRenamed("id", "key"), "key")
    got = {(r["key"], i): k for r in ranged.draw_counts(s, 500, 6, "s").collect() for i, k in enumerate(r["_w"]) if k}
    want = resample.draws(s, tot, 6, "s").join(s, "_slot").groupBy("key", "rep").count().collect()
    assert got == {(r["key"], r["rep"]): r["count"] for r in want} and sum(got.values()) == 3000


def test_replicates_are_not_exchanged(spark, sliced):
    d = table(spark).filter("y is not null and few is not null and not isnan(many)").withColumn("axis", (F.col("key") % 4).cast("int")).withColumn("wide", F.col("few") + F.col("many") / 10)
    d = d.withColumn("few", F.col("few").cast("double")).localCheckpoint()
    rows, n = exchanged(spark, lambda: resample.boot_spearman(d, "few", "y", "key", 30, "i8"))
    assert n < 30 * d.count()  # every drawn row, several times, before
    rows, n = exchanged(spark, lambda: resample.boot_gain(d, "axis", "key", "y", "few", "wide", 0, 30, "i10")[0])
    assert len(rows) == 4 and n < 60 * d.count()
    rows, n = exchanged(spark, lambda: transfer.representation_gain(d, "axis", "unit", "y", "few", "wide"))
    assert len(rows) == 4 and n < 8 * d.count()
