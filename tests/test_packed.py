"""Groups worked on whole behind one shuffle: the same rows as in slices, and how many rows are exchanged."""

import pytest
from pyspark.sql import functions as F

from quorumstat.functions.core import normal, u01
from quorumstat.operators import linear, ordered, packed, peaks, prominence, resample, stats


def exchanged(spark, make):
    """Rows of the result, and the records that its stages wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        s = store.stageList(None, False, False, none, None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (s.apply(i) for i in range(s.size()))}

    def settled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return stages()

    before = settled()
    rows = make().collect()
    return rows, sum(n for k, n in settled().items() if k not in before)


@pytest.fixture()
def batches(spark):
    """Arrow batches of 7 rows, so that groups go over several."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def units(spark):
    d = spark.range(1200).select(
        F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20 + 1).cast("int").alias("unit"),
        F.array(*[F.round(normal("v", "id", F.lit(i)), 4) for i in range(3)]).alias("v"))
    d = d.withColumn("y", F.when(F.col("key") % 31 != 0, F.round(F.get("v", F.lit(0)) + normal("n", "key"), 2)))
    return d.withColumn("v", F.when(F.col("key") % 37 != 0, F.col("v"))).localCheckpoint()


def test_spearman_whole_and_sliced(spark, batches, sliced):
    d = spark.range(700).select(
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("u"), (F.col("id") % 5).cast("string"))).alias("unit"), (F.col("id") % 2).cast("int").alias("half"),
        F.when(F.col("id") % 13 != 0, F.floor(u01("x", "id") * 9)).alias("x"),
        F.when(F.col("id") % 17 == 0, F.lit(float("nan"))).otherwise(F.round(normal("y", "id"), 1)).alias("y"))
    d = d.unionByName(spark.sql("select 'flat' as unit, 0 as half, 1L as x, double(id) as y from range(9)"))
    got = packed.spearman(d, ["unit", "half"], "x", "y", "rho", "n").collect()
    want = stats.spearman(d.withColumn("x", F.col("x").cast("decimal(9,0)")), ["unit", "half"], "x", "y", small=False).collect()
    show = lambda rows: sorted(((r["unit"] or "", r["half"], r["n"], r["rho"]) for r in rows), key=repr)
    assert len(got) == 13 and show(got) == show(want)


def test_decode_units_exchange_rows_once(spark, batches):
    d = units(spark)
    rows, n = exchanged(spark, lambda: linear.decode_units(d, "unit", "key", "v", 3, "y", 4, 2, 9, "m28"))
    assert n < 2 * 1200  # ten copies of every row and a matrix for every row before
    spark.conf.set("quorumstat.chunkRows", "60")
    try:
        sliced = linear.decode_units(d, "unit", "key", "v", 3, "y", 4, 2, 9, "m28").collect()
    finally:
        spark.conf.unset("quorumstat.chunkRows")
    show = lambda rs: sorted((r["unit"], r["n"], r["rho"], round(r["null_mean"], 9), r["p"]) for r in rs)
    assert len(rows) == 21 and show(rows) == show(sliced)


def series(spark, gaps):
    """1,200 samples of 21 units, with missing values; numbered without or with gaps and repeats."""
    d = units(spark).select("unit", "key", "y").withColumn("idx", F.expr("row_number() over (partition by unit order by key) - 1L"))
    if gaps:
        d = d.withColumn("idx", F.when(F.col("key") % 29 != 0, F.col("idx") + F.floor(F.col("idx") / 7) - F.when(F.col("key") % 23 == 0, 1).otherwise(0)))
    return d.withColumn("x", F.when(F.col("key") % 19 != 0, F.floor(u01("x", "key") * 40))).select("unit", "idx", "x", "y").localCheckpoint()


def both_ways(spark, make):
    whole, n = exchanged(spark, make)
    spark.conf.set("quorumstat.chunkRows", "60")
    try:
        sliced = make().collect()
    finally:
        spark.conf.unset("quorumstat.chunkRows")
    show = lambda rows: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    assert whole and show(whole) == show(sliced)
    return n


@pytest.mark.parametrize("gaps", [False, True])
def test_circular_shift_exchanges_rows_once(spark, batches, gaps):
    d = series(spark, gaps)
    n = both_ways(spark, lambda: resample.circular_shift(d, ["unit"], "idx", "x", "y", 12, "i11", 3).select("unit", "obs", "null_p95", "n_null"))
    assert n < 2 * 1200  # twelve copies before


@pytest.mark.parametrize("gaps", [False, True])
def test_mismatch_null_exchanges_lists(spark, batches, gaps):
    d = series(spark, gaps).withColumn("owner", F.col("unit") % 2)
    for pool in ("all", "own"):
        n = both_ways(spark, lambda pool=pool: resample.mismatch_null(d, "unit", "idx", "x", "y", 30, "i12", pool, "owner"))
        assert n < 6 * 1200  # every pair of rows before


def test_phase_null_exchanges_rows_few_times(spark, batches):
    d = series(spark, False).withColumn("x", F.coalesce("x", F.lit(3)).cast("double"))
    n = both_ways(spark, lambda: resample.phase_null(d, "unit", "idx", "x", "y", 12, "i13"))
    assert n < 6 * 1200  # twelve copies, there and back, before


def test_dose_response_exchanges_rows_once(spark):
    d = units(spark).select((F.col("key") % 3).alias("flag"), "unit", F.col("key").cast("double").alias("dose"), "y").localCheckpoint()
    rows, n = exchanged(spark, lambda: stats.spearman(d, ["flag", "unit"], "dose", "y"))
    assert len(rows) == 41 and n < 1.6 * 1200  # counted pairs and ranks took two exchanges before


def test_peaks_exchange_rows_once(spark, batches):
    d = series(spark, False).withColumn("x", F.when(F.col("idx") % 41 != 0, F.round(F.col("y") * 10))).localCheckpoint()
    n = both_ways(spark, lambda: peaks.find_peaks(d, ["unit"], "idx", "x", -5.0, 3))
    assert n < 1.5 * 1200  # runs, their neighbours and blocks before
    n = both_ways(spark, lambda: prominence.prominent_peaks(d, ["unit"], "idx", "x", 4.0, None, 2))
    assert n < 1.5 * 1200


def test_tasks_grow_with_the_rows(spark):
    d = units(spark).select("unit", F.col("key").cast("double").alias("dose"), "y").localCheckpoint()
    spark.conf.set("quorumstat.chunkRows", "600")
    try:
        assert ordered.sizes(d, ["unit"]) == (True, 8) and ordered.sizes(d.unionByName(d), ["unit"]) == (False, 8)
        many = d.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("unit", F.col("unit") + F.col("_k") * 100)
        assert ordered.sizes(many, ["unit"]) == (True, 32)  # 9,600 rows, 300 each
        got = stats.spearman(many, ["unit"], "dose", "y")
        assert got.rdd.getNumPartitions() == 32 and got.count() == 21 * 8
    finally:
        spark.conf.unset("quorumstat.chunkRows")
