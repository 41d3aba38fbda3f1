"""Planted truths, negative controls and invariants."""

import pytest
from pyspark.sql import functions as F

from quorumstat.functions.core import normal, u01
from quorumstat.operators import labels, reliability, resample, sampling, slopes
from quorumstat.sources import scan, sinks


@pytest.fixture(scope="module")
def planted(spark):
    """60 items x 30 rows, ICC 0.3."""
    d = spark.range(1800).select(F.col("id").alias("key"), (F.col("id") % 60).alias("item"), F.floor(F.col("id") / 60).alias("unit"))
    return d.withColumn("x", normal("mu", "item") * 0.3 ** 0.5 + normal("e", "key") * 0.7 ** 0.5).cache()


def test_planted_icc_is_recovered(planted):
    icc = reliability.icc_oneway(planted, [], "item", "x").collect()[0]["icc"]
    assert abs(icc - 0.3) < 0.1


def test_permutation_detects_the_plant(planted):
    r = resample.icc_perm(planted, ["unit"], "item", "x", "key", 19, "p").collect()[0]
    assert r["p"] == pytest.approx(0.05) and abs(r["null_mean"]) < 0.03 and r["null_sd"] > 0


def test_no_effect_is_not_detected(planted):
    d = planted.withColumn("x", normal("none", "key"))
    assert resample.icc_perm(d, ["unit"], "item", "x", "key", 19, "p").collect()[0]["p"] > 0.05


def test_permutation_keeps_every_multiset(planted):
    p = resample.permute_within(planted, ["unit"], "key", ["x"], 2, "m")
    a = {(r["rep"], r["unit"]): r["s"] for r in p.groupBy("rep", "unit").agg(F.sort_array(F.collect_list("x")).alias("s")).collect()}
    b = {r["unit"]: r["s"] for r in planted.groupBy("unit").agg(F.sort_array(F.collect_list("x")).alias("s")).collect()}
    assert len(a) == 60 and all(v == b[u] for (_, u), v in a.items())


def test_signflip_is_symmetric(planted):
    f = lambda d: resample.signflip(d, [], "x", "key", 25, "sf").collect()[0]
    a, b = f(planted), f(planted.withColumn("x", -F.col("x")))
    assert a["p"] == b["p"] and a["mean"] == pytest.approx(-b["mean"])


def test_two_reliability_estimators_agree(planted):
    i = planted.groupBy("item").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"), F.count(F.lit(1)).alias("n"))
    a = reliability.reliability_analytic(i, [], "m", "sd", "n").collect()[0]["reliability"]
    b = reliability.split_half_items(planted, "item", "key", "x", 10, "two").collect()[0]["spearman_brown"]
    assert abs(a - b) < 0.08


@pytest.mark.parametrize("true,lo,hi", [(0.0, 0.0, 0.12), (0.5, 0.35, 0.65)])
def test_planted_slope_spread(spark, true, lo, hi):
    d = spark.range(6000).select(F.col("id").alias("key"), (F.col("id") % 100).alias("unit")).withColumn("x", normal("sx", "key"))
    d = d.withColumn("y", (F.lit(0.2) + true * normal("sb", "unit")) * F.col("x") + normal("se", "key"))
    t = slopes.tau_profile(slopes.slope_se(d, ["unit"], "x", "y"), []).collect()[0]
    assert lo <= t["tau"] <= hi and t["lo"] <= t["tau"] <= t["hi"]


def test_leak_gate(planted):
    d = planted.withColumn("leak", F.col("item") * 2.0)
    r = {x["feature"]: x["leak"] for x in labels.leak_columns(d, "item", ["x", "leak"]).collect()}
    assert r == {"x": False, "leak": True}


def test_one_to_one_join_refuses_repeats(planted):
    from quorumstat.operators.joins import join_1to1

    with pytest.raises(ValueError):
        join_1to1(planted, planted.select("item"), ["item"])


def test_sample_size_and_repeatability(planted):
    f = lambda: {(r["unit"], r["key"]) for r in sampling.sample_k(planted, ["unit"], "key", 5, "k").collect()}
    assert f() == f() and len(f()) == 150


def test_content_hash_ignores_order_and_sees_changes(planted):
    h = lambda d: sinks.content_hash(d, ["key", "item"]).collect()[0]["content_hash"]
    assert h(planted) == h(planted.repartition(5, "unit").orderBy(F.col("x")))
    assert h(planted) != h(planted.withColumn("item", F.when(F.col("key") == 3, 999).otherwise(F.col("item"))))


def test_cache_is_reused(spark, planted):
    a = sinks.cached(planted.select("key"), "reuse", "f1").count()
    assert sinks.cached(planted.select("key").limit(1), "reuse", "f1").count() == a


def test_optional_source(spark):
    from conftest import SF

    assert scan.try_load(spark, SF, "no_such_table") is None
    assert "quality" not in scan.load_joined(spark, SF, "documents", "no_such_table", "doc_id").columns


def test_uniform_draws(spark):
    r = spark.range(20000).agg(F.avg(u01("u", "id")).alias("m"), F.stddev_pop(u01("u", "id")).alias("s")).collect()[0]
    assert abs(r["m"] - 0.5) < 0.01 and abs(r["s"] - 12 ** -0.5) < 0.01


def test_work_dir_follows_the_session(spark):
    assert sinks.work_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_stream_equals_batch_over_two_triggers(spark, tmp_path):
    """Rows that arrive in two files give the state-carrying operator the same answer."""
    from pyspark.sql.window import Window as W

    from quorumstat.streaming import streams as sx

    d = spark.range(400).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), F.lit("a").alias("event_type"),
                                F.round(normal("st", "id"), 3).alias("value"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    p = str(tmp_path)
    d.filter("event_id < 200").coalesce(1).write.parquet(f"{p}/a")
    d.filter("event_id >= 200").coalesce(1).write.parquet(f"{p}/b")
    import glob
    import os
    import shutil

    os.makedirs(f"{p}/in")
    for i, f in enumerate(sorted(glob.glob(f"{p}/a/*.parquet")) + sorted(glob.glob(f"{p}/b/*.parquet"))):
        shutil.copy(f, f"{p}/in/events{i}.parquet")
        os.utime(f"{p}/in/events{i}.parquet", (1e9 + i, 1e9 + i))
    r = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{p}/in")
    got = sx.drain(sx.running_z(r, "user_id", "event_id", "ts", "value"), "two")
    w = W.partitionBy("user_id").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    want = d.withColumn("m", F.avg("value").over(w)).withColumn("s", F.stddev_samp("value").over(w)).select(
        "event_id", F.round((F.col("value") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0)), 6).alias("z"))
    a = {x["event_id"]: x["z"] for x in got.select("event_id", F.round("z", 6).alias("z")).collect()}
    b = {x["event_id"]: x["z"] for x in want.collect()}
    assert a == b


def test_running_z_of_shuffled_chunks_with_nulls(spark, tmp_path):
    from pyspark.sql.window import Window as W

    from quorumstat.functions.core import normal, u01
    from quorumstat.streaming import streams as sx

    d = spark.range(3000).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.lit("a").alias("event_type"),
                                 F.when(F.col("id") % 11 != 0, F.round(normal("sz", "id"), 3)).alias("value"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    d.orderBy(u01("mixed", "event_id")).coalesce(1).write.parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        r = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
        got = sx.drain(sx.running_z(r, "user_id", "event_id", "ts", "value"), "mixed").select("event_id", "n", F.round("z", 6).alias("z")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    w = W.partitionBy("user_id").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    z = (F.col("value") - F.avg("value").over(w)) / F.nullif(F.stddev_samp("value").over(w), F.lit(0.0))
    want = d.select("event_id", F.count("value").over(w).alias("n"), F.round(z, 6).alias("z")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_content_hash_tells_fields_apart(spark):
    from quorumstat.sources import sinks

    rows = [("a|b", "c"), ("a", "b|c"), ("NULL", None), (None, "NULL"), ("-", None), ("1:a", ""), ("", "1:a")]
    one = [sinks.fingerprint(spark.createDataFrame([r], "x string, y string")) for r in rows]
    assert len(set(one)) == len(rows)


def test_many_categories_are_kept(spark):
    from quorumstat.operators.labels import constituent_set

    n = 1100
    text = "mix_across_" + "_".join(f"c{i}" for i in range(n)) + "_" + "_".join(f"{i}-1" for i in range(n))
    got = spark.createDataFrame([(text,)], "x string").select(F.size(constituent_set("x")).alias("n")).first()
    assert got.n == n


def test_alignment_map_equals_the_formula():
    import numpy as np

    from quorumstat.operators.linear import coral_map

    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 4)) + 3, rng.normal(size=(60, 4)) - 1
    cov = lambda x: (x.mean(0), np.cov(x.T), len(x))
    for std in (False, True):
        for diag in (False, True):
            (w, o), (wt, ot) = coral_map(*cov(a), *cov(b)[:2], 4, 0.0, std, diag)
            moved, own = a @ w + o, b @ wt + ot
            assert np.allclose(moved.mean(0), own.mean(0))
            assert np.allclose(np.diag(np.cov(moved.T)), np.diag(np.cov(own.T))) and (diag or np.allclose(np.cov(moved.T), np.cov(own.T)))


def test_phases_of_a_long_series(spark):
    """A series above 65,536 samples keeps its whole spectrum."""
    import numpy as np

    from quorumstat.operators import resample

    n = 70_000
    d = spark.range(n).select(F.lit(1).alias("unit"), F.col("id").alias("idx"), (F.sin(F.col("id") / 300.0) + F.col("id") % 7).alias("x"), F.cos(F.col("id") / 90.0).alias("y"))
    r = resample.phase_null(d, "unit", "idx", "x", "y", 2, "long").first()
    assert r.p is not None and np.isfinite(r.null_mean) and abs(r.null_mean) < 0.2


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from quorumstat.sources import sinks

    conf = {"spark.master": "spark://host:7077"}
    with pytest.raises(ValueError, match="share"):
        sinks.work_dir(SimpleNamespace(conf=conf))


def test_spread_of_slopes_against_a_fine_grid(spark):
    import numpy as np

    from quorumstat.operators import slopes

    rng = np.random.default_rng(8)
    se = rng.uniform(0.1, 0.6, 60)
    b = 0.4 + rng.normal(size=60) * np.hypot(0.5, se)
    got = slopes.tau_profile(spark.createDataFrame([(float(x), float(y)) for x, y in zip(b, se, strict=True)], "b double, se double"), []).first()
    t = np.exp(np.linspace(np.log(1e-4), np.log(4.0), 40_000))
    w = 1 / (se**2 + t[:, None])
    mu = (w * b).sum(1) / w.sum(1)
    ll = 0.5 * np.log(w).sum(1) - 0.5 * (w * (b - mu[:, None]) ** 2).sum(1) - 0.5 * np.log(w.sum(1))
    best = np.sqrt(t[ll.argmax()])
    assert abs(got.tau / best - 1) < 1e-3
