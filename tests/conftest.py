import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from check import session

    s = session()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def sliced(spark):
    """Slices of 60 rows, so that small fixtures take the path of huge groups."""
    spark.conf.set("quorumstat.chunkRows", "60")
    yield spark
    spark.conf.unset("quorumstat.chunkRows")


@pytest.fixture(scope="session")
def skewed(spark):
    """3,000 rows; unit 0 holds a third of them; values repeat; both sides of the key vary."""
    from pyspark.sql import functions as F

    from quorumstat.functions.core import normal, u01

    d = spark.range(3000).select(
        F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40 + 1).cast("int").alias("unit"),
        F.floor(u01("v", "id") * 25).alias("value"), F.round(normal("x", "id"), 3).alias("x"), (u01("t", "id") * 1e5).alias("ts"))
    d = d.withColumn("y", F.round(F.col("x") * 0.4 + normal("y", "key"), 3))
    return d.cache()
