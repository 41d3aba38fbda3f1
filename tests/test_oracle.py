"""Every registered query against its SQL twin, or a run without one."""

import pytest
from check import TABLES, compare
from conftest import SF

from __spark_entry__ import entry, oracle_sql, queries

Q, O = queries(), oracle_sql()


@pytest.fixture(scope="session")
def con():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(O))
def test_equals_sql(spark, con, name):
    msg = compare(name, Q[name](spark, SF), con, O[name])
    assert msg is None or msg.startswith(("EMPTY", "ALLNULL")), msg


@pytest.mark.parametrize("name", sorted(set(Q) - set(O)))
def test_runs(spark, name):
    assert Q[name](spark, SF).collect() is not None


def test_entry(spark):
    assert entry(spark).count() == 1


def test_every_twin_has_a_query():
    assert set(O) <= set(Q)


def test_the_comparison_can_fail(spark, con):
    from pyspark.sql import functions as F

    name = "A3_mean_std"
    wrong = Q[name](spark, SF).withColumn("p_mean", F.col("p_mean") + 1e-6)
    assert compare(name, wrong, con, O[name]) is not None
