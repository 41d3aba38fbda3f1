"""Registry of queries and of their SQL twins."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import seconds
from ..sources.scan import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the tables of one directory: ``t.events``."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.dir = directory
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.dir, name)

    @property
    def ratings(self) -> DataFrame:
        """Events as ratings: unit user_id, items event_type and k, value, seconds."""
        return self.events.select(
            "event_id", "user_id", "event_type", "value",
            F.get_json_object("props", "$.k").cast("int").alias("k"), seconds("ts").alias("sec"))

    @property
    def orders_lines(self) -> DataFrame:
        """Orders with their line count and quantity: x per order, price as y."""
        li = self.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"))
        return self.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate").join(
            li, "o_orderkey").withColumns({"x": F.col("n_lines").cast("double"), "y": F.col("o_totalprice") / 1000.0})

    def path(self, name: str) -> str:
        return os.path.join(self.dir, f"{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under a name, with its SQL twin if there is one."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, directory: fn(Tables(spark, directory))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


# Table expressions of the twins, as WITH members.
EV = """ev as (select event_id, user_id, event_type, value,
 cast(regexp_extract(props, '([0-9]+)', 1) as int) as k, epoch_us(ts) / 1e6::double as sec from events)"""
OL = """ol as (select o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderdate, n_lines, qty,
 n_lines::double as x, o_totalprice / 1000.0::double as y
 from orders join (select l_orderkey as o_orderkey, count(*) as n_lines, sum(l_quantity) as qty
 from lineitem group by 1) using (o_orderkey))"""


# SQL text pieces used by the twins -----------------------------------------

def R(expr: str) -> str:
    return f"(round(({expr})::double + 3.3e-10::double, 6) + 0.0::double)"


def R4(expr: str) -> str:
    return f"(round(({expr})::double, 4) + 0.0::double)"


def U(seed, *keys: str) -> str:
    ks = ", ".join([f"'{seed}'", *[f"({k})::varchar" for k in keys]])
    return f"(('0x' || substr(md5(concat_ws('|', {ks})), 1, 8))::bigint / 4294967296::double)"


def NORMAL(seed, *keys: str) -> str:
    a, b = U(seed, *keys, "'a'"), U(seed, *keys, "'b'")
    return f"round(sqrt(-2.0::double * ln(1.0::double - {a})) * cos(2.0::double * pi() * {b}), 6)"


def CORR(x: str, y: str) -> str:
    return f"(covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0))"


def RANK(x: str, by: str = "") -> str:
    p = f"partition by {by} " if by else ""
    q = f"partition by {by}, {x}" if by else f"partition by {x}"
    return f"(rank() over ({p}order by {x}) + (count(*) over ({q}) - 1) / 2.0::double)"


def SEC(ts: str) -> str:
    return f"(epoch_us({ts}) / 1e6::double)"


def REPS(n: int) -> str:
    return f"(select unnest(range({n})) as rep)"
