"""Result tables, fingerprinted caches and run records."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import with_row


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A session on one machine without the setting gets a temporary folder; on a cluster its
    absence is an error, as executors would each write to a disk of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(work_dir(spark), f"{name}-{uuid.uuid4().hex}")


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    """One tidy table per result, as csv, json or parquet."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends here."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cached(df: DataFrame, name: str, fingerprint: str) -> DataFrame:
    """Table kept under (name, fingerprint) and reused on the next call."""
    spark = df.sparkSession
    path = os.path.join(work_dir(spark), "cache", f"{name}-{fingerprint}")
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def content_hash(df: DataFrame, cols: list[str] | None = None, by: list[str] | None = None,
                 out: str = "content_hash") -> DataFrame:
    """order-free content hash of the rows, as sums of md5 lanes.

    Sums combine map-side, so no task ever holds the sorted rows.
    """
    by = by or []
    text = [F.col(c).cast("string") for c in (cols or df.columns)]
    # Each field with its length, so neither a separator inside a text nor a NULL can be mistaken.
    row = F.md5(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]))
    lane = [F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(4)]
    s = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"),
                            *[F.sum(v).cast("decimal(38,0)").alias(f"_{i}") for i, v in enumerate(lane)])
    parts = [F.col("n_rows").cast("string"), *[F.col(f"_{i}").cast("string") for i in range(4)]]
    return s.select(*by, "n_rows", F.sha2(F.concat_ws("|", *parts), 256).alias(out))


def fingerprint(df: DataFrame, cols: list[str] | None = None) -> str:
    """Content hash of all rows as text, for the cache; one row reaches the driver."""
    return content_hash(df, cols).first()["content_hash"]


def run_record(df: DataFrame, name: str, seed: int, params: dict, metrics: DataFrame) -> DataFrame:
    """One row with parameters, seed, metrics and the hash of the input rows."""
    kv = F.map_from_arrays(F.array(*[F.lit(c) for c in metrics.columns]),
                           F.array(*[F.col(c).cast("double") for c in metrics.columns]))
    ps = F.create_map(*[F.lit(str(x)) for p in sorted(params.items()) for x in p])
    return with_row(content_hash(df), metrics.select(kv.alias("metrics"))).select(
        F.lit(name).alias("name"), F.lit(seed).alias("seed"), ps.alias("params"), "metrics",
        F.struct(F.col("n_rows").alias("n_rows"), F.col("content_hash").alias("sha256")).alias("input"))


def latest(runs: DataFrame, name: str, stamp: str, suffix: str) -> DataFrame:
    """Newest run whose name ends with the suffix."""
    return runs.filter(F.col(name).endswith(suffix)).agg(
        F.max_by(name, F.struct(stamp, name)).alias(name), F.max(stamp).alias(stamp))


def flatten_metrics(df: DataFrame, json_col: str) -> DataFrame:
    """``{"algo|src->dst": {"rho": .., "n": ..}}`` to tidy rows."""
    m = F.from_json(json_col, "map<string,struct<rho:double,n:bigint>>")
    e = df.select(F.explode(m).alias("k", "v"))
    pair = F.split_part("k", F.lit("|"), F.lit(2))
    return e.select(
        F.split_part("k", F.lit("|"), F.lit(1)).alias("algorithm"),
        F.split_part(pair, F.lit("->"), F.lit(1)).alias("source"),
        F.split_part(pair, F.lit("->"), F.lit(2)).alias("target"),
        F.col("v.rho").alias("rho"), F.col("v.n").alias("n"))


def inventory(tables: dict[str, tuple[DataFrame, str, str, object]], sample: int, seed) -> DataFrame:
    """Per corpus rows, units and the total of a size column extrapolated from a
    keyed sample (mean of the sample times the row count)."""
    from pyspark.sql.window import Window as W

    from ..functions.core import u01

    parts = [d.select(F.lit(n).alias("corpus"), F.col(k).cast("string").alias("key"),
                      F.col(u).cast("string").alias("unit"), F.lit(0.0) + size)
             .toDF("corpus", "key", "unit", "size") for n, (d, k, u, size) in tables.items()]
    d = reduce_union(parts)
    full = d.groupBy("corpus").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("unit").alias("n_units"))
    w = W.partitionBy("corpus").orderBy("_u", "key")  # rank limit is applied before the shuffle
    s = d.withColumn("_u", u01(seed, "key")).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= sample)
    m = s.groupBy("corpus").agg(F.avg("size").alias("sample_mean"), F.count(F.lit(1)).alias("n_sampled"))
    return full.join(m, "corpus").withColumn("estimated_total", F.col("sample_mean") * F.col("n_rows"))


def reduce_union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
