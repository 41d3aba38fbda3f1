"""Tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; a local session without the setting gets a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.conf.get("spark.master", "local").startswith("local[") and spark.conf.get("spark.master", "local") != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", top)
    return os.path.join(top, f"{name}-{uuid.uuid4().hex}")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, name: str) -> DataFrame:
    """As ``keep``; the shuffle files behind the table go as soon as it is written.

    Else they stay until the driver happens to collect its garbage, and those of several
    steps add up on the disks.
    """
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return keep(df, name)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def named(df: DataFrame) -> list[str]:
    """The column names of a table, quoted."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def own(df: DataFrame, of: DataFrame | None = None) -> list[Column]:
    """Columns of ``df``, by default all of them, else those that ``of`` has."""
    return [df[c] for c in named(df if of is None else of)]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The given names, lengthened until no column of the table has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
