"""Table scans: parquet, delimited text, many files, drifting and wide layouts."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, directory: str, name: str, cols: list[str] | None = None) -> DataFrame:
    """Parquet scan; ``cols`` reaches the reader as a pruned schema."""
    df = spark.read.parquet(os.path.join(directory, f"{name}.parquet"))
    return df.select(*cols) if cols else df


def read_table(spark: SparkSession, path: str, sep: str = ",", header: bool = True,
               names: list[str] | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """Delimited text with trimmed column names, or given names without a header.

    Without a schema every column stays a string, so no inference pass is read.
    """
    r = spark.read.option("sep", sep).option("header", header)
    r = r.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    if schema is not None:
        r = r.schema(schema)
    df = r.csv(path)
    if names:
        return df.toDF(*names)
    return df.toDF(*[c.strip() for c in df.columns])


def read_many(spark: SparkSession, glob: str, key_regex: str, key: str = "file_key", sep: str = ",",
              schema: T.StructType | str | None = None) -> DataFrame:
    """S3: many files in one scan; the key is taken from each file's path."""
    df = read_table(spark, glob, sep=sep, schema=schema)
    return df.withColumn(key, F.regexp_extract(F.input_file_name(), key_regex, 1))


def union_drift(dfs: list[DataFrame], renames: dict[str, str], keep: list[str]) -> DataFrame:
    """Union of tables whose column names drift; names compare in lower case."""
    def tidy(df):
        low = {c: renames.get(c.strip().lower(), c.strip().lower()) for c in df.columns}
        return df.withColumnsRenamed(low).select(*[c for c in keep if c in low.values()])

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [tidy(d) for d in dfs]).select(*keep)


def try_load(spark: SparkSession, directory: str, name: str) -> DataFrame | None:
    """A table, or None where it does not exist."""
    try:
        return load(spark, directory, name)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def load_joined(spark: SparkSession, directory: str, a: str, b: str, key: str, how: str = "inner") -> DataFrame:
    """Table ``a``, joined with table ``b`` only where ``b`` exists."""
    left, right = load(spark, directory, a), try_load(spark, directory, b)
    return left if right is None else left.join(right, key, how)


def to_long(df: DataFrame, ids: list[str], pattern: str, name: str = "name", value: str = "value",
            key_type: str = "int") -> DataFrame:
    """Columns matching ``pattern`` to rows; group 1 of the pattern is the key."""
    import re

    cols = [c for c in df.columns if c not in ids and re.search(pattern, c)]
    out = df.unpivot(ids, cols, "_name", value).filter(F.col(value).isNotNull())
    return out.select(*ids, F.regexp_extract("_name", pattern, 1).cast(key_type).alias(name), value)
