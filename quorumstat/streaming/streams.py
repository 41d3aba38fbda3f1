"""Streams over sensor tables (T1-T4); each equals its batch twin on the same rows.

Sinks are parquet with a checkpoint in the shared work folder, so a restarted query
continues where it stopped and every row is written once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.sinks import scratch


def read_stream(spark: SparkSession, directory: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table directory as a file stream with the table's schema."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(directory)


def event_stream(spark: SparkSession, directory: str, delay: str = "1 hour") -> DataFrame:
    d = read_stream(spark, directory, "events").select(
        "event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    return d.withWatermark("ts", delay)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run to the end of the available input, then read the sink back."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", out)
         .option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def dropout_sessions(stream: DataFrame, unit: str, ts: str, gap: str) -> DataFrame:
    """Recording stretches between dropouts; a stretch is written once it is closed."""
    return stream.groupBy(unit, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        unit, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def window_measures(stream: DataFrame, by: list[str], ts: str, x: str, size: str, slide: str | None = None) -> DataFrame:
    """Measures per tumbling or sliding window, written once the window is closed."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.groupBy(*by, w.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max")).select(
        *by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "min", "max")


def trial_windows(events: DataFrame, samples: DataFrame, unit: str, onset: str, ts: str, before: str, after: str) -> DataFrame:
    """Samples in [onset - before, onset + after) as a stream-stream join; both
    watermarks bound the state, and samples later than them are dropped."""
    on = (events[unit] == samples[f"s_{unit}"]) & (samples[ts] >= events[onset] - F.expr(f"INTERVAL {before}")) & (
        samples[ts] < events[onset] + F.expr(f"INTERVAL {after}"))
    return events.join(samples, on, "inner").drop(f"s_{unit}")


def running_z(stream: DataFrame, unit: str, key: str, ts: str, x: str) -> DataFrame:
    """T4: z of each value against the unit's earlier and current values.

    State per unit is three numbers (n, mean, M2). All rows that a unit has in a batch are
    sorted by time before they are folded, however many chunks they come in; batches follow
    each other as they arrive. A NULL or NaN value has no z and leaves the state as it is.
    """
    d = stream.select(unit, key, ts, x)
    types = {f.name: f.dataType for f in d.schema.fields}
    out = T.StructType([T.StructField(c, types[c]) for c in (unit, key, ts, x)] + [T.StructField("n", T.LongType()), T.StructField("z", T.DoubleType())])
    state = T.StructType([T.StructField("n", T.LongType()), T.StructField("mean", T.DoubleType()), T.StructField("m2", T.DoubleType())])

    def update(key_: tuple, chunks: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2 = st.get if st.exists else (0, 0.0, 0.0)
        batch = pd.concat(list(chunks)).sort_values([ts, key])
        given = batch[x].to_numpy(float)
        known = ~np.isnan(given)
        v = given[known]
        k = n + np.arange(1, len(v) + 1)
        total = mean * n + v.cumsum()
        means = total / k
        prev = (total - v) / (k - 1).clip(min=1)
        m2s = m2 + ((v - prev) * (v - means)).cumsum()
        sd = np.sqrt(m2s / (k - 1).clip(min=1))
        ok = (k > 1) & (sd > 0)
        z = np.full(len(given), np.nan)
        z[known] = np.where(ok, (v - means) / np.where(ok, sd, 1.0), np.nan)
        yield pd.DataFrame({unit: batch[unit].to_numpy(), key: batch[key].to_numpy(), ts: batch[ts].to_numpy(), x: given, "n": n + known.cumsum(),
                            "z": pd.Series(z, dtype=object).where(~np.isnan(z), None).to_numpy()})
        if len(v):
            st.update((int(k[-1]), float(means[-1]), float(m2s[-1])))

    return d.groupBy(unit).applyInPandasWithState(update, out, state, "append", GroupStateTimeout.NoTimeout)
