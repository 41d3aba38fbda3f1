"""Event-locked measures: trial features, epochs, anchors, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.core import div, with_row
from .joins import drop_overlapping, window_join
from .ordered import quantiles


def free_of_gaps(trials: DataFrame, gap_table: DataFrame, by: list[str], key: str, onset: str,
                 windows: list[tuple[float, float]]) -> DataFrame:
    """Trials none of whose windows overlaps a gap."""
    out = trials
    for a, b in windows:
        out = drop_overlapping(out, gap_table, by, key, onset, a, b)
    return out


def trial_features(trials: DataFrame, samples: DataFrame, gap_table: DataFrame | None, by: list[str], key: str,
                   onset: str, ts: str, x: str, base: tuple[float, float], resp: tuple[float, float],
                   min_n: int = 1, min_shape: int = 2) -> DataFrame:
    """Baseline mean, response minus baseline, and peak to trough of the response
    after removing its end-to-end line.

    All measures are NULL where a window overlaps a gap or holds fewer than ``min_n``
    samples; the shape needs ``min_shape`` samples.
    """
    good = trials if gap_table is None else free_of_gaps(trials, gap_table, by, key, onset, [base, resp])
    lo, hi = min(base[0], resp[0]), max(base[1], resp[1])
    j = window_join(good.select(*by, key, onset), samples.select(*by, ts, x), by, onset, ts, lo, hi)
    lag = F.col(ts) - F.col(onset)
    j = j.withColumns({"_lag": lag, "_base": (lag >= base[0]) & (lag < base[1]), "_resp": (lag >= resp[0]) & (lag < resp[1])})
    w = W.partitionBy(*by, key, "_resp").orderBy("_lag", x)  # the samples of one trial window
    full = W.partitionBy(*by, key, "_resp")
    j = j.withColumns({"_i": F.row_number().over(w), "_n": F.count(F.lit(1)).over(full),
                       "_first": F.first(x).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
                       "_last": F.last(x).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    line = F.col("_first") + F.coalesce((F.col("_last") - F.col("_first")) * div(F.col("_i") - 1, F.col("_n") - 1), F.lit(0.0))
    det = F.when(F.col("_resp"), F.col(x) - line)
    s = j.groupBy(*by, key).agg(
        F.count_if("_base").alias("n_base"), F.count_if("_resp").alias("n_resp"),
        F.avg(F.when(F.col("_base"), F.col(x))).alias("_b"), F.avg(F.when(F.col("_resp"), F.col(x))).alias("_r"),
        (F.max(det) - F.min(det)).alias("_shape"))
    ok = (F.col("n_base") >= min_n) & (F.col("n_resp") >= min_n)
    s = s.select(*by, key, "n_base", "n_resp", F.when(ok, F.col("_b")).alias("baseline"),
                 F.when(ok, F.col("_r") - F.col("_b")).alias("rise"),
                 F.when(ok & (F.col("n_resp") >= min_shape), F.col("_shape")).alias("shape"))
    return trials.select(*by, key).join(s, [*by, key], "left")


def epochs(trials: DataFrame, samples: DataFrame, by: list[str], key: str, onset: str, ts: str, x: str,
           tmin: float, tmax: float, base: tuple[float, float]) -> DataFrame:
    """Samples by lag in [tmin, tmax) minus the epoch's baseline mean."""
    keep = [c for c in samples.columns if c not in by]
    j = window_join(trials.select(*by, key, onset), samples.select(*by, *keep), by, onset, ts, tmin, tmax)
    j = j.withColumn("lag", F.col(ts) - F.col(onset))
    b = j.filter((F.col("lag") >= base[0]) & (F.col("lag") < base[1])).groupBy(*by, key).agg(F.avg(x).alias("_b"))
    return j.join(b, [*by, key]).withColumn("v", F.col(x) - F.col("_b")).drop("_b", onset)


def reject(ep: DataFrame, key: list[str], v: str, max_abs: float, bad=None, max_bad: float = 1.0) -> DataFrame:
    """Epochs whose largest deviation and share of bad samples stay within limits."""
    share = F.avg(bad.cast("int")) if bad is not None else F.lit(0.0)
    s = ep.groupBy(*key).agg(F.max(F.abs(v)).alias("_a"), share.alias("_bad"))
    return ep.join(s.filter((F.col("_a") <= max_abs) & (F.col("_bad") <= max_bad)).select(*key), key, "left_semi")


def grand_average(ep: DataFrame, unit: str, lag_bin: str, v: str) -> DataFrame:
    """Mean over units of the unit means by lag, its SEM, peak and trough lag."""
    u = ep.groupBy(unit, lag_bin).agg(F.avg(v).alias("_m"))
    g = u.groupBy(lag_bin).agg(F.avg("_m").alias("mean"), F.count(F.lit(1)).alias("n_units"),
                               div(F.stddev_samp("_m"), F.sqrt(F.count(F.lit(1)))).alias("sem"))
    ext = g.agg(F.max_by(lag_bin, F.struct(F.round("mean", 9), -F.col(lag_bin))).alias("peak_lag"),
                F.min_by(lag_bin, F.struct(F.round("mean", 9), F.col(lag_bin))).alias("trough_lag"))
    return with_row(g, ext)


def anchor_contrast(real: DataFrame, control: DataFrame, unit: str, v: str) -> DataFrame:
    """E5 table: per unit the mean at real anchors, at random anchors and their difference."""
    a = real.groupBy(unit).agg(F.avg(v).alias("real"), F.count(v).alias("n_real"))
    b = control.groupBy(unit).agg(F.avg(v).alias("control"), F.count(v).alias("n_control"))
    return a.join(b, unit).withColumn("d", F.col("real") - F.col("control"))


def category_contrast(df: DataFrame, unit: str, category: str, names: list[str], v: str) -> DataFrame:
    """Per unit the pairwise differences of category means, long over pairs."""
    p = df.groupBy(unit).pivot(category, names).agg(F.avg(v))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    rows = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), (F.col(a) - F.col(b)).alias("d")) for a, b in pairs])
    return p.select(unit, F.explode(rows).alias("r")).select(unit, "r.pair", "r.d").filter(F.col("d").isNotNull())


def onset_shape(df: DataFrame, by: list[str], idx: str, x: str, hop: float, short: int, long: int, floor_db: float) -> DataFrame:
    """Early levels over the median, time to half the median, lead below the floor."""
    d = df.join(quantiles(df, by, x, {"_med": 0.5}), by).filter(F.col("_med") > 0)
    i, v, m = F.col(idx), F.col(x), F.col("_med")
    thr = m * (10.0 ** (floor_db / 20.0))
    s = d.groupBy(*by).agg(
        F.avg(F.when(i < short, v / m)).alias("rise_short"), F.avg(F.when(i < long, v / m)).alias("rise_long"),
        F.min(F.when(v >= m / 2, i)).alias("_half"), F.min(F.when(v >= thr, i)).alias("_lead"), F.count(F.lit(1)).alias("n"))
    return s.select(*by, "n", "rise_short", "rise_long", (F.col("_half") * hop).alias("t_half"),
                    (F.coalesce("_lead", "n") * hop).alias("lead"))


def evoked_stats(ep: DataFrame, by: list[str], channel: str, lag: str, v: str, window: tuple[float, float],
                 region_window: tuple[float, float], region: list) -> DataFrame:
    """SD over channels of the mean epoch averaged over a lag window, and the mean
    of a channel region in another window."""
    m = ep.groupBy(*by, channel, lag).agg(F.avg(v).alias("_m"))
    inside = (F.col(lag) >= window[0]) & (F.col(lag) <= window[1])
    g = m.filter(inside).groupBy(*by, lag).agg(F.stddev_pop("_m").alias("_s")).groupBy(*by).agg(F.avg("_s").alias("dispersion"))
    reg = F.col(channel).isin(*region) & (F.col(lag) >= region_window[0]) & (F.col(lag) <= region_window[1])
    r = m.filter(reg).groupBy(*by).agg(F.avg("_m").alias("region_mean"))
    return g.join(r, by, "left")


def segment_contrast(samples: DataFrame, log: DataFrame, unit: str, ts: str, x: str, start, end, t_from: float,
                     t_to: float, min_n: int) -> DataFrame:
    """Mean and SD inside the marked baseline span and a later task span."""
    marks = log.groupBy(unit).agg(F.min(F.when(start, F.col(ts))).alias("_b0"), F.min(F.when(end, F.col(ts))).alias("_b1"))
    marks = marks.filter(F.col("_b1") > F.col("_b0"))
    j = samples.join(marks, unit)
    t, v = F.col(ts), F.col(x)
    base = (t >= F.col("_b0")) & (t < F.col("_b1"))
    task = (t >= F.col("_b1") + t_from) & (t < F.col("_b1") + t_to)
    s = j.groupBy(unit).agg(
        F.count_if(base).alias("n_base"), F.count_if(task).alias("n_task"),
        F.avg(F.when(base, v)).alias("mean_base"), F.avg(F.when(task, v)).alias("mean_task"),
        F.stddev_pop(F.when(base, v)).alias("sd_base"), F.stddev_pop(F.when(task, v)).alias("sd_task"))
    s = s.filter((F.col("n_base") > min_n) & (F.col("n_task") > min_n))
    return s.withColumn("diff", F.col("mean_task") - F.col("mean_base"))


def span_check(log: DataFrame, samples: DataFrame, unit: str, ts: str, slack: float) -> DataFrame:
    """Does the log lie inside the recording, give or take the slack?"""
    a = log.groupBy(unit).agg(F.min(ts).alias("log_start"), F.max(ts).alias("log_end"))
    b = samples.groupBy(unit).agg(F.min(ts).alias("rec_start"), F.max(ts).alias("rec_end"))
    return a.join(b, unit).withColumn("inside", (F.col("log_start") >= F.col("rec_start") - slack)
                                      & (F.col("log_end") <= F.col("rec_end") + slack))
