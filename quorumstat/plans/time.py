"""Window and series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import r4, r6
from ..operators import peaks, prominence
from ..operators import recursive as rc
from ..operators import timeline as tl
from .registry import CORR, EV, OL, R, R4, RANK, query
from .stats import rounded, sp_cte

O = "partition by user_id order by sec, event_id"
IDX = f"ix as (select *, row_number() over ({O}) - 1 as idx from ev)"


def series(t):
    """Events numbered 0.. inside each user."""
    d = t.ratings.withColumns({"kd": F.col("k").cast("double")})
    return tl.numbered(d, ["user_id"], ["sec", "event_id"], F.col("sec"))


@query("W1_within_z_null", f"""with {EV} select event_id, {R('(value - avg(value) over (partition by user_id)) / nullif(stddev_samp(value) over (partition by user_id), 0)')} as value_z from ev""")
def _(t):
    return rounded(tl.within_z(t.ratings, ["user_id"], ["value"]).select("event_id", "value_z"), "value_z")


@query("W1_within_z_eps", f"""with {EV} select event_id, {R('(k - avg(k) over (partition by user_id)) / (stddev_samp(k) over (partition by user_id) + 1e-9)')} as k_z from ev""")
def _(t):
    return rounded(tl.within_z(t.ratings, ["user_id"], ["k"], 1e-9).select("event_id", "k_z"), "k_z")


@query("W2_global_z", f"""select o_orderkey, {R('(o_totalprice - avg(o_totalprice) over ()) / (stddev_samp(o_totalprice) over () + 1e-9)')} as o_totalprice_z from orders""")
def _(t):
    return rounded(tl.global_z(t.orders, ["o_totalprice"]).select("o_orderkey", "o_totalprice_z"), "o_totalprice_z")


@query("W3_ranks", f"""with {EV} select event_id, {R(RANK('k', 'user_id'))} as avg_rank, {R(RANK('k', 'user_id') + ' / count(*) over (partition by user_id)')} as pct from ev""")
def _(t):
    return rounded(tl.pct_rank(t.ratings, ["user_id"], "k").select("event_id", "avg_rank", "pct"), "avg_rank", "pct")


@query("W4_diff", f"""with {EV}, d as (select user_id, value - lag(value) over ({O}) as d from ev)
 select user_id, count(d) as n, {R('avg(abs(d))')} as mean_abs_diff, {R('max(d)')} as max_diff from d group by 1""")
def _(t):
    d = tl.diff(t.ratings, ["user_id"], ["sec", "event_id"], F.col("sec"), "value")
    return rounded(d.groupBy("user_id").agg(F.count("diff").alias("n"), F.avg(F.abs("diff")).alias("mean_abs_diff"),
                                            F.max("diff").alias("max_diff")), "mean_abs_diff", "max_diff")


@query("W5_lag_scan", f"""with {EV}, {IDX}, d as (select user_id, idx, lead(value) over (partition by user_id order by idx) - value as dx,
 lead(k) over (partition by user_id order by idx) - k as dy from ix), dd as (select * from d where dx is not null),
 j as (select a.user_id, l as lag, a.dx, b.dy from dd a, (select unnest([0, 1, 2, 3]) as l), dd b where b.user_id = a.user_id and b.idx = a.idx + l),
 {sp_cte('s', 'j', 'user_id, lag', 'dx', 'dy')}, m as (select lag, avg(abs(rho)) as m, count(rho) as n from s where n >= 19 group by 1)
 select lag, {R('m')} as mean_abs_rho, n as n_series, (select arg_max(lag, (round(m, 9), -lag)) from m) as best_lag from m""")
def _(t):
    s = tl.lag_scan(series(t), ["user_id"], "idx", "value", "k", [0, 1, 2, 3])
    return rounded(tl.best_lag(s), "mean_abs_rho")


@query("W6_autocorrelation", f"""with {EV}, d as (select *, lag(value) over ({O}) as p from ev)
 select user_id, count(*) as n, {R(CORR('case when p is not null then value end', 'p').replace('stddev_samp(p)', 'stddev_samp(p)'))} as ac1 from d group by 1""")
def _(t):
    return rounded(tl.ac1(t.ratings, ["user_id"], ["sec", "event_id"], F.col("sec"), "value"), "ac1")


@query("W7_gaps", f"""with {EV}, d as (select user_id, sec, lag(sec) over ({O}) as p from ev)
 select user_id, {R('p')} as gap_start, {R('sec')} as gap_end from d where sec - p > 86400""")
def _(t):
    return rounded(tl.gaps(t.ratings, ["user_id"], "sec", ["sec", "event_id"], 86400.0), "gap_start", "gap_end")


LOCAL = "from ev a join ev b on a.user_id = b.user_id and b.sec >= a.sec - {h}::double and b.sec <= a.sec + {h}::double"


@query("W8_local_stats", f"""with {EV} select a.event_id, count(*) as n, {R('avg(b.value)')} as mean, {R4('stddev_pop(b.value)')} as std,
 min(b.value) as min, max(b.value) as max {LOCAL.format(h=86400)} group by 1""")
def _(t):
    d = tl.local_stats(t.ratings, ["user_id"], "event_id", "sec", "value", 86400.0).drop("user_id")
    return rounded(d, "mean").withColumn("std", r4("std"))


@query("W9_detrend", f"""with {EV}, {IDX}, f as (select user_id, regr_slope(value, idx) as b, regr_intercept(value, idx) as a from ix group by 1)
 select event_id, {R('value - a - b * idx')} as detrended from ix join f using (user_id)""")
def _(t):
    return rounded(tl.detrend(series(t), ["user_id"], "idx", "value").select("event_id", "detrended"), "detrended")


@query("W10_tonic_phasic", f"""with {EV}, m as (select a.event_id, any_value(a.value) as v, avg(b.value) as tonic {LOCAL.format(h=129600)} group by 1)
 select event_id, {R('tonic')} as tonic, {R('v - tonic')} as phasic from m""")
def _(t):
    d = tl.tonic_phasic(t.ratings, ["user_id"], "event_id", "sec", "value", 259200.0)
    return rounded(d.select("event_id", "tonic", "phasic"), "tonic", "phasic")


def zero_phase_sql(b, a, out):
    """Twin of a filter of order 2: both runs as recursions over all series at once."""
    gain = sum(b) / sum(a)
    r2 = b[2] - a[2] * gain
    r1 = b[1] - a[1] * gain + r2
    b0, b1, b2, a1, a2, r1, r2 = (f"({v!r})::double" for v in (*b, *a[1:], r1, r2))

    def run(name, src, first, step):
        y = f"{b0} * e.v + f.s1"
        y0 = f"({b0} * v + {r1} * v)"
        return f"""{name} as (select user_id, idx, {y0} as v, {b1} * v - {a1} * {y0} + {r2} * v as s1, {b2} * v - {a2} * {y0} as s2 from {src} where idx = {first}
 union all select e.user_id, e.idx, {y}, {b1} * e.v - {a1} * ({y}) + f.s2, {b2} * e.v - {a2} * ({y}) from {name} f join {src} e on e.user_id = f.user_id and e.idx = f.idx + {step})"""

    return f"""with recursive {EV}, {IDX}, n as (select user_id, max(idx) as m from ix group by 1 having max(idx) > 8),
 x as (select user_id, idx, m, value::double as v from ix join n using (user_id)),
 ext as (select user_id, idx, m, v from x
 union all select o.user_id, -p.idx, o.m, 2 * o.v - p.v from x o join x p on p.user_id = o.user_id and p.idx between 1 and 9 where o.idx = 0
 union all select o.user_id, 2 * o.m - p.idx, o.m, 2 * o.v - p.v from x o join x p on p.user_id = o.user_id and p.idx between p.m - 9 and p.m - 1 where o.idx = o.m),
 {run('fw', 'ext', '-9', '1')}, mid as (select fw.user_id, fw.idx, n.m, fw.v from fw join n using (user_id)), {run('bw', 'mid', 'm + 9', '-1')}
 {out}"""


HIGH = rc.butter(2, 0.05, 1.0, "high")


@query("W10_zero_phase", zero_phase_sql(*HIGH, f"""select ix.event_id, {R('bw.v')} as phasic, {R('ix.value - bw.v')} as tonic
 from ix left join bw on bw.user_id = ix.user_id and bw.idx = ix.idx"""))
def _(t):
    d = rc.slow_fast(series(t), ["user_id"], "idx", "value", 0.05, 1.0, keep=("event_id",))
    return rounded(d.select("event_id", "phasic", "tonic"), "phasic", "tonic")


@query("W11_peak_rate", f"""with {EV}, m as (select a.user_id, a.event_id, any_value(a.value) as v, max(b.value) as mx, any_value(a.sec) as sec {LOCAL.format(h=43200)} group by 1, 2)
 select user_id, count(*) filter (v >= 50 and v = mx) as n_peaks, {R('count(*) filter (v >= 50 and v = mx) * 3600.0 / nullif(max(sec) - min(sec), 0)')} as rate from m group by 1""")
def _(t):
    return rounded(tl.peak_rate(t.ratings, ["user_id"], "event_id", "sec", "value", 50.0, 43200.0), "rate")


def peaks_sql(x, height, distance, out=None):
    """Twin of the peak finder: runs of equal samples, then the highest left puts out its neighbours."""
    w = "over (partition by user_id order by idx)"
    r = "over (partition by user_id order by run)"
    return f"""with recursive {EV}, {IDX}, s as (select user_id, idx, {x}::double as v from ix),
 f as (select *, case when v is not distinct from lag(v) {w} then 0 else 1 end as new from s), g as (select *, sum(new) {w} as run from f),
 runs as (select user_id, run, min(idx) as a, max(idx) as z, max(v) as v from g group by 1, 2),
 nb as (select *, lag(v) {r} as l, lead(v) {r} as n from runs),
 top as (select user_id, (a + z) // 2 as i, v from nb where l < v and n < v and v >= {height}),
 r as (select user_id, []::struct(v double, i bigint)[] as kept, list({{'v': v, 'i': i::bigint}} order by v desc, i desc) as open from top group by 1
 union all select user_id, list_append(kept, open[1]), list_filter(open, lambda p: abs(p.i - open[1].i) >= {distance}) from r where len(open) > 0),
 k as (select user_id, unnest(kept) as p from r where len(open) = 0)
 {out or f'select user_id, p.i as idx, p.v as {x} from k'}"""


@query("W11_find_peaks", peaks_sql("value", 50, 3))
def _(t):
    return peaks.find_peaks(series(t), ["user_id"], "idx", "value", 50.0, 3)


@query("W11_find_peaks_plateaus", peaks_sql("k", 0, 4))
def _(t):
    return peaks.find_peaks(series(t), ["user_id"], "idx", "k", 0.0, 4)


def prominent_sql(x, height, distance, least):
    """Twin: samples between a peak and the nearest higher ones."""
    return peaks_sql(x, height, distance, f""", e as (select k.user_id, k.p.i as i, k.p.v as v, coalesce(max(s.idx) filter (s.idx < k.p.i and s.v > k.p.v), -1) as l,
 min(s.idx) filter (s.idx > k.p.i and s.v > k.p.v) as r from k join s using (user_id) group by 1, 2, 3),
 m as (select e.user_id, e.i, e.v, min(s.v) filter (s.idx <= e.i) as a, min(s.v) filter (s.idx >= e.i) as z
 from e join s on s.user_id = e.user_id and s.idx > e.l and (e.r is null or s.idx < e.r) group by 1, 2, 3)
 select user_id, i as idx, v as {x}, {R('v - greatest(a, z)')} as prominence from m where v - greatest(a, z) >= {least}""")


@query("W11_prominent_peaks", prominent_sql("value", 20, 2, 30))
def _(t):
    return rounded(prominence.prominent_peaks(series(t), ["user_id"], "idx", "value", 30.0, 20.0, 2), "prominence")


@query("W11_prominent_plateaus", prominent_sql("k", 0, 1, 4))
def _(t):
    return rounded(prominence.prominent_peaks(series(t), ["user_id"], "idx", "k", 4.0, 0.0), "prominence")


@query("W12_event_rate", f"""with {EV}, d as (select user_id, sec - lag(sec) over ({O}) as rr from ev), s as (select user_id, count(rr) as n,
 count(*) filter (rr > 600 and rr < 100000) as ok, avg(rr) filter (rr > 600 and rr < 100000) as m from d group by 1)
 select user_id, n, ok as n_ok, case when ok >= 2 and ok / n >= 0.9 then {R('60 / m')} end as rate from s""")
def _(t):
    return rounded(tl.event_rate(t.ratings, ["user_id"], "sec", ["sec", "event_id"], 600.0, 100000.0, 0.9), "rate")


@query("W13_resample_linear", f"""with {EV}, p as (select user_id, sec as t, avg(value) as x from ev group by 1, 2),
 s as (select user_id, floor(min(t) / 86400)::bigint as lo, floor(max(t) / 86400)::bigint as hi from p group by 1),
 g as (select user_id, unnest(range(lo, hi + 1)) * 86400.0::double as t from s),
 b as (select g.user_id, g.t, p.t as t0, p.x as x0 from g asof left join p on g.user_id = p.user_id and g.t >= p.t),
 a as (select b.*, p.t as t1, p.x as x1 from b asof left join p on b.user_id = p.user_id and b.t <= p.t)
 select user_id, t as sec, {R('case when x0 is null then x1 when x1 is null then x0 else x0 + coalesce((x1 - x0) * (t - t0) / nullif(t1 - t0, 0), 0) end')} as value from a""")
def _(t):
    return rounded(tl.resample_linear(t.ratings, ["user_id"], "sec", "value", 86400.0), "value")


@query("W14_interpolate_bad", f"""with {EV}, {IDX}, b as (select *, value <= 5 or value > 150 as bad from ix),
 ok as (select user_id from b group by 1 having avg(bad::int) <= 0.15), d as (select b.* from b join ok using (user_id)),
 g as (select user_id, idx::double as t, value as x from d where not bad),
 p as (select d.user_id, d.event_id, d.idx::double as idx, d.value, d.bad, g.t as t0, g.x as x0 from d asof left join g on d.user_id = g.user_id and d.idx::double >= g.t),
 q as (select p.*, g.t as t1, g.x as x1 from p asof left join g on p.user_id = g.user_id and p.idx <= g.t)
 select event_id, bad as is_bad, {R('case when not bad then value when x0 is null then x1 when x1 is null then x0 else x0 + coalesce((x1 - x0) * (idx - t0) / nullif(t1 - t0, 0), 0) end')} as filled from q""")
def _(t):
    d = tl.interpolate_bad(series(t), ["user_id"], "idx", "value", 5.0, 150.0, 0.15)
    return rounded(d.select("event_id", "is_bad", "filled"), "filled")


KERNEL = tl.response_kernel(0.5, 4.0, 0.75, 2.0)


@query("W15_convolve", f"""with {EV}, {IDX}, h as (select unnest({KERNEL}::double[]) as h, unnest(range({len(KERNEL)})) as l)
 select a.event_id, {R('sum(b.value * h)')} as conv from ix a, h, ix b where b.user_id = a.user_id and b.idx = a.idx - l group by 1""")
def _(t):
    return rounded(tl.convolve(series(t).select("event_id", "user_id", "idx", "value"), ["user_id"], "idx", "value", KERNEL).select("event_id", "conv"), "conv")


@query("W16_block_mean", f"""with {EV}, {IDX} select user_id, idx // 8 as block, {R('avg(value)')} as value from ix group by 1, 2 having count(*) = 8""")
def _(t):
    return rounded(tl.block_mean(series(t), ["user_id"], "idx", "value", 8), "value")


@query("W17_habituation", f"""with {EV}, {IDX}, {sp_cte('s', 'ix', 'user_id', 'idx', 'value')} select user_id, {R('rho')} as rho, n from s""")
def _(t):
    return rounded(tl.habituation(t.ratings, ["user_id"], ["sec", "event_id"], F.col("sec"), "value"), "rho")


@query("W18_deviation", f"""with {EV} select event_id, {R('value - avg(value) over (partition by k)')} as deviation from ev""")
def _(t):
    return rounded(tl.deviation(t.ratings, ["k"], "value").select("event_id", "deviation"), "deviation")


@query("W19_median_split", f"""with {EV}, g as (select quantile_cont(value, 0.5) as g from ev), u as (select user_id, quantile_cont(value, 0.5) as u from ev group by 1)
 select event_id, value > g as hi_global, value > u as hi_within from ev join u using (user_id), g""")
def _(t):
    return tl.median_split(t.ratings, ["user_id"], "value").select("event_id", "hi_global", "hi_within")


@query("W20_control_order", f"""with {EV}, {IDX}, f as (select user_id, regr_slope(k, idx) as bx, regr_intercept(k, idx) as ax, regr_slope(value, idx) as by_,
 regr_intercept(value, idx) as ay from ix group by 1) select event_id, {R('k - ax - bx * idx')} as kd_r, {R('value - ay - by_ * idx')} as value_r from ix join f using (user_id)""")
def _(t):
    return rounded(tl.control_order(series(t), ["user_id"], "idx", "kd", "value").select("event_id", "kd_r", "value_r"), "kd_r", "value_r")


@query("W20_control_order_cubic")
def _(t):
    return rounded(tl.control_order(series(t), ["user_id"], "idx", "kd", "value", 3).select("event_id", "kd_r", "value_r"), "kd_r", "value_r")


@query("W21_sampling_rate", f"""with {EV}, d as (select user_id, sec - lag(sec) over ({O}) as d from ev)
 select user_id, {R('quantile_cont(d, 0.5)')} as median_step, {R('3600 / nullif(quantile_cont(d, 0.5), 0)')} as per_hour from d where d is not null group by 1""")
def _(t):
    d = tl.sampling_rate(t.ratings, ["user_id"], "sec", ["sec", "event_id"])
    return d.select("user_id", r6("median_step").alias("median_step"), r6(F.col("rate") * 3600).alias("per_hour"))


@query("W21_decimate", f"""with {EV}, {IDX} select user_id, event_id from ix where idx % 5 = 0""")
def _(t):
    return tl.decimate(t.ratings, ["user_id"], ["sec", "event_id"], F.col("sec"), 5).select("user_id", "event_id")


@query("W22_block_range", f"""with {EV}, s as (select user_id, min(sec) as t0 from ev group by 1), d as (select user_id, value, sec - t0 as o, floor((sec - t0) / 172800)::bigint as k from ev join s using (user_id)),
 r as (select user_id, k, max(value) - min(value) as r from d where k < 50 and o - k * 172800 < 86400 group by 1, 2)
 select user_id, {R('quantile_cont(r, 0.5)')} as median_range, count(*) as n_blocks from r group by 1""")
def _(t):
    return rounded(tl.block_range(t.ratings, ["user_id"], "sec", "value", 86400.0, 172800.0), "median_range")
