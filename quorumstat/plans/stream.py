"""Streaming and UDF queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import udfs
from ..functions.core import r6, seconds
from ..operators import stats as st
from ..operators import timeline as tl
from ..streaming import streams as sx
from .registry import CORR, EV, R, RANK, REPS, U, query
from .resampling import EPS
from .stats import rounded


def ms(c):
    return F.floor(seconds(c) * 1000).alias(c)


@query("T1_dropout_sessions", f"""with {EV}, b as (select user_id, sec, case when sec - lag(sec) over (partition by user_id order by sec) < 86400 then 0 else 1 end as nw from ev),
 s as (select user_id, sec, sum(nw) over (partition by user_id order by sec) as sid from b), g as (select user_id, min(sec) as st, max(sec) + 86400 as en, count(*) as n from s group by user_id, sid)
 select user_id, floor(st * 1000)::bigint as start, floor(en * 1000)::bigint as "end", n from g where floor(en * 1000) <= floor(((select max(sec) from ev) - 3600) * 1000)""")
def _(t):
    s = sx.dropout_sessions(sx.event_stream(t.spark, t.dir), "user_id", "ts", "1 day")
    return sx.drain(s, "sessions").select("user_id", ms("start"), ms("end"), "n")


WIN = f"""with {EV}, w as (select *, unnest([0, 1, 2, 3]) as s from ev), x as (select event_type, (floor(sec / 21600) - s) * 21600 as st, value from w),
 y as (select * from x where st + 86400 <= (select max(sec) from ev) - 3600)
 select event_type, (st * 1000)::bigint as start, ((st + 86400) * 1000)::bigint as "end", count(*) as n, {R('avg(value)')} as mean, min(value) as min, max(value) as max
 from y group by 1, 2, st"""


@query("T2_window_measures", WIN)
def _(t):
    s = sx.window_measures(sx.event_stream(t.spark, t.dir), ["event_type"], "ts", "value", "24 hours", "6 hours")
    return rounded(sx.drain(s, "windows").select("event_type", ms("start"), ms("end"), "n", "mean", "min", "max"), "mean")


@query("T3_trial_windows", f"""with {EV} select a.event_id, count(*) as n, {R('avg(b.value)')} as mean from ev a join ev b on a.user_id = b.user_id and a.event_type = 'error' and b.event_type <> 'error'
 and b.sec >= a.sec - 43200 and b.sec < a.sec + 86400 group by 1""")
def _(t):
    e = sx.event_stream(t.spark, t.dir).filter("event_type = 'error'").select("user_id", "event_id", F.col("ts").alias("onset"))
    s = sx.event_stream(t.spark, t.dir).filter("event_type <> 'error'").select(F.col("user_id").alias("s_user_id"), "ts", "value")
    d = sx.drain(sx.trial_windows(e, s, "user_id", "onset", "ts", "12 hours", "24 hours"), "trials")
    return d.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))


RUN = "over (partition by user_id order by sec, event_id rows between unbounded preceding and current row)"


@query("T4_running_z", f"""with {EV}, r as (select user_id, event_id, value, count(*) {RUN} as n, avg(value) {RUN} as m, stddev_samp(value) {RUN} as s from ev)
 select user_id, event_id, n, {R('(value - m) / nullif(s, 0)')} as z from r""")
def _(t):
    d = sx.drain(sx.running_z(sx.event_stream(t.spark, t.dir), "user_id", "event_id", "ts", "value"), "running")
    return d.select("user_id", "event_id", "n", r6("z").alias("z"))


@query("D1_normal_p")
def _(t):
    d = tl.global_z(t.orders.withColumnRenamed("o_totalprice", "x"), ["x"])
    return d.groupBy(F.round("x_z", 2).alias("z")).agg(F.count(F.lit(1)).alias("n")).withColumn("p", r6(udfs.norm_p_two_sided("z")))


@query("D2_grouped_map", f"""with {EV} select user_id, count(*) as n, {R('regr_slope(value, k)')} as slope from ev group by 1""")
def _(t):
    return rounded(udfs.grouped_slope(t.ratings, "user_id", "k", "value"), "slope")


@query("D3_centred_p", f"""with {EV}, r as (select user_id, event_id, {RANK('k', 'user_id')} as rx, {RANK('value', 'user_id')} as ry from ev),
 o as (select user_id, round({CORR('rx', 'ry')}, 9) as obs from r group by 1), n as (select user_id, rep, round({CORR('rx', f"ry * case when {U('d3', 'rep', 'event_id')} < 0.5 then -1 else 1 end")}, 9) as v from r, {REPS(15)} group by 1, 2),
 c as (select user_id, quantile_cont(v, 0.5) as c from n group by 1)
 select user_id, {R(f'(1 + count(*) filter (abs(v - c) >= abs(obs - c) - {EPS})) / (1 + count(v))')} as p from n join o using (user_id) join c using (user_id) group by 1""")
def _(t):
    from ..functions.core import corr, replicates
    from ..operators.ordered import avg_ranks
    from ..operators.resample import sign
    r = avg_ranks(t.ratings, ["user_id"], {"rx": "k", "ry": "value"})
    o = r.groupBy("user_id").agg(F.round(corr("rx", "ry"), 9).alias("obs"))
    n = replicates(r, 15).groupBy("user_id", "rep").agg(F.round(corr("rx", F.col("ry") * sign("d3", "rep", "event_id")), 9).alias("v"))
    return rounded(n.join(o, "user_id").groupBy("user_id").agg(udfs.centred_p("obs", "v").alias("p")), "p")


@query("D4_grid_udtf", f"""select k, w, count(*) as n, {R('avg(least(l_quantity, k) * w)')} as m from lineitem, (select unnest([5, 10, 20]) as k), (select unnest([0.5::double, 1.5::double]) as w) group by 1, 2""")
def _(t):
    g = udfs.Grid(F.array(F.lit(5), F.lit(10), F.lit(20)), F.array(F.lit(0.5), F.lit(1.5)))
    q = t.lineitem.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("c"))
    d = q.lateralJoin(g)
    v = F.least("l_quantity", F.col("k").cast("double")) * F.col("w") * F.col("c")
    return d.groupBy("k", "w").agg(F.sum("c").alias("n"), r6(F.sum(v) / F.sum("c")).alias("m"))
