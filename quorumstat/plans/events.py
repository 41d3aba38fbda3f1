"""Event-locked queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import r4, r6
from ..operators import events as ev
from ..operators import resample as rs
from ..operators import sampling as sm
from ..operators import stats as st
from ..operators import timeline as tl
from .joins import GAPS
from .registry import EV, R, R4, U, query
from .resampling import signflip_sql, wilcoxon_sql
from .stats import TYPES, rounded

DAY = 86400.0


def trials(t, kind="error"):
    return t.ratings.filter(F.col("event_type") == kind).select("user_id", "event_id", F.col("sec").alias("onset"))


def samples(t, kind="error"):
    return t.ratings.filter(F.col("event_type") != kind).select("user_id", "sec", "value", "k", "event_type", F.col("event_id").alias("sample_id"))


TR = "tr as (select user_id, event_id, sec as onset from ev where event_type = 'error'), sa as (select user_id, sec, value, k, event_type, event_id as sample_id from ev where event_type <> 'error')"


@query("E1_trial_features", f"""with {EV}, {TR}, {GAPS}, good as (select * from tr t where not exists (select 1 from gaps g where g.user_id = t.user_id
 and ((g.gap_start < t.onset and g.gap_end > t.onset - 86400) or (g.gap_start < t.onset + 172800 and g.gap_end > t.onset)))),
 j as (select g.user_id, g.event_id, s.value as x, s.sec - g.onset as lag, s.sec - g.onset >= 0 as resp from good g join sa s on s.user_id = g.user_id and s.sec - g.onset >= -86400 and s.sec - g.onset < 172800),
 w as (select *, row_number() over (partition by event_id, resp order by lag, x) as i, count(*) over (partition by event_id, resp) as n,
 first_value(x) over (partition by event_id, resp order by lag, x rows between unbounded preceding and unbounded following) as f,
 last_value(x) over (partition by event_id, resp order by lag, x rows between unbounded preceding and unbounded following) as l from j),
 a as (select event_id, count(*) filter (not resp) as nb, count(*) filter (resp) as nr, avg(x) filter (not resp) as b, avg(x) filter (resp) as r,
 max(x - f - coalesce((l - f) * (i - 1) / nullif(n - 1, 0), 0)) filter (resp) - min(x - f - coalesce((l - f) * (i - 1) / nullif(n - 1, 0), 0)) filter (resp) as sh from w group by 1)
 select tr.user_id, tr.event_id, nb as n_base, nr as n_resp, case when nb >= 1 and nr >= 1 then {R('b')} end as baseline,
 case when nb >= 1 and nr >= 1 then {R('r - b')} end as rise, case when nb >= 1 and nr >= 3 then {R('sh')} end as shape from tr left join a using (event_id)""")
def _(t):
    g = tl.gaps(t.ratings, ["user_id"], "sec", ["sec", "event_id"], DAY)
    d = ev.trial_features(trials(t), samples(t), g, ["user_id"], "event_id", "onset", "sec", "value",
                          (-DAY, 0.0), (0.0, 2 * DAY), 1, 3)
    return rounded(d, "baseline", "rise", "shape")


EPOCH = f"""ep0 as (select t.user_id, t.event_id, s.sample_id, s.event_type, s.value, s.sec - t.onset as lag from tr t join sa s on s.user_id = t.user_id
 and s.sec >= t.onset - 86400 and s.sec < t.onset + 172800), bs as (select event_id, avg(value) as b from ep0 where lag < 0 group by 1),
 ep as (select ep0.*, value - b as v from ep0 join bs using (event_id))"""


def epoch_table(t):
    return ev.epochs(trials(t), samples(t), ["user_id"], "event_id", "onset", "sec", "value", -DAY, 2 * DAY, (-DAY, 0.0))


@query("E2_epochs", f"with {EV}, {TR}, {EPOCH} select event_id, sample_id, {R('lag')} as lag, {R('v')} as v from ep")
def _(t):
    return rounded(epoch_table(t).select("event_id", "sample_id", "lag", "v"), "lag", "v")


@query("E3_reject", f"""with {EV}, {TR}, {EPOCH}, ok as (select event_id from ep group by 1 having max(abs(v)) <= 90 and avg((value < 3)::int) <= 0.25)
 select event_id, count(*) as n from ep join ok using (event_id) group by 1""")
def _(t):
    d = ev.reject(epoch_table(t), ["event_id"], "v", 90.0, F.col("value") < 3, 0.25)
    return d.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("E4_grand_average", f"""with {EV}, {TR}, {EPOCH}, u as (select user_id, floor(lag / 21600)::bigint as bin, avg(v) as m from ep group by 1, 2),
 g as (select bin, avg(m) as mean, count(*) as n, stddev_samp(m) / sqrt(count(*)) as sem from u group by 1)
 select bin, {R('mean')} as mean, n as n_units, {R('sem')} as sem, (select arg_max(bin, (round(mean, 9), -bin)) from g) as peak_lag,
 (select arg_min(bin, (round(mean, 9), bin)) from g) as trough_lag from g""")
def _(t):
    d = epoch_table(t).withColumn("bin", F.floor(F.col("lag") / 21600))
    return rounded(ev.grand_average(d, "user_id", "bin", "v"), "mean", "sem")


ANCH = f"""sp as (select user_id, min(sec) as lo, max(sec) as hi from ev group by 1), na as (select user_id, count(*) as n from ev where event_type = 'purchase' group by 1),
 an as (select user_id, i as anchor, lo + 86400 + {U('anchor', 'user_id', 'i')} * (hi - lo - 172800) as onset from (
 select user_id, lo, hi, unnest(range(1, n + 1)) as i from sp join na using (user_id) where hi - lo > 172800)),
 ot as (select * from ev where event_type <> 'purchase'),
 ra as (select user_id, event_id as id, sec as onset from ev where event_type = 'purchase'),
 fr as (select a.user_id, id, avg(value) filter (s.sec >= onset) - avg(value) filter (s.sec < onset) as m from ra a join ot s on s.user_id = a.user_id and s.sec >= onset - 86400 and s.sec < onset + 86400 group by 1, 2),
 fc as (select a.user_id, anchor, avg(value) filter (s.sec >= onset) - avg(value) filter (s.sec < onset) as m from an a join ot s on s.user_id = a.user_id and s.sec >= onset - 86400 and s.sec < onset + 86400 group by 1, 2),
 ds as (select r.user_id, r.m as rm, c.m as cm, r.m - c.m as d, nr, nc from (select user_id, avg(m) as m, count(m) as nr from fr group by 1) r join (select user_id, avg(m) as m, count(m) as nc from fc group by 1) c using (user_id))"""


def contrast(t):
    s = samples(t, "purchase")
    real = trials(t, "purchase")
    ctl = sm.random_anchors(t.ratings, real, "user_id", "sec", "anchor", DAY)
    ctl = ctl.select("user_id", F.col("anchor").alias("event_id"), F.col("sec").alias("onset"))
    f = lambda x: ev.trial_features(x, s, None, ["user_id"], "event_id", "onset", "sec", "value", (-DAY, 0.0), (0.0, DAY))
    return ev.anchor_contrast(f(real), f(ctl), "user_id", "rise")


@query("E5_anchor_contrast", f"""with {EV}, {ANCH} select user_id, {R('rm')} as "real", nr as n_real, {R('cm')} as control, nc as n_control, {R('d')} as d from ds""")
def _(t):
    return rounded(contrast(t), "real", "control", "d")


@query("E5_anchor_contrast_test", f"with {EV}, {ANCH}, dd as (select user_id, round(d, 9) as d from ds where d is not null), "
       + signflip_sql("dd", "", "d", "user_id", 50, "e5") + f" select n, {R('mean')} as mean, {R('p')} as p from sf")
def _(t):
    d = contrast(t).filter("d is not null").select("user_id", F.round("d", 9).alias("d"))
    return rounded(rs.signflip(d, [], "d", "user_id", 50, "e5"), "mean", "p")


CATS = ["click", "purchase", "view"]


@query("E6_category_contrast", f"""with {EV}, m as (select user_id, {', '.join(f"avg(value) filter (event_type = '{c}') as {c}" for c in CATS)} from ev group by 1),
 d as (select user_id, pair, round(d, 9) as d from (select user_id, unnest(['click-purchase', 'click-view', 'purchase-view']) as pair, unnest([click - purchase, click - view, purchase - view]) as d from m) where d is not null),
 {wilcoxon_sql('d', 'pair', 'd')}, o as (select pair, count(d) as k, avg(d) as mean, avg(d) / nullif(stddev_samp(d), 0) as es from d group by 1)
 select pair, k as n, {R('mean')} as mean, {R('es')} as d, {R('w_plus')} as w_plus, {R('z')} as z from o join wx using (pair)""")
def _(t):
    d = ev.category_contrast(t.ratings, "user_id", "event_type", CATS, "value").withColumn("d", F.round("d", 9))
    o = st.one_sample_d(d, ["pair"], "d")
    w = rs.wilcoxon(d, ["pair"], "d").select("pair", "w_plus", "z")
    return rounded(o.join(w, "pair"), "mean", "d", "w_plus", "z")


@query("E7_onset_shape", f"""with {EV}, ix as (select *, row_number() over (partition by user_id order by sec, event_id) - 1 as idx from ev),
 m as (select user_id, quantile_cont(value, 0.5) as med from ev group by 1), d as (select * from ix join m using (user_id) where med > 0),
 s as (select user_id, count(*) as n, avg(value / med) filter (idx < 2) as a, avg(value / med) filter (idx < 20) as b, min(idx) filter (value >= med / 2) as h,
 min(idx) filter (value >= med * pow(10.0::double, -10 / 20.0::double)) as l from d group by 1)
 select user_id, n, {R('a')} as rise_short, {R('b')} as rise_long, {R('h * 0.01::double')} as t_half, {R('coalesce(l, n) * 0.01::double')} as "lead" from s""")
def _(t):
    d = tl.numbered(t.ratings, ["user_id"], ["sec", "event_id"], F.col("sec"))
    return rounded(ev.onset_shape(d, ["user_id"], "idx", "value", 0.01, 2, 20, -10.0), "rise_short", "rise_long", "t_half", "lead")


@query("E8_evoked_stats", f"""with {EV}, {TR}, {EPOCH}, m as (select user_id % 10 as grp, event_type, floor(lag / 21600)::bigint as bin, avg(v) as m from ep group by 1, 2, 3),
 g as (select grp, avg(s) as d from (select grp, bin, stddev_pop(m) as s from m where bin >= 0 and bin <= 4 group by 1, 2) group by 1),
 r as (select grp, avg(m) as r from m where event_type in ('click', 'view') and bin >= 1 and bin <= 2 group by 1)
 select grp, {R('d')} as dispersion, {R('r')} as region_mean from g left join r using (grp)""")
def _(t):
    d = epoch_table(t).withColumns({"bin": F.floor(F.col("lag") / 21600), "grp": F.col("user_id") % 10})
    return rounded(ev.evoked_stats(d, ["grp"], "event_type", "bin", "v", (0, 4), (1, 2), ["click", "view"]), "dispersion", "region_mean")


@query("E9_segment_contrast", f"""with {EV}, m as (select user_id, min(sec) filter (event_type = 'signup') as b0, min(sec) filter (event_type = 'purchase' and k > 40) as b1 from ev group by 1),
 j as (select ev.user_id, value as x, sec >= b0 and sec < b1 as ba, sec >= b1 + 3600 and sec < b1 + 864000 as ta from ev join m using (user_id) where b1 > b0),
 s as (select user_id, count(*) filter (ba) as n_base, count(*) filter (ta) as n_task, avg(x) filter (ba) as mb, avg(x) filter (ta) as mt, stddev_pop(x) filter (ba) as sb, stddev_pop(x) filter (ta) as st from j group by 1)
 select user_id, n_base, n_task, {R('mb')} as mean_base, {R('mt')} as mean_task, {R('sb')} as sd_base, {R('st')} as sd_task, {R('mt - mb')} as diff from s where n_base > 1 and n_task > 1""")
def _(t):
    d = ev.segment_contrast(t.ratings, t.ratings, "user_id", "sec", "value", F.col("event_type") == "signup",
                            (F.col("event_type") == "purchase") & (F.col("k") > 40), 3600.0, 864000.0, 1)
    return rounded(d, "mean_base", "mean_task", "sd_base", "sd_task", "diff")


@query("E10_span_check", f"""with {EV}, a as (select user_id, min(sec) as ls, max(sec) as le from ev where event_type = 'error' group by 1),
 b as (select user_id, min(sec) as rs, max(sec) as re from ev where event_type = 'click' group by 1)
 select user_id, {R('ls')} as log_start, {R('le')} as log_end, {R('rs')} as rec_start, {R('re')} as rec_end, ls >= rs - 86400 and le <= re + 86400 as inside from a join b using (user_id)""")
def _(t):
    d = t.ratings
    s = ev.span_check(d.filter("event_type = 'error'"), d.filter("event_type = 'click'"), "user_id", "sec", DAY)
    return rounded(s, "log_start", "log_end", "rec_start", "rec_end")
