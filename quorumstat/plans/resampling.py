"""Sampling and inference queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import r6
from ..operators import resample as rs
from ..operators import sampling as sm
from ..operators import stats as st
from ..operators import timeline as tl
from ..operators.ordered import row_numbers
from .registry import CORR, EV, NORMAL, OL, R, R4, RANK, REPS, U, query
from .stats import FE, icc_sql, rounded, sp_cte

EPS = "1e-9::double"


# SQL pieces ------------------------------------------------------------------

def icc_cte(name, src, by, item, value):
    return f"{name} as ({icc_sql(src, by, item, value).replace(R('(msb-msw)/den'), '(msb-msw)/den')})"


def perm_sql(obs, null, hit):
    """obs: one-row (obs); null: rows (rep, v)."""
    return f"""select {R('any_value(obs)')} as obs, {R('avg(v)')} as null_mean, {R('stddev_pop(v)')} as null_sd, count(*) as n_null,
 {R(f'(1 + count(*) filter ({hit})) / (1 + count(*))')} as p from {null}, {obs} where v is not null"""


def permuted_cte(name, src, unit, key, keep, move, n, seed):
    """rows (rep, unit, keep..., move...): move shuffled inside unit."""
    pu = f"partition by {unit} " if unit else ""
    uu = f"{unit}, " if unit else ""
    on = f"a.{unit} = b.{unit} and " if unit else ""
    return f"""{name} as (select b.rep, {f'a.{unit}, ' if unit else ''}{', '.join('a.' + c for c in keep)}, {', '.join('b.' + c for c in move)} from
 (select {uu}{key}, {', '.join(keep)}, row_number() over ({pu}order by {key}) as slot from {src}) a join
 (select rep, {uu}{', '.join(move)}, row_number() over (partition by rep{', ' + unit if unit else ''} order by {U(seed, 'rep', key)}, {key}) as slot from {src}, {REPS(n)}) b
 on {on}a.slot = b.slot)"""


def signflip_sql(src, by, d, key, n, seed, side="two"):
    """CTEs ending in sf(by..., n, mean, p)."""
    b = f"{by}, " if by else ""
    j = f"join sfo using ({by})" if by else ", sfo"
    g = f"group by {by}, n" if by else "group by n"
    hit = f"abs(v) >= abs(mean) - {EPS}" if side == "two" else f"v >= mean - {EPS}"
    return f"""sfo as (select {b}avg({d}) as mean, count(*) as n from {src} where {d} is not null {'group by ' + by if by else ''}),
 sfn as (select {b}rep, avg({d} * case when {U(seed, 'rep', key)} < 0.5 then -1 else 1 end) as v from {src}, {REPS(n)} where {d} is not null group by {b}rep),
 sf as (select {b}n, any_value(mean) as mean, (1 + count(*) filter ({hit})) / (1 + count(*)) as p from sfn {j} {g})"""


def wilcoxon_sql(src, by, d, name="wx"):
    b = f"{by}, " if by else ""
    g = f"group by {by}" if by else ""
    return f"""{name}r as (select {b}{d} as dd, {RANK(f'abs({d})', by)} as r, count(*) over (partition by {b}abs({d})) as t from {src} where {d} is not null and {d} <> 0),
 {name} as (select {b}n, w_plus, (w_plus - n * (n + 1) / 4.0::double) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24.0::double - tie / 48.0::double), 0) as z from (
 select {b}count(*)::double as n, sum(case when dd > 0 then r else 0 end) as w_plus, sum(t * t - 1)::double as tie from {name}r {g}))"""


def mw_sql(src, by, x, flag, name="mw"):
    b = f"{by}, " if by else ""
    g = f"group by {by}" if by else ""
    return f"""{name}r as (select {b}{flag} as f, {RANK(x, by)} as r, count(*) over (partition by {b}{x}) as t from {src} where {x} is not null),
 {name} as (select {b}n1, n - n1 as n0, u, sign(u - n1 * (n - n1) / 2) * greatest(abs(u - n1 * (n - n1) / 2) - 0.5, 0) / nullif(sqrt(n1 * (n - n1) / 12 * ((n + 1) - tie / nullif(n * (n - 1), 0))), 0) as z from (
 select {b}count(*) filter (f)::double as n1, count(*)::double as n, sum(r) filter (f) - count(*) filter (f)::double * (count(*) filter (f) + 1) / 2 as u, sum(t * t - 1)::double as tie from {name}r {g}))"""


def boot_draws(src, key, n, seed):
    """CTEs bs(slot, key...) and dr(rep, draw, slot)."""
    return f"""bs as (select *, row_number() over (order by {key}) - 1 as slot from {src}),
 dr as (select rep, draw, floor({U(seed, 'rep', 'draw')} * (select count(*) from bs))::bigint as slot from (select slot as draw from bs), {REPS(n)})"""


BOOT = f"count(v) as n_boot, {R('avg(v)')} as mean, {R('quantile_cont(v, 0.025)')} as lo, {R('quantile_cont(v, 0.975)')} as hi"

# K ---------------------------------------------------------------------------


@query("K1_top_effects", """select l_suppkey, round(d, 4) as d from (select l_suppkey, avg(l_extendedprice) - 50000 as d from lineitem group by 1) order by abs(d) desc, l_suppkey limit 15""")
def _(t):
    d = t.lineitem.groupBy("l_suppkey").agg((F.avg("l_extendedprice") - 50000).alias("d"))
    return sm.top_effects(d, "d", "l_suppkey", 15).select("l_suppkey", F.round("d", 4).alias("d"))


@query("K2_topk_per_group", """select l_suppkey, l_orderkey, l_extendedprice, rank from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) as rank from lineitem) where rank <= 3""")
def _(t):
    d = sm.topk(t.lineitem, ["l_suppkey"], [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey"], 3)
    return d.select("l_suppkey", "l_orderkey", "l_extendedprice", "rank")


@query("K3_argmax", """select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r = 1""")
def _(t):
    return sm.argmax(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("K4_sample_k", f"""with {EV} select user_id, event_id, draw from (select *, row_number() over (partition by user_id order by {U('k4', 'event_id')}, event_id) as draw from ev) where draw <= 10""")
def _(t):
    return sm.sample_k(t.ratings, ["user_id"], "event_id", 10, "k4").select("user_id", "event_id", "draw")


@query("K5_match_counts", f"""with {EV}, d as (select *, row_number() over (partition by user_id, event_type order by {U('k5', 'event_id')}, event_id) as draw from ev where event_type in ('click', 'view')),
 m as (select user_id, least(count(*) filter (event_type = 'click'), count(*) filter (event_type = 'view')) as least_n from ev group by 1)
 select user_id, event_id, event_type, draw from d join m using (user_id) where draw <= least_n""")
def _(t):
    d = sm.match_counts(t.ratings, "user_id", "event_type", ("click", "view"), "event_id", "k5")
    return d.select("user_id", "event_id", "event_type", "draw")


IX = "ix as (select *, row_number() over (partition by user_id order by sec, event_id) - 1 as idx from ev)"


def series(t):
    return tl.numbered(t.ratings, ["user_id"], ["sec", "event_id"], F.col("sec"))


@query("K6_random_window", f"""with {EV}, {IX}, s as (select user_id, floor({U('k6', 'user_id')} * (n - 20 + 1))::bigint as start from (select user_id, count(*) as n from ev group by 1) where n >= 20)
 select user_id, event_id, idx, start from ix join s using (user_id) where idx >= start and idx < start + 20""")
def _(t):
    return sm.random_window(series(t), ["user_id"], "idx", 20, "k6").select("user_id", "event_id", "idx", "start")


@query("K7_random_anchors", f"""with {EV}, s as (select user_id, min(sec) as lo, max(sec) as hi from ev group by 1), n as (select user_id, count(*) as n from ev where event_type = 'purchase' group by 1)
 select user_id, i as anchor, floor((lo + 86400 + {U('k7', 'user_id', 'i')} * (hi - lo - 172800)) * 1000)::bigint as ms from (select user_id, lo, hi, unnest(range(1, n + 1)) as i from s join n using (user_id) where hi - lo > 172800)""")
def _(t):
    d = sm.random_anchors(t.ratings, t.ratings.filter("event_type = 'purchase'"), "user_id", "sec", "k7", 86400.0)
    return d.select("user_id", "anchor", F.floor(F.col("sec") * 1000).alias("ms"))


@query("K8_first_crossing", f"""with g as (select l_suppkey, l_linenumber as x, avg(l_quantity) as y from lineitem group by 1, 2), d as (select *, lag(x) over (partition by l_suppkey order by x) as px, lag(y) over (partition by l_suppkey order by x) as py from g),
 h as (select l_suppkey, arg_min(x, x) as x, arg_min(y, x) as y, min(x) as mx from d where y >= 26 group by 1), j as (select h.l_suppkey, d.x, d.y, d.px, d.py from h join d on d.l_suppkey = h.l_suppkey and d.x = h.mx)
 select a.l_suppkey, {R('case when px is null then x else px + (26 - py) / greatest(y - py, 1e-9) * (x - px) end')} as x_at_level from (select distinct l_suppkey from g) a left join j using (l_suppkey)""")
def _(t):
    g = t.lineitem.groupBy("l_suppkey", F.col("l_linenumber").cast("double").alias("x")).agg(F.avg("l_quantity").alias("y"))
    return rounded(sm.first_crossing(g, ["l_suppkey"], "x", "y", 26.0), "x_at_level")


@query("K9_shift_anchors", f"""with {EV}, s as (select user_id, min(sec) as lo, max(sec) - min(sec) as w from ev group by 1)
 select user_id, event_id, floor((lo + (sec - lo + {U('k9', 'user_id')} * w) % nullif(w, 0)) * 1000)::bigint as ms from ev join s using (user_id) where event_type = 'purchase'""")
def _(t):
    d = sm.shift_anchors(t.ratings, t.ratings.filter("event_type = 'purchase'"), "user_id", "event_id", "sec", "k9")
    return d.select("user_id", "event_id", F.floor(F.col("sec") * 1000).alias("ms"))


@query("K10_match_survivors", f"""with {EV}, n as (select user_id, count(*) as n from ev where event_type = 'error' and value < 60 group by 1),
 c as (select *, row_number() over (partition by user_id order by event_id) as r from ev where event_type = 'view' and value < 60)
 select user_id, event_id from c join n using (user_id) where r <= n""")
def _(t):
    ok = t.ratings.filter("value < 60")
    return sm.match_survivors(ok.filter("event_type = 'error'"), ok.filter("event_type = 'view'"), "user_id", "event_id").select("user_id", "event_id")


# I ---------------------------------------------------------------------------

@query("I1_permute_within", f"""with {EV}, {permuted_cte('p', 'ev', 'user_id', 'event_id', ['event_id', 'k'], ['value'], 3, 'i1')} select rep, event_id, value from p""")
def _(t):
    d = t.ratings.select("user_id", "event_id", "k", "value")
    return rs.permute_within(d, ["user_id"], "event_id", ["value"], 3, "i1").select("rep", "event_id", "value")


@query("I2_permute_free", f"""with {permuted_cte('p', 'orders', '', 'o_orderkey', ['o_orderkey'], ['o_totalprice'], 3, 'i2')} select rep, o_orderkey, o_totalprice from p""")
def _(t):
    d = t.orders.select("o_orderkey", "o_totalprice")
    return rs.permute(d, "o_orderkey", ["o_totalprice"], 3, "i2").select("rep", "o_orderkey", "o_totalprice")


ZV = f"""zv as (select user_id, event_id, event_type, k, round((value - avg(value) over (partition by user_id)) / nullif(stddev_samp(value) over (partition by user_id), 0), 9) as z from ev)"""


def z_values(t):
    d = tl.within_z(t.ratings, ["user_id"], ["value"])
    return d.select("user_id", "event_id", "event_type", "k", F.round("value_z", 9).alias("z"))


@query("I3_icc_permutation", f"""with {EV}, {ZV}, {permuted_cte('p', 'zv', 'user_id', 'event_id', ['event_type'], ['z'], 20, 'i3')},
 {icc_cte('o', 'zv', '', 'event_type', 'z')}, {icc_cte('n', 'p', 'rep', 'event_type', 'z')}
 {perm_sql('(select icc as obs from o)', '(select rep, icc as v from n)', f'v >= obs - {EPS}')}""")
def _(t):
    return rounded(rs.icc_perm(z_values(t), ["user_id"], "event_type", "z", "event_id", 20, "i3"), "obs", "null_mean", "null_sd", "p")


def sp_perm_sql(hit, extra=""):
    return f"""with {EV}, r as (select event_id, {RANK('k')} as rx, {RANK('value')} as ry from ev), {permuted_cte('p', 'r', '', 'event_id', ['ry'], ['rx'], 20, 'i4')},
 o as (select {CORR('rx', 'ry')} as obs from r), n as (select rep, {CORR('rx', 'ry')} as v from p group by 1){extra} """ + perm_sql("o", "n", hit)


@query("I4_spearman_permutation_one_sided", sp_perm_sql(f"v >= obs - {EPS}"))
def _(t):
    return rounded(rs.spearman_perm(t.ratings, "k", "value", "event_id", 20, "i4", "greater"), "obs", "null_mean", "null_sd", "p")


@query("I4_spearman_permutation_two_sided", sp_perm_sql(f"abs(v) >= abs(obs) - {EPS}"))
def _(t):
    return rounded(rs.spearman_perm(t.ratings, "k", "value", "event_id", 20, "i4", "two"), "obs", "null_mean", "null_sd", "p")


@query("I4_spearman_permutation_centred", sp_perm_sql(f"abs(v - (select quantile_cont(v, 0.5) from n)) >= abs(obs - (select quantile_cont(v, 0.5) from n)) - {EPS}"))
def _(t):
    return rounded(rs.spearman_perm(t.ratings, "k", "value", "event_id", 20, "i4", centred=True), "obs", "null_mean", "null_sd", "p")


DIFF = """df as (select user_id, event_type, event_id, round(value - avg(value) over (partition by event_type) + 1, 9) as d from ev)"""


def diffs(t):
    m = t.ratings.groupBy("event_type").agg(F.avg("value").alias("_m"))
    return t.ratings.join(m, "event_type").select("user_id", "event_type", "event_id", F.round(F.col("value") - F.col("_m") + 1, 9).alias("d"))


@query("I5_signflip", f"with {EV}, {DIFF}, " + signflip_sql("df", "event_type", "d", "event_id", 20, "i5") + f" select event_type, n, {R('mean')} as mean, {R('p')} as p from sf")
def _(t):
    return rounded(rs.signflip(diffs(t), ["event_type"], "d", "event_id", 20, "i5"), "mean", "p")


@query("I6_signflip_max", f"""with {EV}, c as (select user_id, floor(sec / 432000)::bigint as t, value - (select avg(value) from ev) as x from ev), m as (select user_id, t, avg(x) as v from c group by 1, 2),
 o as (select t, abs(avg(v)) / greatest(stddev_samp(v) / sqrt(count(*)), 1e-18) as tt from m group by 1),
 f as (select user_id, rep, case when {U('i6', 'rep', 'user_id')} < 0.5 then -1 else 1 end as s from (select distinct user_id from m), {REPS(30)}),
 n as (select rep, max(tt) as v from (select rep, t, abs(avg(v * s)) / greatest(stddev_samp(v * s) / sqrt(count(*)), 1e-18) as tt from m join f using (user_id) group by 1, 2) group by 1),
 q as (select max(tt) as obs, arg_max(t, (round(tt, 9), -t)) as at_t from o)
 select {R('any_value(obs)')} as obs, any_value(at_t) as at_t, {R('quantile_cont(v, 0.95)')} as null_p95, count(*) as n_null, {R(f'(1 + count(*) filter (v >= obs - {EPS})) / (1 + count(*))')} as p from n, q""")
def _(t):
    from ..functions.core import with_row
    d = with_row(t.ratings, t.ratings.agg(F.avg("value").alias("_m"))).select(
        "user_id", F.floor(F.col("sec") / 432000).alias("t"), (F.col("value") - F.col("_m")).alias("x"))
    return rounded(rs.signflip_max(d, "user_id", "t", "x", 30, "i6"), "obs", "null_p95", "p")


LONG = "(select {by}k, unnest(['sec', 'value']) as measure, unnest([sec, value]) as x from {src})"


@query("I7_icc_max_null", f"""with e0 as (select event_id, event_type, value, cast(regexp_extract(props, '([0-9]+)', 1) as double) as sec, user_id % 40 as k from events),
 {permuted_cte('p', 'e0', '', 'event_id', ['sec', 'value'], ['k'], 10, 'i7')},
 {icc_cte('o', LONG.format(by='', src='e0'), 'measure', 'k', 'x')}, {icc_cte('n', LONG.format(by='rep, ', src='p'), 'rep, measure', 'k', 'x')},
 b as (select max(icc) as obs, arg_max(measure, (round(icc, 9), measure)) as best from o), m as (select rep, max(icc) as v from n group by 1)
 select {R('any_value(obs)')} as obs, {R('avg(v)')} as null_mean, {R('stddev_pop(v)')} as null_sd, count(*) as n_null, {R(f'(1 + count(*) filter (v >= obs - {EPS})) / (1 + count(*))')} as p, any_value(best) as best from m, b""")
def _(t):
    d = t.ratings.select("event_id", "value", F.col("k").cast("double").alias("sec"), (F.col("user_id") % 40).alias("k"))
    return rounded(rs.icc_max_null(d, "k", ["sec", "value"], "event_id", 10, "i7"), "obs", "null_mean", "null_sd", "p")


@query("I8_boot_spearman", f"""with {OL}, {boot_draws('(select o_orderkey, x, y from ol)', 'o_orderkey', 15, 'i8')}, b as (select rep, x, y from dr join bs using (slot)),
 {sp_cte('s', 'b', 'rep', 'x', 'y')} select {BOOT} from (select rho as v from s)""")
def _(t):
    return rounded(rs.boot_spearman(t.orders_lines, "x", "y", "o_orderkey", 15, "i8"), "mean", "lo", "hi")


@query("I9_boot_cluster", f"""with d as (select l_partkey % 50 as item, l_extendedprice / 1000.0::double as x from lineitem), {boot_draws('(select distinct item from d)', 'item', 40, 'i9')},
 b as (select rep, draw, x from dr join bs using (slot) join d using (item)), {icc_cte('c', 'b', 'rep', 'draw', 'x')} select {BOOT} from (select icc as v from c)""")
def _(t):
    d = t.lineitem.select((F.col("l_partkey") % 50).alias("item"), (F.col("l_extendedprice") / 1000.0).alias("x"))
    return rounded(rs.boot_cluster(d, "item", "x", 40, "i9"), "mean", "lo", "hi")


BG = f"""d as (select event_id % 4 as axis, event_id // 4 as clip, value as y, k::double as a, k + value / 10.0::double as ad from ev),
 {boot_draws('(select distinct clip from d)', 'clip', 10, 'i10')}, b as (select rep, draw, axis, y, a, ad from dr join bs using (slot) join d using (clip)),
 {sp_cte('ra', 'b', 'rep, axis', 'y', 'a')}, {sp_cte('rb', 'b', 'rep, axis', 'y', 'ad')}, g as (select ra.rep, ra.axis, rb.rho - ra.rho as v from ra join rb on ra.rep = rb.rep and ra.axis = rb.axis)"""


def gain_input(t):
    return t.ratings.select((F.col("event_id") % 4).alias("axis"), F.floor(F.col("event_id") / 4).alias("clip"), F.col("value").alias("y"),
                            F.col("k").cast("double").alias("a"), (F.col("k") + F.col("value") / 10.0).alias("ad"))


@query("I10_boot_gain", f"with {EV}, {BG} select axis, {BOOT} from g group by 1")
def _(t):
    return rounded(rs.boot_gain(gain_input(t), "axis", "clip", "y", "a", "ad", 0, 10, "i10")[0], "mean", "lo", "hi")


@query("I10_boot_gain_contrast", f"""with {EV}, {BG}, c as (select rep, avg(v) filter (axis = 0) - avg(v) filter (axis <> 0) as v from g group by 1) select {BOOT}, quantile_cont(v, 0.025) > 0 as separated from c""")
def _(t):
    return rounded(rs.boot_gain(gain_input(t), "axis", "clip", "y", "a", "ad", 0, 10, "i10")[1], "mean", "lo", "hi")


@query("I11_circular_shift", f"""with {EV}, {IX}, r as (select user_id, idx, {RANK('k', 'user_id')} as rx, {RANK('value', 'user_id')} as ry from ix), z as (select user_id, count(*) as n from ev group by 1 having count(*) > 10),
 s as (select user_id, rep, n, 5 + floor({U('i11', 'rep', 'user_id')} * (n - 10))::bigint as sh from z, {REPS(20)}),
 v as (select a.user_id, s.rep, abs({CORR('a.rx', 'b.ry')}) as v from r a join s using (user_id) join r b on b.user_id = a.user_id and b.idx = (a.idx + sh) % n group by 1, 2),
 o as (select user_id, {CORR('rx', 'ry')} as obs from r group by 1), q as (select user_id, quantile_cont(v, 0.95) as q, count(v) as n from v group by 1)
 select user_id, {R('obs')} as obs, {R('q')} as null_p95, n as n_null, abs(obs) > q as above from o join q using (user_id)""")
def _(t):
    return rounded(rs.circular_shift(series(t), ["user_id"], "idx", "k", "value", 20, "i11", 5), "obs", "null_p95")


def mismatch_sql(pool):
    owner = "user_id % 10" if pool == "own" else "0"
    return f"""with {EV}, {IX}, n0 as (select distinct user_id, {owner} as ow from ev), sl as (select *, row_number() over (partition by ow order by user_id) - 1 as slot, count(*) over (partition by ow) as k from n0),
 r0 as (select user_id, ow, rep, floor({U('i12', 'rep', 'user_id')} * k)::bigint as slot from sl, {REPS(10)}),
 r as (select r0.rep, r0.user_id, sl.user_id as partner from r0 join sl on sl.slot = r0.slot and sl.ow = r0.ow where sl.user_id <> r0.user_id),
 m as (select rep, r.user_id, a.k as x, b.value as y from r join ix b on b.user_id = r.user_id join ix a on a.user_id = r.partner and a.idx = b.idx),
 {sp_cte('s', 'm', 'rep, user_id', 'x', 'y')}, n as (select rep, avg(rho) as v from s group by 1), {sp_cte('so', 'ix', 'user_id', 'k', 'value')}, o as (select avg(rho) as obs from so) """ + perm_sql(
        "o", "n", f"abs(v - (select quantile_cont(v, 0.5) from n)) >= abs(obs - (select quantile_cont(v, 0.5) from n)) - {EPS}")


@query("I12_mismatch_null", mismatch_sql("all"))
def _(t):
    return rounded(rs.mismatch_null(series(t), "user_id", "idx", "k", "value", 10, "i12"), "obs", "null_mean", "null_sd", "p")


@query("I12_mismatch_null_own", mismatch_sql("own"))
def _(t):
    d = series(t).withColumn("owner", F.col("user_id") % 10)
    return rounded(rs.mismatch_null(d, "user_id", "idx", "k", "value", 10, "i12", "own", "owner"), "obs", "null_mean", "null_sd", "p")


def phase_sql(reps, seed):
    """Transform, turned frequencies and the way back as sums over (time, frequency)."""
    angle = "2 * pi() * ((t * f) % n) / n"
    return f"""with {EV}, {IX}, s as (select user_id, idx as t, k::double as x, value as y, count(*) over (partition by user_id) as n from ix),
 fr as (select user_id, n, unnest(range(n)) as f from (select distinct user_id, n from s)),
 sp as (select user_id, n, f, sum(x * cos({angle})) as re, -sum(x * sin({angle})) as im from s join fr using (user_id, n) group by 1, 2, 3),
 ph as (select user_id, n, f, rep, re, im, sqrt(re * re + im * im) as a, 2 * pi() * {U(seed, 'user_id', 'rep', 'least(f, n - f)')} * case when 2 * f < n then 1 else -1 end as u from sp, {REPS(reps)}),
 tu as (select user_id, n, f, rep, case when f = 0 or 2 * f = n then re else a * cos(u) end as re, case when f = 0 or 2 * f = n then im else a * sin(u) end as im from ph),
 m as (select user_id, rep, t, round(sum(re * cos({angle}) - im * sin({angle})) / any_value(n), 9) as x, any_value(y) as y from tu join s using (user_id, n) group by 1, 2, 3),
 {sp_cte('s1', 'm', 'rep, user_id', 'x', 'y')}, n as (select rep, avg(rho) as v from s1 group by 1), {sp_cte('so', 's', 'user_id', 'x', 'y')}, o as (select avg(rho) as obs from so) """ + perm_sql(
        "o", "n", f"abs(v - (select quantile_cont(v, 0.5) from n)) >= abs(obs - (select quantile_cont(v, 0.5) from n)) - {EPS}")


@query("I13_phase_null", phase_sql(10, "i13"))
def _(t):
    d = series(t).select("user_id", "idx", F.col("k").cast("double").alias("k"), "value")
    return rounded(rs.phase_null(d, "user_id", "idx", "k", "value", 10, "i13"), "obs", "null_mean", "null_sd", "p")


W0 = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]


@query("I14_direction_null", f"""with e as (select vec_id, label, i, embedding[i + 1]::double as x from embeddings, (select unnest(range(64)) as i)),
 w0 as (select rep, i, {NORMAL('i14', 'rep', 'i')} as w from {REPS(30)}, (select unnest(range(64)) as i)), w as (select rep, i, w / sqrt(sum(w * w) over (partition by rep)) as w from w0),
 p as (select rep, vec_id, any_value(label) as y, round(sum(x * w), 9) as x from e join w using (i) group by 1, 2), {sp_cte('s', 'p', 'rep', 'x', 'y')},
 q as (select vec_id, any_value(label) as y, round(sum(x * case when i % 3 = 0 then 1 else -0.5 end), 9) as x from e group by 1), {sp_cte('o', 'q', '', 'x', 'y')}
 select {R('any_value(o.rho)')} as obs, {R('avg(abs(s.rho))')} as null_mean, count(*) as n_null, {R('avg((abs(s.rho) < abs(o.rho))::int)')} as percentile from s, o""")
def _(t):
    return rounded(rs.direction_null(t.embeddings, "embedding", 64, "label", W0, "vec_id", 30, "i14"), "obs", "null_mean", "percentile")


PV = f"pv as (select o_custkey, o_custkey % 3 as fam, round(exp(-abs(avg(o_totalprice) - 250000) / 30000.0::double), 6) as p from orders group by 1)"


def p_values(t):
    g = t.orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("_a"))
    return g.select("o_custkey", (F.col("o_custkey") % 3).alias("fam"), F.round(F.exp(-F.abs(F.col("_a") - 250000) / 30000.0), 6).alias("p"))


RK = "rk as (select *, row_number() over (partition by fam order by p, o_custkey) as r, count(*) over (partition by fam) as m from pv)"


@query("I15_bh_raw", f"with {PV}, {RK} select o_custkey, {R('least(p * m / r, 1)')} as q from rk")
def _(t):
    return rounded(rs.bh(p_values(t), ["fam"], "p", "o_custkey", "raw").select("o_custkey", "q"), "q")


@query("I15_bh_monotone", f"with {PV}, {RK} select o_custkey, {R('least(min(p * m / r) over (partition by fam order by r desc rows between unbounded preceding and current row), 1)')} as q from rk")
def _(t):
    return rounded(rs.bh(p_values(t), ["fam"], "p", "o_custkey", "monotone").select("o_custkey", "q"), "q")


@query("I15_bh_mask", f"with {PV}, {RK} select o_custkey, r <= coalesce(max(case when p * m / r <= 0.3 then r end) over (partition by fam), 0) as significant from rk")
def _(t):
    return rs.bh(p_values(t), ["fam"], "p", "o_custkey", "mask", 0.3).select("o_custkey", "significant")


@query("I16_wilcoxon", f"with {EV}, {DIFF}, {wilcoxon_sql('df', 'event_type', 'd')} select event_type, n::bigint as n, {R('w_plus')} as w_plus, {R('z')} as z from wx")
def _(t):
    return rounded(rs.wilcoxon(diffs(t), ["event_type"], "d"), "w_plus", "z")


@query("I17_mannwhitney", f"with {EV}, {mw_sql('ev', 'event_type', 'value', 'k < 30')} select event_type, n1::bigint as n1, n0::bigint as n0, {R('u')} as u, {R('z')} as z from mw")
def _(t):
    return rounded(rs.mannwhitney(t.ratings, ["event_type"], "value", F.col("k") < 30), "u", "z")


@query("I17_mannwhitney_p")
def _(t):
    d = rs.mannwhitney(t.ratings, ["event_type"], "value", F.col("k") < 30)
    return rounded(st.with_p(d), "u", "z", "p")


#: Null counts by recursion over the ranks; the two-sided p of a rank sum.
SIGNED_NULL = """sr(n, l) as (select 0, [1.0::double] union all
 select n + 1, [case when i < len(l) then l[i + 1] else 0 end + case when i > n then l[i - n] else 0 end for i in range(len(l) + n + 1)] from sr where n < 50)"""
CHOICE_NULL = """rs(r, l) as (select 0, [case when i = 0 then 1.0::double else 0 end for i in range(9 * 5051)] union all
 select r + 1, [l[i + 1] + case when i >= 5052 + r then l[i + 1 - 5052 - r] else 0 end for i in range(9 * 5051)] from rs where r < 100)"""


@query("I16_wilcoxon_exact", f"""with recursive {EV}, {SIGNED_NULL}, d as (select user_id, k, value - 50 as d from ev),
 r as (select user_id, k, d, rank() over (partition by user_id, k order by abs(d)) as r from d where d <> 0),
 s as (select user_id, k, count(*) as n, count(distinct abs(d)) as apart, sum(case when d > 0 then r else 0 end) as w from r group by 1, 2),
 z as (select user_id, k, count(*) filter (d = 0) as zero from d group by 1, 2)
 select user_id, k, s.n, case when zero = 0 and apart = s.n and s.n <= 50 then {R('least(1, 2 * list_sum(l[1:(least(w, s.n * (s.n + 1) // 2 - w) + 1)::int]) / list_sum(l))')} end as p_exact from s join z using (user_id, k) left join sr on sr.n = s.n""")
def _(t):
    d = t.ratings.select("user_id", "k", (F.col("value") - 50).alias("d"))
    return rounded(rs.wilcoxon_exact(d, ["user_id", "k"], "d").select("user_id", "k", "n", "p_exact"), "p_exact")


@query("I17_mannwhitney_exact", f"""with recursive {EV}, {CHOICE_NULL}, v as (select user_id, value, event_type = 'purchase' as f from ev),
 r as (select *, rank() over (partition by user_id order by value) as r from v),
 s as (select user_id, count(*) filter (f) as n1, count(*) filter (not f) as n0, count(distinct value) as apart, sum(r) filter (f) as rsum from r group by 1),
 u as (select *, least(n1, n0) as m, case when apart = n1 + n0 and least(n1, n0) between 1 and 8 and n1 + n0 <= 100 then rsum - n1 * (n1 + 1) // 2 end as u from s),
 c as (select user_id, n1, n0, u, m, l[(m * 5051 + m * (m + 1) // 2 + 1)::int:(m * 5051 + m * (m + 1) // 2 + n1 * n0 + 1)::int] as l from u left join rs on rs.r = n1 + n0 and u is not null)
 select user_id, n1, n0, case when l is not null then {R('least(1, 2 * list_sum(l[1:(least(u, n1 * n0 - u) + 1)::int]) / list_sum(l))')} end as p_exact from c""")
def _(t):
    d = t.ratings.select("user_id", "value", (F.col("event_type") == "purchase").alias("f"))
    return rounded(rs.mannwhitney_exact(d, ["user_id"], "value", "f").select("user_id", "n1", "n0", "p_exact"), "p_exact")


@query("I18_pooled_vs_unit", f"""with {EV}, md as (select user_id, quantile_cont(k, 0.5) as u, (select quantile_cont(k, 0.5) from ev) as g from ev group by 1),
 s as (select user_id, k > g as hg, k > u as hw, unnest(['hour', 'value']) as feature, unnest([round(sec / 3600, 6) % 24, value]) as x from ev join md using (user_id)),
 {mw_sql('s', 'feature', 'x', 'hg', 'ma')}, {mw_sql('s', 'feature', 'x', 'hw', 'mb')},
 u as (select feature, user_id, avg(x) filter (hw) - avg(x) filter (not hw) as d from s group by 1, 2 having count(*) filter (hw) >= 5 and count(*) filter (not hw) >= 5),
 {wilcoxon_sql('u', 'feature', 'd', 'wc')} select feature, {R('ma.z')} as z_a, {R('mb.z')} as z_b, wc.n::bigint as n_units, {R('wc.z')} as z_c from ma join mb using (feature) join wc using (feature)""")
def _(t):
    d = t.ratings.withColumn("hour", F.round(F.col("sec") / 3600, 6) % 24)
    return rounded(rs.pooled_vs_unit(d, "user_id", "k", ["hour", "value"], 5), "z_a", "z_b", "z_c")


PR = """n0 as (select *, row_number() over (partition by user_id, event_type order by sec, event_id) as trial from ev where event_type in ('purchase', 'view')),
 pr as (select user_id, user_id || ':' || trial as id, round(max(value) filter (event_type = 'purchase') - max(value) filter (event_type = 'view') + 12, 9) as d from n0 group by user_id, trial having count(distinct event_type) = 2)"""


def pairs(t):
    from ..operators.joins import paired_diff
    d = t.ratings.filter(F.col("event_type").isin("purchase", "view"))
    d = row_numbers(d, ["user_id", "event_type"], ["sec", "event_id"], F.col("sec"), "trial")
    p = paired_diff(d, ["user_id", "trial"], "event_type", "purchase", "view", "value")
    return p.select("user_id", F.concat_ws(":", "user_id", "trial").alias("id"), F.round(F.col("d") + 12, 9).alias("d"))


@query("I19_positive_control", f"""with {EV}, {PR}, e as (select * from pr where user_id in (select user_id from pr group by 1 having count(*) >= 5)), {signflip_sql('e', 'user_id', 'd', 'id', 20, 'i19')},
 c0 as (select user_id, value, row_number() over (partition by user_id order by {U('i19', "'half'", 'event_id')}, event_id) as rn, count(*) over (partition by user_id) // 2 as h from ev where event_type = 'view'),
 c1 as (select user_id, case when rn <= h then rn else rn - h end as slot, h, max(value) filter (rn <= h) - max(value) filter (rn > h) as d from c0 where rn <= 2 * h group by 1, 2, 3),
 c as (select user_id, user_id || ':' || slot as id, d from c1 where h >= 5), {signflip_sql('c', 'user_id', 'd', 'id', 20, 'i19').replace('sfo', 'cfo').replace('sfn', 'cfn').replace(' sf as', ' cf as')}
 select user_id, n, {R('mean')} as mean, {R('p')} as p, 'effect' as arm from sf union all select user_id, n, {R('mean')}, {R('p')}, 'false_positive' from cf""")
def _(t):
    c = t.ratings.filter("event_type = 'view'").select("user_id", "event_id", "value")
    p = pairs(t).withColumnRenamed("id", "event_id")
    d = rs.positive_control(p, c, "user_id", "d", "value", "event_id", 20, "i19", 5)
    return rounded(d, "mean", "p")


def curve_sql(src, seed, grid, reps, perms):
    return f"""sz as (select user_id, count(*) as nn from {src} group by 1), s0 as (select p.*, tr, row_number() over (partition by user_id, tr order by {U(seed, "'sub'", 'tr', 'id')}, id) as r from {src} p, (select unnest(range({reps})) as tr)),
 s1 as (select s0.user_id, tr, r, d, d * case when {U(seed, "'null'", 'id')} < 0.5 then -1 else 1 end as z, g from s0 join sz using (user_id), (select unnest({grid}) as g) where r <= g and nn >= g),
 ob as (select g, user_id, tr, abs(avg(d)) as o, abs(avg(z)) as oz from s1 group by 1, 2, 3),
 nu as (select g, user_id, tr, rep, abs(avg(d * s)) as v, abs(avg(z * s)) as vz from (select *, case when {U(seed, 'rep', 'r')} < 0.5 then -1 else 1 end as s from s1, {REPS(perms)}) group by 1, 2, 3, 4),
 pp as (select g, user_id, tr, (1 + count(*) filter (v >= o - {EPS})) / (1.0::double + {perms}) as p, (1 + count(*) filter (vz >= oz - {EPS})) / (1.0::double + {perms}) as pz from nu join ob using (g, user_id, tr) group by 1, 2, 3),
 un as (select g, user_id, avg((p < 0.05)::int) as de, avg((pz < 0.05)::int) as fp from pp group by 1, 2)"""


CURVE = f"select g as n, count(*) as n_units, {R('avg(de)')} as detect, {R('stddev_pop(de)')} as detect_sd, {R('avg(fp)')} as false_pos"


@query("I20_detection_curve", f"with {EV}, {PR}, {curve_sql('pr', 'i20', [4, 8], 3, 39)} {CURVE} from un group by 1")
def _(t):
    return rounded(rs.detection_curve(pairs(t), "user_id", "d", "id", [4, 8], 3, 39, "i20"), "detect", "detect_sd", "false_pos")


@query("I21_half_cross", f"""with {EV}, {PR}, hf as (select *, row_number() over (partition by user_id order by {U('i21', "'half'", 'id')}, id) as rn, count(*) over (partition by user_id) // 2 as h from pr),
 bb as (select user_id, id, d from hf where rn > h), es as (select avg(d) / (stddev_samp(d) + 1e-12) as e from hf where rn <= h group by user_id),
 {curve_sql('bb', 'i21', [3, 5], 3, 39)} {CURVE}, (select {R('avg(e)')} from es) as d_half, (select count(e) from es) as n_half from un group by 1""")
def _(t):
    return rounded(rs.half_cross(pairs(t), "user_id", "d", "id", [3, 5], 3, 39, "i21"), "detect", "detect_sd", "false_pos", "d_half")


@query("I22_planted_power", f"""with {EV}, sz as (select k as item, count(*) as n from ev group by 1),
 e as (select item, sim, g, {NORMAL('i22', "'mu'", 'sim', 'item')} * sqrt(g) + {NORMAL('i22', "'e'", 'sim', 'item', 'j')} * sqrt(1 - g) as x from (select item, unnest(range(1, n + 1)) as j from sz), (select unnest(range(5)) as sim), (select unnest([0.0::double, 0.1::double, 0.3::double]) as g)),
 {icc_cte('c', 'e', 'g, sim', 'item', 'x')} select g as true_icc, count(icc) as n_sims, {R('avg(icc)')} as mean_icc, {R('avg((icc > 0.05)::int)')} as power from c group by 1""")
def _(t):
    s = t.ratings.groupBy(F.col("k").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(rs.planted_power(s, "item", [0.0, 0.1, 0.3], 5, "i22", 0.05), "mean_icc", "power")


def oc_rel(src, value, tag, where="true"):
    s = f"oc_{tag}"
    return f"""{s}x as (select k, event_id, {value} as v from {src} where {where} and {value} is not null), {s}z as (select k, count(*) as size from {s}x group by 1),
 {s}r as (select x.*, rep, size, row_number() over (partition by rep, k order by {U('i23', 'rep', 'event_id')}, event_id) as rn from {s}x x join {s}z using (k), {REPS(5)} where size >= 2),
 {s}m as (select rep, k, avg(v) filter (rn <= size // 2) as a, avg(v) filter (rn > size // 2 and rn <= 2 * (size // 2)) as b from {s}r group by 1, 2),
 {sp_cte(s + 's', s + 'm', 'rep', 'a', 'b')}, {s} as (select avg(2 * rho / (1 + rho)) as v from {s}s where n >= 3 and rho > -1)"""


@query("I23_order_confound", f"""with {EV}, d0 as (select *, {RANK('sec', 'user_id')} / count(*) over (partition by user_id) as pos from ev),
 f as (select regr_slope(value, pos) as b, regr_intercept(value, pos) as a from d0), d as (select d0.*, round(a + b * pos, 9) as fit, round(value - a - b * pos, 9) as res from d0, f),
 {permuted_cte('p', 'd', '', 'event_id', ['k'], ['pos'], 10, 'i23')}, {icc_cte('o', 'd', '', 'k', 'pos')}, {icc_cte('n', 'p', 'rep', 'k', 'pos')},
 {oc_rel('d', 'value', 'all')}, {oc_rel('d', 'value', 'late', 'pos > 0.5')}, {oc_rel('d', 'value', 'early', 'pos <= 0.5')}, {oc_rel('d', 'res', 'residual')}, {oc_rel('d', 'fit', 'position_only')}
 select 'position_icc' as test, {R('icc')} as value from o union all select 'position_icc_p', {R(f'(1 + count(*) filter (n.icc >= o.icc - {EPS})) / (1 + count(*))')} from n, o
 """ + " ".join(f"union all select '{g}', {R('v')} from oc_{g}" for g in ("all", "late", "early", "residual", "position_only")))
def _(t):
    return rounded(rs.order_confound(t.ratings, "user_id", "k", "value", "sec", "event_id", 10, 5, "i23"), "value")
