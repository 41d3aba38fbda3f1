"""Per-unit slope queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import normal, r4
from ..operators import slopes as sl
from ..operators import timeline as tl
from .registry import EV, NORMAL, OL, R, R4, RANK, REPS, U, query
from .resampling import EPS, PR, pairs, permuted_cte, signflip_sql
from .stats import rounded, sp_cte

G = 200  # grid points of the registered queries


def rounded4(df, *cols):
    return df.withColumns({c: r4(c) for c in cols})


def slope_cte(name, src, by, x, y, extra=0):
    return f"""{name} as (select *, case when ok then sxy / sxx end as b, case when ok then sqrt(greatest(syy - sxy / sxx * sxy, 0) / (n - 2 - {extra}) / sxx) end as se,
 case when ok then sqrt(greatest(syy - sxy / sxx * sxy, 0) / n) end as resid_sd, sxx / n as var_x, syy / n as var_y from (
 select *, n >= 4 and n - 2 - {extra} >= 2 and sxx / n >= 1e-18 as ok from (
 select {by}, count(*) as n, regr_sxx({y}, {x}) as sxx, regr_sxy({y}, {x}) as sxy, regr_syy({y}, {x}) as syy from {src} where {x} is not null and {y} is not null group by {by})))"""


def tau_cte(name, src, by, b="b", se="se", grid=G, min_units=5):
    """CTE with by..., n_units, tau, lo, hi, beta."""
    k = by or "al"
    s0 = f"(select *, 0 as al from {src})" if not by else src
    p = name
    return f"""{p}d as (select {k}, {b} as b, {se} * {se} as v from {s0} where {b} is not null and {se} > 0),
 {p}c as (select {k}, count(*) as n_units, greatest(var_samp(b) * 20, 1e-6) as hi from {p}d group by {k} having count(*) >= {min_units}),
 {p}g as (select {k}, n_units, j, case when j = 0 then 0.0::double else exp(ln(1e-10::double) + (j - 1) / {float(grid - 1)}::double * (ln(hi) - ln(1e-10::double))) end as t from {p}c, (select unnest(range({grid + 1})) as j)),
 {p}s as (select {k}, j, any_value(t) as t, any_value(n_units) as n_units, sum(1 / (v + t)) as sw, sum(b / (v + t)) as swb, sum(b * b / (v + t)) as swbb, sum(ln(1 / (v + t))) as slw from {p}d join {p}g using ({k}) group by {k}, j),
 {p}l as (select *, round(0.5 * slw - 0.5 * (swbb - swb * swb / sw) - 0.5 * ln(sw), 9) as ll from {p}s),
 {p}t as (select {k}, max(ll) as mx, arg_max(j, (ll, -j)) as jh from {p}l group by {k}),
 {p}x as (select *, lag(gg) over o as pg, lag(t) over o as pt, lag(ll) over o - 2 * ll + lead(ll) over o as bend, lag(ll) over o - lead(ll) over o as tilt, lead(t) over o as nt from (select *, 2 * (mx - ll) - 3.841458820694124 as gg from {p}l join {p}t using ({k})) window o as (partition by {k} order by j)),
 {p} as (select {k}, any_value(n_units) as n_units, sqrt(max(t * exp(coalesce(case when j >= 2 and bend < -1e-4 then 0.5::double * tilt / bend * ln(nt / nullif(t, 0)) end, 0))) filter (j = jh)) as tau, max(swb / sw) filter (j = jh) as beta,
 sqrt(coalesce(max(pt + (t - pt) * pg / nullif(pg - gg, 0)) filter (j <= jh and pg > 0 and gg <= 0), 0)) as lo,
 sqrt(coalesce(min(pt + (t - pt) * pg / nullif(pg - gg, 0)) filter (j > jh and pg <= 0 and gg > 0), max(t))) as hi from {p}x group by {k})"""


@query("M3_slope_se", f"""with {OL}, {slope_cte('s', 'ol', 'o_custkey', 'x', 'y')} select o_custkey, n, {R('b')} as b, {R('se')} as se, {R('resid_sd')} as resid_sd, {R('var_x')} as var_x from s""")
def _(t):
    return rounded(sl.slope_se(t.orders_lines, ["o_custkey"], "x", "y").drop("var_y"), "b", "se", "resid_sd", "var_x")


@query("M3_slope_se_extra_df", f"""with {OL}, {slope_cte('s', 'ol', 'o_custkey', 'x', 'y', 2)} select o_custkey, n, {R('b')} as b, {R('se')} as se from s""")
def _(t):
    return rounded(sl.slope_se(t.orders_lines, ["o_custkey"], "x", "y", 2).select("o_custkey", "n", "b", "se"), "b", "se")


@query("M4_slope_split_half", f"""with {EV}, z as (select user_id, count(*) as n from ev group by 1 having count(*) >= 12),
 r as (select ev.user_id, split, k, value, n, row_number() over (partition by split, ev.user_id order by {U('m4', 'split', 'event_id')}, event_id) as rn from ev join z using (user_id), (select unnest(range(4)) as split)),
 s as (select split, user_id, regr_slope(value, k) filter (rn <= n // 2) as a, regr_slope(value, k) filter (rn > n // 2) as b from r group by 1, 2), sv as (select * from s where a is not null and b is not null and not isnan(a) and not isnan(b)),
 {sp_cte('p', 'sv', 'split', 'a', 'b')}, o as (select avg(rho) as obs from p), la as (select user_id, {RANK('a')} as ra, {RANK('b')} as rb from sv where split = 3),
 {permuted_cte('pm', 'la', '', 'user_id', ['ra'], ['rb'], 20, 'm4-null')}, n as (select rep, corr(ra, rb) as v from pm group by 1)
 select {R('any_value(obs)')} as obs, {R('avg(v)')} as null_mean, {R('stddev_pop(v)')} as null_sd, count(*) as n_null, {R(f'(1 + count(*) filter (v >= obs - {EPS})) / (1 + count(*))')} as p, (select count(*) from la) as n_units from n, o""")
def _(t):
    d = sl.slope_split_half(t.ratings, "user_id", "k", "value", "event_id", 4, 20, "m4", 12)
    return rounded(d, "obs", "null_mean", "null_sd", "p")


@query("M5_personalisation_gain", f"""with {EV}, w as (select user_id, k::double as x, value as y from ev),
 u as (select user_id, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x*x) as sxx, sum(x*y) as sxy from w group by 1), tt as (select sum(n) as n, sum(sx) as sx, sum(sy) as sy, sum(sxx) as sxx, sum(sxy) as sxy from u),
 p as (select user_id, u.n, u.sx, u.sy, u.sxx, u.sxy, ((tt.n-u.n)*(tt.sxy-u.sxy) - (tt.sx-u.sx)*(tt.sy-u.sy)) / nullif((tt.n-u.n)*(tt.sxx-u.sxx) - (tt.sx-u.sx)**2, 0) as pop from u, tt where u.n >= 12),
 e as (select user_id, y - (sy - y)/(n-1) as dy, x - (sx - x)/(n-1) as dx, pop, ((n-1)*(sxy - x*y) - (sx-x)*(sy-y)) / nullif((n-1)*(sxx - x*x) - (sx-x)**2, 0) as s from w join p using (user_id)),
 g as (select user_id, round(avg((dy - pop*dx)**2) - avg((dy - s*dx)**2), 9) as gain from e where s is not null group by 1), {signflip_sql('g', '', 'gain', 'user_id', 50, 'm5', 'greater')}
 select n, {R('mean')} as mean, {R('p')} as p from sf""")
def _(t):
    return rounded(sl.personalisation_gain(t.ratings, "user_id", "k", "value", 12, 50, "m5"), "mean", "p")


# Slopes with a planted spread between units, so that the likelihood has an interior peak.
CELLS = f"(select o_orderpriority as cell, o_custkey % 40 as unit, x, y + 25.0::double * {NORMAL('plant', 'o_orderpriority', 'o_custkey % 40')} * x as y from ol)"


def cells(t):
    u = F.col("o_custkey") % 40
    return t.orders_lines.select(F.col("o_orderpriority").alias("cell"), u.alias("unit"), "x",
                                 (F.col("y") + 25.0 * normal("plant", "o_orderpriority", u) * F.col("x")).alias("y"))


@query("M6_tau_profile", f"""with {OL}, {slope_cte('s', CELLS, 'cell, unit', 'x', 'y')}, {tau_cte('t', 's', 'cell')}
 select cell, n_units, {R4('tau')} as tau, {R4('lo')} as lo, {R4('hi')} as hi, {R4('beta')} as beta from t""")
def _(t):
    s = sl.slope_se(cells(t), ["cell", "unit"], "x", "y")
    return rounded4(sl.tau_profile(s, ["cell"], grid=G), "tau", "lo", "hi", "beta")


M7 = f"""u0 as (select o_custkey % 40 as unit, o_orderkey, x, y from ol), {slope_cte('s', 'u0', 'unit', 'x', 'y')}, {tau_cte('t', 's', '')},
 md as (select quantile_cont(n, 0.5) as n_med, quantile_cont(resid_sd, 0.5) as resid_sd, quantile_cont(var_x, 0.5) as var_x, quantile_cont(se, 0.5) as breakeven from s where se > 0),
 ob as (select t.*, n_med, resid_sd, var_x, breakeven from t, md),
 si as (select rep, unit, x, beta * (x - mx) + resid_sd * {NORMAL('m7', 'rep', 'o_orderkey')} as y from (select *, avg(x) over (partition by unit) as mx from u0), ob, {REPS(6)}),
 {slope_cte('ns', 'si', 'rep, unit', 'x', 'y')}, nz as (select rep, unit, b / (sqrt(var_y) + 1e-9) as b, se / (sqrt(var_y) + 1e-9) as se from ns), {tau_cte('nt', 'nz', 'rep')},
 nl as (select quantile_cont(tau, 0.5) as null_, count(*) as n_null, 1.253 * stddev_samp(tau) / sqrt(count(*)) as mc_se from nt)"""


def m7(t):
    d = t.orders_lines.select((F.col("o_custkey") % 40).alias("unit"), "o_orderkey", "x", "y")
    return sl.tau_null(d, "unit", "x", "y", "o_orderkey", 6, "m7", grid=G)


@query("M7_tau_null", f"""with {OL}, {M7} select n_units, {R4('tau')} as tau, {R4('lo')} as lo, {R4('hi')} as hi, {R4('beta')} as beta, {R4('n_med')} as n_med, {R4('resid_sd')} as resid_sd,
 {R4('var_x')} as var_x, {R4('breakeven')} as breakeven, {R4('null_')} as "null", n_null, {R4('mc_se')} as mc_se, tau - null_ > 2 * mc_se as above_null from ob, nl""")
def _(t):
    return rounded4(m7(t), "tau", "lo", "hi", "beta", "n_med", "resid_sd", "var_x", "breakeven", "null", "mc_se")


@query("M8_tau_table", f"""with {OL}, {slope_cte('s', CELLS, 'cell, unit', 'x', 'y')}, {tau_cte('t', 's', 'cell')},
 md as (select cell, quantile_cont(n, 0.5) as n_med, quantile_cont(se, 0.5) as breakeven from s where se > 0 group by 1),
 ob as (select cell, n_med, breakeven, tau, lo, hi, 0.4::double * hi as nl, 0.1::double * hi as mc from t join md using (cell)),
 c as (select *, sqrt(greatest(tau*tau - nl*nl, 0)) as tc, sqrt(greatest(lo*lo - nl*nl, 0)) as lc, sqrt(greatest(hi*hi - nl*nl, 0)) as hc from ob)
 select cell, {R4('tc')} as tau_c, {R4('lc')} as lo_c, {R4('hc')} as hi_c, case when tc > 1e-9 then {R4('n_med * pow(breakeven / nullif(tc, 0), 2)')} end as n_star,
 case when hc > 1e-9 then {R4('n_med * pow(breakeven / nullif(hc, 0), 2)')} end as n_star_lo, (tau - nl > 2 * mc) and lc > breakeven as usable_now from c""")
def _(t):
    d = sl.tau_cells(cells(t), ["cell"], "unit", "x", "y", grid=G)
    d = d.withColumns({"null": 0.4 * F.col("hi"), "mc_se": 0.1 * F.col("hi")}).withColumn("above_null", F.col("tau") - F.col("null") > 2 * F.col("mc_se"))
    d = sl.tau_table(d).select("cell", "tau_c", "lo_c", "hi_c", "n_star", "n_star_lo", "usable_now")
    return rounded4(d, "tau_c", "lo_c", "hi_c", "n_star", "n_star_lo")


@query("M9_tau_bias_curve", f"""with {OL}, z as (select o_custkey % 40 as unit, count(*) as n from ol group by 1 having count(*) >= 24),
 r as (select unit, rep, x, y, row_number() over (partition by rep, unit order by {U('m9', 'rep', 'o_orderkey')}, o_orderkey) as rn from (select o_custkey % 40 as unit, o_orderkey, x, y from ol) join z using (unit), {REPS(3)}),
 r2 as (select * from r, (select unnest([6, 12, 24]) as n_rows) where rn <= n_rows), {slope_cte('s', 'r2', 'n_rows, rep, unit', 'x', 'y')}, sc as (select *, n_rows * 100 + rep as cell from s), {tau_cte('t', 'sc', 'cell')}
 select (cell // 100)::int as n_rows, {R4('quantile_cont(tau, 0.5)')} as tau, count(*) as n_reps from t group by 1""")
def _(t):
    d = t.orders_lines.select((F.col("o_custkey") % 40).alias("unit"), "o_orderkey", "x", "y")
    return rounded4(sl.tau_bias_curve(d, "unit", "x", "y", "o_orderkey", [6, 12, 24], 3, "m9", grid=G), "tau")


@query("M10_budget_surface", f"""with {EV}, ix as (select *, row_number() over (partition by user_id order by sec, event_id) - 1 as idx from ev),
 d as (select w, user_id, idx // w as block, avg(k) as x, avg(value) as y from ix, (select unnest([1, 2, 4]) as w) group by 1, 2, 3 having count(*) = any_value(w)),
 it as (select *, user_id || '-' || block as item, count(*) over (partition by w, user_id) as n from d), r as (select *, row_number() over (partition by rep, w, user_id order by {U('m10', 'rep', 'w', 'item')}, item) as rn from it, {REPS(4)}),
 r2 as (select w, k, user_id, rep, x, y from r, (select unnest([5, 10]) as k) where rn <= k and n >= k), {slope_cte('s', 'r2', 'w, k, user_id, rep', 'x', 'y')},
 p as (select w, k, user_id, quantile_cont(se, 0.5) as se from s where se is not null group by 1, 2, 3 having count(*) >= 2), m as (select w, k, quantile_cont(se, 0.5) as se, count(*) as n_units from p group by 1, 2 having count(*) >= 5)
 select a.w, a.k, a.k * a.w as budget, a.n_units, {R('a.se')} as se, {R('a.se / 0.5')} as se_over_tau, a.se < 0.5 as usable, {R('a.se / b.se')} as gain_of_doubling from m a left join m b on a.w = b.w and a.k = b.k * 2""")
def _(t):
    from ..operators.ordered import union_all
    d = tl.numbered(t.ratings, ["user_id"], ["sec", "event_id"], F.col("sec"))
    parts = []
    for w in (1, 2, 4):
        g = d.groupBy("user_id", F.floor(F.col("idx") / w).alias("block")).agg(
            F.avg("k").alias("x"), F.avg("value").alias("y"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == w)
        parts.append(g.select(F.lit(w).alias("w"), "user_id", F.concat_ws("-", "user_id", "block").alias("item"), "x", "y"))
    s = sl.budget_surface(union_all(parts), "user_id", "item", "x", "y", "w", [5, 10], 4, 0.5, "m10")
    return rounded(s, "se", "se_over_tau", "gain_of_doubling")


@query("M34_state_interaction", f"""with {EV}, {PR}, st as (select user_id, id, d, cast(split_part(id, ':', 2) as int) % 2 = 0 as act from pr), ag as (select user_id, round(avg(k), 9) as age from ev group by 1),
 u as (select user_id, avg(d) filter (act) as a, avg(d) filter (not act) as p, stddev_samp(d) filter (act) / sqrt(count(d) filter (act)) as sa, stddev_samp(d) filter (not act) / sqrt(count(d) filter (not act)) as sp from st group by 1 having count(*) filter (act) >= 3 and count(*) filter (not act) >= 3),
 lg as (select user_id, unnest(['active', 'passive', 'inter']) as effect, unnest([round(a, 9), round(p, 9), round(round(a, 9) - round(p, 9), 9)]) as v, unnest([sa, null, sqrt(sa*sa + sp*sp)]) as se from u),
 {signflip_sql('lg', 'effect', 'v', 'user_id', 30, 'm34')}, {tau_cte('t', 'lg', 'effect', 'v', 'se')}, sg as (select effect, quantile_cont(se, 0.5) as sigma from lg group by 1),
 la as (select effect, v, age from lg join ag using (user_id)), {sp_cte('r', 'la', 'effect', 'age', 'v')}
 select sf.effect, sf.n, {R4('mean')} as mean, {R4('p')} as p, {R4('tau')} as tau, {R4('lo')} as lo, {R4('hi')} as hi, {R4('sigma')} as sigma, {R4('rho')} as rho_age, {R4('tau / nullif(sigma, 0)')} as ratio
 from sf left join t on t.effect = sf.effect left join sg on sg.effect = sf.effect left join r on r.effect = sf.effect""")
def _(t):
    p = pairs(t).withColumn("act", F.split_part("id", F.lit(":"), F.lit(2)).cast("int") % 2 == 0)
    age = t.ratings.groupBy("user_id").agg(F.round(F.avg("k"), 9).alias("age"))
    d = sl.state_interaction(p, "user_id", "act", True, "d", age, "age", 30, "m34", grid=G)
    return rounded4(d, "mean", "p", "tau", "lo", "hi", "sigma", "rho_age", "ratio")


@query("M35_reconcile", f"""with c as (select l_suppkey, avg(l_quantity) as n_star from lineitem group by 1), o as (select l_linenumber * 4 as n, l_suppkey % 20 as cell, avg(l_quantity) - 25.5 as gain from lineitem group by 1, 2),
 g as (select n, count(*) filter (gain > 0) as ob from o group by 1) select n, ob as observed_cells, (select count(*) from c where n_star <= n) as predicted_cells, (select count(*) from c) as total_cells,
 abs((select count(*) from c where n_star <= n) - ob) <= 2 as agrees from g""")
def _(t):
    c = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("n_star"))
    o = t.lineitem.groupBy((F.col("l_linenumber") * 4).alias("n"), (F.col("l_suppkey") % 20).alias("cell")).agg(
        (F.avg("l_quantity") - 25.5).alias("gain"))
    return sl.reconcile(c, o)


@query("M36_tau_match_units", f"""with {OL}, {slope_cte('s', 'ol', 'o_custkey', 'x', 'y')}, s1 as (select * from s where se > 0), {tau_cte('f', 's1', '')},
 r as (select * from (select *, row_number() over (partition by rep order by {U('m36', 'rep', 'o_custkey')}, o_custkey) as rn from s1, {REPS(4)}) where rn <= 60), {tau_cte('t', 'r', 'rep')},
 q as (select quantile_cont(tau, 0.5) as tau, count(*) as n_reps from t) select {R4('q.tau')} as tau, n_reps, {R4('f.tau')} as tau_full, f.n_units as n_full, {R4('(q.tau - f.tau) / nullif(f.tau, 0)')} as rel_change from q, f""")
def _(t):
    return rounded4(sl.tau_match_units(t.orders_lines, "o_custkey", "x", "y", 60, 4, "m36", grid=G), "tau", "tau_full", "rel_change")
