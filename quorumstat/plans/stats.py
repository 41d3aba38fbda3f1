"""Aggregation and agreement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import corr, r6
from ..operators import reliability as rel
from ..operators import stats as st
from .registry import CORR, EV, OL, R, RANK, U, REPS, query


def rounded(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


def sp_cte(name, src, by, x, y, where="true"):
    """CTE with (by..., rho, n): Spearman of x and y inside by."""
    b = f"{by}, " if by else ""
    g = f"group by {by}" if by else ""
    return f"""{name} as (select {b}round({CORR('rx', 'ry')}, 10) as rho, count(*) as n from (
 select *, {RANK(x, by)} as rx, {RANK(y, by)} as ry from {src}
 where {x} is not null and {y} is not null and {where}) {g})"""


@query("A1_item_means", f"""with {EV} select k, event_type, {R('avg(value)')} as value_mean,
 count(distinct user_id) as n_units, count(*) as n_rows from ev group by 1, 2""")
def _(t):
    d = st.item_means(t.ratings, ["k", "event_type"], "user_id", ["value"])
    return rounded(d, "value_mean")


@query("A2_frame_summary", f"""with {EV}, d as (select *, lag(value) over (partition by user_id order by sec, event_id) as p from ev)
 select user_id, {R('avg(value)')} as mean, {R('stddev_pop(value)')} as std, {R('quantile_cont(value, 0.1)')} as p10,
 {R('quantile_cont(value, 0.5)')} as p50, {R('quantile_cont(value, 0.9)')} as p90, {R('avg(abs(value - p))')} as dmean
 from d group by 1""")
def _(t):
    d = st.frame_summary(t.ratings, ["user_id"], ["sec", "event_id"], F.col("sec"), "value")
    return rounded(d, "mean", "std", "p10", "p50", "p90", "dmean")


@query("A3_mean_std", f"""select l_returnflag, {R('avg(p)')} as p_mean, {R('stddev_samp(p)')} as p_std,
 {R('avg(q)')} as q_mean, {R('stddev_samp(q)')} as q_std from (select l_returnflag, l_suppkey, avg(l_extendedprice) as p,
 avg(l_quantity) as q from lineitem group by 1, 2) group by 1""")
def _(t):
    folds = t.lineitem.groupBy("l_returnflag", "l_suppkey").agg(
        F.avg("l_extendedprice").alias("p"), F.avg("l_quantity").alias("q"))
    return rounded(st.mean_std(folds, ["l_returnflag"], ["p", "q"]), "p_mean", "p_std", "q_mean", "q_std")


@query("A4_spearman", f"with {EV}, {sp_cte('s', 'ev', 'user_id', 'k', 'value')} select user_id, {R('rho')} as rho, n from s")
def _(t):
    return rounded(st.spearman(t.ratings, ["user_id"], "k", "value"), "rho")


@query("A4_spearman_ties", f"""with {sp_cte('s', 'lineitem', 'l_returnflag', 'l_discount', 'l_quantity')}
 select l_returnflag, {R('rho')} as rho, n from s""")
def _(t):
    return rounded(st.spearman(t.lineitem, ["l_returnflag"], "l_discount", "l_quantity"), "rho")


@query("A5_reg_score", f"""with {OL}, d as (select o_custkey, y, 40.0::double + 30.0::double * x as yhat from ol),
 {sp_cte('s', 'd', 'o_custkey', 'y', 'yhat')},
 g as (select o_custkey, count(*) as n, {CORR('y', 'yhat')} as pe, sum((y-yhat)*(y-yhat)) as sse, var_pop(y) as vy,
 avg(abs(y-yhat)) as mae, (count(*) >= 3 and min(yhat) < max(yhat)) as ok from d group by 1)
 select o_custkey, g.n, case when ok then {R('rho')} end as spearman, case when ok then {R('pe')} end as pearson,
 case when ok then {R('1 - sse / nullif(g.n * vy, 0)')} end as r2, case when ok then {R('mae')} end as mae
 from g join s using (o_custkey)""")
def _(t):
    d = t.orders_lines.select("o_custkey", "y", (40.0 + 30.0 * F.col("x")).alias("yhat"))
    return rounded(st.reg_score(d, ["o_custkey"], "y", "yhat"), "spearman", "pearson", "r2", "mae")


def partial_sql(form):
    ranks = f"""r as (select user_id, {RANK('k', 'user_id')} as rx, {RANK('value', 'user_id')} as ry,
 {RANK('sec', 'user_id')} as rz from ev)"""
    if form == "pearson":
        return f"""with {EV}, {ranks}, c as (select user_id, count(*) as n, {CORR('rx','ry')} as xy, {CORR('rx','rz')} as xz,
 {CORR('ry','rz')} as yz from r group by 1) select user_id, n, {R('(xy - xz*yz) / nullif(sqrt((1-xz*xz)*(1-yz*yz)), 0)')} as rho from c"""
    return f"""with {EV}, {ranks}, f as (select user_id, regr_slope(rx,rz) as bx, regr_intercept(rx,rz) as ax,
 regr_slope(ry,rz) as by_, regr_intercept(ry,rz) as ay from r group by 1),
 e as (select user_id, round(rx-ax-bx*rz, 6) as ex, round(ry-ay-by_*rz, 6) as ey from r join f using (user_id)),
 {sp_cte('s', 'e', 'user_id', 'ex', 'ey')} select user_id, {R('rho')} as rho, n from s"""


@query("A6_partial_spearman_pearson", partial_sql("pearson"))
def _(t):
    return rounded(st.partial_spearman(t.ratings, ["user_id"], "k", "value", "sec", "pearson"), "rho")


@query("A6_partial_spearman_spearman", partial_sql("spearman"))
def _(t):
    return rounded(st.partial_spearman(t.ratings, ["user_id"], "k", "value", "sec", "spearman"), "rho")


def d_sql(src, by, x, flag):
    return f"""select {by}, n1, n0, case when n1 >= 2 and n0 >= 2 then {R('(m1-m0)/nullif(sqrt(((n1-1)*v1+(n0-1)*v0)/nullif(n1+n0-2,0)),0)')} end as d
 from (select {by}, count(*) filter ({flag}) as n1, count(*) filter (not ({flag})) as n0, avg({x}) filter ({flag}) as m1,
 avg({x}) filter (not ({flag})) as m0, var_samp({x}) filter ({flag}) as v1, var_samp({x}) filter (not ({flag})) as v0
 from {src} group by {by})"""


@query("A7_cohens_d_label", d_sql("(select d.lang, d.n_chars::double as x, l.quality from labels l join documents d using (doc_id))",
                                  "lang", "x", "quality = 1"))
def _(t):
    d = t.labels.join(t.documents.select("doc_id", "lang", F.col("n_chars").cast("double").alias("x")), "doc_id")
    return rounded(st.cohens_d(d, ["lang"], "x", F.col("quality") == 1), "d")


@query("A7_cohens_d_median_split", f"with {EV}, m as (select event_type, quantile_cont(value, 0.5) as med from ev group by 1) "
       + d_sql("(select event_type, k::double as x, value > med as hi from ev join m using (event_type))", "event_type", "x", "hi"))
def _(t):
    d = t.ratings
    med = st.profile(d, ["event_type"], "value", {"med": 0.5})
    j = d.join(med, "event_type").withColumn("x", F.col("k").cast("double"))
    return rounded(st.cohens_d(j, ["event_type"], "x", F.col("value") > F.col("med")), "d")


@query("A8_one_sample_d", f"""with {EV}, d as (select user_id, avg(value) filter (event_type='click') - avg(value) filter (event_type='view') as d,
 user_id % 4 as arm from ev group by 1) select arm, count(d) as n, {R('avg(d)')} as mean, {R('avg(d)/nullif(stddev_samp(d),0)')} as d
 from d group by 1""")
def _(t):
    v = F.col("value")
    d = t.ratings.groupBy("user_id").agg(
        (F.avg(F.when(F.col("event_type") == "click", v)) - F.avg(F.when(F.col("event_type") == "view", v))).alias("d"))
    d = d.withColumn("arm", F.col("user_id") % 4)
    return rounded(st.one_sample_d(d, ["arm"], "d"), "mean", "d")


@query("A9_class_score", f"""with d as (select d.lang, l.quality as y, least(d.n_chars / 4000.0::double, 1.0::double) as p
 from labels l join documents d using (doc_id)), r as (select *, {RANK('p', 'lang')} as r from d),
 s as (select lang, count(*) filter (y=1) as n1, count(*) filter (y<>1) as n0, sum(r) filter (y=1) as rs,
 count(*) filter (y=1 and p>=0.5) as tp, count(*) filter (y<>1 and p>=0.5) as fp, count(*) filter (y<>1 and p<0.5) as tn from r group by 1),
 a as (select *, (rs - n1*(n1+1)/2.0::double)/nullif(n1*n0,0) as auc from s)
 select lang, n1, n0, {R('auc')} as auc, {R('(tp+tn)/nullif(n1+n0,0)')} as accuracy,
 {R('coalesce(tp/nullif(tp+fp,0),0)')} as precision, {R('coalesce(tp/nullif(n1,0),0)')} as recall,
 {R('greatest(auc,1-auc)')} as auc_flipped from a""")
def _(t):
    d = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").select(
        "lang", F.col("quality").alias("y"), F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("p"))
    return rounded(st.class_score(d, ["lang"], "y", "p"), "auc", "accuracy", "precision", "recall", "auc_flipped")


def icc_sql(src, by, item, value):
    """SQL of the one-way ICC: columns by..., k, n, icc."""
    b = f"{by}, " if by else ""
    g = f"group by {by}" if by else ""
    return f"""select {b}k, n, case when k>=3 and n>=6 and n>k and den>0 then {R('(msb-msw)/den')} end as icc from (
 select *, msb + (n0-1)*msw as den from (select {b}k, n, (B-S*S/n)/nullif(k-1,0) as msb, (SS-B)/nullif(n-k,0) as msw,
 (n-N2/n)/nullif(k-1,0) as n0 from (select {b}count(*) as k, sum(c)::bigint as n, sum(s) as S, sum(ss) as SS, sum(s*s/c) as B,
 sum(c*c)::double as N2 from (select {b}{item}, count(*) as c, sum({value}) as s, sum({value}*{value}) as ss from {src}
 where {value} is not null group by {b}{item}) {g})))"""


@query("A10_icc_oneway", icc_sql("(select l_returnflag, l_partkey % 50 as item, l_quantity from lineitem)", "l_returnflag", "item", "l_quantity"))
def _(t):
    d = t.lineitem.select("l_returnflag", (F.col("l_partkey") % 50).alias("item"), "l_quantity")
    return rounded(rel.icc_oneway(d, ["l_returnflag"], "item", "l_quantity"), "icc")


@query("A11_reliability_analytic", f"""with i as (select l_returnflag, l_partkey % 50 as item, avg(l_extendedprice) as m,
 stddev_samp(l_extendedprice) as sd, count(*) as n from lineitem group by 1, 2),
 s as (select l_returnflag, count(*) as n_items, avg(sd*sd) as vw, var_samp(m) as vo, avg(n) as n0 from i where n > 1 and sd is not null group by 1),
 c as (select *, greatest(vo - vw/n0, 0.0::double) as vb from s), e as (select *, vb/nullif(vb+vw,0) as icc from c)
 select l_returnflag, n_items, {R('icc')} as icc, {R('least(case when icc > 0 then n0*icc/(1+(n0-1)*icc) else 0 end, 0.999)')} as reliability from e""")
def _(t):
    i = t.lineitem.groupBy("l_returnflag", (F.col("l_partkey") % 50).alias("item")).agg(
        F.avg("l_extendedprice").alias("m"), F.stddev_samp("l_extendedprice").alias("sd"), F.count(F.lit(1)).alias("n"))
    return rounded(rel.reliability_analytic(i, ["l_returnflag"], "m", "sd", "n"), "icc", "reliability")


SPLIT_TAIL = f"""d as (select *, 2*rho/(1+rho) as sb from s where n >= {{m}} and rho > -1)
 select count(*) as n_splits, {R('avg(rho)')} as raw_mean, {R('avg(sb)')} as spearman_brown,
 {R('quantile_cont(sb, 0.1)')} as sb_p10, {R('quantile_cont(sb, 0.9)')} as sb_p90 from d"""
SPLIT_COLS = ("raw_mean", "spearman_brown", "sb_p10", "sb_p90")


@query("A12_split_half_units", f"""with {EV}, u as (select distinct user_id from ev),
 h as (select user_id, rep, row_number() over (partition by rep order by {U('split', 'rep', 'user_id')}, user_id)
 <= (select count(*) // 2 from u) as first from u, {REPS(20)}),
 m as (select rep, k, avg(value) filter (first) as a, avg(value) filter (not first) as b from ev join h using (user_id) group by 1, 2),
 {sp_cte('s', 'm', 'rep', 'a', 'b')}, {SPLIT_TAIL.format(m=10)}""")
def _(t):
    return rounded(rel.split_half_units(t.ratings, "k", "user_id", "value", 20, "split"), *SPLIT_COLS)


def split_items_sql(src, item, key, value, seed, n, a, b, m):
    return f"""with {src}, z as (select {item}, count(*) as size from x group by 1),
 r as (select x.*, rep, size, row_number() over (partition by rep, {item} order by {U(seed, 'rep', key)}, {key}) as rn
 from x join z using ({item}), {REPS(n)} where size >= 2),
 m as (select rep, {item}, avg({value}) filter ({a}) as a, avg({value}) filter ({b}) as b from r group by 1, 2),
 {sp_cte('s', 'm', 'rep', 'a', 'b')}, {SPLIT_TAIL.format(m=m)}"""


@query("A13_split_half_items", split_items_sql(f"{EV}, x as (select event_id, k, value from ev)", "k", "event_id", "value", "half", 10,
                                               "rn <= size // 2", "rn > size // 2 and rn <= 2 * (size // 2)", 3))
def _(t):
    return rounded(rel.split_half_items(t.ratings, "k", "event_id", "value", 10, "half"), *SPLIT_COLS)


@query("A14_split_one_rest", split_items_sql(f"{EV}, x as (select event_id, k, value from ev)", "k", "event_id", "value", "one", 10,
                                             "rn = 1", "rn > 1", 3))
def _(t):
    return rounded(rel.split_one_rest(t.ratings, "k", "event_id", "value", 10, "one"), *SPLIT_COLS)


@query("A15_attenuation", f"""with {OL}, {sp_cte('s', 'ol', 'o_orderpriority', 'x', 'y')},
 c as (select o_orderpriority, rho, 0.6::double as rx, 0.1::double + n / 10000.0::double as ry from s)
 select o_orderpriority, {R('rho')} as rho, {R('rx')} as rx, {R('ry')} as ry, {R('sqrt(rx*ry)')} as ceiling,
 {R('rho/sqrt(rx*ry)')} as share_of_ceiling from c""")
def _(t):
    s = st.spearman(t.orders_lines, ["o_orderpriority"], "x", "y")
    s = s.select("o_orderpriority", "rho", F.lit(0.6).alias("rx"), (0.1 + F.col("n") / 10000.0).alias("ry"))
    return rounded(rel.attenuation(s, "rho", "rx", "ry"), "rho", "rx", "ry", "ceiling", "share_of_ceiling")


@query("A16_variance_shares", f"""with {EV}, g as (select avg(value) as m, count(*) as n, sum((value - (select avg(value) from ev))**2) as tot from ev),
 u as (select sum(c*(a-m)**2) as b from (select count(*) as c, avg(value) as a from ev group by user_id), g),
 i as (select sum(c*(a-m)**2) as b from (select count(*) as c, avg(value) as a from ev group by k), g)
 select n, {R('u.b/tot')} as unit_share, {R('i.b/tot')} as item_share, {R('1-(u.b+i.b)/tot')} as residual_share from g, u, i""")
def _(t):
    return rounded(st.variance_shares(t.ratings, "user_id", "k", "value"), "unit_share", "item_share", "residual_share")


@query("A17_agreement", f"""with {EV}, m as (select *, avg(value) over (partition by k) as pop from ev),
 {sp_cte('s', 'm', 'user_id', 'value', 'pop')}, f as (select * from s where n >= 20 and rho is not null)
 select count(*) as n_units, {R('avg(rho)')} as mean, {R('avg((rho<0)::int)')} as frac_negative, {R('quantile_cont(rho,0.5)')} as median,
 {R('quantile_cont(rho,0.1)')} as p10, {R('quantile_cont(rho,0.9)')} as p90 from f""")
def _(t):
    return rounded(st.agreement(t.ratings, "user_id", "k", "value", 20), "mean", "frac_negative", "median", "p10", "p90")


@query("A18_effect_spread", f"""with {OL}, {sp_cte('s', 'ol', 'o_custkey', 'x', 'y')}, f as (select rho from s where rho is not null),
 g as (select count(*) as n, avg(rho) as m, stddev_pop(rho) as sd, avg((rho>0)::int) as p, avg((rho<0)::int) as q,
 quantile_cont(rho,0.1) as p10, quantile_cont(rho,0.9) as p90 from f)
 select n as n_units, {R('m')} as mean_rho, {R('sd')} as sd_rho, {R('p10')} as p10, {R('p90')} as p90,
 {R('case when m>0 then p when m<0 then q end')} as frac_same_sign from g""")
def _(t):
    return rounded(st.effect_spread(t.orders_lines, "o_custkey", "x", "y"), "mean_rho", "sd_rho", "p10", "p90", "frac_same_sign")


@query("A19_sign_consistency", f"""with {EV}, {sp_cte('s', 'ev', 'user_id, event_type', 'k', 'value')}
 select event_type, count(*) as n, {R('avg(rho)')} as mean, {R('greatest(avg((rho>0)::int), avg((rho<0)::int))')} as frac_same_sign
 from s where rho is not null group by 1""")
def _(t):
    s = st.spearman(t.ratings, ["user_id", "event_type"], "k", "value")
    return rounded(st.sign_consistency(s, ["event_type"], "rho"), "mean", "frac_same_sign")


@query("A20_direction_agreement", f"""with a as ({d_sql("lineitem", "l_linenumber", "l_quantity", "l_returnflag = 'A'")}),
 b as ({d_sql("lineitem", "l_linenumber", "l_quantity", "l_linestatus = 'F'")})
 select l_linenumber, a.d as d_a, b.d as d_b, sign(a.d) = sign(b.d) as same_direction, least(abs(a.d), abs(b.d)) as min_abs_d
 from a join b using (l_linenumber)""")
def _(t):
    a = rounded(st.cohens_d(t.lineitem, ["l_linenumber"], "l_quantity", F.col("l_returnflag") == "A"), "d")
    b = rounded(st.cohens_d(t.lineitem, ["l_linenumber"], "l_quantity", F.col("l_linestatus") == "F"), "d")
    return st.direction_agreement(a, b, ["l_linenumber"])


IMP = """imp as (select o_orderpriority as model, c_mktsegment as feature, round(abs(avg(o_totalprice) - 250000), 4) as imp,
 round(avg(o_totalprice), 4) as perf0 from orders join customer on o_custkey = c_custkey group by 1, 2),
 im as (select model, feature, imp, max(perf0) over (partition by model) as perf from imp)"""


def importance_table(t):
    g = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("o_orderpriority").alias("model"), F.col("c_mktsegment").alias("feature")).agg(
        F.round(F.abs(F.avg("o_totalprice") - 250000), 4).alias("imp"), F.round(F.avg("o_totalprice"), 4).alias("_p"))
    best = g.groupBy("model").agg(F.max("_p").alias("perf"))
    return g.join(best, "model").drop("_p")


@query("A21_topk_frequency", f"""with {IMP}, n as (select * from im where perf >= (select max(perf) from im) - 3000),
 r as (select *, row_number() over (partition by model order by imp desc, feature) as rk from n)
 select feature, count(*) as n_top, {R('count(*) / (select count(distinct model) from n)')} as frequency from r where rk <= 2 group by 1""")
def _(t):
    return rounded(st.topk_frequency(importance_table(t), "model", "feature", "imp", "perf", 3000.0, 2), "frequency")


@query("A22_consensus", f"""with {IMP}, r as (select *, row_number() over (partition by model order by imp desc, feature) as rk from im)
 select feature, count(distinct model) as n_models, {R('avg(rk)')} as mean_rank from r where rk <= 4 group by 1
 having count(distinct model) = (select count(distinct model) from im)""")
def _(t):
    return rounded(st.consensus(importance_table(t), "model", "feature", "imp", 4), "mean_rank")


@query("A23_chain_count", """with c as (select distinct p_brand as feature, 'type:' || p_type as chain from part where p_size > 45
 union select distinct p_brand, 'size' from part where p_size < 3)
 select feature, chain, (select count(distinct d.chain) from c d where d.feature = c.feature) as n_chains from c""")
def _(t):
    a = t.part.filter("p_size > 45").select(F.col("p_brand").alias("feature"), F.concat(F.lit("type:"), "p_type").alias("chain"))
    b = t.part.filter("p_size < 3").select(F.col("p_brand").alias("feature"), F.lit("size").alias("chain"))
    return st.chain_count(a.union(b).distinct(), "feature", "chain")


@query("A24_oof_diversity", f"""with w as (select l_quantity as a1, l_extendedprice as a2, l_discount as b1, l_tax as b2 from lineitem)
 select a, b, kind, {R('r')} as r from (select 'a1' as a, 'a2' as b, 'within' as kind, {CORR('a1','a2')} as r from w
 union all select 'a1','b1','across',{CORR('a1','b1')} from w union all select 'a1','b2','across',{CORR('a1','b2')} from w
 union all select 'a2','b1','across',{CORR('a2','b1')} from w union all select 'a2','b2','across',{CORR('a2','b2')} from w
 union all select 'b1','b2','within',{CORR('b1','b2')} from w)""")
def _(t):
    w = t.lineitem.select(F.col("l_quantity").alias("a1"), F.col("l_extendedprice").alias("a2"),
                          F.col("l_discount").alias("b1"), F.col("l_tax").alias("b2"))
    return rounded(st.oof_diversity(w, "id", {"a1": "A", "a2": "A", "b1": "B", "b2": "B"}), "r")


@query("A25_mode_min", f"""with {EV}, c as (select user_id, k, count(*) as n from ev group by 1, 2)
 select user_id, n, k as mode from (select *, row_number() over (partition by user_id order by n desc, k) as rn from c) where rn = 1""")
def _(t):
    return st.mode_min(t.ratings, ["user_id"], "k")


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("A26_pivot_wide", f"""select user_id, {', '.join(R(f"avg(value) filter (event_type='{e}')") + f' as {e}' for e in TYPES)}
 from events group by 1""")
def _(t):
    return rounded(st.pivot_wide(t.events, ["user_id"], "event_type", TYPES, "value"), *TYPES)


@query("A27_share_dispersion", f"""with {EV}, c as (select k, count(*) as n, {', '.join(f"count(*) filter (event_type='{e}') as {e}" for e in TYPES)}
 from ev group by 1), s as (select ({' + '.join(f'stddev_samp({e}/n)' for e in TYPES)})/5 as o,
 ({' + '.join(f'sqrt(sum({e})/sum(n) * (1 - sum({e})/sum(n)) * avg(1.0::double/n))' for e in TYPES)})/5 as x from c)
 select {R('o')} as observed, {R('x')} as expected, {R('o/x')} as ratio from s""")
def _(t):
    return rounded(st.share_dispersion(t.ratings, "k", "event_type", TYPES), "observed", "expected", "ratio")


@query("A28_duplicate_structure", f"""with s as (select l_orderkey, count(*) as n from lineitem group by 1)
 select sum(n)::bigint as n_clips, count(*) as n_sets, {R('avg(n)')} as mean_per_set, max(n) as max_per_set,
 sum(case when n > 1 then n else 0 end)::bigint as n_in_multi, (select count(distinct l_partkey) from lineitem) as n_groups,
 {R('sum(case when n > 1 then n else 0 end) / sum(n)')} as share_in_multi,
 (select count(distinct l_partkey) from lineitem) = sum(n) as group_is_row from s""")
def _(t):
    return rounded(st.duplicate_structure(t.lineitem, "l_orderkey", "l_partkey"), "mean_per_set", "share_in_multi")


@query("A29_dose_response", f"""with {sp_cte('s', 'lineitem', 'l_returnflag, l_suppkey', 'l_discount', 'l_extendedprice')},
 f as (select * from s where rho is not null), m as (select l_returnflag, quantile_cont(rho, 0.5) as med from f group by 1)
 select l_returnflag, {R('med')} as median_rho, count(*) as n_sources, {R('avg((sign(rho)=sign(med))::int)')} as consistency
 from f join m using (l_returnflag) group by l_returnflag, med""")
def _(t):
    d = st.dose_response(t.lineitem, ["l_returnflag"], "l_suppkey", "l_discount", "l_extendedprice")
    return rounded(d, "median_rho", "consistency")


@query("A30_dose_slopes", f"""with s as (select l_returnflag, l_suppkey, regr_slope(l_extendedprice, l_discount) as slope, count(*) as n,
 stddev_samp(l_extendedprice) as sd, min(l_discount) < max(l_discount) as moves from lineitem group by 1, 2),
 f as (select * from s where n >= 3 and sd >= 1e-12 and moves), m as (select l_returnflag, quantile_cont(slope, 0.5) as med from f group by 1)
 select l_returnflag, {R('med')} as median_slope, count(*) as n_sources, {R('avg(slope)')} as mean_slope,
 {R('avg((sign(slope)=sign(med))::int)')} as consistency from f join m using (l_returnflag) group by l_returnflag, med""")
def _(t):
    d = st.dose_slopes(t.lineitem, ["l_returnflag"], "l_suppkey", "l_discount", "l_extendedprice")
    return rounded(d, "median_slope", "mean_slope", "consistency")


FE = ["l_quantity", "l_extendedprice", "l_tax"]


@query("A31_specificity", f"""with sd as (select {', '.join(f'stddev_samp({f}) as s_{f}' for f in FE)} from lineitem),
 p as (select l_suppkey, {', '.join(f'avg({f}) filter (l_discount = 0) as a_{f}, avg({f}) filter (l_discount = 0.1) as b_{f}' for f in FE)}
 from lineitem group by 1), h as (select {', '.join(f'avg(abs(b_{f}-a_{f})/nullif(s_{f},0)) as {f}' for f in FE)} from p, sd)
 select {R('l_quantity')} as target_shift, {R('greatest(l_extendedprice,l_tax)')} as max_other,
 {R('l_quantity/greatest(l_extendedprice,l_tax)')} as ratio,
 (1 + (l_extendedprice>l_quantity)::int + (l_tax>l_quantity)::int)::int as target_rank from h""")
def _(t):
    d = st.specificity(t.lineitem, "l_suppkey", "l_discount", 0.0, 0.1, FE, "l_quantity")
    return rounded(d, "target_shift", "max_other", "ratio")


@query("A32_interaction", f"""with {EV}, {sp_cte('s', 'ev', 'event_type', 'k', 'value')}, {sp_cte('p', 'ev', '', 'k', 'value')},
 g as (select min(rho) as lo, max(rho) as hi, max(abs(rho)) as ma, count(*) as n from s where n >= 100)
 select {R('lo')} as min_rho, {R('hi')} as max_rho, {R('ma')} as max_abs, g.n as n_groups, {R('p.rho')} as pooled_rho,
 lo < 0 and hi > 0 and ma >= 0.02 as interaction from g, p""")
def _(t):
    return rounded(st.interaction(t.ratings, "event_type", "k", "value", 0.02, 100), "min_rho", "max_rho", "max_abs", "pooled_rho")


@query("A33_gates", f"""with n as (select quantile_cont(c_acctbal, 0.9) as hi, quantile_cont(c_acctbal, 0.25) as lo from customer),
 o as (select o_custkey, avg(o_totalprice) as ap, max(o_totalprice) as mp from orders group by 1),
 g as (select c_acctbal <= hi as g1, ap / 100.0::double <= 3000.0 as g2, mp <= 480000.0 as g3 from customer join o on c_custkey = o_custkey, n)
 select gate, count(*) as n, {R('avg(p::int)')} as pass_rate, {R('avg(a::int)')} as accept_rate from (
 select unnest(['applicability_domain','agreement','worst_score']) as gate, unnest([g1,g2,g3]) as p, g1 and g2 and g3 as a from g) group by 1""")
def _(t):
    cut = st.profile(t.customer, [], "c_acctbal", {"hi": 0.9})
    o = t.orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("ap"), F.max("o_totalprice").alias("mp"))
    d = t.customer.join(o, F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(cut))
    g = st.gates(d, [("applicability_domain", F.col("c_acctbal"), F.col("hi")),
                     ("agreement", F.col("ap") / 100.0, F.lit(3000.0)),
                     ("worst_score", F.col("mp"), F.lit(480000.0))])
    return rounded(st.gate_rates(g), "pass_rate", "accept_rate")


@query("A34_transfer_loss", f"""with {OL}, {sp_cte('s', 'ol', 'o_custkey', 'x', 'y')},
 d as (select o_custkey % 5 as algo, o_custkey % 3 = 0 as w, rho from s where rho is not null),
 g as (select algo, quantile_cont(rho, 0.5) filter (w) as a, quantile_cont(rho, 0.5) filter (not w) as b from d group by 1)
 select algo, {R('a')} as within, {R('b')} as "cross", {R('1 - b/nullif(a,0)')} as loss from g""")
def _(t):
    s = st.spearman(t.orders_lines, ["o_custkey"], "x", "y").filter("rho is not null").select(
        (F.col("o_custkey") % 5).alias("algo"), (F.col("o_custkey") % 3 == 0).alias("w"), "rho")
    return rounded(st.transfer_loss(s, "rho", F.col("w"), ["algo"]), "within", "cross", "loss")


RECOVERED = f"""select event_type, month(ts) * 0 + day(ts) // 8 as k, user_id % 10 as target, avg(value) as rho
 from events where user_id % 10 + day(ts) // 8 <= 11 group by 1, 2, 3"""


@query("A35_recovered", f"""with f as (select *, (rho - 40.0::double) / nullif(60.0::double - 40.0::double, 0) as f from ({RECOVERED})),
 b as (select f.* from f where (event_type, target) in (select (event_type, target) from f where k = (select max(k) from f)))
 select a.k, a.n as n_all, {R('a.m')} as median_all, b.n as n_balanced, {R('b.m')} as median_balanced from
 (select k, count(*) as n, quantile_cont(f, 0.5) as m from f group by 1) a left join
 (select k, count(*) as n, quantile_cont(f, 0.5) as m from b group by 1) b using (k)""")
def _(t):
    d = t.events.withColumns({"k": F.floor(F.dayofmonth("ts") / 8), "target": F.col("user_id") % 10})
    d = d.filter(F.col("target") + F.col("k") <= 11).groupBy("event_type", "k", "target").agg(F.avg("value").alias("rho"))
    d = d.withColumns({"zero": F.lit(40.0), "ceil": F.lit(60.0)})
    return rounded(st.recovered(d, ["event_type", "target"], "k", "rho", "zero", "ceil"), "median_all", "median_balanced")


@query("A36_signal_quality", f"""with {EV}, d as (select distinct user_id, value from ev),
 s as (select user_id, value - lag(value) over (partition by user_id order by value) as step from d),
 m as (select user_id, min(step) as ms, count(*) as nl from s group by 1),
 r as (select user_id, max(value)-min(value) as rg, stddev_pop(value) as sd from ev group by 1)
 select user_id, {R('rg')} as "range", {R('sd')} as sd, {R('ms')} as min_step, nl as n_levels from r join m using (user_id)""")
def _(t):
    return rounded(st.signal_quality(t.ratings, "user_id", "value"), "range", "sd", "min_step")


@query("A37_representation_gain", f"""with d as (select l_linenumber as axis, l_returnflag as a,
 l_extendedprice as y, l_quantity as p1, l_quantity * (1 - l_discount) as p2 from lineitem),
 {sp_cte('r1', 'd', 'axis, a', 'y', 'p1')}, {sp_cte('r2', 'd', 'axis, a', 'y', 'p2')},
 g2 as (select axis, gain from (select r1.axis as axis, r2.rho - r1.rho as gain from r1 join r2 on r1.axis = r2.axis and r1.a = r2.a))
 select axis, count(*) as n_algos, {R('min(gain)')} as min_gain, {R('max(gain)')} as max_gain, {R('quantile_cont(gain,0.5)')} as median_gain,
 count(*) filter (gain > 0) as wins from g2 group by 1""")
def _(t):
    from ..operators.transfer import representation_gain
    d = t.lineitem.select(F.col("l_linenumber").alias("axis"), F.col("l_returnflag").alias("algo"),
                          F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("p_a"),
                          (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("p_ad"))
    return rounded(representation_gain(d, "axis", "algo", "y", "p_a", "p_ad"), "min_gain", "max_gain", "median_gain")


@query("A38_rollup_scores", f"""with {EV}, {sp_cte('s', 'ev', 'user_id, event_type', 'k', 'value')}, f as (select * from s where rho is not null)
 select event_type, {R('quantile_cont(rho,0.5)')} as median, count(*) as n from f group by 1
 union all select 'All', {R('quantile_cont(rho,0.5)')}, count(*) from f""")
def _(t):
    s = st.spearman(t.ratings, ["user_id", "event_type"], "k", "value").filter("rho is not null").drop("n")
    return rounded(st.rollup_scores(s, "event_type", "rho"), "median")


@query("A39_threshold_sweep", """select cut::double as cut, cap::double as cap, count(*) filter (v <= cut and sd <= cap) as n_low,
 count(*) filter (v >= 1 - cut and sd <= cap) as n_high from (select l_quantity / 50.0::double as v, l_tax as sd from lineitem),
 (select unnest([0.2::double, 0.3::double, 0.4::double]) as cut), (select unnest([0.02::double, 0.05::double]) as cap) group by 1, 2""")
def _(t):
    d = t.lineitem.select((F.col("l_quantity") / 50.0).alias("v"), F.col("l_tax").alias("sd"))
    return st.threshold_sweep(d, "v", "sd", [0.2, 0.3, 0.4], [0.02, 0.05])


@query("A40_profile", f"""select l_returnflag, {', '.join(R(f'quantile_cont(l_extendedprice, {q})') + f' as q{int(q*100)}' for q in (0.05,0.25,0.5,0.75,0.95))}
 from lineitem group by 1""")
def _(t):
    qs = {f"q{int(q * 100)}": q for q in (0.05, 0.25, 0.5, 0.75, 0.95)}
    return rounded(st.profile(t.lineitem, ["l_returnflag"], "l_extendedprice", qs), *qs)


@query("A41_verdicts", f"""select rule, {R('m')} as mean, th as threshold, m >= th as passed from (
 select 'urgent' as rule, avg(o_totalprice) filter (o_orderpriority = '1-URGENT') as m, 250000.0::double as th from orders
 union all select 'late', avg(o_totalprice) filter (o_orderdate >= timestamp '1998-01-01'), 260000.0::double from orders
 union all select 'open', avg(o_totalprice) filter (o_orderstatus = 'O'), 240000.0::double from orders)""")
def _(t):
    d = st.verdicts(t.orders, "o_totalprice", [
        ("urgent", F.col("o_orderpriority") == "1-URGENT", 250000.0),
        ("late", F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"), 260000.0),
        ("open", F.col("o_orderstatus") == "O", 240000.0)])
    return rounded(d, "mean")


@query("A42_rank_shift", """with a as (select l_partkey, round(avg(l_extendedprice), 4) as v from lineitem where l_linestatus = 'F' group by 1),
 b as (select l_partkey, round(avg(l_extendedprice), 4) as v from lineitem where l_linestatus <> 'F' group by 1),
 ra as (select l_partkey, row_number() over (order by v desc, l_partkey) as rank_a from a),
 rb as (select l_partkey, row_number() over (order by v desc, l_partkey) as rank_b from b)
 select l_partkey, rank_a, rank_b, rank_b - rank_a as shift, rank_a <= 20 and rank_b <= 20 as stays from ra join rb using (l_partkey)""")
def _(t):
    f = F.col("l_linestatus") == "F"
    # Means of cents often end in a 5 at the fifth place, where the order of summation would decide.
    m = lambda d: d.groupBy("l_partkey").agg(F.round(F.round(F.avg("l_extendedprice"), 8), 4).alias("v"))
    return st.rank_shift(m(t.lineitem.filter(f)), m(t.lineitem.filter(~f)), "l_partkey", "v", 20)
