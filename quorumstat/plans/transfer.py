"""Fold, neighbour and alignment queries (M1, M2, M13, M18-M23, M33) and ridge transfer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import r6
from ..operators import additive as ad
from ..operators import linear as ln
from ..operators import transfer as tr
from .registry import EV, R, U, query
from .stats import rounded

E64 = "(select unnest(range(64)) as i)"
LAM = 0.01


def vecs(t):
    """Embeddings as corpora: label % 3, domain A for 0 and 1; last dimension as target."""
    c = F.col("label") % 3
    return t.embeddings.select(
        "vec_id", "label", F.concat(F.lit("c"), c.cast("string")).alias("corpus"), F.when(c < 2, "A").otherwise("B").alias("domain"),
        F.transform(F.slice("embedding", 1, 63), lambda x: x.cast("double")).alias("v"),
        F.col("embedding")[63].cast("double").alias("y"), "embedding")


def snake(src, group, k, seed):
    return f"""(select {group}, (case when (rn // {k}) % 2 = 0 then rn % {k} else {k} - 1 - rn % {k} end)::int as fold from (select {group}, row_number() over (order by n desc, {U(seed, group)}, {group}) - 1 as rn
 from (select {group}, count(*) as n from {src} group by 1)))"""


@query("M1_group_folds", f"select o_custkey, fold from {snake('orders', 'o_custkey', 5, 'm1')}")
def _(t):
    return tr.group_folds(t.orders, "o_custkey", 5, "m1")


@query("M2_folds_stratified", f"""select doc_id, quality, ((row_number() over (partition by quality order by {U('m2', 'doc_id')}, doc_id) - 1) % 5)::int as fold from labels""")
def _(t):
    return tr.folds(t.labels, "stratified", 5, "doc_id", "quality", "m2").select("doc_id", "quality", "fold")


def group_fill(src, group, label, classes, k, seed):
    """Kinds of class counts dealt in a snake, the rest by recursion, largest first."""
    cs = range(len(classes))
    low = "greatest(floor(log2(greatest({v}, 1)::double))::int - 3, 0)"
    v = [f"count(*) filter ({label} = '{c}') as v{i}" for i, c in enumerate(classes)]
    kind = " || ',' || ".join(f"((v{i} >> {low.format(v=f'v{i}')}) || 'x' || {low.format(v=f'v{i}')})" for i in cs)
    score = " + ".join(f"load[f * {len(classes)} + {i + 1}] * v{i} / (t{i} * t{i})" for i in cs)
    full = " + ".join(f"load[f * {len(classes)} + {i + 1}]" for i in cs)
    return f"""g as (select {group}, count(*) as n, {U(seed, group)} as u, {', '.join(v)} from {src} group by 1),
 kk as (select *, {kind} as kind from g),
 rk as (select *, row_number() over (partition by kind order by n desc, u, {group}) - 1 as i, count(*) over (partition by kind) as m from kk),
 dealt as (select *, (case when (i // {k}) % 2 = 0 then i % {k} else {k} - 1 - i % {k} end)::int as fold from rk where i < m - m % {k}),
 lefts as (select *, row_number() over (order by n desc, u, {group}) as s from rk where i >= m - m % {k}),
 tot as (select {', '.join(f'greatest(sum(v{i}), 1)::double as t{i}' for i in cs)} from g),
 slot as (select f, c, coalesce((select sum(case c {' '.join(f'when {i} then v{i}' for i in cs)} end) from dealt where fold = f), 0)::double as x from (select unnest(range({k})) as f), (select unnest(range({len(classes)})) as c)),
 fill(s, {group}, fold, load) as (select 0::bigint, null::bigint, null::int, (select list(x order by f, c) from slot)
  union all select s, {group}, best, [case when j // {len(classes)} = best then load[j + 1] + case j % {len(classes)} {' '.join(f'when {i} then v{i}' for i in cs)} end else load[j + 1] end for j in range({k * len(classes)})] from (
   select l.*, load, list_sort([{{'a': round({score}, 12), 'b': {full}, 'c': f::int}} for f in range({k})])[1].c as best from fill join lefts l on l.s = fill.s + 1, tot)),
 folds as (select {group}, fold from dealt union all select {group}, fold from fill where s > 0)"""


@query("M2_folds_stratified_groups", f"""with recursive {group_fill('orders', 'o_custkey', 'o_orderstatus', 'FOP', 5, 'm2g')} select o_orderkey, o_custkey, fold from orders join folds using (o_custkey)""")
def _(t):
    return tr.folds(t.orders, "stratified", 5, "o_orderkey", "o_orderstatus", "m2g", "o_custkey").select("o_orderkey", "o_custkey", "fold")


@query("M2_folds_shuffled", f"""select o_orderkey, ((row_number() over (order by {U('m2s', 'o_orderkey')}, o_orderkey) - 1) % 5)::int as fold from orders""")
def _(t):
    return tr.folds(t.orders, "shuffled", 5, "o_orderkey", seed="m2s").select("o_orderkey", "fold")


@query("M2_folds_leave_one_category", """select o_orderkey, (dense_rank() over (order by o_orderpriority) - 1)::int as fold from orders""")
def _(t):
    return tr.folds(t.orders, "leave_one_category_out", 0, "o_orderkey", "o_orderpriority").select("o_orderkey", "fold")


def knn_sql(test, train, k, extra=""):
    return f"""dd as (select a.vec_id as q, b.vec_id as b, round(sqrt(sum((a.x - b.x) ** 2)), 9) as d from {test} a join {train} b using (i) {extra} group by 1, 2),
 nn as (select * from (select *, row_number() over (partition by q order by d, b) as r from dd) where r <= {k})"""


SIDES = f"e as (select vec_id, label, i, embedding[i + 1]::double as x from embeddings, {E64}), tr as (select * from e where label < 5), te as (select * from e where label >= 5)"


@query("M13_knn_regress", f"""with {SIDES}, {knn_sql('te', 'tr', 5)}, y as (select vec_id, embedding[64]::double as y from embeddings)
 select q as vec_id, {R('avg(y)')} as prediction, {R('avg(d)')} as mean_distance from nn join y on y.vec_id = nn.b group by 1""")
def _(t):
    d = vecs(t)
    p = tr.knn_regress(d.filter("label < 5"), d.filter("label >= 5"), "vec_id", "embedding", "y", 5)
    return rounded(p, "prediction", "mean_distance")


@query("M18_coral_diag", f"""with {SIDES}, ms as (select i, avg(x) as m, var_samp(x) as v from tr group by 1), mt as (select i, avg(x) as m, var_samp(x) as v from te group by 1)
 select vec_id, {R('sum((i + 1) * ((x - ms.m) * sqrt((mt.v + 0.01) / (ms.v + 0.01)) + mt.m))')} as checksum, {R('max((x - ms.m) * sqrt((mt.v + 0.01) / (ms.v + 0.01)) + mt.m)')} as top from tr join ms using (i) join mt using (i) group by 1""")
def _(t):
    d = vecs(t)
    a = tr.coral_diag(d.filter("label < 5"), d.filter("label >= 5"), "embedding", 64, LAM)
    s = F.aggregate(F.transform("aligned", lambda x, i: x * (i + 1)), F.lit(0.0), lambda p, q: p + q)
    return a.select("vec_id", r6(s).alias("checksum"), r6(F.array_max("aligned")).alias("top"))


@query("M20_zscore_align", f"""with e as (select vec_id, label % 3 as c, i, embedding[i + 1]::double as x from embeddings, {E64}), z as (select vec_id, i, (x - avg(x) over (partition by c, i)) / (stddev_samp(x) over (partition by c, i) + 1e-9) as z from e)
 select vec_id, {R('sum((i + 1) * z)')} as checksum, {R('max(z)')} as top from z group by 1""")
def _(t):
    a = tr.zscore_align(vecs(t), "corpus", "embedding", 64)
    s = F.aggregate(F.transform("aligned", lambda x, i: x * (i + 1)), F.lit(0.0), lambda p, q: p + q)
    return a.select("vec_id", r6(s).alias("checksum"), r6(F.array_max("aligned")).alias("top"))


@query("M23_applicability", f"""with {SIDES}, {knn_sql('tr', 'tr', 5, 'where a.vec_id <> b.vec_id')}, m as (select q, avg(d) as d from nn group by 1),
 s as (select avg(d) as y, stddev_pop(d) as sd from m), {knn_sql('te', 'tr', 5).replace('dd', 'de').replace('nn as', 'ne as')}, mt as (select q, avg(d) as d from ne group by 1)
 select {R('any_value(y)')} as mean_distance, {R('any_value(sd)')} as sd_distance, {R('any_value(0.5 * sd + y)')} as threshold, count(*) as n_test, {R('avg((d <= 0.5 * sd + y)::int)')} as share_inside from mt, s""")
def _(t):
    d = t.embeddings
    a = tr.applicability(d.filter("label < 5"), d.filter("label >= 5"), "vec_id", "embedding", 5, 0.5)
    return rounded(a, "mean_distance", "sd_distance", "threshold", "share_inside")


@query("M33_binned_effect", f"""select bin::int as bin, count(*) as n, {R('avg(o_totalprice)')} as x_mean, {R('avg(o_custkey)')} as y_mean
 from (select ntile(10) over (order by o_totalprice, o_orderkey) as bin, * from orders) group by 1""")
def _(t):
    return rounded(tr.binned_effect(t.orders, "o_totalprice", "o_custkey", "o_orderkey", 10), "x_mean", "y_mean")


def boost_sql(dim, bins, rounds, rate):
    """Pairs of bins counted by a join, the rounds by recursion over (round, feature)."""
    c = dim * bins
    edges = ", ".join(str(i / bins) for i in range(1, bins))
    return f"""with recursive e as (select vec_id, embedding[64]::double as y, i, embedding[i + 1]::double as x from embeddings, (select unnest(range({dim})) as i)),
 q as (select i, quantile_cont(x, [{edges}]) as es from e group by 1), b as (select vec_id, y, i * {bins} + len(list_filter(es, lambda v: v < x)) as c from e join q using (i)),
 cs as (select unnest(range({c})) as c), g as (select p.c as c, r.c as d, count(*)::double as n from b p join b r using (vec_id) group by 1, 2),
 gm as (select list(coalesce(n, 0) order by x.c, z.c) as g from cs x cross join cs z left join g on g.c = x.c and g.d = z.c),
 sm as (select list(coalesce(s, 0) order by c) as s, list(coalesce(n, 0)::double order by c) as n from cs left join (select c, sum(y) as s, count(*) as n from b group by 1) using (c)),
 m as (select avg(y) as mean from (select distinct vec_id, y from b)),
 st(k, sh) as (select 0, [0.0::double for j in range({c})] union all
  select k + 1, [case when j // {bins} = k % {dim} then sh[j + 1] + {rate} * coalesce((s[j + 1] - mean * n[j + 1] - list_sum([g[j * {c} + l + 1] * sh[l + 1] for l in range({c})])) / nullif(n[j + 1], 0), 0) else sh[j + 1] end for j in range({c})]
  from st, gm, sm, m where k < {dim * rounds}),
 fin as (select unnest(range({c})) as c, unnest(sh) as sh, unnest(n) as n from st, sm where k = {dim * rounds}),
 ct as (select c // {bins} as f, sum(sh * n) / sum(n) as o from fin group by 1),
 sh as (select f::int as feature, (c % {bins})::int as bin, n::bigint as n, sh - o as shape, mean + (select sum(o) from ct) as intercept from fin join ct on f = c // {bins}, m)"""


@query("M33_boosted_shapes", f"""{boost_sql(5, 4, 30, 0.2)} select feature, bin, n, {R('shape')} as shape, {R('intercept')} as intercept from sh""")
def _(t):
    s = ad.additive_shapes(vecs(t), "v", 5, "y", 4, 30, 0.2)
    return rounded(s.select("feature", "bin", "n", "shape", "intercept"), "shape", "intercept")


@query("M33_shape_importance", f"""{boost_sql(5, 4, 30, 0.2)} select feature, {R('sum(abs(shape) * n) / sum(n)')} as importance from sh group by 1""")
def _(t):
    return rounded(ad.shape_importance(ad.additive_shapes(vecs(t), "v", 5, "y", 4, 30, 0.2)), "importance")


# ridge by Gram matrices ---------------------------------------------------------

@query("M11_ridge_cv")
def _(t):
    d = vecs(t)
    alpha, b0, b = ln.ridge_cv(d, "v", 63, "y")
    p = ln.predict(d, [], "v", {("m",): (b0, b)}, {(0,): [("m",)]}, ["vec_id", "y"], ["model"])
    return p.select("vec_id", r6("y").alias("y"), r6("pred").alias("pred"), F.lit(float(alpha)).alias("alpha"))


def with_folds(t, k=3):
    d = vecs(t)
    return d.join(tr.group_folds(d, "vec_id", k, "folds"), "vec_id")


@query("M14_oof_ridge")
def _(t):
    from ..operators.stats import reg_score
    p = ln.ridge_oof(with_folds(t), "corpus", "fold", "vec_id", "v", 63, "y")
    return rounded(reg_score(p, ["corpus"], "y", "pred"), "spearman", "pearson", "r2", "mae")


@query("M15_transfer_ridge")
def _(t):
    return rounded(ln.transfer_ridge(vecs(t), "corpus", "vec_id", "v", 63, "y"), "rho")


@query("M17_few_shot")
def _(t):
    from ..operators.stats import recovered
    d = vecs(t)
    fs = ln.few_shot(d, "corpus", "vec_id", "v", 63, "y", [20, 40], 3, "m17")
    zero = ln.transfer_ridge(d, "corpus", "vec_id", "v", 63, "y").select("source", "target", F.col("rho").alias("zero"))
    ceil = ln.ridge_oof(with_folds(t), "corpus", "fold", "vec_id", "v", 63, "y")
    from ..operators.stats import spearman
    c = spearman(ceil, ["corpus"], "y", "pred", "ceiling").select(F.col("corpus").alias("target"), "ceiling")
    m = fs.groupBy("source", "target", "k").agg(F.avg("rho").alias("rho")).join(zero, ["source", "target"]).join(c, "target")
    return rounded(recovered(m, ["source", "target"], "k", "rho", "zero", "ceiling"), "median_all", "median_balanced")


@query("M19_coral")
def _(t):
    d = vecs(t)
    a, _b = ln.coral(d.filter("domain = 'A'"), d.filter("domain = 'B'"), "v", 63, LAM)
    return a.select("vec_id", r6(F.aggregate("aligned", F.lit(0.0), lambda p, q: p + q)).alias("checksum"), r6(F.col("aligned")[0]).alias("first"))


@query("M21_subspace_align")
def _(t):
    d = vecs(t)
    a, b = ln.subspace_align(d.filter("domain = 'A'"), d.filter("domain = 'B'"), "v", 63, 10)
    u = a.unionByName(b)
    return u.select("vec_id", "domain", r6(F.col("aligned")[0]).alias("first"), F.size("aligned").alias("dim"))
