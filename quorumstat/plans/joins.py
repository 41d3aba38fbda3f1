"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import r6, u01
from ..operators import joins as jn
from ..operators import timeline as tl
from ..operators.neighbours import knn
from ..operators.vectors import row_z
from .registry import EV, R, U, query
from .stats import rounded


@query("J1_one_to_one", "select doc_id, quality, lang, n_chars from labels join documents using (doc_id)")
def _(t):
    return jn.join_1to1(t.labels, t.documents, ["doc_id"]).select("doc_id", "quality", "lang", "n_chars")


@query("J2_left_default", """select c_custkey, coalesce(first, 'u' || c_custkey) as first from customer left join (
 select o_custkey, min(o_orderpriority) as first from orders where o_totalprice > 400000 group by 1) on c_custkey = o_custkey""")
def _(t):
    b = t.orders.filter("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("first"))
    return jn.left_with_default(t.customer.select("c_custkey"), b, "c_custkey", "first")


@query("J3_keep_drop_keys", """select l_returnflag, count(*) as n from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')
 and l_partkey not in (select p_partkey from part where p_size > 25) group by 1""")
def _(t):
    keep = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    drop = t.part.filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    d = jn.drop_keys(jn.keep_keys(t.lineitem, keep, ["l_orderkey"]), drop, ["l_partkey"])
    return d.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("J4_common_sample", """with k as (select doc_id from documents intersect select doc_id from labels intersect select vec_id from embeddings)
 select 'documents' as source, count(*) as n from documents where doc_id in (select doc_id from k) union all
 select 'labels', count(*) from labels where doc_id in (select doc_id from k) union all
 select 'embeddings', count(*) from embeddings where vec_id in (select doc_id from k)""")
def _(t):
    names = ["documents", "labels", "embeddings"]
    ds = jn.common_sample([t.documents.select("doc_id"), t.labels.select("doc_id"), t.embeddings.select(F.col("vec_id").alias("doc_id"))], "doc_id")
    out = [d.agg(F.lit(n).alias("source"), F.count(F.lit(1)).alias("n")) for n, d in zip(names, ds)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def side(t, kind):
    return t.ratings.filter(F.col("event_type") == kind)


@query("J5_asof_backward", f"""with {EV}, a as (select a.user_id, a.event_id, a.sec, b.event_id as code_id, b.k as code, a.sec - b.sec as lead_s
 from (select * from ev where event_type = 'error') a asof left join (select * from ev where event_type = 'click') b
 on a.user_id = b.user_id and a.sec >= b.sec)
 select a.user_id, event_id, {R('sec')} as sec, code_id, code, {R('lead_s')} as lead_s,
 (count(distinct code_id) over (partition by a.user_id)) = (count(*) over (partition by a.user_id)) as bijective from a""".replace(
    "(count(distinct code_id) over (partition by a.user_id)) = (count(*) over (partition by a.user_id)) as bijective from a",
    "bijective from a join (select user_id, count(distinct code_id) = count(*) as bijective from a group by 1) using (user_id)"))
def _(t):
    a = side(t, "error").select("user_id", "event_id", "sec")
    b = side(t, "click").select("user_id", F.col("event_id").alias("code_id"), F.col("k").alias("code"), "sec")
    d = jn.asof_backward(a, b, ["user_id"], "sec", ["event_id"], ["code_id", "code"])
    return rounded(d, "sec", "lead_s")


@query("J6_nearest_within", f"""with {EV}, p as (select a.user_id, a.event_id, b.event_id as q_id, abs(a.sec - b.sec) as distance,
 row_number() over (partition by a.event_id order by abs(a.sec - b.sec), b.sec, b.event_id) as r from ev a join ev b on a.user_id = b.user_id
 and a.event_type = 'purchase' and b.event_type = 'view' and abs(a.sec - b.sec) <= 40000)
 select user_id, event_id, q_id, {R('distance')} as distance from p where r = 1""")
def _(t):
    a = side(t, "purchase").select("user_id", "event_id", "sec")
    b = side(t, "view").select("user_id", F.col("event_id").alias("q_id"), "sec")
    return rounded(jn.nearest_within(a, b, ["user_id"], "sec", ["event_id"], ["q_id"], 40000.0).drop("sec"), "distance")


@query("J7_close_join", f"""with {EV} select a.event_id, b.event_id as other_id, {R('b.sec - a.sec')} as gap from ev a join ev b on a.user_id = b.user_id
 and a.event_type = 'purchase' and b.event_type = 'view' and abs(a.sec - b.sec) <= 3600""")
def _(t):
    a = side(t, "purchase").select("user_id", "event_id", "sec")
    b = side(t, "view").select("user_id", F.col("event_id").alias("other_id"), F.col("sec").alias("osec"))
    d = jn.close_join(a, b, ["user_id"], "sec", "osec", 3600.0)
    return d.select("event_id", "other_id", r6(F.col("osec") - F.col("sec")).alias("gap"))


@query("J8_window_join", f"""with {EV} select a.event_id, count(*) as n, {R('avg(b.value)')} as mean from ev a join ev b on a.user_id = b.user_id
 and a.event_type = 'error' and b.event_type <> 'error' and b.sec >= a.sec - 43200 and b.sec < a.sec + 86400 group by 1""")
def _(t):
    a = side(t, "error").select("user_id", "event_id", F.col("sec").alias("onset"))
    b = t.ratings.filter("event_type <> 'error'").select("user_id", "sec", "value")
    d = jn.window_join(a, b, ["user_id"], "onset", "sec", -43200.0, 86400.0)
    return d.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))


GAPS = """gaps as (select user_id, p as gap_start, sec as gap_end from (select user_id, sec, lag(sec) over (partition by user_id order by sec, event_id) as p from ev)
 where sec - p > 86400)"""


@query("J9_drop_overlapping", f"""with {EV}, {GAPS} select event_id, user_id from ev e where event_type = 'error' and not exists (
 select 1 from gaps g where g.user_id = e.user_id and g.gap_start < e.sec + 43200 and g.gap_end > e.sec - 21600)""")
def _(t):
    g = tl.gaps(t.ratings, ["user_id"], "sec", ["sec", "event_id"], 86400.0)
    a = side(t, "error").select("user_id", "event_id", "sec")
    return jn.drop_overlapping(a, g, ["user_id"], "event_id", "sec", -21600.0, 43200.0).select("event_id", "user_id")


@query("J10_paired_diff", f"""with {EV}, r as (select *, row_number() over (partition by user_id, event_type order by sec, event_id) as trial from ev where event_type in ('purchase','view'))
 select user_id, trial, {R("max(value) filter (event_type = 'purchase') - max(value) filter (event_type = 'view')")} as d from r group by 1, 2
 having count(distinct event_type) = 2""")
def _(t):
    from ..operators.ordered import row_numbers
    d = t.ratings.filter(F.col("event_type").isin("purchase", "view"))
    d = row_numbers(d, ["user_id", "event_type"], ["sec", "event_id"], F.col("sec"), "trial")
    return rounded(jn.paired_diff(d, ["user_id", "trial"], "event_type", "purchase", "view", "value"), "d")


CORPORA = "c as (select distinct 'c' || label as name, case when label < 5 then 'A' else 'B' end as dom from embeddings)"


def corpora(t):
    return t.embeddings.select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("name"),
                               F.when(F.col("label") < 5, "A").otherwise("B").alias("dom"))


@query("J11_ordered_pairs", f"""with {CORPORA} select s.name as source, t.name as target,
 case when s.dom = t.dom then 'same-domain' else 'cross-domain' end as domain_match from c s, c t where s.name <> t.name""")
def _(t):
    return jn.ordered_pairs(corpora(t), "name", "dom").select("source", "target", "domain_match")


@query("J12_sham_source", f"""with {CORPORA}, x as (select s.name as source, t.name as target, case when s.dom = t.dom then 'same-domain' else 'cross-domain' end as domain_match,
 t.dom as td, arg_min(o.name, o.name) as third, arg_min(o.dom, o.name) as od from c s, c t, c o where s.name <> t.name and o.name not in (s.name, t.name) group by all)
 select source, target, domain_match, third, od <> td as sham_valid from x""")
def _(t):
    return jn.sham_source(jn.ordered_pairs(corpora(t), "name", "dom"))


@query("J13_with_grid", f"""select k, w, {R('avg(least(l_quantity, k) * w)')} as m, count(*) as n from lineitem, (select unnest([5, 10, 20]) as k),
 (select unnest([0.5::double, 1.5::double]) as w) group by 1, 2""")
def _(t):
    g = jn.with_grid(t.lineitem.select("l_quantity"), k=[5, 10, 20], w=[0.5, 1.5])
    return g.groupBy("k", "w").agg(r6(F.avg(F.least("l_quantity", F.col("k").cast("double")) * F.col("w"))).alias("m"),
                                   F.count(F.lit(1)).alias("n"))


@query("J14_mutual_best", f"""with e as (select vec_id, label % 2 as side, i, embedding[i + 1]::double as x from embeddings, (select unnest(range(64)) as i)),
 z as (select vec_id, side, i, (x - avg(x) over (partition by vec_id)) / greatest(stddev_pop(x) over (partition by vec_id), 1e-9) as z from e),
 s as (select a.vec_id as code, b.vec_id as clip, sum(a.z * b.z) / 64 as sim, round(sqrt(sum((a.z - b.z)**2)), 9) as d from z a join z b using (i) where a.side = 0 and b.side = 1 group by 1, 2),
 r as (select *, row_number() over (partition by code order by d, clip) as r1, row_number() over (partition by clip order by d, code) as r2 from s)
 select code, clip, {R('1 - d * d / 128')} as similarity from r where r1 = 1 and r2 = 1""")
def _(t):
    e = t.embeddings.select("vec_id", "label", row_z("embedding").alias("z"))
    a = e.filter(F.col("label") % 2 == 0).withColumnRenamed("vec_id", "code")
    b = e.filter(F.col("label") % 2 == 1).withColumnRenamed("vec_id", "clip")
    ab, ba = knn(a, b, "code", "clip", "z", 1), knn(b, a, "clip", "code", "z", 1)
    m = jn.mutual(ab, ba, "code", "clip")
    return m.select("code", "clip", r6(1 - F.col("distance") * F.col("distance") / 128.0).alias("similarity"))
