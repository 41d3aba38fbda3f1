"""Source, sink, label and set queries."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions.core import nan_to_null, r6
from ..operators import labels as lb
from ..sources import scan as sc
from ..sources import sinks as sk
from .registry import EV, R, U, query
from .stats import TYPES, rounded


@query("S1_scan_pruned", "select l_returnflag, count(*) as n, max(l_quantity) as max_qty from lineitem group by 1")
def _(t):
    d = sc.load(t.spark, t.dir, "lineitem", ["l_returnflag", "l_quantity"])
    return d.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("max_qty"))


@query("S2_csv_scan", f"select s_suppkey, s_name, {R('s_acctbal')} as s_acctbal from supplier")
def _(t):
    p = sk.scratch(t.spark, "csv")
    t.supplier.select(F.col("s_suppkey").alias(" id "), F.col("s_name").alias("name "), F.col("s_acctbal").alias("bal")).write.option(
        "sep", ";").option("header", True).csv(p)
    d = sc.read_table(t.spark, p, sep=";")
    return d.select(F.col("id").try_cast("bigint").alias("s_suppkey"), F.col("name").alias("s_name"),
                    r6(F.col("bal").try_cast("double")).alias("s_acctbal"))


@query("S3_many_files", f"select event_type, count(*) as n, {R('avg(value)')} as mean from events group by 1")
def _(t):
    p = sk.scratch(t.spark, "many")
    sk.write(t.events.select("event_id", "value", "event_type"), p, "csv", ["event_type"])
    d = sc.read_many(t.spark, os.path.join(p, "*"), r"event_type=([a-z]+)", "event_type", schema="event_id bigint, value double")
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))


@query("S4_union_drift", """select c_custkey as id, c_name as name, c_acctbal as balance from customer
 union all select s_suppkey, s_name, s_acctbal from supplier""")
def _(t):
    b = t.supplier.withColumnsRenamed({"s_suppkey": " SuppKey", "s_acctbal": "AcctBal "})
    return sc.union_drift([t.customer, b], {"c_custkey": "id", "suppkey": "id", "c_name": "name", "s_name": "name",
                                            "c_acctbal": "balance", "acctbal": "balance"}, ["id", "name", "balance"])


@query("S5_optional_source", "select quality, toxic, count(*) as n, max(n_chars) as longest from documents join labels using (doc_id) group by 1, 2")
def _(t):
    d = sc.load_joined(t.spark, t.dir, "documents", "labels", "doc_id")
    d = d.join(sc.try_load(t.spark, t.dir, "no_such_table") or t.labels.select("doc_id"), "doc_id")
    return d.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest"))


@query("S6_wide_to_long", f"""with {EV} select user_id, (k // 20)::int as ms, {R('avg(value)')} as x from ev group by 1, 2""")
def _(t):
    d = t.ratings.withColumn("b", F.floor(F.col("k") / 20).cast("int"))
    wide = d.groupBy("user_id").pivot("b", [0, 1, 2, 3, 4]).agg(F.avg("value"))
    wide = wide.withColumnsRenamed({str(i): f"sample_{i}ms" for i in range(5)})
    return rounded(sc.to_long(wide, ["user_id"], r"^sample_(\d+)ms$", "ms", "x"), "x")


@query("S7_result_sink", f"select o_orderpriority, count(*) as n, {R('avg(o_totalprice)')} as mean from orders group by 1")
def _(t):
    d = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("o_totalprice")).alias("mean"))
    p = sk.write(d, sk.scratch(t.spark, "result"), "csv")
    return t.spark.read.option("header", True).schema(d.schema).csv(p)


@query("S8_cached", f"select l_suppkey, count(*) as n, {R('avg(l_quantity)')} as mean from lineitem group by 1")
def _(t):
    mark = sk.fingerprint(t.lineitem, ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"])
    d = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("l_quantity")).alias("mean"))
    sk.cached(d, "supplier_means", mark)
    return sk.cached(d, "supplier_means", mark)


RUN_HASH = ", '|', ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::bigint)::hugeint" for i in range(4))


@query("S9_run_record", f"""select 'price_summary' as name, 42 as seed, '0.05' as alpha, '20' as n_perm, {R('avg(o_totalprice)')} as mean_price, count(*)::double as n, count(*) as n_rows,
 sha256(concat(count(*), '|', {RUN_HASH})) as sha256 from (select o_totalprice, md5(concat(length(o_orderkey::varchar), ':', o_orderkey, length(o_custkey::varchar), ':', o_custkey)) as h from orders)""")
def _(t):
    m = t.orders.agg(F.avg("o_totalprice").alias("mean_price"), F.count(F.lit(1)).alias("n"))
    rec = sk.run_record(t.orders.select("o_orderkey", "o_custkey"), "price_summary", 42, {"alpha": 0.05, "n_perm": 20}, m)
    p = sk.write(rec, sk.scratch(t.spark, "record"), "json")
    back = t.spark.read.schema(rec.schema).json(p)
    return back.select("name", "seed", F.col("params")["alpha"].alias("alpha"), F.col("params")["n_perm"].alias("n_perm"), r6(F.col("metrics")["mean_price"]).alias("mean_price"),
                       F.col("metrics")["n"].alias("n"), "input.n_rows", "input.sha256")


@query("S10_latest_run", """with r as (select strftime(ts, '%Y%m%dT%H%M%S') || '_' || event_type as name, event_id as stamp from events)
 select name, stamp from r where name like '%\\_purchase' escape '\\' order by stamp desc limit 1""")
def _(t):
    r = t.events.select(F.concat(F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lit("_"), "event_type").alias("name"),
                        F.col("event_id").alias("stamp"))
    return sk.latest(r, "name", "stamp", "_purchase")


@query("S11_flatten_metrics", f"""select 'a' || (l_linenumber % 3) as algorithm, l_returnflag as source, l_linestatus as target,
 {R('avg(l_quantity)')} as rho, count(*) as n from lineitem group by 1, 2, 3""")
def _(t):
    g = t.lineitem.groupBy(F.concat(F.lit("a"), (F.col("l_linenumber") % 3).cast("string")).alias("algo"),
                           "l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("rho"), F.count(F.lit(1)).alias("n"))
    key = F.concat("algo", F.lit("|"), "l_returnflag", F.lit("->"), "l_linestatus")
    j = g.select("algo", F.to_json(F.create_map(key, F.struct("rho", "n"))).alias("metrics"))
    return rounded(sk.flatten_metrics(j, "metrics"), "rho")


def inv_sql(c, src, key, unit, size):
    return f"""select '{c}' as corpus, count(*) as n_rows, count(distinct {unit}) as n_units, (select avg(s) from (
 select {size} as s, row_number() over (order by {U('inv', key)}, {key}::varchar) as r from {src}) where r <= 50) as sm,
 least(count(*), 50) as ns from {src}"""


@query("S12_inventory", f"""select corpus, n_rows, n_units, {R('sm')} as sample_mean, ns as n_sampled, {R('sm * n_rows')} as estimated_total from (
 {inv_sql('documents', 'documents', 'doc_id', 'source', 'n_chars::double')} union all
 {inv_sql('orders', 'orders', 'o_orderkey', 'o_custkey', 'o_totalprice / 3600.0::double')} union all
 {inv_sql('events', 'events', 'event_id', 'user_id', 'value')})""")
def _(t):
    d = sk.inventory({
        "documents": (t.documents, "doc_id", "source", F.col("n_chars").cast("double")),
        "orders": (t.orders, "o_orderkey", "o_custkey", F.col("o_totalprice") / 3600.0),
        "events": (t.events, "event_id", "user_id", F.col("value"))}, 50, "inv")
    return rounded(d, "sample_mean", "estimated_total")


PARTS = """pp as (select l_partkey, avg(l_quantity) / 50.0::double as a, avg(l_discount) * 10.0::double as v,
 stddev_samp(l_quantity) / 50.0::double as a_sd, stddev_samp(l_discount) * 10.0::double as v_sd from lineitem group by 1)"""


def parts(t):
    """Means and SDs of parts; many lie on a threshold, where the order of summation would decide."""
    return t.lineitem.groupBy("l_partkey").agg(
        F.round(F.avg("l_quantity") / 50.0, 12).alias("a"), F.round(F.avg("l_discount") * 10.0, 12).alias("v"),
        F.round(F.stddev_samp("l_quantity") / 50.0, 12).alias("a_sd"), F.round(F.stddev_samp("l_discount") * 10.0, 12).alias("v_sd"))


@query("P1_extreme_labels", f"""with {PARTS} select l_partkey, {R('a')} as a, {R('v')} as v, (a <= 0.48)::int as label,
 case when a <= 0.48 then 'low' else 'high' end as category from pp where a_sd <= 0.32 and v_sd <= 0.32
 and ((a <= 0.48 and v >= 0.45) or (a >= 0.53 and not (a <= 0.48 and v >= 0.45)))""")
def _(t):
    d = lb.extreme_labels(parts(t), "a", "v", ["a_sd", "v_sd"], 0.48, 0.53, 0.45, 0.32)
    return rounded(d.select("l_partkey", "a", "v", "label", "category"), "a", "v")


@query("P2_category_labels", """select o_orderkey, o_orderpriority, (o_orderpriority in ('1-URGENT','2-HIGH'))::int as label,
 'none' as missing from orders where o_orderpriority in ('1-URGENT','2-HIGH','5-LOW')
 union all select null, null, null, '9-ABSENT'""")
def _(t):
    pos, neg = ["1-URGENT", "2-HIGH"], ["5-LOW", "9-ABSENT"]
    d = lb.category_labels(t.orders, "o_orderpriority", pos, neg).select("o_orderkey", "o_orderpriority", "label", F.lit("none").alias("missing"))
    m = lb.missing_categories(t.orders, "o_orderpriority", pos + neg)
    return d.unionByName(m.select(F.col("o_orderpriority").alias("missing")), allowMissingColumns=True)


@query("P3_rescale", f"select p_partkey, {R('(p_size - 25.5::double) / 24.5::double')} as arousal from part")
def _(t):
    return t.part.select("p_partkey", r6(lb.rescale(F.col("p_size"), 1.0, 50.0)).alias("arousal"))


@query("P4_group_key", r"""select page_id, coalesce(nullif(regexp_extract(url, '/([0-9]{3,})', 1), ''), 'p' || page_id) as grp from pages""")
def _(t):
    return t.pages.select("page_id", lb.group_key("url", r"/([0-9]{3,})", F.concat(F.lit("p"), F.col("page_id").cast("string"))).alias("grp"))


@query("P5_feature_columns", " union all ".join(f"select '{c}' as feature, {R(f'avg({c})')} as mean from lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def _(t):
    a = t.lineitem.withColumn("l_extra", F.col("l_tax") * 2)
    cols = lb.feature_cols([t.lineitem, a], [t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")])
    return a.agg(*[r6(F.avg(c)).alias(c) for c in cols]).unpivot([], cols, "feature", "mean")


LEAK = ["l_quantity", "p_size", "p_retailprice", "l_tax"]


@query("P6_leak_columns", "with j as (select l_partkey, l_quantity, p_size::double as p_size, p_retailprice, l_tax from lineitem join part on l_partkey = p_partkey) "
       + " union all ".join(f"select '{c}' as feature, {R(f'max(coalesce(s,0))')} as max_sd, max(coalesce(s,0)) < 1e-9 as leak from (select stddev_samp({c}) as s from j group by l_partkey)" for c in LEAK))
def _(t):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rounded(lb.leak_columns(d, "l_partkey", LEAK), "max_sd")


@query("P7_drop_noise", """select event_id, user_id from events where not (event_type = 'error' or value < 1.0 or regexp_extract(props, '([0-9]+)', 1) in ('0', '13'))""")
def _(t):
    d = lb.drop_noise(t.ratings, [F.col("event_type") == "error", F.col("value") < 1.0, F.col("k").isin(0, 13)])
    return d.select("event_id", "user_id")


@query("P8_min_support", f"""with {EV} select event_id, user_id, k from ev where user_id in (select user_id from ev group by 1 having count(*) >= 65)
 and k in (select k from ev group by 1 having count(distinct user_id) >= 70)""")
def _(t):
    d = t.ratings
    a = lb.min_support(d, "user_id", 65)
    b = lb.min_support(d, "k", 70, "user_id").select("event_id")
    return a.join(b, "event_id", "left_semi").select("event_id", "user_id", "k")


@query("P9_tag_features", r"""select p_partkey, case when regexp_matches(p_name, '^(red|blue)') then 'primary'
 when regexp_matches(p_name, 'ring|gear') then 'round' when regexp_matches(p_name, '^small|^large') then 'sized' else 'other' end as family,
 case when replace(p_name, ' ', '_') like '%\_widget' escape '\' then 'widget' when replace(p_name, ' ', '_') like '%\_ring' escape '\' then 'ring' else 'raw' end as stat from part""")
def _(t):
    fam = lb.tag_features("p_name", [("^(red|blue)", "primary"), ("ring|gear", "round"), ("^small|^large", "sized")])
    st = lb.suffix_tag(F.replace("p_name", F.lit(" "), F.lit("_")), ["widget", "ring"])
    return t.part.select("p_partkey", fam.alias("family"), st.alias("stat"))


@query("P10_spread_columns", f"""select l_suppkey, {R('avg(l_quantity)')} as qty_avg, {R('quantile_cont(l_quantity, 0.95) - quantile_cont(l_quantity, 0.05)')} as qty_range
 from lineitem group by 1""")
def _(t):
    from ..operators.ordered import quantiles
    q = quantiles(t.lineitem, ["l_suppkey"], "l_quantity", {"qty_p05": 0.05, "qty_p95": 0.95})
    a = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("qty_avg"))
    return rounded(lb.spread_columns(a.join(q, "l_suppkey"), ["qty"]).select("l_suppkey", "qty_avg", "qty_range"), "qty_avg", "qty_range")


CLIP = """clips as (select p_partkey, case when p_size % 3 = 0 then 'orig_' || p_partkey when p_size % 3 = 1
 then 'mix_within_' || lower(p_type) || '_' || (p_size % 7) || '-1_' || (p_partkey % 5) || '-2'
 else 'mix_cross_' || lower(p_type) || '_' || split_part(p_name, ' ', 2) || '_' || (p_size % 7) || '-3_' || (p_partkey % 5) || '-1' end as clip_id from part)"""


def clips(t):
    s = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    a, b = s(F.col("p_size") % 7), s(F.col("p_partkey") % 5)
    kind = F.lower("p_type")
    return t.part.select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("orig_"), s("p_partkey"))).when(
        F.col("p_size") % 3 == 1, F.concat(F.lit("mix_within_"), kind, F.lit("_"), a, F.lit("-1_"), b, F.lit("-2"))).otherwise(
        F.concat(F.lit("mix_cross_"), kind, F.lit("_"), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("_"), a, F.lit("-3_"), b, F.lit("-1"))
    ).alias("clip_id"))


@query("P11_constituent_set", f"""with {CLIP}, p as (select *, split_part(clip_id, '_', 2) as kind, string_split(clip_id, '_') as tk from clips),
 q as (select p_partkey, clip_id, case when kind = 'within' then [tk[3] || '#' || split_part(tk[4], '-', 1), tk[3] || '#' || split_part(tk[5], '-', 1)]
 when kind = 'cross' then [tk[3] || '#' || split_part(tk[5], '-', 1), tk[4] || '#' || split_part(tk[6], '-', 1)] else [] end as l from p)
 select p_partkey, clip_id, array_to_string(list_sort(l), ',') as parts from q""")
def _(t):
    return clips(t).withColumn("parts", F.array_join(lb.constituent_set("clip_id"), ","))


@query("P12_fill_zero", f"select l_returnflag, {R('avg(case when l_discount = 0 then 0 else l_tax / l_discount end)')} as m from lineitem group by 1")
def _(t):
    x = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.try_divide("l_tax", "l_discount"))
    d = lb.fill(t.lineitem.withColumn("x", x), ["x"], "zero")
    return d.groupBy("l_returnflag").agg(r6(F.avg("x")).alias("m"))


@query("P12_fill_median", f"""with d as (select l_returnflag, l_linenumber, nullif(l_discount, 0) as x from lineitem),
 m as (select quantile_cont(x, 0.5) as m from d where l_linenumber < 4)
 select l_returnflag, {R('avg(coalesce(x, m))')} as mean, count(*) as n from d, m group by 1""")
def _(t):
    d = t.lineitem.withColumn("x", F.nullif("l_discount", F.lit(0.0)))
    d = lb.fill(d, ["x"], "median", F.col("l_linenumber") < 4)
    return d.groupBy("l_returnflag").agg(r6(F.avg("x")).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("P13_stim_key", "select l_returnflag || '|' || l_linestatus || '|' || l_linenumber as stim, count(*) as n from lineitem group by 1")
def _(t):
    return t.lineitem.groupBy(lb.stim_key("l_returnflag", "l_linestatus", "l_linenumber").alias("stim")).agg(F.count(F.lit(1)).alias("n"))


@query("U1_with_variants", """select variant, kind, count(*) as n from (
 select 'published' as variant, 'order' as kind from orders union all select 'published', 'part' from part
 union all select 'clean', 'order' from orders where o_orderstatus <> 'P' union all select 'clean', 'part' from part) group by 1, 2""")
def _(t):
    o = t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    p = t.part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"))
    v = lb.with_variants({"published": o, "clean": o.filter("o_orderstatus <> 'P'")}, [p])
    return v.groupBy("variant", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("U2_common_keys", """select l_partkey from lineitem where l_returnflag = 'A' intersect select l_partkey from lineitem where l_discount = 0.1
 intersect select p_partkey from part where p_size > 20""")
def _(t):
    li = t.lineitem
    return lb.common([li.filter("l_returnflag = 'A'"), li.filter("l_discount = 0.1"),
                      t.part.filter("p_size > 20").select(F.col("p_partkey").alias("l_partkey"))], "l_partkey")


@query("U3_missing_keys", "select o_orderkey from orders except select l_orderkey from lineitem where l_discount > 0.05")
def _(t):
    return lb.missing(t.orders, t.lineitem.filter("l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("U4_first_wins", """select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) as r from events) where r = 1""")
def _(t):
    return lb.first_wins(t.events.select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).drop("ts")
