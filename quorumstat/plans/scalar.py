"""Scalar, string, array and JSON function queries (F1-F16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import normal, r6, u01
from ..operators import vectors as v
from ..operators.ordered import scan
from ..sources.sinks import content_hash
from .registry import NORMAL, R, U, query
from .stats import rounded


@query("F1_prefix_suffix", "select c_custkey, cast(replace(c_name, 'Customer#', '') as bigint) as id from customer")
def _(t):
    return t.customer.select("c_custkey", F.regexp_replace("c_name", "^Customer#", "").cast("bigint").alias("id"))


@query("F2_regex_split", r"""select page_id, regexp_extract(url, '://([^/]+)/', 1) as host, split_part(split_part(url, '/', 4), '?', 1) as lang,
 split_part(url, '?', 2) as qs from pages""")
def _(t):
    return t.pages.select("page_id", F.regexp_extract("url", "://([^/]+)/", 1).alias("host"),
                          F.split_part(F.split_part("url", F.lit("/"), F.lit(4)), F.lit("?"), F.lit(1)).alias("lang"),
                          F.split_part("url", F.lit("?"), F.lit(2)).alias("qs"))


@query("F3_tolerant_cast", "select p_partkey, try_cast(case when p_size % 5 = 0 then 'None' else p_size || '.5' end as double) as x from part")
def _(t):
    s = F.when(F.col("p_size") % 5 == 0, "None").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5")))
    return t.part.select("p_partkey", s.try_cast("double").alias("x"))


@query("F4_trim_fold", "select n_nationkey, lower(n_name) as name from nation")
def _(t):
    return t.nation.select("n_nationkey", F.lower(F.trim(F.concat(F.lit("  "), "n_name", F.lit(" ")))).alias("name"))


@query("F5_decibel", f"""select event_id, {R('20 * log10(value + 1e-8::double)')} as db, {R('pow(10.0::double, value / 200.0::double)')} as gain from events""")
def _(t):
    return t.events.select("event_id", r6(v.to_db("value")).alias("db"), r6(v.from_db(F.col("value") / 10.0)).alias("gain"))


@query("F6_shrink_range", f"""with d as (select event_id, user_id, (event_id % 4)::int as dose, 20 * log10(value + 1e-8::double) as db from events),
 m as (select user_id, avg(db) as m from d group by 1), s as (select *, case dose when 0 then 0 when 1 then 0.4 when 2 then 0.7 else 0.9 end::double as st from d join m using (user_id))
 select event_id, dose, {R('pow(10.0::double, (m + (db - m) * (1 - st) - db) / 20)')} as gain from s""")
def _(t):
    d = t.events.withColumn("dose", (F.col("event_id") % 4).cast("int"))
    return v.shrink_range(d, ["user_id"], "value", "dose").select("event_id", "dose", r6("gain").alias("gain"))


def vals(name, xs):
    return f"{name} as (select unnest([{','.join(map(str, xs))}]::double[]) as w, unnest(range({len(xs)})) as i)"


CH = """ch as (select vec_id, i, abs(embedding[i + 1])::double as c from embeddings, (select unnest(range(12)) as i))"""


def chroma(t):
    return t.embeddings.select("vec_id", F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x).cast("double")).alias("c"))


@query("F7_template_match", f"""with {CH}, {vals('maj', v.KEY_MAJOR)}, {vals('mnr', v.KEY_MINOR)},
 tp as (select 'a' as m, i, w from maj union all select 'b', i, w from mnr),
 s as (select vec_id, m, k, covar_samp(c, w) / nullif(stddev_samp(c) * stddev_samp(w), 0) as r from ch, (select unnest(range(12)) as k), tp
 where tp.i = (ch.i - k + 12) % 12 group by 1, 2, 3),
 b as (select vec_id, m, max(r) as best, arg_min(k, (-round(r, 12), k)) as k from s group by 1, 2),
 al as (select vec_id, max(r) - avg(r) as clarity from s group by 1)
 select a.vec_id, {R('a.best')} as major_strength, {R('n.best')} as minor_strength, (case when a.best >= n.best then a.k else n.k end)::int as tonic,
 {R('a.best - n.best')} as mode_score, {R('clarity')} as clarity from b a join b n on a.vec_id = n.vec_id and a.m = 'a' and n.m = 'b' join al on al.vec_id = a.vec_id""")
def _(t):
    d = v.key_summary(chroma(t), "c").drop("c")
    return rounded(d, "major_strength", "minor_strength", "mode_score", "clarity")


@query("F8_circular_form", f"""with {CH}, {vals('wt', v.CONSONANCE)}, n as (select vec_id, i, c / greatest(sum(c) over (partition by vec_id), 1e-12) as p from ch)
 select a.vec_id, {R('sum(a.p * b.p * w)')} as consonance from n a join n b using (vec_id) join wt on wt.i = (b.i - a.i + 12) % 12 group by 1""")
def _(t):
    return chroma(t).select("vec_id", r6(v.circular_form("c")).alias("consonance"))


@query("F9_entropy", f"""with {CH}, n as (select vec_id, c / greatest(sum(c) over (partition by vec_id), 1e-12) as p from ch)
 select vec_id, {R('-sum(p * ln(p + 1e-12::double))')} as entropy from n group by 1""")
def _(t):
    return chroma(t).select("vec_id", r6(v.entropy("c")).alias("entropy"))


@query("F10_flux", f"""with e as (select label, vec_id, i, embedding[i + 1]::double as x from embeddings, (select unnest(range(64)) as i)),
 d as (select label, vec_id, i, x - lag(x) over (partition by label, i order by vec_id) as d from e),
 f as (select label, vec_id, sqrt(sum(d * d)) as f from d group by 1, 2)
 select label, count(f) as n, {R('avg(f)')} as flux_mean, {R('stddev_pop(f)')} as flux_std from f group by 1""")
def _(t):
    d = t.embeddings.select("label", "vec_id", v.doubles("embedding").alias("e"))
    d = scan(d, ["label"], ["vec_id"], F.col("vec_id"), {"prev": ("lag", "e")})
    f = d.withColumn("f", v.distance(F.col("e"), F.col("prev")))
    return f.groupBy("label").agg(F.count("f").alias("n"), r6(F.avg("f")).alias("flux_mean"), r6(F.stddev_pop("f")).alias("flux_std"))


@query("F11_band_share_slope", f"""with e as (select vec_id, i, abs(embedding[i + 1])::double as x from embeddings, (select unnest(range(64)) as i))
 select vec_id, {R('sum(x) filter (i >= 8 and i < 24) / nullif(sum(x), 0)')} as share,
 {R('regr_slope(log10(x), log10(i)) filter (i >= 2 and i < 48 and x > 0)')} as slope from e where i > 0 or true group by 1""".replace(
    "log10(i))", "log10(greatest(i, 1)))"))
def _(t):
    d = t.embeddings.select("vec_id", F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("e"))
    return d.select("vec_id", r6(v.band_share("e", 8, 24)).alias("share"), r6(v.loglog_slope("e", 2, 48)).alias("slope"))


@query("F12_row_z_similarity", f"""with e as (select vec_id, i % 32 as j, i // 32 as h, embedding[i + 1]::double as x from embeddings, (select unnest(range(64)) as i)),
 z as (select vec_id, j, h, (x - avg(x) over (partition by vec_id, h)) / greatest(stddev_pop(x) over (partition by vec_id, h), 1e-9) as z from e)
 select a.vec_id, {R('sum(a.z * b.z) / 32')} as sim from z a join z b on a.vec_id = b.vec_id and a.j = b.j and a.h = 0 and b.h = 1 group by 1""")
def _(t):
    a, b = v.row_z(F.slice("embedding", 1, 32)), v.row_z(F.slice("embedding", 33, 32))
    return t.embeddings.select("vec_id", r6(v.similarity(a, b)).alias("sim"))


@query("F13_log_asymmetry", f"""select c_custkey, {R('ln(greatest(c_acctbal, 1e-20::double)) - ln(greatest(c_nationkey, 1e-20::double))')} as asym from customer""")
def _(t):
    return t.customer.select("c_custkey", r6(v.log_asymmetry("c_acctbal", F.col("c_nationkey").cast("double"))).alias("asym"))


@query("F14_json_field", "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


LANES = ", '|', ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::bigint)::hugeint" for i in range(4))


@query("F15_content_hash", f"""select o_orderpriority, count(*) as n_rows, sha256(concat(count(*), '|', {LANES})) as content_hash from (
 select o_orderpriority, md5(concat(length(o_orderkey::varchar), ':', o_orderkey, length(o_custkey::varchar), ':', o_custkey, length(o_orderstatus), ':', o_orderstatus)) as h from orders) group by 1""")
def _(t):
    return content_hash(t.orders, ["o_orderkey", "o_custkey", "o_orderstatus"], ["o_orderpriority"])


@query("F16_keyed_random", f"""select event_id, {R(U('f16', '3', 'event_id'))} as u, {R(NORMAL('f16', '3', 'event_id'))} as z from events""")
def _(t):
    return t.events.select("event_id", r6(u01("f16", 3, "event_id")).alias("u"), r6(normal("f16", 3, "event_id")).alias("z"))
