"""Merkle fixity audit of archive replicas.

A record's bytes are hashed; the hashes of an archive's records, in the order of their
offsets, are hashed by offset range, and ranges by ``fan`` up to a root. Replicas whose roots
agree are done with. Elsewhere only the children of mismatching nodes are compared, level by
level, and in the end the records of the mismatching ranges.

Archives, offsets or bytes may be null: a null archive is an archive of its own, a null offset
stands before all others, null bytes differ from empty ones. Repeated rows count as often as
they occur. A node has at most ``fan`` children, and a range the records of ``span`` bytes, so
no task gathers an archive. Two empty replicas agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store

SPAN, FAN = 1 << 20, 16
KINDS = ("changed", "missing", "extra")


def record(url: Column, body: Column) -> Column:
    """A response record as text; null where the body is."""
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def digests(replica: DataFrame, span: int) -> DataFrame:
    """archive, node (offset range), offset, digest and the number of equal records."""
    d = replica.select("archive", "offset", F.coalesce(F.sha2("bytes", 256), F.lit("null")).alias("digest"))
    d = d.groupBy("archive", "offset", "digest").agg(F.count(F.lit(1)).alias("times"))
    return d.withColumn("node", F.coalesce(F.floor(F.col("offset") / F.lit(span)), F.lit(-1)).cast("long"))


def ranges(leaves: DataFrame) -> DataFrame:
    """Level 0: one hash for each offset range."""
    own = F.array_sort(F.collect_list(F.struct(F.coalesce("offset", F.lit(-1)).alias("at"), "digest", "times")))
    text = F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["at"].cast("string"), x["digest"], x["times"].cast("string"))), ",")
    return leaves.groupBy("archive", "node").agg(F.sha2(text, 256).alias("hash"))


def above(level: DataFrame, fan: int) -> DataFrame:
    """The next level: one hash for each ``fan`` neighbouring nodes."""
    own = F.array_sort(F.collect_list(F.struct("node", "hash")))
    text = F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"])), ",")
    return level.groupBy("archive", F.floor(F.col("node") / F.lit(fan)).cast("long").alias("node")).agg(F.sha2(text, 256).alias("hash"))


def tree(leaves: DataFrame, height: int, fan: int) -> list[DataFrame]:
    """Levels from the ranges up; each is a kept table."""
    out = [store.keep(ranges(leaves), "merkle")]
    for _ in range(height):
        out.append(store.keep(above(out[-1], fan), "merkle"))
    return out


def mismatches(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose values differ or that one side lacks, with both values."""
    x, y = a.select(*keys, F.col(value).alias("a")), b.select(*keys, F.col(value).alias("b"))
    both = x.withColumn("side", F.lit(0)).withColumn("b", F.lit(None).cast("string")).unionByName(y.withColumn("side", F.lit(1)).withColumn("a", F.lit(None).cast("string")))
    met = both.groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return met.filter(~F.col("a").eqNullSafe(F.col("b")))


def below(level: DataFrame, bad: DataFrame, fan: int) -> DataFrame:
    """Children of the mismatching nodes alone."""
    b = bad.select(F.col("archive").alias("_archive"), F.col("node").alias("_node"))
    return level.join(b, level["archive"].eqNullSafe(b["_archive"]) & (F.floor(level["node"] / F.lit(fan)) == b["_node"]), "left_semi")


def audit(a: DataFrame, b: DataFrame, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """Differences of replica b from a: archive, node (range), offset, kind, digest_a, digest_b, times_a, times_b.

    Replicas have archive, offset and bytes.
    """
    la, lb = store.keep(digests(a, span), "records"), store.keep(digests(b, span), "records")
    top = max(x.agg(F.max("node")).first()[0] or 0 for x in (la, lb))
    height = 1
    while fan**height <= top:
        height += 1
    ta, tb = tree(la, height, fan), tree(lb, height, fan)
    bad = mismatches(ta[height], tb[height], ["archive", "node"], "hash")
    for level in range(height - 1, -1, -1):
        bad = store.keep(mismatches(below(ta[level], bad, fan), below(tb[level], bad, fan), ["archive", "node"], "hash"), "bad")
    ra, rb = below(la, bad, 1), below(lb, bad, 1)
    own = ["archive", "node", "offset"]
    pair = lambda d, s: d.withColumn("times_a", F.col("times") if s == "a" else F.lit(0)).withColumn("times_b", F.col("times") if s == "b" else F.lit(0))
    diff = pair(ra, "a").unionByName(pair(rb, "b")).groupBy(*own, "digest").agg(F.sum("times_a").alias("times_a"), F.sum("times_b").alias("times_b")).filter("times_a <> times_b")
    at = diff.groupBy(*own).agg(
        F.min(F.when(F.col("times_a") > F.col("times_b"), F.col("digest"))).alias("digest_a"), F.min(F.when(F.col("times_b") > F.col("times_a"), F.col("digest"))).alias("digest_b"),
        F.sum(F.greatest(F.col("times_a") - F.col("times_b"), F.lit(0))).alias("times_a"), F.sum(F.greatest(F.col("times_b") - F.col("times_a"), F.lit(0))).alias("times_b"))
    kind = F.when(F.col("digest_b").isNull(), F.lit("missing")).when(F.col("digest_a").isNull(), F.lit("extra")).otherwise(F.lit("changed"))
    return at.select(*own, kind.alias("kind"), "digest_a", "digest_b", "times_a", "times_b")


def archives(pages: DataFrame, each: int = 1000) -> DataFrame:
    """Pages as records of archives of ``each`` neighbouring ids, with byte offsets in the order of ids."""
    d = pages.select("page_id", F.floor(F.col("page_id") / each).cast("long").alias("archive"), record(F.col("url"), F.col("html")).alias("bytes"))
    length = F.coalesce(F.octet_length("bytes"), F.lit(0)).cast("long")
    sized = d.select("page_id", "archive", length.alias("_n"), F.sha2("bytes", 256).alias("_d"), "bytes")
    before = Window.partitionBy("archive").orderBy("page_id", "_d").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("page_id", "archive", "offset", "bytes")


def query(spark, sf_dir: str) -> DataFrame:
    """The pages against a replica in which some records were altered and some are gone."""
    a = store.keep(archives(spark.read.parquet(f"{sf_dir}/pages.parquet")), "archives")
    altered = F.when(F.col("page_id") % 97 == 13, F.concat("bytes", F.lit("!"))).otherwise(F.col("bytes"))
    b = a.withColumn("bytes", altered).filter(F.coalesce(F.col("page_id") % 101 != 7, F.lit(True)))
    found = audit(a.select("archive", "offset", "bytes"), b.select("archive", "offset", "bytes"))
    return found.select("archive", F.col("node").alias("range_no"), F.col("offset").alias("byte_offset"), "kind", "digest_a", "digest_b")


SQL = r"""
with r as (select page_id, floor(page_id / 1000)::bigint as archive, concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''),
  chr(13), chr(10), 'Content-Length: ', strlen(html), chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)) as bytes from pages),
o as (select *, coalesce(sum(strlen(bytes)) over (partition by archive order by page_id, sha256(bytes) rows between unbounded preceding and 1 preceding), 0)::bigint as byte_offset from r)
select archive, byte_offset // 1048576 as range_no, byte_offset, case when page_id % 101 = 7 then 'missing' else 'changed' end as kind, sha256(bytes) as digest_a,
  case when page_id % 101 = 7 then null else sha256(bytes || '!') end as digest_b from o where page_id % 97 = 13 or page_id % 101 = 7
"""
