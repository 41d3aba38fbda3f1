"""URL filter: blocked Bloom filter first, exact join after.

A list has entries (host, path, verdict); an entry fits its host and all subdomains, where
the URL's path starts with the entry's. Every URL gives probes: each suffix of its host with
each prefix of its path whose length some entry has. A split-block Bloom filter of the
listed keys, of a bounded size, passes the probes that may be listed; only those are joined
to the list by the exact key, which removes false positives. The longest entry wins.

Null URLs and URLs without ``://`` have an empty host and path and fit no entry. Repeated
rows are judged alike; only distinct (host, path) pairs with a possible hit take part in the
joins. Results come in one struct column, so columns of the same names stay as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One odd multiplier for each of the eight 32-bit lanes of a block.
_SALT = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint64)

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_path(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL column, both empty without ``://``."""
    rest = F.coalesce(F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)


def lanes(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each 64-bit hash, and its bit in each of the block's eight lanes."""
    h = h.astype(np.uint64)
    block = (h >> np.uint64(32)) % np.uint64(blocks)
    bit = ((h[:, None] & np.uint64(0xFFFFFFFF)) * _SALT & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
    return block.astype(np.int64), bit


def bloom(keys: DataFrame, hash_col: str, bits_per_key: int = 16, most_bytes: int = 8 << 20) -> np.ndarray:
    """Split-block filter, lanes as uint32[blocks, 8], of at most ``most_bytes``.

    A longer list makes it pass more, never less; the exact join has the last word. Bits
    are or-ed on the executors, so at most one row per lane reaches the driver.
    """
    n = keys.count()
    blocks = max(1, min(most_bytes // 32, -(-n * bits_per_key // 256)))

    def set_bits(frames):
        for f in frames:
            block, bit = lanes(f[hash_col].to_numpy(np.int64).view(np.uint64), blocks)
            yield pd.DataFrame({"lane": (block[:, None] * 8 + np.arange(8)).ravel(), "mask": (np.int64(1) << bit.astype(np.int64)).ravel()})

    out = np.zeros(blocks * 8, dtype=np.uint32)
    for lane, mask in keys.select(hash_col).mapInPandas(set_bits, "lane long, mask long").groupBy("lane").agg(F.bit_or("mask")).toLocalIterator():
        out[lane] = mask
    return out.reshape(blocks, 8)


def may_hold(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    block, bit = lanes(h, len(table))
    return ((table[block].astype(np.uint64) >> bit) & np.uint64(1)).all(axis=1)


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow", out: str = "judged", most_bytes: int = 8 << 20) -> DataFrame:
    """All columns of pages and a struct: host, path, rule (null if none fits) and verdict.

    ``listed`` has host, path and verdict; of entries with the same key the least verdict
    counts. Only its path lengths and its largest label count reach the driver.
    """
    listed = listed.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").withColumn("rule", F.concat("host", "path"))
    listed = listed.groupBy("rule").agg(F.min("host").alias("rule_host"), F.min("verdict").alias("verdict"))
    shape = listed.agg(F.collect_set(F.length("rule") - F.length("rule_host")), F.max(F.size(F.split("rule_host", r"\.")))).first()
    lengths, labels = sorted(shape[0]), shape[1] or 0
    table = bloom(listed.select(F.xxhash64("rule").alias("h")), "h", most_bytes=most_bytes)

    @F.pandas_udf("array<boolean>")
    def possible(hashes: pd.Series) -> pd.Series:
        size = hashes.map(len).to_numpy()
        flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in hashes]) if size.sum() else np.zeros(0, np.int64)
        return pd.Series(np.split(may_hold(table, flat.view(np.uint64)), np.cumsum(size)[:-1])) if len(size) else pd.Series([], dtype=object)

    host, path = host_path(F.col(url))
    h, p = store.fresh(pages, "_own_host", "_own_path")
    seen = pages.withColumns({h: host, p: path})
    last = F.reverse(F.slice(F.reverse(F.split("_host", r"\.")), 1, max(labels, 1)))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(last)), lambda i: F.array_join(F.slice(last, i, F.size(last)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("_path") >= n, F.substring("_path", 1, n)) for n in lengths]), lambda p: p.isNotNull()) if lengths else F.array().cast("array<string>")
    probes = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    targets = seen.select(F.col(h).alias("_host"), F.col(p).alias("_path")).filter(F.col("_host") != "").distinct().withColumn("_probes", probes)
    marked = targets.withColumn("_may", possible(F.transform("_probes", lambda x: F.xxhash64(x))))
    hits = marked.select("_host", "_path", F.explode(F.filter(F.arrays_zip("_probes", "_may"), lambda x: x["_may"])["_probes"]).alias("rule"))
    best = hits.join(listed, "rule").groupBy("_host", "_path").agg(
        F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "rule", "verdict")).alias("_best"))
    found = seen.join(best, (seen[h] == best["_host"]) & (seen[p] == best["_path"]), "left")
    return found.select(*store.own(seen, pages), F.struct(
        seen[h].alias("host"), seen[p].alias("path"), best["_best"]["rule"].alias("rule"),
        F.coalesce(best["_best"]["verdict"], F.lit(default)).alias("verdict")).alias(out))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).select("page_id", "judged.*")


SQL = r"""
with p as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) as path from p),
r(rh, rp, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
select page_id, host, path,
  (select rh || rp from r where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) order by length(rh || rp) desc limit 1) as rule,
  coalesce((select v from r where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) order by length(rh || rp) desc limit 1), 'allow') as verdict
from h
"""
