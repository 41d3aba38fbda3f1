"""Suffix-array deduplication: distributed prefix doubling over a sparse set of positions.

A byte goes if a string of ``length`` bytes (100) that covers it also starts earlier: in a
document with a smaller id, or earlier in the same document. Spark sorts (rank, position) pairs by
their ranks at growing prefix lengths, positions whose rank is unique drop out, and the last
length is the threshold, where the least document of every rank is known.

Ranking every byte of a corpus at every round would move some 27 times the input, so the first
rounds rank one position for a whole run of starts. A start's sample is the least hash among the
prefixes of 50 bytes that its string holds; equal strings have equal samples, and some 26
neighbouring starts share one. Ranks are names: 64-bit hashes of the prefix, which need no numbering
exchange. Documents are dealt to blocks of eight megabytes by id, and a rank has one row per
block, with the least and greatest document there, in every exchange.

1. Prefixes of 50 bytes: a run whose sample occurs in one document alone drops out.
2. Whole runs (100 to 150 bytes): a run that starts in a smaller document goes as a whole. Only the
   least document of each distinct run stays in play, and only if its sample has other runs.
3. Offset 50 doubles the prefix to 100 bytes: for every start of those runs Spark sorts the
   pair (rank of 50 bytes here, rank of 50 bytes at offset 50), and the least document of
   each pair decides.

Repeats inside one document are found by the same pairs in its block. Blocks then cut their texts.
Samples held by very many blocks have their runs split by hash in rounds 2 and 3, so no task
gathers one. Names that decide have 128 bits or more.

Null and empty texts have no bytes. Rows with a null id are judged against themselves, rows
with the same id against smaller ids and themselves. A long text is worked through in pieces of
a megabyte; it has to fit into a task as bytes. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as W

LENGTH = 100
#: The last offset, and the most starts of a run less one: bits of a run's mask.
OFFSET = 50
BLOCK_BYTES = 8 << 20
PIECE = 1 << 20
#: A sample in more blocks than this has its runs split.
SPLIT = 256


@dataclass
class Runs:
    """Runs of starts that share a sample, in texts that lie end to end."""

    first: np.ndarray  # byte of the first start
    last: np.ndarray
    row: np.ndarray
    sample: np.ndarray
    name: np.ndarray  # of all bytes of the run's strings
    periodic: np.ndarray  # whether strings of the run may be equal


def prefixes(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the ``size`` bytes from every byte on, and the sums they come from."""
    n = len(data)
    h = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(W._BYTE[data] * W._power("up", W._ROOT, n), out=h[1:])
    down = W._power("down", W._INVERSE, n + 1)
    return W.mix((h[size:] - h[: n - size + 1]) * down[: n - size + 1]), h, down


def _pieces(n: int, length: int) -> Iterator[tuple[int, int]]:
    """(from, to) of pieces that overlap so that every string lies in exactly one by its start."""
    for lo in range(0, max(n - length + 1, 0), PIECE):
        yield lo, min(lo + PIECE + length - 1, n)


def runs(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> Runs:
    offset = min(OFFSET, length // 2)
    size = length - offset
    out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]]
    for lo, hi in _pieces(len(data), length):
        part = data[lo:hi]
        g, h, down = prefixes(part, size)
        n = len(part) - length + 1
        low, have = g, 1
        while 2 * have <= offset + 1:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        low = np.minimum(low[:n], low[offset + 1 - have :][:n])
        whole = np.ones(n, dtype=bool)  # starts whose string lies in one text
        inner = bounds[(bounds > lo) & (bounds < hi)] - lo
        for b in inner.tolist():
            whole[max(0, b - length + 1) : b] = False
        cut = np.ones(n, dtype=bool)
        cut[1:] = (low[1:] != low[:-1]) | (whole[1:] != whole[:-1])
        cut[inner[inner < n]] = True
        first = np.flatnonzero(cut)
        width = np.diff(np.append(first, n))
        many = -(-width // (offset + 1))  # long runs in chunks
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        last = np.repeat(first + width, many) - 1
        first = np.repeat(first, many) + k * (offset + 1)
        last = np.minimum(last, first + offset)
        ok = whole[first]
        first, last = first[ok], last[ok]
        again = np.append(0, np.cumsum(g[:n] == low))
        name = W.mix((h[last + length] - h[first]) * down[first] + (last - first).astype(np.uint64))
        for held, x in zip(out, (first + lo, last + lo, low[first], name, again[last] > again[first]), strict=True):
            held.append(x)
    first, last, sample, name, periodic = (np.concatenate(x) for x in out)
    return Runs(first, last, np.searchsorted(bounds, first, side="right") - 1, sample, name, periodic)


def repeats(data: np.ndarray, r: Runs, length: int = LENGTH) -> np.ndarray:
    """Starts whose string starts earlier in the same row."""
    if not len(r.first):
        return r.first
    order = np.lexsort((r.sample, r.row))
    same = (r.sample[order][1:] == r.sample[order][:-1]) & (r.row[order][1:] == r.row[order][:-1])
    often = np.zeros(len(order), dtype=bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    at = np.flatnonzero(often | r.periodic)
    n = r.last[at] - r.first[at] + 1
    start = np.repeat(r.first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row = np.repeat(r.row[at], n)
    if not len(start):
        return start
    offset = min(OFFSET, length // 2)
    pair = np.zeros((2, len(start)), np.uint64)
    for lo, hi in _pieces(len(data), length):
        a, b = np.searchsorted(start, [lo, lo + PIECE])
        if b > a:
            g, _, _ = prefixes(data[lo:hi], length - offset)
            pair[0, a:b], pair[1, a:b] = g[start[a:b] - lo], g[start[a:b] - lo + offset]
    order = np.lexsort((start, pair[1], pair[0], row))
    same = (row[order][1:] == row[order][:-1]) & (pair[:, order][:, 1:] == pair[:, order][:, :-1]).all(axis=0)
    return np.sort(start[order[1:][same]])


def _parts(t: pa.Table) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, bytes, bounds) of a block's texts, about a megabyte at a time."""
    for batch in t.select(["_id", "_text"]).combine_chunks().to_batches():
        for part in W.slices(batch, "_text"):
            text = part.column(1).cast(pa.large_binary()).fill_null(b"")
            off = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
            raw = text.buffers()[2]
            data = np.frombuffer(raw, dtype=np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
            yield part.column(0), data, off - off[0]


def _ids(ids: pa.Array, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have an id, and the ids (0 for null)."""
    return ids.is_valid().to_numpy(zero_copy_only=False)[row], ids.fill_null(0).to_numpy(zero_copy_only=False)[row]


def extremes(ids: np.ndarray, *key: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct keys with their least and greatest id."""
    if not len(ids):
        return list(key), ids, ids
    order = np.lexsort((ids, *key[::-1]))
    key = [k[order] for k in key]
    first = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in key], axis=0)))
    return [k[first] for k in key], ids[order[first]], ids[order[np.append(first[1:], len(ids)) - 1]]


def _gather(t: pa.Table, length: int, wanted: np.ndarray | None, names: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct samples of a block, or (sample, run name) pairs, with their least and greatest id."""
    keys, ids = [[np.zeros(0, np.uint64)] for _ in range(1 + names)], [np.zeros(0, np.int64)]
    for doc, data, bounds in _parts(t):
        r = runs(data, bounds, length)
        ok, own = _ids(doc, r.row)
        if wanted is not None:
            ok &= find(wanted, r.sample)[0]
        k, lo, hi = extremes(own[ok], *[r.sample[ok], r.name[ok]][: 1 + names])
        for held, x in zip(keys, k, strict=True):
            held += [x, x]
        ids += [lo, hi]
    return extremes(np.concatenate(ids), *map(np.concatenate, keys))


def find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether x lies in the ordered keys, and where."""
    at = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
    return (keys[at] == x if len(keys) else np.zeros(len(x), bool)), at


def find_pair(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for pairs; (a, b) are distinct. The two halves are folded to one number first; found pairs are compared whole."""
    fold = W.mix(a ^ (b * np.uint64(W._ROOT)))
    order = np.argsort(fold, kind="stable")
    hit, at = find(fold[order], W.mix(x ^ (y * np.uint64(W._ROOT))))
    if not len(order):
        return hit, at
    at = order[at]
    return hit & (a[at] == x) & (b[at] == y), at


def _block(t: pa.Table) -> int:
    return t.column("_block")[0].as_py() if len(t) else 0


def _u64(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy().view(np.uint64)


def report_samples(t: pa.Table, length: int) -> pa.Table:
    (k,), lo, hi = _gather(t, length, None, False)
    return pa.table({"sample": k.view(np.int64), "_block": pa.array(np.full(len(k), _block(t)), pa.int32()), "lo": lo, "many": lo < hi})


def report_runs(t: pa.Table, shared: pa.Table, length: int) -> pa.Table:
    """Distinct runs of a block whose sample other documents have, with the split they go to."""
    want = _u64(shared, "sample")
    order = np.argsort(want)
    want, split = want[order], shared.column("_split").to_numpy()[order]
    (k, name), lo, hi = _gather(t if len(want) else t.slice(0, 0), length, want, True)
    s = split[find(want, k)[1]] if len(k) else np.zeros(0, np.int64)
    return pa.table({"sample": k.view(np.int64), "name": name.view(np.int64), "_block": pa.array(np.full(len(k), _block(t)), pa.int32()), "lo": lo, "hi": hi,
                     "_split": pa.array(s, pa.int32()), "_part": pa.array((name >> np.uint64(33)).astype(np.int64) % np.maximum(s, 1), pa.int32())})


def report_strings(t: pa.Table, rivals: pa.Table, length: int) -> pa.Table:
    """Bytes of the runs whose least document this block holds and whose sample has other runs.

    ``mask`` has a bit for each start that belongs to ``part``; without a split that is all of them.
    """
    a, b, split = _u64(rivals, "sample"), _u64(rivals, "name"), rivals.column("_split").to_numpy()
    lo = rivals.column("lo").to_numpy()
    todo = np.ones(len(a), dtype=bool)
    out: dict[str, list] = {c: [] for c in ("sample", "name", "part", "mask", "lo", "bytes")}
    offset = min(OFFSET, length // 2)
    for _, data, bounds in _parts(t) if len(a) else ():
        r = runs(data, bounds, length)
        hit, at = find_pair(a, b, r.sample, r.name)
        at, own = at[hit], np.flatnonzero(hit)
        at, i = np.unique(at, return_index=True)
        at, own = at[todo[at]], own[i][todo[at]]
        todo[at] = False
        raw = data.tobytes()
        for k, f, e in zip(at.tolist(), r.first[own].tolist(), r.last[own].tolist(), strict=True):
            text, s = raw[f : e + length], int(split[k])
            masks = {0: (1 << (e - f + 1)) - 1}
            if s > 1:
                g, _, _ = prefixes(np.frombuffer(text, np.uint8), length - offset)
                masks = {}
                for o, p in enumerate((W.mix(g[: e - f + 1] ^ W.mix(g[offset:][: e - f + 1])) % np.uint64(s)).tolist()):
                    masks[p] = masks.get(p, 0) | 1 << o
            for p, mask in masks.items():
                for c, x in zip(out, (k, k, p, mask, lo[k], text), strict=True):
                    out[c].append(x)
    k = np.array(out["sample"], dtype=np.int64)
    return pa.table({"sample": a[k].view(np.int64), "name": b[k].view(np.int64), "part": pa.array(out["part"], pa.int32()), "_block": pa.array(np.full(len(k), _block(t)), pa.int32()),
                     "mask": pa.array(out["mask"], pa.int64()), "lo": pa.array(out["lo"], pa.int64()), "bytes": pa.array(out["bytes"], pa.binary())})


def cut(t: pa.Table, known: pa.Table, length: int) -> pa.Table:
    """What stays of every text of a block. ``known``: least document of a run, or a mask of starts whose string a smaller document has."""
    by_mask = known.column("mask").is_valid().to_numpy(zero_copy_only=False) if len(known) else np.zeros(0, bool)
    a, b = _u64(known, "sample"), _u64(known, "name")
    least = known.column("lo").to_numpy()
    mask = known.column("mask").fill_null(0).to_numpy()
    out: dict[str, list] = {"_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
    for doc, data, bounds in _parts(t):
        r = runs(data, bounds, length)
        has, own = _ids(doc, r.row)
        marks = np.zeros(len(data) + 1, dtype=np.int64)
        first, last = [], []
        hit, at = find_pair(a[~by_mask], b[~by_mask], r.sample, r.name)
        whole = hit & has
        whole[whole] = least[~by_mask][at[whole]] < own[whole]
        first.append(r.first[whole])
        last.append(r.last[whole])
        hit, at = find_pair(a[by_mask], b[by_mask], r.sample, r.name)
        some = hit & has & ~whole
        some[some] = least[by_mask][at[some]] == own[some]
        some = np.flatnonzero(some)
        bits = mask[by_mask][at[some]]
        for o in range(OFFSET + 1):
            start = r.first[some[(bits >> o) & 1 == 1]] + o
            first.append(start)
            last.append(start)
        start = repeats(data, r, length)
        first, last = np.concatenate([*first, start]), np.concatenate([*last, start])
        np.add.at(marks, first, 1)
        np.add.at(marks, last + length, -1)
        gone = np.cumsum(marks)[:-1] > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = bounds[:-1][np.diff(bounds) > 0]
        begins[inner] = gone[inner]
        total, spans = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(begins))
        removed = total[bounds[1:]] - total[bounds[:-1]]
        out["_id"] += doc.to_pylist()
        out["n_bytes"] += np.diff(bounds).tolist()
        out["n_removed"] += removed.tolist()
        out["n_spans"] += (spans[bounds[1:]] - spans[bounds[:-1]]).tolist()
        for lo, hi, n in zip(bounds[:-1].tolist(), bounds[1:].tolist(), removed.tolist(), strict=True):
            out["kept"].append(data[lo:hi][~gone[lo:hi]].tobytes() if n else data[lo:hi].tobytes())
    return pa.table({c: pa.array(v, pa.binary() if c == "kept" else pa.int64()) for c, v in out.items()})


def last_round(strings: DataFrame, length: int) -> DataFrame:
    """For each run the mask of starts whose (rank, rank at the offset) pair a smaller document has."""
    offset = min(OFFSET, length // 2)
    at = strings.repartition("sample", "part").select("sample", "part", "name", "_block", "lo", "mask", "bytes", F.explode(F.sequence(F.lit(0), F.lit(offset))).alias("o"))
    at = at.filter(F.expr("shiftright(mask, o) & 1") == 1)
    rank = lambda more: F.xxhash64(F.expr(f"substring(bytes, o + {1 + more}, {length - offset})"))
    pairs = at.select("sample", "part", "name", "_block", "lo", "o", rank(0).alias("r1"), rank(offset).alias("r2"))
    least = F.min("lo").over(Window.partitionBy("sample", "part", "r1", "r2"))
    found = pairs.withColumn("_least", least).filter(F.col("_least") < F.col("lo"))
    return found.groupBy("sample", "part", "name", "_block").agg(F.min("lo").alias("lo"), F.bit_or(F.expr("shiftleft(1L, o)")).alias("mask"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, split: int = SPLIT) -> DataFrame:
    """One row per row of docs: key, n_bytes, n_removed, n_spans (runs of removed bytes), kept (the bytes that stay)."""
    if length < 2:
        raise ValueError("length must be 2 or more")
    slim = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    size = slim.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n = max(64, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("_id", F.when(F.col("_id").isNull(), F.col("_text"))), F.lit(n)).cast("int")
    # One exchange of the texts serves all passes: the plans of this side are equal.
    dealt = slim.withColumn("_block", block)
    texts = dealt.groupBy("_block")
    seen = texts.applyInArrow(lambda t: report_samples(t, length), "sample long, _block int, lo long, many boolean")
    same = Window.partitionBy("sample")
    shared = seen.withColumns({"_shared": (F.min("lo").over(same) < F.max("lo").over(same)) | F.max("many").over(same), "_n": F.count(F.lit(1)).over(same)}).filter("_shared").select(
        "_block", "sample", (F.floor(F.col("_n") / split) + 1).cast("int").alias("_split"))
    found = texts.cogroup(shared.groupBy("_block")).applyInArrow(lambda t, s: report_runs(t, s, length), "sample long, name long, _block int, lo long, hi long, _split int, _part int")
    # A part of a split sample can't see the other parts' runs, so it takes it that there are some.
    of_sample, of_run = Window.partitionBy("sample", "_part"), Window.partitionBy("sample", "_part", "name")
    placed = found.withColumns({"least": F.min("lo").over(of_run), "_rival": (F.min("name").over(of_sample) < F.max("name").over(of_sample)) | (F.col("_split") > 1)})
    rivals = placed.filter(F.col("_rival") & (F.col("lo") == F.col("least"))).select("_block", "sample", "name", "lo", "_split")
    strings = texts.cogroup(rivals.groupBy("_block")).applyInArrow(lambda t, s: report_strings(t, s, length), "sample long, name long, part int, _block int, mask long, lo long, bytes binary")
    starts = last_round(strings, length).groupBy("_block", "sample", "name").agg(F.min("lo").alias("lo"), F.bit_or("mask").alias("mask"))
    wholes = placed.filter(F.col("hi") > F.col("least")).select("_block", "sample", "name", F.col("least").alias("lo"), F.lit(None).cast("long").alias("mask"))
    done = texts.cogroup(wholes.unionByName(starts).groupBy("_block")).applyInArrow(lambda t, k: cut(t, k, length), "_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.withColumnRenamed("_id", key)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
with d as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
b as (select rid, doc_id, z, substr(x, 2 * z + 1, 1198) as x from (select rid, doc_id, x, unnest(range(0, greatest(len(x) // 2 - 99, 0), 500)) as z from d)),
s as (select rid, doc_id, z + p as p, md5(substr(x, 2 * p + 1, 200)) as w from (select rid, doc_id, z, x, unnest(range(len(x) // 2 - 99)) as p from b)),
f as (select w, min(doc_id) as least from s group by w having count(*) > 1),
o as (select rid, w, min(p) as p from s join f using (w) group by rid, w),
c as (select s.rid, s.p from s join f using (w) join o on o.rid = s.rid and o.w = s.w where f.least < s.doc_id or o.p < s.p),
g as (select rid, p, p - max(e) over (partition by rid order by p rows between unbounded preceding and 1 preceding) as gap from (select rid, p, p + 100 as e from c)),
i as (select rid, p, sum(case when gap is null or gap > 0 then 1 else 0 end) over (partition by rid order by p rows unbounded preceding) as k from g),
r as (select rid, k, min(p) as a, max(p) + 100 as b from i group by rid, k),
h as (select rid, a, b, coalesce(lag(b) over (partition by rid order by a), 0) as z from r),
t as (select h.rid, sum(h.b - h.a)::bigint as n, count(*) as spans, max(h.b) as e, string_agg(substr(d.x, 2 * h.z + 1, 2 * (h.a - h.z)), '' order by h.a) as kept from h join d using (rid) group by h.rid)
select d.doc_id, (len(x) // 2)::bigint as n_bytes, coalesce(n, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
  sha256(unhex(case when t.rid is null then x else kept || substr(x, 2 * e + 1) end)) as kept_sha256 from d left join t on t.rid = d.rid
"""
