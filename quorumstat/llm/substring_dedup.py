"""Substring deduplication by repeated-phrase automata.

A window is 13 consecutive words. A word goes if a window that covers it, also starts in a
document with a smaller id. Documents are dealt to blocks by hash, about eight megabytes of
text in each, and three passes over the blocks follow:

1. Each window has a minimizer, the least hash of its nine 5-word runs; equal windows have
   equal minimizers. A block reports its distinct minimizers with the least and greatest
   document id; those that only one document has are done with.
2. A block reports the hashes of the windows with a shared minimizer, again with the least
   and greatest id. Joined over the blocks, these confirm the recurring windows.
3. A block gets the confirmed windows that it holds itself. Runs of them in one document are
   its recurring passages; these are compiled into Aho-Corasick automata over word numbers, in
   shards of a bounded size, and all the block's documents stream through every shard, which
   locates each occurrence word by word.

A key that a third of all rows share has at most one row per block in both exchanges, so no
task gathers it. Work is linear in the text. Between blocks, windows are known by 80 bits of
hash.

Null and empty texts have no words. Documents with a null id lose nothing and take nothing
from others. Rows with the same id are judged against other ids alone. An empty table gives
an empty table.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as W

WINDOW, RUN = 13, 5
#: Text bytes of a block and words of one automaton's passages: a task's memory, whatever the input.
BLOCK_BYTES, SHARD = 8 << 20, 300_000
#: A word is spelt with three characters of 128 each: an automaton's node is slow with many children.
DIGITS, RADIX = 3, 128


def minimizers(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(minimizer, word index) of every window."""
    g, _ = w.grams(RUN)
    n = len(w.start) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    a = np.minimum(g[:-1], g[1:])
    a = np.minimum(a[:-2], a[2:])
    a = np.minimum(a[:-4], a[4:])
    a = np.minimum(a[:n], g[WINDOW - RUN :][:n])
    at = np.flatnonzero(w.row[:n] == w.row[WINDOW - 1 :])
    return a[at], at


def extremes(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of ``key`` with the least and greatest id of each."""
    if not len(key):
        return key, ids, ids
    order = np.lexsort((ids, *key.T[::-1])) if key.ndim == 2 else np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    new = np.append(True, (key[1:] != key[:-1]).any(axis=1) if key.ndim == 2 else key[1:] != key[:-1])
    first = np.flatnonzero(new)
    return key[first], ids[first], ids[np.append(first[1:], len(ids)) - 1]


def _parts(t: pa.Table):
    """(rows with an id, their words) of a block, a slice at a time."""
    for batch in t.select(["_id", "_text"]).combine_chunks().to_batches():
        for part in W.slices(batch, "_text"):
            yield part.column(0), W.words(part.column(1))


def _with_id(ids: pa.Array, w: W.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the word indexes lie in rows with an id, and the ids of those."""
    has = ids.is_valid().to_numpy(zero_copy_only=False)
    value = ids.fill_null(0).to_numpy()
    ok = has[w.row[at]]
    return ok, value[w.row[at[ok]]]


def report_minimizers(t: pa.Table) -> pa.Table:
    keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for doc, w in _parts(t):
        m, at = minimizers(w)
        ok, own = _with_id(doc, w, at)
        k, lo, hi = extremes(m[ok], own)
        keys += [k, k]
        ids += [lo, hi]
    k, lo, hi = extremes(np.concatenate(keys), np.concatenate(ids))
    block = t.column("_block")[0].as_py()
    return pa.table({"m": k.view(np.int64), "_block": pa.array(np.full(len(k), block), pa.int32()), "lo": lo, "many": lo < hi})


def window_keys(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the 13 words from each word on, of 64 and of 16 bits."""
    g, _ = w.grams(WINDOW)
    n = len(g)
    x = np.zeros(n, dtype=np.uint64)
    other = W.mix(w.hash ^ W._STEP[40])
    for i in range(WINDOW):
        x += other[i : i + n] * W._STEP[20 + i]
    return g, W.mix(x) >> np.uint64(48)


def _isin(sorted_keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, x), max(len(sorted_keys) - 1, 0))
    return (sorted_keys[at] == x if len(sorted_keys) else np.zeros(len(x), bool)), at


def report_windows(t: pa.Table, shared: pa.Table) -> pa.Table:
    want = np.unique(shared.column("m").to_numpy().view(np.uint64))
    keys, ids = [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)]
    for doc, w in _parts(t) if len(want) else ():
        m, at = minimizers(w)
        at = at[_isin(want, m)[0]]
        ok, own = _with_id(doc, w, at)
        g, x = window_keys(w)
        k, lo, hi = extremes(np.stack([g[at[ok]], x[at[ok]]], axis=1), own)
        keys += [k, k]
        ids += [lo, hi]
    k, lo, hi = extremes(np.concatenate(keys), np.concatenate(ids))
    block = t.column("_block")[0].as_py() if len(t) else 0
    return pa.table({"w": np.ascontiguousarray(k[:, 0]).view(np.int64), "x": k[:, 1].astype(np.int32), "_block": pa.array(np.full(len(k), block), pa.int32()), "lo": lo, "many": lo < hi})


def spell(vocabulary: np.ndarray, h: np.ndarray) -> str:
    """Each word as DIGITS characters; every place of a word has characters of its own, so matches keep to words."""
    n = np.searchsorted(vocabulary, h)
    digit = np.stack([n // RADIX ** (DIGITS - 1 - i) % RADIX + RADIX * i for i in range(DIGITS)], axis=1) if len(vocabulary) <= RADIX**DIGITS else None
    if digit is None:
        raise ValueError("a block has too many distinct words; choose smaller blocks")
    return (digit + 1).astype("<u4").tobytes().decode("utf-32-le")


def passages(w: W.Words, least: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
    """(first word, windows) of the runs of windows that also start in a document with a smaller id."""
    hit = least < own
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True))


def locate(t: pa.Table, confirmed: pa.Table) -> pa.Table:
    """Words removed and kept of every document of a block."""
    key = confirmed.column("w").to_numpy().view(np.uint64)
    order = np.argsort(key, kind="stable")
    key, low = key[order], confirmed.column("least").to_numpy()[order]
    parts = list(_parts(t))
    none = np.iinfo(np.int64).max
    found, leasts = [], []
    for p, (doc, w) in enumerate(parts):
        least = np.full(len(w.start), none)
        if len(key):
            _, at = minimizers(w)
            hit, where = _isin(key, window_keys(w)[0][at])
            least[at[hit]] = low[where[hit]]
        leasts.append(least)
        own = doc.fill_null(np.iinfo(np.int64).min).to_numpy()[w.row]
        found += [(p, a, n) for a, n in passages(w, least, own)]
    vocabulary = np.unique(np.concatenate([np.unique(w.hash) for _, w in parts])) if found else None
    spelt = [spell(vocabulary, w.hash) if found else "" for _, w in parts]
    cover = [np.zeros(len(w.start) + 1, dtype=np.int64) for _, w in parts]
    compiled: dict[str, np.ndarray] = {}
    held = 0
    for i, (p, a, n) in enumerate(found):
        compiled[spelt[p][a * DIGITS : (a + n + WINDOW - 1) * DIGITS]] = leasts[p][a : a + n]
        held += n + WINDOW - 1
        if i + 1 == len(found) or held >= SHARD:
            stream(compiled, parts, spelt, cover)
            compiled, held = {}, 0
    out = {"_id": [], "n_words": [], "n_removed": [], "kept": []}
    for (doc, w), marks in zip(parts, cover, strict=True):
        gone = np.cumsum(marks)[:-1] > 0
        raw, start, end = w.data.tobytes(), w.start.tolist(), w.end.tolist()
        total = np.append(0, np.cumsum(gone))
        out["_id"] += doc.to_pylist()
        out["n_words"] += w.count.tolist()
        out["n_removed"] += (total[w.first[1:]] - total[w.first[:-1]]).tolist()
        for r in range(len(doc)):
            a, b = int(w.first[r]), int(w.first[r + 1])
            if total[b] == total[a]:
                kept = raw[int(w.bounds[r]) : int(w.bounds[r + 1])].split()
            else:
                kept = [raw[start[i] : end[i]] for i in (np.flatnonzero(~gone[a:b]) + a).tolist()]
            out["kept"].append(b" ".join(kept).decode())
    return pa.table({"_id": pa.array(out["_id"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept": pa.array(out["kept"], pa.string())})


def stream(compiled: dict[str, np.ndarray], parts: list, spelt: list[str], cover: list[np.ndarray]) -> None:
    """All documents of a block through one automaton; marks where removed words begin and end."""
    machine = ahocorasick.Automaton()
    for phrase, least in compiled.items():
        machine.add_word(phrase, (len(phrase) // DIGITS, least))
    machine.make_automaton()
    for (doc, w), text, marks in zip(parts, spelt, cover, strict=True):
        first = w.first.tolist()
        for r, own in enumerate(doc.to_pylist()):
            a, b = first[r], first[r + 1]
            if own is None or b - a < WINDOW:
                continue
            for e, (n, least) in machine.iter(text, a * DIGITS, b * DIGITS):
                at = (e + 1) // DIGITS - n + np.flatnonzero(least < own)
                np.add.at(marks, at, 1)
                np.add.at(marks, at + WINDOW, -1)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: key, n_words, n_removed, kept (the words that stay, joined by one space)."""
    slim = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    size = slim.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n = max(64, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("_id", F.when(F.col("_id").isNull(), F.col("_text"))), F.lit(n)).cast("int")
    dealt = slim.withColumn("_block", block)
    # One exchange of the texts serves all three passes: the plans of this side are equal.
    seen = dealt.groupBy("_block").applyInArrow(report_minimizers, "m long, _block int, lo long, many boolean")
    same = Window.partitionBy("m")
    shared = seen.withColumn("_shared", (F.min("lo").over(same) < F.max("lo").over(same)) | F.max("many").over(same)).filter("_shared").select("_block", "m")
    windows = dealt.groupBy("_block").cogroup(shared.groupBy("_block")).applyInArrow(lambda a, b: report_windows(a, b), "w long, x int, _block int, lo long, many boolean")
    same = Window.partitionBy("w", "x")
    confirmed = windows.withColumn("least", F.min("lo").over(same)).filter(F.col("many") | (F.col("lo") > F.col("least"))).select("_block", "w", "least")
    done = dealt.groupBy("_block").cogroup(confirmed.groupBy("_block")).applyInArrow(lambda a, b: locate(a, b), "_id long, n_words long, n_removed long, kept string")
    return done.withColumnRenamed("_id", key)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select rid, doc_id, p, md5(array_to_string(list_slice(ws, p, p + 12), ' ')) as w from (select rid, doc_id, ws, unnest(range(1, len(ws) - 11)) as p from d)),
m as (select rid, doc_id, p, min(doc_id) over (partition by w) as least from g),
c as (select distinct rid, p + o as p from m, (select unnest(range(13)) as o) where least < doc_id),
k as (select d.rid, string_agg(w, ' ' order by u.p) as kept, count(*) as n from (select rid, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as p from d) u
  join d using (rid) where not exists (select 1 from c where c.rid = u.rid and c.p = u.p) group by d.rid)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (rid)
"""
