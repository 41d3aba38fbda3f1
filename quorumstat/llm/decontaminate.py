"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over 13 neighbouring words look at nine of them and ignore the rest, so a hit
survives substitutions at ignored positions. The masked windows of the benchmark are joined
to those of every document by hash; around each hit the document and the item are compared
word by word along the hit's alignment. The best stretch of an alignment, a match counting 1
and a substitution -3, is an overlap if it has 13 words or more.

Words are lower-cased and freed of punctuation at their ends; a word of punctuation alone is
no word. Items and documents with fewer than 13 words overlap with nothing, nor do null and
empty texts. An item with a null id counts like any other. Repeated items and documents are found like any other; an empty benchmark or
corpus gives no overlap.

The benchmark is handled in blocks of a bounded number of words, each sent to all tasks
once; documents stream past it, so nothing is shuffled and no passage, however frequent,
gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import words as W
from .memo import Memo

#: Fixed masks: 1 is compared, 0 is ignored.
MASKS = ("1110110101101", "1101011010111", "1011101101011", "1111000111101")
SPAN, LEAST, PENALTY = 13, 13, 3
#: Words of a block of the benchmark: about 100 MB of seeds and item words in a task.
BLOCK_WORDS = 1_000_000
#: Bytes of text that are hashed at once; temporary arrays take some 65 times as many.
SLICE_BYTES = 1 << 18
#: Words with other than ASCII characters that a worker remembers in each of two generations.
REMEMBERED = 40_000
_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
SCHEMA = "doc_id long, item_id long, doc_start int, item_start int, n_words int, n_substituted int"


def normal(word: bytes) -> str:
    """A word in small letters without punctuation at its ends."""
    s = word.decode("utf-8", "replace").lower()
    lo, hi = 0, len(s)
    while lo < hi and not s[lo].isalnum():
        lo += 1
    while hi > lo and not s[hi - 1].isalnum():
        hi -= 1
    return s[lo:hi]


@lru_cache(maxsize=1)
def _memo() -> Memo:
    """Hash of the normal form of a word with other than ASCII characters, 0 for none."""

    def learn(found: list[bytes]) -> list[int]:
        forms = [normal(w) for w in found]
        h = iter(_never_zero(W.words(pa.array([n for n in forms if n], pa.large_string()), fold=True).hash).tolist())
        return [next(h) if n else 0 for n in forms]

    return Memo(learn, REMEMBERED)


def _never_zero(h: np.ndarray) -> np.ndarray:
    return np.maximum(h, np.uint64(1))


def hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normal words of all texts, one after the other, and the bounds of each text.

    ASCII words are trimmed and folded as byte ranges; the few others by their characters.
    """
    w = W.words(texts, fold=True)
    inside = np.flatnonzero(_ALNUM[w.data])
    first, last = np.searchsorted(inside, w.start), np.searchsorted(inside, w.end)
    some = first < last
    trimmed = W.Words(w.data, w.bounds, w.start.copy(), w.end.copy(), True)
    trimmed.start[some], trimmed.end[some] = inside[first[some]], inside[last[some] - 1] + 1
    h = np.where(some, _never_zero(trimmed.hash), np.uint64(0)) if len(w.start) else np.zeros(0, np.uint64)
    wide = np.append(0, np.cumsum(w.data >= 128))
    other = np.flatnonzero(wide[w.end] > wide[w.start])
    h[other] = np.fromiter(_memo().get([w.word(i) for i in other.tolist()]), dtype=np.uint64, count=len(other))
    kept = np.append(0, np.cumsum(h != 0))
    return h[h != 0], kept[w.first]


def seeds(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word index) of every masked window; windows don't cross texts."""
    n = len(h) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.searchsorted(bounds, np.arange(len(h)), side="right")
    at = np.flatnonzero(row[:n] == row[SPAN - 1 :])
    out = []
    for m, mask in enumerate(MASKS):
        s = np.full(n, m + 1, dtype=np.uint64)
        for i, c in enumerate(mask):
            if c == "1":
                s += h[i : i + n] * W._STEP[i]
        out.append(W.mix(s)[at])
    return np.concatenate(out), np.tile(at, len(MASKS))


def best_stretch(same: np.ndarray) -> tuple[int, int]:
    """[from, to) with the greatest sum of 1 per match and -3 per substitution; the longest of equals."""
    total = np.append(0, np.cumsum(np.where(same, 1, -PENALTY)))
    low = np.minimum.accumulate(total)
    gain = total - low
    to = int(np.argmax(gain))
    frm = int(np.flatnonzero(total[: to + 1] == low[to])[0])
    return frm, to


class Block:
    """Items of the benchmark with their sorted seeds."""

    def __init__(self, ids: list, texts: pa.Array):
        self.ids = ids
        self.h, self.bounds = hashes(texts)
        key, at = seeds(self.h, self.bounds)
        order = np.argsort(key, kind="stable")
        self.key, self.at = key[order], at[order]
        self.unique = np.unique(key)
        # A bit for each seed, on 24 bits of its hash: most windows are done with here.
        self.bits = np.zeros(1 << 21, dtype=np.uint8)
        low = (self.unique & np.uint64(0xFFFFFF)).astype(np.int64)
        np.bitwise_or.at(self.bits, low >> 3, np.left_shift(np.uint8(1), (low & 7).astype(np.uint8)))

    def overlaps(self, docs: list, texts: pa.Array) -> list[tuple]:
        h, bounds = hashes(texts)
        key, at = seeds(h, bounds)
        low = (key & np.uint64(0xFFFFFF)).astype(np.int64)
        may = np.flatnonzero(self.bits[low >> 3] >> (low & 7).astype(np.uint8) & 1)
        key, at = key[may], at[may]
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        n = hi - lo
        mine = np.repeat(at, n)
        theirs = self.at[np.repeat(lo - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())] if n.sum() else np.zeros(0, np.int64)
        doc = np.searchsorted(bounds, mine, side="right") - 1
        item = np.searchsorted(self.bounds, theirs, side="right") - 1
        aligned = np.unique(np.stack([doc, item, mine - theirs], axis=1), axis=0) if len(mine) else np.zeros((0, 3), np.int64)
        out = []
        for d, i, shift in aligned.tolist():
            a = max(bounds[d], self.bounds[i] + shift)
            b = min(bounds[d + 1], self.bounds[i + 1] + shift)
            same = h[a:b] == self.h[a - shift : b - shift]
            frm, to = best_stretch(same)
            if to - frm >= LEAST:
                out.append((docs[d], self.ids[i], int(a + frm - bounds[d]), int(a + frm - shift - self.bounds[i]), to - frm, int((~same[frm:to]).sum())))
        return out


def blocks(benchmark: DataFrame, key: str, text: str, most: int) -> Iterator[tuple[list, list]]:
    """The benchmark a block at a time; the driver never holds more than one."""
    ids, texts, n = [], [], 0
    for i, t in benchmark.select(F.col(key).cast("long"), text).filter(F.col(text).isNotNull()).toLocalIterator():
        ids.append(i)
        texts.append(t)
        n += len(t.split())
        if n >= most:
            yield ids, texts
            ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document, item and alignment with an overlap; starts are word numbers from 0."""
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sc = docs.sparkSession.sparkContext
    out = None
    for ids, texts in blocks(benchmark, item, item_text, block_words):
        sent = sc.broadcast((ids, texts))

        def search(frames: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = Block(sent.value[0], pa.array(sent.value[1], pa.large_string()))
            for batch in frames:
                for part in W.slices(batch, "text", SLICE_BYTES):
                    rows = block.overlaps(part.column(0).to_pylist(), part.column(1))
                    cols = list(zip(*rows, strict=True)) or [[]] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), *[pa.int32()] * 4], strict=True)],
                                                     names=["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_substituted"])

        found = slim.mapInArrow(search, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def per_pair(found: DataFrame) -> DataFrame:
    """The longest overlap of each document with each item; of equal ones the first."""
    best = F.max(F.struct("n_words", (-F.col("n_substituted")).alias("s"), (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.d")).cast("long").alias("doc_start"), (-F.col("b.i")).cast("long").alias("item_start"),
        F.col("b.n_words").cast("long").alias("n_words"), (-F.col("b.s")).cast("long").alias("n_substituted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that overlap with a benchmark item go."""
    found = overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("_found")).distinct()
    return docs.join(found, docs["doc_id"] == found["_found"], "left_anti").select(*store.own(docs))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return per_pair(overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
