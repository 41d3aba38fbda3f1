"""Alignment of two tokenizers over a corpus, each distinct text once.

Side A (a byte-level ``tokenizers`` file) encodes a space and the text, side B (a
``sentencepiece`` model, which adds that space itself) the text. Byte offsets where a token of
either side ends cut both sequences into groups; every A token of a group is linked with every B
token of it.

1. Documents are shuffled by their full text and counted: copies meet there, and are counted on
   the map side first, so a text that a third of all rows share is one row per map task.
2. Each distinct text is encoded and aligned once, by its segments (see ``Segments``). Its measures and its distinct linked id pairs
   are written to the shared folder.
3. Texts are dealt to blocks by digest. A block reports each of its pairs once, weighted by the
   multiplicity of the texts; the sums over the blocks are the document counts of the pairs.
4. Counts go back to the blocks that hold the pair, where the count measures are summed.
5. Measures are joined to the document ids by digest. Texts with more than a thousandth of all
   rows are fewer than a thousand, so their measures are broadcast; the rest meet by shuffle.

Null and empty texts, and texts that either side doesn't give back byte for byte, have no tokens:
all measures are 0 and ``groups`` is ''. Special strings in a text are plain text. Repeated rows,
null ids and ties give one row each, an empty table gives none, other columns are not looked at.
A task holds one block (its texts' pairs, not their text) or one slice of about a megabyte of
text, a longer text being a slice of its own.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .packing import plain
from .words import slices

#: Bytes of text whose pairs make one block.
BLOCK_BYTES = 32 << 20
#: Links written out at a time; a group with more is first reduced to its distinct ids.
LINKS = 1 << 21
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the rest as characters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Side A: ids of a text and the bytes of every id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.encode_special_tokens = True
        byte = _byte_of_character()
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else b""
        self.size = np.array([*map(len, self.bytes)])
        self.quick = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if path.endswith(".json") and os.path.exists(ranks):  # the same vocabulary as ranks: same ids, quicker
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def spelt(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [self.quick.encode_to_numpy(t).astype(np.int64) if self.quick is not None and plain(t) else np.array(self.tok.encode(t, add_special_tokens=False).ids, np.int64) for t in (" " + t for t in texts)]


class Pieces:
    """Side B: the same of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.tok = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.tok.get_piece_size()
        self.bytes = [bytes([int(self.tok.id_to_piece(i)[3:-1], 16)]) if self.tok.is_byte(i) else self.tok.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.size = np.array([*map(len, self.bytes)])

    def spelt(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.tok.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def sides(a: str, b: str) -> Segments:
    """Both tokenizers and what they gave so far; kept by the worker from task to task."""
    return Segments(ByteLevel(a), Pieces(b))


@lru_cache(maxsize=4)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of 0 .. n - 1 as characters, left-aligned, and how many there are."""
    text = np.arange(n).astype(f"S{len(str(n))}")
    return text.view(np.uint8).reshape(n, -1), np.char.str_len(text)


def spell(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, na: np.ndarray, nb: np.ndarray, last: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All groups as ``a1,a2|b1;a3|b2,b3`` and the end of each text's part; ``last`` is the last group of each text."""
    digits, width = _decimals(size)
    n = len(a) + len(b)
    before_a, before_b = np.append(0, np.cumsum(na)), np.append(0, np.cumsum(nb))
    ids, mark, more = np.empty(n, np.int64), np.full(n, ord(","), np.uint8), np.ones(n, np.int64)
    ids[np.arange(len(a)) + before_b[ga]] = a
    ids[np.arange(len(b)) + before_a[gb + 1]] = b
    ends = before_a[1:] + before_b[1:]
    mark[ends - nb - 1] = ord("|")
    mark[ends - 1] = ord(";")
    more[ends[last] - 1] = 0
    chars = np.zeros((n, digits.shape[1] + 1), np.uint8)
    chars[:, :-1] = digits[ids]
    w = width[ids]
    chars[np.arange(n), w] = mark
    flat = chars[np.arange(chars.shape[1]) < (w + more)[:, None]]
    return flat, np.cumsum(w + more)[ends[last] - 1]


def distinct(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of n."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n[order], first)


def links(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, text: np.ndarray, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text * n_a + A id) * n_b + B id of all links, and how often each occurs."""
    start_a, start_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    size = na * nb
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.flatnonzero(size <= LINKS)
    total = np.cumsum(size[small])
    at = 0
    while at < len(small):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LINKS, side="right")))
        g = small[at:to]
        rep = np.repeat(g, size[g])
        k = np.arange(len(rep)) - np.repeat(np.cumsum(size[g]) - size[g], size[g])
        key = (text[rep] * n_a + a[start_a[rep] + k // nb[rep]]) * n_b + b[start_b[rep] + k % nb[rep]]
        u, c = distinct(key, np.ones(len(key), np.int64))
        keys.append(u)
        counts.append(c)
        at = to
    for g in np.flatnonzero(size > LINKS).tolist():
        ia, ca = np.unique(a[start_a[g] : start_a[g] + na[g]], return_counts=True)
        ib, cb = np.unique(b[start_b[g] : start_b[g] + nb[g]], return_counts=True)
        keys.append((((text[g] * n_a + ia) * n_b)[:, None] + ib).ravel())
        counts.append((ca[:, None] * cb).ravel())
    return distinct(np.concatenate(keys), np.concatenate(counts))


@dataclass
class Aligned:
    """Measures of some texts; ``cut`` bounds each text's pairs (A id * size of B + B id) and their links."""

    n: np.ndarray  # texts x (A tokens, B tokens, groups, links)
    groups: list[bytes]
    pairs: np.ndarray
    links: np.ndarray
    cut: np.ndarray


def none(k: int) -> Aligned:
    return Aligned(np.zeros((k, 4), np.int64), [b""] * k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(k + 1, np.int64))


def align_parts(a: ByteLevel, b: Pieces, ids_a: np.ndarray, ids_b: np.ndarray, border: np.ndarray) -> Aligned:
    """Texts that lie end to end: their ids on both sides and the byte where each ends; both sides spell the same bytes."""
    if not len(border):
        return none(0)
    end_a, end_b = np.cumsum(a.size[ids_a]), np.cumsum(b.size[ids_b])
    common = np.intersect1d(end_a, end_b, assume_unique=True)
    last = np.searchsorted(common, border)
    if not np.array_equal(common[last], border):
        raise ValueError("a token crosses the end of a text")
    ga, gb = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    na, nb = np.bincount(ga, minlength=len(common)), np.bincount(gb, minlength=len(common))
    flat, ends = spell(ids_a, ids_b, ga, gb, na, nb, last, max(len(a.bytes), len(b.bytes)))
    text = np.searchsorted(border, common)
    key, n = links(ids_a, ids_b, na, nb, text, len(a.bytes), len(b.bytes))
    per_text = len(a.bytes) * len(b.bytes)
    cut = np.searchsorted(key, np.arange(len(border) + 1) * per_text)
    up_to = np.append(0, last + 1)
    counts = [np.diff(np.append(0, np.cumsum(x))[up_to]) for x in (na, nb, np.ones(len(na), np.int64), na * nb)]
    chars, flat = np.append(0, ends).tolist(), flat.tobytes()
    groups = [flat[i:j] for i, j in zip(chars, chars[1:], strict=False)]
    return Aligned(np.stack(counts, axis=1), groups, key - np.repeat(np.arange(len(border)), np.diff(cut)) * per_text, n, cut)


def gather(of: Aligned, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in rows, pair, links) of the pairs of the given rows, in order."""
    size = np.diff(of.cut)[rows]
    take = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(of.cut[rows], size)
    return np.repeat(np.arange(len(rows)), size), of.pairs[take], of.links[take]


def whole(texts: list[str], a: ByteLevel, b: Pieces) -> Aligned:
    """Texts encoded one by one."""
    ok, ids_a, ids_b, size = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    full = [i for i, t in enumerate(texts) if t]
    for i, x, y in zip(full, a.ids([texts[i] for i in full]), b.ids([texts[i] for i in full]), strict=True):
        raw = b" " + texts[i].encode()
        if a.spelt(x) == raw == b.spelt(y):
            ok.append(i)
            ids_a.append(x)
            ids_b.append(y)
            size.append(len(raw))
    got = align_parts(a, b, np.concatenate(ids_a), np.concatenate(ids_b), np.cumsum(size, dtype=np.int64))
    out = none(len(texts))
    out.n[ok] = got.n
    width = np.zeros(len(texts), np.int64)
    width[ok] = np.diff(got.cut)
    for i, g in zip(ok, got.groups, strict=True):
        out.groups[i] = g
    return Aligned(out.n, out.groups, got.pairs, got.links, np.append(0, np.cumsum(width)))


class Segments:
    """What has been worked out for runs of white space and the word behind them.

    Neither tokenizer joins a word's end to white space behind it (``safe`` looks the pieces
    through; the byte-level pattern never does), so tokens and groups of a plain text are
    those of its segments, one after another, and a segment that came before need not be
    encoded again. All new segments of a slice are encoded as one text.
    """

    BLANK = " \t\n\u00a0"
    PATTERN = re.compile(f"[{BLANK}]*[^{BLANK}]+")

    def __init__(self, a: ByteLevel, b: Pieces, most: int = 200_000):
        self.a, self.b, self.most = a, b, most
        blank = {ord(c) for c in self.BLANK if ord(c) < 128}
        joined = [p.replace(b"\xc2\xa0", b" ") for p in b.bytes]
        self.safe = not any(x not in blank and y in blank for p in joined for x, y in zip(p, p[1:], strict=False))
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.held = none(0)

    def fits(self, text: str) -> bool:
        return self.safe and bool(text) and "\r" not in text and text[-1] not in self.BLANK and plain(text)

    def learn(self, new: list[str]) -> bool:
        """False if a side doesn't give the segments back byte for byte, as one that normalises its text."""
        new = [" a", *new]  # the first one starts with the space that both sides begin with
        text = "".join(new)
        ids_a, ids_b = self.a.ids([text[1:]])[0], self.b.ids([text[1:]])[0]
        if not self.a.spelt(ids_a) == text.encode() == self.b.spelt(ids_b):
            self.safe = False
            return False
        got = align_parts(self.a, self.b, ids_a, ids_b, np.cumsum([len(s.encode()) for s in new]))
        n = len(self.at)
        self.at.update(zip(new[1:], range(n, n + len(new) - 1), strict=True))
        h, skip = self.held, got.cut[1]
        self.held = Aligned(np.concatenate([h.n, got.n[1:]]), h.groups + got.groups[1:], np.concatenate([h.pairs, got.pairs[skip:]]), np.concatenate([h.links, got.links[skip:]]), np.concatenate([h.cut, got.cut[2:] - skip + h.cut[-1]]))
        return True

    def align(self, texts: list[str]) -> Aligned | None:
        parts = [self.PATTERN.findall(" " + t) for t in texts]
        if len(self.at) > self.most:
            self.forget()
        new = list({s for p in parts for s in p}.difference(self.at))
        if not all(self.learn(new[i : i + 20_000]) for i in range(0, len(new), 20_000)):
            return None
        count = np.array([*map(len, parts)])
        rows = np.fromiter(map(self.at.__getitem__, chain.from_iterable(parts)), np.int64, count.sum())
        text = np.repeat(np.arange(len(texts)), count)
        first = np.cumsum(count) - count
        at, pairs, n = gather(self.held, rows)
        per_text = len(self.a.bytes) * len(self.b.bytes)
        key, n = distinct(text[at] * per_text + pairs, n)
        cut = np.searchsorted(key, np.arange(len(texts) + 1) * per_text)
        own = self.held.groups
        groups = [b";".join([own[r] for r in rows[i : i + c].tolist()]) for i, c in zip(first.tolist(), count.tolist(), strict=True)]
        return Aligned(np.add.reduceat(self.held.n[rows], first), groups, key - np.repeat(np.arange(len(texts)), np.diff(cut)) * per_text, n, cut)


def align_texts(texts: list[str], memo: Segments) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups, pair keys, their links) of each text."""
    fits = [memo.fits(t) for t in texts]
    out: list[tuple] = [()] * len(texts)
    for wanted in (True, False):
        rows = [i for i, f in enumerate(fits) if f is wanted]
        if not rows:
            continue
        mine = [texts[i] for i in rows]
        got = (memo.align(mine) if wanted else None) or whole(mine, memo.a, memo.b)
        for r, i in enumerate(rows):
            own = slice(got.cut[r], got.cut[r + 1])
            out[i] = (*got.n[r].tolist(), got.groups[r], got.pairs[own], got.links[own])
    return out


def _aligned(frames: Iterator[pa.RecordBatch], path_a: str, path_b: str, with_groups: bool) -> Iterator[pa.RecordBatch]:
    memo = sides(path_a, path_b)
    a, b = memo.a, memo.b
    small = len(a.bytes) * len(b.bytes) <= 1 << 32
    for batch in frames:
        for part in slices(batch, "_text"):
            got = align_texts(part.column(2).to_pylist(), memo)
            cols = [part.column(0), part.column(1), *(pa.array([g[k] for g in got], pa.int64()) for k in range(4))]
            cols.append(pa.array([g[4].decode() if with_groups else hashlib.sha256(g[4]).hexdigest() if g[4] else "" for g in got], pa.string()))
            cols.append(pa.array([g[5].astype("<u4" if small else "<u8").tobytes() for g in got], pa.binary()))
            cols.append(pa.array([g[6].astype("<u4").tobytes() if not len(g[6]) or g[6].max() < 1 << 32 else g[6].astype("<u8").tobytes() for g in got], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["digest", "copies", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "links"])


def _pairs(t: pa.Table, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, pair key and links of all pairs of a block."""
    wide = "<u4" if n_a * n_b <= 1 << 32 else "<u8"
    rows, keys, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r, (p, c) in enumerate(zip(t.column("pairs"), t.column("links"), strict=True)):
        k = np.frombuffer(p.as_py(), wide).astype(np.int64)
        raw = c.as_py()
        keys.append(k)
        n.append(np.frombuffer(raw, "<u8" if len(raw) == 8 * len(k) and len(k) else "<u4").astype(np.int64))
        rows.append(np.full(len(k), r))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(n)


def _report(t: pa.Table, n_a: int, n_b: int) -> pa.Table:
    """Each pair of a block once, with the number of documents there that hold it."""
    rows, keys, _ = _pairs(t, n_a, n_b)
    k, n = distinct(keys, t.column("copies").to_numpy()[rows] if len(rows) else keys)
    block = t.column("_block")[0].as_py()
    return pa.table({"_block": pa.array(np.full(len(k), block), pa.int32()), "a": k // n_b, "b": k % n_b, "n_docs": n})


def _measure(t: pa.Table, counts: pa.Table, n_a: int, n_b: int) -> pa.Table:
    rows, keys, n = _pairs(t, n_a, n_b)
    k = counts.column("a").to_numpy() * n_b + counts.column("b").to_numpy()
    order = np.argsort(k)
    best, total = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
    if len(keys):
        at = order[np.searchsorted(k, keys, sorter=order)]
        np.add.at(total, rows, n * counts.column("n_docs").to_numpy()[at])
        np.add.at(best, rows, n * counts.column("best").to_numpy(zero_copy_only=False)[at])
    return t.select(["digest", "copies", *MEASURES[:4], "groups"]).append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total))


def pair_counts(texts: DataFrame, n_a: int, n_b: int) -> tuple[DataFrame, DataFrame]:
    """Pairs by block, and (a, b, n_docs, best) of the corpus: documents that hold the pair linked, whether it is A's highest."""
    mine = texts.select("_block", "copies", "pairs", "links").groupBy("_block").applyInArrow(lambda t: _report(t, n_a, n_b), "_block int, a long, b long, n_docs long")
    blocks = store.keep(mine, "alignment-pairs")
    counts = blocks.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"))
    top = counts.groupBy("a").agg(F.max("n_docs").alias("_top"))
    return blocks, store.keep(counts.join(top, "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("_top")).alias("best")), "alignment-counts")


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, key: str = "doc_id", text: str = "text", with_groups: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: key, MEASURES and ``groups`` (without ``with_groups`` its SHA-256 in hexadecimal digits)."""
    memo = sides(tokenizer_a, tokenizer_b)
    n_a, n_b = len(memo.a.bytes), len(memo.b.bytes)
    slim = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    size = slim.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = max(64, -(-size // block_bytes))
    apart = slim.groupBy("_text").agg(F.count(F.lit(1)).alias("copies")).select(F.sha2("_text", 256).alias("digest"), "copies", "_text")
    schema = "digest string, copies long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, links binary"
    aligned = apart.mapInArrow(lambda frames: _aligned(frames, tokenizer_a, tokenizer_b, with_groups), schema)
    texts = store.keep(aligned, "alignment-texts").withColumn("_block", F.pmod(F.xxhash64("digest"), F.lit(blocks)).cast("int"))
    held, counts = pair_counts(texts, n_a, n_b)
    back = held.select("_block", "a", "b").join(counts, ["a", "b"])
    schema = "digest string, copies long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
    done = store.keep(texts.groupBy("_block").cogroup(back.groupBy("_block")).applyInArrow(lambda t, c: _measure(t, c, n_a, n_b), schema), "alignment-measures")
    return to_documents(slim.select("_id", F.sha2("_text", 256).alias("digest")), done).select(F.col("_id").alias(key), *MEASURES, "groups")


def to_documents(ids: DataFrame, done: DataFrame) -> DataFrame:
    """Measures of distinct texts joined to all ids by digest."""
    total = done.agg(F.sum("copies")).first()[0] or 0
    out = [*MEASURES, "groups"]
    hot = done.filter(F.col("copies") * 1000 > total).select("digest", F.struct(*out).alias("_hot"))  # fewer than 1000 rows
    known = ids.join(F.broadcast(hot), "digest", "left")
    # Rows that have their measures already are spread evenly by a key that meets nothing.
    spread = F.concat(F.lit("-"), F.xxhash64("_id").cast("string"))
    keyed = known.select("_id", "_hot", F.when(F.col("_hot").isNull(), F.col("digest")).otherwise(spread).alias("_key"))
    rest = done.filter(F.col("copies") * 1000 <= total).select(F.col("digest").alias("_key"), F.struct(*out).alias("_cold"))
    both = keyed.join(rest, "_key", "left").withColumn("_m", F.coalesce("_hot", "_cold"))
    return both.select("_id", *[F.col(f"_m.{c}").alias(c) for c in out])


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), with_groups=False)
    return done.withColumn("doc_id", F.col("doc_id").cast("long")).withColumnRenamed("groups", "groups_sha256")
