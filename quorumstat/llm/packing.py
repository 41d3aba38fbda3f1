"""Packing by power-of-two decomposition.

The ids of a document (its tokens, then one end id) are cut into pieces of the longest
allowed length and then of the powers of two in the rest. Every piece is a sequence of its
own; pieces of equal length share a bucket, so a batch has no padding and no sequence
crosses documents.

A null or empty text is the end id alone. Repeated rows give repeated pieces with different
sequence ids; a table without rows gives none. Sequence numbers are dense inside a bucket's
slots and follow (length, slot, document, start), so a task that runs again numbers alike.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store

#: Characters outside the scripts in which both tokenizer libraries are known to agree.
_RARE = re.compile("[^\t\n\r -~\u00a0-\u024f\u0400-\u045f\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
#: The same for texts whose characters all have one byte in Latin-1.
_LATIN = bytes(i for i in range(256) if not _RARE.match(chr(i)))


def rare(text: str) -> bool:
    try:
        return bool(text.encode("latin-1").translate(None, _LATIN))
    except UnicodeEncodeError:
        return bool(_RARE.search(text))


#: From so many white-space characters in a row on, the quick library's pattern may run out of stack.
_BLANKS = re.compile(r"\s{50000}")


def plain(text: str) -> bool:
    """Whether the quick library is known to give the same ids."""
    return not rare(text) and (len(text) < 50_000 or not _BLANKS.search(text))


SCHEMA = "doc_id long, start long, length int, ids array<int>, ids_crc32 long, doc_tokens long"


def pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of n ids: whole pieces of ``longest``, then falling powers of two."""
    out = [(s, longest) for s in range(0, n - longest + 1, longest)]
    at, left, size = len(out) * longest, n - len(out) * longest, longest
    while left:
        size //= 2
        if left >= size:
            out.append((at, size))
            at, left = at + size, left - size
    return out


class Encoder:
    """Ids of whole texts by the byte-level tokenizer of a ``tokenizers`` file.

    Where the same vocabulary lies beside it as ranks, texts of common scripts go through
    ``tiktoken``, which gives the same ids in a quarter of the time; the special strings
    keep the ids that the file gives them. Texts with any other character, whose class the
    two libraries might see differently, or with very long runs of white space, go through
    ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.quick = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if path.endswith(".json") and os.path.exists(ranks):
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
            self.quick = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        """Little-endian unsigned 32-bit ids."""
        if self.quick is None or not plain(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.quick.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """Kept by the worker from task to task."""
    return Encoder(path)


def cut(frames: Iterator[pa.RecordBatch], path: str, longest: int, end_id: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in frames:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            doc, start, length, crc, total, held = [], [], [], [], [], []
            for d, t in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                ids = np.append(enc.ids(t.as_py() or ""), np.array(end_id, dtype="<u4"))
                held.append(ids)
                for s, n in pieces(len(ids), longest):
                    doc.append(d)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
                    total.append(len(ids))
            off = np.append(0, np.cumsum(length)).astype(np.int32)
            values = pa.array(np.concatenate(held).view(np.int32) if held else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.ListArray.from_arrays(pa.array(off), values), pa.array(crc, pa.int64()), pa.array(total, pa.int64())],
                names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens"])


def number(df: DataFrame, slots: int = 512) -> DataFrame:
    """A number for every piece, gapless from 0 by (length, slot, document, start).

    Slots split a bucket of any size evenly over tasks. Their offsets come from one count
    per (length, slot): at most 11 * slots rows, whatever the input.
    """
    df = df.withColumn("_slot", F.pmod(F.xxhash64("doc_id", "start"), F.lit(slots)))
    sizes = df.groupBy("length", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("length", "_slot").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_slot").orderBy("doc_id", "start", "ids_crc32")
    ranked = df.withColumn("_rank", F.row_number().over(inside))
    return ranked.join(F.broadcast(base), ["length", "_slot"]).withColumn("sequence_id", F.col("_base") + F.col("_rank") - 1).drop("_slot", "_base", "_rank")


def split(docs: DataFrame, tokenizer: str, longest: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with their ids; every id of a document lies in exactly one."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(lambda frames: cut(frames, tokenizer, longest, end_id), SCHEMA)


def pack(docs: DataFrame, tokenizer: str, longest: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece, which is a sequence of its own at offset 0, in the bucket of its length."""
    kept = ["doc_id", "start", "length", *["ids"] * with_ids, "ids_crc32", "doc_tokens"]
    # Counted and numbered from the written pieces, so that a text is encoded once.
    p = store.keep(split(docs, tokenizer, longest, end_id, key, text).select(*kept), "pieces")
    return number(p).withColumns({"length": F.col("length").cast("long"), "offset": F.lit(0).cast("long")}).select(
        "doc_id", "start", "length", *["ids"] * with_ids, "ids_crc32", "doc_tokens", "sequence_id", "offset")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the sequences of the documents that are left, with their ids."""
    return pack(docs, vocabulary())


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocabulary(), with_ids=False)
