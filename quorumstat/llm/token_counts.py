"""Token counts through a digest cache.

A text is normalised (runs of ASCII white space become one space, which the tokenizer drops
anyway), its SHA-256 is joined to a table of (text digest, tokenizer digest, count), and
only distinct texts that the table lacks are encoded and appended. The tokenizer digest is
the SHA-256 of its file, so another version never meets old counts.

A null or empty text has 0 tokens. Copies and repeated rows are encoded once. Only digests
travel for the search of misses; the misses' texts travel once, beside a hash table of
digests that takes no text, so a digest that a third of all rows share stays small.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .memo import Memo

CACHE = "text_digest string, tokenizer_digest string, n_tokens long"
#: Words whose counts a worker remembers in each of two generations.
REMEMBERED = 600_000


def normalised(text: Column) -> Column:
    """ASCII white space as single spaces. Case stays: special strings are told apart by it."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@lru_cache(maxsize=2)
def counter(path: str) -> Memo:
    """Token counts of words; kept by the worker from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return Memo(lambda ws: [len(e.ids) for e in tok.encode_batch_fast([w.decode() for w in ws], add_special_tokens=False)], REMEMBERED)


def count_words(path: str, frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of texts as sums over their words.

    The tokenizer never joins characters across white space, so the count of a text is the
    sum over its words, and a word that came before need not be encoded again.
    """
    memo, seen = counter(path), set()
    for batch in frames:
        new = []  # repeated rows meet in one task: their text is encoded once
        for d in batch.column(0).to_pylist():
            new.append(d not in seen)
            seen.add(d)
        batch = batch.filter(pa.array(new, pa.bool_()))
        counts = [sum(memo.get((t.as_py() or "").encode().split())) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["text_digest", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", cache: str | None = None, out: str = "n_tokens") -> DataFrame:
    """All columns of docs and the token count of each whole text.

    ``cache`` is the folder of the counts kept from earlier calls; without one a new folder
    under the shared one is used. Misses are appended to it.
    """
    spark = docs.sparkSession
    cache = cache or store.folder(spark, "token-counts")
    version = file_digest(tokenizer)
    own = F.col(text)
    digest = F.sha2(normalised(own), 256)

    def stored() -> DataFrame:
        try:
            kept = spark.read.schema(CACHE).parquet(cache)
            kept.columns  # noqa: B018  a missing folder shows here
        except AnalysisException:
            kept = spark.createDataFrame([], CACHE)
        return kept.filter(F.col("tokenizer_digest") == version).groupBy("text_digest").agg(F.max("n_tokens").alias("_n"))

    # One row stands for all of a digest: rows of the least key are read again, the rest are not.
    digests = docs.select(F.col(key).alias("_key"), digest.alias("text_digest"))
    missing = digests.groupBy("text_digest").agg(F.min("_key").alias("_key")).join(stored(), "text_digest", "left_anti")
    texts = docs.select(F.col(key).alias("_key"), digest.alias("text_digest"), own.alias("_text"))
    meet = texts["_key"].eqNullSafe(missing["_key"]) & (texts["text_digest"] == missing["text_digest"])
    found = texts.join(missing.hint("shuffle_hash"), meet, "left_semi").select("text_digest", "_text")
    counted = found.mapInArrow(lambda frames: count_words(tokenizer, frames), "text_digest string, n_tokens long")
    counted.select("text_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)
    (mine,) = store.fresh(docs.withColumn(out, F.lit(0)), "_digest")
    keyed, counts = docs.withColumn(mine, digest), stored()
    return keyed.join(counts, keyed[mine] == counts["text_digest"]).select(*[c for c, name in zip(store.own(keyed, docs), docs.columns, strict=True) if name != out], counts["_n"].alias(out))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    slim = token_counts(docs.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long")), public_tokenizers.path("word_bpe_49k.json"))
    return slim.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
