"""Quality rules as a short-circuit cascade.

Each rule is a cheap or dear test on one document. On a sample of documents every rule is
timed and its rejections are counted; rules then run in the order of rejections per second,
and a document that one rule rejects is not shown to the next. The verdict (any rule
rejects) does not depend on the order; only the work does.

Nulls and empty texts have no words and fail ``few_words``. Rows are judged one by one, so
repeated rows get the same verdict; a table without rows gives a table without rows. Other
columns are passed through, whatever their names: results come in one struct column.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import words as W

_LEAD = np.ones(256, dtype=bool)
_LEAD[0x80:0xC0] = False
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


class Texts:
    """A slice of documents; each measure is taken only of the rows asked for, once."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        self.words = W.words(texts)
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def get(self, name: str, rows: np.ndarray) -> np.ndarray:
        n = len(self.texts)
        value, done = self.known.setdefault(name, (np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)))
        todo = rows[~done[rows]]
        if len(todo):
            value[todo] = MEASURES[name](self, todo)
            done[todo] = True
        return value[rows]

    def per_text(self, flags: np.ndarray, rows: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags))
        b = self.words.bounds
        return total[b[rows + 1]] - total[b[rows]]


def _n_words(t: Texts, rows: np.ndarray) -> np.ndarray:
    return t.words.count[rows]


def _word_chars(t: Texts, rows: np.ndarray) -> np.ndarray:
    return t.per_text(_LEAD[t.words.data] & ~W._SPACE[t.words.data], rows)


def _n_symbols(t: Texts, rows: np.ndarray) -> np.ndarray:
    return t.per_text(_SYMBOL[t.words.data], rows)


def _lines(t: Texts, rows: np.ndarray, dup: bool) -> list[int]:
    out = []
    for r in rows:
        lines = [x for x in t.words.data[t.words.bounds[r] : t.words.bounds[r + 1]].tobytes().split(b"\n") if x.strip()]
        out.append(len(lines) - len(set(lines)) if dup else len(lines))
    return out


def _n_repeat_words(t: Texts, rows: np.ndarray) -> np.ndarray:
    """Words inside 5-word windows that stand twice or more in the text."""
    grams, whole = t.words.grams(5)
    asked = np.zeros(len(t.texts), dtype=bool)
    asked[rows] = True
    row = t.words.row[: len(grams)]
    at = np.flatnonzero(whole & asked[row])
    key = W.mix(grams[at] + row[at].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    order = np.argsort(key)
    key = key[order]
    same = np.zeros(len(key) + 1, dtype=bool)
    same[1:-1] = key[1:] == key[:-1]
    twice = at[order][same[1:] | same[:-1]]
    cover = np.zeros(len(t.words.start) + 6, dtype=np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    covered = np.append(0, np.cumsum(np.cumsum(cover)[: len(t.words.start)] > 0))
    return covered[t.words.first[rows + 1]] - covered[t.words.first[rows]]


MEASURES: dict[str, Callable[[Texts, np.ndarray], np.ndarray]] = {
    "n_words": _n_words,
    "word_chars": _word_chars,
    "n_symbols": _n_symbols,
    "n_lines": lambda t, rows: _lines(t, rows, False),
    "n_dup_lines": lambda t, rows: _lines(t, rows, True),
    "n_repeat_words": _n_repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """Rejects a document if ``test`` of its measures holds."""

    name: str
    needs: tuple[str, ...]
    test: Callable[..., np.ndarray]

    def rejects(self, t: Texts, rows: np.ndarray) -> np.ndarray:
        return self.test(*[t.get(m, rows) for m in self.needs])


#: Integer tests, so that any engine gives the same verdicts.
RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 10),
    Rule("repeats", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 20 * n),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > 3 * n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c > 12 * n) | (c < 2 * n)),
    Rule("duplicate_lines", ("n_dup_lines", "n_lines"), lambda d, n: 100 * d > 30 * n),
)
BASE = ("few_words", "repeats")


def estimate(docs: DataFrame, rules: tuple[Rule, ...], key: str, text: str, sample: int) -> list[tuple[str, float, float]]:
    """(rule, seconds per document, share rejected) on the ``sample`` rows with the least key hash."""
    spot = docs.select(key).orderBy(F.xxhash64(key), key).limit(sample)  # keys alone are sorted; at most ``sample`` are sent
    spot = docs.join(F.broadcast(spot), key, "left_semi").select(text)

    def timed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent = {r.name: [0.0, 0, 0] for r in rules}
        for batch in frames:
            for part in W.slices(batch, text):
                for r in rules:  # each starts anew, as shared measures would hide its cost
                    t, rows = Texts(part.column(0)), np.arange(part.num_rows)
                    t.words.hash  # splitting and hashing are paid for once, whatever the rule
                    at = time.perf_counter()
                    n = int(np.count_nonzero(r.rejects(t, rows)))
                    for i, x in enumerate((time.perf_counter() - at, n, part.num_rows)):
                        spent[r.name][i] += x
        yield pa.RecordBatch.from_pandas(pd.DataFrame([(k, float(a), float(b), float(c)) for k, (a, b, c) in spent.items()], columns=["rule", "s", "rejected", "n"]), preserve_index=False)

    seen = spot.mapInArrow(timed, "rule string, s double, rejected double, n double").groupBy("rule").agg(F.sum("s"), F.sum("rejected"), F.sum("n")).collect()
    return [(r, s / max(n, 1.0), k / max(n, 1.0)) for r, s, k, n in seen]


def order_rules(rules: tuple[Rule, ...], figures: list[tuple[str, float, float]]) -> tuple[Rule, ...]:
    """Most rejections per second first; rules without a figure come last, ties by name."""
    gain = {r: share / max(cost, 1e-12) for r, cost, share in figures}
    return tuple(sorted(rules, key=lambda r: (-gain.get(r.name, 0.0), r.name)))


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", sample: int = 2000,
            report: tuple[str, ...] = (), out: str = "quality", order: tuple[Rule, ...] | None = None) -> DataFrame:
    """All columns of docs and a struct: kept, reasons (the rules that were seen to reject), the measures in ``report``.

    ``sample`` bounds the rows on which costs are estimated; the verdict covers every row.
    ``reasons`` has the first rejecting rule and so may vary with the measured order.
    """
    order = order or order_rules(rules, estimate(docs, rules, key, text, sample))
    report = tuple(report)
    kind = "kept boolean, first_reason string" + "".join(f", {m} long" for m in report)

    @F.pandas_udf(kind)
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in parts:
            batch = pa.RecordBatch.from_arrays([pa.array(series, type=pa.large_string(), from_pandas=True)], names=["t"])
            frames = []
            for part in W.slices(batch, "t", W.SLICE_BYTES >> 2):
                t = Texts(part.column(0))
                left = np.arange(part.num_rows)
                reason = np.full(part.num_rows, None, dtype=object)
                for r in order:
                    if not len(left):
                        break
                    bad = r.rejects(t, left)
                    reason[left[bad]] = r.name
                    left = left[~bad]
                kept = np.zeros(part.num_rows, dtype=bool)
                kept[left] = True
                every = np.arange(part.num_rows)
                frames.append(pd.DataFrame({"kept": kept, "first_reason": reason} | {m: t.get(m, every) for m in report}))
            yield pd.concat(frames) if frames else pd.DataFrame(columns=["kept", "first_reason", *report])

    return docs.withColumn(out, judge(F.col(text)))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go; the columns of documents stay."""
    (out,) = store.fresh(docs, "_quality")
    return cascade(docs, out=out).filter(F.col(out)["kept"]).select(*map(F.col, store.named(docs)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = cascade(docs, report=base)
    failed = (F.col("quality.n_words") < 10) | (100 * F.col("quality.n_repeat_words") > 20 * F.col("quality.n_words"))
    return judged.select("doc_id", *[F.col(f"quality.{m}").alias(m) for m in base], failed.alias("base_failed"), F.col("quality.kept").alias("kept"))


SQL = r"""
with w as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
d as (select *, row_number() over () as rid from w),
g as (select rid, p, list_slice(ws, p, p + 4) as g from (select rid, ws, unnest(range(1, len(ws) - 3)) as p from d)),
twice as (select rid, p from (select rid, p, count(*) over (partition by rid, g) as c from g) where c > 1),
rep as (select rid, count(distinct p + o) as n from twice, (select unnest(range(5)) as o) group by rid),
m as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, len(ls) as n_lines, coalesce(n, 0)::bigint as n_repeat_words
  from d left join rep using (rid)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > 3 * n_words or word_chars > 12 * n_words or word_chars < 2 * n_words
    or 100 * n_dup_lines > 30 * n_lines) as kept from b
"""
