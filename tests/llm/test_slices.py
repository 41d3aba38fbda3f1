"""Decontamination hashes a batch in small parts, so a worker's memory stays small."""

import pyarrow as pa

from quorumstat.llm import decontaminate as dc
from quorumstat.llm import words as W


def test_search_takes_small_parts(spark, monkeypatch):
    seen = []
    plain = W.slices
    monkeypatch.setattr(W, "slices", lambda batch, name, most=W.SLICE_BYTES: seen.append(most) or plain(batch, name, most))
    found = {}

    class Docs:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInArrow(self, f, schema):
            found["f"] = f
            return self

    passage = " ".join(f"word{i}" for i in range(20))
    dc.overlaps(Docs(), spark.createDataFrame([(1, passage)], "item_id long, text string"))
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6]), pa.array(["x " * 200_000, passage])], names=["doc_id", "text"])
    rows = [r for b in found["f"](iter([batch])) for r in b.to_pylist()]
    assert max(seen) <= 1 << 18 and [(r["doc_id"], r["n_words"]) for r in rows] == [(6, 20)]
