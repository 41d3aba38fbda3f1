"""Suffix-array deduplication against a plain version that looks at every string."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quorumstat.llm import suffix_dedup as D


def brute(rows, length):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1 if i is not None else 0):
            s = b[p : p + length]
            least[s] = min(least.get(s, i), i)
    out = []
    for i, t in rows:
        b, seen, gone = (t or "").encode(), set(), set()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen or (i is not None and least[s] < i):
                gone.update(range(p, p + length))
            seen.add(s)
        spans = sum(p - 1 not in gone for p in gone)
        out.append((i, len(b), len(gone), spans, bytes(x for p, x in enumerate(b) if p not in gone)))
    return sorted(out, key=str)


def periodic():
    """Periods, runs of one byte, strings exactly at and just below the length."""
    a = "".join(random.Random(5).choices("abcdefgh", k=100))
    texts = ["a" * 99, "a" * 100, "a" * 101, "a" * 5000, "ab" * 300, "abc" * 37, a, a[:99], "x" + a, a + a, a[1:] + "y" + a, "é" * 80, "b" * 40 + a + "b" * 200, ("q" * 60 + "r") * 9]
    return [(50 + k, t) for k, t in enumerate(texts)] + [(3, "ab" * 60), (None, "a" * 300), (None, a + a), (57, a), (None, None)]


@pytest.mark.parametrize("length, block, split", [(100, 8 << 20, 256), (100, 3000, 1), (24, 3000, 1), (120, 9000, 2)])
def test_remove_repeats(docs, rows, spark, length, block, split):
    """Also with small blocks, and with every sample's runs split."""
    got = D.remove_repeats(docs.unionByName(spark.createDataFrame(periodic(), "doc_id long, text string"), allowMissingColumns=True), length, block_bytes=block, split=split).collect()
    want = brute(rows + periodic(), length)
    assert any(r[3] > 1 for r in want)
    assert sorted([(*r[:4], bytes(r[4])) for r in got], key=str) == want


def test_runs_cover_every_start_once(monkeypatch):
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 100, 5000, dtype=np.uint8)
    bounds = np.array([0, 0, 50, 149, 149, 1500, 4950, 5000])
    want = [p for a, b in zip(bounds, bounds[1:], strict=False) for p in range(a, b - 99)]
    for piece in (1 << 20, 333):
        monkeypatch.setattr(D, "PIECE", piece)
        r = D.runs(data, bounds)
        assert [p for a, b in zip(r.first, r.last, strict=True) for p in range(a, b + 1)] == want
        assert (r.last - r.first).max() <= D.OFFSET


def test_a_split_sample_keeps_every_start():
    """The parts of a run's starts are disjoint and complete."""
    data = np.random.default_rng(2).integers(97, 123, 149, dtype=np.uint8)
    r = D.runs(data, np.array([0, 149]))
    t = pa.table({"_id": [1], "_text": [data.tobytes().decode()], "_block": pa.array([3], pa.int32())})
    rivals = pa.table({"sample": r.sample.view(np.int64), "name": r.name.view(np.int64), "lo": np.ones(len(r.first), np.int64), "_split": np.full(len(r.first), 4)})
    got = D.report_strings(t, rivals, 100).to_pylist()
    assert len(got) > len(r.first)
    for name in r.name.view(np.int64).tolist():
        masks = [g["mask"] for g in got if g["name"] == name]
        assert sum(masks) == 2 ** int(sum(masks)).bit_length() - 1 and all(a & b == 0 for a in masks for b in masks if a is not b)


@pytest.mark.parametrize("piece", [1 << 20, 333])
def test_repeats_inside_a_document(monkeypatch, piece):
    monkeypatch.setattr(D, "PIECE", piece)
    rows = [(i, t) for i, t in periodic() if i is None]
    t = pa.table({"_id": pa.array([i for i, _ in rows], pa.int64()), "_text": [x for _, x in rows]})
    none = pa.table({"sample": pa.array([], pa.int64()), "name": pa.array([], pa.int64()), "lo": pa.array([], pa.int64()), "mask": pa.array([], pa.int64())})
    assert sorted([tuple(r.values()) for r in D.cut(t, none, 100).to_pylist()], key=str) == brute(rows, 100)


def test_empty(nothing):
    assert D.remove_repeats(nothing).collect() == []
