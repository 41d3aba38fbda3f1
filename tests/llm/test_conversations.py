"""Conversation repair against a plain version: all edits by recursion over whole strings."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from quorumstat.llm import conversation_repair as C

INSIDE = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """(cost, audit) over rows of (initial, must go, truncated), by recursion from the front."""

    @lru_cache(None)
    def best(i, out, k):
        opts = [(0, "")] if i == len(rows) and out in ("", "a") else []
        nxt = {"": "u", "s": "u", "u": "a", "a": "u"}[out]
        if k < 2:
            c, s = best(i, nxt, k + 1)
            opts.append((c + 3, "I" + s))
        if i < len(rows):
            initial, gone, cut = rows[i]
            c, s = best(i + 1, out, 0)
            opts.append((c + 4, "D" + s))
            if not gone:
                c, s = best(i + 1, nxt, 0)
                opts.append((c + 3 + 3 * cut, "R" + s))
                if initial == nxt or (initial == "s" and out == ""):
                    c, s = best(i + 1, initial, 0)
                    opts.append((c + 3 * cut, "K" + s))
        return min(opts, default=(10**9, ""))

    return best(0, "", 0)


def brute(table):
    convs = {}
    for conv, turn, role, text in table:
        one = lambda x: " " if x is None else str(x)
        h = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        rows = convs.setdefault(conv, [])
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        rows += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, kinds, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for _, role, text in rows:
            inside = INSIDE.findall(text)
            fault = "blank" if not inside else "duplicate" if (role, text) in seen else "truncated" if inside[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False))
        cost, audit = cheapest(tuple(kinds))
        lines, i, initials = [], 0, ""
        for e in audit:
            if e != "D":
                new = "a" if initials.endswith("u") else "u"
                role, text = {"u": "user", "a": "assistant"}[new], ""
                if e != "I":
                    text = rows[i][2]
                    role = rows[i][1] if e == "K" else role
                initials += role[0]
                lines.append(f"{role}:{text}")
            i += e != "I"
        assert re.fullmatch("(s?(ua)+)?", initials)
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def table(seed=3, n=300):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rnd.randint(1, 9)):
            role = rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "ua"])
            text = rnd.choice(["Yes.", "No", "Really?\n", " ", "", None, "Ünder 日本.", f"{turn}!", "a\x1f"])
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 3, None, -5]), role, text))
    rows += [(None, t, "user", f"q {t}.") for t in range(7)] + [(None, None, None, None)] * 2 + rows[:20]
    rows += [(10**17 + 1, t, "assistant" if t % 2 else "user", f"t {t}." if t % 7 else "cut") for t in range(300)]
    return rows


@pytest.fixture(scope="module")
def wide(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(table(), "conv_id long, turn long, role string, text string")
    return d.select("*", *[F.lit(1).alias(c) for c in ("_c", "_t", "_role", "_text", "_conv", "_again", "_present", "h", "gaps")]).repartition(5)


@pytest.mark.parametrize("spool, batch", [(8 << 20, 10_000), (100, 7)])
def test_repair(spark, wide, monkeypatch, spool, batch):
    """Also with everything spilled, small blocks and batches that cut conversations."""
    import sys

    sys.setrecursionlimit(5_000)
    monkeypatch.setattr(C, "SPOOL", spool)
    monkeypatch.setattr(C, "BLOCK", 50 if batch == 7 else C.BLOCK)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rows = C.damage(wide)
    try:
        got = C.summarise(rows, present=rows["present"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=str) == brute(table())


def test_repaired_rows(spark, wide):
    rows = C.damage(wide)
    got = C.repair(rows, present=rows["present"]).orderBy("conv_id", "seq").collect()
    lines, audit = {}, {}
    for r in got:
        audit[r.conv_id] = audit.get(r.conv_id, "") + r.edit
        if r.edit != "D":
            lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, *_, edits, digest in brute(table()):
        assert audit.get(conv, "") == edits
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == digest


def test_every_short_sequence():
    """All sequences of up to four rows over initials and faults."""
    from itertools import product

    cases = [(i, k) for i in "suax" for k in (C.FREE, C.TRUNCATED)] + [("u", C.GONE)]
    for n in range(5):
        for rows in product(cases, repeat=n):
            c = C.Conversation("x")
            for t, (initial, kind) in enumerate(rows):
                c.add(str(t), initial + str(t), ["ok.", "", "cut"][kind], False)
            audit = "".join(e for e, *_ in c.repaired())
            assert (c.cost, audit) == cheapest(tuple((i, k == C.GONE, k == C.TRUNCATED) for i, k in rows))
            c.close()


def test_empty_conversations(spark, wide):
    assert C.summarise(wide.limit(0)).collect() == [] == C.repair(wide.limit(0)).collect()
    gone = C.summarise(spark.createDataFrame([(5, 1, "user", "x")], "conv_id int, turn int, role string, text string").withColumn("p", C.F.lit(False)), present=C.F.col("p")).collect()
    assert [tuple(r) for r in gone] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query_equals_the_plain_version(spark):
    from conftest import SF

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, C.query(spark, SF).collect()), key=str) == brute(rows)
