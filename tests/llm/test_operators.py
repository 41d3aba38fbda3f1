"""Each operator against a plain version on a fixture of hard cases, and on an empty table."""

import hashlib
import re
import zlib
from collections import defaultdict

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quorumstat.llm import decontaminate, jaccard_join, license_scan, packing, pii, quality_rules, store, substring_dedup, token_counts, url_filter
from quorumstat.llm import words as W
from quorumstat.llm.memo import Memo

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
key = lambda r: str(tuple(r))


def fold(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def test_words_equal_the_pattern(rows):
    t = [x for _, x in rows]
    w = W.words(pa.array(t).slice(2))
    for r, x in enumerate(t[2:]):
        assert [w.word(i).decode() for i in range(w.first[r], w.first[r + 1])] == SPACE.findall(x or "")


def test_memo_forgets_and_relearns():
    seen = []
    m = Memo(lambda ks: [seen.append(k) or k * 2 for k in ks], 3)
    assert list(m.get([1, 2, 2, 3, 4])) == [2, 4, 4, 6, 8]
    assert list(m.get([1])) == [2] and seen.count(1) == 1
    list(m.get([7, 8, 9, 10]))
    list(m.get([11]))
    assert list(m.get([2])) == [4] and seen.count(2) == 2


def brute_removed(rows):
    least = {}
    ws = [SPACE.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, ws, strict=True):
        for p in range(len(w) - 12):
            g = tuple(w[p : p + 13])
            if i is not None:
                least[g] = min(least.get(g, i), i)
    for (i, _), w in zip(rows, ws, strict=True):
        gone = {p + o for p in range(len(w) - 12) if i is not None and least[tuple(w[p : p + 13])] < i for o in range(13)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        yield i, len(w), len(gone), kept


@pytest.mark.parametrize("block", [8 << 20, 3000])
def test_substring_dedup(docs, rows, block, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD", 50)
    got = substring_dedup.remove_repeats(docs, block_bytes=block).collect()
    want = list(brute_removed(rows))
    assert any(r[2] for r in want)
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_spelling_keeps_to_words():
    import numpy as np

    s = substring_dedup.spell(np.arange(200_000, dtype=np.uint64), np.array([0, 199_999, 60_000], dtype=np.uint64))
    assert len(s) == 9 and len({ord(c) // 128 for c in s[:3]} | {0, 1, 2}) == 3


def shingles(t):
    w = SPACE.findall(fold(t or ""))
    return {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    s = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                parent[find(a)] = find(b)
    low = defaultdict(list)
    for x, (i, _) in enumerate(rows):
        if i is not None:
            low[find(x)].append(i)
    return [(i, len(s[x]), min(low[find(x)], default=None)) for x, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("size", [2_000_000, 200])
def test_jaccard_join(docs, rows, size):
    got = jaccard_join.near_duplicates(docs, block_bytes=4000, region_shingles=size).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute_components(rows)))


def test_jaccard_chain_of_links(spark):
    """A row of texts in which each links with the next alone is one component, with regions in chunks as well."""
    base = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(base[k * 12 : k * 12 + 104])) for k in range(24)]
    want = brute_components(rows)
    for size in (2_000_000, 250):
        got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), region_shingles=size).collect()
        assert sorted(map(key, got)) == sorted(map(key, want))


@pytest.mark.parametrize("n, m", [(4, 5), (8, 10), (24, 30)])
def test_jaccard_nested_sets(n, m):
    """A set and one that holds it, at exactly 0.8, are set aside under no order of the hashes."""
    import numpy as np

    own = [{x: np.sort(np.random.default_rng(seed).integers(0, 1 << 62, m, dtype=np.uint64)[:x]) for x in (n, m)} for seed in range(20_000)]
    for s in own:
        k = {x: int(jaccard_join.reported(x)) for x in (n, m)}
        met = len(np.intersect1d(s[n][: k[n]], s[m][: k[m]]))
        assert met >= jaccard_join.least_met(n) and met >= jaccard_join.least_met(m)
    assert all(jaccard_join.least_met(x) >= 1 for x in range(1, 2000))


def test_jaccard_nested_texts(spark):
    rows = []
    for seed, (n, more) in enumerate([(8, 1)] * 60 + [(12, 2)] * 100):
        w = [f"s{seed}w{k}" for k in range(n + more)]
        rows += [(2 * seed, " ".join(w[:n])), (2 * seed + 1, " ".join(w))]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute_components(rows)))


def test_jaccard_regions_by_rare_shingles(spark):
    """Texts that only share frequent passages are in no region; a near copy is in few, however many passages it has."""
    own = lambda k, n: " ".join(f"d{k}x{i}" for i in range(n))
    passages = [" ".join(f"p{j}q{i}" for i in range(9)) for j in range(30)]
    rows = [(k, " ".join(f"{own(100 * k + j, 6)} {passages[(k + 7 * j) % 30]}" for j in range(12))) for k in range(120)]
    rows += [(1000 + k, f"{t} tail{k}") for k, t in rows[:20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    d = jaccard_join.classes(docs)
    v = d.filter("tokens is not null").select("c", "n", "tokens", F.col("_id").alias("lo"))
    member = jaccard_join.regions(v).groupBy("p").count().filter("count > 1")
    assert sorted(x["count"] for x in member.collect()) == [2] * 20
    got = jaccard_join.near_duplicates(docs).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute_components(rows)))


def test_jaccard_reports_are_packed(spark):
    """A block reports at most one row for each slot, with every shingle once, and finds those that several classes have."""
    texts = [" ".join(f"k{k}v{i}" for i in range(400)) for k in range(20)]
    texts += [texts[0] + " end", texts[1], texts[2].replace("v7 ", "v7x ")]
    t = pa.table({"_id": pa.array(range(len(texts)), pa.int64()), "_text": texts, "_block": pa.array([5] * len(texts), pa.int32())})
    seen = jaccard_join.report(t, 7)
    tokens = [x for row in seen["token"].to_pylist() for x in row]
    assert sorted(seen["slot"].to_pylist()) == list(range(7)) and len(tokens) == len(set(tokens)) > 2000
    several = {x for row, c in zip(seen["token"].to_pylist(), seen["c"].to_pylist(), strict=True) for x, y in zip(row, c, strict=True) if y is None}
    other = seen.slice(0, 3).set_column(1, "_block", pa.array([6] * 3, pa.int32()))
    for twin in (other, other.set_column(3, "c", pa.array([[1] * len(x) for x in other["token"].to_pylist()], pa.list_(pa.int64())))):
        got = pa.concat_tables([jaccard_join.shared_by_classes(pa.concat_tables([seen, twin]).filter(pa.compute.equal(pa.concat_tables([seen, twin])["slot"], k))) for k in range(7)])
        found = {b: {x for c, row in zip(got["_block"].to_pylist(), got["token"].to_pylist(), strict=True) if c == b for x in row} for b in (5, 6)}
        here = {x for row in other["token"].to_pylist() for x in row}
        assert several and found[6] == (several & here if twin is other else here) and found[5] == several | found[6]


def test_rarest_shingles_of_linked_sets_meet():
    """Any two sets that link choose a shingle in common, whatever the numbers of their owners."""
    import numpy as np

    g = np.random.default_rng(8)
    pool = np.sort(g.integers(-(1 << 62), 1 << 62, 60))
    sets = [np.sort(g.choice(pool, n, replace=False)) for n in g.integers(2, 12, 300)]
    sets += [np.sort(np.unique(np.append(s[: len(s) - i % 2], g.choice(pool, i % 3)))) for i, s in enumerate(sets)]
    t = pa.table({"c": pa.array(range(len(sets)), pa.int64()), "lo": pa.array([None] + list(range(1, len(sets))), pa.int64()), "tokens": pa.array(sets, pa.list_(pa.int64())), "_block": pa.array([0] * len(sets), pa.int32())})
    met = jaccard_join.tally(t)
    met = met.rename_columns(["token", "_block", "many"]).filter(pa.compute.greater(met.column("k"), 1))
    chosen = defaultdict(set)
    got = jaccard_join.rarest(t, met)
    for c, token in zip(got["c"].to_pylist(), got["token"].to_pylist(), strict=True):
        chosen[c].add(token)
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    assert len(linked) > 100 and all(chosen[a] & chosen[b] for a, b in linked)


def test_settle_drops_shuffle_files(spark):
    import time
    from pathlib import Path

    files = [str(f) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffles = lambda: {p for d in files for p in Path(d).rglob("shuffle_*.data")}
    before, until = shuffles(), time.time() + 20
    settled = store.settle(spark.range(1000).groupBy(F.col("id") % 7).agg(F.count(F.lit(1)).alias("n")), "settled")
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before and settled.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_components_of_a_long_path(spark):
    got = jaccard_join.components(spark.range(40).selectExpr("id + 1 as u", "id as v")).collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(1, 41)]


def test_pieces():
    for n in (0, 1, 2, 1023, 1024, 1025, 5000):
        p = packing.pieces(n, 1024)
        assert sum(x for _, x in p) == n and all(x & (x - 1) == 0 and x <= 1024 for _, x in p)
        assert [s for s, _ in p] == [sum(x for _, x in p[:i]) for i in range(len(p))]


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary())
    got = packing.pack(docs, packing.vocabulary(), longest=64).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got))) and all(r.offset == 0 for r in got)
    want = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for s, n in packing.pieces(len(ids), 64):
            part = ids[s : s + n]
            want.append((i, s, n, part, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)), len(ids)))
    assert sorted(key(r[:6]) for r in got) == sorted(map(key, want))


@pytest.mark.parametrize("t", ["a  b", " \nb", "x<|endoftext|>y", "日本 語\u0308", "\x1c \x85", "it's 12\r\n", "q" * 5000, "שלום 12"])
def test_encoder_equals_the_tokenizer(t):
    e = packing.encoder(packing.vocabulary())
    assert e.ids(t).tolist() == e.tok.encode(t, add_special_tokens=False).ids


def test_long_runs_of_white_space(spark):
    t = ["a" + c * 1_200_000 + "b" for c in " \n"]
    got = packing.pack(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string"), packing.vocabulary(), with_ids=False).groupBy("doc_id").agg(F.max("doc_tokens")).collect()
    enc = packing.encoder(packing.vocabulary())
    assert {r[0]: r[1] for r in got} == {i: len(enc.tok.encode(x, add_special_tokens=False).ids) + 1 for i, x in enumerate(t)}


def test_token_counts_and_their_cache(spark, docs, rows, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, cache = Tokenizer.from_file(path), str(tmp_path / "cache")
    want = sorted(key((i, len(tok.encode(t or "", add_special_tokens=False).ids))) for i, t in rows)
    for _ in range(2):
        got = token_counts.token_counts(docs, path, cache=cache)
        assert set(docs.columns) < set(got.columns)
        assert sorted(map(key, got.select("doc_id", "n_tokens").collect())) == want
        kept = spark.read.parquet(cache)
        assert kept.count() == kept.select("text_digest").distinct().count()  # nothing is encoded twice
    more = spark.createDataFrame([(1, "something new"), (2, "one")], "doc_id long, text string")
    token_counts.token_counts(more, path, cache=cache).collect()
    assert spark.read.parquet(cache).count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows} | {"something new"})


def test_quality_rules(docs, rows):
    orders = [quality_rules.RULES, quality_rules.RULES[::-1]]
    got = [sorted(map(key, quality_rules.cascade(docs, order=o, out="q", report=("n_repeat_words", "n_dup_lines")).select("doc_id", "q.kept", "q.n_repeat_words", "q.n_dup_lines").collect())) for o in orders]
    assert got[0] == got[1]
    want = []
    for i, t in rows:
        t = t or ""
        w = SPACE.findall(t)
        grams = [tuple(w[p : p + 5]) for p in range(len(w) - 4)]
        rep = len({p + o for p, g in enumerate(grams) if grams.count(g) > 1 for o in range(5)}) if len(grams) < 3000 else len({p + o for p, g in enumerate(grams) if grams.index(g) != p for o in range(5)})
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        dup, sym, chars = len(lines) - len(set(lines)), len(re.findall(r"[#*$%&|<>]", t)), sum(map(len, w))
        bad = len(w) < 10 or 100 * rep > 20 * len(w) or 10 * sym > 3 * len(w) or chars > 12 * len(w) or chars < 2 * len(w) or 100 * dup > 30 * len(lines)
        want.append((i, not bad, rep, dup))
    assert got[0] == sorted(map(key, want))


def test_rules_run_in_order_of_gain():
    r = quality_rules.order_rules(quality_rules.RULES, [("few_words", 1.0, 0.1), ("symbols", 0.1, 0.1), ("repeats", 9.0, 0.1)])
    assert [x.name for x in r[:3]] == ["symbols", "few_words", "repeats"]


def brute_overlaps(docs, items):
    norm = lambda t: [n for w in SPACE.findall(t or "") if (n := decontaminate.normal(w.encode()))]
    out = set()
    for d, t in docs:
        for i, u in items:
            a, b = norm(t), norm(u)
            for shift in range(-len(b) + 1, len(a)):
                lo, hi = max(0, shift), min(len(a), len(b) + shift)
                same = [a[p] == b[p - shift] for p in range(lo, hi)]
                if not any(all(same[p + o] for o, c in enumerate(m) if c == "1") for p in range(len(same) - 12) for m in decontaminate.MASKS):
                    continue
                best = max(((sum(1 if x else -3 for x in same[f:e]), -e, -f) for f in range(len(same)) for e in range(f, len(same) + 1)))
                f, e = -best[2], -best[1]
                if e - f >= 13:
                    out.add((d, i, e - f, sum(not x for x in same[f:e])))
    return out


def test_decontamination(spark):
    item = "Alpha, beta gamma delta; epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"
    w = item.split()
    swapped = " ".join("WRONG" if k in (3, 11) else x for k, x in enumerate(w))
    rows = [(1, "start " + item.upper() + " end"), (2, "a b c " + swapped), (3, "nothing of the kind here at all, only other words in a row of some length"), (4, None), (5, ""), (6, " ".join(w[:12])),
            (7, item), (7, item), (8, "-- " + " - ".join(w)), (9, " ".join("no" if k % 2 else x for k, x in enumerate(w)))]
    items = [(1, item), (2, " ".join(w[2:])), (3, "too short"), (4, None), (5, item), (None, item)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute_overlaps(rows, items)
    assert {x[0] for x in want} == {1, 2, 7, 8}
    for size in (1_000_000, 5):  # in one block and in several
        got = decontaminate.overlaps(d, b, block_words=size).select("doc_id", "item_id", "n_words", "n_substituted").collect()
        assert {tuple(r) for r in got} == want
        assert decontaminate.per_pair(decontaminate.overlaps(d, b, block_words=size)).count() == len({x[:2] for x in want})
    assert decontaminate.overlaps(d, b.limit(0)).count() == 0


def test_normal_words_by_byte_ranges(rows):
    texts = [t for _, t in rows] + ["“Hello” HELLO hello, ¡Ünder! ünder -- ... a--b A--B 日本、 İx x\u0301 ½ _a_ 1.5"]
    h, bounds = decontaminate.hashes(pa.array(texts))
    want = [n for t in texts for w in SPACE.findall(t or "") if (n := decontaminate.normal(w.encode()))]
    assert len(h) == len(want) == bounds[-1]
    assert len(set(h.tolist())) == len(set(want)) == len(set(zip(h.tolist(), want, strict=True)))


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(t):
    for kind, p in BASE.items():
        for m in re.finditer(p, t):
            d = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if kind == "ip"), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                yield f"{kind}:{m.start()}:{m.end()}"


def test_pii(spark):
    import random

    rnd = random.Random(5)
    bits = ["1", "25", "4111111111111111", "4111 1111 1111 1111", ".", "@", "a", "b.c", "_", "-", " ", "+", "(", "é", "😀", "\n", "+1 (437) 555-0689", "x@y.z", "10.0.0.1", "256", " ssn 123-45-6789 ", " 123-45-6789 ", "token = f00f00f00f00f00f00f00f00f00aa "]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))) for i in range(900)] + [(None, "x@y.z"), (5000, None), (5001, ""), (7, "same@id.org")] * 2
    long = "a" * 200_000 + " 1" + "2" * 100_000 + " x@y.z " + "a.b" * 30_000
    docs = spark.createDataFrame([*rows, (9000, long)], "doc_id long, text string").repartition(4)
    model, limits = pii.fit(docs, sample=600)
    found = pii.detect(docs, model=model, limits=limits)
    got = found.select("doc_id", "text", pii.written("pii.base"), pii.written("pii.spans")).collect()
    assert len(got) == len(rows) + 1
    for i, t, base, spans in got:
        if i == 9000:
            assert base == f"email:{len(long) - 90_006}:{len(long) - 90_001}"
            continue
        assert base == ",".join(brute_base(t or ""))
        assert set(base.split(",")) - {""} <= set(spans.split(","))
    assert model is not None and any(base != spans for *_, base, spans in got)
    clean = {i: t for i, t in pii.redact(found).select("doc_id", "text").collect()}
    assert clean[9000].count("<EMAIL>") == 1 and not any(next(brute_base(t), None) and "@" in t for t in clean.values() if t and "<" not in t)
    assert pii.fit(docs.limit(0)) == (None, {})


def test_pii_kind_outside_the_sample(spark):
    """A kind that no sampled document has is judged on all of the table's candidates."""
    common = [("my ssn 123-45-6789", 1), ("order 123-45-6789", 0), ("tel 555 123-4567", 1), ("lot 555 123-4567", 0)]
    ids = spark.range(400).select(F.col("id").alias("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    rows = [(r.doc_id, common[n % 4][0] + " x" * n) for n, r in enumerate(ids[:380])] + [(r.doc_id, "iban GB29 NWBK 6016 1331 9268 19" + " x" * n) for n, r in enumerate(ids[380:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model, limits = pii.fit(docs, sample=200)
    got = {r.doc_id: r.s for r in pii.detect(docs, model=model, limits=limits).select("doc_id", pii.written("pii.spans").alias("s")).collect()}
    assert all(got[r.doc_id] for r in ids[380:]) and set(limits) == set(pii.LOOSE)
    assert {got[r.doc_id] for n, r in enumerate(ids[:380]) if n % 4 == 1} == {""}
    # A sample whose documents have one label only gives way to candidates of all the table.
    assert pii.fit(docs.filter(~F.col("text").startswith("order") & ~F.col("text").startswith("lot") | (F.col("doc_id") == ids[377].doc_id)), sample=4)[0] is not None


def test_pii_thresholds():
    bins = [("key", 90, 10, 9.0), ("key", 80, 90, 90.0), ("key", 10, 900, 0.0), ("iban", 50, 10, 1.0)]
    got = pii.thresholds(bins, 0.95)
    assert got["key"] == 0.8 and got["iban"] == pii.NEVER  # the best bin alone falls short for key
    assert set(got) == set(pii.LOOSE) and got["ipv6"] == 0.8  # no candidate: all kinds together
    assert set(pii.thresholds([], 0.95).values()) == {pii.NEVER}


def test_license_scan(spark, docs):
    cases = [("Released under the MIT License, or the Apache license 2.0", "apache,mit", "apache,mit", 0.95), ("licensed under the GNU Lesser General Public License version 3", "gpl", "gpl,lgpl", 0.95),
             ("SPDX-License-Identifier: MPL-2.0", "", "mpl", 1.0), ("mit der Zeit", "", "", 0.0), (None, "", "", 0.0), ("", "", "", 0.0), ("mit license " * 500, "mit", "mit", 0.8)]
    d = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)] * 2, "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(d).select("doc_id", "license.*").collect()}
    for i, (_, base, labels, score) in enumerate(cases):
        assert (got[i].base_labels, got[i].labels, got[i].score) == (base, labels, score)
    assert (got[6].n_base, got[6].first_word, got[6].last_word, got[6].n_words) == (500, 0, 998, 1000)
    assert len(license_scan.rules()) > 200 and license_scan.scan(docs).count() == docs.count()


def test_license_alternatives(spark):
    """Each alternative of each family in each template finds its label, whatever keyword the family has."""
    forms = {"tag": "SPDX-License-Identifier: {}", "grant": "released under the terms of the {} licence", "short_grant": "licensed under {}", "version": "{} License v2", "address": "https://spdx.org/licenses/{}",
             "name": "{} License", "label": "License: {}", "glued_tag": "SPDX-License-Identifier: {}v3", "glued_grant": "published under the {}v2.1 license", "glued_short": "licensed under the terms of the {}v2.1", "glued_version": "{}2 licence", "glued_address": "opensource.org/licenses/{}3", "glued_label": "license {}v3"}
    cases = [(label, f.format(p)) for label, _, names, ids in license_scan.FAMILIES for t, f in forms.items() for p in (ids if t in license_scan.BY_ID or "glued" in t else names).split("|")]
    d = spark.createDataFrame([(i, c[1]) for i, c in enumerate(cases)], "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.labels.split(",") for r in license_scan.scan(d).select("doc_id", "license.labels").collect()}
    assert [c for i, c in enumerate(cases) if c[0] not in got[i]] == []
    assert len({r.name for r in license_scan.rules()}) == len(license_scan.rules())


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://NET/x", "http://net", "https://a.example.net/en/1", "https://example.net/de/1", "http://xexample.com/de/", "http://example.com/de/#f", "//x://w.org/fr/?q", "http://org/fr", "http://a..net/", "x://h.net?/"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] * 2, "page_id long, url string, host int")
    listed = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = fold(m[1]), m[2]
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    got = url_filter.judge(pages, listed).select("page_id", "judged.*").collect()
    assert len(got) == 2 * len(urls)
    assert {key(r) for r in got} == {key((i, *brute(u))) for i, u in enumerate(urls)}
    assert {r.verdict for r in url_filter.judge(pages, listed.limit(0)).select("judged.verdict").collect()} == {"allow"}


def test_bloom_has_no_false_negative(spark):
    import numpy as np

    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    h = np.array([r.h for r in keys.collect()], dtype=np.int64).view(np.uint64)
    full, tight = url_filter.bloom(keys, "h"), url_filter.bloom(keys, "h", most_bytes=1024)
    assert url_filter.may_hold(full, h).all() and url_filter.may_hold(tight, h).all()
    other = np.random.default_rng(1).integers(0, 1 << 63, 20000, dtype=np.uint64)
    assert url_filter.may_hold(full, other).mean() < 0.02 and tight.nbytes <= 1024


def test_empty_tables(spark, nothing):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    bench = spark.createDataFrame([(1, "x")], "item_id long, text string")
    for df in (substring_dedup.remove_repeats(nothing), jaccard_join.near_duplicates(nothing), packing.pack(nothing, packing.vocabulary()), pii.detect(nothing), license_scan.scan(nothing),
               quality_rules.cascade(nothing, out="q"), token_counts.token_counts(nothing, path), decontaminate.overlaps(nothing, bench)):
        assert df.count() == 0


def test_stages_on_hard_rows(spark, docs):
    sf = "/root/testdata/sf0.001"
    left, names = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = store.keep(stage(spark, left, sf), name)
        assert left.columns == names
        assert left.select("`a.b`", "_text_hash").distinct().collect() == [(7, 7)]
    ids = [r.doc_id for r in left.select("doc_id").collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids))
    last = corpus_pipeline.STAGES[-1][1](spark, left, sf)
    assert {r.doc_id for r in last.select("doc_id").collect()} == {r.doc_id for r in left.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_pipeline_equals_its_operators(spark):
    """run() against plain sets: quality, then components, then overlaps, on the small tables."""
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    good = {r.doc_id for r in quality_rules.query(spark, sf).filter("kept").collect()}
    rows = [r for r in rows if r[0] in good]
    rows = [r for r, c in zip(rows, brute_components(rows), strict=True) if c[2] == r[0] or not c[1]]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    left = {r[0] for r in rows} - {r.doc_id for r in decontaminate.query(spark, sf).collect()}
    assert items and {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()} == left


def test_queries_are_registered():
    from __spark_entry__ import oracle_sql, queries

    ops = {int(re.match(r"op(\d+)_", q)[1]) for q in queries() if q.startswith("op")}
    assert "pipeline" in queries() and ops == set(range(1, 14)) and set(oracle_sql()) <= set(queries())


def test_digest_of_kept_words(spark):
    got = {r.doc_id: r.kept_sha256 for r in substring_dedup.query(spark, "/root/testdata/sf0.001").collect()}
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert got == {i: hashlib.sha256(k.encode()).hexdigest() for i, _, _, k in brute_removed(rows)}


def test_counts_of_personal_data(spark):
    got = pii.query(spark, "/root/testdata/sf0.001").collect()
    rows = dict(tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    assert len(got) == len(rows)
    for r in got:
        base = list(brute_base(rows[r.doc_id] or ""))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()


def test_merkle_audit(spark):
    from collections import Counter

    from quorumstat.llm import merkle_audit

    a = [(1, i * 40, f"r{i}") for i in range(300)] + [(2, 0, "x"), (2, 0, "x"), (None, 5, "n"), (3, None, None), (4, 8, ""), (5, 1, "same")]
    b = [r for r in a if r[:2] not in {(1, 800), (1, 11960)}]
    b = [(k, o, t + "!" if (k, o) == (1, 4000) else t) for k, o, t in b] + [(6, 9, "extra")]
    b.remove((2, 0, "x"))
    b[b.index((4, 8, ""))] = (4, 8, None)
    frame = lambda rows: spark.createDataFrame(rows, "archive long, offset long, bytes string")
    want = {(1, 800, "missing"), (1, 11960, "missing"), (1, 4000, "changed"), (6, 9, "extra"), (2, 0, "missing"), (4, 8, "changed")}
    for span, fan in ((100, 3), (1 << 20, 16)):
        got = merkle_audit.audit(frame(a), frame(b), span, fan).select("archive", "offset", "kind").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert merkle_audit.audit(frame(a), frame(list(reversed(a)))).count() == 0
    assert merkle_audit.audit(frame(a).limit(0), frame(a).limit(0)).count() == 0
    assert sum(Counter(a).values()) == 306
