"""Alignment of two tokenizers against a plain version over all documents."""

import hashlib
from collections import defaultdict

import pytest

from quorumstat.llm import token_alignment as T


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(rows, paths):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    # The printed forms of bytes are those of the library's own byte-level decoder.
    from tokenizers.pre_tokenizers import ByteLevel

    shown = {}
    for text in [chr(i) for i in range(128)] + [chr(i) for i in range(128, 2048)] + [chr(0x800 + 0x1000 * i) for i in range(16) if not 0xD000 <= 0x800 + 0x1000 * i < 0xE000] + [chr(0x10000 * i) for i in range(1, 17)]:
        piece = "".join(p for p, _ in ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text))
        shown.update(zip(piece, text.encode(), strict=True))
    of_a = lambda i: bytes(shown[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    groups, count = [], defaultdict(int)
    for _, t in rows:
        ia = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ib = b.encode(t) if t else []
        sides = []
        for ids, of in ((ia, of_a), (ib, of_b)):
            ends, n = [], 0
            for i in ids:
                n += len(of(i))
                ends.append(n)
            sides.append((b"".join(map(of, ids)), ends))
        if not t or not sides[0][0] == sides[1][0] == (" " + t).encode():
            groups.append(None)
            continue
        own = []
        for end in sorted(set(sides[0][1]) & set(sides[1][1])):
            low = own[-1][0] if own else 0
            own.append((end, [i for i, e in zip(ia, sides[0][1], strict=True) if low < e <= end], [i for i, e in zip(ib, sides[1][1], strict=True) if low < e <= end]) if len(t) < 3000 else (end, None, None))
        if len(t) >= 3000:  # the same in one walk
            x, y, own2 = 0, 0, []
            for end, _, _ in own:
                x0, y0 = x, y
                while x < len(ia) and sides[0][1][x] <= end:
                    x += 1
                while y < len(ib) and sides[1][1][y] <= end:
                    y += 1
                own2.append((end, ia[x0:x], ib[y0:y]))
            own = own2
        groups.append([(p, q) for _, p, q in own])
        for pair in {(i, j) for p, q in groups[-1] for i in p for j in q}:
            count[pair] += 1
    top = defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    out = []
    for (d, _), g in zip(rows, groups, strict=True):
        if g is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(i, j) for p, q in g for i in p for j in q]
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in g)
        out.append((d, sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), len(links), sum(count[x] == top[x[0]] for x in links), sum(count[x] for x in links), text))
    return out


def hard():
    t = ["<|endoftext|> and <s> </s> <unk>", "a▁b", "▁", " ", "\n", "x\r\ny\r", "  two  spaces \t tab\n\n", "tail ", " nbsp  x", "🙂👩‍👩‍👧 flags", "\x00nul", "z" * 3000, " " * 200, "=" * 700 + "\n" + "-" * 333,
         "日本語のテキスト", "don't I'll", "é é", "\x1c\x85 sp", "�﻿", "1234567 12.5", "cut here\n  and there"]
    return [*zip(range(1000, 1000 + len(t)), t, strict=True), (1001, "same"), (1001, "same"), (None, "same")]


@pytest.mark.parametrize("block", [32 << 20, 2000])
def test_align(spark, docs, rows, paths, block):
    all_rows = rows + hard()
    got = T.align(docs.unionByName(spark.createDataFrame(hard(), "doc_id long, text string"), allowMissingColumns=True), *paths, block_bytes=block).collect()
    want = brute(all_rows, paths)
    assert any(w[7] == "" and t for w, (_, t) in zip(want, all_rows, strict=True))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_query(spark, paths):
    from conftest import SF

    got = T.query(spark, SF).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*w[:7], hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "") for w in brute(rows, paths)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_segments_forget(paths):
    a, b = (x for x in (T.sides(*paths).a, T.sides(*paths).b))
    memo, texts = T.Segments(a, b, most=10), [f"word{k} again{k % 7} and\nmore" for k in range(200)]
    assert memo.safe
    plain = T.whole(texts, a, b)
    for k in range(0, 200, 20):
        for (*n, groups, pairs, links), i in zip(T.align_texts(texts[k : k + 20], memo), range(k, k + 20), strict=True):
            own = slice(plain.cut[i], plain.cut[i + 1])
            assert n == plain.n[i].tolist() and groups == plain.groups[i] and (pairs == plain.pairs[own]).all() and (links == plain.links[own]).all()


def test_large_groups_are_linked_by_distinct_ids(paths, monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(3)
    na, nb = np.array([3, 40, 1, 7]), np.array([2, 30, 1, 9])
    a, b = rnd.integers(0, 5, na.sum()), rnd.integers(0, 6, nb.sum())
    text = np.array([0, 0, 1, 1])
    want = T.links(a, b, na, nb, text, 50, 60)
    monkeypatch.setattr(T, "LINKS", 10)
    for x, y in zip(want, T.links(a, b, na, nb, text, 50, 60), strict=True):
        assert (x == y).all()


def test_hot_texts_and_empty_tables(spark, paths, nothing):
    """More than a thousandth of the rows share a text: the same measures by broadcast as by shuffle."""
    rows = [(i, "the one text") for i in range(1500)] + [(5000 + i, f"text {i}") for i in range(1500)]
    got = T.align(spark.createDataFrame(rows, "doc_id long, text string"), *paths).collect()
    assert len(got) == 3000 and len({tuple(r)[1:] for r in got if r.doc_id < 1500}) == 1
    assert sorted(map(tuple, got)) == sorted(brute(rows, paths))
    assert T.align(nothing, *paths).count() == 0
