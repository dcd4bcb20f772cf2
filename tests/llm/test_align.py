"""Alignment against plain Python, which tokenizes whole texts and compares all pairs of tokens."""

import hashlib
import re
from collections import Counter

import public_tokenizers as P
import pytest

from marginalia.llm import align as A

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    return A.Tokenizers(A_PATH, B_PATH)


def one(text, tools):
    """(n_a, n_b, n_groups, links, digest) of a whole text."""
    if not text:
        return 0, 0, 0, [], ""
    whole = (" " + text).encode()
    a, b = tools.a.encode(" " + text, add_special_tokens=False).ids, tools.b.encode(text)
    spans = []
    for ids, entry in ((a, tools.a_bytes), (b, tools.b_bytes)):
        at, own = 0, []
        for i in ids:
            own.append((at, at + len(entry[i]), i))
            at += len(entry[i])
        if b"".join(entry[i] for i in ids) != whole:
            return 0, 0, 0, [], ""
        spans.append(own)
    links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
    both = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
    groups, low = [], 0
    for high in both:
        groups.append(",".join(str(x[2]) for x in spans[0] if low < x[1] <= high) + "|" + ",".join(str(y[2]) for y in spans[1] if low < y[1] <= high))
        low = high
    return len(a), len(b), len(both), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def plain(rows, tools):
    ones = [(i, one(t, tools)) for i, t in rows]
    count = Counter(p for _, o in ones for p in set(o[3]))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    return sorted(((i, *o[:3], len(o[3]), sum(count[p] == best[p[0]] for p in o[3]), sum(count[p] for p in o[3]), o[4]) for i, o in ones), key=repr)


ODD = [
    None, "", " ", "  ", "a", " a", "  a  b ", "a\n b\t c", "x   y z 　 w", "café naïve über è é", "<|endoftext|> <s> </s> <unk> <0x41>", "▁x ▁ y", "日本 語 かな",
    "é ﬁ ½", "don't we'll I'm", "!!! ??? ###  $$$", "\x00\x01 \x7f \x85 a", "\U0001f600 \U0001f468‍\U0001f469 x", "12345 678 9", "\r\n\r\n a \n", "word " * 50, "a" * 300, "� ﻿b",
]


def got(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, block string, a int").repartition(parts)
    return sorted(map(tuple, A.aligned(df, A_PATH, B_PATH).collect()), key=repr)


def test_odd_texts_null_ids_and_repeated_rows(spark, tools):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "the same text"), (None, "the same text"), (7, "the same text"), (7, None)]
    assert got(spark, rows) == plain(rows, tools)


def test_salted_ids_and_small_blocks(spark, tools, monkeypatch):
    rows = [(i, f"the {i} thing, and the {'other' if i % 3 else 'others'} unbelievable re{i % 5}thing") for i in range(300)]
    monkeypatch.setattr(A, "SHARE", (2000, 2000))
    assert got(spark, rows, 9) == plain(rows, tools)


def test_words_are_cut_where_both_have_a_boundary(tools):
    for text in filter(None, ODD):
        cut = A.pieces(text.encode())
        assert b"".join(b" " + w for w in cut) == (" " + text).encode()
        left, right = tools.encode([w.decode() for w in cut])
        assert [x for a in left for x in a] == tools.a.encode(" " + text, add_special_tokens=False).ids
        assert [x for b in right for x in b] == tools.b.encode(text)


def test_no_piece_holds_a_blank_within(tools):
    """What the cut rests on: a B piece has blanks at its beginning only, and A's pattern keeps a blank with what follows."""
    assert not [p for p in tools.b_bytes if re.search(rb"[^ ] ", p)]


def test_shares_are_handed_on_early(monkeypatch):
    """Sums are the same however often a task hands on, and an id's counts hold over batches."""
    rows = [(1, 0, 0, 5, 9, 0, None), (1, 0, 0, 6, 4, 0, None), (1, 0, 1, 5, 0, 70, [(0, 2), (3, 1)]), (1, 0, 1, 6, 0, 70, [(3, 5)]), (1, 0, 1, 6, 0, 71, [(1, 1)]), (2, 0, 0, 6, 8, 0, None), (2, 0, 1, 6, 0, 71, [(1, 3)])]
    names = ["a", "salt", "kind", "b", "docs", "block", "postings"]
    packed = [(*r[:6], None if r[6] is None else A.np.array(r[6], A.np.uint32).tobytes()) for r in rows]
    types = [A.pa.int32()] * 4 + [A.pa.int64()] * 2 + [A.pa.binary()]
    batch = A.pa.RecordBatch.from_arrays([A.pa.array(c, t) for c, t in zip(zip(*packed), types, strict=True)], names)

    def sums(batches):
        out, handed = Counter(), 0
        for got in A._shares(batches):
            for i in range(got.num_rows):
                width = got.column("width")[i].as_py()
                own = A.np.frombuffer(A.pa.decompress(got.column("shares")[i].as_py(), decompressed_size=16 * width, codec="zstd", asbytes=True), A.np.int64).reshape(2, width)
                handed += 1
                for place in range(width):
                    out[got.column("block")[i].as_py(), place] += complex(*own[:, place].tolist())
        return {k: (int(v.real), int(v.imag)) for k, v in out.items() if v}, handed

    want = {(70, 0): (2, 18), (70, 3): (1, 29), (71, 1): (3, 28)}
    assert sums([batch]) == (want, 2)
    monkeypatch.setattr(A, "GATHERED", 0)
    assert sums([batch.slice(0, 1), batch.slice(1, 2), batch.slice(3, 2), batch.slice(5)]) == (want, 4)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_given_documents(spark, sf, tools):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 3000]
    assert got(spark, rows, 4) == plain(rows, tools)
