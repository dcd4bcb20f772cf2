"""The manifest against plain Python."""

import hashlib
import zlib

import pytest

from marginalia.llm import merkle as M


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def steps(tree, at):
    out = []
    for level in tree[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        out.append((run[: at % 16], run[at % 16 + 1 :]))
        at //= 16
    return out


def plain(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: levels([leaf(r) for r in own[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(own[s]):
            path = steps(trees[s], i) + steps(top, k)
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if r[4] is not None else None
            at = leaf((*r[:4], low)) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(r)
            for left, right in path:
                at = h(*left, at, *right)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h(*(x for a, b in path for x in a + b)), at, at == top[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree int"


def got(spark, rows):
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "clash", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, M.manifest(df.repartition(3)).collect()), key=repr)


def test_trees_of_many_sizes(spark):
    rows = [(i, s, "en" if i % 3 else None, i, f"Text {i} É") for s, n in ((None, 17), ("", 1), ("a", 16), ("b", 300), ("ü", 5), ("z", 33)) for i in range(n)]
    assert got(spark, rows) == plain(rows)


def test_more_than_sixteen_sources_nulls_and_repeated_rows(spark):
    rows = [(i % 7, f"s{i % 40}", None, None, None if i % 5 == 0 else "" if i % 5 == 1 else "Long " * i) for i in range(200)]
    rows += [(None, None, None, None, None)] * 18 + [(3, "hot", "x", 1, "Same")] * 20
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_tables(spark, n):
    rows = [(5 + i, "s", "en", 1, "A") for i in range(n)]
    assert got(spark, rows) == plain(rows)


def test_given_documents(spark, sf):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    mine = sorted(map(tuple, M.manifest(spark.read.parquet(f"{sf}/documents.parquet")).collect()), key=repr)
    assert mine == plain(rows)
    assert 0 < sum(not r[-1] for r in mine) < len(mine)
