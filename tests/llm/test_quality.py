"""The ledger, policies and ablations against plain Python."""

import random
import re
from collections import Counter

from marginalia.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered), sum(c.isalpha() for c in text)


def failed(m):
    n, chars, symbols, lines, dup, repeat, letters = m
    rules = (n < 50, 100 * repeat > 50 * n, 10 * symbols > n, chars < 3 * n or chars > 10 * n, 10 * dup > 3 * lines, 10 * letters < 7 * chars)
    return sum(1 << i for i, r in enumerate(rules) if r)


def some(rng):
    out = [None, "", " \n\t ", "a", "a b", "a b c a b c", "a a a a", "x\n\nx\n x\nx", "été 日本 \x0b \x0c x y  ", "#*$%&|<> " * 3, "one two three " * 40, "same line here\n" * 30]
    words = ["alpha", "beta", "gamma", "of", "a#", "42", "long" * 6, "ñandú"]
    return out + [" ".join(rng.choice(words[: rng.randrange(2, 9)]) + rng.choice(["", "", "\n", ","]) for _ in range(rng.randrange(120))) for _ in range(60)]


def frame(spark, texts):
    ids = [None if i % 9 == 0 else i // 2 for i in range(len(texts))]
    rows = [(i, t, 1, "clash", True) for i, t in zip(ids, texts, strict=True)]
    return ids, spark.createDataFrame(rows, "doc_id long, text string, n_words int, failed string, kept boolean").repartition(3)


def test_measurements_verdicts_and_rescued(spark):
    texts = some(random.Random(6))
    texts += [texts[-1]] * 4
    ids, docs = frame(spark, texts)
    bits = Counter(failed(plain(t)) for t in texts)
    want = []
    for i, t in zip(ids, texts, strict=True):
        m = plain(t)
        f = failed(m)
        sole = Q.RULES[f.bit_length() - 1].name if f and f & (f - 1) == 0 else None
        want.append((i, *m, f & 3 != 0, f == 0, f, "v3", sole, bits[f] if sole else None))
    got = Q.judged(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan


def test_ablations_of_every_policy(spark):
    texts = some(random.Random(8))
    book = Q.ledger(frame(spark, texts)[1])
    bits = [failed(plain(t)) for t in texts]
    got = {(r.policy, r.rule): r[2:] for r in Q.ablations(book).collect()}
    assert len(got) == sum(len(p.rules) for p in Q.POLICIES)
    for policy in Q.POLICIES:
        mask = Q.mask_of(Q.RULES, policy)
        for rule in policy.rules:
            bit = Q.bit_of(Q.RULES, rule)
            beside = [f & mask & ~bit for f in bits if f & bit]
            ever, always = 0, mask & ~bit if beside else 0
            for x in beside:
                ever, always = ever | x, always & x
            assert got[policy.version, rule] == (sum(f & mask == 0 for f in bits), sum(f & mask & ~bit == 0 for f in bits), len(beside), ever, always)


def test_an_older_policy_reads_the_same_ledger(spark):
    texts = some(random.Random(2))
    book = Q.ledger(frame(spark, texts)[1])
    kept = sum(r.kept for r in Q.under(book, Q.RULES, Q.POLICIES[0]).collect())
    assert kept == sum(failed(plain(t)) & 3 == 0 for t in texts)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert Q.judged(docs).collect() == []
    assert Q.ablations(Q.ledger(docs)).collect() == []


def test_same_rows_as_sql(spark, sf):
    import tools_oracle

    assert tools_oracle.compare(spark, sf, "op11_quality_rules").startswith("ok")
