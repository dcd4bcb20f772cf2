"""Linking against argmax over all pairs."""

import random

import pytest
from test_fuzzy import changed, partial, some, weighted

from marginalia.operators import matching as M


def best(key, known):
    """(score, smallest id) among (id, key)."""
    scores = [(weighted(key, k), -i) for i, k in known if k]
    top = max(scores, default=(0.0, 0))[0]
    return (top, min(-i for s, i in scores if s > top - 1e-9)) if scores and key else (0.0, None)


@pytest.fixture(scope="module")
def sides():
    rng = random.Random(5)
    left = [(i, rng.choice(["a", "b", None]), t) for i, t in enumerate(some(rng, 25) + [None, ""])]
    right = [(i, rng.choice(["a", "b", None]), t) for i, t in enumerate(some(rng, 15) + [changed(rng, t or "") for _, _, t in left] + [None, ""])]
    return left, right


@pytest.mark.parametrize("on", [[], ["g"]])
def test_best_of_a_block_in_small_groups(spark, sides, monkeypatch, on):
    left, right = sides
    monkeypatch.setattr(M, "LEFT", 7)
    monkeypatch.setattr(M, "RIGHT", 9)
    frame = lambda rows, i: spark.createDataFrame(rows, f"{i} int, g string, key string")
    got = {r.l: (r.r, pytest.approx(r.score)) for r in M.best_matches(frame(left, "l"), frame(right, "r"), "l", "r", on).collect()}
    want = {}
    for i, g, t in left:
        score, who = best(t, [(j, u) for j, h, u in right if not on or g == h])
        if score >= 70:
            want[i] = (who, score)
    assert got == want


def test_only_unknown_names_are_vetoed(spark):
    known = spark.createDataFrame([(1, "hamad", "alpha beta gamma delta"), (2, None, "one two three four")], "k int, name string, text string")
    # shares one word of four with text 2, but almost all characters
    rows = [(10, "hamad", "alpha beta gamma delta"), (11, "unknown", "alpha beta gamma delta"), (12, None, "onee twoo threee four"), (13, "hamad", "alphaa betaa gammaa deltaa"), (14, "x", "zzz qqq"), (15, None, None), (16, " مجهول ", "")]
    got = {r.r: (r.k, r.decision) for r in M.linked(spark.createDataFrame(rows, "r int, name string, text string"), known, "r", "k").collect()}
    assert got[10] == (1, "linked")
    assert got[11][0] == 1
    assert got[12] == (None, "unlinked")  # vetoed
    assert got[13][0] == 1  # a known name is not
    assert got[14] == (1, "linked")  # of very unlike lengths, the mark between name and text is a shared word
    assert got[15] == got[16] == (None, "unlinked")
    assert M.linked(spark.createDataFrame([], "r int, name string, text string"), known, "r", "k").collect() == []


def test_names_by_three_tiers(spark):
    members = ["Nation_1", "NATION_12", "brand", "Great Brand", ""]
    hints = ["nation_1", "ation_12", "natoin_1", "grat", "", None, "zzzz", "the great brands"]
    got = {r.q: (r.name, r.tier) for r in M.resolved(spark.createDataFrame([(h,) for h in hints], "q string"), spark.createDataFrame([(m,) for m in members], "name string"), "q", "name").collect()}
    want = {}
    for q in filter(None, hints):
        tiers = [(0, 0.0, n) if q == n.lower() else (1, 0.0, n) if q in n.lower() else (2, -partial(q, n.lower()), n) for n in members if n]
        tiers = [t for t in tiers if t[0] < 2 or -t[1] >= 60]
        if tiers:
            want[q] = (min(tiers)[2], min(tiers)[0])
    assert got == want


def test_only_first_words_meet_the_labels(spark, sf):
    """Texts are cut before the join, not after it."""
    from marginalia.plans import joins as P

    for how in ("left_anti", "left_semi"):
        plan = P._keyed(spark, sf, how)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join") < plan.index("regexp_extract")
