"""Scores against plain Python that follows the definitions, and argmax over all pairs."""

import random

import numpy as np
import pytest

from marginalia.functions import fuzzy as Z


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) > len(b):
        return partial(b, a)
    one = max(ratio(a, b[max(k, 0) : k + len(a)]) for k in range(1 - len(a), len(b)))
    return one if len(a) < len(b) else max(one, max(ratio(b, a[max(k, 0) : k + len(b)]) for k in range(1 - len(b), len(a))))


def by_set(a, b):
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    if x & y and (not x - y or not y - x):
        return 100.0
    p, q = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    n, m = (len(both) + bool(both) + len(r) for r in (p, q))
    out = 100.0 * (n + m - (len(p) + len(q) - 2 * lcs(p, q))) / (n + m) if n + m else 100.0
    return max(out, *(200.0 * len(both) / (len(both) + z) for z in (n, m))) if both else out


def weighted(a, b):
    if not a or not b:
        return 0.0
    far = max(len(a), len(b)) / min(len(a), len(b))
    in_order = [" ".join(sorted(x.split())) for x in (a, b)]
    if far < 1.5:
        return max(ratio(a, b), 0.95 * max(ratio(*in_order), by_set(a, b)))
    scale = 0.9 if far <= 8 else 0.6
    x, y = set(a.split()), set(b.split())
    words = 100.0 if x & y else max(partial(*in_order), partial(" ".join(sorted(x)), " ".join(sorted(y))))
    return max(ratio(a, b), scale * partial(a, b), 0.95 * scale * words)


def some(rng, n):
    words = ["the", "then", "of", "offer", "a", "sea", "caravan", "camels", "été", "نجد", "desert", "deserts"]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 1, 2, 3, 4]))) for _ in range(n)]


def changed(rng, text):
    out = list(text)
    for _ in range(rng.randrange(8)):
        if out:
            k = rng.randrange(len(out))
            out[k : k + rng.randrange(2)] = rng.choice(["", "q", " ", "e"])
    return " ".join("".join(out).split())


def test_subsequences_of_long_rows():
    rng = random.Random(3)
    a, b = (["".join(rng.choice("abcd") for _ in range(rng.randrange(200))) for _ in range(60)] for _ in range(2))
    codes, words = {" ": 1}, {}
    x, y = Z.coded(a, codes, words), Z.coded(b, codes, words)
    at = np.arange(60)
    assert Z.in_parts(x, y, Z.patterns(x, 10), at, at).tolist() == [lcs(p, q) for p, q in zip(a, b, strict=True)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("floor", [0.1, 70.0])
def test_best_equals_all_pairs(seed, floor):
    rng = random.Random(seed)
    left = some(rng, 15)
    right = some(rng, 25) + [changed(rng, t) for t in left]
    score, which = Z.best(left, right, floor)
    for i, t in enumerate(left):
        all_scores = [weighted(t, u) for u in right]
        top = max(all_scores)
        if top < floor:
            assert which[i] == -1
        else:
            assert score[i] == pytest.approx(top, abs=1e-9)
            assert all_scores[which[i]] == pytest.approx(top, abs=1e-9)
            assert which[i] == next(k for k, s in enumerate(all_scores) if s > top - 1e-9)


def test_bands_of_length_lose_nothing(monkeypatch):
    rng = random.Random(2)
    left = some(rng, 12) + ["z" * 40, "y " * 30]
    right = [changed(rng, t) for t in left] + some(rng, 20) + ["z" * 41 + " y"]
    whole = Z.best(left, right)
    monkeypatch.setattr(Z, "LONG", 5)
    parts = Z.best(left, right)
    assert whole[1].tolist() == parts[1].tolist()
    assert whole[0].tolist() == parts[0].tolist()


def test_partial_equals_all_windows():
    rng = random.Random(9)
    left, right = some(rng, 12), [changed(rng, t) for t in some(rng, 12)]
    assert Z.partial_scores(left, right) == pytest.approx(np.array([[partial(a, b) for b in right] for a in left]))


def test_nothing_to_compare():
    assert Z.best([], ["a"])[1].tolist() == []
    assert Z.best(["a", ""], [])[1].tolist() == [-1, -1]
    assert Z.best([""], ["", "a"])[1].tolist() == [-1]


def test_windows_are_compared_only_where_a_pair_can_win(monkeypatch):
    """The same matches in tiles of any size, and few of all windows are looked at."""
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    left, right = [text(rng.randrange(3, 14)) for _ in range(40)], [text(rng.randrange(3, 14)) for _ in range(120)]
    spans, common = [], Z.common
    monkeypatch.setattr(Z, "common", lambda p, i, *more: spans.append(len(i)) or common(p, i, *more))
    score, which = Z.best(left, right, 70.0)
    far = [(len(a), len(b)) for a in left for b in right if max(len(a), len(b)) >= 1.5 * min(len(a), len(b))]
    assert sum(spans) < 0.5 * sum(n + m - 1 for n, m in far)
    for tiles in ((7, 9), (40, 1), (1, 120)):
        monkeypatch.setattr(Z, "LEFTS", tiles[0], raising=False)
        monkeypatch.setattr(Z, "RIGHTS", tiles[1], raising=False)
        assert all((x == y).all() for x, y in zip(Z.best(left, right, 70.0), (score, which), strict=True))
    for k in range(0, 40, 8):
        every = [weighted(left[k], r) for r in right]
        assert score[k] == (pytest.approx(max(every)) if max(every) >= 70 else 0.0)


def test_pairs_are_laid_out_in_tiles_of_bounded_size(monkeypatch):
    """However many keys a group has, tables for pairs stay small."""
    sizes, alike = [], Z.best_alike
    monkeypatch.setattr(Z, "best_alike", lambda left, right, *more: sizes.append((len(left), len(right))) or alike(left, right, *more))
    left, right = [f"a{k} b{k % 7}" for k in range(300)], [f"a{k} b{k % 7}" for k in range(1100)]
    score, which = Z.best(left, right, 70.0)
    assert max(n for n, _ in sizes) <= 256 and max(m for _, m in sizes) <= 1024
    assert (score == 100).all() and which.tolist() == list(range(300))


@pytest.mark.parametrize("seed", range(6))
def test_sifted_texts_equal_tiled_ones(seed, monkeypatch):
    """Words that repeat, ties, untidy and long texts: the same matches, with few pairs scored."""
    rng = random.Random(seed)
    letters = ("abc", "etaoin")[seed % 2]
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))
    left = [*some(rng, 20), *(text() for _ in range(40)), "a  b", " ab", "z" * 230, ""]
    right = [*some(rng, 30), *(text() for _ in range(60)), *(changed(rng, t) for t in left), "b\ta", "z" * 231]
    want = {floor: Z.tiled(left, right, floor) for floor in (0.1, 70.0, 80.0)}
    monkeypatch.setattr(Z, "FEW_PAIRS", 0)
    monkeypatch.setattr(Z, "ROWS", 7)
    monkeypatch.setattr(Z, "COLUMNS", 11)
    monkeypatch.setattr(Z, "CHARACTERS", (160, 12)[seed // 3])
    for floor, (score, which) in want.items():
        got = Z.best(left, right, floor)
        assert got[0].tolist() == score.tolist() and got[1].tolist() == which.tolist()


def test_few_pairs_of_many_are_scored(monkeypatch):
    rng = random.Random(21)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 11))) for _ in range(3000)]
    text = lambda: " ".join(["the", *(rng.choice(words) for _ in range(rng.randrange(4, 12)))])
    left, right, scored, common = [text() for _ in range(400)], [text() for _ in range(1500)], [], Z.common
    monkeypatch.setattr(Z, "common", lambda p, i, *more: scored.append(len(i)) or common(p, i, *more))
    score, which = Z.best(left, right, 70.0)
    assert sum(scored) < 0.02 * len(left) * len(right)
    assert (score[:40] == Z.tiled(left[:40], right, 70.0)[0]).all() and (which[:40] == Z.tiled(left[:40], right, 70.0)[1]).all()
