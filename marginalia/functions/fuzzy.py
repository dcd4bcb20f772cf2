"""Similarity of short texts in numpy: longest common subsequences of many pairs at once, and scores made of them.

Scores run from 0 to 100.  With L the length of the longest common subsequence of texts of n and m characters:

- ``ratio``: 200 L / (n + m)
- ``partial``: the best ratio of the shorter text with a window of the longer one, of its length or, at either end, less
- sorted and set forms compare the words in order, and what is left of two word sets beside the words they share
- ``weighted``: of texts of like length (longer under 1.5 times the shorter) the larger of ratio and 0.95 times the word
  forms; else the larger of ratio, 0.9 times partial (0.6 beyond 8 times the length) and 0.95 of that times the partial
  word forms, which are 100 if a word is shared.  An empty text scores 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property
from typing import NamedTuple

import numpy as np

#: Weights of the word forms and of windows, and the length ratios where they apply.
WORDS, WINDOWS, FAR_WINDOWS = 0.95, 0.9, 0.6
NEAR, FAR = 1.5, 8.0
#: Pairs, and window pairs, whose subsequences are found at once.
AT_ONCE = 1 << 13
#: Windows that are looked at together to leave out pairs.
STRIDE = 8
#: Texts of either side whose pairs are looked at at once.
LEFTS, RIGHTS = 256, 1024
#: Characters of a text from which texts are compared by bands of length.
LONG = 200
#: Pairs up to which all are laid out; left and right texts of a matrix of bounds, its columns for characters, and bits for pairs of characters.
FEW_PAIRS, ROWS, COLUMNS, CHARACTERS, BITS = 1 << 19, 1024, 4096, 160, 1024
#: The score of texts of unlike lengths that share a word; texts that have it are sifted.
STRONG = 100.0 * WORDS * WINDOWS
#: Common pairs of characters that an order of words, or its ends, may hide.
HIDDEN = 5


class Texts(NamedTuple):
    """Texts as rows of character codes, filled up with 0, with their lengths and word numbers.

    ``word`` gives for each character the place of its word among the text's (the blank after a word is the word's), ``ids``
    the words by number, filled up with -1.
    """

    codes: np.ndarray
    length: np.ndarray
    word: np.ndarray
    ids: np.ndarray


def coded(texts: Sequence[str], codes: dict[str, int], words: dict[str, int]) -> Texts:
    """Rows of codes; both dictionaries take up what is new, and the first holds the blank as 1."""
    length = np.array([len(t) for t in texts], np.int64)
    wide = int(length.max(initial=0)) + 1
    out, word = np.zeros((len(texts), wide), np.int32), np.zeros((len(texts), wide), np.int16)
    row, place = np.repeat(np.arange(len(texts)), length), np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    points, back = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    number = np.array([codes.setdefault(chr(c), len(codes) + 1) for c in points.tolist()], np.int32)
    if len(points):
        out[row, place] = number[back]
        blank = np.zeros((len(texts), wide), np.int16)
        blank[row, place] = out[row, place] == 1
        word[:, 1:] = np.cumsum(blank, 1, dtype=np.int16)[:, :-1]
        word[np.arange(wide) >= length[:, None]] = 0
    split = [t.split(" ") if t else [] for t in texts]
    ids = np.full((len(texts), max(map(len, split), default=0)), -1, np.int64)
    for i, own in enumerate(split):
        ids[i, : len(own)] = [words.setdefault(w, len(words)) for w in own]
    return Texts(out, length, word, ids)


class Patterns(NamedTuple):
    """For each text and symbol the places that hold it, as bits of ``parts`` 64-bit words; symbol 0 is held nowhere."""

    bits: np.ndarray
    symbols: int


def patterns(t: Texts, symbols: int) -> Patterns:
    """``symbols`` is above every code that will be looked up."""
    parts = max(1, -(-int(t.length.max(initial=0)) // 64))
    bits = np.zeros((parts, len(t.length), symbols), np.uint64)
    row = np.arange(len(t.length))
    for j in range(int(t.length.max(initial=0))):
        bits[j // 64, row, t.codes[:, j]] |= np.uint64(1 << (j % 64))
    bits[:, :, 0] = 0
    return Patterns(bits.reshape(parts, -1), symbols)


def common(p: Patterns, i: np.ndarray, codes: np.ndarray, parts: int, keep: np.ndarray | None = None) -> np.ndarray:
    """Length of the longest common subsequence of pattern ``i[k]`` and row k of ``codes``; code 0 matches nothing.

    Bit-parallel, and all rows advance by a character together.  ``keep`` blanks places of the patterns, ``parts`` is how
    many words of bits the longest pattern here needs.
    """
    n = len(i)
    ones = ~np.uint64(0)
    left = np.full((parts, n), ones)
    at = np.ascontiguousarray(codes.T).astype(np.int64) + i * p.symbols
    u, s = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for where in at:
        carry = None
        for k in range(parts):
            v = left[k]
            np.take(p.bits[k], where, out=u)
            if keep is not None:
                u &= keep[k]
            u &= v
            np.add(v, u, out=s)
            if parts > 1:
                more = s < v
                if carry is not None:
                    s += carry
                    more |= s < carry
                carry = more.astype(np.uint64)
            v -= u
            v |= s
    return np.bitwise_count(~left).sum(0, dtype=np.int64)


def in_parts(a: Texts, b: Texts, p: Patterns, i: np.ndarray, j: np.ndarray, shared: bool = True) -> np.ndarray:
    """``common`` of the texts that ``i`` and ``j`` name, so many at a time; without ``shared`` words that a pair shares are left out."""
    out = np.zeros(len(i), np.int64)
    order = np.argsort((-(-a.length[i] // 64)) * 100_000 + b.length[j], kind="stable")
    for at in range(0, len(i), AT_ONCE):
        own = order[at : at + AT_ONCE]
        x, y = i[own], j[own]
        codes = b.codes[y, : int(b.length[y].max()) + 1]
        parts, keep = max(1, -(-(int(a.length[x].max()) + 1) // 64)), None
        parts = min(parts, len(p.bits))
        if not shared:
            same = (a.ids[x][:, :, None] == b.ids[y][:, None, :]) & (a.ids[x] >= 0)[:, :, None]
            gone = np.take_along_axis(same.any(1), b.word[y, : codes.shape[1]].astype(np.int64), 1)
            codes = np.where(gone, 0, codes)
            keep = _kept(a, x, same.any(2), parts)
        out[own] = common(p, x, codes, parts, keep)
    return out


def _kept(a: Texts, x: np.ndarray, gone: np.ndarray, parts: int) -> np.ndarray:
    """Bits of the places whose word is not ``gone``."""
    places = ~np.take_along_axis(gone, a.word[x].astype(np.int64), 1)
    wide = np.zeros((len(x), parts * 64), bool)
    wide[:, : places.shape[1]] = places[:, : parts * 64]
    return np.ascontiguousarray(np.packbits(wide, axis=1, bitorder="little").view(np.uint64).T)


def _similar(lcs: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.divide(200.0 * lcs, total, out=np.full(len(lcs), 100.0), where=total > 0)


def ratio(a: Texts, b: Texts, p: Patterns, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return _similar(in_parts(a, b, p, i, j), a.length[i] + b.length[j])


def partial(a: Texts, b: Texts, p: Patterns, q: Patterns, i: np.ndarray, j: np.ndarray, need: np.ndarray | None = None) -> np.ndarray:
    """The best window's ratio of each pair (``p`` and ``q`` are the patterns of ``a`` and ``b``); 0 if one text is empty, 100 if both are.

    With ``need`` pairs that cannot reach theirs are left at 0: a window has no more in common with the shorter text than
    the longer text has, nor than a span of ``STRIDE`` windows.
    """
    out = np.where((a.length[i] == 0) & (b.length[j] == 0), 100.0, 0.0)
    swap = a.length[i] > b.length[j]
    for x, y, held, f, g, own in ((a, b, p, i, j, np.flatnonzero(~swap)), (b, a, q, j, i, np.flatnonzero(swap | (a.length[i] == b.length[j])))):
        own = own[x.length[f[own]] > 0]
        if need is not None:
            for lcs in (lambda f, g: in_parts(x, y, held, f, g), lambda f, g: _spans(x, y, held, f, g, STRIDE)):  # noqa: B023
                n = x.length[f[own]]
                most = np.minimum(lcs(f[own], g[own]), n)
                own = own[200.0 * most / (n + most) >= need[own]]
        out[own] = np.maximum(out[own], _spans(x, y, held, f[own], g[own], 1))
    return out


def _spans(x: Texts, y: Texts, held: Patterns, f: np.ndarray, g: np.ndarray, stride: int) -> np.ndarray:
    """The best window's ratio of each pair, the shorter text first; beyond one of ``stride`` windows together, what a span of them has in common."""
    out, by_size = np.zeros(len(f)), np.argsort(x.length[f], kind="stable")
    f, g = f[by_size], g[by_size]
    n, m = x.length[f], y.length[g]
    windows = -(-(n + m - 1) // stride)  # those that begin before the text, within it, or end after it
    ends = segment_ends(windows)
    at = 0
    while at < len(f):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + AT_ONCE, side="right")) - 1)
        pair = np.repeat(np.arange(at, to), windows[at:to])
        begin = (np.arange(len(pair)) + ends[at] - ends[pair]) * stride - n[pair] + 1
        longest = int(n[at:to].max())
        wide = longest + stride - 1
        place = begin[:, None] + np.arange(wide)
        inside = (place >= 0) & (place < m[pair][:, None]) & (np.arange(wide) < n[pair][:, None] + stride - 1)
        codes = np.where(inside, y.codes[g[pair][:, None], np.clip(place, 0, y.codes.shape[1] - 1)], 0)
        got = common(held, f[pair], codes, -(-longest // 64))
        np.maximum.at(out, by_size[pair], _similar(got, n[pair] + inside.sum(1)) if stride == 1 else got)
        at = to
    return out


def segment_ends(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


class Keys(NamedTuple):
    """Texts as they are, with their words sorted, and with each word once, sorted."""

    plain: Texts
    ordered: Texts
    once: Texts

    def __len__(self) -> int:
        return len(self.plain.length)


def keys(texts: Sequence[str], codes: dict[str, int], words: dict[str, int]) -> Keys:
    split = [[w for w in t.split() if w] for t in texts]
    forms = (texts, [" ".join(sorted(s)) for s in split], [" ".join(sorted(set(s))) for s in split])
    return Keys(*(coded(f, codes, words) for f in forms))


def set_rest(a: Texts, b: Texts, p: Patterns, ended: tuple[Texts, Texts, Patterns], i: np.ndarray, j: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The ratio of two word sets' texts, the shared words first in both; ``shared`` is their length with blanks between.

    The rests' words are compared with a blank after each, so that the last one's is taken off what they have in common.
    """
    rest_a, rest_b = (t.length[k] - np.where(shared > 0, shared + 1, 0) for t, k in ((a, i), (b, j)))
    lcs = np.zeros(len(i), np.int64)
    whole = shared == 0
    lcs[whole] = in_parts(a, b, p, i[whole], j[whole])
    part = np.flatnonzero(~whole & (rest_a > 0) & (rest_b > 0))
    if len(part):
        lcs[part] = in_parts(*ended, i[part], j[part], shared=False) - 1  # the last blank of both
    total = a.length[i] + b.length[j]
    return np.divide(100.0 * (total - (np.maximum(rest_a, 0) + np.maximum(rest_b, 0) - 2 * lcs)), total, out=np.full(len(i), 100.0), where=total > 0)


def _ended(t: Texts) -> Texts:
    """The texts with a blank at the end; code 1 is the blank (see ``best``)."""
    codes = t.codes.copy()
    codes[np.arange(len(codes)), t.length] = np.where(t.length > 0, 1, 0)
    word = t.word.copy()
    last = np.maximum((t.ids >= 0).sum(1) - 1, 0)
    word[np.arange(len(codes)), t.length] = last
    return t._replace(codes=codes, word=word, length=t.length + (t.length > 0))


def _bags(a: Texts, b: Texts, size: int) -> np.ndarray:
    """For every pair, how many characters both hold: no subsequence is longer."""
    count = lambda t: np.stack([(np.where(t.codes > 0, (t.codes - 1) % 48 + 1, 0) == c).sum(1) for c in range(1, min(size, 48) + 1)], 1).astype(np.uint16)
    x, y = count(a), count(b)
    out = np.zeros((len(x), len(y)), np.uint16)
    for c in range(x.shape[1]):
        out += np.minimum(x[:, c][:, None], y[:, c][None, :])
    return out


def best(left: Sequence[str], right: Sequence[str], floor: float = 70.0) -> tuple[np.ndarray, np.ndarray]:
    """As ``best_alike``, in bounded memory; of many pairs only those are laid out that can win.

    Texts of one blank between words and of ``LONG`` characters at most are sifted, see ``sifted``; others are few, and tiled.
    """
    if len(left) * len(right) <= FEW_PAIRS or floor > STRONG:
        return tiled(left, right, floor)
    x, y = (np.array([0 < len(t) <= LONG and " ".join(t.split()) == t for t in side], bool) for side in (left, right))
    score, which = np.zeros(len(left)), np.full(len(left), -1, np.int64)
    for rows, cols, how in ((x, y, sifted), (x, ~y, tiled), (~x, y | ~y, tiled)):
        rows, cols = np.flatnonzero(rows), np.flatnonzero(cols)
        s, w = how([left[k] for k in rows], [right[k] for k in cols], floor)
        own = np.flatnonzero(w >= 0)
        _raise(score, which, rows[own], s[own], cols[w[own]])
    return score, which


def _raise(score: np.ndarray, which: np.ndarray, row: np.ndarray, s: np.ndarray, j: np.ndarray) -> None:
    """Put higher scores in place, of equal ones that of the first text; a row may be there more than once."""
    order = np.lexsort((j, -s, row))
    row, s, j = row[order], s[order], j[order]
    first = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
    row, s, j = row[first], s[first], j[first]
    wins = (s > score[row]) | ((s == score[row]) & (j < which[row]))
    score[row[wins]], which[row[wins]] = s[wins], j[wins]


def tiled(left: Sequence[str], right: Sequence[str], floor: float = 70.0) -> tuple[np.ndarray, np.ndarray]:
    """As ``best_alike``, ``LEFTS`` and ``RIGHTS`` texts at a time, so that memory is bounded: what was found must be beaten by what follows.

    Texts of very unlike lengths are not laid side by side if they cannot reach the floor anyway.
    """
    score, which = np.zeros(len(left)), np.full(len(left), -1, np.int64)
    apart = floor > 100 * FAR_WINDOWS and max(map(len, [*left, *right]), default=0) > LONG
    x, y = (np.array([len(t).bit_length() if apart else 0 for t in side], np.int64) for side in (left, right))
    for band in np.unique(x):
        rows, others = np.flatnonzero(x == band), np.flatnonzero(np.abs(y - band) <= 4)  # within eight times the length
        for a in range(0, len(rows), LEFTS):
            i = rows[a : a + LEFTS]
            for b in range(0, len(others), RIGHTS):
                j = others[b : b + RIGHTS]
                s, w = best_alike([left[k] for k in i], [right[k] for k in j], floor, score[i])
                better = w >= 0
                score[i[better]], which[i[better]] = s[better], j[w[better]]
    return score, which


class Form(NamedTuple):
    """What bounds need of a form of texts: lengths, columns whose products count common characters, what these leave out, and bits of pairs."""

    length: np.ndarray
    columns: np.ndarray
    rest: np.ndarray
    bits: np.ndarray
    lost: np.ndarray


def _counts(t: Texts, buckets: int = 64) -> np.ndarray:
    out, rows = np.zeros((len(t.length), buckets), np.uint8), np.arange(len(t.length))
    for j in range(int(t.length.max(initial=0))):
        own = t.length > j
        out[rows[own], (t.codes[own, j] - 1) % buckets] += 1
    return out


def _pair_bits(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each text's pairs of neighbouring characters (a repeated one counts again), and how many pairs share one."""
    wide = t.codes.shape[1] - 1
    pair = t.codes[:, :-1].astype(np.int64) * (1 << 20) + t.codes[:, 1:]
    pair[np.arange(wide) >= np.maximum(t.length - 1, 0)[:, None]] = 0
    pair.sort(axis=1)
    new = np.ones(pair.shape, bool)
    new[:, 1:] = pair[:, 1:] != pair[:, :-1]
    at = np.arange(wide) + np.zeros((len(pair), 1), np.int64)
    again = at - np.maximum.accumulate(np.where(new, at, 0), axis=1)
    bit = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + again.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)) % np.uint64(BITS)
    held = np.zeros((len(pair), BITS), bool)
    row, col = np.nonzero(pair)
    held[row, bit[row, col].astype(np.int64)] = True
    return np.packbits(held, axis=1).view(np.uint64), np.maximum(t.length - 1, 0) - held.sum(1)


def forms(a: Texts, b: Texts) -> tuple[Form, Form]:
    """Both sides' forms: a column says that a character is there so many times; the most common ones of these are taken."""
    x, y = _counts(a), _counts(b)
    often = np.stack([np.minimum((x >= k).mean(0), (y >= k).mean(0)) for k in range(1, 17)])  # falls with k
    least = np.sort(often.ravel())[-min(CHARACTERS, often.size)]
    most = (often >= max(least, 1e-12)).sum(0)
    out = []
    for t, counts in ((a, x), (b, y)):
        columns = np.concatenate([counts[:, c : c + 1] >= np.arange(1, k + 1) for c, k in enumerate(most.tolist()) if k] or [np.zeros((len(counts), 1), bool)], axis=1)
        bits = [_pair_bits(t._replace(codes=t.codes[k : k + COLUMNS], length=t.length[k : k + COLUMNS])) for k in range(0, len(counts), COLUMNS)]
        out.append(Form(t.length, columns.astype(np.uint8), (t.length - columns.sum(1)).astype(np.float32), *(np.concatenate(p) for p in zip(*bits, strict=True))))
    return out[0], out[1]


class Way(NamedTuple):
    """A way to win: the ratio that whole texts must have, that of a window, for each row, and pairs of characters that an order of words hides."""

    whole: np.ndarray
    window: np.ndarray
    hidden: int

    def characters(self, rows, near: np.ndarray, total: np.ndarray, short: np.ndarray) -> np.ndarray:
        """What must be in common, of texts of ``total`` characters together and ``short`` in the shorter one."""
        whole, window = self.whole[rows], self.window[rows]
        part = window / (200.0 - np.minimum(window, 199.0))
        return np.where(near, np.where(whole <= 100 + 1e-6, whole / 200 * total, np.inf), np.where(window <= 100 + 1e-6, part * short, np.inf))

    def pairs(self, rows, near: np.ndarray, total: np.ndarray, short: np.ndarray) -> np.ndarray:
        """A subsequence of L characters of texts of n and m takes 3 L - 1 - n - m of their pairs of neighbours at least."""
        whole, window = self.whole[rows], self.window[rows]
        part = window / (200.0 - np.minimum(window, 199.0))
        all_of = np.where(whole <= 100 + 1e-6, (3 * whole / 200 - 1) * total, np.inf)
        spans = np.where(window <= 100 + 1e-6, (3 * window / 200 - 1) * (1 + part) * short, np.inf)
        far = np.where(whole > 200 / (1 + NEAR), spans, np.minimum(spans, all_of))  # beyond that the longer text is too long
        return np.where(near, all_of, far) - 1 - self.hidden - 1e-6


def _reach(f: Form, g: Form, rows: np.ndarray, cols: np.ndarray, n: np.ndarray, m: np.ndarray, ways: Sequence[Way]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of ``rows`` and ``cols`` with so many characters, and pairs of them, in common that one of the ways is open; and the former, at most.

    ``n`` and ``m`` are the lengths that say whether whole texts or windows are asked for; the ways have a value for each row.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    x = np.concatenate([f.columns[rows], np.ones((len(rows), 1)), f.rest[rows, None] / 2], axis=1, dtype=np.float32)
    for at in range(0, len(cols) if len(rows) else 0, COLUMNS):
        own = cols[at : at + COLUMNS]
        y = np.concatenate([g.columns[own], g.rest[own, None] / 2, np.ones((len(own), 1))], axis=1, dtype=np.float32)
        sizes, back = np.unique(m[own] * (1 << 20) + g.length[own], return_inverse=True)
        sizes = np.divmod(sizes, 1 << 20)
        near = np.maximum(n[rows][:, None], sizes[0]) < NEAR * np.minimum(n[rows][:, None], sizes[0])
        short, total = np.minimum(f.length[rows][:, None], sizes[1]), f.length[rows][:, None] + sizes[1]
        each = (np.arange(len(rows))[:, None], near, total, short)
        need = np.minimum.reduce([w.characters(*each) for w in ways]) - 0.01
        few = np.minimum.reduce([w.pairs(*each) for w in ways])
        common = x @ y.T
        i, k = np.divmod(np.flatnonzero(common >= np.take(need.astype(np.float32), back, axis=1)), len(own))
        for to in range(0, len(i), 8 * AT_ONCE):
            p, q = i[to : to + 8 * AT_ONCE], k[to : to + 8 * AT_ONCE]
            r, c = rows[p], own[q]
            pairs = np.bitwise_count(f.bits[r] & g.bits[c]).sum(1, dtype=np.uint16) + np.minimum(f.lost[r], g.lost[c])
            keep = pairs >= few[p, back[q]]
            found.append((r[keep], c[keep], common[p[keep], q[keep]] + 0.01))
    return tuple(np.concatenate(p) for p in zip(*found, strict=True))


class Index(NamedTuple):
    """Entries (word, text) in order, with the words' cuts."""

    cuts: np.ndarray
    text: np.ndarray

    @staticmethod
    def of(word: np.ndarray, text: np.ndarray, words: int) -> "Index":
        order = np.lexsort((text, word))
        return Index(np.searchsorted(word[order], np.arange(words + 1)), text[order])

    def met(self, word: np.ndarray, row: np.ndarray, most: int = 1 << 19):
        """(row, text) for every entry of the words, about ``most`` at a time."""
        begin, many = self.cuts[word], self.cuts[word + 1] - self.cuts[word]
        ends = segment_ends(many)
        at = 0
        while at < len(word):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            own = many[at:to]
            place = np.arange(ends[to] - ends[at]) + np.repeat(begin[at:to] - (ends[at:to] - ends[at]), own)
            yield np.repeat(row[at:to], own), self.text[place]
            at = to


def _words(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    row, at = np.nonzero(t.ids >= 0)
    return row, t.ids[row, at]


def _first_words(row: np.ndarray, word: np.ndarray, often: np.ndarray, size: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Which words are a text's rarest ones that are more than it can spare: a text that shares the rest shares one of these."""
    order = np.lexsort((often[word], row))
    own = size[word[order]]
    before = np.cumsum(own) - own
    first = np.append(True, row[order][1:] != row[order][:-1]) if len(row) else np.zeros(0, bool)
    before -= before[first][np.cumsum(first) - 1]
    out = np.zeros(len(row), bool)
    out[order] = before <= spare[row[order]] + 1e-6
    return out


def _sharing_far(index: Index, row: np.ndarray, word: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For each left text the first right one of an unlike length, up to ``FAR`` times, that shares a word with it; as many as there are if none."""
    out, at, wide = np.full(len(n), len(m)), index.cuts[word], 4
    while len(row):
        place = at[:, None] + np.arange(wide)
        there = place < index.cuts[word + 1][:, None]
        j = index.text[np.where(there, place, 0)]
        longer, shorter = np.maximum(n[row][:, None], m[j]), np.minimum(n[row][:, None], m[j])
        fits = there & (longer >= NEAR * shorter) & (longer <= FAR * shorter)
        has = fits.any(1)
        np.minimum.at(out, row[has], j[has, fits[has].argmax(1)])
        more = ~has & (at + wide < index.cuts[word + 1]) & (j[:, -1] < out[row])
        row, word, at, wide = row[more], word[more], at[more] + wide, min(2 * wide, 1024)
    return out


def sifted(left: Sequence[str], right: Sequence[str], floor: float = 70.0) -> tuple[np.ndarray, np.ndarray]:
    """As ``best_alike``, for many tidy texts: pairs are found by words and by matrix products, and few are scored.

    Equal texts score 100, and a text of an unlike length that shares a word ``STRONG``; both are looked up.  What beats that,
    or the floor if there is neither (or is as good, and comes first), shares most of a text's words, of which one of its
    rarest, or most of its characters and their pairs: the latter bounds are products of matrices, for all pairs.
    """
    codes, words = {" ": 1}, {}
    score, which = np.zeros(len(left)), np.full(len(left), -1, np.int64)
    if not len(left) or not len(right):
        return score, which
    a, b = (Keys(*(t._replace(codes=t.codes.astype(np.uint16)) for t in keys(side, codes, words))) for side in (left, right))
    n, m = a.plain.length, b.plain.length
    size = np.array([len(w) + 1 for w in words], np.int64)
    (row, word), (col, held) = _words(a.once), _words(b.once)
    index, often = Index.of(held, col, len(words)), np.bincount(held, minlength=len(words))
    far = _sharing_far(index, row, word, n, m)
    own = np.flatnonzero(far < len(right))
    score[own], which[own] = STRONG, far[own]
    place = {t: k for k, t in reversed(list(enumerate(right)))}
    same = np.array([place.get(t, -1) for t in left])
    score[same >= 0], which[same >= 0] = 100.0, same[same >= 0]
    weak = score < STRONG
    if floor <= 100 * WORDS * FAR_WINDOWS:  # a word shared with a much longer text is enough
        own = np.flatnonzero(weak)
        score[own], which[own] = tiled([left[k] for k in own], right, floor)
        weak[:] = False
    plain, once = forms(a.plain, b.plain), forms(a.once, b.once)
    repeats = [np.flatnonzero(k.plain.length != k.once.length) for k in (a, b)]
    spare = lambda c: 1 - np.minimum(c, 100) / (200 - np.minimum(c, 100))
    begins, every = np.searchsorted(row, np.arange(len(left) + 1)), np.arange(len(right))
    for rows, least in ((np.flatnonzero(weak), floor), (np.flatnonzero((score >= STRONG) & (score < 100) & ~weak), STRONG)):
        rare = _first_words(col, held, often, size, spare(np.full(len(right), least / WORDS)) * b.once.length)
        prefix = Index.of(held[rare], col[rare], len(words))
        for at in range(0, len(rows), ROWS):
            some = rows[at : at + ROWS]
            mine = np.concatenate([np.arange(begins[k], begins[k + 1]) for k in some])
            i, k = row[mine], word[mine]
            first = _first_words(i, k, often, size, spare(np.maximum(score, least) / WORDS) * a.once.length)
            for pairs in (index.met(k[first], i[first]), prefix.met(k, i)):
                for x, y in pairs:
                    near = np.maximum(n[x], m[y]) < NEAR * np.minimum(n[x], m[y])
                    x, y = _distinct(x[near], y[near], len(right))
                    _raise(score, which, x, WORDS * _by_words(a.once, b.once, size, x, y)[1], y)
            if least < STRONG:
                for x, y in (_within(left, right, some, repeats[1], n, m), _alike(*plain, some)):
                    able = score[x] < STRONG
                    _score(a, b, codes, size, x[able], y[able], np.full(int(able.sum()), np.inf), score, which)
            for f, g, weight, r, c in ((*plain, 1.0, some, every), (*once, WORDS, np.intersect1d(some, repeats[0]), every), (*once, WORDS, np.setdiff1d(some, repeats[0]), repeats[1])):
                need = np.maximum(score[r], least)
                moved = Way(need / WORDS, need / (WORDS * WINDOWS), HIDDEN)
                if weight == 1:
                    ways = [Way(need, need / WINDOWS, 0), moved]
                else:  # windows are those of the words as they are here
                    ways = [moved._replace(window=np.full(len(r), np.inf)), moved._replace(whole=np.full(len(r), np.inf), hidden=0)]
                x, y, most = _reach(f, g, r, c, n, m, ways)
                _score(a, b, codes, size, x, y, most if weight == 1 else np.full(len(x), np.inf), score, which, floor)
    which = np.where(score >= floor, which, -1)
    return np.where(which >= 0, score, 0.0), which


def _within(left: Sequence[str], right: Sequence[str], rows: np.ndarray, repeats: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first text of an unlike length that repeats words, all of which together are a part of the row's: a window of it."""
    form, x, y = lambda t: " ".join(sorted(set(t.split(" ")))), [], []
    short = [(j, form(right[j]), m[j]) for j in repeats.tolist()]
    for i in rows.tolist():
        own, size = form(left[i]), n[i]
        j = next((j for j, t, to in short if t in own and NEAR * min(size, to) <= max(size, to) <= FAR * min(size, to)), None)
        if j is not None:
            x.append(i)
            y.append(j)
    return np.array(x, np.int64), np.array(y, np.int64)


def _alike(f: Form, g: Form, rows: np.ndarray, most: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """For each row the texts whose characters are most like its own."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    y = g.columns.astype(np.float32).T
    for at in range(0, len(rows), 64):
        own = rows[at : at + 64]
        like = f.columns[own].astype(np.float32) @ y / (f.length[own][:, None] + g.length).astype(np.float32)
        best = np.argpartition(-like, most - 1, axis=1)[:, :most] if like.shape[1] > most else np.tile(np.arange(like.shape[1]), (len(own), 1))
        out.append((np.repeat(own, best.shape[1]), best.ravel()))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def _distinct(x: np.ndarray, y: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.unique(x * wide + y), wide)


def _by_words(a: Texts, b: Texts, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The length of the words that pairs share, and the score that follows from it."""
    shared = np.zeros(len(i), np.int64)
    step = max(1, (1 << 23) // max(1, a.ids.shape[1] * b.ids.shape[1]))
    for at in range(0, len(i), step):
        x, y = a.ids[i[at : at + step]], b.ids[j[at : at + step]]
        shared[at : at + step] = np.where((x[:, :, None] == y[:, None, :]).any(2) & (x >= 0), size[x], 0).sum(1)
    shared = np.maximum(shared - 1, 0)
    n, m = a.length[i], b.length[j]
    score = np.where(shared > 0, 200.0 * shared / np.maximum(shared + np.minimum(n, m), 1), 0.0)
    return shared, np.where((shared > 0) & ((shared == n) | (shared == m)), 100.0, score)


def _score(a: Keys, b: Keys, codes: dict[str, int], size: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, score: np.ndarray, which: np.ndarray, floor: float = 0.0) -> None:
    """Score pairs, and raise what they beat; so many at a time.  ``most`` characters are common to a pair at most."""
    for at in range(0, len(i), 4 * AT_ONCE):
        x, y = i[at : at + 4 * AT_ONCE], j[at : at + 4 * AT_ONCE]
        n, m = a.plain.length[x], b.plain.length[y]
        longer, shorter = np.maximum(n, m), np.minimum(n, m)
        near = (shorter > 0) & (longer < NEAR * shorter)
        window = np.where(longer <= FAR * np.maximum(shorter, 1), WINDOWS, FAR_WINDOWS)
        shared, by_words = _by_words(a.once, b.once, size, x, y)
        known = np.where(near, WORDS * by_words, np.where(shared > 0, 100.0 * WORDS * window, 0.0)) * (shorter > 0)
        for own in (np.flatnonzero(near), np.flatnonzero(~near)):
            if len(own):
                lefts, p = np.unique(x[own], return_inverse=True)
                rights, q = np.unique(y[own], return_inverse=True)
                sides = Sides(*(Keys(*(Texts(*(z[rows] for z in t)) for t in k)) for k, rows in ((a, lefts), (b, rights))), len(codes) + 1)
                top = 200.0 * most[at : at + 4 * AT_ONCE][own] / (n[own] + m[own])
                like = np.where((a.once.length[x] == n) & (b.once.length[y] == m), WORDS * 200.0 * most[at : at + 4 * AT_ONCE] / (n + m), 100.0)[own]
                s = weighted_pairs(sides, p, q, known[own], near[own], window[own], shared[own], top, like, np.full(len(own), 100.0), np.maximum(score[x[own]], floor) - 1e-9)
                _raise(score, which, x[own], s, y[own])


def best_alike(left: Sequence[str], right: Sequence[str], floor: float = 70.0, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each left text the highest ``weighted`` score over all right texts, and the first right text that has it; -1 if under ``floor``.

    A left text's score must be above its ``least`` as well, if that is given, or it counts as none.
    Scores of shared words follow from their lengths for all pairs.  Subsequences are found only for pairs whose bound (by
    the characters both hold) reaches the floor and the best score so far, the most promising pairs first.
    """
    codes, words = {" ": 1}, {}
    a, b = keys(left, codes, words), keys(right, codes, words)
    score, which = np.zeros(len(left)), np.full(len(left), -1, np.int64)
    if not len(left) or not len(right):
        return score, which
    n, m = a.plain.length[:, None], b.plain.length[None, :]
    longer, shorter = np.maximum(n, m), np.minimum(n, m)
    near = (shorter > 0) & (longer < NEAR * shorter)
    window = np.where(longer <= FAR * np.maximum(shorter, 1), WINDOWS, FAR_WINDOWS)
    once_n, once_m = a.once.length[:, None], b.once.length[None, :]

    held = np.intersect1d(a.once.ids, b.once.ids)
    held = held[held >= 0]
    size_of = np.zeros(len(words) + 1)
    for w, k in words.items():
        size_of[k] = len(w) + 1

    def presence(t: Texts) -> np.ndarray:
        out = np.zeros((len(t.length), len(held)), np.float32)
        at = np.searchsorted(held, t.ids)
        row, col = np.nonzero((t.ids >= 0) & (at < len(held)) & (held[np.minimum(at, len(held) - 1)] == t.ids)) if len(held) else (np.zeros(0, int), np.zeros(0, int))
        out[row, at[row, col]] = 1
        return out

    shared = np.rint((presence(a.once) * size_of[held].astype(np.float32)) @ presence(b.once).T).astype(np.int64)
    shared = np.maximum(shared - 1, 0)  # a blank between words only
    subset = (shared > 0) & ((shared == once_n) | (shared == once_m))
    by_words = np.where(shared > 0, 200.0 * shared / np.maximum(shared + np.minimum(once_n, once_m), 1), 0.0)
    by_words = np.where(subset, 100.0, by_words)
    known = np.where(near, WORDS * by_words, np.where(shared > 0, 100.0 * WORDS * window, 0.0)) * (shorter > 0)

    bag, bag_once = _bags(a.plain, b.plain, len(codes)).astype(np.int64), _bags(a.once, b.once, len(codes)).astype(np.int64)
    top = 200.0 * bag / np.maximum(n + m, 1)
    like = WORDS * np.maximum(top, 200.0 * bag_once / np.maximum(once_n + once_m, 1))
    small = np.minimum(n, m)
    apart = window * 200.0 * bag / np.maximum(small + bag, 1)
    once_small = np.minimum(once_n, once_m)
    apart = np.maximum(apart, np.where(shared > 0, 0.0, window * WORDS * 200.0 * np.maximum(bag, bag_once) / np.maximum(np.minimum(small, once_small) + np.maximum(bag, bag_once), 1)))
    bound = np.maximum(known, np.where(near, np.maximum(top, like), np.maximum(top, apart))) * (shorter > 0)
    bound = np.minimum(bound, 100.0)

    row, least = np.arange(len(left)), np.zeros(len(left)) if least is None else least
    which = known.argmax(1)
    score = known[row, which]
    order = np.argsort(-bound, axis=1, kind="stable")
    sides = Sides(a, b, len(codes) + 1)
    done, step = 0, 8
    while done < len(right):
        own = order[:, done : done + step]
        need = np.maximum(np.maximum(score, floor), least) - 1e-9
        i, k = np.nonzero(bound[row[:, None], own] >= need[:, None])
        if not len(i):
            break
        j = own[i, k]
        got = weighted_pairs(sides, i, j, *(x[i, j] for x in (known, near, window, shared, top, like, apart)), need[i])
        rank = np.lexsort((j, -got, i))
        first = rank[np.append(True, i[rank][1:] != i[rank][:-1])]
        r, s, w = i[first], got[first], j[first]
        wins = (s > score[r]) | ((s == score[r]) & (w < which[r]))
        score[r[wins]], which[r[wins]] = s[wins], w[wins]
        done, step = done + step, min(step * 4, 512)
    which = np.where((score >= floor) & (score > least), which, -1)
    return np.where(which >= 0, score, 0.0), which


class Sides:
    """Both sides' keys with what their comparison needs, made once for a block of pairs."""

    def __init__(self, a: Keys, b: Keys, symbols: int):
        self.a, self.b = a, b
        self.p = [patterns(t, symbols) for t in a]
        self.symbols = symbols
        ended = _ended(a.once), _ended(b.once)
        self.ended = (*ended, patterns(ended[0], symbols))
        once = lambda k: k.ordered.length == k.once.length
        self.distinct = once(a), once(b)

    @cached_property
    def q(self) -> list[Patterns]:
        """The right texts' patterns, for windows of longer left ones."""
        return [patterns(t, self.symbols) for t in self.b]


def weighted_pairs(s: Sides, i, j, known, near, window, shared, top, like, apart, need) -> np.ndarray:
    """``weighted`` of pairs, given what their shared words alone give; forms whose bound is under ``need`` are left out."""
    a, b, out = s.a, s.b, known.copy()

    def raise_to(own: np.ndarray, score) -> None:
        if len(own):
            out[own] = np.maximum(out[own], score(i[own], j[own], own))

    raise_to(np.flatnonzero(top >= need), lambda x, y, own: ratio(a.plain, b.plain, s.p[0], x, y))
    words = near & (like >= need)
    raise_to(np.flatnonzero(words), lambda x, y, own: WORDS * ratio(a.ordered, b.ordered, s.p[1], x, y))
    again = words & ~((shared == 0) & s.distinct[0][i] & s.distinct[1][j])  # else it is the form before
    raise_to(np.flatnonzero(again), lambda x, y, own: WORDS * set_rest(a.once, b.once, s.p[2], s.ended, x, y, shared[own]))
    far = ~near & (apart >= need)
    raise_to(np.flatnonzero(far), lambda x, y, own: window[own] * partial(a.plain, b.plain, s.p[0], s.q[0], x, y, need[own] / window[own] - 1e-9))
    far &= shared == 0
    raise_to(np.flatnonzero(far), lambda x, y, own: WORDS * window[own] * partial(a.ordered, b.ordered, s.p[1], s.q[1], x, y, need[own] / (WORDS * window[own]) - 1e-9))
    far &= ~(s.distinct[0][i] & s.distinct[1][j])
    raise_to(np.flatnonzero(far), lambda x, y, own: WORDS * window[own] * partial(a.once, b.once, s.p[2], s.q[2], x, y, need[own] / (WORDS * window[own]) - 1e-9))
    return out


def partial_scores(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """``partial`` of every left text with every right one, as a matrix."""
    codes, words = {" ": 1}, {}
    a, b = coded(left, codes, words), coded(right, codes, words)
    i, j = np.divmod(np.arange(len(left) * len(right)), max(len(right), 1))
    return partial(a, b, patterns(a, len(codes) + 1), patterns(b, len(codes) + 1), i, j).reshape(len(left), len(right))
