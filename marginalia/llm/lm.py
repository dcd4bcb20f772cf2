"""LM scoring: online logistic context mixing over a text's bytes, giving its total bits.

Contexts are the last 3 and 4 bytes and the word so far.  Counts of (context, next byte) pairs over all learning texts are
kept exactly, in hash ranges whose number grows with the input: each block of texts sends its distinct pairs with its own
counts there, and gets back, for each pair, the log odds of the byte's eight bits, each after the bits before it.  While a
text is scored, a mixer weighs the contexts' predictions in the logistic domain: the bit's place in its byte is the gate that
chooses the weights, and these move along the error after every few bytes (``steps``), from a text's beginning to its end
without a break.  All texts of a group go side by side, a step at a time.

That gives each token a probability, which is refined by the corpus's exact word counts.  Learning texts are told apart by
their language into ``KINDS_OF_TEXT`` kinds; a text's kind is inferred, token by token, from how well the kinds' counts
explained the tokens before.  The mixer's and the counts' probability are added with weights that follow how much of the text
so far each of them explained.

What is scored is the text's tokens: its words, A to Z lower-cased, with one blank between two, and an end.  The base is
the smoothed unigram model of the same tokens.  Words meet by hash ranges as pairs do, so no task, nor the driver, holds the
corpus's words or contexts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import bucketed, chunks, give_back, id_remainder, segment_starts, stored, tidy, words_of

#: Contexts: so many last bytes each (7 at most), and the word so far.
ORDERS = (3, 4)
#: Bits of a context's hash beyond those that count the input's bytes: at any size, one context in 1024 meets another.
MARGIN, WIDEST = 10, 55
#: What a node counts before it has seen a bit, for each value.
PRIOR = 0.05
#: Stretched probabilities are stored as bytes of this many to one unit.
SCALE = 12.0
START, RATE = 0.35, 0.01
#: Bytes after which weights move, but for a text's first ones, where they move sooner.
STEP = 32
#: Texts that are mixed side by side, to stay near the processor.
SIDE = 192
#: Log odds of a mistake that a bit may have at most, either way.
SURE = 10.0
#: Kinds of learning texts (by the hash of their language), a kind's part in its words' probability, and how much a token before counts.
KINDS_OF_TEXT, OWN, TRUST = 8, 0.9, 0.7
#: Tokens that the refinement's first, even weights count as.
HABIT = 6.0
#: Bytes of text of one block, and of what is scored at once; input bytes for each hash range of words.
BLOCK, SCORED, RANGE = 8 << 20, 4 << 20, 32 << 20
#: Bytes of text whose pairs are made at once, to stay near the processor, and counted at once.
HASHED, COUNTED = 1 << 16, 1 << 20
#: Compression of texts.
CLOSE = 3
#: Buckets that Spark lets a table have.
MOST_BUCKETS = 100_000
#: Zero bytes before each text, as its contexts; one more ends it.
LEAD = 8

POWERS = np.cumprod(np.array([1] + [0x9E3779B97F4A7C15] * 63, np.uint64), dtype=np.uint64)
ODD = np.uint64(0xD6E8FEB86659FD93)


def canonical(text: bytes) -> bytes:
    return b" ".join(words_of(text))


def canonicals(column: pa.Array) -> list[bytes]:
    """``canonical`` of each text; null is empty."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.cast(pa.string()), "")))
    return pc.ascii_trim(pc.binary_join(words, " "), " ").cast(pa.binary()).to_pylist()  # outer white space leaves empty words


class Stream:
    """Texts end to end, each after ``LEAD`` zero bytes and before one, and the (context, byte) pair of each byte that counts."""

    def __init__(self, texts: list[bytes]):
        gap = bytes(LEAD)
        self.data = np.frombuffer(b"".join([x for t in texts for x in (gap, t, b"\0")]), np.uint8)
        self.sizes = np.array([len(t) + 1 for t in texts], np.int64)
        inside = np.column_stack((np.full(len(texts), LEAD), self.sizes)).ravel()
        self.at = np.flatnonzero(np.repeat(np.tile([False, True], len(texts)), inside))

    def last_bytes(self) -> Iterator[np.ndarray]:
        """For each order the last bytes before each byte that counts, as a number."""
        if not len(self.at):
            yield from (np.empty(0, np.uint64) for _ in ORDERS)
            return
        eight = self.before(self.at)
        for order in ORDERS:
            yield eight >> np.uint64(64 - 8 * order)

    def before(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes before each of these places, as a number."""
        return np.ndarray((len(self.data) - LEAD,), "<u8", self.data, strides=(1,))[at - LEAD]

    def bytes(self) -> np.ndarray:
        return self.data.take(self.at).astype(np.uint64)

    def pairs(self, width: int) -> Iterator[np.ndarray]:
        """For each context its hash of ``width`` bits, and the byte in the lowest eight bits."""
        byte = self.bytes()
        for x in (*self.last_bytes(), word_so_far(self.data).take(self.at)):
            yield paired(x, byte, width)


def word_so_far(data: np.ndarray) -> np.ndarray:
    """For each byte a sum over the bytes of the word before it; bytes up to 32 end words."""
    place = np.arange(len(data), dtype=np.int32)
    first = np.append(np.int32(0), np.maximum.accumulate(np.where(data <= 32, place + np.int32(1), np.int32(0))))[:-1]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * POWERS.take((place - first) & 63), dtype=np.uint64)))
    return sums[:-1] - sums.take(first)


def paired(x: np.ndarray, byte: np.ndarray, width: int) -> np.ndarray:
    """The contexts ``x`` hashed to ``width`` bits, in place, each with its byte."""
    x += np.uint64(1)
    x *= ODD
    x ^= x >> np.uint64(32)
    x *= ODD
    x >>= np.uint64(64 - width)
    x <<= np.uint64(8)
    x |= byte
    return x


def width_for(size: int) -> int:
    """Bits of the contexts' hash for an input of so many bytes."""
    return min(WIDEST, max(32, size.bit_length() + MARGIN))


def groups(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes."""
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) <= most):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


class Places:
    """Distinct pairs in the order in which they are met, and the place of each pair there; place 0 is no pair's.

    Tables by hash, each smaller than the one before, hold places: a pair that finds its slot taken goes on to the next.  The
    last one's slots change hands, so that a pair may get a second place, which ``summed`` and ``ordered`` put right.
    """

    NONE = np.uint64((1 << 64) - 1)

    def __init__(self, bits: int = 16):
        self.held, self.used = np.full(1 << 12, self.NONE, np.uint64), 1
        self._open(bits)

    def _open(self, bits: int) -> None:
        factors = (ODD, POWERS[1], np.uint64(0xC2B2AE3D27D4EB4F))
        self.bits = bits
        self.tables = [(f, np.uint64(64 - b), np.zeros(1 << b, np.int32)) for f, b in zip(factors, (bits, bits - 2, bits - 4), strict=True)]

    @property
    def keys(self) -> np.ndarray:
        return self.held[1 : self.used]

    def of(self, pairs: np.ndarray) -> np.ndarray:
        out = left = None
        for factor, shift, table in self.tables:
            own = pairs if left is None else pairs[left]
            found = table.take((own * factor >> shift).view(np.int64))
            other = np.flatnonzero(self.held.take(found) != own)
            if left is None:
                out, left = found, other
            else:
                out[left] = found
                left = left[other]
            if not len(left):
                return out
        fresh, back = np.unique(pairs[left], return_inverse=True)
        out[left] = (self.used + back).astype(np.int32)
        self._add(fresh)
        return out

    def _add(self, fresh: np.ndarray) -> None:
        at = np.arange(self.used, self.used + len(fresh), dtype=np.int32)
        self.used += len(fresh)
        if self.used > len(self.held):
            self.held = np.concatenate((self.held, np.full(max(self.used, 2 * len(self.held)) - len(self.held), self.NONE)))
        self.held[at] = fresh
        if self.used > 1 << self.bits:
            self._open(self.bits + 2)
            fresh, at = self.keys, np.arange(1, self.used, dtype=np.int32)
        for k, (factor, shift, table) in enumerate(self.tables):
            slots = (fresh * factor >> shift).view(np.int64)
            free = slice(None) if k + 1 == len(self.tables) else np.flatnonzero(table.take(slots) == 0)
            table[slots[free]] = at[free]
            rest = table.take(slots) != at
            fresh, at = fresh[rest], at[rest]

    def ordered(self) -> tuple[np.ndarray, np.ndarray]:
        return ordered(self.keys)


def ordered(all_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs in order, and for each place which of them it is, counted from 1; place 0 is 0."""
    order = np.argsort(all_keys)
    keys = all_keys[order]
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    which = np.zeros(len(keys) + 1, np.int32)
    which[1:][order] = np.cumsum(new)
    return keys[new], which


class Chained:
    """A block's pairs of one of ``ORDERS`` and their places, as ``Places`` has them."""

    def __init__(self):
        self.table, self.parts, self.used = np.zeros(0, np.int32), [], 1
        self.more: Places | None = None  # where the table would be too large

    @property
    def keys(self) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint64), *self.parts, *([self.more.keys] if self.more else [])])

    def ordered(self) -> tuple[np.ndarray, np.ndarray]:
        return ordered(self.keys)


class Chains:
    """Places of pairs whose contexts are the last bytes.

    A pair of a context one byte longer is the shorter one's place and that byte, so that a plain table has its place, and only
    new pairs are hashed.  From where a table would be too large, pairs are found by ``Places``; they may get second places.
    """

    MOST = 1 << 24

    def __init__(self, texts: list[bytes], width: int):
        seen = np.zeros(256, np.int64)
        for a, b in groups(texts, COUNTED):
            seen += np.bincount(np.frombuffer(b"".join(texts[a:b]), np.uint8), minlength=256)
        seen[0] += 1
        self.width, self.codes, self.bytes = width, np.empty(256, np.int64), int(np.count_nonzero(seen))
        self.codes[np.argsort(-seen, kind="stable")] = np.arange(256)  # frequent ones lie together
        self.threes, self.used = np.zeros(self.bytes**3, np.int32), 1
        self.known = {order: Chained() for order in range(3, max(ORDERS) + 1)}

    def of(self, stream: Stream) -> list[np.ndarray]:
        if not len(stream.at):
            return [np.empty(0, np.int32) for _ in ORDERS]
        code, many, at, out = self.codes.take(stream.data), self.bytes, stream.at, {}
        slots = ((code[:-2] * many + code[1:-1]) * many + code[2:]).take(at - 2)
        places = self.threes.take(slots)
        new = np.flatnonzero(places == 0)
        if len(new):
            fresh = np.unique(slots[new])
            self.threes[fresh] = np.arange(self.used, self.used + len(fresh))
            self.used += len(fresh)
            places[new] = self.threes.take(slots[new])
        most = self.used
        for order, own in self.known.items():
            if own.more is None and most * many > self.MOST:
                own.more, own.table = Places(), np.zeros(0, np.int32)
            if own.more is not None:
                places = own.more.of(self._pairs(stream, at, order))
                places[places > 0] += own.used - 1
                most = self.MOST + 1
            else:
                if len(own.table) < most * many:
                    table, own.table = own.table, np.zeros(min(self.MOST, 2 * most * many), np.int32)
                    own.table[: len(table)] = table
                slots = np.multiply(places, many, dtype=np.int64)
                slots += code.take(at - order)
                places = own.table.take(slots)
                new = np.flatnonzero(places == 0)
                if len(new):
                    fresh, first = np.unique(slots[new], return_index=True)
                    own.table[fresh] = np.arange(own.used, own.used + len(fresh))
                    own.used += len(fresh)
                    own.parts.append(self._pairs(stream, at[new[first]], order))
                    places[new] = own.table.take(slots[new])
                most = own.used
            out[order] = places
        return [out[order] for order in ORDERS]

    def _pairs(self, stream: Stream, at: np.ndarray, order: int) -> np.ndarray:
        return paired(stream.before(at) >> np.uint64(64 - 8 * order), stream.data.take(at).astype(np.uint64), self.width)


class Tokens:
    """A block's distinct words in order of first use, each token's number, and each text's tokens (an empty text has none)."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
        words = pc.split_pattern(pa.array([t for t in texts if t], pa.binary()), b" ").flatten().dictionary_encode()
        self.words = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.numbers = words.indices.to_numpy().astype(np.int64)
        last = np.cumsum(self.sizes)[self.sizes > 0] - 1
        self.final = np.zeros(len(self.numbers), bool)
        self.final[last] = True

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))


class WordPlaces:
    """Places of the pairs whose context is the word so far.  They follow from the word, so each distinct one is looked at once.

    A word has a place for each byte, one for the blank after it and one for the end after it; a blank or an end that no text
    of the block has there has place 0.  An empty text is the end of an empty word.
    """

    def __init__(self, tokens: Tokens, width: int):
        self.tokens = tokens
        words = [*tokens.words, b""]
        count = len(words)
        blank = np.bincount(tokens.numbers[~tokens.final], minlength=count) > 0
        end = np.bincount(tokens.numbers[tokens.final], minlength=count) > 0
        end[-1] |= not tokens.sizes.all()
        self.lengths = np.fromiter(map(len, words), np.int64, count)
        self.begin = segment_starts(self.lengths + 2)
        data = np.frombuffer(b"".join((b" \0".join(words), b" \0")), np.uint8)
        pairs, is_met = np.empty(len(data), np.uint64), np.ones(len(data), bool)
        is_met[self.begin[1:] - 2], is_met[self.begin[1:] - 1] = blank, end
        cuts = np.unique(np.searchsorted(self.begin, np.arange(0, len(data), HASHED))).tolist()
        for a, b in zip(cuts, [*cuts[1:], count], strict=True):
            a, b = int(self.begin[a]), int(self.begin[b])
            pairs[a:b] = paired(word_so_far(data[a:b]), data[a:b], width)
        pairs[self.begin[1:] - 1] = pairs[self.begin[1:] - 2] & ~np.uint64(255)
        pairs = pairs[is_met]
        keys = np.sort(pairs)
        self.keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
        self.places = np.zeros(len(data), np.int32)
        self.places[is_met] = Finder(self.keys).places(pairs) + 1

    def ordered(self) -> tuple[np.ndarray, np.ndarray]:
        return self.keys, np.arange(len(self.keys) + 1)

    def counts(self, learned: np.ndarray, empty: int) -> np.ndarray:
        """How often learning texts have each pair: the tokens of ``learned``, and so many empty texts."""
        t, count = self.tokens, len(self.lengths)
        met = np.bincount(t.numbers[learned], minlength=count)
        ends = np.bincount(t.numbers[learned & t.final], minlength=count)
        times = np.repeat(met, self.lengths + 2)
        times[self.begin[1:] - 2] = met - ends
        ends[-1] += empty
        times[self.begin[1:] - 1] = ends
        return np.bincount(self.places, times, len(self.keys) + 1)[1:].astype(np.int64)  # whole numbers far below 2^53

    def of_bytes(self, out: np.ndarray) -> None:
        """The place of each byte of the texts, ends included."""
        t = self.tokens
        numbers, final, sizes = t.numbers, t.final, t.sizes
        if not sizes.all():  # an empty text gets an empty word
            at = segment_starts(sizes)[:-1][sizes == 0]
            numbers, final = np.insert(numbers, at, len(self.lengths) - 1), np.insert(final, at, True)
        to = 0
        for a in range(0, len(numbers), HASHED):
            own, last = numbers[a : a + HASHED], final[a : a + HASHED]
            sizes = self.lengths[own] + 1
            begin = segment_starts(sizes)
            at = np.arange(begin[-1])
            at += np.repeat(self.begin[own] - begin[:-1], sizes)
            at[begin[1:][last] - 1] += 1
            self.places.take(at, out=out[to : to + len(at)], mode="clip")
            to += len(at)


def block_places(texts: list[bytes], width: int, tokens: Tokens | None = None) -> tuple[list[Chained | WordPlaces], list[np.ndarray]]:
    """For each context the block's pairs, and the place of each byte's, ends included; one more stands past the end."""
    chains = Chains(texts, width)
    places = [np.zeros(sum(len(t) + 1 for t in texts) + 1, np.int32) for _ in (*ORDERS, "word")]
    at = 0
    for a, b in groups(texts, HASHED):
        stream = Stream(texts[a:b])
        to = at + int(stream.sizes.sum())
        for out, x in zip(places, chains.of(stream), strict=False):
            out[at:to] = x
        at = to
    by_word = WordPlaces(tokens or Tokens(texts), width)
    by_word.of_bytes(places[-1][:-1])
    return [*(chains.known[order] for order in ORDERS), by_word], places


def block_pairs(texts: list[bytes], train: np.ndarray, width: int, tokens: Tokens | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each context the block's distinct pairs in order, and how often learning texts have each (perhaps never)."""
    chains = Chains(texts, width)
    totals = [np.zeros(1, np.int64) for _ in ORDERS]
    for a, b in groups(texts, COUNTED):
        met: list[list] = [[] for _ in ORDERS]
        for c, d in groups(texts[a:b], HASHED):
            stream = Stream(texts[a + c : a + d])
            learned = np.repeat(train[a + c : a + d], stream.sizes)
            for parts, x in zip(met, chains.of(stream), strict=True):
                parts.append(x[learned])
        for k, parts in enumerate(met):
            counts = np.bincount(np.concatenate(parts), minlength=len(totals[k]))
            counts[: len(totals[k])] += totals[k]
            totals[k] = counts
    tokens, out = tokens or Tokens(texts), []
    for order, counts in zip(ORDERS, totals, strict=True):
        keys = chains.known[order].keys
        out.append(summed(keys, np.append(counts, np.zeros(len(keys) + 1 - len(counts), np.int64))[1:]))
    by_word = WordPlaces(tokens, width)
    return [*out, (by_word.keys, by_word.counts(np.repeat(train, tokens.sizes), int((train & (tokens.sizes == 0)).sum())))]


def ranges_of(keys: np.ndarray, width: int, ranges: int) -> np.ndarray:
    """The hash range of each pair; all pairs of a context share one, and ranges follow the pairs' order."""
    return (keys >> np.uint64(width + 8 - 32)) * np.uint64(ranges) >> np.uint64(32)  # by the context's first 32 bits


def planes(x: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of all of them, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def unplanes(data: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(flat.T).view(kind).ravel()


def leanings(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each pair the log odds of a mistake in each bit of its byte, after the bits before; ``keys`` are distinct and in order."""
    totals = []
    for bits in range(9):
        prefix = keys >> np.uint64(8 - bits)
        new = np.append(True, prefix[1:] != prefix[:-1])
        totals.append(np.add.reduceat(counts, np.flatnonzero(new))[np.cumsum(new) - 1].astype(float))
    out = np.empty((len(keys), 8), np.int8)
    for bit, (both, own) in enumerate(zip(totals, totals[1:], strict=False)):
        out[:, bit] = np.clip(np.rint(np.log((both - own + PRIOR) / (own + PRIOR)) * SCALE), -127, 127)
    return out


def _said(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bits of each pair's byte stand after what the pair before has, too, so that its leaning tells this one's; and 1 or -1 by bit."""
    other = np.append(~np.uint64(0), keys[1:] ^ keys[:-1])[: len(keys)]
    said = np.stack([other >> np.uint64(8 - bit) == 0 for bit in range(8)], axis=1)
    return said, (np.unpackbits((keys & np.uint64(255)).astype(np.uint8)[:, None], axis=1).view(np.int8) * 2 - 1).astype(np.int8)


def _alone(said: np.ndarray) -> np.ndarray:
    """Which bits, from the second on, stand after one that is not said either: with one byte seen there, both lean alike."""
    return ~(said[:, 1:] | said[:, :-1])


def brief(keys: np.ndarray, lean: np.ndarray) -> bytes:
    """Leanings of pairs in order, without what the pair before or the bit before says already: which bits differ, and by how much."""
    said, sign = _said(keys)
    one = lean * sign  # the bit's log odds, not those of a mistake
    one[1:] -= one[:-1] * said[1:]
    one *= sign
    one[:, 1:] -= one[:, :-1] * _alone(said)
    which = one != 0
    bits = zstandard.compress(np.packbits(which, axis=1).tobytes(), 1)
    return len(bits).to_bytes(4, "little") + bits + zstandard.compress(one[which].tobytes(), 1)


def unbrief(keys: np.ndarray, data: bytes) -> np.ndarray:
    said, sign = _said(keys)
    cut = 4 + int.from_bytes(data[:4], "little")
    which = np.unpackbits(np.frombuffer(zstandard.decompress(data[4:cut]), np.uint8)[:, None], axis=1).view(bool)
    step = np.zeros((len(keys), 8), np.int8)
    step[which] = np.frombuffer(zstandard.decompress(data[cut:]), np.int8)
    step, said, sign = (np.ascontiguousarray(x.T) for x in (step, said, sign))
    out = np.empty((len(keys), 8), np.int8)
    for bit in range(8):
        if bit:
            step[bit] += step[bit - 1] * ~(said[bit] | said[bit - 1])
        one = step[bit] * sign[bit]
        sums, start = np.cumsum(one, dtype=np.int8), np.flatnonzero(~said[bit])  # sums go round modulo 256, as int8 does
        sums -= np.repeat(sums[start] - one[start], np.diff(start, append=len(keys)))
        out[:, bit] = sums * sign[bit]
    return out.view(np.uint64).ravel()


def vocabulary(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words of canonical texts, in order of first use, each token's number, and each text's tokens."""
    tokens = Tokens(texts)
    return tokens.hashes(), tokens.numbers, tokens.sizes


BLOCKS = "block long, doc_ids array<long>, train array<boolean>, sizes binary, texts binary, part int, slots binary, counts binary, kind int"
NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
KINDS = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
TEXTS, WORDS, PAIRS = 0, 1, 2  # and from PAIRS on, one kind for each context


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _row(**cells) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([cells.get(n)], k) for n, k in zip(NAMES, KINDS, strict=True)], NAMES)


def _packed(x: np.ndarray) -> bytes:
    return planes(np.ascontiguousarray(x.T).ravel())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    """A block's own counts are uint32, the corpus's int64."""
    return unplanes(data, kind).reshape(KINDS_OF_TEXT, -1).T


def _count(batches: Iterator[pa.RecordBatch], ranges: int, width: int) -> Iterator[pa.RecordBatch]:
    """Blocks of texts; their words' hashes and their pairs, each with learning counts, by hash range."""
    task, number = TaskContext.get().partitionId(), 0
    for batch in chunks(batches, "text", BLOCK):
        texts = canonicals(batch.column("text"))
        train = np.asarray(batch.column("train"), bool)
        ids = batch.column("doc_id").to_pylist()
        tokens = Tokens(texts)
        hashes, numbers, lengths = tokens.hashes(), tokens.numbers, tokens.sizes
        learned = np.repeat(train, lengths)
        own = np.repeat(batch.column("kind").to_numpy(), lengths)[learned]
        counts = np.bincount(numbers[learned] * KINDS_OF_TEXT + own, minlength=len(hashes) * KINDS_OF_TEXT).astype(np.uint32).reshape(-1, KINDS_OF_TEXT)
        block, number = task << 32 | number, number + 1  # what is written is read by all, so the name stays the block's
        lengths = np.array([len(t) for t in texts], np.int64)
        yield _row(kind=TEXTS, block=block, doc_ids=ids, train=train.tolist(), sizes=lengths.tobytes(), texts=zstandard.compress(b"".join(texts), CLOSE))
        order = np.argsort(hashes, kind="stable")
        cuts = np.searchsorted((hashes[order] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))
        for r in range(ranges):
            pick = order[cuts[r] : cuts[r + 1]]
            if len(pick):
                yield _row(kind=WORDS, block=block, part=r, slots=planes(np.diff(hashes[pick], prepend=np.uint64(0))), counts=_packed(counts[pick]))
        for k, (keys, counts) in enumerate(block_pairs(texts, train, width, tokens)):
            where = ranges_of(keys, width, ranges)
            cuts = np.append(np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(keys) else [], len(keys)).astype(int).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                gaps = np.diff(keys[a:b], prepend=np.uint64(0))
                yield _row(kind=PAIRS + k, block=block, part=int(where[a]), slots=planes(gaps), counts=planes(counts[a:b]))


BACK = "block long, part int, counts binary, tokens array<long>, types long"
LEAN = "block long, kind int, part int, counts binary"


def _lean(batches: Iterator[pa.RecordBatch], short: bool = False) -> Iterator[pa.RecordBatch]:
    """What the corpus's counts say of each block's pairs, a hash range of a context at a time; rows come ordered by both.

    ``short``: as ``brief`` gives them.
    """
    rows: list[tuple] = []

    def done() -> pa.RecordBatch:
        keys = [np.cumsum(unplanes(r[3], np.uint64), dtype=np.uint64) for r in rows]
        names, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(names), np.int64)
        cuts = segment_starts(np.array([len(k) for k in keys])).tolist()
        for r, a, b in zip(rows, cuts, cuts[1:], strict=False):
            total[which[a:b]] += unplanes(r[4], np.int64)  # a block's pairs are distinct
        lean = leanings(names, total)
        back = [brief(k, lean[which[a:b]]) if short else planes(lean[which[a:b]]) for k, a, b in zip(keys, cuts, cuts[1:], strict=False)]
        cells = [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array(back, pa.binary())]
        return pa.RecordBatch.from_arrays(cells, ["block", "kind", "part", "counts"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "part", "slots", "counts")), strict=True):
            if rows and row[1:3] != rows[0][1:3]:
                yield done()
                rows = []
            rows.append(row)
    if rows:
        yield done()


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their words' hashes in place of the gaps between them."""
    for batch in batches:
        hashes = [np.cumsum(unplanes(x, np.uint64), dtype=np.uint64).tobytes() for x in batch.column("slots").to_pylist()]
        yield batch.set_column(batch.schema.get_field_index("slots"), "slots", pa.array(hashes, pa.binary()))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corpus counts of each block's words, a hash range at a time; rows come ordered by range."""
    rows: list[tuple] = []

    def done() -> pa.RecordBatch:
        hashes = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
        names, which = np.unique(hashes, return_inverse=True)
        total = np.zeros((len(names), KINDS_OF_TEXT), np.int64)
        cuts = segment_starts(np.array([len(r[2]) // 8 for r in rows]))
        for r, a, b in zip(rows, cuts, cuts[1:], strict=False):
            total[which[a:b]] += _unpacked(r[3], np.uint32)  # a block's words are distinct
        back = [_packed(total[which[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]
        tokens = [total.sum(axis=0, dtype=np.int64).tolist()] + [[0] * KINDS_OF_TEXT] * (len(rows) - 1)
        types = [int(total.any(axis=1).sum())] + [0] * (len(rows) - 1)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array(back, pa.binary()), pa.array(tokens, pa.list_(pa.int64())), pa.array(types, pa.int64())], ["block", "part", "counts", "tokens", "types"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "slots", "counts")), strict=True):
            if rows and row[1] != rows[0][1]:
                yield done()
                rows = []
            rows.append(row)
    if rows:
        yield done()


class Finder:
    """Places of pairs among a block's distinct ones: a table by hash, and a search for those that share its slots."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(10, len(keys).bit_length() + 3))
        self.table = np.zeros(1 << 64 - int(self.shift), np.int32)
        slots, every = (keys * ODD >> self.shift).astype(np.int64), np.arange(len(keys), dtype=np.int32)
        self.table[slots] = every
        self.table[slots[self.table[slots] != every]] = -1
        self.rest_at = np.flatnonzero(self.table[slots] < 0).astype(np.int32)
        self.rest = keys[self.rest_at]

    def places(self, pairs: np.ndarray) -> np.ndarray:
        out = self.table.take((pairs * ODD >> self.shift).view(np.int64))
        shared = np.flatnonzero(out < 0)
        out[shared] = self.rest_at[np.searchsorted(self.rest, pairs[shared])]
        return out


def steps(size: int) -> Iterator[tuple[int, int]]:
    """From where to where weights stay: 1, 1, 2, 4 ... bytes, and then ``STEP`` at a time."""
    at, more = 0, 1
    while at < size:
        yield at, at + more
        at += more
        more = min(STEP, at)


def mix(sizes: np.ndarray, ways: list[np.ndarray], start: float = START, rate: float = RATE, places: list[np.ndarray] | None = None) -> np.ndarray:
    """Natural log-probability of each byte of texts of so many bytes, laid end to end.

    ``ways`` has each context's leanings, and after the last byte's one more row of zeros, which stands past a text's end; or
    ``places`` says where in ``ways`` each byte's row is, and some row for past the end, which moves no text's weights.
    """
    total = int(sizes.sum())
    order, starts = np.argsort(-sizes, kind="stable"), segment_starts(sizes)
    ways = [w.view(np.uint64).ravel() for w in ways]
    down = np.float32(-rate / SCALE / SCALE)
    out = np.empty(total + 1)
    room = [np.empty(8 * STEP * min(SIDE, len(sizes)), np.float32) for _ in range(len(ways) + 2)]
    for first in range(0, len(order), SIDE):
        own = order[first : first + SIDE]
        begin, length = starts[own], sizes[own]
        weights = [np.full(8 * len(own), start / SCALE, np.float32) for _ in ways]  # along the log odds of a mistake
        for a, b in steps(int(length[0])):
            n = int(np.searchsorted(-length, -a, side="left"))  # texts that are longer than a
            at = np.arange(a, b)[:, None] + begin[:n]  # the texts' bytes lie side by side
            if length[n - 1] < b:
                at[np.arange(a, b)[:, None] >= length[:n]] = total
            *inputs, d, m = (x[: 8 * n * (b - a)].reshape(b - a, 8 * n) for x in room)
            for k, (x, w) in enumerate(zip(inputs, ways, strict=True)):
                x[:] = w.take(at if places is None else places[k].take(at)).view(np.int8).reshape(x.shape)
            np.multiply(inputs[0], weights[0][: 8 * n], out=d)
            for x, w in zip(inputs[1:], weights[1:], strict=True):
                d += np.multiply(x, w[: 8 * n], out=m)
            np.clip(d, -SURE, SURE, out=d)
            np.exp(d, out=d)
            np.add(d, 1, out=m)
            d /= m
            d *= down
            while m.shape[1] > n:  # the product of each byte's eight
                m = m[:, ::2] * m[:, 1::2]
            out[at] = -np.log(m)
            for x, w in zip(inputs, weights, strict=True):
                x *= d
                w[: 8 * n] += x.sum(axis=0)
    return out[:-1]


def chances(counts: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words' probabilities by kind from their counts, the logarithms of these as ``TRUST`` weighs them, and which words have counts."""
    whole = counts.sum(axis=1, keepdims=True) / max(1, tokens.sum())
    each = OWN * counts / np.maximum(tokens, 1) + (1 - OWN) * whole
    known = whole[:, 0] > 0
    return each, TRUST * np.where(known[:, None], np.log(np.where(known[:, None], each, 1)), 0), known


def explained(counts: np.ndarray, tokens: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Natural log-probability of each word from its counts by kind, the kind inferred from the text's words before.

    ``tokens`` are all words' counts by kind, ``begin`` as in ``refined``; a word without counts has none (-inf).
    """
    return inferred(*chances(counts, tokens), tokens, begin)


def inferred(each: np.ndarray, logs: np.ndarray, known: np.ndarray, tokens: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """``explained`` of words whose ``chances`` are known."""
    if not len(logs):
        return np.empty(0)
    logs, each = np.ascontiguousarray(logs.T), np.ascontiguousarray(each.T)  # kinds lie one after the other
    before = np.zeros_like(logs)
    np.cumsum(logs[:, :-1], axis=1, out=before[:, 1:])
    before -= np.repeat(before.take(begin[:-1][np.diff(begin) > 0], axis=1), np.diff(begin)[np.diff(begin) > 0], axis=1)
    with np.errstate(divide="ignore"):
        before += np.log(tokens / max(1, tokens.sum()))[:, None]
        before -= before.max(axis=0)
        part = np.exp(before, out=before)
        each *= part
        return np.where(known, np.log(_over_kinds(each) / np.maximum(_over_kinds(part), 1e-300)), -np.inf)


def _over_kinds(x: np.ndarray) -> np.ndarray:
    """The sum of each column, two and two, as numpy adds eight numbers that lie side by side."""
    while len(x) > 1:
        x = x[::2] + x[1::2]
    return x[0]


def refined(mixed: np.ndarray, counted: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Natural log-probability of each token from the mixer's and the counts', with weights from the text's tokens before.

    ``begin`` has where each text's tokens begin, and the end of all.
    """
    share = 1 / (1 + np.exp(np.clip(mixed - counted, -40, 40)))  # of the token that the counts explain
    sums = np.concatenate(([0], np.cumsum(share)))[:-1]
    sizes = np.diff(begin)
    first = np.repeat(begin[:-1], sizes)
    weight = (HABIT / 2 + sums - sums[first]) / (HABIT + np.arange(len(share)) - first) if len(share) else share
    weight = np.clip(weight, 0.02, 0.98)
    return np.logaddexp(np.log(weight) + counted, np.log1p(-weight) + mixed)


RESULT = "doc_id long, train boolean, n_tokens long, n_known long, known_sum double, score double, bits_per_byte double"


def _texts_scores(texts: list[bytes], counted: np.ndarray, sizes: np.ndarray, last: float, leans: list[np.ndarray], places: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of each text; ``counted`` has its words' by their counts, ``last`` the end's;
    ``leans`` has the leanings by place, and ``places`` each byte's place and one more.

    A token is a word with the blank or the end after it; a text without words is its end.
    """
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    logs = mix(lengths, leans, places=places)
    ends = np.concatenate([np.frombuffer(t + b"\0", np.uint8) for t in texts])
    bounds = np.flatnonzero((ends == 32) | (ends == 0)) if b"\0" not in b"".join(texts) else _bounds(texts)
    mixed = np.add.reduceat(logs, np.append(0, bounds[:-1] + 1))
    tokens = np.maximum(sizes, 1)
    begin = segment_starts(tokens)
    own = np.zeros(len(mixed))
    own[np.repeat(sizes > 0, tokens)] = counted
    own[begin[1:] - 1] += last
    out = refined(mixed, np.maximum(own, -1e4), begin)
    return np.add.reduceat(out, begin[:-1])


def _bounds(texts: list[bytes]) -> np.ndarray:
    """Where tokens end, in texts that hold zero bytes."""
    out, at = [], 0
    for t in texts:
        data = np.frombuffer(t, np.uint8)
        out += [np.flatnonzero(data == 32) + at, [at + len(t)]]
        at += len(t) + 1
    return np.concatenate(out).astype(np.int64)


def _block_scores(row: dict, width: int, kinds: list[int], ends: int) -> pa.RecordBatch:
    cuts = segment_starts(np.frombuffer(row["sizes"], np.int64)).tolist()
    data = zstandard.decompress(row["texts"])
    texts = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    tokens = Tokens(texts)
    ids, sizes = tokens.numbers, tokens.sizes
    order = np.argsort(tokens.hashes(), kind="stable")
    by_kind = np.zeros((len(order), KINDS_OF_TEXT), np.int64)
    back: list[list[bytes]] = [[] for _ in range(PAIRS + len(ORDERS) + 1)]
    for x in sorted(row["back"], key=lambda x: x["part"]):
        back[x["kind"]].append(x["counts"])
    if back[WORDS]:
        by_kind[order] = np.concatenate([_unpacked(x, np.int64) for x in back[WORDS]])
    met, places = block_places(texts, width, tokens)
    del tokens
    leans = []
    for own in back[PAIRS:]:
        keys, which = met.pop(0).ordered()
        cuts = np.append(np.flatnonzero(np.diff(ranges_of(keys, width, row["ranges"]), prepend=np.uint64((1 << 64) - 1))), len(keys)).tolist()
        lean = [np.zeros(1, np.uint64), *(unbrief(keys[a:b], x) for a, b, x in zip(cuts, cuts[1:], own, strict=False))]
        leans.append(np.concatenate(lean)[which])
    first = segment_starts(np.array([len(t) + 1 for t in texts], np.int64))
    counts = by_kind.sum(axis=1, dtype=np.int64)
    begin = segment_starts(sizes)
    own = np.append(np.log10(counts + 1.0)[ids], 0)
    known = np.append((counts > 0)[ids], False)
    sums = [np.concatenate(([0], np.cumsum(v)))[begin] for v in (known.astype(np.int64),)][0]
    logs = np.array([own[a:b].sum() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)])
    score = np.zeros(len(texts))
    every = np.array(kinds, float)
    last = np.log(ends / (ends + every.sum())) if ends else -1e4  # a text's end, and that it is none
    more = np.log(every.sum() / (ends + every.sum())) if every.any() else -1e4
    words = [np.concatenate(x) for x in zip(*(chances(by_kind[a : a + HASHED].astype(float), every) for a in range(0, max(1, len(by_kind)), HASHED)), strict=True)]
    del by_kind
    for at, to in groups(texts, SCORED):
        spans = [(begin[at + a : at + b + 1], ids[begin[at + a] : begin[at + b]]) for a, b in groups(texts[at:to], HASHED)]
        counted = np.concatenate([inferred(*(x.take(own, axis=0) for x in words), every, span - span[0]) for span, own in spans]) + more
        score[at:to] = _texts_scores(texts[at:to], counted, sizes[at:to], last, leans, [p[first[at] : first[to] + 1] for p in places]) / np.log(10)
    length = np.array([len(t) + 1 for t in texts])
    return pa.RecordBatch.from_arrays([
        pa.array(row["doc_ids"], pa.int64()), pa.array(row["train"], pa.bool_()), pa.array(sizes + 1), pa.array(np.diff(sums)), pa.array(logs), pa.array(score), pa.array(-score * np.log2(10) / length),
    ], [x.split()[0] for x in RESULT.split(", ")])


def _score(batches: Iterator[pa.RecordBatch], width: int, kinds: list[int], ends: int) -> Iterator[pa.RecordBatch]:
    for batch in tidy(batches):
        for k in range(batch.num_rows):  # one block at a time is unpacked
            yield _block_scores(batch.slice(k, 1).to_pylist()[0], width, kinds, ends)
            give_back()


def score(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` for each row of ``docs``.

    Held out, and not learned from, are ids whose crc32 as text leaves ``held`` modulo ``modulus``; a null doc_id counts
    as the text ''.  A null text is empty: one token, its end.  Without learning texts counts are 0 and predictions even.
    Repeated rows count each time; of other columns of ``docs`` only learning texts' ``lang``, if there is one, plays a part
    (null is a language of its own).  ``bits_per_byte`` is the score's bits for each
    byte of the text's tokens as they are scored, the end's included.  An empty table gives an empty result.
    """
    kind = F.pmod(F.crc32(F.coalesce(F.col("lang").cast("string"), F.lit("")).cast("binary")), F.lit(KINDS_OF_TEXT)).cast("int") if "lang" in docs.columns else F.lit(0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", kind.alias("kind"), (id_remainder(F.col("doc_id"), modulus) != held).alias("train"))
    known = rows.agg(F.count_if("train").alias("ends"), F.sum(F.octet_length("text")).alias("bytes")).first()  # one end for each learning text
    ends, ranges = known.ends, max(64, -(-(known.bytes or 0) // RANGE))
    width, homes = width_for(known.bytes or 0), min(ranges, MOST_BUCKETS)
    counted = bucketed(rows.mapInArrow(lambda it: _count(it, ranges, width), BLOCKS), "lm-counts", homes, "block")  # texts stay where they are
    pairs = counted.where(F.col("kind") >= PAIRS).select("block", "kind", "part", "slots", "counts").repartition("kind", "part").sortWithinPartitions("kind", "part")
    words = counted.where(F.col("kind") == WORDS).select("block", "part", "slots", "counts").repartition("part").sortWithinPartitions("part")
    back = stored(words.mapInArrow(lambda it: _meet(_opened(it)), BACK), "lm-words")
    sums = back.agg(*(F.coalesce(F.sum(F.col("tokens")[k]), F.lit(0)).alias(f"n{k}") for k in range(KINDS_OF_TEXT)), F.coalesce(F.sum("types"), F.lit(0)).alias("v")).first()
    kinds = list(sums)[:KINDS_OF_TEXT]
    total, types = sum(kinds) + ends, sums.v + (ends > 0)
    met = back.select("block", F.lit(WORDS).alias("kind"), "part", "counts").unionByName(pairs.mapInArrow(lambda it: _lean(it, short=True), LEAN))
    lists = met.repartition(homes, "block").groupBy("block").agg(F.collect_list(F.struct("kind", "part", "counts")).alias("back"))  # one entry for each hash range
    blocks = counted.where(F.col("kind") == TEXTS).select("block", "doc_ids", "train", "sizes", "texts", F.lit(ranges).alias("ranges"))
    scored = blocks.join(lists.hint("merge"), "block", "left").select("doc_ids", "train", "sizes", "texts", "ranges", "back").mapInArrow(lambda it: _score(it, width, kinds, ends), RESULT)
    bottom = F.log10(F.lit(float(total + types + 1)))
    end = F.log10(F.lit(float(ends + 1)))
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + (1 if ends else 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("known_sum") + end - F.col("n_tokens") * bottom).alias("base_score"), "score", "bits_per_byte",
    )
