"""Suffix-array dedup: deep-shallow sorting of the suffixes that can repeat.

A byte goes if a string of ``SPAN`` bytes over it also starts anywhere else.  Which strings can repeat is narrowed first:
of the grams of ``GRAMS[0]`` bytes inside each string, the one with the smallest hash is its anchor, so equal strings have
equal anchors at equal places.  Strings whose anchor gram occurs once cannot repeat.  The others travel by their gram: a
run of neighbouring strings with one anchor is one segment, and equal segments of one task are one row with a count.

A task sorts the suffixes of its segments: multikey quicksort by 8-byte words down to ``SHALLOW`` bytes, then blind tries
for the groups that still agree.  Neighbours in that order that share ``SPAN`` bytes are repeats.

A gram with more than ``HOT`` different segments (counted once for each piece of text) does not go to one task: its strings get anchors of the next, longer gram
length instead, up to the whole string, of which equal ones are one row for each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import chunks, mixed, segment_starts, stored, texts_of, tidy

SPAN = 200
GRAMS = (56, 184, SPAN)
HOT = 32768
SHALLOW = 32
#: Bytes of segments that one sort takes, unless a gram's own are more.
SORT_BYTES = 6 << 20
#: Bytes of text that are hashed at once.
PIECE = 1 << 19

BASE, BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
SALT = mixed(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


class Texts:
    """Texts end to end, with hashes of any of their substrings."""

    def __init__(self, texts: list[bytes]):
        self.bounds = segment_starts(np.array([len(t) for t in texts], np.int64))
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        power, self.inverse = powers(len(self.bytes) + 1)
        self.sums = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum((self.bytes + np.uint64(1)) * power[:-1], out=self.sums[1:])

    def hashes(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]

    def anchors(self, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each anchor in order: text, place, first and last start of the strings it is the anchor of, gram hash."""
        n, width = len(self.bytes), SPAN - gram + 1
        none = np.empty(0, np.int64)
        if n < SPAN:
            return none, none, none, none, none.view(np.uint64)
        grams = mixed((self.sums[gram:] - self.sums[:-gram]) * self.inverse[: n + 1 - gram])
        places = len(grams)
        bits = np.uint64(max(1, int(places).bit_length()))
        # High bits of the hash, then the place: the smallest is the leftmost of the least, wherever the text lies.
        value = grams >> bits << bits | np.arange(places, dtype=np.uint64)
        rows = -(-places // width)
        wide = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
        wide[:places] = value
        wide = wide.reshape(rows, width)
        before = np.minimum.accumulate(wide, axis=1).ravel()
        after = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - SPAN + 1
        place = (np.minimum(after[:starts], before[width - 1 : width - 1 + starts]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))[:starts]
        inside = np.arange(starts) + SPAN <= self.bounds[1:][text]
        first = np.empty(starts, bool)
        first[0] = True
        first[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
        heads = np.flatnonzero(first & inside)
        # A run ends where the next one begins or its text's last whole string does.
        nexts = np.append(np.flatnonzero(first)[1:], starts)[np.cumsum(first)[heads] - 1] if len(heads) else heads
        last = np.minimum(nexts - 1, self.bounds[1:][text[heads]] - SPAN)
        return text[heads], place[heads], heads, last, grams[place[heads]]


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text, offset, bytes) of about ``PIECE`` bytes; a longer text is cut so that each start is in one piece."""
    group: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - SPAN + 1), PIECE):
            piece = text[at : at + PIECE + SPAN - 1]
            if len(piece) < SPAN:
                continue
            if size and size + len(piece) > PIECE:
                yield group
                group, size = [], 0
            group.append((i, at, piece))
            size += len(piece)
    if group:
        yield group


def _anchored(texts: list[bytes], gram: int) -> Iterator[tuple[Texts, np.ndarray, ...]]:
    """For groups of pieces: the group, and for each anchor its text, ordinal in it, place, first and last start in the group, offset of the piece in the text, gram hash."""
    seen = np.zeros(len(texts), np.int64)
    for group in _pieces(texts):
        part = Texts([x[2] for x in group])
        piece, place, first, last, hashes = part.anchors(gram)
        text = np.array([x[0] for x in group], np.int64)[piece]
        ordinal = np.arange(len(text)) - np.searchsorted(text, text) + seen[text]
        seen += np.bincount(text, minlength=len(texts))
        yield part, text, ordinal, place, first, last, (np.array([x[1] for x in group], np.int64) - part.bounds[:-1])[piece], hashes


def _chosen(column: pa.Array) -> np.ndarray:
    """Sorted (text, ordinal) pairs as one number each."""
    ordinals = np.asarray(column.flatten(), np.int64)
    lengths = np.diff(np.asarray(column.offsets, np.int64))
    return np.unique(np.repeat(np.arange(len(column)), lengths) << 32 | ordinals)


def _among(sorted_: np.ndarray, text: np.ndarray, ordinal: np.ndarray) -> np.ndarray:
    code = text << 32 | ordinal
    at = np.minimum(np.searchsorted(sorted_, code), max(0, len(sorted_) - 1))
    return sorted_[at] == code if len(sorted_) else np.zeros(len(code), bool)


ANCHOR = "key long, gram long, ordinal int"


GRAM = "gram long, n int"


def _segment_ids(part: Texts, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    whole = last - first + SPAN
    return mixed(part.hashes(first, whole) + whole.astype(np.uint64) * SALT[0] + (place - first).astype(np.uint64) * SALT[1])


def _anchors(batches: Iterator[pa.RecordBatch], gram: int, held: bool, counts: bool) -> Iterator[pa.RecordBatch]:
    """Anchors of each text; with ``held`` only those of strings that also have an anchor listed in column ``hot``.

    With ``counts``, grams and how often they occur instead: one row for each different segment of a piece.
    """
    for batch in chunks(batches, "text"):
        texts = texts_of(batch.column("text"))
        keys = batch.column("key").to_numpy()
        hot = _chosen(batch.column("hot")) if held else None
        coarse = _anchored(texts, GRAMS[0]) if held else None
        for fine, text, ordinal, place, first, last, _, hashes in _anchored(texts, gram):
            if held:
                part, t, o, _, a, b, _, _ = next(coarse)
                pick = _among(hot, t, o)
                marked = np.zeros(len(part.bytes) + 2, np.int64)
                np.add.at(marked, a[pick], 1)
                np.add.at(marked, b[pick] + 1, -1)
                sums = np.concatenate(([0], np.cumsum(np.cumsum(marked) > 0)))
                keep = sums[last + 1] > sums[first]
                text, ordinal, hashes, place, first, last = (x[keep] for x in (text, ordinal, hashes, place, first, last))
            if counts:
                _, at, n = np.unique(_segment_ids(fine, place, first, last), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(n.astype(np.int32))], ["gram", "n"])
                continue
            yield pa.RecordBatch.from_arrays([pa.array(keys[text]), pa.array(hashes.view(np.int64)), pa.array(ordinal.astype(np.int32))], ["key", "gram", "ordinal"])


SEGMENT = "gram long, segment long, starts int, bytes binary, copies long, key long, start int"


def _segments(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[pa.RecordBatch]:
    """Where each segment lies (``key, start``), and the segments themselves, each once for each task and flush."""
    names = [x.split()[0] for x in SEGMENT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
    held: dict[int, list] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows = [[*v, None, None] for v in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in chunks(batches, "text"):
        values = batch.column("key").to_numpy()
        heads = np.flatnonzero(np.append(True, values[1:] != values[:-1]))  # neighbouring rows with one text
        times = np.diff(np.append(heads, len(values)))
        part = pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(heads)) for c in ("key", "text", "ordinals")], ["key", "text", "ordinals"])
        keys, chosen = part.column("key").to_numpy(), _chosen(part.column("ordinals"))
        for group, text, ordinal, place, first, last, offset, hashes in _anchored(texts_of(part.column("text")), gram):
            pick = _among(chosen, text, ordinal)
            text, place, first, last, offset, hashes = (x[pick] for x in (text, place, first, last, offset, hashes))
            if not len(text):
                continue
            whole = last - first + SPAN
            ids = _segment_ids(group, place, first, last).view(np.int64)
            data = group.bytes.tobytes()
            for s, g, a, w, c in zip(ids.tolist(), hashes.view(np.int64).tolist(), first.tolist(), whole.tolist(), times[text].tolist(), strict=True):
                if s in held:
                    held[s][4] += c
                else:
                    held[s] = [g, s, w - SPAN + 1, data[a : a + w], c]
                    size += w
            empty = [pa.nulls(len(text), k) for k in (pa.int64(), pa.int32(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([empty[0], pa.array(ids), *empty[1:], pa.array(keys[text]), pa.array((first + offset).astype(np.int32))], names)
            if size > 2 * SORT_BYTES:
                yield flush()
                held, size = {}, 0
    if held:
        yield flush()


def blind_trie(data: bytes, starts: list[int], depth: int, limit: int) -> list[tuple[int, int]]:
    """Suffixes in order, each with the length of what it shares with the one before, up to ``limit``.

    An inner node keeps only the place at which its branches differ and their bytes.  A new suffix goes down blindly to
    some leaf, one comparison with it gives the true place, and the branch is put there.
    """
    leaf = lambda s: [limit, {}, [s]]
    root = leaf(starts[0])
    for s in starts[1:]:
        node = root
        while node[0] < limit:
            node = node[1].get(data[s + node[0]]) or next(iter(node[1].values()))
        other = node[2][0]
        k = depth
        while k < limit and data[s + k : s + k + 16] == data[other + k : other + k + 16]:
            k += 16
        while k < limit and data[s + k] == data[other + k]:
            k += 1
        k = min(k, limit)
        if k == limit:
            node[2].append(s)
            continue
        above, node = None, root
        while node[0] < k:
            above, node = node, node[1][data[s + node[0]]]
        if node[0] == k:
            node[1][data[s + k]] = leaf(s)
            continue
        branch = [k, {data[other + k]: node, data[s + k]: leaf(s)}, []]
        if above is None:
            root = branch
        else:
            above[1][data[s + above[0]]] = branch
    out: list[tuple[int, int]] = []
    stack: list[tuple[list, int]] = [(root, depth)]
    while stack:
        (place, branches, found), shared = stack.pop()
        if place == limit:
            out += [(s, limit if i else shared) for i, s in enumerate(found)]
        else:
            below = [branches[b] for b in sorted(branches)]
            stack += [(x, place if i else shared) for i, x in reversed(list(enumerate(below)))]
    return out


def sort_suffixes(data: np.ndarray, starts: np.ndarray, limit: int = SPAN, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The starts in order of the ``limit`` bytes after them, and whether each shares all of them with the one before.

    ``data`` needs 8 more bytes after the last string.
    """
    words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,)).astype(np.uint64)
    order = np.array(starts, np.int64)
    rank = np.argsort(words[order])
    order = order[rank]
    key = words[order]
    same = np.zeros(len(order), bool)
    head = np.append(True, key[1:] != key[:-1])  # where a group of equal prefixes begins

    def members(head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in groups of two or more, and their group's number."""
        sizes = np.diff(np.append(np.flatnonzero(head), len(head)))
        many = np.repeat(sizes > 1, sizes)
        return np.flatnonzero(many), np.repeat(np.arange((sizes > 1).sum()), sizes[sizes > 1])

    for depth in range(8, shallow, 8):  # multikey quicksort, a word of 8 bytes at a time
        at, group = members(head)
        if not len(at):
            break
        key = words[order[at] + depth]
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        uneven = np.add.reduceat(key != key[begin][group], begin) > 0
        pick = uneven[group]
        if pick.any():
            where = at[pick]
            rank = np.lexsort((key[pick], group[pick]))
            order[where] = order[where][rank]
            key[pick] = key[pick][rank]
        new = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
        head[at[new]] = True
    at, group = members(head)
    if not len(at):
        return order, same
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(begin, len(group)))
    first = order[at[begin]][group]
    equal = np.arange(len(at))  # members that still agree with their group's first suffix
    equal = equal[first != order[at]]
    differ_at = np.full(len(at), limit, np.int64)
    for depth in range(shallow, limit, 8):
        step = min(depth, limit - 8)
        same_word = words[order[at[equal]] + step] == words[first[equal] + step]
        differ_at[equal[~same_word]] = step
        equal = equal[same_word]
        if not len(equal):
            break
    whole = np.minimum.reduceat(differ_at, begin) == limit
    follows = np.append(False, group[1:] == group[:-1])
    same[at[follows & whole[group]]] = True
    # Tries of two leaves need one comparison, the others are built.
    two = np.flatnonzero(~whole & (sizes == 2))
    if len(two):
        a, b = at[begin[two]], at[begin[two] + 1]
        step = differ_at[begin[two] + 1]
        swap = words[order[a] + step] > words[order[b] + step]
        order[a[swap]], order[b[swap]] = order[b[swap]], order[a[swap]]
    raw = data.tobytes()
    for g in np.flatnonzero(~whole & (sizes > 2)).tolist():
        where = at[begin[g] : begin[g] + sizes[g]]
        found = blind_trie(raw, order[where].tolist(), shallow, limit)
        order[where] = [s for s, _ in found]
        same[where] = [shared == limit for _, shared in found]
    return order, same


REPEAT = "segment long, spans array<int>"


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of starts, in each segment, of strings that start elsewhere too.  Rows come ordered by gram."""
    rows: dict[int, list] = {}
    size, last = 0, None

    def sort() -> pa.RecordBatch:
        names = list(rows)
        data = np.frombuffer(b"".join(r[1] for r in rows.values()) + b"\0" * 8, np.uint8)
        counts = np.array([r[0] for r in rows.values()])
        base = segment_starts(np.array([len(r[1]) for r in rows.values()]))[:-1]
        owner = np.repeat(np.arange(len(names)), counts)
        starts = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + base[owner]
        order, same = sort_suffixes(data, starts)
        twice = same | np.append(same[1:], False)
        marked = np.zeros(len(data), bool)
        marked[order[twice]] = True
        found = marked[starts] | (np.array([r[2] for r in rows.values()]) > 1)[owner]
        edge = np.diff(np.concatenate(([False], found, [False])).astype(np.int8))
        begin = segment_starts(counts)
        # Runs also end where a segment does.
        new = np.flatnonzero((edge[:-1] == 1) | (found & np.isin(np.arange(len(found)), begin)))
        end = np.flatnonzero((edge[1:] == -1) | (found & np.isin(np.arange(len(found)) + 1, begin)))
        which = owner[new]
        flat = np.column_stack((new - begin[which], end - begin[which] + 1)).astype(np.int32)
        cuts = np.searchsorted(which, np.arange(len(names) + 1)) * 2
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat.ravel()))], ["segment", "spans"])

    for batch in tidy(batches):
        for gram, name, starts, data, copies in zip(*(batch.column(c).to_pylist() for c in ("gram", "segment", "starts", "bytes", "copies")), strict=True):
            if gram != last and size > SORT_BYTES:
                yield sort()
                rows, size = {}, 0
            last = gram
            if name in rows:
                rows[name][2] += copies
            else:
                rows[name] = [starts, data, copies]
                size += len(data)
    if rows:
        yield sort()


def spans_to_remove(found: list) -> np.ndarray:
    """Bounds of the maximal runs of bytes under the strings that ``found`` (start, spans of starts) names."""
    if not found:
        return np.empty((0, 2), np.int64)
    spans = np.concatenate([np.asarray(r["spans"], np.int64).reshape(-1, 2) + r["start"] for r in found])
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1] - 1 + SPAN)
    new = np.append(True, spans[1:, 0] > end[:-1])
    return np.column_stack((spans[new, 0], end[np.append(new[1:], True)]))


def cut(text: bytes, spans: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in spans.tolist():
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def whole_characters(text: bytes, spans: np.ndarray) -> np.ndarray:
    """Spans drawn in to the UTF-8 characters that lie in them as a whole."""
    if not len(spans):
        return spans
    inner = np.append((np.frombuffer(text, np.uint8) & 0xC0) == 0x80, False)
    out = []
    for a, b in spans.tolist():
        while a < b and inner[a]:
            a += 1
        while b > a and inner[b]:
            b -= 1
        if b > a:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    """Column ``row`` and what is left of its text."""
    for batch in chunks(batches, "text"):
        cells: list[tuple] = []
        for text, found in zip(texts_of(batch.column("text")), batch.column("found").to_pylist(), strict=True):
            spans = spans_to_remove(found)
            if as_text:
                spans = whole_characters(text, spans)
            kept = cut(text, spans)
            cells.append((kept.decode(),) if as_text else (len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
        kinds = [pa.string()] if as_text else [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = ["kept"] if as_text else [x.split()[0] for x in RESULT.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(list(c), k) for c, k in zip(zip(*cells, strict=True), kinds, strict=True))], ["row", *names])


def _found(docs: DataFrame, hot: int) -> DataFrame | None:
    """``key, start, spans``: spans of repeated strings for each text, named by its hash."""
    out: DataFrame | None = None
    level_docs = docs
    for level, gram in enumerate(GRAMS):
        held = level > 0
        grams = level_docs.mapInArrow(lambda it, g=gram, h=held: _anchors(it, g, h, True), GRAM)
        twice = stored(grams.groupBy("gram").agg(F.sum("n").alias("n"), F.count("*").alias("segments")).where("n > 1"), "suffix-grams")
        anchors = level_docs.mapInArrow(lambda it, g=gram, h=held: _anchors(it, g, h, False), ANCHOR)
        last = level == len(GRAMS) - 1
        cold = twice if last else twice.where(F.col("segments") <= hot)
        chosen = anchors.join(cold.select("gram"), "gram").groupBy("key").agg(F.collect_set("ordinal").alias("ordinals"))
        rows = docs.join(chosen, "key").mapInArrow(lambda it, g=gram: _segments(it, g), SEGMENT)
        sorted_ = rows.where("bytes IS NOT NULL").select("gram", "segment", "starts", "bytes", "copies").repartition("gram").sortWithinPartitions("gram")
        repeats = sorted_.mapInArrow(_repeats, REPEAT).where(F.size("spans") > 0)
        found = rows.where("bytes IS NULL").select("segment", "key", "start").join(repeats, "segment").select("key", "start", "spans")
        out = found if out is None else out.union(found)
        if last or twice.where(F.col("segments") > hot).isEmpty():
            break
        if level == 0:
            hot_rows = anchors.join(twice.where(F.col("segments") > hot).select("gram"), "gram").groupBy("key").agg(F.collect_set("ordinal").alias("hot"))
            level_docs = docs.join(hot_rows, "key")
        # The next level looks at all strings of the hot anchors again; those that a longer gram already settles come twice, with one result.
    return out


def _finished(docs: DataFrame, row, as_text: bool, hot: int) -> DataFrame:
    rows = docs.select(F.struct(*row).alias("row"), "text", F.xxhash64(F.col("text"), F.length("text")).alias("key"))
    spans = _found(rows, hot).groupBy("key").agg(F.collect_set(F.struct("start", "spans")).alias("found"))
    joined = rows.join(spans, "key", "left").select("row", "text", "found")
    kind = rows.schema["row"].dataType
    schema = T.StructType([T.StructField("row", kind), *T.StructType.fromDDL("kept string" if as_text else RESULT).fields])
    return joined.mapInArrow(lambda it: _finish(it, as_text), schema)


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Null texts are empty; texts under ``SPAN`` bytes lose nothing.  Repeated rows repeat each other, so all their strings
    go.  Other columns of ``docs`` play no part.  Texts are told apart by 64 bits of hash and their length.
    """
    return _finished(docs, ["doc_id"], False, hot).select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The rows of ``docs``, all their columns, with what is left of ``text``; a character that a cut would split stays.

    A column ``n_chars`` is counted anew.  Null texts become empty.
    """
    left = _finished(docs, [c for c in docs.columns if c != "text"], True, hot)
    cells = [F.col("kept").alias(c) if c == "text" else F.length("kept").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns]
    return left.select(*cells)
