"""Best-fit packing: a grouping genetic algorithm, distributed as islands with elite migration.

A document's tokens and an end are cut into pieces of at most ``capacity``.  Shards of at most ``SHARD`` pieces are packed
on their own, each by ``ISLANDS`` populations.  A packing is a list of bins (groups).  Crossover injects whole well-filled
bins of one parent into the other, removes the bins that hold a piece of them already, and best-fits the displaced pieces,
largest first.  Populations begin with best fits of shuffled orders, one island's with one of falling sizes as well, and
every population goes through all its generations.  After each epoch an island's elite migrates to the next island.

Of a shard's best packing, bins filled to ``FULL`` are final.  The pieces of the others meet those of other shards in new,
fewer shards, level by level, so that what a shard leaves open does not add up; the last level keeps all bins.
"""

from __future__ import annotations

import os
import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import chunks, segment_starts, stored

CAPACITY = 4096
END = 1
SHARD, ISLANDS, EPOCHS = 2048, 2, 2
POPULATION, GENERATIONS = 8, 64
FULL = 0.99
#: Tasks of islands at most.
TASKS = 2000
#: Bits of a bin's number beside what it has left.
BIN, LOW = 32, (1 << 32) - 1
#: Bytes of text that are encoded at once; word cores of a generation whose ids a worker keeps; cores encoded at once.
PART, MEMO, BATCH = 8 << 20, 250_000, 8192
#: A character that no other joins, and how many cores go between such marks in one text.
MARK, JOINED = "|", 512
#: Marks that follow a word of these last letters are apart from it for the tokenizer.
TAIL, LAST = ".,;:!?", "[a-z\u00df-\u00f6\u00f8-\u00ff]$"


class Known:
    """Ids of strings, end to end."""

    def __init__(self):
        self.slots: dict[str, int] = {"": 0}
        self.begins, self.lengths, self.flat, self.used = np.zeros(1, np.int64), np.zeros(1, np.int64), np.empty(1 << 16, np.uint32), 0

    def add(self, strings: list[str], ids: np.ndarray, begins: np.ndarray) -> None:
        end = self.used + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty(max(end, 2 * len(self.flat)) - len(self.flat), np.uint32)))
        self.flat[self.used : end] = ids
        self.slots.update(zip(strings, range(len(self.slots), len(self.slots) + len(strings)), strict=True))
        self.begins = np.concatenate((self.begins, self.used + begins[:-1]))
        self.lengths = np.concatenate((self.lengths, np.diff(begins)))
        self.used = end


class Tokens:
    """Ids of texts by a tokenizer that never joins over white space: each distinct word core is encoded once.

    Cores are known in two generations: when the young one is full it becomes the old one, and what is met again moves
    over, so that frequent cores stay and those met once go.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young, self.old = Known(), Known()
        mark = self._encoded([MARK])[0]
        self.mark = int(mark[0]) if len(mark) == 1 else None  # a vocabulary without it encodes cores one by one

    def _encoded(self, strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _encode(self, strings: list[str]) -> None:
        """Many cores in one text, a mark between two; those with the mark's character alone."""
        marked = [x for x in strings if self.mark is None or MARK in x]
        for a in range(0, len(marked), BATCH):
            ids = self._encoded(marked[a : a + BATCH])
            self.young.add(marked[a : a + BATCH], np.concatenate(ids), segment_starts(np.array([len(x) for x in ids], np.int64)))
        plain = strings if not marked else [x for x in strings if MARK not in x] if self.mark is not None else []
        for a in range(0, len(plain), BATCH):
            some = plain[a : a + BATCH]
            ids = np.concatenate([x for k in range(0, len(some), JOINED) for x in (*self._encoded([f" {MARK} ".join(some[k : k + JOINED])]), np.array([self.mark], np.uint32))])
            ends = np.flatnonzero(ids == self.mark)
            self.young.add(some, np.delete(ids, ends), np.append(0, ends - np.arange(len(ends))))

    def _slots(self, strings: list[str]) -> np.ndarray:
        young, old = self.young, self.old
        new = [x for x in strings if x not in young.slots]
        again = [x for x in new if x in old.slots]
        if again:
            where = np.fromiter(map(old.slots.__getitem__, again), np.int64, len(again))
            young.add(again, *_gathered(old.flat, old.begins, old.lengths, where, 1))
            new = [x for x in new if x not in old.slots]
        if new:
            self._encode(new)
        return np.fromiter(map(young.slots.__getitem__, strings), np.int64, len(strings))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and where each word's begin."""
        cores = pc.utf8_rtrim(words, characters=TAIL)
        marked = pc.indices_nonzero(pc.not_equal(cores, words))  # those with marks at the end, which are few
        apart = marked.filter(pc.match_substring_regex(cores.take(marked), LAST))
        tails = pc.struct_field(pc.extract_regex(words.take(apart), f"(?P<t>[{TAIL}]*)$"), 0)
        mask = np.zeros(len(words), bool)
        mask[apart.to_numpy()] = True
        units = np.zeros((len(words), 2), np.int64)
        for column, k, own in ((pc.if_else(pa.array(mask), cores, words), 0, slice(None)), (tails, 1, mask)):
            coded = column.dictionary_encode()
            units[own, k] = self._slots(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        return _gathered(self.young.flat, self.young.begins, self.young.lengths, units.ravel(), 2)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each with ``END``, and where each text's begin (one more for the end of all)."""
        if len(self.young.slots) > MEMO:
            self.young, self.old = Known(), self.young
        texts = pc.fill_null(texts.cast(pa.string()), "")
        special = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))  # may hold a special token's text, which lower-casing could make
        if len(special):
            mask = np.zeros(len(texts), bool)
            mask[special] = True
            plain = pc.if_else(pa.array(mask), "", texts)
        else:
            plain = texts
        lists = pc.ascii_split_whitespace(pc.ascii_lower(plain))  # cuts at spaces and the bytes 9 to 13
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        flat, begins = self._words(coded.dictionary)
        lengths = np.append(np.diff(begins), 1)
        flat, begins = np.append(flat, np.uint32(END)), begins  # the last begin is the end's
        which = np.full(int(sizes.sum()) + len(texts), len(lengths) - 1, np.int64)
        inner = np.ones(len(which), bool)
        inner[np.cumsum(sizes + 1) - 1] = False
        which[inner] = coded.indices.to_numpy()
        out, cuts = _gathered(flat, begins, lengths, which, 1)
        cuts = cuts[segment_starts(sizes + 1)]
        if len(special):
            parts = [out[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            for i in special.tolist():
                parts[i] = np.array([*self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, END], np.uint32)
            out, cuts = np.concatenate(parts), segment_starts(np.array([len(x) for x in parts], np.int64))
        return out, cuts


_tokens: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """A worker's tokens, which its later tasks use again; of one vocabulary at a time."""
    if path not in _tokens:
        _tokens.clear()
        _tokens[path] = Tokens(path)
    return _tokens[path]


def _gathered(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, which: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs named by ``which``, end to end, and where every so manieth begins (one more for the end of all)."""
    own = lengths[which]
    starts = segment_starts(own)
    return flat[np.repeat(begins[which] - starts[:-1], own) + np.arange(starts[-1])], starts[::every]


ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
ITEM_SQL = "struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,ids:binary>"
SHARDS = f"shard long, items array<{ITEM_SQL}>"


def _cut(doc_ids: pa.Array, flat: np.ndarray, cuts: np.ndarray, capacity: int, with_ids: bool) -> pa.StructArray:
    """The texts' pieces."""
    sizes = np.diff(cuts)
    counts = -(-sizes // capacity)  # a text has an end at least
    doc = np.repeat(np.arange(len(sizes)), counts)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = piece * capacity
    length = np.minimum(capacity, sizes[doc] - start)
    data = memoryview(flat.astype("<u4", copy=False).tobytes())
    spans = [data[a : a + n] for a, n in zip((4 * (cuts[doc] + start)).tolist(), (4 * length).tolist(), strict=True)]
    crc = np.fromiter(map(zlib.crc32, spans), np.int64, len(spans))
    ids = pa.array([bytes(x) for x in spans], pa.binary()) if with_ids else pa.nulls(len(spans), pa.binary())
    return pa.StructArray.from_arrays([doc_ids.cast(pa.int64()).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), ids], fields=list(ITEM))


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    tokens = tokens_of(path)
    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def shard(items: pa.StructArray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([task << 20 | number]), pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)], ["shard", "items"])

    for batch in chunks(batches, "text", PART):
        held.append(_cut(batch.column("doc_id"), *tokens.ids(batch.column("text")), capacity, with_ids))
        size += len(held[-1])
        if size >= SHARD:
            items = pa.concat_arrays(held)
            for a in range(0, size - SHARD + 1, SHARD):
                yield shard(pa.concat_arrays([items.slice(a, SHARD)]))
                number += 1
            held, size = [items.slice(size - size % SHARD)], size % SHARD
    if size:
        yield shard(pa.concat_arrays(held))


class Packing:
    """Bins of piece numbers, with what each has left."""

    __slots__ = ("bins", "left")

    def __init__(self, bins: list[list[int]], left: list[int]):
        self.bins, self.left = bins, left

    def fitness(self, capacity: int) -> float:
        """Mean square of the bins' fill: of two packings with as many bins, the one with fuller ones is fitter."""
        return sum([(1 - x / capacity) ** 2 for x in self.left]) / max(1, len(self.left))

    def best_fit(self, order: list[int], sizes: list[int], capacity: int) -> None:
        """Put each piece into the bin it fits most tightly, or a new one."""
        bins, left = self.bins, self.left
        room = sorted([x << BIN | b for b, x in enumerate(left)])  # what is left, then the bin's number
        for i in order:
            size = sizes[i]
            at = bisect_left(room, size << BIN)
            if at == len(room):
                b, rest = len(bins), capacity - size
                bins.append([i])
                left.append(rest)
            else:
                b = room.pop(at) & LOW
                bins[b].append(i)
                rest = left[b] = left[b] - size
            if rest:
                insort(room, rest << BIN | b)

    def owners(self, n: int) -> list[int]:
        out = [-1] * n
        for b, items in enumerate(self.bins):
            for i in items:
                out[i] = b
        return out


def crossed(a: Packing, b: Packing, sizes: list[int], capacity: int, dice: random.Random) -> Packing:
    """``b`` with some of the best-filled bins of ``a`` injected whole."""
    good = sorted(range(len(a.bins)), key=a.left.__getitem__)
    good = good[: max(1, len(good) // 2)]
    chosen = dice.sample(good, max(1, int(len(good) * dice.uniform(0.3, 0.9))))
    injected = {i for g in chosen for i in a.bins[g]}
    kept, displaced = [], []
    for k, items in enumerate(b.bins):
        if injected.isdisjoint(items):
            kept.append(k)
        else:
            displaced += [i for i in items if i not in injected]
    if kept and dice.random() < 0.5:  # a mutation: the emptiest kept bin is emptied as well
        worst = max(kept, key=b.left.__getitem__)
        kept.remove(worst)
        displaced += b.bins[worst]
    child = Packing([list(a.bins[g]) for g in chosen] + [list(b.bins[k]) for k in kept], [a.left[g] for g in chosen] + [b.left[k] for k in kept])
    child.best_fit(sorted(displaced, key=sizes.__getitem__, reverse=True), sizes, capacity)
    return child


@dataclass
class Island:
    """A population, the fittest first, and what happened in it."""

    people: list[Packing]
    crossovers: int = 0
    children: int = 0  # that were fit enough to stay
    migrants: int = 0  # immigrants that became the fittest


def packing_of(owner: list[int], sizes: list[int], capacity: int) -> Packing:
    bins: list[list[int]] = [[] for _ in range(max(owner, default=-1) + 1)]
    for i, b in enumerate(owner):
        bins[b].append(i)
    return Packing(bins, [capacity - sum(sizes[i] for i in items) for items in bins])


def evolve(sizes: list[int], capacity: int, seed: int, people: list[list[int]] = (), migrant: list[int] | None = None, best_fit: bool = False, generations: int = GENERATIONS) -> Island:
    """An epoch of one island: ``people`` (each piece's bin) of the epoch before, or new ones, and an elite from elsewhere.

    New people are best fits of shuffled orders, large pieces mostly before small ones; with ``best_fit`` one is that of
    falling sizes.  In each generation a child of two parents takes the place of the least fit, if it is fitter.
    """
    dice = random.Random(seed)
    n = len(sizes)
    island = Island([packing_of(p, sizes, capacity) for p in people])
    while len(island.people) < POPULATION:
        noise = 0.0 if best_fit and not island.people else dice.uniform(0.2, 1.0)
        fresh = Packing([], [])
        fresh.best_fit(sorted(range(n), key=lambda i: -sizes[i] * (1 - noise * dice.random())), sizes, capacity)
        island.people.append(fresh)
    key = lambda p: (len(p.bins), -p.fitness(capacity))
    ranked = sorted(((key(p), k) for k, p in enumerate(island.people)))
    people, keys = [island.people[k] for _, k in ranked], [x for x, _ in ranked]

    def settle(child: Packing) -> int | None:
        own = key(child)
        at = bisect_left(keys, own)
        if at == len(keys) or keys[at] == own:
            return None
        people.insert(at, child)
        keys.insert(at, own)
        people.pop()
        keys.pop()
        return at

    if migrant:
        island.migrants = int(settle(packing_of(migrant, sizes, capacity)) == 0)
    for _ in range(generations if n > 1 else 0):
        a, b = dice.sample(range(len(people)), 2)
        island.crossovers += 1
        island.children += settle(crossed(people[a], people[b], sizes, capacity, dice)) is not None
    island.people = people
    return island


ISLAND = "shard long, island int, sizes array<int>, elite array<int>, people array<array<int>>, bins int, fitness double, crossovers long, children long, migrants long"


def _island(batches: Iterator[pa.RecordBatch], capacity: int, epoch: int) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in ISLAND.split(", ")]
    one = pa.list_(pa.int32())
    kinds = [pa.int64(), pa.int32(), one, one, pa.list_(one), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            sizes = row["sizes"]
            found = evolve(sizes, capacity, (row["shard"] * 31 + epoch) * ISLANDS + row["island"], row.get("people") or (), row.get("migrant"), best_fit=not epoch and not row["island"])
            people = [p.owners(len(sizes)) for p in found.people]
            told = [row[x] or 0 for x in ("crossovers", "children", "migrants")] if epoch else [0, 0, 0]
            cells = [
                row["shard"], row["island"], sizes, people[0], people if epoch + 1 < EPOCHS else None, len(found.people[0].bins), found.people[0].fitness(capacity),
                told[0] + found.crossovers, told[1] + found.children, told[2] + found.migrants,
            ]
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], names)


PLACED = f"shard long, item {ITEM_SQL}, sequence_id long, offset long"


def _close(batches: Iterator[pa.RecordBatch], capacity: int, level: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Pieces with their place in a final sequence; those of open bins without one."""
    for batch in batches:
        for k in range(batch.num_rows):
            shard, items = batch.column("shard")[k].as_py(), batch.column("items")[k].values
            owner = batch.column("elite")[k].values.to_numpy().astype(np.int64)
            length = items.field("length").to_numpy()
            fill = np.bincount(owner, length).astype(np.int64)
            order = np.argsort(owner, kind="stable")
            offset = np.empty(len(owner), np.int64)
            before = np.cumsum(length[order]) - length[order]
            offset[order] = before - segment_starts(fill)[owner[order]]
            done = np.full(len(owner), True) if last else (fill >= FULL * capacity)[owner]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(owner), shard)), items, pa.array(level << 57 | shard << 12 | owner, mask=~done), pa.array(offset),
            ], ["shard", "item", "sequence_id", "offset"])


def evolved(shards: DataFrame, capacity: int, count: int = 1) -> DataFrame:
    """The last epoch's islands of each shard: ``elite``, its bins and fitness, and what happened on the way."""
    lengths = F.transform("items", lambda x: x["length"].cast("int"))
    islands = shards.select("shard", lengths.alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    islands = islands.repartition(max(1, min(count * ISLANDS, TASKS)), "shard", "island")  # rows are small, but each is work
    out = islands.mapInArrow(lambda it: _island(it, capacity, 0), ISLAND)
    ring = Window.partitionBy("shard").orderBy("island")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for epoch in range(1, EPOCHS):
        moved = out.withColumn("migrant", F.coalesce(F.lead("elite").over(ring), F.first("elite").over(whole)))  # ISLANDS rows of a shard
        out = moved.drop("elite").mapInArrow(lambda it, e=epoch: _island(it, capacity, e), ISLAND)
    return out


def _level(shards: DataFrame, capacity: int, level: int, last: bool, count: int) -> DataFrame:
    best = evolved(shards, capacity, count).groupBy("shard").agg(F.min_by("elite", F.struct("bins", (-F.col("fitness")).alias("f"), "island")).alias("elite"))
    return shards.join(best, "shard").select("shard", "items", "elite").mapInArrow(lambda it: _close(it, capacity, level, last), PLACED)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, and ``ids`` (little-endian) if asked.

    A null or empty text is one piece, its end.  Only documents over ``capacity`` are cut.  Repeated rows are packed each.
    Sequences are gapless from offset 0.  Other columns of ``docs`` play no part; an empty table gives an empty result.
    """
    shards = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _pieces(it, tokenizer, capacity, with_ids), SHARDS), "pack-shards")
    out, level, before = None, 0, None
    while True:
        count = shards.count()
        last = count <= 1 or level >= 15 or (before is not None and count > 0.7 * before)
        placed = stored(_level(shards, capacity, level, last, count), "pack-level")
        done = placed.where("sequence_id IS NOT NULL")
        out = done if out is None else out.union(done)
        if last:
            break
        open_ = placed.where("sequence_id IS NULL")
        left = open_.count()
        if not left:
            break
        fewer = -(-left // SHARD)
        level, before = level + 1, count
        again = open_.select(F.pmod(F.xxhash64("shard", "offset", "item.doc_id", "item.piece", F.lit(level)), F.lit(fewer)).alias("shard"), "item")
        shards = stored(again.groupBy("shard").agg(F.collect_list("item").alias("items")), "pack-shards")  # about SHARD pieces
    columns = ["item.doc_id", "item.piece", "item.start", "item.length", "item.ids_crc32", "sequence_id", "offset"]
    return out.select(*columns, *(["item.ids"] if with_ids else []))
