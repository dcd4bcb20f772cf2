"""Two tokenizers' tokens aligned by bytes, and how often an id of one meets an id of the other.

Texts are read once, in blocks.  A text is cut before single blanks that begin a word, where both tokenizers have a token
boundary whatever lies around, so that only distinct words are tokenized.  A block keeps its documents' figures and, for
each pair of ids, the documents that hold it linked and how often (its *postings*).

Pairs' counts then meet postings in a cogroup: two kinds of rows, counts added up beforehand and postings, are dealt by the
A id and sorted by Spark, which spills.  A task reads them as one stream: an A id's counts first (at most one for each B id),
of which it takes the maximum, then its postings, whose shares go to their documents.  An A id with many postings is
salted: its counts are repeated for each salt, its postings are parted among them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import chunks, segment_starts, stored, texts_of, tidy

#: Bytes of text of a block at most (a longer text is a block of its own), and rows.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 1 << 16
#: Words, and bytes of words, that a worker remembers.
WORDS, WORD_BYTES = 300_000, 24 << 20
#: Bits of a B id in a pair's number; ids of A take the bits above, up to 32 in all.
B_BITS = 15
#: Bytes of postings of one A id in one task, least and most; within that, a quarter of a task's even share.
SHARE = (1 << 18, 8 << 20)
#: Bytes of documents' shares that a task gathers before it hands them on.
GATHERED = 48 << 20
#: A single blank that begins a word: no blank before it, and after it no white space (nor a byte that may begin some).
CUT = re.compile(rb"(?<! ) (?=[\x21-\x7e\xc3-\xe0\xe4-\xf4])")

BLOCKS = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pair binary, docs binary, postings binary"
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


class Tokenizers:
    """Ids and byte lengths of both sides; built in a worker from two vocabulary files."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        if self.b.get_piece_size() > 1 << B_BITS or self.a.get_vocab_size() > 1 << (32 - B_BITS):
            raise ValueError("a vocabulary has more ids than a pair's number can hold")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level entries
        hidden = [x for x in range(256) if x not in set(shown)]
        byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}
        size = self.a.get_vocab_size()
        self.a_bytes = [bytes(byte_of[c] for c in self.a.id_to_token(i)) if all(c in byte_of for c in self.a.id_to_token(i)) else self.a.id_to_token(i).encode() for i in range(size)]
        as_byte = re.compile(r"<0x([0-9A-F]{2})>")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := as_byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]

        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        # how a group's tokens are written: an id and what follows it
        written = lambda n, mark: np.array([f"{i}{mark}".encode() for i in range(n)], object)
        self.written = (written(size, ","), written(size, "|"), written(len(pieces), ","), written(len(pieces), ";"))

    def encode(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Both sides' ids of each word with a blank before it (which B adds itself)."""
        left = self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)
        return [e.ids for e in left], self.b.encode(words, num_threads=1)


class Grown:
    """An array that rows are added to."""

    def __init__(self, dtype, width: int = 0):
        self.held, self.n = np.zeros((1024, width) if width else 1024, dtype), 0

    def add(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.held):
            more = np.zeros((max(2 * len(self.held), self.n + len(rows)), *self.held.shape[1:]), self.held.dtype)
            more[: self.n] = self.held[: self.n]
            self.held = more
        self.held[self.n : self.n + len(rows)] = rows
        self.n += len(rows)


class Words:
    """Words that a worker remembers: ``at`` numbers them by their bytes.

    Of each it keeps its ``figures`` (see ``NUMBERS``), whether the bytes of both sides are the word's (``ok``), where its
    pairs and their multiplicities begin and how many there are, and its groups as text that ends in ``;``.
    """

    def __init__(self, tools: Tokenizers):
        self.tools = tools
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.groups: list[bytes] = []
        self.figures, self.ok, self.begin, self.count = Grown(np.int64, 4), Grown(bool), Grown(np.int64), Grown(np.int64)
        self.pair, self.times, self.size = Grown(np.uint32), Grown(np.uint32), 0

    def settle(self) -> None:
        """Forget all, if there is much; called between blocks."""
        if len(self.at) > WORDS or self.size > WORD_BYTES:
            self.clear()

    def learn(self, words: Iterable[bytes]) -> None:
        """Tokenize those that are new, a batch at a time."""
        new = [w for w in words if w not in self.at]
        at = 0
        while at < len(new):
            n, held = 0, 0
            while at + n < len(new) and n < 8192 and held < 1 << 19:
                held += len(new[at + n])
                n += 1
            self._add(new[at : at + n])
            self.size += held
            at += n

    def _add(self, words: list[bytes]) -> None:
        tools = self.tools
        a, b = tools.encode([w.decode() for w in words])
        whole = [b" " + w for w in words]
        ok = np.ones(len(words), bool)
        if b"".join(tools.a_bytes[i] for x in a for i in x) != b"".join(whole) or b"".join(tools.b_bytes[i] for x in b for i in x) != b"".join(whole):
            for k, w in enumerate(whole):
                ok[k] = b"".join(tools.a_bytes[i] for i in a[k]) == w == b"".join(tools.b_bytes[i] for i in b[k])
        for k in np.flatnonzero(~ok):
            a[k], b[k] = [], []
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(words)) for x in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        # the words lie one after the other, and tokens of both sides end where a word ends
        ends_a, ends_b = np.cumsum(tools.a_size[ids_a]), np.cumsum(tools.b_size[ids_b])
        word_a, word_b = np.repeat(np.arange(len(words)), n_a), np.repeat(np.arange(len(words)), n_b)
        first = np.searchsorted(ends_b, ends_a - tools.a_size[ids_a], side="right")  # B tokens that overlap an A token
        n = np.searchsorted(ends_b, ends_a, side="left") - first + 1
        at_a = np.repeat(np.arange(len(ids_a)), n)
        at_b = np.arange(len(at_a)) - np.repeat(segment_starts(n)[:-1], n) + np.repeat(first, n)
        number = (word_a[at_a] << 32) | (ids_a[at_a] << B_BITS) | ids_b[at_b]
        pairs, times = np.unique(number, return_counts=True)
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, ends_a, side="left"), np.searchsorted(both, ends_b, side="left")
        per_word = lambda at: np.bincount(at, minlength=len(words))
        n_groups, n_links, n_pairs = per_word(word_a[np.searchsorted(ends_a, both)]), per_word(word_a[at_a]), per_word(pairs >> 32)

        last = lambda g: np.append(g[1:] != g[:-1], True)[: len(g)]
        comma_a, bar, comma_b, semi = tools.written
        said = np.concatenate([np.where(last(group_a), bar[ids_a], comma_a[ids_a]), np.where(last(group_b), semi[ids_b], comma_b[ids_b])])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        said, cuts = said[order].tolist(), segment_starts(n_a + n_b).tolist()
        self.groups += [b"".join(said[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        self.figures.add(np.stack([n_a, n_b, n_groups, n_links], 1))
        self.ok.add(ok)
        self.begin.add(self.pair.n + segment_starts(n_pairs)[:-1])
        self.count.add(n_pairs)
        self.pair.add((pairs & 0xFFFFFFFF).astype(np.uint32))
        self.times.add(times.astype(np.uint32))


def pieces(text: bytes) -> list[bytes]:
    """The text's words with what stands between them; each is preceded by one blank in the text with a blank before it."""
    cut = CUT.split(b" " + text)
    return cut[1:] if not cut[0] else [cut[0][1:], *cut[1:]]


def block_of(name: int, ids: pa.Array, texts: list[bytes], words: Words) -> pa.RecordBatch:
    """A block's row."""
    words.settle()
    cut = [pieces(t) if t else [] for t in texts]
    words.learn(set(chain.from_iterable(cut)))
    lengths = np.fromiter(map(len, cut), np.int64, len(cut))
    word = np.fromiter(map(words.at.__getitem__, chain.from_iterable(cut)), np.int64, int(lengths.sum()))
    del cut
    doc = np.repeat(np.arange(len(texts)), lengths)
    good = (np.bincount(doc, weights=~words.ok.held[word], minlength=len(texts)) == 0) & (lengths > 0)
    word, doc = word[good[doc]], doc[good[doc]]
    figures = np.zeros((len(texts), 4), np.int64)
    np.add.at(figures, doc, words.figures.held[word])
    shas, at = [], 0
    for d, n in enumerate(lengths.tolist()):
        if not good[d]:
            shas.append("")
            continue
        said = b"".join(map(words.groups.__getitem__, word[at : at + n].tolist()))
        shas.append(hashlib.sha256(memoryview(said)[:-1]).hexdigest())
        at += n
    n = words.count.held[word]
    place = np.arange(int(n.sum())) - np.repeat(segment_starts(n)[:-1], n) + np.repeat(words.begin.held[word], n)
    number = (words.pair.held[place].astype(np.uint64) << np.uint64(16)) | np.repeat(doc, n).astype(np.uint64)
    order = np.argsort(number)
    number, times = number[order], words.times.held[place][order].astype(np.int64)
    edge = np.flatnonzero(np.append(True, number[1:] != number[:-1])[: len(number)])
    number, times = number[edge], np.add.reduceat(times, edge) if len(edge) else times
    pair, docs = np.unique((number >> np.uint64(16)).astype(np.uint32), return_counts=True)
    postings = np.empty((len(number), 2), np.uint32)  # the document's place in the block, and how often
    postings[:, 0], postings[:, 1] = number & np.uint64(0xFFFF), times
    column = lambda values: pa.array([values])
    arrays = [
        pa.array([name], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(pa.int64())), *(pa.array([figures[:, k]], pa.list_(pa.int64())) for k in range(4)),
        column(shas), *(pa.array([x.tobytes()], pa.binary()) for x in (pair, docs.astype(np.uint32), postings)),
    ]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in BLOCKS.split(", ")])


def _blocks(a_path: str, b_path: str):
    def run(batches):
        words, name = Words(Tokenizers(a_path, b_path)), TaskContext.get().partitionId() << 32
        for part in chunks(batches, "text", BLOCK_BYTES):
            for at in range(0, part.num_rows, BLOCK_ROWS):
                rows = part.slice(at, BLOCK_ROWS)
                yield block_of(name, rows.column("doc_id"), texts_of(rows.column("text")), words)
                name += 1

    return run


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
    for i in range(batch.num_rows):
        get = lambda c: np.frombuffer(batch.column(c)[i].as_py(), np.uint32)
        yield batch.column("block")[i].as_py() if "block" in batch.schema.names else 0, get("pair"), get("docs"), get("postings").reshape(-1, 2) if "postings" in batch.schema.names else None


def _counted(batches):
    """``a, b, docs``: of a block, in how many documents each pair is."""
    for batch in tidy(batches):
        for _, pair, docs, _ in _pairs(batch):
            yield pa.RecordBatch.from_arrays([pa.array((pair >> B_BITS).astype(np.int32)), pa.array((pair & ((1 << B_BITS) - 1)).astype(np.int32)), pa.array(docs.astype(np.int64))], ["a", "b", "docs"])


def _posted(batches):
    """``a, b, block, postings``: a row for each pair of a block."""
    for batch in tidy(batches):
        for block, pair, docs, postings in _pairs(batch):
            for at in range(0, len(pair), 1 << 15):
                own = slice(at, at + (1 << 15))
                begin, n = int(docs[:at].sum()), docs[own]
                offsets = np.zeros(len(n) + 1, np.int32)
                np.cumsum(n * 8, out=offsets[1:])
                held = postings[begin : begin + int(n.sum())]
                binary = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(held))])
                yield pa.RecordBatch.from_arrays([pa.array((pair[own] >> B_BITS).astype(np.int32)), pa.array((pair[own] & ((1 << B_BITS) - 1)).astype(np.int32)), pa.array(np.full(len(n), block, np.int64)), binary], ["a", "b", "block", "postings"])


def _shares(batches):
    """The cogroup's stream, sorted by A id, salt, kind (counts before postings) and B id: ``block, shares`` of documents."""
    count, best, current, touched = np.zeros(1 << B_BITS, np.int64), 0, None, np.zeros(0, np.int64)
    gathered: dict[int, np.ndarray] = {}
    size = 0
    for batch in tidy(batches):
        if not batch.num_rows:
            continue
        a, salt, kind, b, docs, block = (np.asarray(batch.column(c).fill_null(0)) for c in ("a", "salt", "kind", "b", "docs", "block"))
        postings = batch.column("postings")
        edge = np.flatnonzero((np.diff(a) != 0) | (np.diff(salt) != 0) | (np.diff(kind) != 0)) + 1
        row_count, row_best = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
        for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(a)], strict=True):
            if current != (a[i], salt[i]):
                count[touched] = 0
                current, best, touched = (a[i], salt[i]), 0, np.zeros(0, np.int64)
            if kind[i] == 0:
                count[b[i:j]] = docs[i:j]
                best, touched = max(best, int(docs[i:j].max())), np.concatenate([touched, b[i:j]])
            else:
                row_count[i:j] = count[b[i:j]]
                row_best[i:j] = row_count[i:j] == best
        own = np.flatnonzero(kind == 1)
        if not len(own):
            continue
        held = postings.take(pa.array(own))
        lengths = np.diff(np.frombuffer(held.buffers()[1], np.int32)[: len(own) + 1]) // 8
        flat = np.frombuffer(b"".join(held.to_pylist()), np.uint32).reshape(-1, 2)
        where, times = np.repeat(block[own], lengths), flat[:, 1].astype(np.int64)
        sums, bests = times * np.repeat(row_count[own], lengths), np.where(np.repeat(row_best[own], lengths), times, 0)
        order = np.argsort(where, kind="stable")
        cuts = np.flatnonzero(np.diff(where[order])) + 1
        for part in np.split(order, cuts):
            name, place = int(where[part[0]]), flat[part, 0].astype(np.int64)
            top = int(place.max()) + 1
            known = gathered.get(name)
            if known is None or known.shape[1] < top:
                grown = np.zeros((2, max(top, 64)), np.int64)
                if known is not None:
                    grown[:, : known.shape[1]] = known
                    size -= known.nbytes
                gathered[name] = known = grown
                size += grown.nbytes
            np.add.at(known[0], place, bests[part])
            np.add.at(known[1], place, sums[part])
        if size > GATHERED:
            yield from _handed(gathered)
            gathered, size = {}, 0
    yield from _handed(gathered)


def _handed(gathered: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    names = list(gathered)
    for at in range(0, len(names), 64):
        own = names[at : at + 64]
        packed = [pa.compress(np.ascontiguousarray(gathered[n]).tobytes(), codec="zstd", asbytes=True) for n in own]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([gathered[n].shape[1] for n in own], pa.int32()), pa.array(packed, pa.binary())], ["block", "width", "shares"])


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(batches):
    """The stream of blocks' rows, each before its shares: a row for each document."""
    held, total = None, None

    def rows():
        n = len(held["doc_id"])
        columns = [held["doc_id"], *(held[c] for c in NUMBERS), total[0, :n], total[1, :n], held["groups_sha256"]]
        types = [pa.int64()] * 7 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in RESULT.split(", ")])

    for batch in tidy(batches):
        for i in range(batch.num_rows):
            if batch.column("kind")[i].as_py() == 0:
                if held is not None:
                    yield rows()
                held = {c: batch.column(c)[i].as_py() for c in ("doc_id", *NUMBERS, "groups_sha256")}
                total = np.zeros((2, len(held["doc_id"])), np.int64)
            else:
                width = batch.column("width")[i].as_py()
                own = np.frombuffer(pa.decompress(batch.column("shares")[i].as_py(), decompressed_size=16 * width, codec="zstd", asbytes=True), np.int64).reshape(2, width)
                n = min(width, total.shape[1])
                total[:, :n] += own[:, :n]
    if held is not None:
        yield rows()


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Every row's figures, see ``RESULT``.

    Null and empty texts, and texts whose tokens of a side do not give back their bytes with a blank before, have no tokens:
    zeros and an empty ``groups_sha256``; they count for no pair.  Every row is a document of its own, whatever its id,
    null ids and repeated rows too.  Only ``doc_id`` and ``text`` are read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    blocks = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_blocks(a_path, b_path), BLOCKS), "align-blocks")
    counts = blocks.select("pair", "docs").mapInArrow(_counted, "a int, b int, docs long").groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.count("*").alias("rows"))
    counts = stored(counts, "align-counts")

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    load = F.sum(8 * F.col("docs") + 40 * F.col("rows"))
    share = min(max((counts.agg(load).first()[0] or 0) // (4 * tasks), SHARE[0]), SHARE[1])  # one number
    salts = counts.groupBy("a").agg(F.ceil(load / share).cast("int").alias("salts")).where("salts > 1")  # at most a row for each id of A
    salted = counts.select("a", "b", "docs").join(F.broadcast(salts), "a", "left").select("a", "b", "docs", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    known = salted.select("a", "salt", F.lit(0).alias("kind"), "b", "docs", F.lit(0).cast("long").alias("block"), F.lit(None).cast("binary").alias("postings"))
    posted = blocks.select("block", "pair", "docs", "postings").mapInArrow(_posted, "a int, b int, block long, postings binary").join(F.broadcast(salts), "a", "left")
    salt = F.coalesce(F.pmod(F.xxhash64("block"), F.col("salts")), F.lit(0)).cast("int")
    posted = posted.select("a", salt.alias("salt"), F.lit(1).alias("kind"), "b", F.lit(0).cast("long").alias("docs"), "block", "postings")
    stream = known.unionByName(posted).repartition(tasks, "a", "salt").sortWithinPartitions("a", "salt", "kind", "b")
    shares = stream.mapInArrow(_shares, "block long, width int, shares binary")

    none = lambda kind: F.lit(None).cast(kind)
    own = blocks.select("block", F.lit(0).alias("kind"), "doc_id", *NUMBERS, "groups_sha256", none("int").alias("width"), none("binary").alias("shares"))
    added = shares.select("block", F.lit(1).alias("kind"), none("array<long>").alias("doc_id"), *(none("array<long>").alias(c) for c in NUMBERS), none("array<string>").alias("groups_sha256"), "width", "shares")
    return own.unionByName(added).repartition(tasks, "block").sortWithinPartitions("block", "kind").mapInArrow(_summed, RESULT)
