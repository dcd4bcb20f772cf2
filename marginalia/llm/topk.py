"""Exact top-k search by inner product: three-phase uniform threshold.

A vector's components are split into ``LISTS`` blocks; a block's partial products are one score list.  Vectors and
queries are packed into bounded blocks, and each pair of a query block and a vector block is one step of work.

1. Each list of each pair gives its local best entries, whose scores alone are completed from the other lists, and its
   highest partial score.  The k-th best completed score, over all pairs, is a safe cutoff: the answer's scores are at
   least that.
2. The cutoffs, (k, queries) numbers of a query block, go back.  A pair whose highest partial scores can't add up to the
   cutoff for any query is done.  An entry of the others reaches the cutoff only if it has the cutoff over the number of
   lists in some list; entries without that are never collected.  The first list alone rules out most: what it lacks,
   the highest scores of the others must bring.
3. The remaining partial scores of the entries that are left are resolved one by one, exactly, and the k best are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import stored

LISTS = 2
#: Components beyond this count as this; 256 times as much is still a double.
LARGEST = 2.0**1000
#: Vectors of a block, queries of a block.
ROWS, QUERIES = 2048, 1024
#: Groups of vector blocks that a query block is sent to.
GROUPS, GROUP_BLOCKS = 64, 16

PACKED = "dim int, ids binary, vectors binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of quantised vectors of one length; invalid ones go."""
    held: dict[int, tuple[list, list]] = {}

    def block(dim: int) -> pa.RecordBatch:
        ids, vectors = held.pop(dim)
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.concatenate(vectors).tobytes()], pa.binary())], ["dim", "ids", "vectors"])

    for batch in batches:
        for i, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            if i is None or vector is None or None in vector:
                continue
            x = np.array(vector, np.float64)
            if not np.isfinite(x).all():
                continue
            x = np.floor(256 * np.clip(x, -LARGEST, LARGEST))
            ids, vectors = held.setdefault(len(x), ([], []))
            ids.append(i)
            vectors.append(x)
            if len(ids) == ROWS:
                yield block(len(x))
    for dim in list(held):
        yield block(dim)


QUERY = "dim int, block long, place int, id long, vector binary"


def _queries(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            at = np.flatnonzero(ids % every == 0)
            vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), row["dim"])[at]
            yield pa.RecordBatch.from_arrays([
                pa.array([row["dim"]] * len(at), pa.int32()), pa.array([row["block"]] * len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array(ids[at]), pa.array([v.tobytes() for v in vectors], pa.binary()),
            ], [x.split()[0] for x in QUERY.split(", ")])


QUERY_BLOCK = "dim int, q_blocks binary, q_places binary, q_ids binary, q_vectors binary"


def _pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}

    def block(dim: int) -> pa.RecordBatch:
        rows = held.pop(dim)
        cells = [np.array([r[k] for r in rows], np.int64).tobytes() for k in range(3)] + [b"".join(r[3] for r in rows)]
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], [x.split()[0] for x in QUERY_BLOCK.split(", ")])

    for batch in batches:
        for dim, *row in zip(*(batch.column(c).to_pylist() for c in ("dim", "block", "place", "id", "vector")), strict=True):
            held.setdefault(dim, []).append(row)
            if len(held[dim]) == QUERIES:
                yield block(dim)
    for dim in list(held):
        yield block(dim)


LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Pair:
    """A block of vectors and one of queries; whole numbers as doubles, whose products are exact or taken as integers."""

    def __init__(self, row: dict):
        self.ids, self.q_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
        self.own = np.zeros((len(self.ids), len(self.q_ids)), bool)  # the query's own row
        mine = np.flatnonzero(np.frombuffer(row["q_blocks"], np.int64) == row["block"])
        self.own[np.frombuffer(row["q_places"], np.int64)[mine], mine] = True
        dim = row["dim"]
        v, q = np.frombuffer(row["vectors"]).reshape(-1, dim), np.frombuffer(row["q_vectors"]).reshape(-1, dim)
        self.exact = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * dim < 2**53  # doubles hold every sum exactly
        if not self.exact:
            v, q = ([[int(x) for x in r] for r in m.tolist()] for m in (v, q))
            v, q = (np.array(m, object).reshape(-1, dim) for m in (v, q))
        self.vectors, self.queries = v, q
        cuts = np.linspace(0, dim, min(LISTS, max(dim, 1)) + 1).astype(int)
        self.lists = list(zip(cuts.tolist(), cuts[1:].tolist(), strict=False))

    def partial(self, k: int) -> np.ndarray:
        """(vector, query) products of one list."""
        a, b = self.lists[k]
        out = self.vectors[:, a:b] @ self.queries[:, a:b].T
        return np.zeros(out.shape, object) + out if not self.exact else out

    def resolved(self, k: int, v: np.ndarray, q: np.ndarray) -> np.ndarray:
        """One list's products of some entries."""
        a, b = self.lists[k]
        return (self.vectors[v, a:b] * self.queries[q, a:b]).sum(axis=1)


def held(scores: np.ndarray) -> np.ndarray:
    """Whole scores as 64-bit integers; those beyond stand at the nearest."""
    if scores.dtype != object:
        return scores.astype(np.int64)
    return np.array([min(max(int(x), LEAST + 1), MOST) for x in scores.ravel()], np.int64).reshape(scores.shape)


BEST = "q long, part int, best binary"
FIRST = "q long, block long, best binary, highest binary"


def _first(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Phase 1: for each query the k best completed scores among the lists' best, and what all lists' highest add up to."""
    for batch in batches:
        for row in batch.to_pylist():
            pair = Pair(row)
            partials = [pair.partial(i) for i in range(len(pair.lists))]
            listed, highest = np.zeros(pair.own.shape, bool), 0
            for p in partials:
                p[pair.own] = LEAST if pair.exact else -(1 << 4000)
                top = np.argpartition(-p, min(k, len(p)) - 1, axis=0)[:k] if pair.exact else np.argsort(-p, axis=0, kind="stable")[:k]
                np.put_along_axis(listed, top, True, axis=0)
                highest = highest + p.max(axis=0)
            v, q = np.nonzero(listed & ~pair.own)
            total = held(sum(p[v, q] for p in partials))
            scores = np.full((k, len(pair.q_ids)), LEAST)
            order = np.lexsort((-total, q))
            v, q, total = v[order], q[order], total[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            scores[rank[rank < k], q[rank < k]] = total[rank < k]
            top = held(highest) if not pair.exact else np.maximum(highest, float(LEAST)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([row["q"]]), pa.array([row["block"]]), pa.array([scores.tobytes()], pa.binary()), pa.array([top.tobytes()], pa.binary())], ["q", "block", "best", "highest"])


def _worth(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Phase 2: the pairs in which some query can still reach its cutoff."""
    for batch in batches:
        keep = [
            bool((np.frombuffer(h, np.int64) >= np.frombuffer(b, np.int64).reshape(k, -1)[-1]).any())
            for h, b in zip(batch.column("highest").to_pylist(), batch.column("best").to_pylist(), strict=True)
        ]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["q", "block"])


def _merge(batches: Iterator[pa.RecordBatch], k: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Running best k of the rows of one query block (and part); rows come ordered."""
    last, best = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]], pa.int32()), pa.array([best.tobytes()], pa.binary())], ["q", "part", "best"])

    for batch in batches:
        for q, part, data in zip(*(batch.column(c).to_pylist() for c in ("q", "part", "best")), strict=True):
            key = (q, 0 if whole else part)
            scores = np.frombuffer(data, np.int64).reshape(k, -1)
            if key != last:
                if last is not None:
                    yield done()
                last, best = key, scores
            else:
                best = np.sort(np.concatenate((best, scores)), axis=0)[::-1][:k]
    if last is not None:
        yield done()


FOUND = "q long, q_place int, query_id long, vec_id long, score long, block long, place int"


def _second(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Phases 2 and 3: entries that can reach the cutoff, resolved, the best k of each query."""
    for batch in batches:
        for row in batch.to_pylist():
            pair = Pair(row)
            cutoff = np.frombuffer(row["best"], np.int64).reshape(k, -1)[-1]
            open_ = cutoff <= LEAST + 1  # fewer than k entries are known, or the k-th stands at the lower end: all may count
            limit = cutoff.astype(float) if pair.exact else cutoff.astype(object)
            first = pair.partial(0)
            ends = [np.abs(pair.vectors[:, a:b]).sum(axis=1).max(initial=0) * np.abs(pair.queries[:, a:b]).max(axis=1, initial=0) if b > a else 0 for a, b in pair.lists[1:]]
            able = first + sum(ends) >= limit  # with the most that the other lists could bring
            v, q = np.nonzero((able | open_) & ~pair.own)
            partials = [first[v, q]]
            total = partials[0]
            for i in range(1, len(pair.lists)):
                partials.append(pair.resolved(i, v, q))
                total = total + partials[-1]
            share = limit[q] / len(partials) if pair.exact else np.array([-(-int(x) // len(partials)) for x in limit[q]], object)
            enough = open_[q]
            for p in partials:
                enough = enough | (p >= share)
            total = held(total)
            keep = np.asarray(enough, bool) & (total >= cutoff[q])
            v, q, total = v[keep], q[keep], total[keep]
            order = np.lexsort((v, pair.ids[v], -total, q))
            v, q, total = v[order], q[order], total[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            v, q, total = v[rank < k], q[rank < k], total[rank < k]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(q), row["q"])), pa.array(q.astype(np.int32)), pa.array(pair.q_ids[q]), pa.array(pair.ids[v]), pa.array(total), pa.array(np.full(len(q), row["block"])), pa.array(v.astype(np.int32)),
            ], [x.split()[0] for x in FOUND.split(", ")])


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``vectors`` (``vec_id, embedding``): each query's k best other rows.

    Queries are the rows whose vec_id is divisible by ``every``.  Rows without a vec_id, and vectors null or with null or
    non-finite components, take no part; vectors of different lengths are not compared.  Rows that repeat a vec_id count
    each: as queries of their own and as candidates of each other.  Scores beyond 64 bits stand at
    the nearest that fit (ties to the smaller vec_id); components beyond 2**1000 count as that.
    """
    blocks = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_pack, PACKED).withColumn("block", F.monotonically_increasing_id()), "topk-blocks")
    n_blocks = blocks.count()
    queries = stored(blocks.mapInArrow(lambda it: _queries(it, every), QUERY), "topk-queries")
    n_queries = queries.count()
    packed = queries.repartition(max(1, -(-n_queries // QUERIES))).mapInArrow(_pack_queries, QUERY_BLOCK).withColumn("q", F.monotonically_increasing_id())
    packed = stored(packed, "topk-query-blocks")
    groups = min(max(1, n_blocks), max(GROUPS, n_blocks // GROUP_BLOCKS))
    cut = blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    sent = packed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = sent.join(cut.hint("merge"), ["group", "dim"])  # sent grows with both tables: never a broadcast; a group's few blocks are held
    firsts = stored(pairs.mapInArrow(lambda it: _first(it, k), FIRST), "topk-first")
    best = firsts.select("q", F.pmod("block", F.lit(GROUPS)).cast("int").alias("part"), "best")
    for whole in (False, True):
        keys = ["q"] if whole else ["q", "part"]
        best = best.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda it, w=whole: _merge(it, k, w), BEST)
    cutoffs = stored(best.select("q", "best"), "topk-cutoffs")
    worth = firsts.select("q", "block", "highest").join(cutoffs.hint("merge"), "q").mapInArrow(lambda it: _worth(it, k), "q long, block long")
    wanted = worth.groupBy("q").agg(F.collect_list("block").alias("worth")).join(cutoffs.hint("merge"), "q")  # a query block's row: block numbers and cutoffs
    some = packed.join(stored(wanted, "topk-worth").hint("merge"), "q")
    again = some.withColumn("group", F.explode(F.array_distinct(F.transform("worth", lambda b: F.pmod(F.xxhash64(b), F.lit(groups)).cast("int")))))
    found = again.join(cut.hint("merge"), ["group", "dim"]).where(F.array_contains("worth", F.col("block"))).drop("worth").mapInArrow(lambda it: _second(it, k), FOUND)
    order = Window.partitionBy("q", "q_place").orderBy(F.desc("score"), "vec_id", "block", "place")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
