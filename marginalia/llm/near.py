"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges.

One hash of a shingle serves all of a document's minima: its high bits choose the bin, and a bin keeps its smallest
hash.  An empty bin copies the bin that a hash of (bin, attempt) names first among the filled ones.  ``BANDS`` groups of
``ROWS`` bins name buckets.  Documents with the same set are one node beforehand, so a bucket holds different sets only.

In a bucket every member is a candidate of one centre only, the same for all buckets that hold it, so there are at most as
many pairs as members; each is confirmed on the full sets.  As two members can be alike though the centre is not like
both, buckets whose other members still lie in several components get an exact finish.  There every member outside the
bucket's largest component is compared, on full sets, with all members of other components: outsiders in cells of at most
``CELL`` sets of about one size, each of which the bucket's members stream past.  A cell gives back the links that join
components, never its pairs, so no pair that shares a bucket goes untried and no row stands for a pair that is no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import chunks, fresh, mixed, sized, stored, texts_of, tidy, words_of

BANDS, ROWS = 32, 5
#: A shared hash is tried so often for an empty bin; after that the next filled bin serves.
ATTEMPTS = 64
#: Sets of one cell at most, and their shingles (a single larger set is a cell of its own).
CELL, CELL_SHINGLES = 512, 1 << 18
#: Shingles that so many sets of a cell hold are columns of a matrix, rarer ones go through lists of their holders.
COMMON = 16
#: Entries of a worker's word memo, after which it starts anew.
MEMO = 250_000

FACTORS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingle_sets(texts: list[bytes], width: int, memo: dict[bytes, int]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``width`` words; all words as one, if there are fewer."""
    tokens = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in tokens], np.int64)
    ends = np.cumsum(sizes)
    flat = np.fromiter(map(memo.__getitem__, chain.from_iterable(tokens)), np.uint64, int(ends[-1]) if len(ends) else 0)
    n = max(0, len(flat) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(width):
        rolled += flat[i : i + n] * FACTORS[i]
    rolled = mixed(rolled)
    out = []
    for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        start = end - size
        if size >= width:
            h = np.sort(rolled[start : end - width + 1])
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
        elif size:
            out.append(mixed((flat[start:end] * FACTORS[:size]).sum(keepdims=True) + FACTORS[63:] * np.uint64(size)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def node_of(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    return (mixed(hashes + FACTORS[60]).sum(dtype=np.uint64).tobytes()) + (mixed(hashes ^ FACTORS[61]).sum(dtype=np.uint64).tobytes())


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation minima of (documents, bins), densified; every set has a member."""
    bounds = ((np.arange(bins, dtype=np.uint64) << np.uint64(32)) + np.uint64(bins - 1)) // np.uint64(bins) << np.uint64(32)
    out = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for d, h in enumerate(sets):
        at = np.searchsorted(h, bounds)
        out[d] = h[np.minimum(at, len(h) - 1)]
        full[d] = at < np.append(at[1:], len(h))
    source = np.where(full, np.arange(bins), -1)
    for t in range(ATTEMPTS):
        d, k = np.nonzero(source < 0)
        if not len(d):
            break
        pick = (mixed(k.astype(np.uint64) * FACTORS[40] + FACTORS[41:42] * np.uint64(t + 1)) % np.uint64(bins)).astype(np.int64)
        ok = full[d, pick]
        source[d[ok], k[ok]] = pick[ok]
    d, k = np.nonzero(source < 0)
    if len(d):
        turned = np.concatenate((full, full), axis=1)
        after = np.where(turned, np.arange(2 * bins), 2 * bins)
        after = np.minimum.accumulate(after[:, ::-1], axis=1)[:, ::-1]
        source[d, k] = after[d, k] % bins
    return np.take_along_axis(out, source, axis=1)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    acc = np.broadcast_to(FACTORS[:bands] if bands <= 64 else mixed(np.arange(bands, dtype=np.uint64)), (len(signature), bands)).copy()
    for i in range(rows):
        acc = mixed(acc * FACTORS[50] + parts[:, :, i])
    return acc.view(np.int64)


SKETCH = "doc_id long, name long, n_shingles long, node binary, bands array<long>"


def _sketch(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    memo = _Memo()
    for batch in chunks(batches, "text"):
        sets = shingle_sets(texts_of(batch.column("text")), width, memo)
        some = [i for i, s in enumerate(sets) if len(s)]
        keys: list = [None] * len(sets)
        if some:
            for i, k in zip(some, band_keys(signatures([sets[i] for i in some], bands * rows), bands, rows), strict=True):
                keys[i] = k
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id").cast(pa.int64()), batch.column("name"), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([node_of(s) if len(s) else None for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64())),
        ], ["doc_id", "name", "n_shingles", "node", "bands"])


MEMBER = "node binary, shingles array<long>"


def _members(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    memo = _Memo()
    for batch in chunks(batches, "text"):
        sets = shingle_sets(texts_of(batch.column("text")), width, memo)
        node = batch.column("node").to_pylist()
        keep = [i for i, s in enumerate(sets) if len(s) and node_of(s) == node[i]]  # rows of other texts under the same id go
        yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in keep], pa.binary()), pa.array([sets[i].view(np.int64) for i in keep], pa.list_(pa.int64()))], ["node", "shingles"])


def _stars(placed: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (``a, b``) of the buckets' centres and their members of a like size (``key, node, n``)."""
    pairs = placed.join(_centres(placed, "n"), "key").where((F.col("node") != F.col("m")) & (100 * F.least("n", "n_m") >= percent * F.greatest("n", "n_m")))
    return pairs.select(F.least("m", "node").alias("a"), F.greatest("m", "node").alias("b")).distinct()


def _centres(placed: DataFrame, *more: str) -> DataFrame:
    """Each bucket's member of the smallest hash, so that a group has few centres."""
    least = F.min(F.struct(F.xxhash64("node", F.lit(0)).alias("p"), "node", *more)).alias("c")
    return placed.groupBy("key").agg(least).select("key", F.col("c.node").alias("m"), *(F.col(f"c.{x}").alias(f"{x}_m") for x in more))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike."""
    count = pairs.count()
    left = sets.toDF("a", "s").join(sized(pairs, count), "a")
    right = sets.toDF("b", "t").join(sized(pairs.select("b").distinct(), count), "b")
    common = F.size(F.array_intersect("s", "t"))
    return left.join(right, "b").where(100 * common >= percent * (F.size("s") + F.size("t") - common)).select("a", "b")


class Cell:
    """Some sets, ready to be intersected with others."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.names, which, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        order = np.argsort(which, kind="stable")
        self.holders, self.begins, self.held = owner[order], np.cumsum(held) - held, held
        self.column = np.where(held >= COMMON, np.cumsum(held >= COMMON) - 1, -1)
        self.common = self._matrix(owner, self.column[which])

    def _matrix(self, rows: np.ndarray, columns: np.ndarray, n: int | None = None) -> np.ndarray:
        out = np.zeros((len(self.sizes) if n is None else n, int(self.column.max(initial=-1)) + 1), np.float32)
        some = columns >= 0
        out[rows[some], columns[some]] = 1
        return out

    def intersections(self, sets: list[np.ndarray]) -> np.ndarray:
        """Sizes of the intersections, (others, own)."""
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(self.names, flat), len(self.names) - 1)
        hit = self.names[at] == flat
        at, row = at[hit], row[hit]
        out = self._matrix(row, self.column[at], len(sets)) @ self.common.T
        rare = self.column[at] < 0
        at, row = at[rare], row[rare]
        times = self.held[at]
        ends = np.cumsum(times)
        holder = self.holders[np.repeat(self.begins[at] - ends + times, times) + np.arange(int(times.sum()))]
        cells = np.bincount(np.repeat(row, times) * len(self.sizes) + holder, minlength=out.size)
        return np.rint(out).astype(np.int64) + cells.reshape(out.shape)


LINK = "a binary, b binary"


def _compared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links that join components.  Rows come ordered by cell (``key, size, cell``); its own sets, ``streams`` false, first."""
    at, cell, own, joined = None, None, [], {}

    def root(x: int) -> int:
        while x in joined:
            x = joined[x]
        return x

    for batch in tidy(batches):
        if not batch.num_rows:
            continue
        names = np.column_stack([batch.column(c).to_numpy() for c in ("key", "size", "cell")])
        comps, nodes = batch.column("comp").to_numpy(), batch.column("node")
        streams = batch.column("streams").to_numpy(zero_copy_only=False)
        column = batch.column("shingles")
        values, ends = column.flatten().to_numpy().view(np.uint64), np.asarray(column.offsets, np.int64)
        ends = ends - ends[0]
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1) | (streams[1:] != streams[:-1])) + 1).tolist(), batch.num_rows]
        links: list[tuple] = []
        for first, last in zip(cuts, cuts[1:], strict=False):
            if at != tuple(names[first]):
                at, cell, own, joined = tuple(names[first]), None, [], {}
            if not streams[first]:
                own += [(values[ends[i] : ends[i + 1]].copy(), int(comps[i]), nodes[i].as_py()) for i in range(first, last)]
                continue
            cell = cell or Cell([x[0] for x in own])
            mine = np.array([x[1] for x in own], np.int64)
            for a in range(first, last, CELL):
                rows = range(a, min(a + CELL, last))
                sets = [values[ends[i] : ends[i + 1]] for i in rows]
                both = cell.intersections(sets)
                sizes = np.array([len(s) for s in sets], np.int64)[:, None] + cell.sizes
                like = (100 * both >= percent * (sizes - both)) & (comps[rows.start : rows.stop, None] != mine)
                for i, k in zip(*np.nonzero(like), strict=True):
                    x, y = root(int(comps[a + i])), root(int(mine[k]))
                    if x != y:
                        joined[x] = y
                        links.append((nodes[a + int(i)].as_py(), own[k][2]))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in zip(*links, strict=True)], ["a", "b"])


def _finish(entries: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (``a, b``) between components of a bucket, without its centre, whose pairs are tried."""
    placed = entries.join(labels, "node")
    others = stored(placed.join(_centres(placed), "key").where("node <> m").select("key", "node", "n", F.xxhash64("comp").alias("comp")), "near-others")
    held = others.groupBy("key", "comp").agg(F.count("*").alias("k"))
    open_ = held.groupBy("key").agg(F.max_by("comp", F.struct("k", "comp")).alias("largest"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    growth = 100 / percent  # sets whose sizes are further apart than one class are not alike
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(growth))).cast("int").alias("size")
    members = stored(others.join(open_, "key").select("key", "node", "comp", size, (F.col("comp") != F.col("largest")).alias("outside")), "near-open")
    per_cell = F.greatest(F.lit(1), F.least(F.lit(CELL), F.floor(F.lit(float(CELL_SHINGLES)) / F.pow(F.lit(growth), F.col("size") + 1))))
    cells = members.where("outside").groupBy("key", "size").agg(F.count("*").alias("k")).select("key", "size", F.ceil(F.col("k") / per_cell).cast("int").alias("cells"))
    cells = stored(cells, "near-cells")
    placed = members.join(cells, ["key", "size"], "left").withColumn("home", F.when(F.col("outside"), F.pmod(F.xxhash64("node", "key"), "cells").cast("int")))
    own = placed.where("outside").select("key", "size", F.col("home").alias("cell"), F.lit(False).alias("streams"), "node", "comp")
    near = placed.drop("cells").withColumn("to", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
    past = near.join(cells.withColumnRenamed("size", "to"), ["key", "to"]).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    past = past.where(~F.col("outside") | (F.col("size") > F.col("to")) | ((F.col("size") == F.col("to")) & (F.col("home") >= F.col("cell"))))  # two outsiders meet once
    rows = own.unionByName(past.select("key", F.col("to").alias("size"), "cell", F.lit(True).alias("streams"), "node", "comp"))
    names = ["key", "size", "cell"]
    ordered = rows.join(sets, "node").repartition(*names).sortWithinPartitions(*names, "streams")
    return ordered.mapInArrow(lambda it: _compared(it, percent), LINK)


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` of every node of ``links`` (two columns): smallest label of the neighbours, then of the label's own label."""
    a, b = links.columns
    edges = stored(links.union(links.select(b, a)).toDF("node", "other").distinct(), "near-edges")
    labels = stored(edges.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("comp")), "near-labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("other"), F.col("comp").alias("c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        step = labels.withColumnRenamed("comp", "was").join(near, "node").select("node", "was", F.least("was", "c").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = stored(step.join(up, "comp", "left").select("node", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "near-labels")
        labels = new.select("node", "comp")
        if new.where("was <> comp").isEmpty():
            return labels


def _shared(entries: DataFrame) -> DataFrame:
    """The entries (``node, key``) of buckets with two members or more."""
    many = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return stored(entries.join(many, "key").select("key", "node"), "near-buckets")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (``node, n, comp``) with the components that ``links`` (``a, b``) connect as one."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("comp_a")), "a").join(labels.select(F.col("node").alias("b"), F.col("comp").alias("comp_b")), "b")
    joined = components(ends.select("comp_a", "comp_b").distinct()).toDF("comp", "to")
    return stored(labels.join(joined, "comp", "left").select("node", "n", F.coalesce("to", "comp").alias("comp")), "near-labels")


def _linked(docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame | None:
    """``node, comp`` of the nodes in buckets with others; None if no bucket has two."""
    entries = _shared(nodes.select("node", F.explode("bands").alias("key")))
    some = stored(entries.select("node").distinct().join(nodes.select("node", "home", "n"), "node"), "near-some")
    count = some.count()
    if not count:
        return None
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("name"))  # ids may be null or shared: a row goes by its text as well
    homes = some.select("node", F.col("home.doc_id").alias("rep"), F.col("home.name").alias("called"))
    named = texts.join(sized(homes, count), texts["doc_id"].eqNullSafe(F.col("rep")) & (F.col("name") == F.col("called"))).select("node", "text")
    sets = stored(named.mapInArrow(lambda it: _members(it, width), MEMBER).dropDuplicates(["node"]), "near-sets")
    labels = some.select("node", "n", F.col("node").alias("comp"))
    pairs = stored(_stars(entries.join(labels, "node"), percent), "near-pairs")
    links = stored(_confirmed(pairs, sets, percent), "near-links")
    if not links.isEmpty():
        labels = _merged(labels, links)
    links = stored(_finish(entries, labels, sets, percent), "near-links")
    return (labels if links.isEmpty() else _merged(labels, links)).select("node", "comp")


def _judged(docs: DataFrame, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, n_shingles, node, comp, component_id`` for each row of ``docs``; the last three are null without shingles."""
    sketch = stored(docs.select("doc_id", "text", F.xxhash64("text").alias("name")).mapInArrow(lambda it: _sketch(it, width, bands, rows), SKETCH), "near-sketch")
    some = sketch.where("node IS NOT NULL")
    nodes = stored(some.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), "name")).alias("home"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "near-nodes")
    labels = _linked(docs, nodes, width, percent)
    if labels is None:
        whole = nodes.select("node", F.col("node").alias("comp"), F.col("rep").alias("component_id"))
    else:
        placed = nodes.select("node", "rep").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = placed.groupBy("comp").agg(F.min("rep").alias("component_id"))
        whole = placed.join(least, "comp").select("node", "comp", "component_id")
    return sketch.select("doc_id", "n_shingles", "node").join(whole, "node", "left")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, node`` for each row of ``docs``.

    Links are pairs of shingle sets with 100 * intersection >= ``percent`` * union.  A null or empty text has no
    shingles and no links and is kept.  Rows with equal sets are linked, repeated rows too (all that carry the
    component's smallest doc_id are kept).  A null doc_id counts as larger than any.  Other columns play no part.
    """
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return _judged(docs, width, percent, bands, rows).select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "node")


def _noded(batches: Iterator[pa.RecordBatch], width: int, name: str) -> Iterator[pa.RecordBatch]:
    """The rows, each with the node of its text."""
    memo = _Memo()
    for batch in chunks(batches, "text"):
        sets = shingle_sets(texts_of(batch.column("text")), width, memo)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([node_of(s) if len(s) else None for s in sets], pa.binary())], [*batch.schema.names, name])


def first_of_each(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of ``docs``, all its columns, of each group of near duplicates: that of the smallest (doc_id, node).

    A null doc_id counts as larger than any.  Rows with equal ids and equal sets, empty ones too, are one: that of the
    smallest text.  Rows that share an id but no group don't touch each other.

    The ids to drop are far fewer than those to keep, so texts move only if there are too many to broadcast, and
    those of ids with several rows, some of which stay.
    """
    ident, several, node, own = fresh(docs, "near id", "near several", "near node", "near own")
    judged = _judged(docs, width, percent, bands, rows).groupBy(F.col("doc_id").alias("id"), "node", "comp").agg(F.count("*").alias("n"))
    texts = stored(judged, "near-verdicts")
    best = texts.where("node IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("best"))
    stays = texts.where("node IS NOT NULL").join(best, "comp").select("id", "node", "n", (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("node") == F.col("best.node"))).alias("kept"))
    stays = stored(stays.union(texts.where("node IS NULL").select("id", "node", "n", F.lit(True))), "near-stays")
    fates = stays.groupBy("id").agg(F.sum("n").alias("n"), F.count_if("kept").alias("k")).where("k = 0 OR n > 1").select(F.col("id").alias(ident), (F.col("k") > 0).alias(several))
    fates = stored(fates, "near-gone")
    count = fates.count()
    same = docs["doc_id"].eqNullSafe(F.col(f"`{ident}`"))
    out = docs.join(sized(fates, count), same, "left_anti")
    shared = fates.where(F.col(f"`{several}`"))
    if shared.isEmpty():
        return out
    schema = T.StructType([*docs.schema.fields, T.StructField(node, T.BinaryType())])
    noded = docs.join(sized(shared, count), same, "left_semi").mapInArrow(lambda it: _noded(it, width, node), schema)
    pick = stays.where("kept").join(sized(shared, count), F.col("id").eqNullSafe(F.col(f"`{ident}`"))).select(F.col("id").alias(ident), F.col("node").alias(own))
    pick = stored(pick, "near-several")
    held = noded.join(sized(pick, pick.count()), F.col("doc_id").eqNullSafe(F.col(f"`{ident}`")) & F.col(f"`{node}`").eqNullSafe(F.col(f"`{own}`")), "left_semi")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    ones = held.select(F.col("doc_id").alias("id"), F.col(f"`{node}`").alias("node"), F.coalesce("text", F.lit("")).alias("text"), row.alias("row"))
    ones = ones.groupBy("id", "node").agg(F.min_by("row", F.struct("text", F.to_json("row"))).alias("row"))
    return out.unionByName(ones.select("row.*"))
