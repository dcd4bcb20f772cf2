"""Toxicity: class-conditional Kneser-Ney models of toxic and ordinary text.

Each class has an interpolated Kneser-Ney model of its expressions (words without punctuation at their ends): counts of
word pairs back off to the number of different words that an expression follows, these to the same of its stem (its first
letters), and these to counts that both classes share.  Discounts are estimated from counts of counts, each class and
level its own.  The weight that a level passes on is the same for both classes, the larger of the two, so that an
expression that neither has seen is as likely in one as in the other, however unlike the classes are in size.

A text's evidence is its log-likelihood ratio for a word, over the whole text, and that of its strongest expression, which
counts by the number of different words it follows in toxic text.  A logistic curve turns both into a probability; it is
fitted on the evidence that each learning text has from the models of the other texts (``FOLDS`` parts by the text's
hash, so that copies share a part).

The models are fitted on at most ``PER_CLASS`` labelled texts of each class, those of smallest hash, equal ones once; they
are arrays of a fixed size.  Every text is scored, over all its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import chunks, id_remainder, mixed, segment_starts, stored

PER_CLASS = 3000
FOLDS = 4
STEM = 5
WORD_BITS, STEM_BITS, PAIR_BITS = 20, 18, 20
#: Words that a text's length counts more, so that a few words prove little; contexts that halve the strongest one's ratio.
EXTRA, RELIABLE = 10, 4
ENDS = b".,;:!?\"'()[]"
THRESHOLD = 0.7
#: The curve's slopes count as if they were seen to be flat so often, which matters for a few labels only.
DAMPING = 1.0
#: What every shared count has besides.
FLOOR = 0.5


def slots(word: bytes) -> int:
    """Slots of the expression and of its stem in one number."""
    word = word.strip(ENDS)
    stem = word if len(word) <= STEM else word.decode("utf-8", "replace")[:STEM].encode()
    return (xxhash.xxh3_64_intdigest(word) & (1 << WORD_BITS) - 1) << STEM_BITS | xxhash.xxh3_64_intdigest(stem) & (1 << STEM_BITS) - 1


#: The slot before a text's first word.
START = slots(b"") >> STEM_BITS


def pair_slots(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (mixed(before.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


@dataclass
class Tokens:
    """Texts' expressions: slots of the distinct ones, and which one each token is."""

    word: np.ndarray
    stem: np.ndarray
    which: np.ndarray
    sizes: np.ndarray  # tokens of each text

    @classmethod
    def of(cls, texts: pa.Array) -> Tokens:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
        words = lists.flatten()
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        full = pc.not_equal(words, "")  # white space at a text's ends leaves empty strings
        if not pc.all(full).as_py():
            gone = np.concatenate(([0], np.cumsum(~full.to_numpy(zero_copy_only=False))))
            cuts = segment_starts(sizes)
            sizes = sizes - (gone[cuts[1:]] - gone[cuts[:-1]])
            words = words.filter(full)
        coded = words.dictionary_encode()
        codes = np.fromiter(map(slots, coded.dictionary.cast(pa.binary()).to_pylist()), np.int64, len(coded.dictionary))
        return cls(codes >> STEM_BITS, codes & (1 << STEM_BITS) - 1, coded.indices.to_numpy().astype(np.int64), sizes)

    def before(self) -> np.ndarray:
        """Slot of the expression before each token."""
        out = np.append(START, self.word[self.which])[:-1] if len(self.which) else np.empty(0, np.int64)
        starts = segment_starts(self.sizes)[:-1]
        out[starts[self.sizes > 0]] = START
        return out


PAIRS = "toxic int, fold int, before int, word int, stem int, n long"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbours by class and fold, with the second one's stem and their number in the batch."""
    for batch in chunks(batches, "text"):
        tokens = Tokens.of(batch.column("text"))
        group = np.repeat(batch.column("toxic").to_numpy() * FOLDS + batch.column("fold").to_numpy(), tokens.sizes)
        rows, n = np.unique(np.column_stack((group, tokens.before(), tokens.word[tokens.which], tokens.stem[tokens.which])), axis=0, return_counts=True)
        cells = (rows[:, 0] // FOLDS, rows[:, 0] % FOLDS, *rows[:, 1:].T)
        yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in cells), pa.array(n)], ["toxic", "fold", "before", "word", "stem", "n"])


def discounts(counts: np.ndarray) -> np.ndarray:
    """Each class's discount, (class, 1): n1 / (n1 + 2 * n2); one half where a class has no such counts."""
    once, twice = ((counts == k).sum(axis=1, keepdims=True).astype(float) for k in (1, 2))
    return np.where((once > 0) & (twice > 0), once / np.maximum(once + 2 * twice, 1), 0.5)


class Packed:
    """A dataclass whose arrays, mostly zeros, travel compressed."""

    def __getstate__(self) -> dict:
        held = {f.name: getattr(self, f.name) for f in fields(self)}
        return {k: (v.dtype.str, v.shape, zstandard.compress(np.ascontiguousarray(v).tobytes(), 1)) if isinstance(v, np.ndarray) else v for k, v in held.items()}

    def __setstate__(self, state: dict) -> None:
        arrays = [f.name for f in fields(self) if f.type == "np.ndarray"]
        held = {k: np.frombuffer(zstandard.decompress(v[2]), v[0]).reshape(v[1]) if k in arrays else v for k, v in state.items()}
        self.__init__(**held)


@dataclass
class Model(Packed):
    """Smoothed models of both classes, from counts of (class, slot)."""

    pairs: np.ndarray
    tokens: np.ndarray  # of each expression as the one before
    types: np.ndarray  # different ones that follow it
    words: np.ndarray  # different ones that it follows
    stems: np.ndarray  # the same of all of a stem's expressions
    curve: tuple[float, ...] = ()

    def __post_init__(self):
        self.d2 = discounts(self.pairs)
        shared_stems = self.stems.sum(axis=0, dtype=np.int64)
        base = (shared_stems + FLOOR) / (shared_stems.sum() + FLOOR * len(shared_stems))
        self.share = (self.words.sum(axis=0, dtype=np.int64) + FLOOR).astype(np.float32), (shared_stems + FLOOR).astype(np.float32)
        rest, weight = self._level(self.stems)
        self.stem = (rest + weight * base).astype(np.float32)
        rest, self.passed = self._level(self.words)
        self.word = rest.astype(np.float32)

    @staticmethod
    def _level(counts: np.ndarray) -> tuple[np.ndarray, float]:
        """Discounted shares, and the weight that both classes pass on."""
        total = np.maximum(counts.sum(axis=1, keepdims=True, dtype=np.int64), 1)
        left = np.maximum(counts.astype(np.float32) - discounts(counts), 0)
        kept = left.sum(axis=1, keepdims=True)
        weight = float((1 - kept / total).max())
        return (1 - weight) * left / np.maximum(kept, 1e-9), weight

    def singles(self, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """Probability of expressions without the word before, (class, expression)."""
        share = np.minimum(1, self.share[0][word] / self.share[1][stem])
        return self.word[:, word] + self.passed * self.stem[:, stem] * share

    def ratios(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """log of P(expression | before, toxic) over the same, ordinary, for each token; each distinct one's by itself, by its contexts."""
        single = self.singles(tokens.word, tokens.stem)
        contexts = self.words[1, tokens.word].astype(float)
        strength = np.log(single[1] / single[0]) * contexts / (contexts + RELIABLE)
        before = tokens.before()
        seen = self.tokens[:, before].astype(float)
        left = seen - self.d2 * self.types[:, before]
        known = (left > 0).all(axis=0)
        weight = np.where(known, (1 - left / np.maximum(seen, 1)).max(axis=0), 1.0)
        rest = np.maximum(self.pairs[:, pair_slots(before, tokens.word[tokens.which])] - self.d2, 0) / np.maximum(left, 1e-9)
        both = np.where(known, (1 - weight) * rest, 0) + weight * single[:, tokens.which]
        return np.log(both[1] / both[0]), strength

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Ratio for a word, over each whole text, and that of its strongest expression: (text, 2)."""
        tokens = Tokens.of(texts)
        out = np.zeros((len(tokens.sizes), 2))
        full = np.flatnonzero(tokens.sizes)
        if len(full):
            ratio, strength = self.ratios(tokens)
            starts = segment_starts(tokens.sizes[full])[:-1]
            out[full, 0] = np.add.reduceat(ratio, starts) / (tokens.sizes[full] + EXTRA)
            out[full, 1] = np.maximum(np.maximum.reduceat(strength[tokens.which], starts), 0)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return probability(self.curve, self.evidence(texts))


class Slices:
    """An array, mostly zeros, compressed by its first axis; a slice is unpacked when it is asked for."""

    def __init__(self, array: np.ndarray):
        self.kind, self.shape = array.dtype.str, array.shape[1:]
        self.parts = [zstandard.compress(np.ascontiguousarray(x).tobytes(), 1) for x in array]

    def __getitem__(self, k: int) -> np.ndarray:
        return np.frombuffer(zstandard.decompress(self.parts[k]), self.kind).reshape(self.shape)


@dataclass
class Counts:
    """What the models are made of; a slice is a fold, or what is counted without a fold (the last: all)."""

    pairs: Slices
    tokens: Slices
    types: Slices
    words: Slices
    stems: Slices

    def model(self, without: int = FOLDS) -> Model:
        keep = [f for f in range(FOLDS) if f != without]
        both = (sum(x[f] for f in keep) for x in (self.pairs, self.tokens))
        return Model(*both, *(x[without] for x in (self.types, self.words, self.stems)))


def counted(pairs: DataFrame) -> Counts:
    """Tables of ``pairs`` (``PAIRS``, several rows of a pair allowed); each collect has at most the table's own slots."""
    folds = [F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).cast("int").alias(f"f{f}") for f in range(FOLDS)]
    distinct = stored(pairs.groupBy("toxic", "before", "word", "stem").agg(*folds), "toxic-pairs")
    without = [F.count_if(F.expr(" + ".join(f"f{g}" for g in range(FOLDS) if g != f)) > 0).cast("int").alias(f"t{f}") for f in range(FOLDS)] + [F.count("*").cast("int").alias(f"t{FOLDS}")]
    sums = [F.sum(f"f{f}").cast("int").alias(f"s{f}") for f in range(FOLDS)]

    def table(by: str, size: int, cells: list, kind=np.uint32) -> np.ndarray:
        found = distinct.groupBy("toxic", by).agg(*cells).toArrow()
        out = np.zeros((len(cells), 2, size), kind)
        at = found.column("toxic").to_numpy(), found.column(by).to_numpy()
        for k in range(len(cells)):
            out[k][at] = found.column(k + 2).to_numpy()
        return out

    by_context = table("before", 1 << WORD_BITS, sums + without)
    arrays = _pair_table(distinct), by_context[:FOLDS], by_context[FOLDS:], table("word", 1 << WORD_BITS, without), table("stem", 1 << STEM_BITS, without)
    return Counts(*map(Slices, arrays))


def _slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot = pair_slots(batch.column("before").to_numpy(), batch.column("word").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(slot.astype(np.int32)), *(batch.column(f"f{f}") for f in range(FOLDS))], ["toxic", "slot", *(f"f{f}" for f in range(FOLDS))])


def _pair_table(distinct: DataFrame) -> np.ndarray:
    slotted = distinct.mapInArrow(_slotted, "toxic int, slot int, " + ", ".join(f"f{f} int" for f in range(FOLDS)))
    found = slotted.groupBy("toxic", "slot").agg(*(F.sum(f"f{f}").cast("int").alias(f"s{f}") for f in range(FOLDS))).toArrow()
    out = np.zeros((FOLDS, 2, 1 << PAIR_BITS), np.uint32)
    at = found.column("toxic").to_numpy(), found.column("slot").to_numpy()
    for f in range(FOLDS):
        out[f][at] = found.column(f + 2).to_numpy()
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Means, scales and coefficients of a weighted, damped logistic curve, by Newton's steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack((np.ones(len(x)), (x - mean) / scale))
    b, damp = np.zeros(z.shape[1]), DAMPING * np.eye(z.shape[1])
    damp[0, 0] = 1e-2
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        b += np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + damp, z.T @ (weight * (y - p)) - damp @ b)
    return (*mean, *scale, *b)


def probability(curve: tuple[float, ...], x: np.ndarray) -> np.ndarray:
    mean, scale, b = np.array(curve[:2]), np.array(curve[2:4]), np.array(curve[4:])
    return 1 / (1 + np.exp(-np.clip(b[0] + (x - mean) / scale @ b[1:], -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Labelled learning texts (``text, toxic, fold``), at most PER_CLASS ids of a class; labelled ids of each class."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(id_remainder(F.col("doc_id"), 3) != 1)
    counts = {r.toxic: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ids = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS) for c in (0, 1)]  # 2 * PER_CLASS rows at most
    rows = docs.select("doc_id", "text").join(F.broadcast(ids[0].union(ids[1])), "doc_id")
    rows = rows.select("toxic", "text", F.xxhash64("text").alias("hash")).dropDuplicates(["toxic", "hash"])
    return rows.select("text", "toxic", F.pmod("hash", F.lit(FOLDS)).cast("int").alias("fold")), counts


def _evidences(batches: Iterator[pa.RecordBatch], counts) -> Iterator[pa.RecordBatch]:
    """Each learning text's evidence from the models without its fold; rows come ordered by fold."""
    own = {}
    for batch in chunks(batches, "text"):
        folds = batch.column("fold").to_numpy()
        for f in np.unique(folds).tolist():
            if f not in own:
                own = {f: counts.value.model(f)}
            part = batch.filter(pa.array(folds == f))
            x = own[f].evidence(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(x[:, 0]), pa.array(x[:, 1])], ["toxic", "mean", "best"])


def fit(docs: DataFrame, labels: DataFrame) -> Model | float:
    """The models, or the share of toxic labels if there is no text of both classes to learn from."""
    sample, labelled = _sample(docs, labels)
    sample = stored(sample, "toxic-sample")
    everything = sum(labelled.values())
    share = labelled.get(1, 0) / everything if everything else 0.0
    counts = counted(sample.mapInArrow(_pairs, PAIRS))
    if not (counts.words[FOLDS].sum(axis=1) > 0).all():
        return share
    sent = docs.sparkSession.sparkContext.broadcast(counts)
    rows = sample.repartition(FOLDS, "fold").sortWithinPartitions("fold").mapInArrow(lambda it: _evidences(it, sent), "toxic int, mean double, best double").toArrow()
    sent.destroy()
    y = rows.column("toxic").to_numpy().astype(float)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))  # the sample has other shares than the labels
    model = counts.model()
    model.curve = logistic(np.column_stack((rows.column("mean").to_numpy(), rows.column("best").to_numpy())), y, weight)
    return model


SCORED = "doc_id long, score double"


def _scores(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.scores(batch.column("text")), pa.float64())], ["doc_id", "score"])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Labels other than 0 and 1 and of a null doc_id are ignored; if an id has several, toxic wins.  A null text is empty
    and has no evidence.  A null doc_id counts as the text '' for its remainder.  Without texts of both classes every
    score is the share of toxic labels (0 without labels).  Repeated rows repeat; other columns play no part.
    """
    held = id_remainder(F.col("doc_id"), 3) == 1
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if isinstance(model, float):
        scored = rows.select("doc_id", F.lit(model).alias("score"))
    else:
        sent = docs.sparkSession.sparkContext.broadcast(model)
        scored = rows.mapInArrow(lambda it: _scores(it, sent), SCORED)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, that are not predicted to be toxic.

    Null and empty texts have no evidence and stay, repeated rows stay or go together, an empty table stays empty; labels
    count as in ``score``.  Without texts of both classes all rows stay unless the share of toxic labels is ``THRESHOLD``.
    """
    model = fit(docs, labels)
    if isinstance(model, float):
        return docs if model < THRESHOLD else docs.limit(0)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield batch.filter(pa.array(sent.value.scores(batch.column("text")) < THRESHOLD))

    return docs.mapInArrow(ordinary, docs.schema)
