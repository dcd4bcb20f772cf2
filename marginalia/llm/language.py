"""Language ID: multilingual mixture inference.

A language is a distribution of hashed byte trigrams, counted in words with a blank at both ends.  A text is a mixture
of languages: each word comes from one of them, with the likelihood of its trigrams.  Expectation-maximisation estimates
the proportions, until they settle; among the sets of the first 1, 2, ... languages by proportion, each fitted again on its
own, the one of highest log-likelihood less a penalty for each language is taken.  The prediction is its largest proportion.

The trigram tables are counted on at most ``PER_LANGUAGE`` texts of a language, those of smallest hash.  Every text is
predicted, from all of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import chunks, id_remainder, segment_starts, texts_of, words_of

PER_LANGUAGE = 1000
BITS = 16
#: What each trigram slot counts at least.
FLOOR = 0.5
#: Proportions settle when no step moves one of a text by so much, or after so many steps.
SETTLED, STEPS = 2e-3, 40
#: Log-likelihood that one more language must bring, times the logarithm of the number of words.
PENALTY = 2.0
LETTER = regex.compile(r"\p{L}")


def trigram_slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all words' trigrams end to end, and where each word's begin: one for each byte, blanks around a word."""
    buffer = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    code = buffer[:-2] << 16 | buffer[1:-1] << 8 | buffer[2:]
    middle = buffer[1:-1] != 32  # a blank between two words is nobody's middle
    slots = (code * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS))[middle]
    return slots.astype(np.int64), segment_starts(np.array([len(w) for w in words], np.int64))


COUNTS = "lang string, slot int, n long"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        by: dict[str, list[bytes]] = {}
        for text, lang in zip(texts_of(batch.column("text")), batch.column("lang").to_pylist(), strict=True):
            by.setdefault(lang, []).extend(words_of(text))
        for lang, words in by.items():
            if words:
                n = np.bincount(trigram_slots(words)[0], minlength=1 << BITS)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "slot", "n"])


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # (slot, language)


def fit(docs: DataFrame) -> Model:
    """Trigram tables of each language among the learning texts; one row for each slot and language comes to the driver."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (id_remainder(F.col("doc_id"), 4) != 2))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # Ids alone are ranked; texts of the chosen ones are read after.  PER_LANGUAGE rows of a language at most.
    chosen = known.select("doc_id", "lang").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PER_LANGUAGE)
    most = chosen.groupBy("lang").agg(F.max("rank").alias("r"), F.max_by(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id"), "rank").alias("last"))
    sample = known.join(F.broadcast(most), "lang").where((F.xxhash64("doc_id") < F.col("last.h")) | ((F.xxhash64("doc_id") == F.col("last.h")) & F.col("doc_id").eqNullSafe(F.col("last.doc_id")))).select("text", "lang")
    found = sample.mapInArrow(_counts, COUNTS).groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names, which = np.unique(np.array(found.column("lang").to_pylist(), object).astype(str), return_inverse=True) if found.num_rows else (np.array([]), np.array([], int))
    table = np.zeros((1 << BITS, len(names)))
    np.add.at(table, (found.column("slot").to_numpy(), which), found.column("n").to_numpy())
    return Model(names.tolist(), np.log((table + FLOOR) / (table + FLOOR).sum(axis=0)).astype(np.float32))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self)
        return out


def _mix(likely: np.ndarray, starts: np.ndarray, doc: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages in each text, and the log-likelihood of its words under them."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    sizes = np.diff(np.append(starts, len(likely)))
    moving = np.arange(len(starts)) if (allowed.sum(axis=1) > 1).any() else np.empty(0, np.int64)
    own, begin, owner = likely, starts, doc
    for _ in range(STEPS):
        if not len(moving):
            break
        joint = own * share[moving][owner]
        joint /= joint.sum(axis=1, keepdims=True) + np.float32(1e-30)
        new = np.add.reduceat(joint, begin, axis=0) / sizes[moving][:, None].astype(np.float32)
        still = np.abs(new - share[moving]).max(axis=1) > SETTLED
        share[moving] = new
        if not still.all():  # settled texts drop out
            words = np.repeat(still, sizes[moving])
            own, moving = own[words], moving[still]
            begin = segment_starts(sizes[moving])[:-1]
            owner = np.repeat(np.arange(len(moving)), sizes[moving])
    word = (likely * share[doc]).sum(axis=1) + np.float32(1e-30)
    return share, np.add.reduceat(np.log(word), starts)


def infer(texts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Each text's number of the largest language (-1 without words) and its proportion."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    numbers = _Numbers()
    tokens = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in tokens])
    full = np.flatnonzero(sizes)
    if not len(full) or not model.languages:
        return best, score
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(tokens)), np.int64, int(sizes.sum()))
    slots, begins = trigram_slots(list(numbers))
    logs = np.column_stack([np.add.reduceat(model.logs[:, k].take(slots), begins[:-1]) for k in range(len(model.languages))])
    likely = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -60)).astype(np.float32)[ids]
    starts = segment_starts(sizes[full])[:-1]
    doc = np.repeat(np.arange(len(full)), sizes[full])
    share, _ = _mix(likely, starts, doc, np.ones((len(full), len(model.languages)), np.float32))
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    taken, value = _mix(likely, starts, doc, (rank < 1).astype(np.float32))
    value = value - PENALTY * np.log(sizes[full] + 1)
    for k in range(2, len(model.languages) + 1):
        # A text that no set of k languages can make likelier by its penalty is done: every word at its best language is the most.
        open_ = np.flatnonzero(np.add.reduceat(np.log(likely.max(axis=1) + np.float32(1e-30)), starts) - PENALTY * k * np.log(sizes[full] + 1) > value)
        if not len(open_):
            break
        pick = np.isin(doc, open_)
        n = sizes[full][open_]
        own, log = _mix(likely[pick], segment_starts(n)[:-1], np.repeat(np.arange(len(open_)), n), (rank[open_] < k).astype(np.float32))
        worth = log - PENALTY * k * np.log(n + 1)
        better = worth > value[open_]
        taken[open_[better]], value[open_[better]] = own[better], worth[better]
    best[full] = taken.argmax(axis=1)
    score[full] = np.clip(taken.max(axis=1), 0, 1)
    return best, score


PREDICTED = "doc_id long, lang_pred string, score double"


def _predictions(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    names = np.array([*model.value.languages, "und"], object)
    for batch in chunks(batches, "text", 2 << 20):
        texts = texts_of(batch.column("text"))
        best, score = infer(texts, model.value)
        mute = np.array([not LETTER.search(t.decode("utf-8", "replace")) for t in texts])
        best[mute], score[mute] = -1, 0
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs`` (``doc_id, text, lang``).

    ``und`` with score 0 if the text is null or has no letter, or if there is nothing to learn from.  A null doc_id
    counts as the text '' for its remainder.  Repeated rows repeat; other columns play no part.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _predictions(it, sent), PREDICTED)
    return found.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
