"""Best matches by weighted similarity, exact over all pairs of a block, in groups of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import fuzzy as Z
from marginalia.operators import joins as J
from marginalia.sources.shared import stored

#: Keys of a group on either side, and left ones of a small block's, so that it spreads over ``SPREAD`` groups.
LEFT, RIGHT = 16_384, 32_768
FEW, SPREAD = 1024, 16
#: Tasks for the groups at most.
TASKS = 20_000
#: Names that say nothing, and the mark between a name and a text in a composite key.
UNKNOWN, MARK = ("unknown", "مجهول", ""), " :: "


def is_unknown(name: Column) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit("")))).isin(*UNKNOWN)


def composite_key(name: Column, text: Column) -> Column:
    """The name and the text; the text alone where the name is unknown."""
    return F.when(is_unknown(name), text).otherwise(F.concat(F.trim(name), F.lit(MARK), text))


def best_matches(left: DataFrame, right: DataFrame, left_id: str, right_id: str, on: Sequence[str] = (), floor: float = 70.0) -> DataFrame:
    """(left id, right id, score): each left row's best right one by the ``weighted`` score of their ``key``, if it is ``floor`` or more.

    Only rows that agree ``on`` the given columns are compared (null agrees with null); of equal scores the smallest right
    id wins.  Equal keys are scored once.  Keys of a block are dealt into groups of about ``LEFT`` and ``RIGHT``, every left
    group meets every right one of its block, and each pair of groups is a task's unit: a block of any size spreads.  So the
    pairs looked at are those of a block, all of them if there is none; most are told apart by a bound, see ``fuzzy.best``.
    Null and empty keys match nothing; the floor is above 0.
    """
    if floor <= 0:
        raise ValueError("a floor is above 0")
    names = [f"_on{k}" for k in range(len(on))] or ["_on0"]
    keyed = lambda df, *more: df.where("key <> ''").select(*(F.col(c).alias(n) for c, n in zip(on or [F.lit(0)], names, strict=True)) if on else (F.lit(0).alias("_on0"),), "key", *more)
    rows = stored(keyed(left, F.col(left_id).alias("_left")), "match-left")
    a = rows.select(*names, "key").distinct()
    b = stored(keyed(right, right_id).groupBy(*names, "key").agg(F.min(right_id).alias("_id")), "match-right")
    parts = lambda df, size, name: df.groupBy(*names).agg(F.ceil(size(F.count("*"))).cast("int").alias(name))
    same = lambda x, y: [x[n].eqNullSafe(y[f"{n}s"]) for n in names]
    renamed = lambda df: df.select(*(F.col(n).alias(f"{n}s") for n in names), *(c for c in df.columns if c not in names))
    n_a = parts(a, lambda n: F.greatest(n / LEFT, F.least(n / FEW, F.lit(float(SPREAD)))), "_na")
    n_b = renamed(parts(b, lambda n: n / RIGHT, "_nb"))
    sizes = renamed(n_a.join(n_b, same(n_a, n_b)).select(*names, "_na", "_nb"))
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    x = a.join(sizes, same(a, sizes)).select(*names, "key", own("_na").alias("_l"), F.explode(to("_nb")).alias("_r"))
    y = b.join(sizes, same(b, sizes)).select(*names, "key", "_id", own("_nb").alias("_r"), F.explode(to("_na")).alias("_l"))
    fields = {f.name: f for f in x.schema.fields} | {f.name: f for f in y.schema.fields}
    out = ", ".join(f"{n} {fields[n].dataType.simpleString()}" for n in [*names, "key", "_id"]) + ", score double"

    def scored(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        theirs = theirs.sort_by("_id")
        score, which = Z.best(mine.column("key").to_pylist(), theirs.column("key").to_pylist(), floor)
        hit = pa.array(which >= 0)
        found = mine.select([*names, "key"]).filter(hit)
        return found.append_column("_id", theirs.column("_id").take(pa.array(which[which >= 0]))).append_column("score", pa.array(score[which >= 0]))

    group = [*names, "_l", "_r"]
    groups = sizes.agg(F.sum(F.col("_na").cast("long") * F.col("_nb"))).first()[0] or 1  # one number; a group is work enough for a task, and few share one
    x, y = (side.repartition(min(4 * groups, TASKS), *group) for side in (x, y))
    met = x.groupBy(*group).cogroup(y.groupBy(*group)).applyInArrow(scored, out)
    best = renamed(met.groupBy(*names, "key").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("_id").alias("i"))).alias("_b")).withColumnRenamed("key", "_key"))
    joined = rows.join(best, [rows["key"] == best["_key"], *same(rows, best)])
    return joined.select(F.col("_left").alias(left_id), F.col("_b.i").alias(right_id), (-F.col("_b.s")).alias("score"))


def linked(records: DataFrame, known: DataFrame, record_id: str, known_id: str, linked_at: float = 85, review_at: float = 70, floor: float = 0.30) -> DataFrame:
    """(record id, known id, score, confidence, decision) of every record; both sides have ``name`` and ``text``.

    A record is linked to the known one whose composite key is most like its own.  Where the record's name is unknown and
    the two texts share less than ``floor`` of the larger one's words, the score is held under ``review_at``.  A record
    without a match of ``review_at`` has no known id and no score, and a confidence of 0; a record id is expected once.
    """
    keys = lambda df, i: df.select(i, composite_key(F.col("name"), F.col("text")).alias("key"))
    best = best_matches(keys(records, record_id), keys(known, known_id), record_id, known_id, floor=review_at)
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    theirs = known.select(F.col(known_id), F.col("text").alias("_theirs"))
    full = records.select(record_id, "name", "text").join(best, record_id, "left").join(theirs, known_id, "left")
    veto = is_unknown(F.col("name")) & (J.token_overlap(words("text"), words("_theirs")) < floor)
    score = F.when(~veto, F.round("score", 6))  # a vetoed score is under the limit
    rows = full.withColumn("score", score).withColumn(known_id, F.when(F.col("score").isNotNull(), F.col(known_id)))
    return rows.select(record_id, known_id, "score", F.coalesce(F.round(F.col("score") / 100, 4), F.lit(0.0)).alias("confidence"), J.decision(F.coalesce("score", F.lit(0.0)), linked_at, review_at).alias("decision"))


def resolved(hints: DataFrame, members: DataFrame, hint: str, name: str, floor: float = 60.0) -> DataFrame:
    """(hint, name, tier) of hints that find a member: the same name (0), as a part of it (1), by ``partial`` score of at least ``floor`` (2).

    Whatever their case; the first tier wins, there the higher score, then the smaller name.  Members are a small dimension,
    hints any number: each hint meets every member, ``RIGHT`` of them in a task's unit.
    """
    m = members.select(F.col(name).alias("_name")).where("_name <> ''").distinct()
    parts = m.agg(F.ceil(F.count("*") / RIGHT).cast("int").alias("_n"))  # one row
    y = m.join(F.broadcast(parts)).select("_name", F.pmod(F.xxhash64("_name"), "_n").cast("int").alias("_r"))
    h = hints.select(F.col(hint).alias("_hint")).where("_hint <> ''").distinct()
    x = h.join(F.broadcast(parts)).where("_n > 0").select("_hint", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_r"), F.pmod(F.xxhash64("_hint"), F.lit(64)).alias("_l"))
    y = y.select("_name", "_r", F.explode(F.sequence(F.lit(0), F.lit(63)).cast("array<bigint>")).alias("_l"))

    def scored(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        theirs = theirs.sort_by("_name")
        asked, held = mine.column("_hint").to_pylist(), theirs.column("_name").to_pylist()
        low = [n.lower() for n in held]
        rows = []
        for k in range(0, len(asked), 256):
            part = asked[k : k + 256]
            scores = Z.partial_scores([q.lower() for q in part], low) if held else None
            for i, q in enumerate(part):
                tiers = [(0, 0.0, n) if q.lower() == p else (1, 0.0, n) if q.lower() in p else (2, -float(scores[i, j]), n) for j, (n, p) in enumerate(zip(held, low, strict=True))]
                best = min((t for t in tiers if t[0] < 2 or -t[1] >= floor), default=None)
                if best:
                    rows.append((q, best[2], best[0], -best[1]))
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("_hint", pa.string()), ("_name", pa.string()), ("tier", pa.int32()), ("_score", pa.float64())))})

    met = x.groupBy("_l", "_r").cogroup(y.groupBy("_l", "_r")).applyInArrow(scored, "_hint string, _name string, tier int, _score double")
    best = J.first_by(met, ["_hint"], F.col("tier"), F.desc("_score"), F.col("_name"))
    return best.select(F.col("_hint").alias(hint), F.col("_name").alias(name), "tier")
