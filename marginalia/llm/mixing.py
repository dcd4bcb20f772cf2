"""Mixing sources to target weights: hash-threshold histograms.

A source's target over its size tells how many whole times every document is taken; what is left of the target is the
budget of one more time, for the documents whose hash is below a threshold.  Sums of words by source and hash bucket
find the bucket in which the budget ends; only that bucket is split again, bit group by bit group, until a bucket is a
single hash.  No sort of the documents, and no more state than a histogram for each source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import WORD, sized, stored

WEIGHTS = (5, 2, 1)
#: A document is taken at most so many times.
MOST = 3
#: Bits of a document's hash, and bits that one histogram resolves.
HASH_BITS, STEP_BITS = 60, 10


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of id, blank and text; null counts as empty.  Only rows equal in both share it."""
    key = F.concat_ws(" ", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` for ``totals`` (``source, source_size``), one row for each source.

    Weights repeat over the sources by code point, null last.  A target stops at ``most`` times its source's size and the
    excess is shared again by weight, until none is above: with the sources by size over weight, the stopped ones come
    first, so running sums say for each source whether the share stops there.
    """
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    known = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(most))
    whole = Window.partitionBy()
    upto = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    sums = known.select(
        "*", F.sum("source_size").over(whole).alias("all"), F.sum("weight").over(whole).alias("weights"),
        F.coalesce(F.sum("most").over(upto), F.lit(0.0)).alias("stopped"), F.coalesce(F.sum("weight").over(upto), F.lit(0.0)).alias("gone"),
    )
    share = (F.col("all") - F.col("stopped")) / (F.col("weights") - F.col("gone"))
    free = sums.withColumn("share", share).withColumn("free", F.col("most") >= F.col("share") * F.col("weight"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("weight"), "rank", "share"))).over(whole)["share"]
    return free.select("source", "source_size", F.least(F.col("most"), F.col("weight") * level).cast("double").alias("target"))


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``source, times, edge, alike, more``: every document is taken ``times`` times, and once more if its hash is under ``edge``.

    Of the ``alike`` rows at the edge, the single hash in which the budget ends, so many are taken once more (``more``) as bring the
    sum nearest to the target; they are equal in id and text, so which ones does not matter.
    """
    budget = F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")
    state = wanted.where(F.col("source_size") > 0).select("source", F.floor(F.col("target") / F.col("source_size")).cast("long").alias("times"), budget.alias("left"), F.lit(0).cast("long").alias("prefix"))
    rows = sizes.where(F.col("size") > 0)
    for bits in range(STEP_BITS, HASH_BITS + 1, STEP_BITS):
        low = HASH_BITS - bits
        at = F.shiftright("hash", low)
        if bits == STEP_BITS:
            inside = rows.select("source", "size", at.alias("bucket"))
        else:  # only the bucket in which a source's budget ends goes on
            inside = rows.join(state.select("source", "prefix"), rows["source"].eqNullSafe(state["source"])).where(F.shiftright("hash", low + STEP_BITS) == F.col("prefix")).select(rows["source"], "size", at.alias("bucket"))
        histogram = inside.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        summed = histogram.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
        joined = summed.join(state.select(F.col("source").alias("s"), "times", "left"), F.col("source").eqNullSafe(F.col("s")))
        ends = joined.where(F.col("before") <= F.col("left")).groupBy("source", "times").agg(F.max_by(F.struct((F.col("left") - F.col("before")).alias("left"), F.col("bucket").alias("prefix"), "words", "rows"), "bucket").alias("m"))
        state = stored(ends.select("source", "times", "m.left", "m.prefix", "m.words", "m.rows"), f"mix-{bits}")
    return state.select("source", "times", F.col("prefix").alias("edge"), F.col("rows").alias("alike"), F.least(F.col("rows"), F.floor(F.col("left") * F.col("rows") / F.col("words") + 0.5)).cast("long").alias("more"))


def _plan(docs: DataFrame, weights: Sequence[float], most: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, source, size, hash`` of every row, and ``key, source_size, target, times, edge, alike, more`` of every source."""
    sizes = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), order_hash(F.col("doc_id"), F.col("text")).alias("hash")), "mix-sizes")
    totals = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    wanted = stored(targets(totals, weights, most), "mix-targets")
    cut = thresholds(sizes, wanted)
    plan = wanted.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumnRenamed("source", "key")
    return sizes, sized(plan, totals.count())


def _counted(rows: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """``rows`` (``source, size, hash`` among their columns) with their source's plan and ``n``, how often each is taken.

    Only rows at a source's edge are numbered: those that are equal in id and text.
    """
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("key"))).drop("key")
    at_edge = (F.col("size") > 0) & (F.col("hash") == F.col("edge"))
    both = joined.withColumn("number", F.lit(1))
    if not plan.where("alike > 1").isEmpty():
        numbered = joined.where(at_edge).withColumn("number", F.row_number().over(Window.partitionBy("source").orderBy("hash")))
        both = both.where(~F.coalesce(at_edge, F.lit(False))).unionByName(numbered)
    once_more = F.coalesce((F.col("hash") < F.col("edge")) | ((F.col("hash") == F.col("edge")) & (F.col("number") <= F.col("more"))), F.lit(False))
    times = F.least(F.lit(most), F.coalesce("times", F.lit(0)) + once_more.cast("int"))
    return both.withColumn("n", F.when(F.col("size") > 0, times).otherwise(0).cast("int"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row of ``docs``.

    A null or empty text has size 0 and is not taken; null is a source of its own; a source without words has target 0.
    Rows equal in id and text are told apart by a number only, so a rerun takes as many of them.  Other columns of
    ``docs`` play no part; an empty table gives an empty result.
    """
    sizes, plan = _plan(docs, weights, most)
    return _counted(sizes, plan, most).select("doc_id", "size", "source_size", "target", (F.col("n") * F.col("size")).cast("long").alias("taken"))


def mixture(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of ``docs``, all their columns, each as often as the mix takes it: copies count as taken.

    Texts without words, null ones too, are never taken.  Nulls, ties and repeated rows go as in ``mix``.
    """
    _, plan = _plan(docs, weights, most)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, "source", order_hash(F.col("doc_id"), F.col("text")).alias("hash"), n_words(F.col("text")).alias("size"))
    taken = _counted(rows, plan, most).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("n"))
    return taken.select(*(F.col("row")[c].alias(c) for c in docs.columns))
