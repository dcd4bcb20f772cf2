"""Joins, guards and set operations over annotated records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.sources.shared import stored


def or_all(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that match; all rows if none does.  One plan: the guard is a one-row aggregate."""
    hit = df.agg(F.bool_or(F.coalesce(condition, F.lit(False))).alias("_hit"))
    return df.join(F.broadcast(hit)).where(condition | ~F.coalesce("_hit", F.lit(False))).drop("_hit")


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def first_n(df: DataFrame, keys: Sequence[str], n: int, *order: Column, rank: str | None = None) -> DataFrame:
    """The first n rows of each key in the given order, numbered from 1 in the column ``rank`` if it is named."""
    ranked = df.withColumn(rank or "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("int"))
    kept = ranked.where(F.col(rank or "_rank") <= n)
    return kept if rank else kept.drop("_rank")


def union_first_wins(parts: Sequence[DataFrame], key: str, seq: str) -> DataFrame:
    """All parts, one row for each non-blank key: of the earliest part, and there the earliest row."""
    out = None
    for i, part in enumerate(parts):
        own = part.withColumn("_part", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    kept = out.where(F.nullif(F.trim(F.col(key).cast("string")), F.lit("")).isNotNull())
    return first_by(kept, [key], F.col("_part"), F.col(seq)).drop("_part")


def union_last_wins(parts: Sequence[DataFrame], key: str, seq: str) -> DataFrame:
    return union_first_wins(list(reversed(parts)), key, seq)


def anti_join_any(new: DataFrame, old: DataFrame, keys: Sequence[Sequence[str]]) -> DataFrame:
    """Rows of ``new`` that share none of the composite keys with a row of ``old``."""
    for key in keys:
        new = new.join(old.select(*key).distinct(), list(key), "left_anti")
    return new


def token_overlap(a: Column, b: Column) -> Column:
    """Shared distinct tokens over the larger number of distinct tokens."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most > 0, F.size(F.array_intersect(x, y)) / most).otherwise(F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """100 times one minus the edit distance over the longer length, rounded; 100 for two empty texts."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(100.0)).otherwise(F.round(100.0 * (F.lit(1.0) - F.levenshtein(a, b) / most), 6))


def decision(score: Column, linked: float = 85, review: float = 70) -> Column:
    return F.when(score >= linked, "linked").when(score >= review, "review").otherwise("unlinked")


def held_names(names: DataFrame, column: str) -> DataFrame:
    """``inner, outer``: every name and the names that hold it, whatever their case; also each name and itself.

    The inner name's first three characters must be among the outer one's substrings of up to three, so it is an
    equi-join on those.
    """
    known = names.where(F.col(column) != "").select(F.col(column).alias("name"), F.lower(column).alias("low")).distinct()
    at = F.sequence(F.lit(1), F.length("low"))
    grams = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(*(F.substr("low", i, F.lit(k)) for k in (1, 2, 3))))))
    inner = known.select(F.col("name").alias("inner"), F.col("low").alias("low_inner"), F.substring("low", 1, 3).alias("gram"))
    outer = known.select(F.col("name").alias("outer"), F.col("low").alias("low_outer"), F.explode(grams).alias("gram"))
    return inner.join(outer, "gram").where(F.col("low_outer").contains(F.col("low_inner"))).select("inner", "outer").distinct()


def held_texts(inner: DataFrame, outer: DataFrame, inner_id: str, outer_id: str) -> DataFrame:
    """(inner id, outer id) where the outer row's ``text`` holds the inner one's, of five words or more.

    The inner text's second to fourth word are whole words of the outer one, so it is an equi-join on word triples.
    """
    words = F.split("text", " ")
    triple = lambda w, i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    small = inner.select(inner_id, words.alias("w")).where(F.size("w") >= 5).select(inner_id, triple(F.col("w"), F.lit(1)).alias("gram"))
    large = outer.select(outer_id, words.alias("w")).where(F.size("w") >= 5)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: triple(F.col("w"), i)))
    pairs = large.select(outer_id, F.explode(grams).alias("gram")).join(small, "gram").select(inner_id, outer_id).distinct()  # ids alone travel by gram
    found = pairs.join(inner.select(inner_id, F.col("text").alias("held")), inner_id).join(outer.select(outer_id, "text"), outer_id)
    return found.where(F.col("text").contains(F.col("held"))).select(inner_id, outer_id).distinct()


def overlapping(small: DataFrame, large: DataFrame, small_id: str, large_id: str, least: float, larger: bool = False) -> DataFrame:
    """(small id, large id, overlap) of rows whose distinct words ``t`` overlap by ``least`` of the small one's, or of the larger set's.

    Of a set's rarest words, so many that a partner cannot miss them all, one at least is shared: the join is on those,
    and full sets are compared for its pairs only.
    """
    able = lambda n, m: F.least(n, m) >= F.greatest(n, m) * least - 1e-9 if larger else F.lit(True)  # of the larger set a smaller one can't fill so much
    if larger and least > 0:
        ends = small.where(F.size("t") > 0).agg(F.min(F.size("t")).alias("_from"), F.max(F.size("t")).alias("_to"))  # one row
        once = large.select(large_id, F.inline(F.array(F.struct("t"))))  # a row's words are made once, not again for each condition
        fit = once.join(F.broadcast(ends)).where((F.size("t") >= F.col("_from") * least - 1e-9) & (F.size("t") * least <= F.col("_to") + 1e-9))
        large = stored(fit.select(large_id, "t"), "overlap-sets")
    words = small.select(small_id, F.size("t").alias("n"), F.explode("t").alias("w"))
    known = large.select(large_id, F.size("t").alias("m"), F.explode("t").alias("w"))
    counts = known.join(words.select("w").distinct(), "w").groupBy("w").agg(F.count("*").alias("df"))
    order = Window.partitionBy(small_id).orderBy(F.coalesce("df", F.lit(0)), "w")
    rare = words.join(counts, "w", "left").withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.floor(F.col("n") * (1 - least) + 1e-9) + 1)
    pairs = rare.where("df > 0").select(small_id, "n", "w").join(known, "w").where(able(F.col("n"), F.col("m"))).select(small_id, large_id).distinct()
    full = pairs.join(small.select(small_id, F.col("t").alias("a")), small_id).join(large.select(large_id, F.col("t").alias("b")), large_id)
    size = F.greatest(F.size("a"), F.size("b")) if larger else F.size("a")
    overlap = F.size(F.array_intersect("a", "b")) / size
    return full.select(small_id, large_id, overlap.alias("raw")).where(F.col("raw") >= least).select(small_id, large_id, F.round("raw", 6).alias("overlap"))
