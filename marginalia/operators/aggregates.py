"""Aggregations over a registry of annotated records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.sources.shared import stored


def filled(c: str | Column) -> Column:
    """A trimmed text, null where nothing is left of it: '' and blanks count as missing."""
    return F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))


def top_by_count(df: DataFrame, key: str, seq: str, n: int, out: str = "n") -> DataFrame:
    """The n most frequent values; of equally frequent ones the one seen first."""
    counts = df.where(filled(key).isNotNull()).groupBy(key).agg(F.count("*").alias(out), F.min(seq).alias("_first"))
    return counts.orderBy(F.desc(out), "_first").limit(n).drop("_first")


def zero_filled(labels: Sequence[str], counted: DataFrame, key: str, out: str = "n") -> DataFrame:
    """Counts of the closed list of labels, 0 where a label does not occur."""
    spark = counted.sparkSession
    closed = spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in labels))).alias(key))
    return closed.join(counted, key, "left").select(key, F.coalesce(out, F.lit(0)).cast("long").alias(out))


def multi_label_counts(df: DataFrame, array: str, labels: Sequence[str]) -> DataFrame:
    counted = df.select(F.explode(array).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return zero_filled(labels, counted, "label")


def banded(value: Column, bounds: Sequence[float], names: Sequence[str]) -> Column:
    """The first band whose upper bound lies above the value; the last name if none does."""
    out = F
    for bound, name in zip(bounds, names, strict=False):
        out = out.when(value < bound, name)
    return out.otherwise(names[-1])


def span(df: DataFrame, start: str, end: str) -> DataFrame:
    """First and last year, their distance and a coverage text; 0 counts as missing."""
    lo, hi = F.min(F.nullif(F.col(start), F.lit(0))), F.max(F.nullif(F.col(end), F.lit(0)))
    return df.agg(lo.alias("first_year"), hi.alias("last_year")).select(
        "first_year", "last_year", (F.col("last_year") - F.col("first_year")).alias("years"), F.concat_ws("-", F.col("first_year").cast("string"), F.col("last_year").cast("string")).alias("coverage")
    )


def ranked_groups(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Every group's count and rank by count, ties by first occurrence.  Only one row for each group is ranked."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"), F.min(seq).alias("_first"))
    return counts.select(key, "n", F.row_number().over(Window.orderBy(F.desc("n"), "_first")).cast("int").alias("rank"))


def ordered_text(df: DataFrame, keys: Sequence[str], seq: str, text: str, glue: str = " | ") -> DataFrame:
    """Each group's texts in order, joined."""
    items = F.transform(F.sort_array(F.collect_list(F.struct(seq, text))), lambda x: x[text])
    return df.groupBy(*keys).agg(F.array_join(items, glue).alias("joined"))


#: Buckets of a histogram, and values of a bucket that are numbered in the end.
BUCKETS, LEAF = 1024, 4096


def upper_rank(share: float) -> Callable[[Column], Column]:
    """The place ``min(int(n * share), n - 1)`` among n sorted values."""
    return lambda n: F.least(F.floor(n * F.lit(share)), n - 1)


def median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Each group's middle value, or what lies midway between the two middle ones, as ``selected`` finds them."""
    low = selected(df, keys, value, lambda n: F.floor((n - 1) / 2), "_low")
    high = selected(df, keys, value, lambda n: F.floor(n / 2), "_high").select(*(F.col(k).alias(f"_h{k}") for k in keys), "_high")
    both = low.join(high, [F.col(k).eqNullSafe(F.col(f"_h{k}")) for k in keys])
    return both.select(*keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * 0.5).alias(name))


def selected(df: DataFrame, keys: Sequence[str], value: str, rank: Callable[[Column], Column], name: str) -> DataFrame:
    """For each group the element at place ``rank`` (from 0, of the number of values) of its sorted values, exact and without sorting groups.

    A histogram over the values' range tells the bucket that holds the rank; only that bucket's values go on to the next,
    finer one, until it holds one value or at most ``LEAF``, which are numbered.  A histogram is added up before it is
    shuffled, so that a group of any size is spread over tasks.  Nulls, NaN and infinities are left out; a group without
    values gives no row; null keys are a group.
    """
    marks = [f"_k{i}" for i in range(len(keys))]
    numbers = df.select(*(F.col(k).alias(m) for k, m in zip(keys, marks, strict=True)), F.col(value).cast("double").alias("_v")).where("_v < double('infinity') AND _v > double('-infinity')")
    names = [f"_s{m}" for m in marks]
    same = [F.col(m).eqNullSafe(F.col(n)) for m, n in zip(marks, names, strict=True)]
    state = numbers.groupBy(*(F.col(m).alias(n) for m, n in zip(marks, names, strict=True))).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    state = stored(state.select(*names, "n", "lo", "hi", rank(F.col("n")).cast("long").alias("at")), "selected")
    open_ = (F.col("lo") < F.col("hi")) & (F.col("n") > LEAF)
    inside = (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))
    while not state.where(open_).isEmpty():
        bucket = F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS), F.lit(BUCKETS - 1))
        held = numbers.join(state.where(open_), same).where(inside).groupBy(*names, "at", bucket.alias("_b")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*names).orderBy("_b"))  # BUCKETS rows at most
        hit = held.withColumn("_upto", upto).where((F.col("_upto") > F.col("at")) & (F.col("_upto") - F.col("n") <= F.col("at")))
        finer = hit.select(*names, "n", "lo", "hi", (F.col("at") - (F.col("_upto") - F.col("n"))).alias("at"))
        state = stored(state.where(~open_).unionByName(finer), "selected")
    single = state.where("lo = hi").select(*names, F.col("lo").alias(name))
    few = numbers.join(state.where("lo < hi"), same).where(inside)
    number = F.row_number().over(Window.partitionBy(*names).orderBy("_v")) - 1  # LEAF rows at most
    found = few.withColumn("_n", number).where(F.col("_n") == F.col("at")).select(*names, F.col("_v").alias(name))
    return single.unionByName(found).select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), name)


def verdict(high: Column, medium: Column, low: Column) -> Column:
    """FAIL if more than three in ten are low, REVIEW if any is, else PASS."""
    total = high + medium + low
    return F.when(total == 0, "FAIL").when(low / total > 0.30, "FAIL").when(low > 0, "REVIEW").otherwise("PASS")
