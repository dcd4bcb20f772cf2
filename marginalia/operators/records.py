"""Operators on registry rows of several schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.aggregates import filled


def indexed(df: DataFrame, keys: Mapping[str, Column], row: str) -> DataFrame:
    """``kind, value`` and the smallest ``row`` of each lookup key; blank keys go.  One pass over the rows."""
    pairs = F.array(*(F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value")) for kind, value in keys.items()))
    flat = df.select(F.explode(pairs).alias("k"), row).select("k.kind", "k.value", row)
    return flat.where(filled("value").isNotNull()).groupBy("kind", "value").agg(F.min(row).alias(row))


def until_gap(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """The rows of each group whose numbers follow one another from the first."""
    w = Window.partitionBy(*keys).orderBy(number)
    place = F.row_number().over(w) - 1
    first = F.min(number).over(Window.partitionBy(*keys))
    return df.withColumn("_place", place).withColumn("_first", first).where(F.col(number) == F.col("_first") + F.col("_place")).drop("_place", "_first")


def coalesced(df: DataFrame, key: str, fields: Mapping[str, tuple[Sequence[str], str]]) -> DataFrame:
    """The key and each field from the first of its columns that is there and not blank, else its default."""
    out = [F.coalesce(*(filled(c) for c in columns if c in df.columns), F.lit(default)).alias(name) for name, (columns, default) in fields.items()]
    return df.select(key, *out)


def flattened(df: DataFrame, extra: str) -> DataFrame:
    """The struct's fields as columns; one that is not null wins over a column of its name."""
    fields = df.schema[extra].dataType.names
    own = [F.coalesce(F.col(extra)[c], F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns if c != extra]
    return df.select(*own, *(F.col(extra)[c].alias(c) for c in fields if c not in df.columns))


def named(name: Column, nobody: Sequence[str], least: int, letters: str) -> Column:
    """Whether a name is long enough, begins with one of the letters and is no word for nobody."""
    bare = F.trim(name)
    return (F.length(bare) >= least) & bare.rlike(f"^[{letters}]") & ~F.lower(bare).isin(*nobody)


def slice_rates(df: DataFrame, slice_: str, flags: Mapping[str, Column]) -> DataFrame:
    """Rows of each slice and the share of them for which each flag holds, to four places."""
    rates = [F.round(F.avg(F.when(flag, 1.0).otherwise(0.0)), 4).alias(name) for name, flag in flags.items()]
    return df.groupBy(slice_).agg(F.count("*").alias("n"), *rates)


def updated(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``changes`` put in where the key has one; the first change by order of columns wins."""
    names = [c for c in changes.columns if c != key]
    one = changes.groupBy(key).agg(F.min(F.struct(*names)).alias("_new"))
    joined = rows.join(one, key, "left")
    return reduce(lambda df, c: df.withColumn(c, F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c))), names, joined).select(*rows.columns)
