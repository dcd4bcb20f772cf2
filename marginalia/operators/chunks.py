"""Records exploded into text granularities: row, window, group, dimension, era and label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW, ERA = 3, 50


def rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """A chunk for each record with text."""
    return df.where(F.trim(text) != "").select(F.concat(F.col(key).cast("string"), F.lit("__row")).alias("chunk_id"), F.lit("row").alias("level"), F.col(text).alias("text"))


def windows(df: DataFrame, groups: Sequence[str], seq: str, text: str, size: int = WINDOW) -> DataFrame:
    """Every run of exactly ``size`` neighbouring records of a group; shorter groups give none."""
    w = Window.partitionBy(*groups).orderBy(seq).rowsBetween(0, size - 1)
    runs = df.select(*groups, F.col(seq).alias("first"), F.collect_list(text).over(w).alias("_t"))
    return runs.where(F.size("_t") == size).select(*groups, "first", F.array_join("_t", "\n").alias("text"))


def groups(df: DataFrame, keys: Sequence[str], seq: str, text: str, least: int = 2, glue: str = " | ", span: int = 100) -> DataFrame:
    """Texts in order of groups of at least ``least`` records, in parts of ``span`` sequence numbers."""
    known = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    parts = F.transform(F.sort_array(F.collect_list(F.struct(seq, text))), lambda x: x[text])
    grouped = df.join(known, list(keys)).groupBy(*keys, F.floor(F.col(seq) / span).alias("part")).agg(F.count("*").alias("n"), parts.alias("_t"))
    return grouped.select(*keys, "part", "n", F.array_join("_t", glue).alias("text"))


def blobs(parts: DataFrame, key: str, part: Column, order: str, size: Column) -> DataFrame:
    """Each group's header, the sum of its parts' sizes, and the parts in order."""
    items = F.transform(F.sort_array(F.collect_list(F.struct(order, part.alias("_p")))), lambda x: x["_p"])  # one for each part
    grouped = parts.groupBy(key).agg(F.sum(size).alias("_n"), items.alias("_items"))
    return grouped.select(key, F.concat(F.lit("["), key, F.lit("] "), F.col("_n").cast("string"), F.lit(" records || "), F.array_join("_items", " ||| ")).alias("blob"))


def era(start, end, width: int = ERA):
    """The first year of the ``width``-year band of the middle of two years."""
    return (F.floor(F.floor((start + end) / 2) / width) * width).cast("int")
