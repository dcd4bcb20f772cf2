"""Places and windows against plain Python."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from marginalia.operators import order as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [(rng.choice([None, "a", "b", "b", "b", "c", "ü"]), rng.choice([None, *range(40)]), i) for i in range(500)]
    return data, spark.createDataFrame(data, "g string, x int, i int").repartition(5)


def test_places_equal_a_sort(rows):
    data, df = rows
    got = O.numbered(df, ["g"], [F.col("x").asc_nulls_first(), F.col("i").asc()], partitions=7).collect()
    key = lambda r: ((r[0] is not None, (r[0] or "").encode()), (r[1] is not None, r[1] or 0), r[2])
    want, start = [], 0
    for g, part in groupby(sorted(data, key=key), key=lambda r: r[0]):
        part = list(part)
        want += [(*r, start, k, len(part)) for k, r in enumerate(part)]
        start += len(part)
    assert sorted(map(tuple, got), key=lambda r: r[2]) == sorted(want, key=lambda r: r[2])


def test_places_without_groups_and_ties(spark):
    df = spark.createDataFrame([(1,)] * 300, "x int")
    got = O.numbered(df, [], [F.col("x").asc()], partitions=6).collect()
    assert sorted(r.position for r in got) == list(range(300))
    assert {(r.group_start, r.group_rows) for r in got} == {(0, 300)}


def test_hot_group_is_spread_over_tasks(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("g"), "id")
    got = O.numbered(df, ["g"], [F.col("id").asc()], partitions=8)
    tasks = got.select(F.floor(F.col("position") / 100).alias("b"), F.spark_partition_id().alias("p")).distinct().groupBy("p").count().collect()
    assert len(tasks) > 1
    assert got.where("position <> id").count() == 0


def test_empty_table(spark):
    assert O.numbered(spark.createDataFrame([], "g string, x int"), ["g"], [F.col("x").asc()]).collect() == []


@pytest.mark.parametrize("size", [1, 3])
def test_runs_equal_a_loop(rows, size):
    data, df = rows
    placed = O.numbered(df, ["g"], [F.col("i").asc()], partitions=4)
    got = {tuple(x.i for x in r.run) for r in O.neighbours(placed, size, "i", block=16).collect()}
    want = set()
    for g in {r[0] for r in data}:
        own = sorted(r[2] for r in data if r[0] == g)
        want |= {tuple(own[k : k + size]) for k in range(len(own) - size + 1)}
    assert got == want
