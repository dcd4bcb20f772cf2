"""Places of rows in an order, and windows over them, without one task for a group or for all rows.

Rows are dealt by range over group and order, so that a group of any size spreads over tasks.  Each task numbers what it
holds; a table of one row for each task and group then gives the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.sources.shared import stored

#: Rows of a task's share where rows are numbered, and of a block of ``neighbours``.
PER_TASK, BLOCK = 1_000_000, 4096
#: Rows of (task, group) that may be broadcast.
EDGES = 200_000
_TASK, _ROW = 33, (1 << 33) - 1  # how monotonically_increasing_id puts a partition and a row of it together


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[Column], partitions: int | None = None, label: str = "numbered") -> DataFrame:
    """The rows with ``group_start``, ``position`` and ``group_rows``, all long.

    ``position`` counts from 0 within a group in the given order; ``group_start`` is the number of rows in groups before it
    (groups ascend, null first), so it names the group, and ``group_start + position`` is a place among all rows.  Rows
    that tie have any order among themselves.  Without ``groups`` all rows are one group.  The rows are stored once.
    """
    spark = df.sparkSession
    keys = [f"_key{i}" for i in range(len(groups))]
    keyed = df.select("*", *(F.col(f"`{g}`").alias(k) for g, k in zip(groups, keys, strict=True)), F.monotonically_increasing_id().alias("_tie"))
    ascending = [*(F.col(k).asc_nulls_first() for k in keys), *order, F.col("_tie").asc()]
    tasks = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(tasks, *ascending).sortWithinPartitions(*ascending).drop("_tie")
    placed = dealt.withColumn("_at", F.monotonically_increasing_id())
    rows = stored(placed.withColumn("_task", F.shiftright("_at", _TASK)).withColumn("_at", F.col("_at").bitwiseAND(F.lit(_ROW))), label)
    edges = rows.groupBy("_task", *keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    offsets = edges.groupBy("_task").agg(F.sum("_n").alias("_n"))  # a row for each task
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    edges = stored(edges.join(F.broadcast(offsets), "_task"), f"{label}-edges")
    renamed = lambda names, mark: [F.col(n).alias(f"{mark}{n}") for n in names]
    starts = edges.groupBy(*renamed(keys, "_s")).agg(F.min(F.col("_before") + F.col("_first")).alias("group_start"), F.sum("_n").alias("group_rows"))
    same = lambda names, mark: [F.col(n).eqNullSafe(F.col(f"{mark}{n}")) for n in names]
    known = edges.join(starts, same(keys, "_s")) if keys else edges.join(F.broadcast(starts))  # one row
    known = known.select(*renamed(["_task", *keys], "_k"), "_before", "group_start", "group_rows")
    small = F.broadcast(known) if edges.count() <= EDGES else known
    place = (F.col("_before") + F.col("_at") - F.col("group_start")).alias("position")
    return rows.join(small, same(["_task", *keys], "_k")).select(*(F.col(f"`{c}`") for c in df.columns), "group_start", place, "group_rows")


def neighbours(placed: DataFrame, size: int, *columns: str, block: int = BLOCK) -> DataFrame:
    """For every run of ``size`` rows in a row of a group: ``group_start``, ``position`` of the first, and ``run``, the
    rows' ``columns`` in order.  Takes what ``numbered`` gives.

    A group is cut into blocks of places; the first ``size - 1`` rows of a block travel to the one before as well.
    """
    at = F.floor(F.col("position") / block)
    blocks = F.when((F.col("position") % block < size - 1) & (at > 0), F.array(at, at - 1)).otherwise(F.array(at))
    spread = placed.select("group_start", "position", "group_rows", *columns, F.explode(blocks).alias("_block"))
    ahead = Window.partitionBy("group_start", "_block").orderBy("position").rowsBetween(0, size - 1)
    runs = spread.select("group_start", "position", "_block", F.collect_list(F.struct(*columns)).over(ahead).alias("run"))
    return runs.where((F.size("run") == size) & (F.floor(F.col("position") / block) == F.col("_block"))).drop("_block")
