"""Event streams: tumbling, sliding and session windows with watermarks, and a queue kept by upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def timed(events: DataFrame) -> DataFrame:
    """Event time as a zoned timestamp, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, window: Column, *keys: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window, in batch or streaming; in a stream rows later than ``late`` are dropped."""
    return timed(events).withWatermark("ts", late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def flat(windows: DataFrame) -> DataFrame:
    """Window bounds as plain columns."""
    return windows.withColumns({"start": F.col("w.start").cast("timestamp_ntz"), "end": F.col("w.end").cast("timestamp_ntz")}).drop("w")


def stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def upsert(path: str, key: str):
    """A ``foreachBatch`` function: rows whose key the table at ``path`` does not hold yet are appended, once each."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(path)

    return write
