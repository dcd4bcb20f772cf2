"""Tables and files as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """The first path that Spark's file system has; None if none is there."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return path
    return None


def json_records(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """A JSON array (or lines) of records from the first path that exists; an empty frame with the schema if none does."""
    path = first_existing(spark, [paths] if isinstance(paths, str) else paths)
    return spark.createDataFrame([], schema) if path is None else spark.read.schema(schema).json(path, multiLine=True)


def tolerant_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Records of JSON lines; a line that does not parse is dropped."""
    bad = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_bad", T.StringType())])
    parsed = lines.select(F.from_json(column, bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where(F.col("r._bad").isNull() & F.col("r").isNotNull()).select("r.*").drop("_bad")


def csv_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, and a byte-order mark if there is one."""
    return spark.read.schema(schema).csv(path, header=True, encoding="UTF-8", multiLine=True)


def page_lines(spark: SparkSession, path: str) -> DataFrame:
    """``id, points, text, confidence`` of each TextLine of PAGE-XML files, with Spark's XML source."""
    schema = "_id string, _custom string, Coords struct<_points:string>, TextEquiv struct<_conf:double,Unicode:string>"
    rows = spark.read.format("xml").option("rowTag", "TextLine").schema(schema).load(path)
    return rows.select(F.col("_id").alias("id"), F.col("Coords._points").alias("points"), F.trim(F.coalesce("TextEquiv.Unicode", F.lit(""))).alias("text"), F.col("TextEquiv._conf").alias("confidence"))
