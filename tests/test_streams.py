"""The window plans as streams, and the queue's upsert."""

from pyspark.sql import functions as F

from marginalia.sources.tables import table
from marginalia.streaming import windows as S


def test_tumbling_stream_equals_batch(spark, sf, tmp_path):
    events = table(spark, sf, "events")
    source = S.stream(spark, sf, events.schema, "events.parquet")
    out = S.flat(S.windowed(source, F.window("ts", "1 hour"), "event_type"))
    q = out.writeStream.format("memory").queryName("tumbling").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.table("tumbling").collect()}
    want = {(r.start, r.event_type): r.n for r in S.flat(S.windowed(events, F.window("ts", "1 hour"), "event_type")).collect()}
    assert got == want and got


def test_upsert_adds_each_key_once(spark, tmp_path):
    path = str(tmp_path / "queue")
    write = S.upsert(path, "k")
    write(spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int"), 0)
    write(spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int"), 1)
    assert {r.k: r.v for r in spark.read.parquet(path).collect()} == {"a": 1, "b": 2, "c": 3}
    assert spark.read.parquet(path).count() == 3
