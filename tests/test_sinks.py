"""Written tables: versions, the queue, the index, audits and reports."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import retrieval as V
from marginalia.sources import sinks


def test_versions_keep_the_ones_before(spark, tmp_path):
    path = str(tmp_path / "registry")
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, path)
    a = spark.createDataFrame([(1, "x", "a"), (2, "y", " ")], "seq int, text string, id string")
    b = spark.createDataFrame([(1, "z", "a"), (2, "w", "b")], "seq int, text string, id string")
    assert sinks.write_registry([a, b], path, "id", "seq") == {"version": 0, "part_0": 1, "part_1": 1}
    assert sinks.enrich(spark, path, {"genre": F.upper("text")}) == 1
    assert sorted(r.genre for r in sinks.read_version(spark, path).collect()) == ["W", "X"]
    assert "genre" not in sinks.read_version(spark, path, 0).columns and sinks.versions(spark, path) == [0, 1]


def test_queue_adds_once_and_updates_by_key(spark, tmp_path):
    path = str(tmp_path / "queue")
    pages = spark.createDataFrame([("p1", "pending", None), ("p1", "pending", None), ("p2", "pending", None)], "page string, status string, done string")
    assert sinks.enqueue(spark, path, pages, "page") == {"enqueued": 2, "skipped": 1}
    assert sinks.enqueue(spark, path, pages, "page") == {"enqueued": 0, "skipped": 3}
    sinks.update(spark, path, spark.createDataFrame([("p2", "completed", "now"), ("p9", "completed", "now")], "page string, status string, done string"), "page")
    assert sorted(map(tuple, sinks.read_version(spark, path).collect())) == [("p1", "pending", None), ("p2", "completed", "now")]


def test_index_is_built_once_and_answers_as_the_scan(spark, sf, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        sinks.read_index(spark, path)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chunks = docs.select(F.concat("doc_id", F.lit("__row")).alias("chunk_id"), F.lit("row").alias("level"), "text")
    tokens = X.tokens(F.col("text"))
    assert sinks.write_index(chunks, tokens, path) and not sinks.write_index(chunks, tokens, path)
    index = sinks.read_index(spark, path)
    found = sinks.search(index, ["license", "version", "version"], 10)
    want = V.top(V.bm25(chunks, "chunk_id", tokens, ["license", "version", "version"]), "chunk_id", 10)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in want.collect()] and found.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "/chunks" not in plan and "PushedFilters: [In(term" in plan
    assert sinks.search(index, [], 5).count() == 0


def test_audit_and_report(spark, tmp_path):
    df = spark.createDataFrame([(3, "a|b")], "n int, name string")
    assert sinks.write_audit(df, str(tmp_path / "audit")) == {"n": 3, "name": "a|b"}
    assert spark.read.json(str(tmp_path / "audit")).first().n == 3
    with pytest.raises(ValueError):
        sinks.write_audit(df.union(df), str(tmp_path / "audit"))
    text = sinks.report("All", {"Counts": df.union(df)}, most=1)
    assert text.splitlines()[:2] == ["# All", ""] and "a\\|b" in text and "More than 1 rows" in text
