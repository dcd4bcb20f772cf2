"""Queries on rows that the given tables lack: what a reviewer found on larger ones."""

import math

from pyspark.sql import functions as F

from marginalia.plans.registry import QUERIES, SQL


def of_sql(name, **tables):
    """The SQL's rows over parquet files."""
    import duckdb

    con = duckdb.connect()
    for table, path in tables.items():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    return con.sql(SQL[name]).to_arrow_table().to_pylist()


def test_chunk_ids_beyond_four_digits(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    spark.range(10_012).select(F.col("id").alias("doc_id"), F.lit("one").alias("source")).write.parquet(path)
    got = {r.chunk_id for r in QUERIES["chunk_ids"](spark, str(tmp_path)).collect()}
    assert got == {r["chunk_id"] for r in of_sql("chunk_ids", documents=path)} and "10011__row__1001" in got


def test_unit_vectors_keep_the_sign_of_what_rounds_to_nothing(spark, tmp_path):
    path = f"{tmp_path}/embeddings.parquet"
    rows = [(0, [-1e-6, 1.0]), (1, [1e-6, -3.0]), (2, [0.015625, 0.6]), (3, [-0.0, 2.0]), (4, [0.5, -0.125])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(path)
    signed = lambda rows: {r["vec_id"]: [(x, math.copysign(1, x)) for x in r["unit"]] for r in rows}
    got = signed(QUERIES["l2_normalise"](spark, str(tmp_path)).collect())
    assert got == signed(of_sql("l2_normalise", embeddings=path)) and got[0][0] == (0.0, -1.0)


def test_overlaps_look_at_sets_of_a_fitting_size_only(spark, monkeypatch):
    """Of the larger set: exact at the limit, and no set that is too small or too large goes on."""
    from marginalia.operators import joins as J

    held, stored = [], J.stored
    monkeypatch.setattr(J, "stored", lambda df, label: held.append(stored(df, label)) or held[-1])
    small = {i: [f"w{k}" for k in range(i, i + 3)] for i in range(5)}
    large = {i: [f"w{k}" for k in range(n)] for i, n in enumerate((0, 1, 2, 3, 6, 9, 10, 11, 40))}
    frame = lambda rows, name: spark.createDataFrame(list(rows.items()), f"{name} int, t array<string>")
    got = {(r.one, r.two): r.overlap for r in J.overlapping(frame(small, "one"), frame(large, "two"), "one", "two", 0.3, larger=True).collect()}
    share = {(i, j): len({*s} & {*t}) / max(len(s), len(t), 1) for i, s in small.items() for j, t in large.items()}
    assert got == {k: round(v, 6) for k, v in share.items() if v >= 0.3}
    assert sorted(r.two for r in held[0].collect()) == [1, 2, 3, 4, 5, 6]


def test_levels_number_chunks_without_their_texts(spark, tmp_path, monkeypatch):
    """What is stored on the way holds no text, and windows, parts and groups that reach over homes are as in the SQL."""
    from marginalia.operators import order as O

    text = F.when(F.col("id") % 50 == 7, F.lit(" ")).otherwise(F.concat_ws("", *(F.sha2(F.concat(F.lit(f"{k} "), F.col("id")), 256) for k in range(8))))
    docs = spark.range(700).select(
        (F.col("id") * 5 - 20).alias("doc_id"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("s"), F.pmod("id", F.lit(3)))).otherwise("").alias("source"),
        F.when(F.col("id") % 400 < 399, "en").otherwise("de").alias("lang"), text.alias("text"),
    )
    docs = docs.where("doc_id >= 0")
    labels = docs.where("doc_id % 4 > 0").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3 - 1).cast("int").alias("toxic"))
    tables = {
        "documents": docs, "labels": labels, "nation": spark.range(32).select(F.col("id").alias("n_nationkey"), F.concat(F.lit("N"), "id").alias("n_name")),
        "benchmark": spark.range(3).select(F.col("id").alias("item_id"), F.lit("ref").alias("text")),
    }
    for name, df in tables.items():
        df.coalesce(3).write.parquet(f"{tmp_path}/{name}.parquet")
    held, stored = [], O.stored
    monkeypatch.setattr(O, "stored", lambda df, label: held.append(stored(df, label)) or held[-1])
    got = QUERIES["chunk_levels"](spark, str(tmp_path)).toArrow().to_pylist()
    rows = lambda found: sorted((tuple(sorted((k, str(v)) for k, v in r.items())) for r in found), key=repr)
    assert rows(got) == rows(of_sql("chunk_levels", **{name: f"{tmp_path}/{name}.parquet" for name in tables}))
    verses = [r["text"] for r in got if r["level"] == "verse"][:3]
    assert held and not any(t in str(x.toArrow().to_pylist()) for x in held for t in verses)
