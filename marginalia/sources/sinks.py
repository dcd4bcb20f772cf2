"""Written tables: versions that replace no earlier one, the retrieval index, audits and reports."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import joins as J
from marginalia.operators import records as R
from marginalia.operators import retrieval as V

#: Levels of an index's chunk table; postings and statistics lie beside it.
TABLES = ("chunks", "postings", "terms", "stats")


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _folder(spark, path)
    return system.exists(where)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a table's finished versions, the oldest first."""
    system, where = _folder(spark, path)
    if not system.exists(where):
        return []
    names = [s.getPath().getName() for s in system.listStatus(where)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit() and exists(spark, f"{path}/{n}/_SUCCESS"))


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """A version of the table, the latest by default; FileNotFoundError if there is none."""
    known = versions(spark, path)
    if not known or (number is not None and number not in known):
        raise FileNotFoundError(f"{path} has no version {'' if number is None else number}".rstrip())
    return spark.read.parquet(f"{path}/v={known[-1] if number is None else number}")


def write_version(df: DataFrame, path: str) -> int:
    """Write the rows as the table's next version; the ones before stay as they are, as its backups."""
    number = (versions(df.sparkSession, path) or [-1])[-1] + 1
    df.write.mode("overwrite").parquet(f"{path}/v={number}")  # only what an unfinished write left is replaced
    return number


def write_registry(parts: Sequence[DataFrame], path: str, key: str, seq: str) -> dict[str, int]:
    """The union of the parts, the first row of a key, as a new version; its number and the rows of each part that stayed."""
    number = write_version(J.union_first_wins([p.withColumn("origin", F.lit(i)) for i, p in enumerate(parts)], key, seq), path)
    rows = read_version(parts[0].sparkSession, path, number).groupBy("origin").agg(F.count("*").alias("n")).collect()  # one for each part
    return {"version": number, **{f"part_{r.origin}": r.n for r in sorted(rows)}}


def enrich(spark: SparkSession, path: str, columns: Mapping[str, Column]) -> int:
    """A new version of the table with more columns, or new values of its own."""
    return write_version(read_version(spark, path).withColumns(dict(columns)), path)


def enqueue(spark: SparkSession, path: str, pages: DataFrame, key: str) -> dict[str, int]:
    """Add the pages that the queue doesn't hold, once each; how many were added and skipped."""
    new = pages.dropDuplicates([key])
    old = read_version(spark, path) if versions(spark, path) else None
    added = new if old is None else new.join(old.select(key), key, "left_anti")
    before = 0 if old is None else old.count()
    number = write_version(added if old is None else old.unionByName(added, allowMissingColumns=True), path)
    after = read_version(spark, path, number).count()
    return {"enqueued": after - before, "skipped": pages.count() - (after - before)}


def update(spark: SparkSession, path: str, changes: DataFrame, key: str) -> int:
    """A new version in which rows whose key has a change carry its columns."""
    return write_version(R.updated(read_version(spark, path), changes, key), path)


def write_index(chunks: DataFrame, tokens: Column, path: str, force: bool = False) -> bool:
    """Store chunks (``chunk_id, level, text`` and payload) by level, and their postings and statistics; False if all is there already.

    ``terms`` has each term's number of chunks and its idf, a negative one raised; ``stats`` is one row.
    """
    spark = chunks.sparkSession
    if not force and all(exists(spark, f"{path}/{t}/_SUCCESS") for t in TABLES):
        return False
    chunks.write.mode("overwrite").partitionBy("level").parquet(f"{path}/chunks")
    held = spark.read.parquet(f"{path}/chunks")
    postings = V.postings(held, "chunk_id", tokens)
    postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")  # a term's row groups are skipped by their bounds
    stored = spark.read.parquet(f"{path}/postings")
    lengths = held.select(F.size(tokens).alias("dl"))
    lengths.agg(F.count("*").alias("chunks"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/stats")
    stats = spark.read.parquet(f"{path}/stats")
    df = stored.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(stats)).select("term", "df", (F.ln(F.col("chunks") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))  # one row
    mean = idf.agg(F.avg("raw").alias("mean"))
    terms = idf.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, V.EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    return True


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The index's tables; FileNotFoundError if one is absent."""
    absent = [t for t in TABLES if not exists(spark, f"{path}/{t}/_SUCCESS")]
    if absent:
        raise FileNotFoundError(f"{path} has no {', '.join(absent)}: build the index first")
    return {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}


def search(index: Mapping[str, DataFrame], query: Sequence[str], n: int = 20) -> DataFrame:
    """``chunk_id, score, rank`` of the n best chunks by BM25: no text is read, only the query's postings."""
    times = {t: query.count(t) for t in query}
    if not times:
        return index["postings"].select("chunk_id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    weight = F.create_map(*(F.lit(x) for t, k in times.items() for x in (t, float(k))))
    wanted = F.col("term").isin(list(times))
    terms = index["terms"].where(wanted).select("term", (F.col("idf") * weight[F.col("term")]).alias("w"))  # at most one row for each query term
    hits = index["postings"].where(wanted).join(F.broadcast(terms), "term").join(F.broadcast(index["stats"]))
    part = F.col("w") * F.col("tf") * (V.K1 + 1) / (F.col("tf") + V.K1 * (1 - V.B + V.B * F.col("dl") / F.col("avgdl")))
    return V.top(hits.groupBy("chunk_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0"), "chunk_id", n)


def write_audit(summary: DataFrame, path: str) -> dict:
    """A summary of one row as a JSON file, and as a dict."""
    rows = summary.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("an audit is one row")
    summary.coalesce(1).write.mode("overwrite").json(path)
    return json.loads(json.dumps(rows[0].asDict(True), default=str))


def report(title: str, sections: Mapping[str, DataFrame], most: int = 50) -> str:
    """A report in Markdown: a table for each section, of at most ``most`` rows, each with its number of rows."""
    out = [f"# {title}"]
    for name, df in sections.items():
        rows = df.limit(most + 1).collect()
        cells = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        cells += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows[:most]]
        out += [f"\n## {name}\n", *cells] + ([f"\nMore than {most} rows; the first are shown."] if len(rows) > most else [])
    return "\n".join(out) + "\n"
