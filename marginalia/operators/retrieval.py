"""Ranked retrieval: BM25, exact nearest neighbours, rank fusion, weighting and deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.vector import dot

#: Constants that define the ranking.
RRF_K, FUSED, CUT = 60, 20, 40
K1, B, EPSILON = 1.5, 0.75, 0.25
SOFT_BOOST, LEVEL_BOOST = 1.5, 1.25
REFERENCE_WEIGHT, SECONDARY_WEIGHT = 0.30, 0.45


def postings(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``term, key, tf, dl``: how often a term is in a record, and the record's tokens."""
    rows = docs.select(key, tokens.alias("_t")).withColumn("dl", F.size("_t"))
    return rows.select(key, "dl", F.explode("_t").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, tokens: Column, query: Sequence[str]) -> DataFrame:
    """``key, score`` of records that hold a query term and score above 0; a repeated query term counts again.

    A negative idf becomes ``EPSILON`` times the mean idf of all terms.  Only the query's terms reach the score join; the
    corpus statistics are two aggregates.
    """
    rows = docs.select(key, tokens.alias("_t")).withColumn("dl", F.size("_t"))
    stats = rows.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"))
    df = rows.select(F.explode(F.array_distinct("_t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(stats)).select("term", (F.ln(F.col("N") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("idf"))  # one row
    mean = idf.agg(F.avg("idf").alias("mean"))
    weights = {t: list(query).count(t) for t in query}
    wanted = list(weights)
    times = F.create_map(*(F.lit(x) for t, n in weights.items() for x in (t, float(n))))
    terms = idf.where(F.col("term").isin(wanted)).join(F.broadcast(mean)).select("term", (F.when(F.col("idf") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf")) * times[F.col("term")]).alias("w"))
    hits = rows.select(key, "dl", F.explode(F.filter("_t", lambda t: t.isin(wanted))).alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    scored = hits.join(F.broadcast(terms), "term").join(F.broadcast(stats))  # at most one row for each query term
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy(key).agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")


def nearest(vectors: DataFrame, key: str, vector: str, query: Sequence[float]) -> DataFrame:
    """``key, score``: inner product of every vector with the query (cosine, for unit vectors)."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, F.round(dot(F.col(vector), q), 6).alias("score"))


def top(scored: DataFrame, key: str, n: int) -> DataFrame:
    """The n best by score, then key, with their rank; the whole table is never sorted."""
    best = scored.orderBy(F.desc("score"), key).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("int"))  # n rows


def fuse(lists: Sequence[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (``key, rank``): the sum of 1 / (k + rank)."""
    out = None
    for i, ranked in enumerate(lists):
        own = ranked.select(key, "rank", F.lit(i).alias("list"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy(key).agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 9).alias("score"), F.min("list").alias("list"))


def source_weight(source: Column) -> Column:
    return F.when(source == "reference", REFERENCE_WEIGHT).when(source == "secondary", SECONDARY_WEIGHT).otherwise(1.0)


def boosts(*conditions: Column, factor: float = SOFT_BOOST) -> Column:
    out = F.lit(1.0)
    for c in conditions:
        out = out * F.when(c, factor).otherwise(1.0)
    return out


def best_of_each(scored: DataFrame, group: str, key: str) -> DataFrame:
    """The best record of each group; ties to the smaller key."""
    ranked = scored.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), key)))
    return ranked.where("_r = 1").drop("_r")
