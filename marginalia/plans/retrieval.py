"""Retrieval queries; ``hybrid_search`` is the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.functions.vector import dot, rounded, unit
from marginalia.operators import index as I
from marginalia.operators import joins as J
from marginalia.operators import retrieval as R
from marginalia.plans.catalog import SQL, query
from marginalia.sources.shared import new_path
from marginalia.sources.tables import table

TERMS = ("license", "the", "trash", "the")
_DENSE = """
    q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
    d AS (SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q)"""
_BM25 = r"""
    t AS (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '\p{L}+') AS t FROM documents),
    s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS avgdl FROM t),
    f AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM t) GROUP BY term),
    i AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM f, s),
    w AS (SELECT term, CASE WHEN idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM i) ELSE idf END * CASE term WHEN 'the' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM i WHERE term IN ('license', 'the', 'trash')),
    h AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM t),
    c AS (SELECT doc_id, dl, term, count(*) AS tf FROM h JOIN w USING (term) GROUP BY 1, 2, 3),
    b AS (SELECT doc_id, round(sum(w * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM c JOIN w USING (term), s GROUP BY 1)"""


def _bm25(spark, sf):
    return R.bm25(table(spark, sf, "documents"), "doc_id", X.tokens(F.col("text")), TERMS)


def _query_vector(spark, sf):
    row = table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()  # one vector
    return row.embedding


@query("WITH " + _DENSE + " SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM d WHERE score > 0 QUALIFY rank <= 20")
def dense_topk(spark, sf):
    scored = R.nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf))
    return R.top(scored.where("score > 0"), "vec_id", 20)


@query("WITH " + _BM25 + " SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM b WHERE score > 0 QUALIFY rank <= 20")
def bm25_topk(spark, sf):
    return R.top(_bm25(spark, sf), "doc_id", 20)


@query("WITH " + _DENSE + " SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM d WHERE label = 3 QUALIFY rank <= 20")
def prefilter_knn(spark, sf):
    vectors = table(spark, sf, "embeddings").where("label = 3")
    return R.top(R.nearest(vectors, "vec_id", "embedding", _query_vector(spark, sf)), "vec_id", 20)


@query("WITH " + _BM25 + """, k AS (SELECT doc_id, score FROM b WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50)
    SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM k JOIN t USING (doc_id) WHERE lang = 'en' QUALIFY rank <= 20""")
def postfilter_bm25(spark, sf):
    """The first 50 are fetched before the filter, on purpose."""
    fetched = _bm25(spark, sf).orderBy(F.desc("score"), "doc_id").limit(50)
    langs = table(spark, sf, "documents").select("doc_id", "lang")
    return R.top(langs.join(F.broadcast(fetched), "doc_id").where("lang = 'en'").select("doc_id", "score"), "doc_id", 20)  # 50 rows


_LISTS = "WITH " + _BM25 + "," + _DENSE + """,
    l AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 0 AS list FROM b WHERE score > 0 QUALIFY rank <= 20
          UNION ALL SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id), 1 FROM d WHERE score > 0 QUALIFY row_number() OVER (ORDER BY score DESC, vec_id) <= 20),
    u AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, CAST(min(list) AS INTEGER) AS list FROM l GROUP BY id)"""


def _fused(spark, sf):
    lexical = bm25_topk(spark, sf).select(F.col("doc_id").alias("id"), "rank")
    dense = dense_topk(spark, sf).select(F.col("vec_id").alias("id"), "rank")
    return R.fuse([lexical, dense], "id")


@query(_LISTS + " SELECT id, score, list FROM u")
def rrf_fuse(spark, sf):
    return _fused(spark, sf)


def _weighted(spark, sf):
    """Fused, cut, boosted by filters that match, weighted by source and by level."""
    fused = _fused(spark, sf).orderBy(F.desc("score"), "id").limit(R.CUT)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "lang", "n_chars")
    rows = docs.join(F.broadcast(fused), "id")  # CUT rows
    kind = F.when(F.col("source") == "src1", "reference").when(F.col("source") == "src2", "secondary").otherwise("primary")
    soft = R.boosts(F.col("lang") == "en", F.col("source") == "src3")
    level = F.when(F.col("n_chars") < 500, R.LEVEL_BOOST).otherwise(1.0)
    return rows.select("id", "source", "lang", F.round(F.col("score") * soft * R.source_weight(kind) * level, 9).alias("score"))


_HYBRID = _LISTS + """,
    cut AS (SELECT * FROM u ORDER BY score DESC, id LIMIT 40),
    x AS (SELECT id, source, documents.lang, round(score * (CASE WHEN documents.lang = 'en' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN source = 'src3' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END)
        * CASE source WHEN 'src1' THEN 0.3::DOUBLE WHEN 'src2' THEN 0.45::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN n_chars < 500 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END, 9) AS score
      FROM cut JOIN documents ON doc_id = id)"""


@query(_HYBRID + """, g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS r FROM x)
    SELECT id, source, lang, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM g WHERE r = 1 QUALIFY rank <= 20""")
def hybrid_search(spark, sf):
    """BM25 and dense lists fused, weighted, one record for each source, the best 20."""
    return R.top(R.best_of_each(_weighted(spark, sf), "source", "id"), "id", R.FUSED)


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN source = 'src3' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS boost FROM documents")
def soft_boost(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.boosts(F.col("lang") == "en", F.col("source") == "src3").alias("boost"))


@query("SELECT doc_id, CASE source WHEN 'src1' THEN 0.3::DOUBLE WHEN 'src2' THEN 0.45::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM documents")
def source_weight(spark, sf):
    kind = F.when(F.col("source") == "src1", "reference").when(F.col("source") == "src2", "secondary").otherwise("primary")
    return table(spark, sf, "documents").select("doc_id", R.source_weight(kind).alias("weight"))


@query("SELECT doc_id, CASE WHEN n_chars < 500 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END AS boost FROM documents")
def level_boost(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.boosts(F.col("n_chars") < 500, factor=R.LEVEL_BOOST).alias("boost"))


@query("SELECT user_id, event_id, score FROM (SELECT user_id, event_id, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def dedup_top1(spark, sf):
    return R.best_of_each(table(spark, sf, "events").select("user_id", "event_id", F.col("value").alias("score")), "user_id", "event_id")


@query("WITH " + _DENSE + " SELECT vec_id, score FROM d WHERE label = 2 AND score >= 0.1")
def nn_threshold(spark, sf):
    vectors = table(spark, sf, "embeddings").where("label = 2")
    return R.nearest(vectors, "vec_id", "embedding", _query_vector(spark, sf)).where("score >= 0.1")


@query("SELECT conv_id, string_agg(left(text, 400), ' ' ORDER BY turn) AS query FROM conversations WHERE role = 'user' AND turn < 8 GROUP BY conv_id")
def query_compose(spark, sf):
    turns = table(spark, sf, "conversations").where("role = 'user' AND turn < 8")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.substring("text", 1, 400).alias("t")))), lambda x: x["t"])
    return turns.groupBy("conv_id").agg(F.concat_ws(" ", parts).alias("query"))


@query("WITH " + _DENSE + """, n AS (SELECT count(*) AS n FROM d WHERE label = 77)
    SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM d, n WHERE n < 3 OR label = 77 QUALIFY rank <= 5""")
def relaxing_retrieval(spark, sf):
    """The label filter is dropped if fewer than three vectors have it."""
    vectors = table(spark, sf, "embeddings")
    hits = vectors.agg(F.count_if(F.col("label") == 77).alias("_n"))
    kept = vectors.join(F.broadcast(hits)).where((F.col("_n") < 3) | (F.col("label") == 77))
    return R.top(R.nearest(kept, "vec_id", "embedding", _query_vector(spark, sf)), "vec_id", 5)


@query("""
    WITH p AS (SELECT label, embedding::DOUBLE[] AS p FROM embeddings WHERE vec_id < 20), v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id >= 20),
    m AS (SELECT vec_id, label, max(round(list_dot_product(v, p), 6)) AS s FROM v, p GROUP BY 1, 2),
    r AS (SELECT vec_id, list(s ORDER BY s DESC) AS s, arg_min(label, (-s, label)) AS label FROM m GROUP BY 1)
    SELECT vec_id, CASE WHEN s[1] >= 0.3 AND (len(s) < 2 OR s[1] - s[2] >= 0.05) THEN label END AS intent, s[1] AS score FROM r""")
def prototype_classify(spark, sf):
    """The label of the nearest prototype if it is near enough and clear; the prototypes are twenty vectors."""
    vectors = table(spark, sf, "embeddings")
    prototypes = vectors.where("vec_id < 20").agg(F.collect_list(F.struct("label", F.col("embedding").alias("p"))).alias("ps"))  # one row of twenty
    each = F.transform("ps", lambda x: F.struct((-F.round(dot(F.col("embedding"), x["p"]), 6)).alias("m"), x["label"].alias("label")))
    ordered = vectors.where("vec_id >= 20").select("vec_id", "embedding").join(F.broadcast(prototypes)).select("vec_id", F.array_sort(each).alias("all"))
    first = F.filter("all", lambda x, i: ~F.exists(F.slice("all", 1, i), lambda y: y["label"].eqNullSafe(x["label"])))  # each label's best
    ranked = ordered.select("vec_id", first.alias("r"))
    best, second = -F.get("r", 0)["m"], -F.get("r", 1)["m"]
    clear = (best >= 0.3) & (second.isNull() | (best - second >= 0.05))
    return ranked.select("vec_id", F.when(clear, F.get("r", 0)["label"]).alias("intent"), best.alias("score"))


@query(r"""
    WITH w AS (SELECT item_id, ' ' || unnest(string_split(lower(text), ' ')) || ' ' AS w FROM benchmark),
    g AS (SELECT item_id, unnest(list_transform(range(1, greatest(length(w) - k + 2, 1)), lambda i: substr(w, i, k))) AS g FROM w, (SELECT unnest([3, 4, 5]) AS k) WHERE length(w) >= k),
    t AS (SELECT item_id, g, 1 + ln(count(*)) AS tf FROM g GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM benchmark),
    d AS (SELECT g, ln((1.0::DOUBLE + n) / (1 + count(*))) + 1 AS idf FROM t, n GROUP BY g, n),
    x AS (SELECT item_id, g, tf * idf AS x FROM t JOIN d USING (g)), l AS (SELECT item_id, sqrt(sum(x * x)) AS l FROM x GROUP BY 1)
    SELECT item_id, count(*) AS grams, round(max(x / l), 6) AS peak FROM x JOIN l USING (item_id) GROUP BY 1""")
def char_tfidf(spark, sf):
    """Runs of three to five characters within padded words: sublinear tf, smooth idf, unit length."""
    items = table(spark, sf, "benchmark")
    words = items.select("item_id", F.explode(F.split(F.lower("text"), " ")).alias("w")).select("item_id", F.concat(F.lit(" "), "w", F.lit(" ")).alias("w")).where(F.length("w") >= 3)
    runs = lambda k: F.when(F.length("w") >= k, F.transform(F.sequence(F.lit(1), F.length("w") - (k - 1)), lambda i: F.substr("w", i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    grams = words.select("item_id", F.explode(F.concat(*(runs(k) for k in (3, 4, 5)))).alias("g"))
    tf = grams.groupBy("item_id", "g").agg((1 + F.ln(F.count("*"))).alias("tf"))
    size = items.agg(F.count("*").alias("n"))
    df = tf.groupBy("g").agg(F.count("*").alias("df")).join(F.broadcast(size)).select("g", (F.ln((1.0 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    x = tf.join(df, "g").select("item_id", (F.col("tf") * F.col("idf")).alias("x"))
    return x.groupBy("item_id").agg(F.count("*").alias("grams"), F.round(F.max("x") / F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("peak"))


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5)) AS unit FROM embeddings")
def l2_normalise(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform(unit(F.col("embedding")), lambda x: rounded(x, 5)).alias("unit"))


@query("""
    WITH c AS (SELECT conv_id, list_distinct(regexp_extract_all(string_agg(text, ' '), 'src[0-9]+')) AS cited FROM conversations GROUP BY 1)
    SELECT d.doc_id FROM documents d WHERE source IN (SELECT unnest(cited) FROM c) OR NOT EXISTS (SELECT 1 FROM c WHERE list_has_any(cited, ['src1', 'src2', 'src3']))""")
def citation_list(spark, sf):
    """Records whose source a conversation cites; all of them if none of the first three is cited."""
    cited = table(spark, sf, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("(src[0-9]+)"), F.lit(1))).alias("source")).distinct()
    rows = table(spark, sf, "documents").select("doc_id", "source").join(cited.withColumn("_c", F.lit(True)), "source", "left")
    none = cited.agg((F.count_if(F.col("source").isin("src1", "src2", "src3")) == 0).alias("_none"))
    return rows.join(F.broadcast(none)).where(F.col("_c").isNotNull() | F.col("_none")).select("doc_id")


# -- over a stored index


def _index(spark, sf, write=I.write, held="postings"):
    """An index of documents and embeddings, written to the shared folder and read back."""
    path = new_path(spark, "index")
    write(table(spark, sf, "documents"), "doc_id", X.tokens(F.col("text")), path, payload=["source", "lang", "n_chars"])
    I.write_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding", path)
    return I.read(spark, path, "docs", held, "terms", "stats", "vectors", "cells")


def _asked(spark, sf):
    """The question of the other queries here, as tables: its terms, and the first vector."""
    terms = spark.createDataFrame([(0, t) for t in TERMS], "query_id long, term string")
    return terms, table(spark, sf, "embeddings").where("vec_id = 0").select(F.lit(0).cast("long").alias("query_id"), F.col("embedding").alias("vector"))


@query(SQL["bm25_topk"])
def indexed_bm25_topk(spark, sf):
    """As bm25_topk, from stored postings."""
    found, _ = I.lexical(_index(spark, sf), _asked(spark, sf)[0], 20)
    return found.select(F.col("key").alias("doc_id"), "score", "rank")


def _weighed(index, fused, nudge):
    """The records of a fused list with their payload and weights; the list is cut at CUT records for each question.

    ``nudge`` is added before scores are rounded, so that halves go the same way however products came about.
    """
    cut = J.first_n(fused, ["query_id"], R.CUT, F.desc("score"), F.col("key"))
    rows = index["docs"].join(cut, "key")
    kind = F.when(F.col("source") == "src1", "reference").when(F.col("source") == "src2", "secondary").otherwise("primary")
    soft = R.boosts(F.col("lang") == "en", F.col("source") == "src3")
    level = F.when(F.col("n_chars") < 500, R.LEVEL_BOOST).otherwise(1.0)
    return rows.select("query_id", F.col("key").alias("id"), "source", "lang", F.round(F.col("score") * soft * R.source_weight(kind) * level + nudge, 9).alias("score"))


def _answers(index, lists, nudge=0.0):
    best = J.first_by(_weighed(index, I.fused(lists), nudge), ["query_id", "source"], F.desc("score"), F.col("id"))
    return J.first_n(best, ["query_id"], R.FUSED, F.desc("score"), F.col("id"), rank="rank")


@query(SQL["hybrid_search"])
def indexed_hybrid_search(spark, sf):
    """As hybrid_search, from the stored index: no text is read for a question."""
    index, (terms, vectors) = _index(spark, sf), _asked(spark, sf)
    return _answers(index, [I.lexical(index, terms, 20)[0], I.dense(index, vectors, 20)[0]]).drop("query_id")


@query(r"""
    WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS t FROM documents),
    s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS avgdl FROM t),
    p AS (SELECT doc_id, len AS dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM t) GROUP BY 1, 2, 3),
    i AS (SELECT term, ln(n - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS idf FROM p, s GROUP BY term, n),
    q AS (SELECT query_id, term, count(*) AS times FROM (SELECT conv_id * 1000 + turn AS query_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM conversations WHERE role = 'user') GROUP BY 1, 2),
    w AS (SELECT query_id, term, times * CASE WHEN idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM i) ELSE idf END AS w FROM q JOIN i USING (term)),
    b AS (SELECT query_id, doc_id AS id, round(sum(w * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM w JOIN p USING (term), s GROUP BY 1, 2),
    v AS (SELECT c.conv_id * 1000 + c.turn AS query_id, e.embedding::DOUBLE[] AS q FROM conversations c JOIN embeddings e ON e.vec_id = c.conv_id WHERE role = 'user'),
    d AS (SELECT query_id, vec_id AS id, round(list_dot_product(embedding::DOUBLE[], q), 6) AS score FROM embeddings, v),
    l AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b WHERE score > 0 QUALIFY rank <= 20
          UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM d WHERE score > 0 QUALIFY rank <= 20),
    u AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM l GROUP BY 1, 2),
    cut AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 40),
    x AS (SELECT query_id, id, source, documents.lang, round(score * (CASE WHEN documents.lang = 'en' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN source = 'src3' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END)
        * CASE source WHEN 'src1' THEN 0.3::DOUBLE WHEN 'src2' THEN 0.45::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN n_chars < 500 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END + 1e-12::DOUBLE, 9) AS score
      FROM cut JOIN documents ON doc_id = id),
    g AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) = 1)
    SELECT query_id, id, source, lang, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM g QUALIFY rank <= 20""")
def batch_hybrid_search(spark, sf):
    """Every user turn as a question, with its conversation's vector where there is one, in one plan over the stored index."""
    index = _index(spark, sf, I.write_forward, "forward")
    turns = table(spark, sf, "conversations").where("role = 'user'").withColumn("query_id", F.col("conv_id") * 1000 + F.col("turn"))
    terms = turns.select("query_id", F.explode(X.tokens(F.col("text"))).alias("term"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = I.dense(index, vectors.join(turns.select(F.col("conv_id").alias("query_id")), "query_id", "left_semi"), 20)[0]  # once for all of a conversation's turns
    near = turns.select("query_id", "conv_id").join(near.withColumnRenamed("query_id", "conv_id"), "conv_id").drop("conv_id")
    return _answers(index, [I.lexical_all(index, terms, 20), near], 1e-12)


@query("""
    WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)
    SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM d QUALIFY rank <= 10""")
def vector_store_knn(spark, sf):
    """The ten nearest of many vectors in a store of cells, exact."""
    path = new_path(spark, "vectors")
    vectors = table(spark, sf, "embeddings")
    I.write_vectors(vectors, "vec_id", "embedding", path)
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found, _ = I.dense(I.read(spark, path, "vectors", "cells"), asked, 10, positive=False)
    return found.select("query_id", F.col("key").alias("vec_id"), "score", "rank")
