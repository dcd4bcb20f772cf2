"""Filters, joins, unions and the review queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import joins as J
from marginalia.operators import matching as M
from marginalia.plans.catalog import query
from marginalia.sources.tables import table

# -- filters


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src3' AND contains(lower(source), 'src')")
def hard_filter_exact(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.where((F.col("lang") == "en") & (F.col("source") == "src3") & F.lower("source").contains("src")).select("doc_id")


@query("""
    SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND list_has_any([event_type, CASE WHEN value > 10 THEN 'high' ELSE 'low' END], ['high', 'click'])""")
def hard_filter_sets(spark, sf):
    tags = F.array("event_type", F.when(F.col("value") > 10, "high").otherwise("low"))
    return table(spark, sf, "events").where(F.col("event_type").isin("click", "view") & F.arrays_overlap(tags, F.array(F.lit("high"), F.lit("click")))).select("event_id")


@query("SELECT doc_id FROM documents WHERE lang = 'it' OR NOT EXISTS (SELECT 1 FROM documents WHERE lang = 'it')")
def filter_or_skip(spark, sf):
    return J.or_all(table(spark, sf, "documents").select("doc_id", "lang"), F.col("lang") == "it").select("doc_id")


@query("SELECT doc_id FROM documents WHERE (lang = 'de' AND source = 'src1') OR NOT EXISTS (SELECT 1 FROM documents WHERE lang = 'de' AND source = 'src1')")
def filter_fallback_all(spark, sf):
    return J.or_all(table(spark, sf, "documents").select("doc_id", "lang", "source"), (F.col("lang") == "de") & (F.col("source") == "src1")).select("doc_id")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(r_name), 'asia')")
def dim_by_region(spark, sf):
    regions = table(spark, sf, "region").where(F.lower("r_name").contains("asia"))
    return table(spark, sf, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '00007')")
def dim_by_collector(spark, sf):
    return table(spark, sf, "supplier").where(F.lower("s_name").contains("00007")).select("s_suppkey", "s_name")


@query(r"""
    SELECT p_partkey FROM part WHERE length(p_name) >= 4 AND NOT regexp_matches(p_name, '[0-9]') AND regexp_matches(p_name, '[a-z]') AND NOT regexp_matches(p_name, '^[0-9\s]*$')""")
def valid_name(spark, sf):
    n = F.col("p_name")
    return table(spark, sf, "part").where((F.length(n) >= 4) & ~n.rlike("[0-9]") & n.rlike("[a-z]") & ~n.rlike(r"^[0-9\s]*$")).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE length(regexp_replace(lower(text), '[^a-z]', '', 'g')) < 40 OR source IN ('src0', '')")
def useless_text(spark, sf):
    letters = F.length(F.regexp_replace(F.lower("text"), "[^a-z]", ""))
    return table(spark, sf, "documents").where((letters < 40) | F.col("source").isin("src0", "")).select("doc_id")


@query("""
    SELECT doc_id, length(text) AS n FROM (
      SELECT doc_id, text FROM documents WHERE (contains(lower(text), 'trash') OR contains(lower(source), 'trash')) AND lang = 'en' ORDER BY doc_id LIMIT 200)
    WHERE length(trim(text)) >= 4""")
def browse_filter(spark, sf):
    docs = table(spark, sf, "documents")
    hits = docs.where((F.lower("text").contains("trash") | F.lower("source").contains("trash")) & (F.col("lang") == "en")).orderBy("doc_id").limit(200)
    return hits.where(F.length(F.trim("text")) >= 4).select("doc_id", F.length("text").alias("n"))


@query(r"""
    WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
    SELECT doc_id FROM l WHERE len(l) >= 4 AND len(l) % 2 = 0 AND list_sum(list_transform(l, lambda x: length(x))) / len(l) >= 18
      AND list_sum(list_transform(range(1, len(l), 2), lambda i: length(l[i]) / CAST(length(l[i + 1]) AS DOUBLE))) / (len(l) // 2) BETWEEN 0.35 AND 2.8""")
def classical_structure(spark, sf):
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = table(spark, sf, "documents").select("doc_id", lines.alias("l")).where((F.size("l") >= 4) & (F.size("l") % 2 == 0))
    mean = F.aggregate("l", F.lit(0.0), lambda a, x: a + F.length(x)) / F.size("l")
    ratios = F.transform(F.sequence(F.lit(1), F.greatest(F.size("l") - 1, F.lit(1)), F.lit(2)), lambda i: F.length(F.try_element_at("l", i)) / F.length(F.try_element_at("l", i + 1)))
    ratio = F.aggregate(ratios, F.lit(0.0), lambda a, x: a + x) / F.size(ratios)
    return rows.where((mean >= 18) & ratio.between(0.35, 2.8)).select("doc_id")


# -- joins


@query("""
    SELECT l_orderkey, l_linenumber, s_name FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 3 = 0""")
def left_join_dim(spark, sf):
    dim = table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select("s_suppkey", "s_name")
    facts = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return facts.join(dim, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", "s_name")


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def stem_lookup(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    c = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("""
    SELECT s_suppkey, coalesce(n, 0) AS n FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY 1) ON l_suppkey = s_suppkey""")
def dim_with_counts(spark, sf):
    counts = table(spark, sf, "lineitem").where("l_quantity > 49").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    dim = table(spark, sf, "supplier").select("s_suppkey").join(counts, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return dim.select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n")).orderBy("s_suppkey")


@query("""
    SELECT d.doc_id, l.doc_id IS NOT NULL OR d.source = 'src7' AS resolvable, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def resolve_left_join(spark, sf):
    registry = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    joined = table(spark, sf, "documents").select("doc_id", "source").join(registry, F.col("doc_id") == F.col("id"), "left")
    return joined.select("doc_id", (F.col("id").isNotNull() | (F.col("source") == "src7")).alias("resolvable"), "quality")


@query("""
    WITH s AS (SELECT source, min(doc_id) AS seen FROM documents GROUP BY 1), p AS (
      SELECT s.source, t.source AS other, row_number() OVER (PARTITION BY s.source ORDER BY CASE WHEN s.source = t.source THEN 0 ELSE 1 END, t.seen) AS r
      FROM s JOIN s t ON contains(s.source, t.source) OR contains(t.source, s.source))
    SELECT source, other FROM p WHERE r = 1 AND source <> ''""")
def theta_substring_join(spark, sf):
    """Each name's best holder or part: itself if there, else the first in the table's order."""
    docs = table(spark, sf, "documents").select("source", "doc_id")
    held = J.held_names(docs, "source")
    pairs = held.toDF("source", "other").union(held.select("outer", "inner")).distinct()
    pairs = pairs.join(docs.groupBy(F.col("source").alias("other")).agg(F.min("doc_id").alias("seen")), "other").select("source", "other", "seen")
    return J.first_by(pairs, ["source"], F.when(F.col("source") == F.col("other"), 0).otherwise(1), F.col("seen")).drop("seen")


# The composite key of a record is its first ten words, folded; unlabelled records are compared with labelled ones if their keys share
# three words in a row.
def _keyed(spark, sf, how):
    """Names and first ten words of records with a label (the known ones) or without; a name of src0 counts as unknown."""
    first = F.regexp_extract("text", r"^\s*((?:\S+\s+){0,9}\S+)", 1)
    words = F.filter(F.split(X.folded(first), r"\s+"), lambda x: x != "")
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", F.array_join(words, " ").alias("text"))  # whole texts don't travel
    docs = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", how)
    return docs.select("doc_id", "source", "lang", F.when(F.col("source") != "src0", F.col("source")).alias("name"), "text")


@query()
def blocked_fuzzy_join(spark, sf):
    """Each record's best known one of its own source, if their first words score 70 or more."""
    records = _keyed(spark, sf, "left_anti").select("doc_id", "source", F.col("text").alias("key"))
    known = _keyed(spark, sf, "left_semi").select(F.col("doc_id").alias("item_id"), "source", F.col("text").alias("key"))
    return M.best_matches(records, known, "doc_id", "item_id", on=["source"]).withColumn("score", F.round("score", 6))


@query()
def fuzzy_best_match(spark, sf):
    """Every record with the known one that its name and first words are most like, over all of them, and what to do with it."""
    known = _keyed(spark, sf, "left_semi").select(F.col("doc_id").alias("item_id"), "name", "text")
    return M.linked(_keyed(spark, sf, "left_anti").select("doc_id", "name", "text"), known, "doc_id", "item_id")


@query("""
    WITH a AS (SELECT doc_id, list_distinct(string_split(text, ' ')) AS t FROM documents), b AS (SELECT item_id, list_distinct(string_split(text, ' ')) AS t FROM benchmark),
    x AS (SELECT doc_id, unnest(t) AS w FROM a), y AS (SELECT item_id, unnest(t) AS w FROM b),
    n AS (SELECT doc_id, item_id, count(*) AS n FROM x JOIN y USING (w) GROUP BY 1, 2)
    SELECT doc_id, item_id, round(n / CAST(greatest(len(a.t), len(b.t)) AS DOUBLE), 6) AS overlap FROM n JOIN a USING (doc_id) JOIN b USING (item_id) WHERE n / CAST(greatest(len(a.t), len(b.t)) AS DOUBLE) >= 0.3""")
def token_overlap(spark, sf):
    """Pairs of whole texts that share three in ten of the larger one's distinct words."""
    a = table(spark, sf, "documents").select("doc_id", F.array_distinct(F.split("text", " ")).alias("t"))
    b = table(spark, sf, "benchmark").select("item_id", F.array_distinct(F.split("text", " ")).alias("t"))
    return J.overlapping(b, a, "item_id", "doc_id", 0.3, larger=True).select("doc_id", "item_id", "overlap")


@query("""
    SELECT conv_id, turn, CASE WHEN role = 'system' THEN coalesce(u, 'unknown') ELSE role END AS role FROM conversations
    LEFT JOIN (SELECT conv_id, min(role) AS u FROM conversations WHERE role <> 'system' GROUP BY 1) USING (conv_id)""")
def propagate_attr(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    known = turns.where("role <> 'system'").groupBy("conv_id").agg(F.min("role").alias("u"))
    filled = F.when(F.col("role") == "system", F.coalesce("u", F.lit("unknown"))).otherwise(F.col("role"))
    return turns.join(known, "conv_id", "left").select("conv_id", "turn", filled.alias("role"))


@query("""
    SELECT min(o_orderkey) AS o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity > 40)
      AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderstatus = 'P' AND p.o_custkey = o.o_custkey AND p.o_orderpriority = o.o_orderpriority)
    GROUP BY o_custkey, o_orderpriority""")
def anti_join_two_keys(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    large = table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    new = J.anti_join_any(orders, large, [["o_orderkey"]])
    new = J.anti_join_any(new, orders.where("o_orderstatus = 'P'"), [["o_custkey", "o_orderpriority"]])
    return new.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("o_orderkey")).select("o_orderkey")  # and once in the batch


@query("""
    SELECT doc_id, 'old' AS origin FROM labels UNION ALL SELECT doc_id, 'new' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def anti_join_append(spark, sf):
    old = table(spark, sf, "labels").select("doc_id")
    new = table(spark, sf, "documents").select("doc_id").join(old, "doc_id", "left_anti")
    return old.withColumn("origin", F.lit("old")).unionByName(new.withColumn("origin", F.lit("new")))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount = 0.1))")
def semi_join(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_discount = 0.1").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(lines, "o_orderkey", "left_semi")
    return table(spark, sf, "customer").select("c_custkey").join(orders, "c_custkey", "left_semi")


@query("""
    WITH e AS (SELECT CASE WHEN coalesce(CASE WHEN c_custkey % 10 <> 0 THEN year(o_orderdate) END, 1995) < 1995 THEN 'early' WHEN coalesce(CASE WHEN c_custkey % 10 <> 0 THEN year(o_orderdate) END, 1995) < 1998 THEN 'middle' ELSE 'late' END AS era,
      c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT era, c_mktsegment, count(*) AS n FROM e GROUP BY 1, 2""")
def era_genre_dist(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    year = F.coalesce(F.when(F.col("o_custkey") % 10 != 0, F.year("o_orderdate")), F.lit(1995))
    era = F.when(year < 1995, "early").when(year < 1998, "middle").otherwise("late")
    return joined.groupBy(era.alias("era"), "c_mktsegment").agg(F.count("*").alias("n"))


@query("""
    SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 9)
      OR NOT EXISTS (SELECT 1 FROM documents d2 JOIN labels l2 USING (doc_id) WHERE l2.toxic = 9)""")
def grade_filter(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    graded = docs.join(table(spark, sf, "labels").where("toxic = 9").select("doc_id", F.lit(True).alias("_ok")).distinct(), "doc_id", "left")
    return J.or_all(graded, F.col("_ok").isNotNull()).select("doc_id")


@query("""
    SELECT conv_id, turn, CAST(coalesce(score, 0) AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(score, 0) DESC, turn) AS INTEGER) AS rank
    FROM conversations LEFT JOIN (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, CAST(floor(value) AS BIGINT) AS score FROM events) ON user_id = conv_id AND pos = turn""")
def rerank_join(spark, sf):
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    grades = table(spark, sf, "events").select(F.col("user_id").alias("conv_id"), pos.cast("long").alias("turn"), F.floor("value").cast("long").alias("score"))
    joined = table(spark, sf, "conversations").select("conv_id", "turn").join(grades, ["conv_id", "turn"], "left").withColumn("score", F.coalesce("score", F.lit(0)).cast("long"))
    return joined.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "turn")).cast("int"))


@query("""
    SELECT item_id, count(DISTINCT doc_id) AS n FROM benchmark b JOIN documents d ON (len(string_split(b.text, ' ')) >= 5 AND contains(d.text, b.text)) OR (len(string_split(d.text, ' ')) >= 5 AND contains(b.text, d.text))
    GROUP BY 1""")
def contamination_check(spark, sf):
    items, docs = table(spark, sf, "benchmark").select("item_id", "text"), table(spark, sf, "documents").select("doc_id", "text")
    pairs = J.held_texts(items, docs, "item_id", "doc_id").union(J.held_texts(docs, items, "doc_id", "item_id").select("item_id", "doc_id")).distinct()
    return pairs.groupBy("item_id").agg(F.count("*").alias("n"))


@query()
def resolve_dim_3tier(spark, sf):
    """Every part's type as a hint for a nation or a brand: exact, then as a part, then by the best window, 60 at least."""
    hints = table(spark, sf, "part").select(F.col("p_type").alias("q")).union(table(spark, sf, "customer").select(F.concat(F.lit("NATIO_"), F.col("c_nationkey").cast("string")))).distinct()
    members = table(spark, sf, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf, "part").select("p_brand").distinct())
    return M.resolved(hints, members, "q", "name")


# -- unions and dedup


@query("""
    WITH u AS (SELECT doc_id, 1 AS origin, 0 AS p FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 2, 1 FROM documents WHERE lang = 'en')
    SELECT doc_id, origin FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM u WHERE doc_id IS NOT NULL) WHERE r = 1""")
def union_first_wins(spark, sf):
    a = table(spark, sf, "labels").where("quality = 1").select("doc_id", F.lit(1).alias("origin"))
    b = table(spark, sf, "documents").where("lang = 'en'").select("doc_id", F.lit(2).alias("origin"))
    return J.union_first_wins([a, b], "doc_id", "doc_id")


@query("""
    WITH u AS (SELECT doc_id, 1 AS origin FROM labels UNION ALL SELECT doc_id, 2 FROM documents WHERE lang = 'en')
    SELECT doc_id, max(origin) AS origin FROM u GROUP BY doc_id""")
def union_last_wins(spark, sf):
    a = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("origin"))
    b = table(spark, sf, "documents").where("lang = 'en'").select("doc_id", F.lit(2).alias("origin"))
    return J.union_last_wins([a, b], "doc_id", "doc_id")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS key FROM documents GROUP BY md5(text)")
def dedup_first(spark, sf):
    return table(spark, sf, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("key")).agg(F.min("doc_id").alias("doc_id"))


@query("""
    WITH p AS (SELECT vec_id, 0 AS pool FROM embeddings WHERE label = 1 ORDER BY vec_id LIMIT 15), q AS (SELECT vec_id, 1 AS pool FROM embeddings WHERE vec_id % 2 = 1 ORDER BY vec_id LIMIT 5),
    u AS (SELECT * FROM p UNION ALL SELECT * FROM q)
    SELECT vec_id, min(pool) AS pool FROM u GROUP BY 1""")
def blend_two_pools(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "label")
    first = vectors.where("label = 1").orderBy("vec_id").limit(15).select("vec_id", F.lit(0).alias("pool"))
    second = vectors.where("vec_id % 2 = 1").orderBy("vec_id").limit(5).select("vec_id", F.lit(1).alias("pool"))
    return J.union_first_wins([first, second], "vec_id", "vec_id")


@query("""
    SELECT coalesce(a.c_custkey, b.k) AS custkey, coalesce(nullif(a.seg, ''), b.seg) AS segment
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 2 = 0) a
    FULL JOIN (SELECT o_custkey AS k, min(o_orderpriority) AS seg FROM orders GROUP BY 1) b ON a.c_custkey = b.k""")
def merge_fill_missing(spark, sf):
    old = table(spark, sf, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("seg"))
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderpriority").alias("other"))
    return old.join(new, F.col("c_custkey") == F.col("k"), "full").select(F.coalesce("c_custkey", "k").alias("custkey"), F.coalesce(F.nullif(F.col("seg"), F.lit("")), F.col("other")).alias("segment"))


# -- the review queue


def _queue(spark, sf):
    return table(spark, sf, "events").where("event_type = 'error'").select(F.concat(F.lit("page_"), (F.col("event_id") % 500).cast("string")).alias("page_path"), "event_id")


_QUEUE = "SELECT 'page_' || (event_id % 500) AS page_path, min(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY 1"


@query(f"SELECT page_path, event_id, 'pending' AS status FROM ({_QUEUE}) WHERE page_path NOT IN (SELECT 'page_' || user_id FROM events WHERE event_type = 'view')")
def queue_enqueue(spark, sf):
    waiting = table(spark, sf, "events").where("event_type = 'view'").select(F.concat(F.lit("page_"), F.col("user_id").cast("string")).alias("page_path")).distinct()
    new = _queue(spark, sf).groupBy("page_path").agg(F.min("event_id").alias("event_id"))
    return new.join(waiting, "page_path", "left_anti").select("page_path", "event_id", F.lit("pending").alias("status"))


@query(f"SELECT page_path, CASE WHEN event_id % 4 = 0 THEN 'completed' ELSE 'pending' END AS status, CASE WHEN event_id % 4 = 0 THEN event_id END AS completed_at FROM ({_QUEUE})")
def queue_update(spark, sf):
    done = F.col("event_id") % 4 == 0
    queue = _queue(spark, sf).groupBy("page_path").agg(F.min("event_id").alias("event_id"))
    return queue.select("page_path", F.when(done, "completed").otherwise("pending").alias("status"), F.when(done, F.col("event_id")).alias("completed_at"))


@query(f"SELECT page_path FROM ({_QUEUE}) WHERE event_id % 4 <> 0")
def queue_pending(spark, sf):
    return queue_update(spark, sf).where("status = 'pending'").select("page_path")
