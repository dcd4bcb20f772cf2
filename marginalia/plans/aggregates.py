"""Counting, provenance and distribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import aggregates as A
from marginalia.plans.catalog import query
from marginalia.sources.tables import table


@query("SELECT count(*) AS n FROM documents")
def agg_count(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (WHERE starts_with(source, 'src1')) AS n FROM documents")
def agg_count_if(spark, sf):
    return table(spark, sf, "documents").agg(F.count_if(F.startswith("source", F.lit("src1"))).alias("n"))


@query("SELECT count(DISTINCT CASE WHEN starts_with(source, 'src1') THEN nullif(lang, '') END) AS n FROM documents")
def agg_distinct_if(spark, sf):
    value = F.when(F.startswith("source", F.lit("src1")), F.nullif(F.col("lang"), F.lit("")))
    return table(spark, sf, "documents").agg(F.countDistinct(value).alias("n"))


@query("SELECT count(DISTINCT nullif(trim(coalesce(source, lang)), '')) AS n FROM documents")
def agg_distinct(spark, sf):
    return table(spark, sf, "documents").agg(F.countDistinct(A.filled(F.coalesce("source", "lang"))).alias("n"))


@query("SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, (SELECT count(*) FROM supplier) AS dimension FROM lineitem")
def agg_distinct_fk(spark, sf):
    facts = table(spark, sf, "lineitem").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"))
    size = table(spark, sf, "supplier").agg(F.count("*").alias("dimension"))
    return facts.join(size)  # one row and one row


@query("""
    WITH s AS (SELECT min(nullif(year(o_orderdate), 0)) AS a, max(nullif(year(o_orderdate), 0)) AS b FROM orders)
    SELECT CAST(a AS INTEGER) AS first_year, CAST(b AS INTEGER) AS last_year, CAST(b - a AS INTEGER) AS years, concat_ws('-', a, b) AS coverage FROM s""")
def agg_min_max_span(spark, sf):
    orders = table(spark, sf, "orders").select(F.year("o_orderdate").alias("y"))
    return A.span(orders, "y", "y")


@query("SELECT list_sort(list_distinct(list(nullif(trim(source), '')))) AS vals FROM documents")
def agg_sorted_set(spark, sf):
    return table(spark, sf, "documents").agg(F.sort_array(F.collect_set(A.filled("source"))).alias("vals"))


@query("""
    SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT source) FROM documents) AS sources,
           (SELECT count(DISTINCT lang) FROM documents) AS langs, (SELECT count(*) FROM labels) AS labelled,
           (SELECT count(*) FROM labels WHERE toxic = 1) AS toxic, (SELECT CAST(max(n_chars) AS BIGINT) FROM documents) AS longest""")
def corpus_summary(spark, sf):
    docs = table(spark, sf, "documents").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"), F.max("n_chars").alias("longest"))
    labels = table(spark, sf, "labels").agg(F.count("*").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return docs.join(labels).select("documents", "sources", "langs", "labelled", "toxic", "longest")


@query("""
    SELECT source, n FROM (SELECT source, count(*) AS n, min(doc_id) AS f FROM documents WHERE nullif(trim(source), '') IS NOT NULL GROUP BY source)
    ORDER BY n DESC, f LIMIT 5""")
def topn_by_count(spark, sf):
    return A.top_by_count(table(spark, sf, "documents"), "source", "doc_id", 5)


@query("SELECT count(*) AS n FROM documents WHERE source <> '' AND (contains(lower(source), 'src1') OR contains('src1', lower(source)))")
def count_bidir_substring(spark, sf):
    name, wanted = F.lower("source"), F.lit("src1")
    return table(spark, sf, "documents").where((F.col("source") != "") & (name.contains(wanted) | wanted.contains(name))).agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) FILTER (WHERE toxic = 1) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def count_by_label(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    return joined.groupBy("lang").agg(F.count_if(F.col("toxic") == 1).alias("n"))


@query("""
    SELECT coalesce(CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END, 'unlabelled') AS label, count(*) AS n
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def group_count(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    label = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").otherwise("unlabelled")
    return joined.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("""
    SELECT source, n FROM (SELECT source, count(*) AS n, min(doc_id) AS f FROM documents WHERE lang = 'de' GROUP BY source) ORDER BY n DESC, f LIMIT 3""")
def topn_filtered(spark, sf):
    return A.top_by_count(table(spark, sf, "documents").where("lang = 'de'"), "source", "doc_id", 3)


TERMS_A, TERMS_B = ("idiot", "stupid", "trash"), ("license", "idiot")
_PAIR = "(" + " OR ".join(f"contains(lower(text), '{t}')" for t in TERMS_A) + ") AND ((" + " OR ".join(f"contains(lower(text), '{t}')" for t in TERMS_B) + ") OR lang = 'en')"


def _term_pair(docs):
    text = F.lower("text")
    any_of = lambda terms: F.greatest(*(text.contains(t) for t in terms))
    return docs.where(any_of(TERMS_A) & (any_of(TERMS_B) | (F.col("lang") == "en")))


@query(f"SELECT doc_id FROM documents WHERE {_PAIR}")
def term_pair_match(spark, sf):
    return _term_pair(table(spark, sf, "documents")).select("doc_id")


@query(f"""SELECT source, n FROM (SELECT source, count(*) AS n, min(doc_id) AS f FROM documents WHERE {_PAIR} GROUP BY source) ORDER BY n DESC, f LIMIT 5""")
def term_pair_topn(spark, sf):
    return A.top_by_count(_term_pair(table(spark, sf, "documents")), "source", "doc_id", 5)


@query("""
    SELECT count(*) > 0 AS present, count(*) AS n, coalesce(list_sort(list_distinct(list(source))), []) AS sources FROM documents WHERE contains(lower(text), 'trash')""")
def entity_presence(spark, sf):
    found = table(spark, sf, "documents").where(F.lower("text").contains("trash"))
    return found.agg((F.count("*") > 0).alias("present"), F.count("*").alias("n"), F.sort_array(F.collect_set("source")).alias("sources"))


@query("""
    SELECT source, n, CAST(row_number() OVER (ORDER BY n DESC, f) AS INTEGER) AS rank FROM (
      SELECT source, count(*) AS n, min(doc_id) AS f FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY source)""")
def rank_of_group(spark, sf):
    good = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id")
    return A.ranked_groups(good, "source", "doc_id")


@query("""
    SELECT band, count(*) AS n FROM (
      SELECT CASE WHEN value = 0 THEN 'zero' WHEN value < 5 THEN 'under 5' WHEN value < 10 THEN 'under 10' WHEN value < 20 THEN 'under 20' ELSE '20 and over' END AS band
      FROM events) GROUP BY band""")
def audit_histogram(spark, sf):
    value = F.col("value")
    band = F.when(value == 0, "zero").otherwise(A.banded(value, (5, 10, 20), ("under 5", "under 10", "under 20", "20 and over")))
    return table(spark, sf, "events").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


LABELS = ("view", "click", "purchase", "signup", "error", "refund")


@query("""
    SELECT label, count(t) AS n FROM (SELECT unnest(['view', 'click', 'purchase', 'signup', 'error', 'refund']) AS label) LEFT JOIN (
      SELECT unnest(CASE WHEN value > 10 THEN [event_type, 'purchase'] ELSE [event_type] END) AS t FROM events) ON t = label GROUP BY label""")
def explode_count_zero_fill(spark, sf):
    tagged = table(spark, sf, "events").select(F.when(F.col("value") > 10, F.array("event_type", F.lit("purchase"))).otherwise(F.array("event_type")).alias("labels"))
    return A.multi_label_counts(tagged, "labels", LABELS)


@query("""
    SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O",
           count(*) FILTER (WHERE o_orderstatus = 'P') AS "P", count(*) FILTER (WHERE o_orderstatus = 'X') AS "X" FROM orders GROUP BY 1""")
def pivot_status(spark, sf):
    wide = table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P", "X"]).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


@query("""
    WITH t AS (SELECT user_id, count(*) FILTER (WHERE value >= 20) AS high, count(*) FILTER (WHERE value >= 5 AND value < 20) AS medium, count(*) FILTER (WHERE value < 5) AS low FROM events GROUP BY 1)
    SELECT *, CASE WHEN high + medium + low = 0 THEN 'FAIL' WHEN low / (high + medium + low) > 0.3 THEN 'FAIL' WHEN low > 0 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM t""")
def qa_verdict(spark, sf):
    v = F.col("value")
    tiers = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(v >= 20).alias("high"), F.count_if((v >= 5) & (v < 20)).alias("medium"), F.count_if(v < 5).alias("low"))
    return tiers.withColumn("verdict", A.verdict(F.col("high"), F.col("medium"), F.col("low")))


@query("""
    SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'Correct' WHEN bool_and(event_type = 'error') THEN 'Incorrect' ELSE 'Ambiguous' END AS verdict FROM events GROUP BY 1""")
def bool_agg_verdict(spark, sf):
    any_, all_ = F.bool_or(F.col("event_type") == "purchase"), F.bool_and(F.col("event_type") == "error")
    return table(spark, sf, "events").groupBy("user_id").agg(F.when(any_, "Correct").when(all_, "Incorrect").otherwise("Ambiguous").alias("verdict"))


@query("""
    SELECT event_type, quantile_cont(value, 0.5) AS p50, list_sort(list(value))[CAST(least(floor(count(*) * 0.95), count(*) - 1) AS BIGINT) + 1] AS p95 FROM events GROUP BY 1""")
def latency_p50_p95(spark, sf):
    """The median and the value at the upper rank, each of the values themselves, by selection."""
    events = table(spark, sf, "events").select("event_type", "value")
    high = A.selected(events, ["event_type"], "value", A.upper_rank(0.95), "p95").withColumnRenamed("event_type", "_type")
    return A.median(events, ["event_type"], "value", "p50").join(high, F.col("event_type").eqNullSafe(F.col("_type"))).select("event_type", "p50", "p95")


@query("""
    SELECT stage, round_even(avg(ms), 1) AS mean FROM (
      SELECT unnest(['value', 'k']) AS stage, unnest([value, CAST(json_extract_string(props, '$.k') AS DOUBLE)]) AS ms FROM events) GROUP BY stage""")
def map_key_mean(spark, sf):
    timings = F.create_map(F.lit("value"), F.col("value"), F.lit("k"), F.get_json_object("props", "$.k").cast("double"))
    return table(spark, sf, "events").select(F.explode(timings).alias("stage", "ms")).groupBy("stage").agg(F.bround(F.avg("ms"), 1).alias("mean"))


@query("""
    SELECT event_type, round(avg(CASE WHEN value > 10 THEN 1 ELSE 0 END), 4) AS over_rate, round(avg(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END), 4) AS even_rate FROM events GROUP BY 1""")
def rate_metrics(spark, sf):
    rate = lambda c: F.round(F.avg(c.cast("int")), 4)
    return table(spark, sf, "events").groupBy("event_type").agg(rate(F.col("value") > 10).alias("over_rate"), rate(F.col("user_id") % 2 == 0).alias("even_rate"))


@query("""
    WITH g AS (SELECT user_id, list(event_type || '_p' || event_id) FILTER (WHERE value > 20) AS gold, list(event_type || '_p' || event_id) FILTER (WHERE value > 15) AS got FROM events GROUP BY 1),
    r AS (SELECT user_id, list_has_any(coalesce(gold, []), coalesce(got, [])) AS e,
      list_has_any(list_transform(coalesce(gold, []), lambda x: split_part(x, '_p', 1)), list_transform(coalesce(got, []), lambda x: split_part(x, '_p', 1))) AS p FROM g WHERE gold IS NOT NULL)
    SELECT round(avg(CAST(e AS INTEGER)), 4) AS exact, round(avg(CAST(p AS INTEGER)), 4) AS relaxed FROM r""")
def recall_exact_relaxed(spark, sf):
    anchor = F.concat("event_type", F.lit("_p"), F.col("event_id").cast("string"))
    sets = table(spark, sf, "events").groupBy("user_id").agg(F.collect_list(F.when(F.col("value") > 20, anchor)).alias("gold"), F.collect_list(F.when(F.col("value") > 15, anchor)).alias("got"))
    stem = lambda a: F.transform(a, lambda x: F.when(F.instr(x, "_p") > 1, F.substring_index(x, "_p", 1)).otherwise(x))
    scored = sets.where(F.size("gold") > 0).select(F.arrays_overlap("gold", "got").alias("e"), F.arrays_overlap(stem(F.col("gold")), stem(F.col("got"))).alias("p"))
    return scored.agg(F.round(F.avg(F.col("e").cast("int")), 4).alias("exact"), F.round(F.avg(F.col("p").cast("int")), 4).alias("relaxed"))


@query("""
    SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END AS level, count(*) AS n FROM documents GROUP BY 1""")
def level_counts(spark, sf):
    level = A.banded(F.col("n_chars"), (500, 5000), ("short", "medium", "long"))
    return table(spark, sf, "documents").groupBy(level.alias("level")).agg(F.count("*").alias("n"))


@query("""
    SELECT CAST(sum(n) AS BIGINT) AS n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) WHERE contains(source, 'src1') OR contains(source, 'src10') OR contains(source, 'src2')""")
def variant_sum(spark, sf):
    counts = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    variants = F.array(*(F.lit(v) for v in ("src1", "src10", "src2")))
    return counts.where(F.exists(variants, lambda v: F.col("source").contains(v))).agg(F.sum("n").alias("n"))


@query("""
    SELECT count(*) FILTER (WHERE c < 0.1) AS good, count(*) FILTER (WHERE c >= 0.1 AND c < 0.25) AS fair, count(*) FILTER (WHERE c >= 0.25) AS poor
    FROM (SELECT coalesce(nullif(l_discount, 0), 1.0) AS c FROM lineitem)""")
def band_counts(spark, sf):
    c = F.coalesce(F.nullif(F.col("l_discount"), F.lit(0.0)), F.lit(1.0))
    return table(spark, sf, "lineitem").agg(F.count_if(c < 0.1).alias("good"), F.count_if((c >= 0.1) & (c < 0.25)).alias("fair"), F.count_if(c >= 0.25).alias("poor"))


@query("SELECT conv_id, string_agg(role || ':' || length(text), ' | ' ORDER BY turn) AS joined FROM conversations GROUP BY conv_id")
def ordered_string_agg(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.concat("role", F.lit(":"), F.length("text").cast("string")).alias("line"))
    return A.ordered_text(turns, ["conv_id"], "turn", "line")
