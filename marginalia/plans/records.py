"""Registry rows: coalescing, flattening, orders, normal forms, blobs and slices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import chunks as C
from marginalia.operators import records as R
from marginalia.operators.aggregates import filled
from marginalia.operators.classify import lexicon_genre, top_labels
from marginalia.plans.catalog import query
from marginalia.plans.texts import GENRES
from marginalia.sources.tables import table


@query("""
    WITH k AS (
      SELECT 'key' AS kind, CAST(c_custkey AS VARCHAR) AS value, c_custkey FROM customer UNION ALL
      SELECT 'number', regexp_extract(c_name, '#0*([0-9]+)', 1), c_custkey FROM customer UNION ALL
      SELECT 'stem', lower(regexp_extract(c_name, '^(.*)#', 1)), c_custkey FROM customer)
    SELECT kind, value, min(c_custkey) AS c_custkey FROM k WHERE trim(value) <> '' GROUP BY 1, 2""")
def registry_indexes(spark, sf):
    """A dimension by three lookup keys; of rows with one key the first."""
    keys = {"key": F.col("c_custkey").cast("string"), "number": F.regexp_extract("c_name", "#0*([0-9]+)", 1), "stem": F.lower(F.regexp_extract("c_name", "^(.*)#", 1))}
    return R.indexed(table(spark, sf, "customer"), keys, "c_custkey")


@query("""
    WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r, min(turn) OVER (PARTITION BY conv_id) AS f FROM conversations WHERE role <> 'system' AND length(text) > 40)
    SELECT conv_id, turn FROM r WHERE turn = f + r""")
def harvest_until_gap(spark, sf):
    """Pages of each category up to the first that is missing."""
    pages = table(spark, sf, "conversations").where((F.col("role") != "system") & (F.length("text") > 40)).select("conv_id", "turn")
    return R.until_gap(pages, ["conv_id"], "turn")


@query("""
    WITH u AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN text END AS s, CASE WHEN role = 'user' THEN text END AS u, CASE WHEN role = 'assistant' THEN text END AS a FROM conversations)
    SELECT conv_id, coalesce(nullif(trim(max(s)), ''), nullif(trim(max(u)), ''), nullif(trim(max(a)), '')) AS head FROM u GROUP BY 1""")
def coalesce_variants(spark, sf):
    """One text for each page from three variants, the first that isn't blank: standard, then dialect, then manuscript."""
    turns = table(spark, sf, "conversations")
    variant = lambda role: F.max(F.when(F.col("role") == role, F.col("text")))
    return turns.groupBy("conv_id").agg(F.coalesce(*(filled(variant(r)) for r in ("system", "user", "assistant"))).alias("head"))


@query("""
    SELECT 'doc_' || doc_id AS anchor_id, coalesce(nullif(trim(text), ''), '') AS text, coalesce(nullif(trim(source), ''), 'unknown') AS source_page FROM documents
    UNION ALL SELECT 'item_' || item_id, coalesce(nullif(trim(text), ''), ''), 'unknown' FROM benchmark""")
def coalesce_schemas(spark, sf):
    """Text, id and page of records under two schemas."""
    fields = {"text": (["text", "verse"], ""), "source_page": (["source", "page"], "unknown")}
    docs = R.coalesced(table(spark, sf, "documents").withColumn("anchor_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))), "anchor_id", fields)
    items = R.coalesced(table(spark, sf, "benchmark").select(F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("anchor_id"), F.col("text").alias("verse")), "anchor_id", fields)
    return docs.unionByName(items)


@query("SELECT event_id, event_type, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), user_id) AS user_id FROM events")
def flatten_extra(spark, sf):
    """Rows with their extra fields at the top level, where an extra field wins."""
    rows = table(spark, sf, "events").select("event_id", "event_type", "user_id", F.from_json("props", "k long").alias("extra"))
    return R.flattened(rows.withColumn("extra", F.struct(F.col("extra.k").alias("user_id"))), "extra")


@query("""
    WITH y AS (SELECT o_custkey, min(year(o_orderdate)) AS a, CASE WHEN count(*) > 1 THEN max(year(o_orderdate)) END AS b FROM orders GROUP BY 1)
    SELECT o_custkey, CASE WHEN b IS NOT NULL THEN 'c. ' || a || '–' || b ELSE 'c. ' || a END AS year_approx FROM y""")
def year_approx(spark, sf):
    """A member's years as text, where a first one is known; without a last one that year alone."""
    years = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("a"), F.when(F.count("*") > 1, F.max(F.year("o_orderdate"))).alias("b"))
    text = F.when(F.col("b").isNotNull(), F.format_string("c. %d–%d", "a", "b")).otherwise(F.format_string("c. %d", "a"))
    return years.where("a IS NOT NULL").select("o_custkey", text.alias("year_approx"))


@query("SELECT DISTINCT source FROM documents WHERE length(trim(source)) >= 4 AND regexp_matches(trim(source), '^[a-z]') AND lower(trim(source)) NOT IN ('anonymous', 'unknown', 'src0')")
def named_sources(spark, sf):
    """Names that begin with a letter, are long enough and not a word for nobody."""
    return table(spark, sf, "documents").select("source").distinct().where(R.named(F.col("source"), ("anonymous", "unknown", "src0"), 4, "a-z"))


@query("""
    SELECT role, count(*) AS n, round(avg(CASE WHEN length(text) > 60 THEN 1.0 ELSE 0.0 END), 4) AS long_rate, round(avg(CASE WHEN regexp_matches(text, '[?]') THEN 1.0 ELSE 0.0 END), 4) AS question_rate FROM conversations GROUP BY 1""")
def slice_metrics(spark, sf):
    """Rates of each slice of an evaluation."""
    flags = {"long_rate": F.length("text") > 60, "question_rate": F.col("text").rlike("[?]")}
    return R.slice_rates(table(spark, sf, "conversations"), "role", flags)


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey")
def registry_by_number(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", "s_name").orderBy("s_suppkey")


@query("SELECT source, count(*) AS images FROM documents GROUP BY 1 ORDER BY images DESC, source")
def images_by_count(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("images")).orderBy(F.desc("images"), "source")


_AR = "'  أَنَا ـ فِي مَكَّةَ  على ' || doc_id"


@query(rf"SELECT doc_id, trim(regexp_replace(translate(regexp_replace({_AR}, '[\x{{064B}}-\x{{065F}}]', '', 'g'), 'أإآٱـ', 'اااا'), '\s+', ' ', 'g')) AS form FROM documents")
def norm_orthographic(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.orthographic(F.concat(F.lit("  أَنَا ـ فِي مَكَّةَ  على "), F.col("doc_id").cast("string"))).alias("form"))


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace({_AR}, '[\x{{064B}}-\x{{065F}}\x{{0640}}]', '', 'g'), '\s+', ' ', 'g')) AS form FROM documents")
def norm_containment(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.containable(F.concat(F.lit("  أَنَا ـ فِي مَكَّةَ  على "), F.col("doc_id").cast("string"))).alias("form"))


@query(rf"SELECT doc_id, regexp_replace({_AR}, '[\x{{064B}}-\x{{065F}}]', '', 'g') AS form FROM documents")
def norm_marks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.without_marks(F.concat(F.lit("  أَنَا ـ فِي مَكَّةَ  على "), F.col("doc_id").cast("string"))).alias("form"))


@query("SELECT page_id, nullif(trim(regexp_extract(html, '<title>(.*?)</title>', 1, 's')), '') AS found FROM pages")
def marked_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.marked(F.col("html"), "<title>", "</title>").alias("found"))


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ') AS at FROM orders")
def iso_timestamps(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.iso_utc(F.col("o_orderdate").cast("timestamp")).alias("at"))


@query("""
    WITH s AS (SELECT source, lang, count(*) AS n, min(doc_id) AS d FROM documents GROUP BY 1, 2)
    SELECT source, '[' || source || '] ' || CAST(sum(n) AS BIGINT) || ' records || ' || string_agg(lang || ': ' || n, ' ||| ' ORDER BY d) AS blob FROM s GROUP BY 1""")
def chunk_blobs(spark, sf):
    """A header and the parts of each group, with the marks that part them."""
    parts = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("d"))
    return C.blobs(parts, "source", F.concat("lang", F.lit(": "), F.col("n").cast("string")), "d", F.col("n"))


@query(r"""
    SELECT doc_id, concat_ws(chr(10), 'plain: ' || left(text, 60), 'folded: ' || trim(regexp_replace(translate(left(text, 60), 'أإآٱ', 'اااا'), '\s+', ' ', 'g')), 'lines: ' || len(string_split(text, chr(10)))) AS variants FROM documents""")
def format_variants(spark, sf):
    """An answer's variants in one text: as it is, in the light form, and its lines; a preview of sixty characters is the feature."""
    head = F.substring("text", 1, 60)
    return table(spark, sf, "documents").select("doc_id", F.concat_ws("\n", F.concat(F.lit("plain: "), head), F.concat(F.lit("folded: "), X.orthographic(head)), F.concat(F.lit("lines: "), F.size(F.split("text", "\n")).cast("string"))).alias("variants"))


@query("""
    WITH l AS (SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
    s AS (SELECT doc_id, len(l) AS lines, list_sum(list_transform(l, lambda x: length(x))) // greatest(len(l), 1) AS width FROM l WHERE len(l) >= 1),
    q AS (SELECT item_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS lines, length(trim(text)) AS width FROM benchmark WHERE trim(text) <> ''),
    r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY abs(s.width - q.width), doc_id) AS rank FROM q JOIN s ON q.lines = s.lines AND abs(s.width - q.width) <= 50)
    SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def similar_structures(spark, sf):
    """Records with as many lines and a width within fifty characters, the three nearest in width."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    docs = table(spark, sf, "documents").select("doc_id", lines.alias("l")).where(F.size("l") >= 1)
    docs = docs.select("doc_id", F.size("l").alias("lines"), F.floor(F.aggregate("l", F.lit(0), lambda a, x: a + F.length(x)) / F.size("l")).alias("width"))
    items = table(spark, sf, "benchmark").where(F.trim("text") != "").select("item_id", F.size(lines).alias("lines"), F.length(F.trim("text")).alias("own"))
    bands = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("own") / 50) + k))  # an item meets the bands beside its own, too
    pairs = items.withColumn("band", bands).join(docs.withColumn("band", F.floor(F.col("width") / 50)), ["lines", "band"]).where(F.abs(F.col("width") - F.col("own")) <= 50)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.abs(F.col("width") - F.col("own")), "doc_id")).cast("int")
    return pairs.withColumn("rank", rank).where("rank <= 3").select("item_id", "doc_id", "rank")


@query(r"""
    WITH t AS (SELECT doc_id, source, list_distinct(regexp_extract_all(lower(text), '\p{L}+')) AS t FROM documents),
    h AS (SELECT doc_id, len(list_intersect(t, ['idiot', 'stupid', 'trash', 'clown'])) + CASE WHEN source = 'src2' THEN 5 ELSE 0 END AS a, len(list_intersect(t, ['license', 'licensed', 'released', 'version'])) + CASE WHEN source = 'src1' THEN 5 ELSE 0 END AS b, len(list_intersect(t, ['the', 'of', 'and', 'is'])) AS c FROM t),
    s AS (SELECT *, greatest(a, b, c) AS top, list_sort([a, b, c])[2] AS second FROM h)
    SELECT doc_id, CASE WHEN top = 0 OR top - second < 1 THEN 'none' WHEN a = top THEN 'insult' WHEN b = top THEN 'licence' ELSE 'prose' END AS genre,
           CASE WHEN top = 0 THEN 0.0 WHEN top - second < 1 THEN 0.2 ELSE round((top - second) / CAST(top AS DOUBLE), 2) END AS confidence FROM s""")
def genre_with_occasion(spark, sf):
    """The lexicon's genre where a record's occasion, here its source, counts five hits for the genre it names."""
    occasion = F.when(F.col("source") == "src2", "insult").when(F.col("source") == "src1", "licence")
    scored = table(spark, sf, "documents").select("doc_id", F.array_distinct(X.tokens(F.col("text"))).alias("t"), occasion.alias("o"))
    return scored.select("doc_id", lexicon_genre(F.col("t"), GENRES, occasion=F.col("o"), tied=0.2).alias("g")).select("doc_id", "g.genre", "g.confidence")


@query(r"""
    WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '\p{L}+')) AS t FROM documents),
    h AS (SELECT doc_id, len(list_intersect(t, ['idiot', 'stupid', 'trash', 'clown'])) AS a, len(list_intersect(t, ['license', 'licensed', 'released', 'version'])) AS b, len(list_intersect(t, ['the', 'of', 'and', 'is'])) AS c FROM t),
    s AS (SELECT *, greatest(a, b, c) AS top, list_sort([a, b, c])[2] AS second FROM h),
    e AS (SELECT doc_id, unnest(['insult', 'licence', 'prose']) AS label, unnest([0, 1, 2]) AS o, unnest([a, b, c]) AS n FROM h), l AS (SELECT doc_id, list(label ORDER BY n DESC, o) AS labels FROM e WHERE n > 0 GROUP BY 1)
    SELECT doc_id, CASE WHEN top = 0 OR top - second < 1 THEN 'none' WHEN a = top THEN 'insult' WHEN b = top THEN 'licence' ELSE 'prose' END AS genre, coalesce(labels, []) AS labels FROM s LEFT JOIN l USING (doc_id)""")
def classify_both(spark, sf):
    """Genre and labels of each record in one row."""
    scored = table(spark, sf, "documents").select("doc_id", F.array_distinct(X.tokens(F.col("text"))).alias("t"))
    return scored.select("doc_id", lexicon_genre(F.col("t"), GENRES)["genre"].alias("genre"), top_labels(F.col("t"), GENRES, 4).alias("labels"))
