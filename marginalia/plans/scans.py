"""Scans of tables, HTML, JSON and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators.images import triaged
from marginalia.plans.catalog import query
from marginalia.sources.tables import table, tolerant_lines


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def scan_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")


@query("SELECT n_nationkey, n_name FROM nation")
def scan_dim_nation(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", "n_name")


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, label FROM embeddings")
def scan_embeddings(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.size("embedding").alias("dim"), "label")


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def explode_props_map(spark, sf):
    return table(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS INTEGER) AS links, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def regex_extract_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1))).alias("links"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


@query("SELECT l_orderkey, l_linenumber, unnest(['quantity', 'discount']) AS side, unnest([l_quantity, l_discount]) AS value FROM lineitem")
def stack_unpivot(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "stack(2, 'quantity', l_quantity, 'discount', l_discount) AS (side, value)")


@query(r"SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, coalesce(list_filter(regexp_extract_all(html, '<a[^>]*>([^<]*)</a>', 1), lambda x: trim(x) <> '')[1], '') AS link FROM pages")
def html_title_links(spark, sf):
    links = F.filter(F.regexp_extract_all("html", F.lit("<a[^>]*>([^<]*)</a>"), F.lit(1)), lambda x: F.trim(x) != "")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.coalesce(F.try_element_at(links, F.lit(1)), F.lit("")).alias("link"))


@query(r"""
    SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
      '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'))) AS digest FROM pages""")
def html_strip_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(X.stripped_html(F.col("html")).cast("binary")).alias("digest"))


@query(r"""
    WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages), u AS (SELECT page_id, unnest(l) AS href, unnest(range(1, len(l) + 1)) AS pos FROM l),
    f AS (SELECT page_id, href, min(pos) AS pos FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM f)
    SELECT page_id, href, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")
def html_links_dedup(spark, sf):
    """Each page's links in order, repeated ones once, at most twenty."""
    links = F.slice(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))), 1, 20)
    return table(spark, sf, "pages").select("page_id", F.posexplode(links).alias("pos", "href")).select("page_id", "href", (F.col("pos") + 1).alias("rank"))


@query("SELECT page_id, left(regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g'), 120) AS key FROM pages")
def url_cache_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.substring(F.regexp_replace("url", "[^a-zA-Z0-9_-]", "_"), 1, 120).alias("key"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY 1")
def jsonl_tolerant(spark, sf):
    """Every third line is broken, and dropped."""
    broken = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("}{"))).otherwise(F.col("props"))
    lines = table(spark, sf, "events").select(F.when(F.col("event_id") % 3 == 0, F.substring(broken, 2, 99)).otherwise(broken).alias("line"))
    return tolerant_lines(lines, "line", "k long").groupBy("k").agg(F.count("*").alias("n"))


@query()
def triage(spark, sf):
    """Triage of images: here each vector's values as grey, in rows of eight."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.transform("embedding", lambda x: F.least(F.greatest((x + 1) * 127.5, F.lit(0)), F.lit(255)).cast("int")).alias("pixels"), F.lit(8).alias("width"))
    return triaged(rows).withColumn("vec_id", F.col("name").cast("long")).drop("name")
