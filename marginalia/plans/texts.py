"""Text functions as queries.  Arabic normalisers run on literals, as the tables hold no Arabic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import text as X
from marginalia.operators import aggregates as A
from marginalia.plans.catalog import query
from marginalia.sources.tables import table

SAMPLES = ("قَصِيدَةٌ فِي الغَزَلِ", "أهلاً وسهلاً ١٢٣ abc", "إلى مدرسةٍ كبـــيرة،", "آمنَ ى ئ ؤ", "", "  ")
_VALUES = "(SELECT unnest([" + ", ".join(f"'{s}'" for s in SAMPLES) + "]) AS text)"
_MARKS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06DC}\x{06DF}-\x{06E4}\x{06E7}-\x{06E8}\x{06EA}-\x{06ED}]"


def _samples(spark):
    return spark.range(1).select(F.explode(F.array(*(F.lit(s) for s in SAMPLES))).alias("text"))


def _sql(fold: str, to: str, marks: str = _MARKS, keep: bool = False) -> str:
    inner = f"translate(regexp_replace(text, '{marks}', '', 'g'), '{fold}', '{to}')"
    bare = inner if keep else f"regexp_replace({inner}, '[^\\x{{0600}}-\\x{{06FF}}]', ' ', 'g')"
    return f"SELECT text, trim(regexp_replace({bare}, '\\s+', ' ', 'g')) AS norm FROM {_VALUES}"


@query(_sql("أإآٱةىـ", "ااااهي"))
def norm_n1(spark, sf):
    return _samples(spark).select("text", X.searchable(F.col("text")).alias("norm"))


@query(_sql("أإآٱةـ", "ااااه"))
def norm_n2(spark, sf):
    return _samples(spark).select("text", X.matchable(F.col("text")).alias("norm"))


@query(_sql("أإآٱةىئؤیکـ", "ااااهييويك", r"[\x{064B}-\x{0652}]", keep=True))
def norm_n3(spark, sf):
    return _samples(spark).select("text", X.lexical(F.col("text")).alias("norm"))


@query(r"SELECT text, trim(regexp_replace(lower(translate(text, 'أإآٱةى', 'ااااهي')), '\s+', ' ', 'g')) AS key FROM " + _VALUES)
def norm_key(spark, sf):
    return _samples(spark).select("text", X.cache_key(F.col("text")).alias("key"))


@query(r"SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '\p{L}+')) AS t, len(t) AS n FROM documents".replace(", len(t) AS n", "").replace("list_distinct(", "list_sort(list_distinct(").replace("'))", "')))"))
def token_set(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sort_array(F.array_distinct(X.tokens(F.col("text")))).alias("t"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '(?m)^Licensed.*$', '', 'g'), '\n{2,}', chr(10), 'g'), chr(10)) AS clean FROM documents")
def clean_ocr(spark, sf):
    bare = F.regexp_replace(F.regexp_replace("text", r"(?m)^Licensed.*$", ""), r"\n{2,}", "\n")
    return table(spark, sf, "documents").select("doc_id", F.btrim(bare, F.lit("\n")).alias("clean"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '\p{L}+')) AS INTEGER) AS n, md5(array_to_string(regexp_extract_all(lower(text), '\p{L}+'), ' ')) AS digest FROM documents")
def tokenise(spark, sf):
    t = X.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ").cast("binary")).alias("digest"))


@query(r"SELECT doc_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\s.,;:!?]+'), lambda x: x <> '') AS t FROM documents)")
def tokenise_punct(spark, sf):
    t = X.split_tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ").cast("binary")).alias("digest"))


@query("SELECT doc_id, source || ' :: ' || array_to_string(list_slice(string_split(text, ' '), 1, 10), ' ') AS key FROM documents")
def composite_key(spark, sf):
    head = F.array_join(F.slice(F.split("text", " "), 1, 10), " ")
    return table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit(" :: "), head).alias("key"))


@query("""
    WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
    p AS (SELECT doc_id, l, unnest(range(1, len(l) + 1, 2)) AS i FROM l)
    SELECT doc_id || '_b' || lpad(CAST((i + 1) // 2 AS VARCHAR), CAST(greatest(2, length(CAST((i + 1) // 2 AS VARCHAR))) AS INTEGER), '0') AS id, l[i] AS first, CASE WHEN i < len(l) THEN l[i + 1] END AS second FROM p""")
def split_pairs(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(X.couplets(F.col("text"))).alias("pos", "pair"))
    return rows.select(F.format_string("%d_b%02d", "doc_id", F.col("pos") + 1).alias("id"), "pair.first", "pair.second")


@query()
def paragraphs(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(X.paragraphs(F.col("text"))).alias("pos", "text"))
    return rows.select("doc_id", F.col("pos").alias("paragraph"), "text")


DIALECT = {"the": "der", "of": "von", "and": "und", "is": "ist"}


@query("""
    SELECT doc_id, md5(array_to_string(list_transform(string_split(text, ' '), lambda t: CASE t WHEN 'the' THEN 'der' WHEN 'of' THEN 'von' WHEN 'and' THEN 'und' WHEN 'is' THEN 'ist' ELSE t END), ' ')) AS digest FROM documents""")
def dict_token_map(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.mapped_tokens(F.col("text"), DIALECT).cast("binary")).alias("digest"))


@query("""
    SELECT doc_id, term, meaning, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS term FROM documents)
    JOIN (SELECT unnest(['the', 'of', 'and', 'is']) AS term, unnest(['der', 'von', 'und', 'ist']) AS meaning) USING (term) GROUP BY 1, 2, 3""")
def lexicon_join(spark, sf):
    lexicon = spark.range(1).select(F.explode(F.create_map(*(F.lit(x) for kv in DIALECT.items() for x in kv))).alias("term", "meaning"))
    terms = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("term"))
    return terms.join(F.broadcast(lexicon), "term").groupBy("doc_id", "term", "meaning").agg(F.count("*").alias("n"))  # the lexicon is a constant


@query("SELECT 'the' AS term, 'der' AS meaning, CAST(4 AS BIGINT) AS size")
def lexicon_lookup(spark, sf):
    lexicon = spark.range(1).select(F.explode(F.create_map(*(F.lit(x) for kv in DIALECT.items() for x in kv))).alias("term", "meaning"))
    return lexicon.agg(F.max(F.when(F.col("term") == "the", F.struct("term", "meaning"))).alias("m"), F.count("*").alias("size")).select("m.term", "m.meaning", "size")


@query(r"""
    SELECT doc_id, round(CASE WHEN length(regexp_replace(text, '\s', '', 'g')) > 0 THEN length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / CAST(length(regexp_replace(text, '\s', '', 'g')) AS DOUBLE) ELSE 0 END, 6) AS share FROM documents""")
def lang_ratio(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(X.letter_share(F.col("text"), "a-zA-Z"), 6).alias("share"))


@query()
def first_sentences(spark, sf):
    parts = F.slice(F.split("text", r"(?<=[.!?])\s+"), 1, 2)
    return table(spark, sf, "documents").select("doc_id", F.array_join(parts, " ").alias("head"))


@query(r"""
    SELECT doc_id, TRY_CAST(coalesce(nullif(regexp_extract(text, '(1[0-9]{3})m', 1), ''), nullif(regexp_extract(text, '([12][0-9]{3})', 1), '')) AS INTEGER) AS year FROM documents""")
def extract_year(spark, sf):
    found = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.coalesce(found("(1[0-9]{3})m"), found("([12][0-9]{3})")).cast("int").alias("year"))


@query("""SELECT doc_id, CASE WHEN contains(text, 'trash') THEN 'trash' WHEN contains(text, 'clown') THEN 'clown' WHEN contains(text, 'the') THEN 'the' END AS word FROM documents""")
def first_keyword(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.first_of(F.col("text"), ("trash", "clown", "the")).alias("word"))


@query("""SELECT doc_id, CASE WHEN contains(text, 'License') THEN 'licence' WHEN contains(text, '@') THEN 'contact' WHEN contains(text, 'the') THEN 'prose' ELSE 'other' END AS category FROM documents""")
def category_map(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.category(F.col("text"), {"License": "licence", "@": "contact", "the": "prose"}, "other").alias("category"))


@query(r"SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, 'href=\"(/[a-z]+)\"', 1))) AS tags FROM pages".replace('\\"', '"'))
def extract_tags(spark, sf):
    tags = F.regexp_extract_all("html", F.lit('href="(/[a-z]+)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.sort_array(F.array_distinct(tags)).alias("tags"))


@query("""
    SELECT event_id, event_type IN ('view', 'click') AS valid, list_filter([event_type, 'click', 'bogus'], lambda x: x IN ('view', 'click', 'purchase')) AS kept FROM events""")
def validate_enum(spark, sf):
    kept = F.filter(F.array("event_type", F.lit("click"), F.lit("bogus")), lambda x: x.isin("view", "click", "purchase"))
    return table(spark, sf, "events").select("event_id", F.col("event_type").isin("view", "click").alias("valid"), kept.alias("kept"))


@query("""
    SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], left(text, 80)) AS line FROM documents""")
def first_line(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.first_line(F.col("text")).alias("line"))


@query("""
    SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1996 THEN '—' WHEN o_orderstatus = 'P' THEN 'c. ' || year(o_orderdate) ELSE 'c. ' || year(o_orderdate) || '-' || (year(o_orderdate) + 1) END AS range FROM orders""")
def format_date_range(spark, sf):
    y = F.year("o_orderdate")
    text = F.when(y == 1996, "—").when(F.col("o_orderstatus") == "P", F.concat(F.lit("c. "), y.cast("string"))).otherwise(F.concat(F.lit("c. "), y.cast("string"), F.lit("-"), (y + 1).cast("string")))
    return table(spark, sf, "orders").select("o_orderkey", text.alias("range"))


@query("""
    SELECT doc_id, CASE source WHEN 'src1' THEN '[secondary]' WHEN 'src2' THEN '[oral]' ELSE '[primary]' END || ' ' || source || ', ' || lang || ': ' || left(text, 40) || CASE WHEN length(text) > 40 THEN '…' ELSE '' END AS citation FROM documents""")
def format_citation(spark, sf):
    badge = F.when(F.col("source") == "src1", "[secondary]").when(F.col("source") == "src2", "[oral]").otherwise("[primary]")
    more = F.when(F.length("text") > 40, "…").otherwise("")
    return table(spark, sf, "documents").select("doc_id", F.concat(badge, F.lit(" "), "source", F.lit(", "), "lang", F.lit(": "), F.substring("text", 1, 40), more).alias("citation"))


@query(r"SELECT c_custkey, regexp_extract(c_name, '^([A-Za-z ]+)#', 1) AS name FROM customer")
def regex_prefix_name(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.regexp_extract("c_name", r"^([A-Za-z ]+)#", 1).alias("name"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '/[0-9]+') THEN regexp_extract(url, '^(.*)/([0-9]+)', 1) ELSE url END AS stem, coalesce(TRY_CAST(nullif(regexp_extract(url, '^(.*)/([0-9]+)', 2), '') AS INTEGER), 0) AS page FROM pages""")
def parse_page_key(spark, sf):
    hit = F.col("url").rlike("/[0-9]+")
    page = F.nullif(F.regexp_extract("url", "^(.*)/([0-9]+)", 2), F.lit("")).try_cast("int")
    return table(spark, sf, "pages").select("page_id", F.when(hit, F.regexp_extract("url", "^(.*)/([0-9]+)", 1)).otherwise(F.col("url")).alias("stem"), F.coalesce(page, F.lit(0)).alias("page"))


@query("SELECT doc_id, round(CAST(n_chars AS DOUBLE) / 7, 2) AS a, round_even(CAST(n_chars AS DOUBLE) / 8, 1) AS b FROM documents")
def rounding(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(F.col("n_chars") / 7, 2).alias("a"), F.bround(F.col("n_chars") / 8, 1).alias("b"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fenced(spark, sf):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    bare = F.regexp_replace(fenced, r"^```(?:json)?\s*|\s*```$", "")
    return table(spark, sf, "events").select("event_id", F.from_json(bare, "k long").getField("k").alias("k"))


@query("""
    WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) SELECT conv_id, list(role ORDER BY t) AS roles FROM f GROUP BY 1""")
def ordered_distinct(spark, sf):
    ordered = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(ordered.alias("roles"))


@query("""
    SELECT CAST(n AS INTEGER) AS n, CAST(i AS INTEGER) AS i, round(100 + 50 * cos(2 * pi() * i / n), 6) AS x, round(100 + 50 * sin(2 * pi() * i / n), 6) AS y
    FROM (SELECT n, unnest(range(0, n)) AS i FROM (SELECT unnest([3, 6, 12]) AS n))""")
def circle_polygon(spark, sf):
    sizes = spark.range(1).select(F.explode(F.array(F.lit(3), F.lit(6), F.lit(12))).alias("n"))
    points = sizes.select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    angle = F.lit(2.0) * F.pi() * F.col("i") / F.col("n")
    return points.select("n", "i", F.round(100 + 50 * F.cos(angle), 6).alias("x"), F.round(100 + 50 * F.sin(angle), 6).alias("y"))


GENRES = {"insult": ("idiot", "stupid", "trash", "clown"), "licence": ("license", "licensed", "released", "version"), "prose": ("the", "of", "and", "is")}


@query(r"""
    WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '\p{L}+')) AS t FROM documents),
    h AS (SELECT doc_id, len(list_intersect(t, ['idiot', 'stupid', 'trash', 'clown'])) AS a, len(list_intersect(t, ['license', 'licensed', 'released', 'version'])) AS b, len(list_intersect(t, ['the', 'of', 'and', 'is'])) AS c FROM t),
    s AS (SELECT *, greatest(a, b, c) AS top, list_sort([a, b, c])[2] AS second FROM h)
    SELECT doc_id, CASE WHEN top = 0 OR top - second < 1 THEN 'none' WHEN a = top THEN 'insult' WHEN b = top THEN 'licence' ELSE 'prose' END AS genre,
           CASE WHEN top = 0 OR top - second < 1 THEN 0.0 ELSE round((top - second) / CAST(top AS DOUBLE), 2) END AS confidence FROM s""")
def genre_enrich(spark, sf):
    from marginalia.operators.classify import lexicon_genre

    scored = table(spark, sf, "documents").select("doc_id", F.array_distinct(X.tokens(F.col("text"))).alias("t"))
    return scored.select("doc_id", lexicon_genre(F.col("t"), GENRES).alias("g")).select("doc_id", "g.genre", "g.confidence")


@query(r"""
    WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '\p{L}+')) AS t FROM documents),
    h AS (SELECT doc_id, unnest(['insult', 'licence', 'prose']) AS label, unnest([0, 1, 2]) AS o, unnest([len(list_intersect(t, ['idiot', 'stupid', 'trash', 'clown'])), len(list_intersect(t, ['license', 'licensed', 'released', 'version'])), len(list_intersect(t, ['the', 'of', 'and', 'is']))]) AS n FROM t),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o) AS r FROM h WHERE n > 0)
    SELECT t.doc_id, coalesce((SELECT list(label ORDER BY r.r) FROM r WHERE r.doc_id = t.doc_id AND r.r <= 2), []) AS labels FROM t""")
def multilabel_topk(spark, sf):
    from marginalia.operators.classify import top_labels

    scored = table(spark, sf, "documents").select("doc_id", F.array_distinct(X.tokens(F.col("text"))).alias("t"))
    return scored.select("doc_id", top_labels(F.col("t"), GENRES, 2).alias("labels"))


@query(r"""
    WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '\p{L}+')) AS t FROM documents),
    s AS (SELECT doc_id, list_reverse_sort([len(list_intersect(t, ['idiot', 'stupid', 'trash', 'clown'])), len(list_intersect(t, ['license', 'licensed', 'released', 'version'])), len(list_intersect(t, ['the', 'of', 'and', 'is']))]) AS s FROM t)
    SELECT doc_id, CAST(s[1] AS INTEGER) AS best, CAST(s[2] AS INTEGER) AS second, s[1] - s[2] >= 2 AS clear FROM s""")
def margin_argmax(spark, sf):
    from marginalia.operators.classify import hits

    scored = table(spark, sf, "documents").select("doc_id", F.array_distinct(X.tokens(F.col("text"))).alias("t"))
    ordered = scored.select("doc_id", F.sort_array(F.array(*(hits(F.col("t"), w) for w in GENRES.values())), asc=False).alias("s"))
    return ordered.select("doc_id", F.get("s", 0).alias("best"), F.get("s", 1).alias("second"), (F.get("s", 0) - F.get("s", 1) >= 2).alias("clear"))


_HASHED = T.ArrayType(T.DoubleType())


@query()
def hash_embedding(spark, sf):
    """A unit vector from each text's hash: the same text always gives the same one."""
    @F.pandas_udf(_HASHED)
    def embed(digest: pd.Series) -> pd.Series:
        def one(d: str) -> list[float]:
            v = np.random.default_rng(int(d[:16], 16)).standard_normal(16)
            return (v / np.linalg.norm(v)).tolist()

        return digest.map(one)

    return table(spark, sf, "benchmark").select("item_id", embed(F.sha2("text", 256)).alias("embedding"))


@query("SELECT coalesce(nullif(trim(source), ''), 'manuscript') AS source_type, coalesce(nullif(CASE WHEN lang = 'en' THEN '' ELSE lang END, ''), 'unknown') AS genre, doc_id FROM documents")
def project_defaults(spark, sf):
    genre = F.nullif(F.when(F.col("lang") == "en", "").otherwise(F.col("lang")), F.lit(""))
    return table(spark, sf, "documents").select(F.coalesce(A.filled("source"), F.lit("manuscript")).alias("source_type"), F.coalesce(genre, F.lit("unknown")).alias("genre"), "doc_id")


@query("""SELECT event_id, event_type, CAST(coalesce(json_extract_string(props, '$.k'), '0') AS BIGINT) AS page_number, coalesce(json_extract_string(props, '$.poet'), 'user ' || user_id) AS poet FROM events""")
def project_canonical(spark, sf):
    """A record's fields with an overlay of extra ones, which win where they are there."""
    extra = F.from_json("props", "map<string,string>")
    over = lambda name, default: F.coalesce(F.try_element_at("extra", F.lit(name)), default)
    rows = table(spark, sf, "events").withColumn("extra", extra)
    return rows.select("event_id", "event_type", over("k", F.lit("0")).cast("long").alias("page_number"), over("poet", F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("poet"))
