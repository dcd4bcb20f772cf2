"""Query routing, guardrails and acceptance rules, over the conversation table."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import classify as K
from marginalia.operators import joins as J
from marginalia.plans.catalog import query
from marginalia.sources.tables import table

#: Cues and their weights, ordered rules: this engine's own, for the driver's invented prose.
CUES = {"the": 0.6, "license|licence": 0.3, r"\?": 0.1, "[0-9]": 0.2}
SLOTS = {"licence": "license|licensed", "insult": "idiot|trash|clown", "prose": "the"}
UNSUPPORTED = {"network": "https?://", "mail": "@"}
#: A turn's checks before the registry's and after it, in order; all patterns of a check must match.
EARLY = {
    "out_of_scope": ["idiot|scum"], "unsupported": ["https?://"], "image_provenance": ["[.](png|jpg)", "who|where"],
    "capabilities": ["can you|help"], "pipeline_debug": ["debug|pipeline"],
}
LATE = {"content": ["(^|[^a-z])(find|show|give|tell)[^a-z].{0,40}(text|page|line)"], "provenance": ["license"], "counting": ["[0-9]"]}


def _turns(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.lower("text").alias("t"))


_T = "(SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user')"
_CASE = lambda rules: "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in rules.items()) + " END"
_SUM = "least(1.0::DOUBLE, round(" + " + ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for p, w in CUES.items()) + ", 6))"


@query(f"SELECT conv_id, turn, {_SUM} AS confidence, {_SUM} >= 0.7 AS fires FROM {_T}")
def intent_classify(spark, sf):
    confidence, fires = K.additive(F.col("t"), CUES, 0.7)
    return _turns(spark, sf).select("conv_id", "turn", confidence.alias("confidence"), fires.alias("fires"))


@query(f"SELECT conv_id, turn, {_CASE(SLOTS)} AS genre FROM {_T}")
def genre_slot(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", K.first_match(F.col("t"), SLOTS).alias("genre"))


@query(f"SELECT conv_id, turn, {_CASE(UNSUPPORTED)} AS dimension FROM {_T}")
def unsupported_dim(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", K.first_match(F.col("t"), UNSUPPORTED).alias("dimension"))


_MENTION = f"""
    WITH n AS (SELECT DISTINCT lower(lang) AS name FROM documents UNION SELECT 'the' UNION SELECT 'thing'),
    m AS (SELECT conv_id, turn, name FROM {_T} JOIN n ON length(name) >= 3 AND regexp_matches(t, '(^|[^a-z])' || name || '([^a-z]|$)'))
    SELECT conv_id, turn, arg_min(name, (-length(name), name)) AS entity FROM m GROUP BY 1, 2"""


@query(_MENTION)
def entity_mention(spark, sf):
    """The longest known name of three letters or more that stands alone; names join on words, not by a nested loop."""
    names = table(spark, sf, "documents").select(F.lower("lang").alias("name")).union(spark.range(1).select(F.explode(F.array(F.lit("the"), F.lit("thing"))))).distinct().where(F.length("name") >= 3)
    words = _turns(spark, sf).select("conv_id", "turn", F.explode(F.array_distinct(F.split("t", "[^a-z]+"))).alias("name"))
    return words.join(names, "name").groupBy("conv_id", "turn").agg(F.min(F.struct((-F.length("name")).alias("l"), "name")).alias("m")).select("conv_id", "turn", F.col("m.name").alias("entity"))


_WHEN = lambda checks: " ".join("WHEN " + " AND ".join(f"regexp_matches(t, '{p}')" for p in ps) + f" THEN '{n}'" for n, ps in checks.items())


@query(f"""
    SELECT conv_id, turn, CASE {_WHEN(EARLY)} WHEN {_SUM} >= 0.7 THEN 'registry' WHEN entity IS NOT NULL THEN 'name' {_WHEN(LATE)} ELSE 'retrieval' END AS route, entity
    FROM {_T} LEFT JOIN ({_MENTION}) USING (conv_id, turn)""")
def route_cascade(spark, sf):
    """Ten outcomes: refusals and fast answers first, a sure intent, a known name (which vetoes the cues after it), the rest."""
    t = F.col("t")
    matched = lambda checks: {n: reduce(and_, (F.rlike(t, F.lit(p)) for p in ps)) for n, ps in checks.items()}
    sure = {"registry": K.additive(t, CUES, 0.7)[1], "name": F.col("entity").isNotNull()}
    turns = _turns(spark, sf).join(entity_mention(spark, sf), ["conv_id", "turn"], "left")
    return turns.select("conv_id", "turn", K.first_true(matched(EARLY) | sure | matched(LATE), "retrieval").alias("route"), "entity")


_GRADE = "(SELECT event_id, event_type, user_id, value / 30.0::DOUBLE AS conf FROM events)"


def _graded(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", "user_id", (F.col("value") / 30.0).alias("conf"))


@query(f"SELECT event_id, conf >= 0.6 AND event_type IN ('view', 'click') AS accepted FROM {_GRADE}")
def route_accept(spark, sf):
    return _graded(spark, sf).select("event_id", ((F.col("conf") >= 0.6) & F.col("event_type").isin("view", "click")).alias("accepted"))


@query(f"SELECT event_id, CASE WHEN conf >= 0.7 THEN event_type END AS hard, CASE WHEN conf < 0.7 THEN event_type END AS soft FROM {_GRADE}")
def filter_split(spark, sf):
    sure = F.col("conf") >= 0.7
    return _graded(spark, sf).select("event_id", F.when(sure, F.col("event_type")).alias("hard"), F.when(~sure, F.col("event_type")).alias("soft"))


@query(f"SELECT count(*) FILTER (WHERE event_type = 'error' AND conf > 0.9) AS violations, count(*) AS checked FROM {_GRADE}")
def routing_invariant(spark, sf):
    return _graded(spark, sf).agg(F.count_if((F.col("event_type") == "error") & (F.col("conf") > 0.9)).alias("violations"), F.count("*").alias("checked"))


@query(f"SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'pass' WHEN event_type = 'purchase' THEN 'pass' WHEN conf < 0.5 THEN 'flag' ELSE 'retry' END AS verdict FROM {_GRADE}")
def reflect_verdict(spark, sf):
    v = F.when(F.col("user_id") % 5 == 0, "pass").when(F.col("event_type") == "purchase", "pass").when(F.col("conf") < 0.5, "flag").otherwise("retry")
    return _graded(spark, sf).select("event_id", v.alias("verdict"))


_CITED = """
    WITH c AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="/([a-z]+)"', 1))) AS tag FROM pages),
    k AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS tag FROM documents WHERE lang = 'en')"""


def _unresolved(spark, sf):
    tags = table(spark, sf, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([a-z]+)"'), F.lit(1)))).alias("tag"))
    known = table(spark, sf, "documents").where("lang = 'en'").select(F.explode(F.split(F.lower("text"), " ")).alias("tag")).distinct()
    return tags.join(known, "tag", "left_anti")


@query(_CITED + " SELECT page_id, tag FROM c WHERE tag NOT IN (SELECT tag FROM k)")
def guard_citation(spark, sf):
    """Citations that the registry does not hold."""
    return _unresolved(spark, sf).select("page_id", "tag")


@query(r"""
    WITH d AS (SELECT doc_id, unnest(list_distinct(string_split(text, ' '))) AS w FROM documents), b AS (SELECT item_id, list_distinct(string_split(text, ' ')) AS t FROM benchmark WHERE len(string_split(text, ' ')) >= 12),
    n AS (SELECT item_id, doc_id, count(*) AS n FROM (SELECT item_id, unnest(t) AS w FROM b) JOIN d USING (w) GROUP BY 1, 2),
    o AS (SELECT item_id, max(CASE WHEN n / CAST(len(t) AS DOUBLE) >= 0.65 THEN round(n / CAST(len(t) AS DOUBLE), 6) END) AS overlap FROM b LEFT JOIN n USING (item_id) GROUP BY 1)
    SELECT item_id, overlap, overlap IS NULL AS unsupported FROM o""")
def guard_verbatim(spark, sf):
    """Phrases of twelve words or more that no passage covers by 0.65 of their words; every whole passage counts."""
    words = lambda: F.array_distinct(F.split("text", " ")).alias("t")
    items = table(spark, sf, "benchmark").where(F.size(F.split("text", " ")) >= 12).select("item_id", words())
    docs = table(spark, sf, "documents").select("doc_id", words())
    best = J.overlapping(items, docs, "item_id", "doc_id", 0.65).groupBy("item_id").agg(F.max("overlap").alias("overlap"))
    return items.select("item_id").join(best, "item_id", "left").withColumn("unsupported", F.col("overlap").isNull())


@query(r"SELECT conv_id, turn, len(regexp_extract_all(replace(lower(text), 'the', ''), '\p{L}+')) > 8 AS too_long FROM conversations WHERE role = 'assistant'")
def guard_refusal(spark, sf):
    """A refusal that goes on for more than eight words besides its phrase."""
    left = F.size(X.tokens(F.replace(F.lower("text"), F.lit("the"), F.lit(""))))
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", (left > 8).alias("too_long"))


@query(_CITED + """, f AS (SELECT page_id, count(*) AS n FROM c WHERE tag NOT IN (SELECT tag FROM k) GROUP BY 1)
    SELECT page_id, list_filter([CASE WHEN n > 0 THEN 'citation' END, CASE WHEN length(html) > 4000 THEN 'length' END, CASE WHEN contains(html, 'ad 0') THEN 'badge' END], lambda x: x IS NOT NULL) AS flags
    FROM pages LEFT JOIN f USING (page_id)""")
def guard_all(spark, sf):
    """All guards' flags, none of which stops the others."""
    bad = _unresolved(spark, sf).groupBy("page_id").agg(F.count("*").alias("n"))
    pages = table(spark, sf, "pages").select("page_id", F.length("html").alias("l"), F.col("html").contains("ad 0").alias("ad"))
    flags = F.array_compact(F.array(F.when(F.col("n") > 0, "citation"), F.when(F.col("l") > 4000, "length"), F.when(F.col("ad"), "badge")))
    return pages.join(bad, "page_id", "left").select("page_id", flags.alias("flags"))


@query("SELECT doc_id, CASE WHEN contains(text, 'License') AND source = 'src1' THEN 'ok' WHEN contains(text, 'License') THEN 'missing badge' ELSE 'none' END AS badge FROM documents")
def guard_badge(spark, sf):
    licence = F.col("text").contains("License")
    badge = F.when(licence & (F.col("source") == "src1"), "ok").when(licence, "missing badge").otherwise("none")
    return table(spark, sf, "documents").select("doc_id", badge.alias("badge"))


@query("SELECT event_id, json_exists(props, '$.k') AND length(event_type) >= 5 AND value >= 1 AS passes FROM events")
def quality_gate(spark, sf):
    props = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", (F.map_contains_key(props, "k") & (F.length("event_type") >= 5) & (F.col("value") >= 1)).alias("passes"))


@query(r"SELECT conv_id, turn, len(regexp_extract_all(lower(text), '\p{L}+')) >= 6 AS skip FROM conversations WHERE role = 'user'")
def hyde_skip(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", (F.size(X.tokens(F.col("text"))) >= 6).alias("skip"))


@query(f"SELECT event_id, conf < 0.5 AS clarify FROM {_GRADE}")
def clarify_rule(spark, sf):
    return _graded(spark, sf).select("event_id", (F.col("conf") < 0.5).alias("clarify"))


@query(f"""
    WITH s AS (SELECT (SELECT count(*) FROM documents) AS d, (SELECT count(DISTINCT source) FROM documents) AS u)
    SELECT conv_id, turn, CASE WHEN regexp_matches(t, '[0-9]') THEN 'There are ' || d || ' records.' WHEN regexp_matches(t, 'the') THEN 'There are ' || u || ' sources.' ELSE 'No count was asked for.' END AS answer FROM {_T}, s""")
def deterministic_answer(spark, sf):
    """Counting questions answered from the one-row summary."""
    summary = table(spark, sf, "documents").agg(F.count("*").alias("d"), F.countDistinct("source").alias("u"))
    say = lambda n, what: F.concat(F.lit("There are "), F.col(n).cast("string"), F.lit(f" {what}."))
    answer = F.when(F.col("t").rlike("[0-9]"), say("d", "records")).when(F.col("t").rlike("the"), say("u", "sources")).otherwise("No count was asked for.")
    return _turns(spark, sf).join(F.broadcast(summary)).select("conv_id", "turn", answer.alias("answer"))  # one row


@query()
def stub_answers(spark, sf):
    """The deterministic stand-in for a language model: a digest of the prompt."""
    prompt = F.sha2(F.concat_ws("|", "role", "text"), 256)
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("stub-"), F.substring(prompt, 1, 12)).alias("answer"))
