"""The operators' queries over the standard tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import align, audio, language, lm, merkle, mixing, near, packing, quality, suffix, topk, toxicity, urls
from marginalia.llm.common import table

#: The rules of the url query.
RULES = (
    urls.Rule("com", "/en/", "block"),
    urls.Rule("example.com", "/en/7", "allow"),
    urls.Rule("net", "/de/", "allow"),
    urls.Rule("example.net", "/de/8", "block"),
    urls.Rule("org", "/es/", "block"),
)


def tokenizer_path() -> str:
    """The packing query's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).drop("node")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_columns(table(spark, sf_dir, "documents"), digest=True)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_topk_search, op3_toxicity, op4_lm_scoring, op5_mixing, op6_url_filters, op7_suffix_array_dedup, op8_minhash_near_dedup, op9_language_id, op10_media_columns, op11_quality_rules, op12_merkle_manifest, op13_cross_tokenizer_alignment)}

SQL: dict[str, str] = {
    "op2_topk_search": r"""
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_mixing": r"""
        WITH s AS (
          SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                 CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
          FROM documents),
        t AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                 CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w
          FROM s GROUP BY source),
        lines AS (
          SELECT source, source_size, w, sum(source_size) OVER () AS n, sum(w) OVER () AS ws,
                 coalesce(sum(3.0::DOUBLE * source_size) OVER o, 0) AS stopped, coalesce(sum(w) OVER o, 0) AS gone
          FROM t WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        shares AS (SELECT *, (n - stopped) / (ws - gone) AS share FROM lines),
        level AS (SELECT arg_min(share, 3.0::DOUBLE * source_size / w) AS share FROM shares WHERE 3.0::DOUBLE * source_size >= share * w),
        goal AS (SELECT source, source_size, CAST(least(3.0::DOUBLE * source_size, w * level.share) AS DOUBLE) AS target FROM shares, level),
        run AS (
          SELECT s.*, g.source_size, g.target, floor(g.target / nullif(g.source_size, 0)) AS times,
                 g.target - floor(g.target / nullif(g.source_size, 0)) * g.source_size AS budget,
                 sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
                 sum(size) OVER (PARTITION BY s.source, h) AS own, row_number() OVER (PARTITION BY s.source, h) AS number
          FROM s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, size, source_size, target,
               CAST(CASE WHEN size = 0 THEN 0 ELSE least(3, times + CASE WHEN upto - own <= budget AND number <= floor((budget - (upto - own)) / size + 0.5) THEN 1 ELSE 0 END) * size END AS BIGINT) AS taken
        FROM run""",
    "op6_url_filters": r"""
        WITH u AS (
          SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (
          SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path
          FROM u)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('com/en/', 'net/de/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict
        FROM (SELECT *, CASE
                WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
                WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
                WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/'
                END AS rule FROM p)""",
    "op8_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (
          SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                 ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
        e AS (SELECT doc_id, unnest(s) AS x FROM g),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (
          SELECT a, b FROM c JOIN g ga ON ga.doc_id = a JOIN g gb ON gb.doc_id = b WHERE 100 * n >= 85 * (len(ga.s) + len(gb.s) - n)),
        both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, m.b FROM r JOIN both_ways m ON r.b = m.a)
        SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, m.component_id, g.doc_id = m.component_id AS kept
        FROM g JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = g.doc_id""",
    "op11_quality_rules": r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                 list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l, row_number() OVER () AS r
          FROM documents),
        g AS (SELECT r, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: {'g': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], 'i': i}), recursive := true) FROM d),
        k AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
        c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM k) GROUP BY r),
        m AS (
          SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                 CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
                 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
                 CAST(length(regexp_replace(t, '[^\pL]+', '', 'g')) AS BIGINT) AS n_letters
          FROM d LEFT JOIN c USING (r)),
        b AS (
          SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
                 + 8 * (word_chars < 3 * n_words OR word_chars > 10 * n_words)::INT + 16 * (10 * n_dup_lines > 3 * n_lines)::INT + 32 * (10 * n_letters < 7 * word_chars)::INT AS BIGINT) AS failed
          FROM m)
        SELECT *, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, 'v3' AS policy,
               CASE failed WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'word_length' WHEN 16 THEN 'repeated_lines' WHEN 32 THEN 'few_letters' END AS sole_rule,
               CASE WHEN failed IN (1, 2, 4, 8, 16, 32) THEN count(*) OVER (PARTITION BY failed) END AS rescued
        FROM b""",
}
