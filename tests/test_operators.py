"""Hand-computed values and plan shapes."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.functions.vector import dot, unit
from marginalia.operators import aggregates as A
from marginalia.operators import chunks as C
from marginalia.operators import classify as K
from marginalia.operators import joins as J
from marginalia.operators import retrieval as R
from marginalia.sources.tables import json_records, page_lines, tolerant_lines


def ranked(spark, *ids):
    return spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id string, rank int")


def test_rank_fusion_is_the_sum_of_reciprocal_ranks(spark):
    out = {r.id: r.score for r in R.fuse([ranked(spark, "a", "b"), ranked(spark, "b", "c"), ranked(spark, "d")], "id").collect()}
    assert out == {"a": round(1 / 61, 9), "b": round(1 / 62 + 1 / 61, 9), "c": round(1 / 62, 9), "d": round(1 / 61, 9)}
    assert R.fuse([ranked(spark, "a")], "id", k=5).first().score == round(1 / 6, 9)


def test_fusion_does_not_depend_on_the_lists_order(spark):
    lists = [ranked(spark, "a", "b", "c"), ranked(spark, "c", "a"), ranked(spark, "x")]
    a = {r.id: r.score for r in R.fuse(lists, "id").collect()}
    b = {r.id: r.score for r in R.fuse(lists[::-1], "id").collect()}
    assert a == b


def test_windows_of_seven_rows_are_five_and_of_two_none(spark):
    rows = spark.createDataFrame([("p", i, f"t{i}") for i in range(7)] + [("q", i, "x") for i in range(2)], "g string, seq int, t string")
    out = C.windows(rows, ["g"], "seq", "t").collect()
    assert len(out) == 5
    assert {r.g for r in out} == {"p"}
    assert sorted(r.text for r in out)[0] == "t0\nt1\nt2"
    assert {r.g: r.n for r in C.groups(rows, ["g"], "seq", "t").collect()} == {"p": 7, "q": 2}


def test_top_by_count_takes_the_first_seen_of_equals(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("a", 3), ("b", 4), ("c", 5), (" ", 6), (None, 7)], "k string, seq int")
    assert [(r.k, r.n) for r in A.top_by_count(rows, "k", "seq", 2).collect()] == [("b", 2), ("a", 2)]


def test_guard_keeps_all_rows_if_none_matches(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, x string")
    assert J.or_all(rows, F.col("x") == "a").count() == 1
    assert J.or_all(rows, F.col("x") == "z").count() == 2


def test_union_first_and_last_wins(spark):
    a, b = spark.createDataFrame([("1", "a"), ("", "a")], "id string, v string"), spark.createDataFrame([("1", "b"), ("2", "b")], "id string, v string")
    assert {r.id: r.v for r in J.union_first_wins([a, b], "id", "v").collect()} == {"1": "a", "2": "b"}
    assert {r.id: r.v for r in J.union_last_wins([a, b], "id", "v").collect()} == {"1": "b", "2": "b"}


def test_ratio_and_overlap(spark):
    row = spark.range(1).select(
        J.ratio(F.lit("abcd"), F.lit("abcf")).alias("r"), J.ratio(F.lit(""), F.lit("")).alias("e"), J.token_overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"), F.lit("d"))).alias("o")
    ).first()
    assert (row.r, row.e, round(row.o, 6)) == (75.0, 100.0, round(1 / 3, 6))


def test_verdicts(spark):
    rows = spark.createDataFrame([(7, 0, 3), (6, 0, 4), (5, 0, 0), (0, 0, 0)], "h int, m int, l int")
    assert [r.v for r in rows.select(A.verdict(F.col("h"), F.col("m"), F.col("l")).alias("v")).collect()] == ["REVIEW", "FAIL", "PASS", "FAIL"]


def test_selection_is_exact(spark, monkeypatch):
    """Ties, skew, null keys and values that are no numbers, in buckets so small that they are refined."""
    import random

    monkeypatch.setattr(A, "LEAF", 3)
    monkeypatch.setattr(A, "BUCKETS", 4)
    rng = random.Random(1)
    rows = [("hot", rng.choice([1.0, rng.random(), rng.gauss(0, 1e6)])) for _ in range(300)] + [(None, float(i)) for i in range(20)] + [("one", 7.5), ("none", None), ("none", float("nan")), ("inf", float("inf")), ("inf", -2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    groups = {}
    for g, v in rows:
        if v is not None and abs(v) < float("inf"):
            groups.setdefault(g, []).append(v)
    high = {r.g: r.p for r in A.selected(df, ["g"], "v", A.upper_rank(0.95), "p").collect()}
    assert high == {g: sorted(v)[min(int(len(v) * 0.95), len(v) - 1)] for g, v in groups.items()}
    middle = {r.g: r.p for r in A.median(df, ["g"], "v", "p").collect()}
    assert middle == {g: pytest.approx((sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2) for g, v in groups.items()}
    assert A.selected(df.limit(0), ["g"], "v", A.upper_rank(0.5), "p").collect() == []


def test_vectors(spark):
    row = spark.range(1).select(unit(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), unit(F.array(F.lit(0.0), F.lit(0.0))).alias("z"), dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("d")).first()
    assert row.u == [0.6, 0.8] and row.z == [0.0, 0.0] and row.d == 11.0


def test_normalisers_are_idempotent(spark):
    samples = spark.createDataFrame([("أهلاً وسهلاً abc",), ("مدرسةٍ كبـــيرة،",), ("",)], "t string")
    for f in (X.searchable, X.matchable, X.lexical, X.cache_key):
        for r in samples.select(f(F.col("t")).alias("a"), f(f(F.col("t"))).alias("b")).collect():
            assert r.a == r.b


def test_paragraphs_merge_short_ones_and_cut_long_ones(spark):
    text = "x" * 130 + "\n\nshort\n\n" + ("A sentence of some words. " * 60)
    out = spark.createDataFrame([(text,)], "t string").select(X.paragraphs(F.col("t")).alias("p")).first().p
    assert out[0] == "x" * 130 + " short"
    assert all(len(p) <= 900 for p in out[1:]) and len(out) >= 3


def test_lexicon_needs_a_lead(spark):
    lexicon = {"a": ("x", "y"), "b": ("z",)}
    pick = lambda *t: spark.range(1).select(K.lexicon_genre(F.array(*(F.lit(w) for w in t)), lexicon).alias("g")).first().g
    assert (pick("x", "y", "z").genre, pick("x", "y", "z").confidence) == ("a", 0.5)
    assert pick("x", "z").genre == "none" and pick("q").confidence == 0.0


def test_bm25_counts_a_repeated_term_twice(spark):
    docs = spark.createDataFrame([(i, "apple pear" if i < 2 else "plum") for i in range(7)], "id int, t string")
    once = R.bm25(docs, "id", X.tokens(F.col("t")), ["apple"]).first().score
    twice = R.bm25(docs, "id", X.tokens(F.col("t")), ["apple", "apple"]).first().score
    assert abs(twice - 2 * once) < 2e-6


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2}]')
    schema = spark.range(0).withColumnRenamed("id", "id").schema
    assert json_records(spark, [str(tmp_path / "none.json"), str(tmp_path / "a.json")], schema).count() == 2
    assert json_records(spark, str(tmp_path / "none.json"), schema).count() == 0
    lines = spark.createDataFrame([('{"k": 1}',), ("{oops",), (None,)], "l string")
    assert [r.k for r in tolerant_lines(lines, "l", "k int").collect()] == [1]
    (tmp_path / "p.xml").write_text('<PcGts><TextLine id="l1" custom="c"><Coords points="0,0 1,1"/><TextEquiv conf="0.9"><Unicode> abc </Unicode></TextEquiv></TextLine></PcGts>')
    row = page_lines(spark, str(tmp_path / "p.xml")).first()
    assert (row.id, row.text, row.confidence) == ("l1", "abc", 0.9)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf):
    from marginalia.plans.registry import QUERIES

    assert "TakeOrderedAndProject" in plan(QUERIES["dense_topk"](spark, sf))
    assert "WindowGroupLimit" in plan(QUERIES["dedup_top1"](spark, sf))
    assert "PushedFilters: [IsNotNull(lang), IsNotNull(source), EqualTo(lang,en), EqualTo(source,src3)]" in plan(QUERIES["hard_filter_exact"](spark, sf))
    assert "CartesianProduct" not in plan(QUERIES["theta_substring_join"](spark, sf))


def test_routes_take_the_first_check_that_holds(spark):
    from marginalia.plans import routing

    text = {
        "you idiot, see https://a.b": "out_of_scope", "see https://a.b": "unsupported", "who wrote page.png": "image_provenance", "who wrote it": "retrieval",
        "can you debug": "capabilities", "debug": "pipeline_debug", "the license?": "registry", "show me this page": "content", "license": "provenance", "7": "counting",
        None: "retrieval", "": "retrieval",
    }
    rows = spark.createDataFrame([(t, r, None) for t, r in text.items()], "t string, want string, entity string")
    sure = {"registry": K.additive(F.col("t"), routing.CUES, 0.7)[1], "name": F.col("entity").isNotNull()}
    late = {n: F.rlike("t", F.lit(p[0])) for n, p in routing.LATE.items()}
    early = {n: F.rlike("t", F.lit(p[0])) if len(p) == 1 else F.rlike("t", F.lit(p[0])) & F.rlike("t", F.lit(p[1])) for n, p in routing.EARLY.items()}
    got = rows.select("t", "want", K.first_true(early | sure | late, "retrieval").alias("route")).collect()
    assert [(r.t, r.route) for r in got] == [(r.t, r.want) for r in got]
