"""Quality rules: a ledger of failure bits and measurements, policies over it, and their ablations.

Every rule is evaluated once for each document.  What it found stays in the *ledger*: a narrow table of measurements and one
integer whose bit ``i`` says that rule ``i`` failed.  A *policy* is a version name and a set of rules; its verdict is one
bitwise ``and`` over the ledger, so that another version never reads a text again.  An *ablation* tells for every policy and
rule how many documents would stay without that rule; it aggregates the few distinct bit patterns, not the documents.

Only DataFrame functions run here; nothing is shuffled but the patterns' counts, at most 2 to the power of the rules.  Arrays
of one text's words and three-word windows are the largest thing a task holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import stored

#: Separators of words, and the characters that count as symbols.
SEPARATORS, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
WINDOW = 3
#: Measurements of a text, in the ledger's order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters")


class Rule(NamedTuple):
    """A name and the condition over ``MEASURES``, as SQL, under which a document fails."""

    name: str
    fails: str


class Policy(NamedTuple):
    """A version name and the rules that reject a document."""

    version: str
    rules: tuple[str, ...]


#: A rule's place here is its bit.  New rules go at the end, so that ledgers already stored keep their meaning.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("few_letters", "10 * n_letters < 7 * word_chars"),
)
POLICIES = (
    Policy("v1", ("few_words", "repeated_words")),
    Policy("v2", ("few_words", "repeated_words", "symbols", "word_length")),
    Policy("v3", ("few_words", "repeated_words", "symbols", "word_length", "repeated_lines", "few_letters")),
)


def bit_of(rules: Sequence[Rule], name: str) -> int:
    return 1 << next(i for i, r in enumerate(rules) if r.name == name)


def mask_of(rules: Sequence[Rule], policy: Policy) -> int:
    out = 0
    for name in policy.rules:
        out |= bit_of(rules, name)
    return out


def _repeated(windows: str) -> Column:
    """Of windows ``(g, i)`` sorted by key then place, the places of those whose key equals a neighbour's."""
    same = lambda x, i: (x["g"] == F.get(windows, i - 1)["g"]) | (x["g"] == F.get(windows, i + 1)["g"])
    return F.transform(F.filter(windows, same), lambda x: x["i"])


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``MEASURES`` for every row; a null text counts as empty.  Other columns are left out, whatever their names.

    Windows are compared in two steps: the 64-bit hashes of all, then the words of those whose hash another one has.
    """
    count = lambda c: c.cast("long")
    whole = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    cut = whole.select(
        "doc_id", "t", F.filter(F.split("t", SEPARATORS), lambda x: x != "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    words_at = lambda i: [F.get("w", i + k) for k in range(WINDOW)]
    keyed = lambda places, key: F.sort_array(F.transform(places, lambda i: F.struct(key(*words_at(i)).alias("g"), i.alias("i"))))
    places = F.sequence(F.lit(0), F.size("w") - WINDOW)
    none = F.array().cast("array<struct<g:bigint,i:int>>")
    sized = cut.select(
        "doc_id", "w", count(F.size("w")).alias("n_words"), count(F.length(F.array_join("w", ""))).alias("word_chars"),
        count(F.regexp_count("t", F.lit(SYMBOLS))).alias("n_symbols"), count(F.size("lines")).alias("n_lines"),
        count(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), count(F.length(F.regexp_replace("t", r"[^\p{L}]+", ""))).alias("n_letters"),
        F.when(F.size("w") >= WINDOW, keyed(places, F.xxhash64)).otherwise(none).alias("windows"),
    )
    plain = [c for c in MEASURES if c != "n_repeat_words"]
    alike = sized.select("doc_id", *plain, "w", _repeated("windows").alias("at"))
    exact = alike.select("doc_id", *plain, keyed(F.col("at"), lambda *w: F.concat_ws(" ", *w)).alias("windows"))
    placed = exact.select("doc_id", *plain, _repeated("windows").alias("at"))
    covered = F.array_distinct(F.flatten(F.transform("at", lambda i: F.array(*(i + k for k in range(WINDOW))))))
    return placed.withColumn("n_repeat_words", count(F.size(covered))).select("doc_id", *MEASURES)


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``MEASURES`` and ``failed`` (a bit for each rule) of every row, stored in the shared folder."""
    if len(rules) > 62:
        raise ValueError("a ledger holds at most 62 rules")
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return stored(measured(docs, doc_id, text).withColumn("failed", bits), "quality-ledger")


def under(book: DataFrame, rules: Sequence[Rule], policy: Policy) -> DataFrame:
    """The ledger's rows with the policy's ``kept``."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask_of(rules, policy)).cast("long")) == 0)


def ablations(book: DataFrame, rules: Sequence[Rule] = RULES, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """A row for each policy and rule of it: what the policy keeps, what it would keep without the rule, and how rules go together.

    ``kept, kept_without, failing`` count documents; ``ever_with`` and ``always_with`` are the bits of the policy's rules that
    fail beside this one in some document and in every document (both 0 where none fails it).  An empty ledger gives no row.
    """
    patterns = book.groupBy("failed").agg(F.count("*").alias("docs"))
    cases = F.array(*(
        F.struct(F.lit(p.version).alias("policy"), F.lit(r).alias("rule"), F.lit(mask_of(rules, p)).cast("long").alias("mask"), F.lit(bit_of(rules, r)).cast("long").alias("bit"))
        for p in policies for r in p.rules
    ))
    each = patterns.select("failed", "docs", F.explode(cases).alias("c")).select("failed", "docs", "c.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    has = hit.bitwiseAND(F.col("bit")) != 0
    others = hit.bitwiseAND(F.bitwise_not("bit"))
    total = lambda on: F.sum(F.when(on, F.col("docs")).otherwise(F.lit(0)))
    return each.groupBy("policy", "rule").agg(
        total(hit == 0).alias("kept"), total(others == 0).alias("kept_without"), total(has).alias("failing"),
        F.coalesce(F.bit_or(F.when(has, others)), F.lit(0)).alias("ever_with"), F.coalesce(F.bit_and(F.when(has, others)), F.lit(0)).alias("always_with"),
    )


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """Every document's measurements and the last policy's verdict, with what dropping a single rule would change.

    ``base_failed`` is the first policy's rejection, ``kept`` the last one's verdict.  ``sole_rule`` names the only rule of
    the last policy that a document fails (else null) and ``rescued`` how many documents the policy would keep without that
    rule.  Null and empty texts have no words and fail ``few_words``; null ids and repeated rows are rows like others; an
    empty table gives no rows.
    """
    book = ledger(docs, rules)
    last = policies[-1]
    sole = F.lit(None).cast("string")
    for name in last.rules:
        sole = F.when(F.col("failed").bitwiseAND(F.lit(mask_of(rules, last)).cast("long")) == bit_of(rules, name), F.lit(name)).otherwise(sole)
    gain = ablations(book, rules, [last]).select(F.col("rule").alias("sole_rule"), (F.col("kept_without") - F.col("kept")).alias("rescued"))  # a row for each rule
    rows = under(book, rules, last).withColumn("sole_rule", sole).withColumn("policy", F.lit(last.version))
    base = F.col("failed").bitwiseAND(F.lit(mask_of(rules, policies[0])).cast("long")) != 0
    return rows.withColumn("base_failed", base).join(F.broadcast(gain), "sole_rule", "left").select("doc_id", *MEASURES, "base_failed", "kept", "failed", "policy", "sole_rule", "rescued")
