"""Lexicon classifiers and rule cascades as expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Hits that an occasion is worth.
OCCASION = 5


def hits(tokens: Column, words: Sequence[str]) -> Column:
    """Distinct tokens that the lexicon lists."""
    return F.size(F.array_intersect(tokens, F.array(*(F.lit(w) for w in words))))


def lexicon_genre(tokens: Column, lexicon: Mapping[str, Sequence[str]], margin: int = 1, none: str = "none", occasion: Column | None = None, tied: float = 0.0) -> Column:
    """(genre, confidence): most hits if they lead by the margin, else none; confidence is the lead over the hits.

    An occasion that names a genre counts as five hits for it.  Hits without a lead have the confidence ``tied``.
    """
    scores = {g: hits(tokens, w) + (0 if occasion is None else F.when(occasion == g, OCCASION).otherwise(0)) for g, w in lexicon.items()}
    ordered = F.sort_array(F.array(*scores.values()), asc=False)
    top, second = F.get(ordered, F.lit(0)), F.coalesce(F.get(ordered, F.lit(1)), F.lit(0))
    clear = (top > 0) & (top - second >= margin)
    genre = F
    for g, s in scores.items():
        genre = genre.when(clear & (s == top), g)
    return F.struct(genre.otherwise(none).alias("genre"), F.when(clear, F.round((top - second) / top, 2)).when(top > 0, F.lit(tied)).otherwise(F.lit(0.0)).alias("confidence"))


def top_labels(tokens: Column, lexicon: Mapping[str, Sequence[str]], most: int) -> Column:
    """Labels with hits, most hits first, ties in the lexicon's order."""
    scored = F.array(*(F.struct((-hits(tokens, w)).alias("n"), F.lit(i).alias("o"), F.lit(g).alias("label")) for i, (g, w) in enumerate(lexicon.items())))
    found = F.array_sort(F.filter(scored, lambda s: s["n"] < 0))
    return F.transform(F.slice(found, 1, most), lambda s: s["label"])


def first_match(text: Column, rules: Mapping[str, str], default: str | None = None) -> Column:
    """The name of the first pattern that the text matches."""
    return first_true({name: F.rlike(text, F.lit(pattern)) for name, pattern in rules.items()}, default)


def first_true(checks: Mapping[str, Column], default: str | None = None) -> Column:
    """The name of the first check that holds; one that is null doesn't."""
    out = F
    for name, check in checks.items():
        out = out.when(check, name)
    return out.otherwise(default)


def additive(text: Column, cues: Mapping[str, float], fire: float) -> tuple[Column, Column]:
    """The sum of the weights of the cues that match, at most 1, and whether it fires."""
    total = F.least(F.lit(1.0), F.round(sum((F.when(F.rlike(text, F.lit(p)), w).otherwise(0.0) for p, w in cues.items()), F.lit(0.0)), 6))
    return total, total >= fire
