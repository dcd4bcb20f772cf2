"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that fold, and marks that go (Arabic normalisation).
ALEF_FORMS, ALEF = "أإآٱ", "ا"
TATWEEL = "ـ"
MARKS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06DC}\x{06DF}-\x{06E4}\x{06E7}-\x{06E8}\x{06EA}-\x{06ED}]"
ARABIC = r"\x{0600}-\x{06FF}"


def without_marks(text: Column) -> Column:
    return F.regexp_replace(text, MARKS, "")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def searchable(text: Column) -> Column:
    """For retrieval: alef forms, final ya and ta marbuta folded, marks and tatweel gone, anything not Arabic a blank."""
    folded = F.translate(without_marks(text), ALEF_FORMS + "ةى" + TATWEEL, ALEF * len(ALEF_FORMS) + "هي")
    return squeezed(F.regexp_replace(folded, f"[^{ARABIC}]", " "))


def matchable(text: Column) -> Column:
    """For matching names: as searchable, but final ya keeps its form."""
    folded = F.translate(without_marks(text), ALEF_FORMS + "ة" + TATWEEL, ALEF * len(ALEF_FORMS) + "ه")
    return squeezed(F.regexp_replace(folded, f"[^{ARABIC}]", " "))


def lexical(text: Column) -> Column:
    """For lexicons: letter variants folded, short marks and tatweel gone, punctuation kept."""
    short = F.regexp_replace(text, r"[\x{064B}-\x{0652}]", "")
    return squeezed(F.translate(short, ALEF_FORMS + "ةىئؤیک" + TATWEEL, ALEF * len(ALEF_FORMS) + "هييويك"))


def orthographic(text: Column) -> Column:
    """A light form for display: alef forms folded, marks and tatweel gone; ta marbuta and final ya stay."""
    return squeezed(F.translate(without_marks(text), ALEF_FORMS + TATWEEL, ALEF * len(ALEF_FORMS)))


def containable(text: Column) -> Column:
    """For containment: short marks and tatweel gone, white space squeezed."""
    return squeezed(F.regexp_replace(text, r"[\x{064B}-\x{065F}\x{0640}]", ""))


def marked(text: Column, begin: str, end: str) -> Column:
    """What lies between two markers, over lines, trimmed; null if nothing does."""
    return F.nullif(F.trim(F.regexp_extract(text, f"(?s){begin}(.*?){end}", 1)), F.lit(""))


def iso_utc(moment: Column) -> Column:
    """A moment as UTC in ISO form."""
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


#: Latin letters with marks and what they fold to.
MARKED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüçñß", "aaaaaaeeeeiiiiooooouuuucns"


def folded(text: Column) -> Column:
    """Lower case, Latin letters without their marks."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def cache_key(text: Column) -> Column:
    return squeezed(F.lower(F.translate(text, ALEF_FORMS + "ةى", ALEF * len(ALEF_FORMS) + "هي")))


def tokens(text: Column, pattern: str = r"\p{L}+") -> Column:
    """Lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))


def split_tokens(text: Column, marks: str = r"[\s.,;:!?]+") -> Column:
    return F.filter(F.split(text, marks), lambda x: x != "")


def first_line(text: Column, most: int = 80) -> Column:
    """The first line that is not blank, else the first characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.try_element_at(lines, F.lit(1)), F.substring(text, 1, most))


def mapped_tokens(text: Column, table: Mapping[str, str]) -> Column:
    """Blank-separated tokens, those in the table replaced."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.array_join(F.transform(F.split(text, " "), lambda t: F.coalesce(F.try_element_at(pairs, t), t)), " ")


def first_of(text: Column, words: Sequence[str]) -> Column:
    """The first of the listed words that the text holds."""
    return F.try_element_at(F.filter(F.array(*(F.lit(w) for w in words)), lambda w: text.contains(w)), F.lit(1))


def category(text: Column, patterns: Mapping[str, str], default: str) -> Column:
    """The category of the first pattern found in the text."""
    out = F
    for pattern, name in patterns.items():
        out = out.when(F.contains(text, F.lit(pattern)), name)
    return out.otherwise(default)


def letter_share(text: Column, letters: str) -> Column:
    """Characters of a class over all that are not blank."""
    solid = F.length(F.regexp_replace(text, r"\s", ""))
    return F.when(solid > 0, F.length(F.regexp_replace(text, f"[^{letters}]", "")) / solid).otherwise(F.lit(0.0))


def stripped_html(html: Column) -> Column:
    """Text without scripts, styles and tags, five entities resolved."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def couplets(text: Column) -> Column:
    """Non-blank lines in pairs, as an array of (first, second)."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    at = F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1)), F.lit(2))
    return F.filter(F.transform(at, lambda i: F.struct(F.try_element_at(lines, i).alias("first"), F.try_element_at(lines, i + 1).alias("second"))), lambda p: p["first"].isNotNull())


def paragraphs(text: Column, least: int = 120, most: int = 900) -> Column:
    """Paragraphs of at most ``most`` characters, cut at sentence ends; one under ``least`` joins the one before."""
    blocks = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")
    sentences = lambda b: F.when(F.length(b) <= most, F.array(b)).otherwise(F.filter(F.split(b, r"(?<=[.!?])\s+"), lambda x: x != ""))
    empty = F.array().cast("array<string>")
    last = lambda acc: F.element_at(acc, -1)
    swap = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", last(acc), x)))
    pack = lambda b: F.aggregate(sentences(b), empty, lambda a, s: F.when((F.size(a) > 0) & (F.length(F.element_at(F.concat(F.array(F.lit("")), a), -1)) + F.length(s) + 1 <= most), swap(F.concat(F.array(F.lit("")), a), s)).otherwise(F.concat(a, F.array(s))))
    flat = F.filter(F.flatten(F.transform(blocks, pack)), lambda x: x != "")
    return F.aggregate(flat, empty, lambda a, p: F.when((F.size(a) > 0) & (F.length(p) < least), swap(a, p)).otherwise(F.concat(a, F.array(p))))
