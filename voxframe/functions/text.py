"""Text expressions: non-answers, spans, tokens, concept patterns, truncation, JSON out of prose."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Answers that say nothing.  "none" and "nothing" are real answers and stay out.
NON_ANSWERS = (
    "n/a", "na", "n.a", "n.a.", "idk", "i don't know", "i dont know", "dont know", "don't know", "no comment", "nil", "nada",
    "x", "xx", "xxx", "?", "??", "???", "-", "--", ".", "..", "...", "unsure", "not sure",
)
# Words that say nothing about a category's idea, one list per use.
PLAN_STOPWORDS = ("and", "the", "of", "to", "in", "for", "a", "on", "with", "general", "specific", "other", "issues", "concerns")
REVIEW_STOPWORDS = ("and", "the", "of", "to", "in", "for", "a", "on", "with", "general", "specific", "other")
TOPIC_STOPWORDS = ("a", "an", "and", "at", "by", "for", "general", "in", "of", "on", "or", "other", "the", "to", "with", "concern", "concerns", "issue", "issues")
QUESTION_STOPWORDS = (
    "what", "which", "who", "when", "where", "why", "how", "do", "doe", "are", "is", "was", "were", "people", "resident",
    "respondent", "mention", "mentioned", "describe", "describing", "say", "saying", "said", "most", "often", "about",
    "they", "them", "their", "being", "want", "wanted", "asking", "asked", "kind", "type", "many", "survey", "question", "answer",
)


def stripped(c: Column) -> Column:
    """All outer white space off; the built-in ``trim`` takes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_nonanswer(c: Column) -> Column:
    """PR-06: blank, or a sentinel after lower-casing and taking ``.!?`` and blanks off the ends.  Null stays null."""
    core = F.regexp_replace(F.lower(stripped(c)), r"^[ \t.!?]+|[ \t.!?]+$", "")
    return (core == "") | core.isin(*NON_ANSWERS)


def normalized_span(c: Column) -> Column:
    """PR-10: lower case, single blanks, no outer punctuation, no leading article unless too little would be left."""
    s = F.regexp_replace(F.lower(stripped(c)), r"(?U)\s+", " ")
    s = F.regexp_replace(s, r"""^[.,;:!?"'()\[\]]+|[.,;:!?"'()\[\]]+$""", "")
    return F.trim(
        F.when(s.startswith("the ") & (F.length(s) > 6), s.substr(5, 1 << 30))
        .when(s.startswith("a ") & (F.length(s) > 4), s.substr(3, 1 << 30))
        .when(s.startswith("an ") & (F.length(s) > 5), s.substr(4, 1 << 30))
        .otherwise(s)
    )


def normalized_name(c: Column) -> Column:
    """PR-12: lower case, only ASCII letters, digits and spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""))


def truncated(c: Column, limit: int) -> Column:
    """PR-13: at most ``limit`` characters, an ellipsis where something was cut."""
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit)), F.lit("…"))).otherwise(c)


def verbatim(spans: Column, text: Column) -> Column:
    """PR-14: the spans that occur in the text whatever their case, the first spelling of each, in order."""
    inside = F.filter(spans, lambda s: (F.trim(s) != "") & (F.instr(F.lower(text), F.lower(F.trim(s))) > 0))
    trimmed = F.transform(inside, lambda s: F.trim(s))
    return F.filter(trimmed, lambda s, i: F.array_position(F.transform(trimmed, F.lower), F.lower(s)) == i + 1)


def tokens(c: Column, stopwords: tuple[str, ...] = PLAN_STOPWORDS, singular: bool = True) -> Column:
    """SF-08: the set of words of a name without stopwords; a final s is taken off words of more than three letters."""
    words = F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)")), lambda w: ~w.isin(*stopwords))
    if singular:
        words = F.transform(words, lambda w: F.when(w.endswith("s") & (F.length(w) > 3), w.substr(F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.array_distinct(words)


def token_set(name: str, stopwords: tuple[str, ...] = PLAN_STOPWORDS, singular: bool = True) -> set[str]:
    """SF-08 for names held on the driver: the same words as ``tokens`` gives."""
    spaced = "".join(c if "a" <= c <= "z" else " " for c in name.lower())
    kept = [w for w in spaced.split() if w not in stopwords]
    return {w.removesuffix("s") if singular and len(w) > 3 else w for w in kept}


def shared_tokens(a: Column, b: Column) -> tuple[Column, Column]:
    """Sizes of the intersection and the union of two token sets: similarity stays a ratio of integers."""
    return F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))


def concept_pattern(terms: list[str]) -> str:
    """SF-06: one case-blind pattern for a concept: longest term first, optional plural, any white space between words."""
    ordered = sorted({t.strip().lower() for t in terms if t.strip()}, key=lambda t: (-len(t), t))
    literal = (re.sub(r"\\?\s+", r"\\s+", re.escape(t)) for t in ordered)
    return r"(?iu)\b(?:" + "|".join(f"{t}(?:e?s)?" for t in literal) + r")\b"


def json_in_prose(c: Column, schema: str) -> Column:
    """PR-17: the outermost JSON object of a reply that may have fences or talk around it; null where there is none."""
    return F.from_json(F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def normalized_question(q: str) -> str:
    """PR-11 (driver side): NFKC, no apostrophes, other punctuation as blanks, case-folded, single blanks."""
    plain = unicodedata.normalize("NFKC", q)
    plain = re.sub(r"['’‘`]", "", plain)
    return " ".join(re.sub(r"[^\w\s]", " ", plain).casefold().split())


def citations(c: Column) -> Column:
    """SF-17: all numbers of citations like ``[1, 3]``, in order of appearance, each once."""
    groups = F.regexp_extract_all(c, F.lit(r"\[(\d{1,4}(?:\s*,\s*\d{1,4})*)\]"))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*,\s*"), lambda n: n.cast("int")))))
