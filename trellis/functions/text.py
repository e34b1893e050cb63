"""Text functions as column expressions; character classes are spelled out so that they hold beyond ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
LINK = r"!?\[\[[^\[\]]+\]\]"
TAG = r"(?:^|[ \t\r\n])#([A-Za-z_][A-Za-z0-9_/-]*)"
SENTENCE = r"[^.?!。？！\n]*[.?!。？！]|[^.?!。？！\n]+"
BACK_REFERENCE = r"(?i)^(it|this|that|these|those|they|he|she|its|their)([^\p{L}\p{N}_]|$)"


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def word_set(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(all_matches(F.lower(text), WORD))


def index_terms(text: Column) -> Column:
    """Search terms: words of two characters and more, in their own case."""
    return F.filter(all_matches(text, WORD), lambda t: F.length(t) > 1)


def without_code(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"```[\s\S]*?```", " "), r"`[^`\n]*`", " ")


def inline_tags(text: Column) -> Column:
    """Distinct #tags outside of code."""
    return F.array_distinct(all_matches(without_code(text), TAG, 1))


def overlap(a: Column, b: Column) -> Column:
    """The share of b's words that occur in a; 0 where b has none."""
    x, y = word_set(a), word_set(b)
    return F.when(F.size(y) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(y))


def estimate_tokens(text: Column) -> Column:
    """Token estimate without a vocabulary: a quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def knowledge_label(title: Column, stem: Column) -> Column:
    """Title, else the slug after the second hyphen with blanks, else the stem."""
    slug = F.replace(F.regexp_extract(stem, r"^[^-]*-[^-]*-(.*)$", 1), F.lit("-"), F.lit(" "))
    return F.coalesce(F.when(F.trim(title) != "", title), F.when(slug != "", slug), stem)
