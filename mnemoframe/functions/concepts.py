"""Derive concept names (entities and topics) from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemoframe import constants as C
from mnemoframe.functions.text import (
    bind,
    extract_keywords,
    first_distinct,
    normalize_concept,
    unicode_pattern,
)

_EDGES = ".,;:!?()[]\"'"
_LEADS = "|".join(C.SENTENCE_LEADS)


def _clean(name: Column) -> Column:
    """Strip blanks, then edge punctuation, then blanks again."""
    blanks = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
    inner = F.btrim(F.regexp_replace(name, blanks, ""), F.lit(_EDGES))
    return F.regexp_replace(inner, blanks, "")


def with_normal(names: Column) -> Column:
    """array<struct(name, normalized)>: each name with its normal form."""
    return F.transform(names, lambda n: F.struct(
        n.alias("name"), normalize_concept(n).alias("normalized")))


def named_concepts(content: Column, max_concepts: int = 6) -> Column:
    """Capitalised phrases without leading sentence words, then keywords, with normal forms.

    A keyword is a run of lower-case word characters, so it is its own normal form and has
    nothing to clean; only the few phrases go through the patterns.
    """
    body = F.coalesce(content, F.lit(""))
    phrases = F.transform(
        F.regexp_extract_all(body, F.lit(unicode_pattern(C.CAPITALISED_PHRASE)), 1),
        # one pattern drops any number of leading sentence-position words
        lambda p: _clean(F.regexp_replace(
            F.regexp_replace(p, unicode_pattern(r"\s+"), " "), rf"^(?i)(?:(?:{_LEADS})(?: |$))+", ""
        )),
    )
    usable = F.filter(
        with_normal(phrases), lambda n: (F.length(n["name"]) >= 2) & (n["normalized"] != ""))

    def with_keywords(own: Column) -> Column:
        others = F.array_except(extract_keywords(body), F.transform(own, lambda n: n["normalized"]))
        return F.slice(F.concat(own, F.transform(others, lambda k: F.struct(
            k.alias("name"), k.alias("normalized")))), 1, max_concepts)

    return bind(first_distinct(usable, lambda n: n["normalized"]), with_keywords)


def deterministic_concepts(content: Column, max_concepts: int = 6) -> Column:
    """The names alone."""
    return F.transform(named_concepts(content, max_concepts), lambda n: n["name"])


def cap_concepts(names: Column, max_concepts: int = 6) -> Column:
    """Trim, drop blanks, de-duplicate by normal form and cap supplied names."""
    blanks = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
    trimmed = F.transform(
        names, lambda n: F.regexp_replace(F.coalesce(n, F.lit("")), blanks, "")
    )
    usable = F.filter(trimmed, lambda n: normalize_concept(n) != "")
    return F.slice(first_distinct(usable, normalize_concept), 1, max_concepts)
