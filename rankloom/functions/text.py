"""Token expressions. Everything is a regex or array function, so no text leaves the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.lexicons import TOKEN_SUFFIXES

WORD = r"[\p{L}\p{N}_]"
# a place is looked at closely only if a suffix can start there
_STEM = rf"(?=[{''.join(sorted({s[0] for s in TOKEN_SUFFIXES}))}])(?<={WORD}{{4}})(?:{'|'.join(TOKEN_SUFFIXES)})(?!{WORD})"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD}+)"), F.lit(1))


def stemmed_tokens(text: Column) -> Column:
    """Tokens with their suffix removed, by one regex over the whole text.

    The suffixes are listed longest first and a match starts as early as four
    letters of the word allow, which picks the same suffix as trying the list
    word by word.
    """
    plain = F.replace(F.lower(text), F.lit("ё"), F.lit("е"))
    return F.regexp_extract_all(F.regexp_replace(plain, _STEM, ""), F.lit(f"({WORD}+)"), F.lit(1))


def member(token: Column, words: Sequence[str]) -> Column:
    """Membership in a fixed class; a long list becomes a hash lookup."""
    return token.isin(list(words))


def alias_literal(aliases: Mapping[str, Sequence[str]]) -> Column:
    return F.create_map(*[item for key, group in aliases.items() for item in (F.lit(key), F.array(*[F.lit(g) for g in group]))])


def count_of(haystack: Column, token: Column) -> Column:
    return F.size(F.filter(haystack, lambda t: t == token))


def phrase_count(needle: Column, haystack: Column) -> Column:
    """Contiguous occurrences of ``needle`` in ``haystack``, overlapping ones included."""
    last = F.size(haystack) - F.size(needle) + 1
    starts = F.when((F.size(needle) > 0) & (last > 0), F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    first = F.element_at(needle, F.when(F.size(needle) > 0, F.lit(1)).otherwise(F.lit(None).cast("int")))
    candidates = F.filter(starts, lambda i: F.element_at(haystack, i) == first)
    return F.size(F.filter(candidates, lambda i: F.slice(haystack, i, F.size(needle)) == needle))


def scan_text(*parts: Column) -> Column:
    """Parts joined, whitespace collapsed, lower-cased."""
    joined = F.concat_ws(" ", *parts)
    # a single space stays as it is
    return F.lower(F.trim(F.regexp_replace(joined, r"(?U)\s{2,}|(?! )\s", " ")))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Does one of the literals occur? A search of bytes for each, which long texts bear better than a regex of all."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def strip(text: Column) -> Column:
    """Remove whitespace of every kind from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
