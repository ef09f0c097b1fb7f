"""Text predicates and small string builders, all JVM-side expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote(word: str) -> str:
    """A literal as a regular expression that Java and RE2 read the same way."""
    return re.sub(r"([^0-9A-Za-z_ #&@%'+=-])", r"\\\1", word).replace("+", r"\+")


def alternation(words: Sequence[str]) -> str:
    return "|".join(quote(w) for w in words)


def contains_any(col: Column, words: Sequence[str]) -> Column:
    """True when any of the words is a substring (one pass, for short texts)."""
    return col.rlike(alternation(words))


def contains_any_long(col: Column, words: Sequence[str]) -> Column:
    """Same for long texts: plain substring searches, stopping at the first hit."""
    return reduce(lambda a, b: a | b, [col.contains(w) for w in words])


def bind(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)`` with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), build), 1)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(" \t\n\r\f\x0b"))


def required_literal(pattern: str) -> str:
    """Longest run of plain characters that every match of a simple pattern must contain ('' if none).

    Top-level alternatives have none; groups, classes, escapes and repeated characters are cut out.
    """
    bare = re.sub(r"\([^()]*\)[?*]?", "\0", pattern)
    if "|" in bare:
        return ""
    bare = re.sub(r"\[[^\]]*\][?*]?|\\.[?*+]?|.[?*]", "\0", bare)
    return max(bare.split("\0"), key=len)


def found(lower: Column, pattern: str) -> Column:
    """Pattern search in lower-cased text; the regex only runs where its literal part occurs."""
    lowered = pattern.lower()
    literal = required_literal(lowered)
    return lower.contains(literal) & lower.rlike(lowered) if literal else lower.rlike(lowered)


def found_any(lower: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [found(lower, p) for p in patterns])


def first_label(tests: Sequence[tuple[Column, str]], default: str | None) -> Column:
    """Ordered ``(test, label)`` pairs as one CASE: evaluation stops at the first hit."""
    case = F
    for test, label in tests:
        case = case.when(test, label)
    return case.otherwise(default)


def all_labels(lower: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Every label with a matching pattern, in rule order (no row explosion, no join)."""
    return F.array_compact(F.array(*[F.when(found_any(lower, patterns), label) for label, patterns in rules if patterns]))


def path_name(url: Column) -> Column:
    """Last path segment of a URL or path: query, fragment and parameters removed."""
    path = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?", "")
    path = F.regexp_extract(path, r"^([^?#;]*)", 1)
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def safe_name(name: Column) -> Column:
    """Anything but letters, digits, '.', '-' and '_' becomes '_'."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}.\-_]", "_")


def strip_fence(text: Column, stop_at_close: bool) -> Column:
    """Body of a fenced block; unfenced text is returned as it is.

    ``stop_at_close=False`` drops every later fence line, ``True`` ends at the first one.
    """
    lines = F.split(text, "\n")
    body = F.slice(lines, 2, F.size(lines))
    fences = F.transform(body, lambda line: line.startswith("```"))
    close = F.array_position(fences, True)
    if stop_at_close:
        kept = F.when(close > 0, F.slice(body, 1, close.cast("int") - 1)).otherwise(body)
    else:
        kept = F.filter(body, lambda line: ~line.startswith("```"))
    return F.when(text.startswith("```"), F.array_join(kept, "\n")).otherwise(text)
