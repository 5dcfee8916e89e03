"""Ordered-choice token patterns as native regular expressions.

A pattern here never gives back what it has taken: choices are atomic groups, repetitions possessive. So a pattern behaves
like a parser of ordered, committed alternatives while it stays one expression that Spark evaluates in the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def literal(text: str) -> str:
    """Match a text as it stands."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def any_char(chars: str) -> str:
    """Match one of the characters."""
    return "[" + re.sub(r"([\\\]\[^-])", r"\\\1", chars) + "]"


def any_of(*patterns: str) -> str:
    """The first alternative that matches, for good."""
    return "(?>" + "|".join(patterns) + ")"


def sequence(*patterns: str) -> str:
    return "".join(patterns)


def one_or_more(pattern: str) -> str:
    return f"(?>{pattern})++"


def zero_or_more(pattern: str) -> str:
    return f"(?>{pattern})*+"


def exactly(n: int, pattern: str) -> str:
    return f"(?>{pattern}){{{n}}}"


def tokens(text: Column, alternatives: list[str], separators: str) -> Column:
    """The tokens of the longest prefix of text that is a series of (alternative, one separator); separators included."""
    unit = any_of(*alternatives) + any_char(separators)
    return F.regexp_extract_all(text, F.lit(r"\G" + unit), F.lit(0))


def flatten_once(nested: Column) -> Column:
    """array<array<x>> to array<x>."""
    return F.flatten(nested)


def joined(parts: Column) -> Column:
    """Strings put together without a separator."""
    return F.array_join(parts, "")


def mapped(parts: Column, change) -> Column:
    """change applied to every value of a match."""
    return F.transform(parts, change)
