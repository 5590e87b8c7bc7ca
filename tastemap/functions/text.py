"""Tokenisers as array expressions (same results as ``RegexTokenizer`` with the
given settings, computed without leaving the JVM expression engine)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens_ws(text) -> Column:
    """Split on single spaces, case preserved, empty strings dropped."""
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), " "), lambda t: t != "")


def tokens_regex_gap(text, pattern: str = r"\s+", lower: bool = True) -> Column:
    """Regex tokenise by gaps (default ``\\s+``), lower-cased, min length 1."""
    t = F.coalesce(_c(text), F.lit(""))
    if lower:
        t = F.lower(t)
    return F.filter(F.split(t, pattern), lambda x: F.length(x) >= 1)


def tokens_regex_match(text, pattern: str = r"\p{L}+", lower: bool = True) -> Column:
    """Regex tokenise by matches (default ``\\p{L}+``), lower-cased."""
    t = F.coalesce(_c(text), F.lit(""))
    if lower:
        t = F.lower(t)
    return F.regexp_extract_all(t, F.lit(f"({pattern})"), 1)
