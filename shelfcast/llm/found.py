"""Positions of regular-expression matches in SQL functions: the text is split
at the matches, and lengths of pieces and matches give code-point offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pieces(text: Column, pattern: str) -> Column:
    """Text between matches: one more than there are matches. No match may be empty."""
    return F.split(text, pattern, -1)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def spliced(text: Column, pattern: str, new: callable) -> Column:
    """Text with every match m replaced by ``new(m)`` (a Column of a Column)."""
    return F.concat_ws("", F.flatten(F.zip_with(
        pieces(text, pattern), F.transform(matches(text, pattern), new),
        lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))))
