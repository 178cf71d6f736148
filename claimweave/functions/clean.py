"""Cleaning expressions for claim tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: str | Column) -> Column:
    """The number, or null where it is null, NaN or infinite. -0.0 becomes 0.0."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x + F.lit(0.0))


def measured(c: str | Column, low: float, high: float) -> Column:
    """The number where it lies in [low, high], else null."""
    x = finite(c)
    return F.when((x >= low) & (x <= high), x)


def polarity(c: str | Column = "pos") -> Column:
    """`pos` where it is 0 or 1, else null (-1 marks a duplicate from the same journal)."""
    x = finite(c)
    return F.when((x == 0) | (x == 1), x)


def gene(c: str) -> Column:
    """A resolved gene id, else null (null or <= 0: not resolved)."""
    return F.when(F.col(c) > 0, F.col(c)).cast("long")


def known_year(c: str = "year") -> Column:
    """The year, else null (null or <= 0: unknown)."""
    return F.when(F.col(c) > 0, F.col(c)).cast("int")


def organisations(c: str = "affs") -> Column:
    """Array of organisation spellings: text in [] and () removed, split at `|`, each piece up to its
    first comma, trimmed; empty pieces are none. Spellings stay exactly as typed. Null for null."""
    text = F.regexp_replace(F.col(c), r"\[[^\]]*\]|\([^)]*\)", "")
    return F.filter(F.transform(F.split(text, r"\|"), lambda p: _trim(F.split(p, ",")[0])), lambda p: p != "")


def authors(c: str = "aus") -> Column:
    """Array of author spellings: split at `|`, trimmed; empty pieces are none. Null for null."""
    return F.filter(F.transform(F.split(F.col(c), r"\|"), _trim), lambda p: p != "")


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")
