"""String functions where Spark's own differ from what the extractors need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def padded(c: Column, width: int) -> Column:
    """Filled with spaces up to a width, never cut (rpad cuts)."""
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(c))))


def extracted(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where nothing or nothing but an empty string matches."""
    found = F.regexp_extract(c, pattern, group)
    return F.when(found != "", found)


def uri_decoded(c: Column) -> Column:
    """Percent-decoded; a plus stays a plus, and what can't be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def contains_any(c: Column, parts: tuple[str, ...] | list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def starts_with_any(c: Column, parts: tuple[str, ...] | list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.startswith(p)
    return out


def ends_with_any(c: Column, parts: tuple[str, ...] | list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.endswith(p)
    return out


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance with unit costs."""
    return F.levenshtein(a, b).cast("long")
