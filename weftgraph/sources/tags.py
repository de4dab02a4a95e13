"""Annotation tags in comments: each binds to the first function, method or class at or below its line."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import trimmed
from ..schema import TAG_KINDS

#: What tags start with; a project's configuration may name another.
MARKER = "@weft:"

# Comment openings by language, and tag names.
COMMENTS = {"typescript": r"(?://|/\*\*?|\*)", "python": r'(?:#|""")', "go": r"(?://)"}
ANY_COMMENT = r"(?://|#|--|/\*\*?|\*)"
NAME = r"^[a-z][a-z0-9._-]*\z"


def comment_pattern(language: Column) -> Column:
    out = F.lit(rf"^\s*{ANY_COMMENT}\s*")
    for name, opening in COMMENTS.items():
        out = F.when(language == name, F.lit(rf"^\s*{opening}\s*")).otherwise(out)
    return out


def tag_lines(sources: DataFrame, marker: str = MARKER) -> DataFrame:
    """file, language, tag_line, kind, raw of each comment line that holds a tag; sources: file, language, text."""
    rows = sources.select("file", "language", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    # the marker first: few lines have it, and the patterns are only tried on those
    rows = rows.filter(F.col("line").contains(marker))
    pattern = comment_pattern(F.col("language"))
    rows = rows.filter(F.regexp_like("line", pattern)).withColumn("bare", F.regexp_replace("line", pattern, F.lit("")))
    found = rf"^{re.escape(marker)}(\S+)\s+(.+)"
    rows = rows.filter(F.col("bare").rlike(found))
    return rows.select(
        "file",
        "language",
        (F.col("pos") + 1).alias("tag_line"),
        F.regexp_extract("bare", found, 1).alias("kind"),
        F.regexp_extract("bare", found, 2).alias("raw"),
    )


def tag_values(lines: DataFrame) -> DataFrame:
    """file, tag_line, kind, value, at: the comma-separated values of each tag line, empty ones left out."""
    values = lines.select("file", "tag_line", "kind", F.posexplode(F.split("raw", ",")).alias("at", "part"))
    return values.select("file", "tag_line", "kind", trimmed(F.col("part")).alias("value"), "at").filter("value <> ''")


def bind_forward(lines: DataFrame, candidates: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """lines (keys, tag_line) with node_id: the first candidate (keys, node_id, line_start, ord) at or below the line.

    A forward as-of join: lines and candidates of a file are gone through once, from below,
    with the last candidate in hand. Lines with nothing below are left out.
    """
    none = F.lit(None)
    asked = lines.select(*keys, F.col("tag_line").alias("line"), F.lit(True).alias("asks"), none.cast("long").alias("ord"), none.alias("node_id")).distinct()
    known = candidates.select(*keys, F.col("line_start").alias("line"), F.lit(False).alias("asks"), F.col("ord").cast("long").alias("ord"), "node_id")
    upwards = Window.partitionBy(*keys).orderBy(F.desc("line"), "asks", F.desc("ord"), F.desc("node_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = known.unionByName(asked).withColumn("met", F.last("node_id", ignorenulls=True).over(upwards))
    return met.filter("asks AND met IS NOT NULL").select(*keys, F.col("line").alias("tag_line"), F.col("met").alias("node_id"))


# The wording of scan errors, after "Line n: ".
BAD_NAME = "invalid tag name '", "' — must be lowercase kebab-case"
NOTHING_BELOW = " has no function below it"
BAD_KIND = "unknown tag kind '", "'"


def scan(sources: DataFrame, nodes: DataFrame, marker: str = MARKER) -> DataFrame:
    """file, tag_line, kind, value, at, node_id, error of every tag value; error is null for good ones.

    A tag of an unknown kind has one error for its whole line. Nodes have `ord`, their
    order in the document. A tag line inside a function binds to the next function all the
    same: the one that contains it starts above it.
    """
    lines = tag_lines(sources, marker)
    candidates = nodes.filter(F.col("kind").isin("function", "method", "class")).select("file", F.col("id").alias("node_id"), "line_start", "ord")
    known = lines.filter(F.col("kind").isin(*TAG_KINDS))
    values = tag_values(known).join(bind_forward(known, candidates), ["file", "tag_line"], "left")
    at_line = F.concat(F.lit("Line "), F.col("tag_line").cast("string"), F.lit(": "))
    error = (
        F.when(~F.col("value").rlike(NAME), F.concat(at_line, F.lit(BAD_NAME[0]), F.col("value"), F.lit(BAD_NAME[1])))
        .when(F.col("node_id").isNull(), F.concat(at_line, F.lit(marker), F.col("kind"), F.lit(" "), F.col("value"), F.lit(NOTHING_BELOW)))
        .otherwise(F.lit(None).cast("string"))
    )
    good = values.select("file", "tag_line", "kind", "value", "at", "node_id", error.alias("error"))
    unknown = lines.filter(~F.col("kind").isin(*TAG_KINDS)).select(
        "file",
        "tag_line",
        "kind",
        F.lit(None).cast("string").alias("value"),
        F.lit(0).alias("at"),
        F.lit(None).cast("string").alias("node_id"),
        F.concat(at_line, F.lit(BAD_KIND[0]), F.col("kind"), F.lit(BAD_KIND[1])).alias("error"),
    )
    return good.unionByName(unknown)


def scan_tags(sources: DataFrame, nodes: DataFrame, marker: str = MARKER) -> DataFrame:
    """Tags of the graph: node_id, kind, value (a bag)."""
    return scan(sources, nodes, marker).filter("error IS NULL").select("node_id", "kind", "value")


def scan_errors(sources: DataFrame, nodes: DataFrame, marker: str = MARKER) -> DataFrame:
    """file, tag_line, error of the tags that are dropped."""
    return scan(sources, nodes, marker).filter("error IS NOT NULL").select("file", "tag_line", "error")
