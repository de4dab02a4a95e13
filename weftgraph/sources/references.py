"""References to a symbol become calls from the functions that enclose them: an interval join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCATIONS = "array<struct<uri: string, range: struct<start: struct<line: int, character: int>, `end`: struct<line: int, character: int>>>>"


def located(dump: DataFrame, project: str) -> DataFrame:
    """target_id, file, line (from 1) of each reference inside the project; the dump has target_id and refs (JSON)."""
    rows = dump.select("target_id", F.explode(F.from_json("refs", LOCATIONS)).alias("ref"))
    rows = rows.filter(F.col("ref.uri").startswith(project))
    file = F.regexp_replace(F.substring(F.col("ref.uri"), F.lit(len(project) + 1), F.length("ref.uri")), "^/", "")
    return rows.select("target_id", file.alias("file"), (F.col("ref.range.start.line") + 1).alias("line"))


#: Lines of a block, and up to how many lines a function is looked for by it; longer functions have blocks of their own.
BLOCKS = ((1 << 8, 1 << 12), (1 << 16, None))


def enclosing(refs: DataFrame, functions: DataFrame, innermost: bool = False) -> DataFrame:
    """refs (target_id, file, line) with caller_id, the function or method around the line.

    Of several the first in document order, which is the outermost, or else the innermost.
    functions: id, kind, file, line_start, line_end and ord (document order). A function is
    met by the references in its blocks of lines only, not by all of its file.
    """
    own = functions.filter(F.col("kind").isin("function", "method")).select(F.col("id").alias("caller_id"), "file", "line_start", "line_end", "ord")
    length = F.col("line_end") - F.col("line_start")
    block_of = lambda column, lines: F.floor(F.col(column) / lines).cast("int")
    spans, shortest = None, 0
    for size, (lines, longest) in enumerate(BLOCKS):
        fits = (length >= shortest) if longest is None else (length >= shortest) & (length < longest)
        rows = own.filter(fits).withColumn("block", F.explode(F.sequence(block_of("line_start", lines), block_of("line_end", lines)))).withColumn("size", F.lit(size))
        spans, shortest = rows if spans is None else spans.unionByName(rows), longest
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("size"), block_of("line", lines).alias("block")) for k, (lines, _) in enumerate(BLOCKS)]))
    asked = refs.select("target_id", "file", "line").distinct().select("*", at.alias("at")).select("target_id", "file", "line", "at.size", "at.block")
    met = asked.join(spans, ["file", "size", "block"]).filter(F.col("line").between(F.col("line_start"), F.col("line_end")))
    order = F.struct(-F.col("line_start"), F.col("line_end"), -F.col("ord")) if innermost else F.struct("ord", "line_start", "caller_id")
    return met.groupBy("target_id", "file", "line").agg(F.min_by("caller_id", order).alias("caller_id"))


def reference_edges(refs: DataFrame, functions: DataFrame, innermost: bool = False) -> DataFrame:
    """Distinct call edges from enclosing functions to what they refer to; a function's references to itself are none."""
    met = enclosing(refs, functions, innermost).filter(F.col("caller_id") != F.col("target_id"))
    return met.select(F.col("caller_id").alias("source_id"), "target_id", F.lit("calls").alias("kind")).distinct()
