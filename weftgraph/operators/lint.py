"""Lint rules: one DataFrame of (rule, severity, file, line, symbol, message) each.

The wording of the messages is a fixed value, as those who read them look for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..schema import CALLABLE
from .closure import reachable_from_flows
from .relational import tagged

#: Shorter values are never called typos; typos are at most this far from a common value.
TYPO_LENGTH, TYPO_DISTANCE = 4, 2
#: Callees from which an unreachable function is worth a remark.
BUSY = 3


def _issues(rows: DataFrame, rule: int, severity: str, *message: Column | str) -> DataFrame:
    text = F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message])
    return rows.select(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "file", F.col("line_start").alias("line"), F.col("name").alias("symbol"), text.alias("message")
    )


def _tagged_any(graph: Graph) -> DataFrame:
    tags = graph.tags.select(F.col("node_id").alias("id"), F.col("kind").alias("tag_kind"), "value")
    return graph.nodes.join(tags, "id")


def invalid_tags(graph: Graph, marker: str) -> DataFrame:
    """Tags on what is neither function nor method."""
    rows = _tagged_any(graph).filter(~F.col("kind").isin(*CALLABLE))
    return _issues(rows, 1, "error", marker, F.col("tag_kind"), " tag on a ", F.col("kind"), " — tags should only be on functions or methods")


def close_values(values: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of values (kind, value) and known ones (kind, suggestion, used) that may be TYPO_DISTANCE edits apart, and no nearer pair is left out.

    A known value is cut into one part more than there are edits: one of them stands in the
    value as it is, moved by at most as many places as there are edits.
    """
    parts, shift = TYPO_DISTANCE + 1, TYPO_DISTANCE
    begin = lambda n, i: F.floor(n * i / parts).cast("int")
    numbers = lambda low, high: F.explode(F.sequence(F.lit(low), F.lit(high)))
    size = F.length("suggestion")
    theirs = known.withColumn("n", size).withColumn("i", numbers(0, parts - 1))
    theirs = theirs.withColumn("part", F.substring(F.col("suggestion"), begin(F.col("n"), F.col("i")) + 1, begin(F.col("n"), F.col("i") + 1) - begin(F.col("n"), F.col("i"))))
    own = values.withColumn("d", numbers(-shift, shift)).withColumn("n", (F.length("value") + F.col("d")).cast("int")).filter(F.col("n") >= 1)
    own = own.withColumn("i", numbers(0, parts - 1)).withColumn("s", numbers(-shift, shift))
    start, wide = begin(F.col("n"), F.col("i")) + F.col("s"), begin(F.col("n"), F.col("i") + 1) - begin(F.col("n"), F.col("i"))
    own = own.filter((start >= 0) & (start + wide <= F.length("value"))).withColumn("part", F.substring(F.col("value"), start + 1, wide))
    return own.select("kind", "value", "n", "i", "part").distinct().join(theirs, ["kind", "n", "i", "part"]).select("kind", "value", "suggestion", "used").distinct()


def typo_pairs(graph: Graph) -> DataFrame:
    """kind, value, suggestion, used: values used once, and the least common value close to each."""
    counts = graph.tags.groupBy("kind", "value").agg(F.count("*").alias("used")).filter(F.length("value") >= TYPO_LENGTH)
    once = counts.filter("used = 1").select("kind", "value")
    common = counts.filter("used > 1").select("kind", F.col("value").alias("suggestion"), "used")
    close = close_values(once, common).filter(F.levenshtein("value", "suggestion", TYPO_DISTANCE).between(0, TYPO_DISTANCE))
    best = close.groupBy("kind", "value").agg(F.min(F.struct("suggestion", "used")).alias("best"))
    return best.select("kind", "value", "best.suggestion", "best.used")


def typos(graph: Graph, marker: str) -> DataFrame:
    rows = _tagged_any(graph).join(typo_pairs(graph).withColumnRenamed("kind", "tag_kind"), ["tag_kind", "value"])
    return _issues(
        rows, 2, "warning", marker, F.col("tag_kind"), ' "', F.col("value"), '" — did you mean "', F.col("suggestion"), '"? (used ', F.col("used").cast("string"), " times elsewhere)"
    )


def _unmatched(graph: Graph, own: str, other: str) -> DataFrame:
    return tagged(graph, own).join(graph.tags.filter(F.col("kind") == other).select("value"), "value", "left_anti")


def orphan_emits(graph: Graph, marker: str) -> DataFrame:
    value = F.col("value")
    return _issues(_unmatched(graph, "emits", "handles"), 3, "warning", marker, 'emits "', value, f'" has no handler — no {marker}handles "', value, '" found')


def orphan_handles(graph: Graph, marker: str) -> DataFrame:
    value = F.col("value")
    return _issues(_unmatched(graph, "handles", "emits"), 4, "warning", marker, 'handles "', value, f'" has no emitter — no {marker}emits "', value, '" found')


def stale_boundaries(graph: Graph, marker: str) -> DataFrame:
    """Boundaries on nodes without external calls, unless no node has any."""
    calls = graph.external_calls.select(F.col("node_id").alias("id"))
    some = graph.external_calls.agg(F.count("*").alias("_calls")).filter("_calls > 0").select(F.lit(1).alias("_some"))  # one row at most
    rows = tagged(graph, "boundary").join(calls, "id", "left_anti").join(F.broadcast(some), F.lit(True))
    return _issues(rows, 5, "warning", marker, 'boundary "', F.col("value"), '" may be stale — no external calls found in this function')


def missing_boundaries(graph: Graph, marker: str) -> DataFrame:
    """Nodes that call a package and have no boundary, once for each package."""
    calls = graph.external_calls.select(F.col("node_id").alias("id"), "package").distinct()
    bound = graph.tags.filter("kind = 'boundary'").select(F.col("node_id").alias("id"))
    rows = graph.nodes.join(calls.join(bound, "id", "left_anti"), "id")
    return _issues(rows, 6, "warning", "Function calls external package '", F.col("package"), f"' but has no {marker}boundary tag")


def dead_end_flows(graph: Graph, marker: str) -> DataFrame:
    entries = graph.tags.filter("kind = 'flow'").select(F.col("node_id").alias("id")).distinct()
    led = graph.sources().join(entries, "id", "left_semi").distinct().withColumn("_led", F.lit(True))  # edges are read once, and what is left are entries
    rows = tagged(graph, "flow").join(led, "id", "left").filter("_led IS NULL")
    tail = f'" entry point has no callees — the call tree may be incomplete. If this function dispatches through a queue or dynamic dispatch, add {marker}emits/{marker}handles tags.'
    return _issues(rows, 7, "warning", 'Flow "', F.col("value"), tail)


def disconnected(graph: Graph, marker: str) -> DataFrame:
    """Busy functions outside tests, without tags, that no flow reaches."""
    busy = graph.callees().filter(F.col("callees") >= BUSY)
    rows = graph.nodes.filter(F.col("kind").isin(*CALLABLE) & ~F.col("is_test")).join(busy, "id")
    rows = rows.join(graph.tags.select(F.col("node_id").alias("id")), "id", "left_anti").join(reachable_from_flows(graph), "id", "left_anti")
    return _issues(
        rows, 8, "info", "Function has ", F.col("callees").cast("string"), f" callees but is unreachable from any flow. Consider adding {marker}flow or {marker}handles tag."
    )


RULES = (invalid_tags, typos, orphan_emits, orphan_handles, stale_boundaries, missing_boundaries, dead_end_flows, disconnected)


def lint(graph: Graph, marker: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """All issues; rules whose function name is in `ignore` are left out. Order by rule, file, line, symbol, message."""
    found = [rule(graph, marker) for rule in RULES if rule.__name__ not in ignore]
    out = found[0] if found else invalid_tags(graph, marker).limit(0)
    for more in found[1:]:
        out = out.unionByName(more)
    return out
