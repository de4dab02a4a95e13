"""Reports composed of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..graph import Graph
from ..operators import closure, relational
from ..sources.shared import saved

#: What a code slice takes along above its function: comments and decorators.
LEADING = ("#", "//", "@", "/*")


def _part(rows: DataFrame, name: str, column: str) -> DataFrame:
    return rows.select(F.lit(name).alias("part"), F.col(column).alias("item"))


def impact_rows(graph: Graph, node_id: str) -> DataFrame:
    """part (direct, transitive, flow, test) and item of what a change of the node affects.

    Flows are those that any upstream node is in: an entry that leads to one is upstream itself.
    """
    upstream = saved(graph.nodes.select("id", "is_test").join(closure.impact_ids(graph, node_id), "id", "left_semi"), "upstream")
    direct = relational.callers(graph, node_id).select("id")
    reached = closure.flow_seeds(graph).join(upstream, "id", "left_semi").select("flow").distinct()
    return (
        _part(direct, "direct", "id")
        .unionByName(_part(upstream.join(direct, "id", "left_anti"), "transitive", "id"))
        .unionByName(_part(reached, "flow", "flow"))
        .unionByName(_part(upstream.filter("is_test"), "test", "id"))
    )


def context_rows(graph: Graph, node_id: str) -> DataFrame:
    """part (caller, callee, flow, boundary) and item of a node's neighbourhood; of several boundaries the first."""
    boundary = relational.boundary_of_node(graph, last=False).filter(F.col("node_id") == node_id)
    return (
        _part(relational.callers(graph, node_id), "caller", "id")
        .unionByName(_part(relational.callees(graph, node_id), "callee", "id"))
        .unionByName(_part(closure.flows_for_node(graph, node_id), "flow", "flow"))
        .unionByName(_part(boundary, "boundary", "boundary"))
    )


def code_slices(rows: DataFrame) -> DataFrame:
    """rows (text, line_start, line_end) with first and code: a function's lines, and the comments and decorators right above."""
    lines = F.split("text", "\n", -1)
    out = rows.withColumn("_lines", lines)
    above = F.reverse(F.slice("_lines", 1, F.greatest(F.col("line_start") - 1, F.lit(0))))
    leads = F.transform(above, lambda x: F.exists(F.array(*[F.lit(p) for p in LEADING]), lambda p: F.startswith(trimmed(x), p)))
    stop = F.array_position(leads, F.lit(False))  # from 1; 0: all of them lead
    out = out.withColumn("_ups", F.when(stop > 0, stop - 1).otherwise(F.size(leads)).cast("int"))
    out = out.withColumn("first", F.greatest(F.lit(1), F.col("line_start") - F.col("_ups")))
    code = F.array_join(F.slice("_lines", F.col("first"), F.greatest(F.col("line_end") - F.col("first") + 1, F.lit(0))), "\n")
    return out.withColumn("code", code).drop("_lines", "_ups")
