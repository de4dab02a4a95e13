"""Symbol lookup, one-step joins and aggregates over the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, event_hubs, pairs_of_hubs


#: Matches of an ambiguous symbol that its error names.
MATCHES = 100


class SymbolError(LookupError):
    """A symbol that names no node, or several: `matches` holds their ids."""

    def __init__(self, message: str, matches: tuple[str, ...] = ()):
        super().__init__(message)
        self.matches = matches


def event_pairs(tags: DataFrame) -> DataFrame:
    """Event edges: each emitter of a value to each of its handlers, itself included."""
    return pairs_of_hubs(event_hubs(tags))


def synthesize_event_edges(graph: Graph) -> Graph:
    """The graph with its event edges made anew from the tags; repeating it changes nothing."""
    return graph.with_hubs()


def resolve_symbol(graph: Graph, symbol: str) -> DataFrame:
    """The node of that id, else all nodes of that name."""
    named = graph.nodes.filter((F.col("id") == symbol) | (F.col("name") == symbol))
    exact = graph.node_rows(symbol).select(F.lit(1).alias("_exact")).limit(1)
    # at most one row on the other side
    return named.join(F.broadcast(exact), F.lit(True), "left").filter((F.col("id") == symbol) | F.col("_exact").isNull()).drop("_exact")


def resolve_one(graph: Graph, symbol: str):
    """The only node that a symbol stands for; of an ambiguous one some matches are named."""
    found = resolve_symbol(graph, symbol).orderBy("file", "line_start", "id").limit(MATCHES).collect()
    if not found:
        raise SymbolError(f"Unknown symbol: {symbol}")
    if len(found) > 1:
        raise SymbolError("Ambiguous symbol. Matches:", tuple(r["id"] for r in found))
    return found[0]


def only(graph: Graph, symbol: str) -> DataFrame:
    """The only node that a symbol stands for, as a row; none for an unknown symbol, and an error for an ambiguous one when it is read."""
    found = resolve_symbol(graph, symbol).limit(2)
    several = found.agg((F.count("*") > 1).alias("_several"))  # of two rows at most
    bad = F.raise_error(F.lit(f"Ambiguous symbol: {symbol}")).cast("boolean")
    return found.join(F.broadcast(several)).filter(F.when(F.col("_several"), bad).otherwise(True)).drop("_several")


def callers(graph: Graph, node_id: str) -> DataFrame:
    """Nodes with a followed edge to the node, once for each edge."""
    to = graph.edges_into(node_id).select(F.col("source_id").alias("id"))
    return graph.nodes.join(to, "id")


def callees(graph: Graph, node_id: str) -> DataFrame:
    """Nodes that the node has a followed edge to, once for each edge."""
    to = graph.edges_from(node_id).select(F.col("target_id").alias("id"))
    return graph.nodes.join(to, "id")


def tagged(graph: Graph, kind: str) -> DataFrame:
    """value and node columns for each tag of a kind; see in_order."""
    tags = graph.tags.filter(F.col("kind") == kind).select(F.col("node_id").alias("id"), "value")
    return graph.nodes.join(tags, "id")


def in_order(rows: DataFrame) -> DataFrame:
    """The order of every listing: value, file, line, id."""
    return rows.orderBy(*[c for c in ("value", "file", "line_start", "id") if c in rows.columns])


def flows(graph: Graph) -> DataFrame:
    return tagged(graph, "flow")


def boundaries(graph: Graph) -> DataFrame:
    return tagged(graph, "boundary")


def events(graph: Graph) -> DataFrame:
    """event_name, emitter_name, emitter_file, handler_name, handler_file of each pair of emitter and handler."""

    def side(kind: str, name: str) -> DataFrame:
        return tagged(graph, kind).select(F.col("value").alias("event_name"), F.col("name").alias(f"{name}_name"), F.col("file").alias(f"{name}_file"))

    return side("emits", "emitter").join(side("handles", "handler"), "event_name")


def tag_counts(graph: Graph) -> DataFrame:
    """kind, value, n."""
    return graph.tags.groupBy("kind", "value").agg(F.count("*").alias("n"))


def boundary_rollup(graph: Graph) -> DataFrame:
    """value, n_functions, n_files of each boundary."""
    return boundaries(graph).groupBy("value").agg(F.count("*").alias("n_functions"), F.countDistinct("file").alias("n_files"))


def emitted_values(graph: Graph) -> DataFrame:
    """node_id, emits: a node's emitted values, joined by comma and space."""
    own = graph.tags.filter("kind = 'emits'").groupBy("node_id")
    return own.agg(F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("emits"))


def boundary_of_node(graph: Graph, last: bool) -> DataFrame:
    """node_id, boundary: the last or first of a node's boundary values."""
    pick = F.max if last else F.min
    return graph.tags.filter("kind = 'boundary'").groupBy("node_id").agg(pick("value").alias("boundary"))


def coverage(graph: Graph) -> DataFrame:
    """tagged, total, percent: distinct tagged nodes of any kind against all functions and methods."""
    some = graph.tags.agg(F.countDistinct("node_id").alias("tagged"))
    every = graph.nodes.filter("kind IN ('function', 'method')").agg(F.count("*").alias("total"))
    percent = F.when(F.col("total") > 0, F.floor(100 * F.col("tagged") / F.col("total") + 0.5)).otherwise(0)
    return some.join(every, F.lit(True)).withColumn("percent", percent.cast("long"))  # one row each


def project_summary(graph: Graph) -> DataFrame:
    """files, symbols, edges."""
    own = graph.nodes.agg(F.countDistinct("file").alias("files"), F.count("*").alias("symbols"))
    return own.join(graph.size(), F.lit(True))  # one row each
