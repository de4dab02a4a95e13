"""Listings and reports as tables of lines: o (texts that order them) and line. Spark makes and orders them, however many there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import padded
from ..graph import Graph
from ..operators import closure, paths, relational
from ..sources.shared import saved
from . import reports

#: Width of a line number, and of names in a column.
DIGITS, NAME = 12, 20
#: Emitters or handlers of an event in a cell, on average.
CELL = 300


def in_order(lines: DataFrame) -> DataFrame:
    """at (from 0) and line."""
    return closure.numbered(lines, "o", "line").select(F.col("_number").alias("at"), "line")


def _ends(graph: Graph, kind: str) -> DataFrame:
    """event_name, name, and where each emitter or handler stands in its event, by file and name: how many stand before all of the same file and name (before), how many those are (n), how many of these have no name (unnamed), and how many stand before it among them (i)."""
    rows = relational.tagged(graph, kind).select(F.col("value").alias("event_name"), F.coalesce("file", F.lit("")).alias("_file"), F.coalesce("name", F.lit("")).alias("_name"), F.col("name").isNotNull().alias("_named"), "name")
    order = ("event_name", "_file", "_name")
    rows = saved(closure.numbered(rows, *order, "_named"), "ends")
    like = rows.groupBy(*order).agg(F.min("_number").alias("_first"), F.count("*").alias("n"), F.sum((~F.col("_named")).cast("long")).alias("unnamed"))
    firsts = rows.groupBy("event_name").agg(F.min("_number").alias("_least"))
    return rows.join(like, [*order]).join(firsts, "event_name").select("event_name", "name", (F.col("_first") - F.col("_least")).alias("before"), "n", "unnamed", (F.col("_number") - F.col("_first")).alias("i"))


def _in_cells(ends: DataFrame, side: str, text: Column) -> DataFrame:
    """event_name, a cell and an array of its ends, some CELL each."""
    sizes = ends.groupBy("event_name").agg(F.ceil(F.count("*") / CELL).alias("_cells"))
    cell = F.pmod(F.xxhash64("name", "before", "i"), F.col("_cells")).alias(f"{side}_cell")
    rows = ends.join(sizes, "event_name").select("event_name", cell, F.struct(text.alias("text"), "before", "n", "unnamed", "i").alias("_end"))
    return rows.groupBy("event_name", f"{side}_cell").agg(F.collect_list("_end").alias(side))


def events_in_order(graph: Graph, after: int = 0, title: Column | None = None) -> DataFrame:
    """at (from `after`) and line of each pair of emitter and handler, as in_order has them.

    Only emitters and handlers are sorted: as an event's pairs are all of its emitters with all of its
    handlers, a pair's place follows from theirs. No pair is shuffled. Pairs of the same files and names share their places;
    lines among them without a text come first.
    """
    emitters, handlers = _ends(graph, "emits"), _ends(graph, "handles")
    count = lambda rows, n: rows.groupBy("event_name").agg(F.count("*").alias(n))
    sizes = count(emitters, "_emitters").join(count(handlers, "handlers"), "event_name").withColumn("_pairs", F.col("_emitters") * F.col("handlers"))
    places = closure.summed(sizes, "_pairs", "event_name").select("event_name", "handlers", (F.col("_before") + after).alias("first"))
    title = F.col("event_name") if title is None else title
    head = F.concat(title, F.lit(" → emitted by "), "name", F.lit(", handled by "))
    n = int(graph.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _in_cells(emitters, "emits", head).join(_in_cells(handlers, "handles", F.col("name")), "event_name").join(places, "event_name")
    met = met.repartition(n, "event_name", "emits_cell", "handles_cell")
    pairs = met.select("first", "handlers", "handles", F.explode("emits").alias("e")).select("first", "handlers", "e", F.explode("handles").alias("h"))
    e, h = (lambda c: F.col("e")[c]), (lambda c: F.col("h")[c])
    named = F.col("e")["i"] - e("unnamed")
    among = (
        F.when(named < 0, e("i") * h("n") + h("i"))
        .when(h("i") < h("unnamed"), e("unnamed") * h("n") + named * h("unnamed") + h("i"))
        .otherwise(e("unnamed") * h("n") + (e("n") - e("unnamed")) * h("unnamed") + named * (h("n") - h("unnamed")) + h("i") - h("unnamed"))
    )
    at = F.col("first") + e("before") * F.col("handlers") + e("n") * h("before") + among
    return pairs.select(at.alias("at"), F.concat(e("text"), h("text")).alias("line"))


def _number(c: str) -> Column:
    return F.lpad(F.col(c).cast("string"), DIGITS, "0")


def _rows(rows: DataFrame, line: Column, *order: str | Column) -> DataFrame:
    """A line a row; order: columns, or texts as they are."""
    return rows.select(F.array(*[F.coalesce(F.col(o) if isinstance(o, str) else o, F.lit("")) for o in order]).alias("o"), line.alias("line"))


def _fixed(graph: Graph, *lines: tuple[str, str]) -> DataFrame:
    return graph.nodes.sparkSession.createDataFrame([([o], line) for o, line in lines], "o array<string>, line string")


def _section(rows: DataFrame, first: str, title: str, line: Column, *order: str | Column) -> DataFrame:
    """An empty line, a title and the rows, if there are any. first: the text that orders the section, a digit."""
    head = rows.limit(1)
    return _union(_rows(head, F.lit(""), F.lit(first), F.lit("0")), _rows(head, F.lit(title), F.lit(first), F.lit("1")), _rows(rows, line, F.lit(first), F.lit("2"), *order))


def _union(*lines: DataFrame) -> DataFrame:
    out = lines[0]
    for more in lines[1:]:
        out = out.unionByName(more)
    return out


def place() -> Column:
    return F.concat("name", F.lit(" ("), "file", F.lit(":"), F.col("line_start").cast("string"), F.lit(")"))


def _place_order() -> tuple[str | Column, ...]:
    return "file", _number("line_start"), "id"


def flow_line() -> Column:
    route = F.col("metadata")["route"]
    way = F.when(F.length(route) > 0, F.concat(route, F.lit(" "))).otherwise("")
    return F.concat(padded(F.col("value"), NAME), F.lit(" → "), way, F.lit("("), "file", F.lit(":"), F.col("line_start").cast("string"), F.lit(")"))


def _event_text() -> Column:
    return F.concat(F.lit("emitted by "), "emitter_name", F.lit(", handled by "), "handler_name")


_EVENT_ORDER = ("event_name", "emitter_file", "emitter_name", "handler_file", "handler_name")


def _counted(n: str, noun: str) -> Column:
    return F.concat(F.col(n).cast("string"), F.lit(f" {noun}"), F.when(F.col(n) == 1, "").otherwise("s"))


def flows(graph: Graph) -> DataFrame:
    return _rows(relational.flows(graph), flow_line(), "value", *_place_order())


def boundaries(graph: Graph) -> DataFrame:
    """Each boundary's name, and its functions below."""
    found = relational.boundaries(graph)
    heads = _rows(found.select("value").distinct(), F.concat("value", F.lit(":")), "value", F.lit("0"))
    return heads.unionByName(_rows(found, F.concat(F.lit("  "), place()), "value", F.lit("1"), *_place_order()))


def events(graph: Graph) -> DataFrame:
    return _rows(relational.events(graph), F.concat("event_name", F.lit(" → "), _event_text()), *_EVENT_ORDER)


def _overview_events(graph: Graph) -> DataFrame:
    return _rows(relational.events(graph), F.concat(F.lit("  "), padded(F.col("event_name"), NAME), F.lit(" → "), _event_text()), F.lit("7"), *_EVENT_ORDER)


def overview(graph: Graph) -> DataFrame:
    return _union(_overview_head(graph), _overview_events(graph))


def overview_in_order(graph: Graph) -> DataFrame:
    """at and line of the overview; the events, which come last, aren't sorted as pairs."""
    head = in_order(_overview_head(graph))
    return head.unionByName(events_in_order(graph, head.count(), F.concat(F.lit("  "), padded(F.col("event_name"), NAME))))


def _overview_head(graph: Graph) -> DataFrame:
    return _union(
        _fixed(graph, ("0", "Flows:"), ("2", ""), ("3", "Boundaries:"), ("5", ""), ("6", "Events:")),
        _rows(relational.flows(graph), F.concat(F.lit("  "), flow_line()), F.lit("1"), "value", *_place_order()),
        _rows(relational.boundary_rollup(graph), F.concat(F.lit("  "), padded(F.col("value"), NAME), F.lit(" → "), _counted("n_functions", "function"), F.lit(" across "), _counted("n_files", "file")), F.lit("4"), "value"),
    )


def callers(graph: Graph, node_id: str) -> DataFrame:
    return _rows(relational.callers(graph, node_id), F.concat(F.lit("← "), place()), *_place_order())


def callees(graph: Graph, node_id: str) -> DataFrame:
    return _rows(relational.callees(graph, node_id), F.concat(F.lit("→ "), place()), *_place_order())


def flow(graph: Graph, name: str) -> DataFrame:
    """The trees of a flow's entries, one after the other."""
    rows = paths.flow_tree(graph, name)
    entries = graph.nodes.select(F.col("id").alias("entry"), F.col("file").alias("_file"), F.col("line_start").alias("_line"))
    arrow = F.when(F.col("depth") > 0, F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("→ "))).otherwise("")
    bound = F.when(F.length("boundary") > 0, F.concat(F.lit(" ["), "boundary", F.lit("]"))).otherwise("")
    emits = F.when(F.length("emits") > 0, F.concat(F.lit(" emits "), "emits")).otherwise("")
    return _rows(rows.join(entries, "entry"), F.concat(arrow, place(), bound, emits), "_file", _number("_line"), "entry", _number("ord"))


def context(graph: Graph, node_id: str) -> DataFrame:
    """A node, its signature, flows, callers, callees and first boundary, as far as it has them."""
    own = graph.node_rows(node_id)
    flows_of = closure.flows_for_node(graph, node_id).agg(F.array_join(F.array_sort(F.collect_set("flow")), ", ").alias("flows"))
    near, order = F.concat(F.lit("    ← "), place()), _place_order()
    bound = relational.boundary_of_node(graph, last=False).filter(F.col("node_id") == node_id)
    return _union(
        _rows(own, place(), F.lit("0")),
        _rows(own.filter(F.length("signature") > 0), F.concat(F.lit("  signature: "), "signature"), F.lit("1")),
        _rows(flows_of.filter("flows <> ''"), F.concat(F.lit("  flows: "), "flows", F.lit(" (derived)")), F.lit("2")),
        _section(relational.callers(graph, node_id), "3", "  callers:", near, *order),
        _section(relational.callees(graph, node_id), "4", "  callees:", F.concat(F.lit("    → "), place()), *order),
        _rows(bound, F.lit(""), F.lit("5")),
        _rows(bound, F.concat(F.lit("  boundary: "), "boundary"), F.lit("6")),
    )


def impact(graph: Graph, node_id: str) -> DataFrame:
    """What a change of a node affects: callers, flows and tests."""
    rows = reports.impact_rows(graph, node_id)

    def listed(part: str) -> DataFrame:
        return graph.nodes.join(rows.filter(F.col("part") == part).select(F.col("item").alias("id")), "id")

    up = F.concat(F.lit("  ← "), place())
    flows_of = rows.filter("part = 'flow'").agg(F.array_join(F.array_sort(F.collect_set("item")), ", ").alias("flows")).filter("flows <> ''")
    return _union(
        _fixed(graph, ("0", "Direct callers:")),
        _rows(listed("direct"), up, F.lit("1"), *_place_order()),
        _section(listed("transitive"), "2", "Transitive callers:", up, *_place_order()),
        _rows(flows_of, F.lit(""), F.lit("3")),
        _rows(flows_of, F.concat(F.lit("Affected flows: "), "flows"), F.lit("4")),
        _section(listed("test"), "5", "Tests:", F.concat(F.lit("  "), "id"), *_place_order()),
    )
