"""Registered queries of what is written: the store's operations, and the commands' texts, each with SQL of its own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, is_hub
from ..operators import closure, relational
from ..schema import TABLES
from ..sources import files
from ..sources.shared import table_path
from ..sources.store import GraphStore
from . import lines as lines_of
from .queries import FLOW, SINK, SOURCE, TREE, table_rows
from .registry import on_graph, query
from .sql import MEMBERSHIP, over_graph
from .sql import upstream as upstream_sql

# --- the store ---

_ROWS = """select 'nodes' as tab, id as a, file as b, kind as c from nodes
union all select 'edges', source_id, target_id, kind from edges
union all select 'tags', node_id, kind, value from tags
union all select 'external_calls', node_id, package, symbol from external_calls"""


def _store(graph: Graph, *tables: str) -> GraphStore:
    """A store with these tables of the graph, and the others empty."""
    spark = graph.nodes.sparkSession
    store = GraphStore(spark, table_path(spark, "store"))
    store.create()
    own = Graph.empty(spark).with_tables(**{t: getattr(graph, t) for t in tables})
    if "edges" in tables and graph.hubs is not None:
        own = replace(own, hubs=graph.hubs, direct=graph.direct)
    store.replace(own)
    return store


@on_graph(over_graph(_ROWS))
def store_replace_and_open(g: Graph) -> DataFrame:
    return table_rows(_store(g, "nodes", "edges", "tags", "external_calls").open())


@on_graph(over_graph("select node_id, kind, value from tags"))
def store_insert_tags(g: Graph) -> DataFrame:
    """All tags, some of them twice."""
    store = _store(g, "nodes")
    store.insert_tags(g.tags.filter("kind <> 'flow'"))
    store.insert_tags(g.tags.filter("kind <> 'emits'").unionByName(g.tags.filter("kind = 'flow'")))
    return store.read("tags")


@on_graph(over_graph("select node_id, package, symbol from external_calls"))
def store_insert_external_calls(g: Graph) -> DataFrame:
    store = _store(g)
    for _ in range(2):
        store.insert_external_calls(g.external_calls)
    return store.read("external_calls")


@on_graph(over_graph("select id, case when kind = 'class' then name || ' again' else name end as name, file, line_start, line_end from nodes"))
def store_insert_nodes(g: Graph) -> DataFrame:
    """Nodes over nodes: the new rows win, and of several the last."""
    store = _store(g, "nodes")
    again = g.nodes.filter("kind = 'class'")
    more = again.withColumn("name", F.lit("lost")).withColumn("at", F.lit(1)).unionByName(again.withColumn("name", F.concat("name", F.lit(" again"))).withColumn("at", F.lit(2)))
    store.insert_nodes(more, "at")
    return store.read("nodes").select("id", "name", "file", "line_start", "line_end")


@on_graph("select tab, cast(0 as bigint) as n from (values ('nodes'), ('edges'), ('tags'), ('external_calls')) as v(tab) union all select 'meta', 1")
def store_clear(g: Graph) -> DataFrame:
    store = _store(g, "nodes", "edges", "tags", "external_calls")
    store.clear()
    counts = [store.read(t).agg(F.lit(t).alias("tab"), F.count("*").alias("n")) for t in TABLES]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


@on_graph("select 'schema_version' as key, '2' as value union all select 'last_build', '12'")
def store_meta(g: Graph) -> DataFrame:
    store = _store(g)
    for value in ("11", "12"):
        store.set_meta("last_build", value)
    return store.read("meta")


@on_graph(over_graph("select source_id, target_id, kind from edges where kind = 'event'"))
def store_event_edges(g: Graph) -> DataFrame:
    """Made anew twice, from edges without events."""
    store = _store(g.with_tables(edges=g.edges.filter("kind <> 'event'")), "nodes", "edges", "tags")
    for _ in range(2):
        store.synthesize_event_edges()
    return store.read("edges").filter("kind = 'event'")


_GONE = "gone as (select id from nodes where file = 'orders/3.ts')"
_LEFT = """select 'nodes' as tab, id as a, file as b, kind as c from nodes where id not in (select id from gone)
union all select 'edges', source_id, target_id, kind from edges where source_id not in (select id from gone) and target_id not in (select id from gone)
union all select 'tags', node_id, kind, value from tags where node_id not in (select id from gone)
union all select 'external_calls', node_id, package, symbol from external_calls where node_id not in (select id from gone)"""


@on_graph(over_graph(_LEFT, _GONE))
def store_delete_file_data(g: Graph) -> DataFrame:
    store = _store(g, "nodes", "edges", "tags", "external_calls")
    store.delete_file_data("orders/3.ts")
    return table_rows(store.open())


class _Overtaken(GraphStore):
    """A writer that another one overtakes once, between its change and its version."""

    def before_publishing(self, action: Callable[[], None]) -> _Overtaken:
        self._action = action
        return self

    def _publish(self, version) -> bool:
        action, self._action = self._action, None
        if action:
            action()
        return super()._publish(version)


@on_graph(over_graph("select source_id, target_id, kind from edges where kind <> 'event'"))
def store_two_writers(g: Graph) -> DataFrame:
    """Edges by two writers at once, of which neither loses any: some are both's."""
    plain = g.edges.filter("kind <> 'event'")
    store = _store(g, "nodes")
    slow = _Overtaken(store.spark, store.path).before_publishing(lambda: store.insert_edges(plain.filter("source_id NOT LIKE 'customer::%'")))
    slow.insert_edges(plain.filter("source_id NOT LIKE 'part::%'"))
    return store.read("edges")


@on_graph(over_graph("select kind, count(*) as n from tags where kind in ('emits', 'handles') group by 1"))
def store_event_hubs(g: Graph) -> DataFrame:
    """Edges of the hubs that stand for all event edges, by their end: as many as tags."""
    store = _store(g, "nodes", "tags")
    store.synthesize_event_edges()
    return store.open().hubs.groupBy(F.when(is_hub(F.col("target_id")), "emits").otherwise("handles").alias("kind")).agg(F.count("*").alias("n"))


@on_graph(over_graph(f"select 'caller' as part, n.id from nodes n join followed f on f.source_id = n.id where f.target_id = '{SINK}' union all select 'callee', n.id from nodes n join followed f on f.target_id = n.id where f.source_id = '{SINK}'"))
def store_lookups(g: Graph) -> DataFrame:
    """One id's neighbours, from the parts of the store that hold it."""
    opened = _store(g, "nodes", "edges", "tags").open()
    near = ((n, step(opened, SINK)) for n, step in (("caller", relational.callers), ("callee", relational.callees)))
    first, second = (rows.select(F.lit(n).alias("part"), "id") for n, rows in near)
    return first.unionByName(second)


_ROUTE = "'GET /' || lower(n.name)"


@on_graph(
    over_graph(
        f"select t.value as flow, n.id, {_ROUTE} as route, t.value || repeat(' ', greatest(0, 20 - length(t.value))) || ' → ' || {_ROUTE} || ' (' || n.file || ':' || n.line_start || ')' as line "
        "from tags t join nodes n on n.id = t.node_id where t.kind = 'flow'"
    )
)
def store_metadata(g: Graph) -> DataFrame:
    """Nodes' metadata, written and read again: an entry's route in the flow's line."""
    routed = g.nodes.withColumn("metadata", F.create_map(F.lit("route"), F.concat(F.lit("GET /"), F.lower("name"))))
    opened = _store(g.with_tables(nodes=routed), "nodes", "tags").open()
    found = relational.flows(opened)
    return found.select(F.col("value").alias("flow"), "id", F.col("metadata")["route"].alias("route"), lines_of.flow_line().alias("line"))


# --- files ---


@query(
    "select 'folder=' || lower(replace(p_brand, '#', '')) as folder, count(distinct p_brand) as n_files, cast(sum(length(p_name) + 1) as bigint) as n_chars "
    "from part where p_brand not like 'Brand#1%' group by 1"
)
def discover_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files with their texts, below a folder of which some folders are excluded: a file a brand, with the names of its parts."""
    root = table_path(spark, "tree")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    folder = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    part.select(F.col("p_name").alias("value"), folder.alias("folder")).repartition("folder").write.partitionBy("folder").text(root)
    found = files.discover(spark, root, (".txt",), ("brand1",), text=True)
    folder = F.element_at(F.split("file", "/"), -2)
    return found.groupBy(folder.alias("folder")).agg(F.count("*").alias("n_files"), F.sum(F.length("text")).cast("long").alias("n_chars"))


# --- the order of listings ---


@on_graph(over_graph("select value, n.id, row_number() over (partition by value order by n.file, n.line_start, n.id) as nth from tags t join nodes n on n.id = t.node_id where t.kind = 'boundary'"))
def grouped_listing(g: Graph) -> DataFrame:
    """Each boundary's functions, numbered in the order in which the listing has them."""
    listed = closure.numbered(relational.boundaries(g).select("value", "file", "line_start", "id"), "value", "file", "line_start", "id")
    first = listed.groupBy("value").agg(F.min("_number").alias("_least"))
    return listed.join(first, "value").select("value", "id", (F.col("_number") - F.col("_least") + 1).alias("nth"))


@on_graph(over_graph(f"select id, kind, name, file, line_start, line_end from nodes where id = '{SOURCE}'"))
def resolve_one(g: Graph) -> DataFrame:
    return relational.only(g, SOURCE).select("id", "kind", "name", "file", "line_start", "line_end")


# --- what commands print ---


def printed(lines: str, *parts: str, ordered: bool = False):
    """Registers a command's lines, as at (from 0) and line; `lines` is SQL of (o, line), in the order of o. ordered: the function numbers them itself."""
    sql = over_graph(f"select row_number() over (order by o) - 1 as at, line from ({lines})", *parts)

    def keep(function: Callable[[Graph], DataFrame]):
        def run(g: Graph) -> DataFrame:
            return function(g) if ordered else lines_of.in_order(function(g))

        run.__name__ = function.__name__
        return on_graph(sql)(run)

    return keep


def _wide(text: str) -> str:
    return f"{text} || repeat(' ', greatest(0, 20 - length({text})))"


_PLACE = "n.name || ' (' || n.file || ':' || n.line_start || ')'"
_ORDER = "[n.file, lpad(cast(n.line_start as varchar), 12, '0'), n.id]"
_TAGGED = "tags t join nodes n on n.id = t.node_id where t.kind ="


def _flow_lines(indent: str) -> str:
    return f"""select ['1', t.value, n.file, lpad(cast(n.line_start as varchar), 12, '0'), n.id] as o, '{indent}' || {_wide("t.value")} || ' → (' || n.file || ':' || n.line_start || ')' as line from {_TAGGED} 'flow'"""


_EVENT = """select e.value as event, a.name as an, a.file as af, b.name as bn, b.file as bf
from tags e join tags h on h.value = e.value join nodes a on a.id = e.node_id join nodes b on b.id = h.node_id where e.kind = 'emits' and h.kind = 'handles'"""


@printed(_flow_lines(""))
def command_flows(g: Graph) -> DataFrame:
    return lines_of.flows(g)


@printed(
    f"""select [value, '0', '', '', ''] as o, value || ':' as line from (select distinct value from tags where kind = 'boundary')
union all select [t.value, '1', n.file, lpad(cast(n.line_start as varchar), 12, '0'), n.id], '  ' || {_PLACE} from {_TAGGED} 'boundary'"""
)
def command_boundaries(g: Graph) -> DataFrame:
    return lines_of.boundaries(g)


@printed(f"select [event, af, an, bf, bn] as o, event || ' → emitted by ' || an || ', handled by ' || bn as line from ({_EVENT})", ordered=True)
def command_events(g: Graph) -> DataFrame:
    return lines_of.events_in_order(g)


@printed(f"select {_ORDER} as o, '← ' || {_PLACE} as line from nodes n join followed f on f.source_id = n.id where f.target_id = '{SINK}'")
def command_callers(g: Graph) -> DataFrame:
    return lines_of.callers(g, SINK)


@printed(f"select {_ORDER} as o, '→ ' || {_PLACE} as line from nodes n join followed f on f.target_id = n.id where f.source_id = '{SOURCE}'")
def command_callees(g: Graph) -> DataFrame:
    return lines_of.callees(g, SOURCE)


@printed(
    f"""select ['0', '', '', '', '', ''] as o, 'Flows:' as line
union all select list_append(o, ''), line from ({_flow_lines("  ")})
union all select ['2', '', '', '', '', ''], '' union all select ['3', '', '', '', '', ''], 'Boundaries:'
union all select ['4', value, '', '', '', ''], '  ' || {_wide("value")} || ' → ' || n || ' function' || case when n = 1 then '' else 's' end || ' across ' || f || ' file' || case when f = 1 then '' else 's' end
  from (select t.value, count(*) as n, count(distinct n.file) as f from {_TAGGED} 'boundary' group by 1)
union all select ['5', '', '', '', '', ''], '' union all select ['6', '', '', '', '', ''], 'Events:'
union all select ['7', event, af, an, bf, bn], '  ' || {_wide("event")} || ' → emitted by ' || an || ', handled by ' || bn from ({_EVENT})""",
    ordered=True,
)
def command_overview(g: Graph) -> DataFrame:
    return lines_of.overview_in_order(g)


@printed(
    """select [e.file, lpad(cast(e.line_start as varchar), 12, '0'), t.entry, lpad(cast(t.ord as varchar), 9, '0')] as o,
  case when t.depth > 0 then repeat('  ', t.depth) || '→ ' else '' end || t.name || ' (' || t.file || ':' || t.line_start || ')'
  || coalesce(' [' || t.boundary || ']', '') || coalesce(' emits ' || t.emits, '') as line
from tree t join nodes e on e.id = t.entry where t.flow = '"""
    + FLOW
    + "'",
    TREE,
)
def command_flow(g: Graph) -> DataFrame:
    return lines_of.flow(g, FLOW)


def _near(part: str, sign: str, condition: str) -> str:
    return f"select ['{part}', n.file, lpad(cast(n.line_start as varchar), 12, '0'), n.id] as o, '    {sign} ' || {_PLACE} as line from nodes n join followed f on {condition}"


@printed(
    f"""select ['0', '', '', ''] as o, {_PLACE} as line from nodes n where id = '{SINK}'
union all select ['1', '', '', ''], '  flows: ' || string_agg(distinct flow, ', ' order by flow) || ' (derived)' from membership where id = '{SINK}' having count(*) > 0
union all select unnest([['2', '', '', ''], ['3', '', '', '']]), unnest(['', '  callers:']) from (select 1 from followed where target_id = '{SINK}' limit 1)
union all {_near("4", "←", f"f.source_id = n.id where f.target_id = '{SINK}'")}
union all select unnest([['5', '', '', ''], ['6', '', '', '']]), unnest(['', '  callees:']) from (select 1 from followed f join nodes n on n.id = f.target_id where source_id = '{SINK}' limit 1)
union all {_near("7", "→", f"f.target_id = n.id where f.source_id = '{SINK}'")}
union all select unnest([['8', '', '', ''], ['9', '', '', '']]), unnest(['', '  boundary: ' || b]) from (select min(value) as b from tags where kind = 'boundary' and node_id = '{SINK}') where b is not null""",
    MEMBERSHIP,
)
def command_context(g: Graph) -> DataFrame:
    return lines_of.context(g, SINK)


_DIRECT = f"(select source_id from steps where target_id = '{SINK}')"
_INDIRECT = f"n.id in (select id from upstream) and n.id not in {_DIRECT}"
_AFFECTED = "(select t.value from tags t where t.kind = 'flow' and t.node_id in (select u.id from upstream u join nodes n on n.id = u.id))"


@printed(
    f"""select ['0', '', '', ''] as o, 'Direct callers:' as line
union all select ['1', n.file, lpad(cast(n.line_start as varchar), 12, '0'), n.id], '  ← ' || {_PLACE} from nodes n join followed f on f.source_id = n.id where f.target_id = '{SINK}'
union all select unnest([['2', '', '', ''], ['3', '', '', '']]), unnest(['', 'Transitive callers:']) from (select 1 from nodes n where {_INDIRECT} limit 1)
union all select ['4', n.file, lpad(cast(n.line_start as varchar), 12, '0'), n.id], '  ← ' || {_PLACE} from nodes n where {_INDIRECT}
union all select unnest([['5', '', '', ''], ['6', '', '', '']]), unnest(['', 'Affected flows: ' || f]) from (select string_agg(distinct value, ', ' order by value) as f from {_AFFECTED}) where f is not null
union all select unnest([['7', '', '', ''], ['8', '', '', '']]), unnest(['', 'Tests:']) from (select 1 from nodes n where is_test and id in (select id from upstream) limit 1)
union all select ['9', n.file, lpad(cast(n.line_start as varchar), 12, '0'), n.id], '  ' || n.id from nodes n where is_test and id in (select id from upstream)""",
    upstream_sql(SINK),
)
def command_impact(g: Graph) -> DataFrame:
    return lines_of.impact(g, SINK)
