"""The registered queries of the graph engine over the star tables, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import edit_distance, padded, trimmed
from ..graph import Graph
from ..operators import closure, lint, paths, relational
from ..sources import calls, files, references, store, symbols, tags
from ..sources.star import star_graph
from . import reports
from .registry import ORACLE_SQL, QUERIES, on_graph, query
from .sql import MEMBERSHIP, NODE, over_graph
from .sql import paths as paths_sql
from .sql import upstream as upstream_sql

FLOW, SOURCE, SINK, BOUNDARY, NAMED = "building", "customer::0", "supplier::0", "nation-0", "part::0"
MARKER = "@weft:"
__all__ = ["ORACLE_SQL", "QUERIES"]
_NODE = ("id", "kind", "name", "file", "line_start", "line_end", "language", "is_test")


def table_rows(g: Graph) -> DataFrame:
    """tab, a, b, c: the rows of all tables."""
    keys = {"nodes": ("id", "file", "kind"), "edges": ("source_id", "target_id", "kind"), "tags": ("node_id", "kind", "value"), "external_calls": ("node_id", "package", "symbol")}
    parts = [getattr(g, t).select(F.lit(t).alias("tab"), *[F.col(c).alias(n) for c, n in zip(own, "abc", strict=True)]) for t, own in keys.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def text_of(path: str) -> F.Column:
    return F.array_join(path, " -> ")


# --- closures ---


@on_graph(over_graph(f"select {NODE} from nodes n where id in (select id from membership where flow = '{FLOW}')", MEMBERSHIP))
def flow_members(g: Graph) -> DataFrame:
    return closure.flow_members(g, FLOW).select(*_NODE)


@on_graph(over_graph("select flow, id from membership", MEMBERSHIP))
def flow_membership_all(g: Graph) -> DataFrame:
    return closure.flow_membership(g)


@on_graph(over_graph("select flow, id from membership", MEMBERSHIP, cyclic=True), cyclic=True)
def flow_membership_cyclic(g: Graph) -> DataFrame:
    return closure.flow_membership(g)


@on_graph(over_graph(f"select {NODE} from nodes n where id in (select id from upstream)", upstream_sql(SINK)))
def impact(g: Graph) -> DataFrame:
    return closure.impact(g, SINK).select(*_NODE)


@on_graph(over_graph(f"select {NODE} from nodes n where id in (select id from upstream)", upstream_sql(SINK), cyclic=True), cyclic=True)
def impact_cyclic(g: Graph) -> DataFrame:
    return closure.impact(g, SINK).select(*_NODE)


@on_graph(over_graph(f"select distinct flow from membership where id = '{SINK}'", MEMBERSHIP))
def flows_for_node(g: Graph) -> DataFrame:
    return closure.flows_for_node(g, SINK)


@on_graph(over_graph("select distinct id from membership", MEMBERSHIP))
def reachable_from_flows(g: Graph) -> DataFrame:
    return closure.reachable_from_flows(g)


# --- joins and lookups ---


@on_graph(over_graph(f"select {NODE} from nodes n join followed f on f.source_id = n.id where f.target_id = '{SINK}'"))
def callers(g: Graph) -> DataFrame:
    return relational.callers(g, SINK).select(*_NODE)


@on_graph(over_graph(f"select {NODE} from nodes n join followed f on f.target_id = n.id where f.source_id = '{SOURCE}'"))
def callees(g: Graph) -> DataFrame:
    return relational.callees(g, SOURCE).select(*_NODE)


@on_graph(over_graph(f"select t.value, {NODE} from nodes n join tags t on t.node_id = n.id where t.kind = 'flow'"))
def all_flows(g: Graph) -> DataFrame:
    return relational.flows(g).select("value", *_NODE)


@on_graph(over_graph(f"select t.value, {NODE} from nodes n join tags t on t.node_id = n.id where t.kind = 'boundary'"))
def all_boundaries(g: Graph) -> DataFrame:
    return relational.boundaries(g).select("value", *_NODE)


@on_graph(
    over_graph(
        """select e.value as event_name, a.name as emitter_name, a.file as emitter_file, b.name as handler_name, b.file as handler_file
from tags e join tags h on h.value = e.value join nodes a on a.id = e.node_id join nodes b on b.id = h.node_id where e.kind = 'emits' and h.kind = 'handles'"""
    )
)
def all_events(g: Graph) -> DataFrame:
    return relational.events(g)


@on_graph(over_graph("select source_id, target_id, kind from edges"))
def synthesize_event_edges(g: Graph) -> DataFrame:
    return relational.synthesize_event_edges(g).edges


@on_graph(over_graph(f"select {NODE} from nodes n where id = '{SOURCE}'"))
def resolve_symbol_id(g: Graph) -> DataFrame:
    return relational.resolve_symbol(g, SOURCE).select(*_NODE)


@on_graph(over_graph(f"select {NODE} from nodes n where name = (select name from nodes where id = '{NAMED}')"))
def resolve_symbol_name(g: Graph) -> DataFrame:
    name = g.nodes.filter(F.col("id") == NAMED).first()["name"]
    return relational.resolve_symbol(g, name).select(*_NODE)


@on_graph(over_graph("select kind, value, count(*) as n from tags group by all"))
def tag_counts(g: Graph) -> DataFrame:
    return relational.tag_counts(g)


@on_graph(over_graph("select t.value, count(*) as n_functions, count(distinct n.file) as n_files from tags t join nodes n on n.id = t.node_id where t.kind = 'boundary' group by 1"))
def overview_boundaries(g: Graph) -> DataFrame:
    return relational.boundary_rollup(g)


@on_graph(over_graph("select node_id, string_agg(distinct value, ', ' order by value) as emits from tags where kind = 'emits' group by 1"))
def emitted_values(g: Graph) -> DataFrame:
    return relational.emitted_values(g)


@on_graph(over_graph("select (select count(distinct file) from nodes) as files, (select count(*) from nodes) as symbols, (select count(*) from edges) as edges"))
def project_summary(g: Graph) -> DataFrame:
    return relational.project_summary(g)


@on_graph(
    over_graph(
        """select tagged, total, case when total = 0 then 0 else cast(floor(100.0 * tagged / total + 0.5) as bigint) end as percent
from (select (select count(distinct node_id) from tags) as tagged, (select count(*) from nodes where kind in ('function', 'method')) as total)"""
    )
)
def lint_coverage(g: Graph) -> DataFrame:
    return relational.coverage(g)


# --- paths and trees ---


@on_graph(over_graph("select array_to_string(path, ' -> ') as path from walks where head = dst", paths_sql(f"select '{SOURCE}' as src, '{SINK}' as dst")))
def find_all_paths(g: Graph) -> DataFrame:
    return paths.find_all_paths(g, SOURCE, SINK).select(text_of("path").alias("path"))


@on_graph(
    over_graph(
        "select src, dst, array_to_string(path, ' -> ') as path from walks where head = dst",
        paths_sql(f"select f.node_id as src, b.node_id as dst from tags f, tags b where f.kind = 'flow' and f.value = '{FLOW}' and b.kind = 'boundary' and b.value = '{BOUNDARY}'"),
    )
)
def trace(g: Graph) -> DataFrame:
    return paths.trace(g, FLOW, BOUNDARY).select("src", "dst", text_of("path").alias("path"))


#: On an acyclic graph a depth-first walk first meets a node on the path with the least list of (file, line, id).
TREE = """place as (select id, {'file': file, 'line': line_start, 'id': id} as p from nodes),
ways as (
  select t.value as flow, t.node_id as entry, [t.node_id] as path, [n.p] as keys, t.node_id as head from tags t join place n on n.id = t.node_id where t.kind = 'flow'
  union all
  select w.flow, w.entry, list_append(w.path, s.target_id), list_append(w.keys, n.p), s.target_id from ways w join steps s on s.source_id = w.head join place n on n.id = s.target_id
),
met as (select flow, entry, head as id, min(keys) as keys from ways group by all),
tree as (
  select flow, entry, row_number() over (partition by flow, entry order by keys) - 1 as ord, len(keys) - 1 as depth, m.id, keys[-2].id as parent_id, n.name, n.file, n.line_start,
    (select max(value) from tags where kind = 'boundary' and node_id = m.id) as boundary,
    (select string_agg(distinct value, ', ' order by value) from tags where kind = 'emits' and node_id = m.id) as emits
  from met m join nodes n on n.id = m.id
)"""


@on_graph(over_graph("select flow, entry, ord, depth, id, parent_id, name, file, line_start, boundary, emits from tree", TREE))
def flow_tree(g: Graph) -> DataFrame:
    return paths.flow_tree(g)


#: Also on cycles it is the least of all simple paths: paths are made longer, and a node keeps the least one found so far.
_LEAST = """place as (select id, {'file': file, 'line': line_start, 'id': id} as p from nodes),
best(entry, id, keys) using key (entry, id) as (
  select distinct t.node_id, t.node_id, [n.p] from tags t join place n on n.id = t.node_id where t.kind = 'flow'
  union
  select * from (
    select b.entry, s.target_id as id, min(list_append(b.keys, n.p)) as keys
    from best b join steps s on s.source_id = b.id join place n on n.id = s.target_id
    where not list_contains(list_transform(b.keys, lambda x: x.id), s.target_id) group by all
  ) m where not exists (select 1 from recurring.best r where r.entry = m.entry and r.id = m.id and r.keys <= m.keys)
),
tree as (
  select t.value as flow, m.entry, row_number() over (partition by t.value, m.entry order by m.keys) - 1 as ord, len(m.keys) - 1 as depth, m.id, m.keys[-2].id as parent_id, n.name, n.file, n.line_start,
    (select max(value) from tags where kind = 'boundary' and node_id = m.id) as boundary,
    (select string_agg(distinct value, ', ' order by value) from tags where kind = 'emits' and node_id = m.id) as emits
  from best m join nodes n on n.id = m.id join tags t on t.kind = 'flow' and t.node_id = m.entry
)"""
_CYCLIC_TREE = over_graph("select flow, entry, ord, depth, id, parent_id, name, file, line_start, boundary, emits from tree", _LEAST, cyclic=True)


@on_graph(_CYCLIC_TREE, cyclic=True)
def flow_tree_cyclic(g: Graph) -> DataFrame:
    return paths.flow_tree(g)


@on_graph(_CYCLIC_TREE, cyclic=True)
def flow_tree_in_rounds(g: Graph) -> DataFrame:
    """As if every entry's subgraph were too large for a task's memory: edges are laid on its disk. Rounds are left to entries that reach over `paths.LAID` nodes."""
    return paths.flow_tree(g, walked=0)


# --- reports ---


@on_graph(
    over_graph(
        f"""select 'direct' as part, {NODE.split(", n.kind")[0]} as item from nodes n join followed f on f.source_id = n.id where f.target_id = '{SINK}'
union all select 'transitive', n.id from nodes n where id in (select id from upstream) and id not in (select source_id from steps where target_id = '{SINK}')
union all select distinct 'flow', flow from membership where id in (select u.id from upstream u join nodes n on n.id = u.id)
union all select 'test', n.id from nodes n where is_test and id in (select id from upstream)""",
        upstream_sql(SINK),
        MEMBERSHIP,
    )
)
def impact_report(g: Graph) -> DataFrame:
    return reports.impact_rows(g, SINK)


@on_graph(
    over_graph(
        f"""select 'caller' as part, n.id as item from nodes n join followed f on f.source_id = n.id where f.target_id = '{SINK}'
union all select 'callee', n.id from nodes n join followed f on f.target_id = n.id where f.source_id = '{SINK}'
union all select distinct 'flow', flow from membership where id = '{SINK}'
union all select 'boundary', min(value) from tags where kind = 'boundary' and node_id = '{SINK}' group by node_id""",
        MEMBERSHIP,
    )
)
def context_report(g: Graph) -> DataFrame:
    return reports.context_rows(g, SINK)


# --- lint ---


def _lint_sql(rule: int, severity: str, message: str, rows: str, *parts: str) -> str:
    return over_graph(f"select {rule} as rule, '{severity}' as severity, n.file, n.line_start as line, n.name as symbol, {message} as message from {rows}", *parts)


def _tagged(kind: str) -> str:
    return f"nodes n join tags t on t.node_id = n.id where t.kind = '{kind}'"


@on_graph(_lint_sql(1, "error", f"'{MARKER}' || t.kind || ' tag on a ' || n.kind || ' — tags should only be on functions or methods'", "nodes n join tags t on t.node_id = n.id where n.kind not in ('function', 'method')"))
def lint_invalid_tags(g: Graph) -> DataFrame:
    return lint.invalid_tags(g, MARKER)


_TYPOS = """counts as (select kind, value, count(*) as used from tags where length(value) >= 4 group by all),
close as (select a.kind, a.value, min(b.value) as suggestion from counts a join counts b on a.kind = b.kind and levenshtein(a.value, b.value) <= 2 where a.used = 1 and b.used > 1 group by all),
best as (select c.*, used from close c join counts k on k.kind = c.kind and k.value = c.suggestion)"""


@on_graph(
    _lint_sql(
        2,
        "warning",
        f"""'{MARKER}' || t.kind || ' "' || t.value || '" — did you mean "' || suggestion || '"? (used ' || used || ' times elsewhere)'""",
        "nodes n join tags t on t.node_id = n.id join best b on b.kind = t.kind and b.value = t.value",
        _TYPOS,
    )
)
def lint_typos(g: Graph) -> DataFrame:
    return lint.typos(g, MARKER)


@on_graph(
    _lint_sql(
        3, "warning", f"""'{MARKER}emits "' || t.value || '" has no handler — no {MARKER}handles "' || t.value || '" found'""",
        _tagged("emits") + " and t.value not in (select value from tags where kind = 'handles')",
    )
)
def lint_orphan_emits(g: Graph) -> DataFrame:
    return lint.orphan_emits(g, MARKER)


@on_graph(
    _lint_sql(
        4, "warning", f"""'{MARKER}handles "' || t.value || '" has no emitter — no {MARKER}emits "' || t.value || '" found'""",
        _tagged("handles") + " and t.value not in (select value from tags where kind = 'emits')",
    )
)
def lint_orphan_handles(g: Graph) -> DataFrame:
    return lint.orphan_handles(g, MARKER)


@on_graph(
    _lint_sql(
        5, "warning", f"""'{MARKER}boundary "' || t.value || '" may be stale — no external calls found in this function'""",
        _tagged("boundary") + " and n.id not in (select node_id from external_calls) and exists (select 1 from external_calls)",
    )
)
def lint_stale_boundaries(g: Graph) -> DataFrame:
    return lint.stale_boundaries(g, MARKER)


@on_graph(
    _lint_sql(
        6, "warning", f"""'Function calls external package ''' || x.package || ''' but has no {MARKER}boundary tag'""",
        "nodes n join (select distinct node_id, package from external_calls) x on x.node_id = n.id where n.id not in (select node_id from tags where kind = 'boundary')",
    )
)
def lint_missing_boundaries(g: Graph) -> DataFrame:
    return lint.missing_boundaries(g, MARKER)


_DEAD_END = f"""'Flow "' || t.value || '" entry point has no callees — the call tree may be incomplete. If this function dispatches through a queue or dynamic dispatch, add {MARKER}emits/{MARKER}handles tags.'"""


@on_graph(_lint_sql(7, "warning", _DEAD_END, _tagged("flow") + " and n.id not in (select source_id from steps)"))
def lint_dead_end_flows(g: Graph) -> DataFrame:
    return lint.dead_end_flows(g, MARKER)


@on_graph(
    _lint_sql(
        8,
        "info",
        f"'Function has ' || c.callees || ' callees but is unreachable from any flow. Consider adding {MARKER}flow or {MARKER}handles tag.'",
        """nodes n join (select source_id, count(*) as callees from followed group by 1 having count(*) >= 3) c on c.source_id = n.id
where n.kind in ('function', 'method') and not n.is_test and n.id not in (select node_id from tags) and n.id not in (select id from membership)""",
        MEMBERSHIP,
    )
)
def lint_disconnected(g: Graph) -> DataFrame:
    return lint.disconnected(g, MARKER)


# --- extraction ---


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A file of each document's whole text with tag lines below, and its only function."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    k = F.col("doc_id")
    language = F.when(k % 3 == 0, "python").when(k % 3 == 1, "typescript").otherwise("go")
    python, typescript = F.when(k % 2 == 0, "# ").otherwise('"' * 3), F.when(k % 2 == 0, " * ").otherwise("/** ")
    mark = F.when(language == "python", python).when(language == "typescript", typescript).otherwise("// ")
    kind = F.when(k % 11 == 0, "flows").otherwise("flow")
    segment = F.concat(F.lit("seg-"), (k % 13).cast("string"))
    value = F.when(k % 7 == 0, F.concat(F.lit("Bad_"), segment)).otherwise(F.concat(segment, F.lit(" ,  part-"), (k % 5).cast("string"), F.lit(",")))
    text = F.concat("body", F.lit("\n"), mark, F.lit(MARKER), kind, F.lit(" "), value, F.lit("\nfunction body\n  "), mark, F.lit(f"{MARKER}emits late\n"))
    rows = d.select(F.concat(F.lit("src/"), k.cast("string")).alias("file"), language.alias("language"), text.alias("text"), F.size(F.split("body", "\n", -1)).alias("n"))
    nodes = rows.select(F.concat("file", F.lit("::f")).alias("id"), F.lit("function").alias("kind"), "file", (F.col("n") + 2).alias("line_start"), (F.col("n") + 4).alias("line_end"), F.lit(0).alias("ord"))
    return rows.select("file", "language", "text"), nodes


_MADE = """with c as (select doc_id as k, 'src/' || doc_id as file, 'seg-' || (doc_id % 13) as s, len(string_split(coalesce(text, ''), chr(10))) as n from documents),
t as (select k, file, n, cast(n + 1 as int) as tag_line, case when k % 11 = 0 then 'flows' else 'flow' end as kind,
  case when k % 7 = 0 then ['Bad_' || s] else [s, 'part-' || (k % 5)] end as vals from c),
v as (select k, file, tag_line, kind, unnest(vals) as value from t where kind = 'flow')"""


@query(f"{_MADE} select file || '::f' as node_id, kind, value from v where value not like 'Bad%'")
def scan_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.scan_tags(*_sources(spark, sf_dir), MARKER)


@query(
    f"""{_MADE} select file, tag_line, 'Line ' || tag_line || ': unknown tag kind ''flows''' as error from t where kind = 'flows'
union all select file, tag_line, 'Line ' || tag_line || ': invalid tag name ''' || value || ''' — must be lowercase kebab-case' from v where value like 'Bad%'
union all select file, cast(n + 3 as int), 'Line ' || (n + 3) || ': {MARKER}emits late has no function below it' from c"""
)
def scan_tag_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.scan_errors(*_sources(spark, sf_dir), MARKER)


@query(
    """with u as (select conv_id, turn from conversations where role = 'user'), a as (select conv_id, turn from conversations where role = 'assistant')
select u.conv_id, u.turn as tag_line, min(a.turn) as answer from u join a on a.conv_id = u.conv_id and a.turn >= u.turn group by all"""
)
def tag_asof_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    asked = turns.filter("role = 'user'").select("conv_id", F.col("turn").alias("tag_line"))
    answers = turns.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("node_id"), F.col("turn").alias("line_start"), F.col("turn").alias("ord"))
    return tags.bind_forward(asked, answers, ("conv_id",)).withColumnRenamed("node_id", "answer")


@on_graph(
    over_graph(
        """select id as target_id, n.file, line, coalesce(case when line between 1 and o.last then n.file || '::outer' end, id) as caller_id
from (select *, line_start + 4 as line from nodes where kind in ('function', 'method')) n join (select file, max(line_end) // 2 as last from nodes group by 1) o on o.file = n.file"""
    )
)
def ref_interval_bind(g: Graph) -> DataFrame:
    inner = g.nodes.filter("kind IN ('function', 'method')").select("id", "kind", "file", "line_start", "line_end", F.col("line_start").alias("ord"))
    outer = g.nodes.groupBy("file").agg(F.floor(F.max("line_end") / 2).cast("int").alias("line_end"))
    outer = outer.select(F.concat("file", F.lit("::outer")).alias("id"), F.lit("function").alias("kind"), "file", F.lit(1).alias("line_start"), "line_end", F.lit(0).alias("ord"))
    refs = inner.select(F.col("id").alias("target_id"), "file", (F.col("line_start") + 4).alias("line"))
    return references.enclosing(refs, inner.unionByName(outer))


def _ref_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to every order from the function two keys before it, from itself, and from outside the project."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))

    def at(root: str, line: F.Column) -> F.Column:
        spot = F.concat(F.lit('{"line":'), line.cast("string"), F.lit(',"character":0}'))
        return F.concat(F.lit('{"uri":"' + root + "/orders/"), (F.col("c") % 10).cast("string"), F.lit('.ts","range":{"start":'), spot, F.lit(',"end":'), spot, F.lit("}}"))

    places = F.concat_ws(",", at("file:///app", F.col("k") * 10 - 16), at("file:///app", F.col("k") * 10 + 3), at("file:///else", F.col("k") * 10))
    return o.select(F.concat(F.lit("orders::"), F.col("k").cast("string")).alias("target_id"), F.concat(F.lit("["), places, F.lit("]")).alias("refs"))


_LOCATED = "select 'orders::' || o_orderkey as target_id, 'orders/' || (o_custkey % 10) || '.ts' as file, cast(o_orderkey * 10 + d as int) as line from orders, (values (-15), (4)) as v(d)"


@query(_LOCATED)
def located_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.located(_ref_dump(spark, sf_dir), "file:///app")


@query(
    f"""with refs as ({_LOCATED}), f as (select 'orders::' || o_orderkey as id, 'orders/' || (o_custkey % 10) || '.ts' as file, o_orderkey * 10 + 1 as a, o_orderkey * 10 + 9 as b from orders)
select distinct f.id as source_id, target_id, 'calls' as kind from refs r join f on f.file = r.file and r.line between f.a and f.b where f.id <> target_id"""
)
def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = star_graph(spark, sf_dir).nodes.withColumn("ord", F.col("line_start"))
    return references.reference_edges(references.located(_ref_dump(spark, sf_dir), "file:///app"), functions)


def _uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    n, at = F.col("k").cast("string"), F.col("k") % 9
    uri = (
        F.when(at == 0, F.concat(F.lit("file:///app/node_modules/pkg"), n, F.lit("/index.js")))
        .when(at == 1, F.concat(F.lit("file:///app/node_modules/%40scope"), n, F.lit("/lib/a.js")))
        .when(at == 2, F.concat(F.lit("file:///app/node_modules/@types/t"), n, F.lit("/index.d.ts")))
        .when(at == 3, F.concat(F.lit("file:///go/pkg/mod/github.com/u/m"), n, F.lit("@v1.2.3/x.go")))
        .when(at == 4, F.concat(F.lit("file:///usr/go/src/net/p"), n, F.lit("/s.go")))
        .when(at == 5, F.concat(F.lit("file:///app/src/f"), n, F.lit(".ts")))
        .when(at == 6, F.concat(F.lit("file:///other/f+"), n, F.lit(".ts")))
        .when(at == 7, F.concat(F.lit("file:///app/x/typeshed/s"), n, F.lit(".pyi")))
        .otherwise(F.concat(F.lit("file:///app/node_modules/a+b%20c/node_modules/deep"), n, F.lit("/i.js")))
    )
    return p.select("k", uri.alias("uri"))


_EXTERNAL = "k % 9 not in (5, 7)"


@query(f"select p_partkey as k, {_EXTERNAL.replace('k ', 'p_partkey ')} as external, p_partkey % 9 in (1, 2, 7) and p_partkey % 9 <> 1 as declares from part")
def classify_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.col("uri")
    return _uris(spark, sf_dir).select("k", calls.is_external(uri, "file:///app").alias("external"), calls.is_type_declaration(uri).alias("declares"))


@query(
    """select p_partkey as k, case p_partkey % 9 when 0 then 'pkg' || p_partkey when 1 then '@scope' || p_partkey || '/lib' when 2 then '@types/t' || p_partkey when 8 then 'a+b c' end as package from part"""
)
def package_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uris(spark, sf_dir).select("k", calls.package_name(F.col("uri")).alias("package"))


@query("select p_partkey as k, case p_partkey % 9 when 3 then 'github.com/u/m' || p_partkey when 4 then 'net/p' || p_partkey end as module from part")
def go_module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uris(spark, sf_dir).select("k", calls.go_module_name(F.col("uri")).alias("module"))


def _call_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    uris = _uris(spark, sf_dir)
    go = F.col("k") % 9 == 3
    one = F.concat(F.lit('{"to":{"name":"f'), F.col("k").cast("string"), F.lit('","kind":12,"uri":"'), F.col("uri"), F.lit('"}}'))
    return uris.select(
        F.concat(F.lit("src::"), F.col("k").cast("string")).alias("source_id"),
        F.when(F.col("k") % 10 == 9, "class").otherwise("function").alias("kind"),
        F.when(go, "go").otherwise("typescript").alias("language"),
        F.concat(F.lit("["), one, F.lit("]")).alias("calls"),
    )


@query("select 'src::' || p_partkey as source_id, case p_partkey % 9 when 5 then 'src/f' || p_partkey || '.ts' else 'x/typeshed/s' || p_partkey || '.pyi' end || '::f' || p_partkey as target_id, 'calls' as kind from part where p_partkey % 9 in (5, 7) and p_partkey % 10 <> 9")
def outgoing_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.call_edges(calls.outgoing_calls(_call_dump(spark, sf_dir)), "file:///app")


@query(
    """select 'src::' || p_partkey as node_id, 'f' || p_partkey as symbol, case p_partkey % 9 when 0 then 'pkg' || p_partkey when 1 then '@scope' || p_partkey || '/lib'
when 3 then 'github.com/u/m' || p_partkey when 8 then 'a+b c' end as package from part where p_partkey % 9 in (0, 1, 3, 8) and p_partkey % 10 <> 9"""
)
def outgoing_external_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.external_calls(calls.outgoing_calls(_call_dump(spark, sf_dir)), "file:///app")


def _symbol_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree for each supplier: its lines and names depend on the key, and every third one has no inner function."""
    k = F.col("s_suppkey")
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("k"))
    line = lambda at: (F.col("k") + at).cast("string")

    def symbol(name: F.Column, kind: int, first: int, last: int, children: F.Column | None = None) -> F.Column:
        parts = [F.lit('{"name":"'), name, F.lit(f'","kind":{kind},"range":{{"start":{{"line":'), line(first), F.lit(',"character":0},"end":{"line":'), line(last)]
        parts += [F.lit(',"character":1}},"selectionRange":{"start":{"line":'), line(first), F.lit(',"character":4},"end":{"line":'), line(first), F.lit(',"character":9}}')]
        return F.concat(*parts, *([F.lit(',"children":['), children, F.lit("]")] if children is not None else []), F.lit("}"))

    own = F.concat(F.lit("C"), F.col("k").cast("string"))
    inner = F.when(F.col("k") % 3 == 0, "").otherwise(symbol(F.lit("inner"), 12, 4, 5))
    body = F.concat_ws(",", symbol(F.lit("m"), 6, 1, 2), symbol(F.lit("v"), 13, 3, 6, inner))
    more = symbol(F.lit("init"), 12, 10, 11), symbol(F.lit("init"), 12, 12, 13), symbol(F.lit("T"), 11, 14, 15)
    tree = F.concat(F.lit("["), F.concat_ws(",", symbol(own, 5, 0, 9, body), *more), F.lit("]"))
    go = F.col("k") % 2 == 0
    folder = F.when(F.col("k") % 5 == 0, "tests/").otherwise("d/")
    file = F.concat(folder, F.col("k").cast("string"), F.when(go, "_test.go").otherwise(".py"))
    return n.select(file.alias("file"), F.when(go, "go").otherwise("python").alias("language"), tree.alias("symbols"))


_FLAT = """with f as (select s_suppkey as k, case when s_suppkey % 5 = 0 then 'tests/' else 'd/' end || s_suppkey || case when s_suppkey % 2 = 0 then '_test.go' else '.py' end as file from supplier),
v as (select k, file, case when q like 'C%' then 'C' || k || substr(q, 2) else q end as q, kind, case when name = 'C' then 'C' || k else name end as name, a, b, case when k % 3 = 0 and o > 2 then o - 1 else o end as o
  from f, (values ('C', 'class', 'C', 0, 9, 0), ('C.m', 'method', 'm', 1, 2, 1), ('C.inner', 'function', 'inner', 4, 5, 2), ('init', 'function', 'init', 10, 11, 3), ('init$2', 'function', 'init', 12, 13, 4), ('T', 'type', 'T', 14, 15, 5)) as v(q, kind, name, a, b, o)
  where k % 3 <> 0 or q <> 'C.inner')"""


@query(
    f"{_FLAT} select file || '::' || q as id, kind, name, file, k + a + 1 as line_start, k + b + 1 as line_end, file like 'tests/%.py' or k % 2 = 0 as is_test, o as ord, k + a as select_line, 4 as select_character from v"
)
def flatten_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("id", "kind", "name", "file", "line_start", "line_end", "is_test", "ord", "select_line", "select_character")
    return symbols.symbol_nodes(_symbol_dump(spark, sf_dir), ("tests",)).select(*columns)


@query(
    """select p_partkey, case when n > 1 then base || '$' || n else base end as id
from (select p_partkey, p_brand || '.' || p_name as base, row_number() over (partition by p_brand || '.' || p_name order by p_partkey) as n from part)"""
)
def dedup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat_ws(".", "p_brand", "p_name").alias("base"))
    return symbols.deduplicated(parts, "base", "p_partkey").select("p_partkey", "id")


@query(
    """with n as (select distinct p_name as b, p_type as t from part), l as (select t, lag(b) over (partition by t order by b) as a, b from n)
select t, a, b, levenshtein(a, b) as distance from l where a is not null"""
)
def edit_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each name to the one before it among the parts of its type."""
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("t"), F.col("p_name").alias("b")).distinct()
    pairs = names.withColumn("a", F.lag("b").over(Window.partitionBy("t").orderBy("b"))).filter("a IS NOT NULL")
    return pairs.select("t", "a", "b", edit_distance(F.col("a"), F.col("b")).alias("distance"))


@query("select c_custkey, trim(c_mktsegment) as trimmed, rpad(c_mktsegment, 20, ' ') as padded from customer")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", trimmed(F.concat(F.lit(" \t\n"), "c_mktsegment", F.lit("  \r\n"))).alias("trimmed"), padded(F.col("c_mktsegment"), 20).alias("padded"))


# --- changes ---


@query("select 'part::' || p_partkey as id, p_name || case when p_partkey % 7 = 0 then '+2' else '' end as name from part")
def upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    old = p.select(F.concat(F.lit("part::"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"))
    again = p.filter("p_partkey % 7 = 0").select(F.concat(F.lit("part::"), F.col("p_partkey").cast("string")).alias("id"), "p_name")
    new = again.select("id", F.concat("p_name", F.lit("+1")).alias("name"), F.lit(1).alias("seq")).union(again.select("id", F.concat("p_name", F.lit("+2")), F.lit(2)))
    return store.upserted(old, new, ["id"], "seq")


@query("select distinct 'orders::' || l_orderkey as source_id, 'part::' || l_partkey as target_id, 'calls' as kind from lineitem")
def insert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    edge = lines.select(
        F.concat(F.lit("orders::"), F.col("l_orderkey").cast("string")).alias("source_id"), F.concat(F.lit("part::"), F.col("l_partkey").cast("string")).alias("target_id"), F.lit("calls").alias("kind")
    )
    return store.inserted(edge.filter(lines["l_linenumber"] == 1).distinct(), edge, ["source_id", "target_id", "kind"])


@on_graph(
    over_graph(
        """select 'nodes' as tab, id as a, file as b, kind as c from nodes where file <> 'orders/3.ts'
union all select 'edges', source_id, target_id, kind from edges where source_id not in (select id from gone) and target_id not in (select id from gone)
union all select 'tags', node_id, kind, value from tags where node_id not in (select id from gone)
union all select 'external_calls', node_id, package, symbol from external_calls where node_id not in (select id from gone)""",
        "gone as (select id from nodes where file = 'orders/3.ts')",
    )
)
def delete_file_data(g: Graph) -> DataFrame:
    return table_rows(store.without_file(g, "orders/3.ts"))


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each order, modified on the order's day, some at an unknown time."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    modified = F.when(F.col("o_orderkey") % 17 != 0, F.unix_millis(F.to_timestamp("o_orderdate")))
    return o.select(F.concat(F.lit("src/"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".ts").otherwise(".py")).alias("file"), modified.alias("modified"))


_BUILT = 883_612_800_000  # 1998-01-01
_CHANGED = f"select *, o_orderkey % 17 = 0 or epoch_ms(cast(o_orderdate as timestamp)) > {_BUILT} as changed from orders"


@query(f"select 'src/' || o_orderkey || case when o_orderkey % 2 = 0 then '.ts' else '.py' end as file from ({_CHANGED}) where changed")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.changed_since(_listing(spark, sf_dir), _BUILT).select("file")


@query(f"select count(*) filter (changed) as changed, count(*) as total, count(*) filter (changed) * 10 > count(*) * 3 as whole from ({_CHANGED})")
def changed_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.changed_share(_listing(spark, sf_dir), _BUILT)


@query("select p_partkey, p_name, contains(p_name, 'lace') or contains(p_name, 'oe') as excluded from part")
def excluded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", "p_name", files.is_excluded(F.col("p_name"), ("lace", "oe")).alias("excluded"))


@query("select count(*) > 0 as python, false as typescript from customer where c_custkey % 4 = 1")
def detect_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python files in the open; TypeScript only where it doesn't count."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("k"), (F.col("c_custkey") % 4).alias("at"))
    file = F.when(F.col("at") == 0, F.concat(F.lit("node_modules/"), "k", F.lit(".ts"))).when(F.col("at") == 1, F.concat(F.lit("src/"), "k", F.lit(".py")))
    file = file.when(F.col("at") == 2, F.concat(F.lit("src/"), "k", F.lit(".test.tsx"))).otherwise(F.concat(F.lit("doc/"), "k", F.lit(".md")))
    return files.language_flags(c.select(file.alias("file")))


@query(
    """select doc_id, greatest(1, 3 - ups) || '-' || len(lines) as span, array_to_string(list_slice(lines, greatest(1, 3 - ups), len(lines)), chr(10)) as code from (
select doc_id, lines, case when not regexp_matches(trim(lines[2]), '^(#|//|@|/\\*)') then 0 when not regexp_matches(trim(lines[1]), '^(#|//|@|/\\*)') then 1 else 2 end as ups
from (select doc_id, string_split(case doc_id % 3 when 0 then '# a' when 1 then 'x' else '  @b' end || chr(10) || case doc_id % 2 when 0 then '// c' else '' end || chr(10) || 'def f():' || chr(10) || coalesce(text, ''), chr(10)) as lines from documents))"""
)
def code_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    k = F.col("doc_id")
    head = F.when(k % 3 == 0, "# a").when(k % 3 == 1, "x").otherwise("  @b")
    text = F.concat(head, F.lit("\n"), F.when(k % 2 == 0, "// c").otherwise(""), F.lit("\ndef f():\n"), "body")
    rows = d.select("doc_id", text.alias("text"), F.lit(3).alias("line_start"), (F.size(F.split("body", "\n", -1)) + 3).alias("line_end"))
    return reports.code_slices(rows).select("doc_id", F.concat_ws("-", F.col("first").cast("string"), F.col("line_end").cast("string")).alias("span"), "code")


@on_graph(over_graph("select id, first_value(id) over (partition by file order by line_start, id) as first_id from nodes"))
def first_of_file(g: Graph) -> DataFrame:
    order = Window.partitionBy("file").orderBy("line_start", "id")
    return g.nodes.select("id", F.first("id").over(order).alias("first_id"))
