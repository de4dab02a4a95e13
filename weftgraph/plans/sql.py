"""DuckDB SQL over the star tables: the graph of sources/star.py, written independently of it."""

from __future__ import annotations

GRAPH = """
nodes as (
  select 'region::' || r_regionkey as id, 'module' as kind, r_name as name, 'region.sql' as file,
    cast(r_regionkey * 10 + 1 as int) as line_start, cast(r_regionkey * 10 + 9 as int) as line_end, 'sql' as language, false as is_test from region
  union all select 'nation::' || n_nationkey, 'class', n_name, 'nation.sql', cast(n_nationkey * 10 + 1 as int), cast(n_nationkey * 10 + 9 as int), 'sql', false from nation
  union all select 'customer::' || c_custkey, 'function', c_name, 'customer/' || c_nationkey || '.py', cast(c_custkey * 10 + 1 as int), cast(c_custkey * 10 + 9 as int), 'python', false from customer
  union all select 'orders::' || o_orderkey, 'function', 'order_' || o_orderkey, 'orders/' || (o_custkey % 10) || '.ts', cast(o_orderkey * 10 + 1 as int), cast(o_orderkey * 10 + 9 as int), 'typescript', o_orderstatus = 'P' from orders
  union all select 'part::' || p_partkey, 'method', p_name, 'part/' || p_brand || '.go', cast(p_partkey * 10 + 1 as int), cast(p_partkey * 10 + 9 as int), 'go', false from part
  union all select 'supplier::' || s_suppkey, 'function', s_name, 'supplier/' || s_nationkey || '.go', cast(s_suppkey * 10 + 1 as int), cast(s_suppkey * 10 + 9 as int), 'go', false from supplier
),
tags as (
  select 'customer::' || c_custkey as node_id, 'flow' as kind, lower(c_mktsegment) as value from customer where c_custkey % 50 = 0
  union all select 'customer::1', 'flow', 'buildng' from customer where c_custkey = 1
  union all select 'nation::0', 'flow', 'building' from nation where n_nationkey = 0
  union all select 'supplier::' || s_suppkey, 'boundary', 'nation-' || s_nationkey from supplier where s_suppkey % 2 = 0
  union all select 'part::' || p_partkey, 'emits', 'part.' || lower(p_type) from part where p_partkey % 100 = 0
  union all select 'supplier::' || s_suppkey, 'handles', 'part.' || (['economy', 'promo', 'small', 'large', 'legacy'])[cast(s_suppkey % 10 + 1 as int)] from supplier where s_suppkey % 10 < 5
),
event_edges as (select distinct e.node_id as source_id, h.node_id as target_id, 'event' as kind from tags e join tags h on e.value = h.value where e.kind = 'emits' and h.kind = 'handles'),
edges as (
  select 'customer::' || o_custkey as source_id, 'orders::' || o_orderkey as target_id, 'calls' as kind from orders
  union select 'orders::' || l_orderkey, 'part::' || l_partkey, 'calls' from lineitem
  union select 'part::' || l_partkey, 'supplier::' || l_suppkey, 'calls' from lineitem
  union select 'supplier::' || s_suppkey, 'nation::' || s_nationkey, 'contains' from supplier
  union select 'nation::' || n_nationkey, 'region::' || n_regionkey, 'imports' from nation
  {cycle}
  union select source_id, target_id, kind from event_edges
),
external_calls as (
  select distinct 'supplier::' || s_suppkey as node_id, event_type as package, event_type || '.call' as symbol
  from supplier join events on user_id = s_suppkey where s_suppkey % 3 = 0
),
followed as (select source_id, target_id from edges where kind in ('calls', 'event')),
steps as (select distinct source_id, target_id from followed)
"""

CYCLE = "union select 'supplier::' || s_suppkey, 'customer::' || s_suppkey, 'calls' from supplier where s_suppkey % 25 = 0"
NODE = "n.id, n.kind, n.name, n.file, n.line_start, n.line_end, n.language, n.is_test"


def over_graph(query: str, *parts: str, cyclic: bool = False) -> str:
    """A query over the graph's tables and further common table expressions."""
    return "with recursive " + ",\n".join([GRAPH.format(cycle=CYCLE if cyclic else ""), *parts]) + "\n" + query


MEMBERSHIP = """membership as (
  select value as flow, node_id as id from tags where kind = 'flow'
  union select m.flow, s.target_id from membership m join steps s on s.source_id = m.id
)"""


def upstream(node: str) -> str:
    return f"""upstream as (
  select source_id as id from steps where target_id = '{node}'
  union select s.source_id from upstream u join steps s on s.target_id = u.id
)"""


def paths(pairs: str) -> str:
    return f"""pairs as ({pairs}),
toward as (
  select dst, dst as id from pairs
  union select t.dst, s.source_id from toward t join steps s on s.target_id = t.id
),
walks as (
  select src, dst, [src] as path, src as head from pairs
  union all
  select w.src, w.dst, list_append(w.path, f.target_id), f.target_id
  from walks w join followed f on f.source_id = w.head join toward t on t.dst = w.dst and t.id = f.target_id
  where w.head <> w.dst and not list_contains(w.path, f.target_id)
)"""
