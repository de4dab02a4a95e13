"""Operators on the golden graph, and closures on random graphs against DuckDB."""

import random
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.golden import CHARGE, CREATE, EMIT, HANDLE, SAVE, SEND, SUBMIT, TEST, graph_of, node, shop
from weftgraph.graph import Graph
from weftgraph.operators import closure, lint, paths, relational
from weftgraph.operators.relational import SymbolError
from weftgraph.plans import lines, reports
from weftgraph.schema import TABLES
from weftgraph.sources.store import without_file

MARKER = "@weft:"


def ids(rows):
    return sorted(r["id"] for r in rows.select("id").collect())


@pytest.fixture(scope="module")
def g(spark):
    return shop(spark)


def test_closures(g):
    assert ids(closure.flow_members(g, "checkout")) == sorted([HANDLE, CREATE, CHARGE, SAVE, EMIT, SEND, SUBMIT])
    assert ids(closure.flow_members(g, "nothing")) == []
    assert ids(closure.impact(g, CHARGE)) == sorted([CREATE, HANDLE, TEST])
    assert [r["flow"] for r in closure.flows_for_node(g, CHARGE).collect()] == ["checkout"]
    assert closure.flows_for_node(g, TEST).count() == 0


def test_lookups(g):
    assert ids(relational.callers(g, CHARGE)) == sorted([CREATE, TEST])
    assert ids(relational.callees(g, CREATE)) == sorted([CHARGE, SAVE, EMIT])
    assert [relational.flows(g).count(), relational.boundaries(g).count(), relational.events(g).count()] == [2, 2, 1]
    assert relational.resolve_one(g, "charge")["id"] == CHARGE
    assert relational.resolve_one(g, CHARGE)["id"] == CHARGE
    with pytest.raises(SymbolError, match="Unknown symbol: x"):
        relational.resolve_one(g, "x")


def test_ambiguous_and_exact(spark):
    g = graph_of(spark, [node("a.py::f"), node("b.py::f"), node("c.py::g")])
    with pytest.raises(SymbolError) as bad:
        relational.resolve_one(g, "f")
    assert bad.value.matches == ("a.py::f", "b.py::f")
    assert ids(relational.resolve_symbol(g, "a.py::f")) == ["a.py::f"]


def test_parallel_edges_are_a_bag(spark):
    g = shop(spark, [(EMIT, SEND, "calls")])
    assert ids(relational.callers(g, SEND)) == [EMIT, EMIT]
    assert paths.find_all_paths(g, EMIT, SEND).count() == 2


def test_paths(g):
    path = lambda a, b: [list(r["path"]) for r in paths.find_all_paths(g, a, b).collect()]
    assert path(HANDLE, CHARGE) == [[HANDLE, CREATE, CHARGE]]
    assert path(HANDLE, SEND) == [[HANDLE, CREATE, EMIT, SEND]]
    assert path(CHARGE, CHARGE) == [[CHARGE]]
    assert path(CHARGE, HANDLE) == []


def test_cycle(spark):
    g = shop(spark, [(CHARGE, HANDLE, "calls")])
    assert CHARGE in ids(closure.impact(g, CHARGE))
    assert paths.find_all_paths(g, HANDLE, CHARGE).count() == 1
    assert [r["id"] for r in paths.flow_tree(g, "checkout").filter(f"entry = '{HANDLE}'").orderBy("ord").collect()] == [HANDLE, CREATE, SAVE, CHARGE, EMIT, SEND]


def test_tree(g):
    rows = paths.flow_tree(g, "checkout").orderBy("entry", "ord").collect()
    assert [(r["depth"], r["id"], r["boundary"], r["emits"]) for r in rows if r["entry"] == HANDLE] == [
        (0, HANDLE, None, None),
        (1, CREATE, None, None),
        (2, SAVE, "postgres", None),
        (2, CHARGE, "stripe", None),
        (2, EMIT, None, "order.created"),
        (3, SEND, None, None),
    ]
    assert [r["id"] for r in rows if r["entry"] == SUBMIT] == [SUBMIT]


def test_trace_and_reports(g):
    assert [list(r["path"]) for r in paths.trace(g, "checkout", "stripe").collect()] == [[HANDLE, CREATE, CHARGE]]
    got = sorted(tuple(r) for r in reports.impact_rows(g, CHARGE).collect())
    assert got == sorted([("direct", CREATE), ("direct", TEST), ("transitive", HANDLE), ("flow", "checkout"), ("test", TEST)])


def test_empty_graph(spark):
    g = Graph.empty(spark)
    assert closure.flow_members(g, "x").count() == 0 and closure.flow_membership(g).count() == 0 and closure.impact(g, "x").count() == 0
    assert paths.flow_tree(g).count() == 0 and paths.find_all_paths(g, "a", "b").count() == 0
    assert lint.lint(g, MARKER).count() == 0
    assert tuple(relational.coverage(g).first()) == (0, 0, 0)


def test_synthesis_is_idempotent_and_keeps_self_edges(spark):
    g = graph_of(spark, [node("a.py::f")], [("a.py::f", "a.py::g", "calls"), ("x", "y", "event")], [("a.py::f", "emits", "e"), ("a.py::f", "handles", "e")])
    once = relational.synthesize_event_edges(g)
    want = [("a.py::f", "a.py::f", "event"), ("a.py::f", "a.py::g", "calls")]
    assert sorted(map(tuple, once.edges.collect())) == want
    assert sorted(map(tuple, relational.synthesize_event_edges(once).edges.collect())) == want


@pytest.mark.parametrize("seed", range(3))
def test_random_closures(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    nodes = [node(f"f.py::{n}") for n in names[:11]]  # the last three dangle
    full = [f"f.py::{n}" for n in names]
    edges = {(rng.choice(full), rng.choice(full), rng.choice(["calls", "event", "imports"])) for _ in range(22)}
    tags = {(rng.choice(full[:11]), "flow", rng.choice("abc")) for _ in range(5)}
    g = graph_of(spark, nodes, edges, tags)
    con = duckdb.connect()
    con.execute("create table e (s text, t text, k text)")
    con.executemany("insert into e values (?, ?, ?)", sorted(edges))
    con.execute("create table tag (n text, k text, v text)")
    con.executemany("insert into tag values (?, ?, ?)", sorted(tags))
    want = con.execute("with recursive m as (select v, n from tag union select m.v, e.t from m join e on e.s = m.n where e.k <> 'imports') select * from m").fetchall()
    assert sorted(map(tuple, closure.flow_membership(g).collect())) == sorted(want)
    target = full[rng.randrange(14)]
    want = con.execute(f"with recursive u as (select s from e where t = '{target}' and k <> 'imports' union select e.s from u join e on e.t = u.s where e.k <> 'imports') select * from u").fetchall()
    assert sorted(map(tuple, closure.impact_ids(g, target).collect())) == sorted(want)


def hubbed(spark, seed):
    """A random graph with hubs, cycles, events of several values between the same nodes, and the same graph with its pairs listed."""
    rng = random.Random(seed)
    full = [f"f{rng.randrange(3)}.py::n{i}" for i in range(9)]
    edges = {(rng.choice(full), rng.choice(full), "calls") for _ in range(9)}
    tags = {(rng.choice(full), rng.choice(["emits", "handles"]), rng.choice("uv")) for _ in range(8)} | {(rng.choice(full), "flow", rng.choice("ab")) for _ in range(3)}
    g = relational.synthesize_event_edges(graph_of(spark, [node(i, (rng.randrange(4), 9)) for i in full[:8]], edges, tags))
    return g, g.with_tables(edges=g.edges), full, tags


@pytest.mark.parametrize("seed", range(2))
def test_hubs_and_listed_pairs_have_the_same_closures_paths_and_trees(spark, seed):
    g, pairs, full, tags = hubbed(spark, seed)
    assert g.hubs is not None and pairs.hubs is None
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(closure.flow_membership(g)) == rows(closure.flow_membership(pairs))
    assert rows(closure.impact_ids(g, full[0])) == rows(closure.impact_ids(pairs, full[0]))
    wanted = spark.createDataFrame([(a, b) for a in full[:3] for b in full[3:7]], "src string, dst string")
    assert rows(paths.simple_paths(g, wanted)) == rows(paths.simple_paths(pairs, wanted))
    want = walked(g, tags)
    for graph, limit in ((g, paths.WALKED), (pairs, paths.WALKED), (g, 0)):
        got = paths.flow_tree(graph, walked=limit).select("flow", "entry", "ord", "depth", "id", "parent_id")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str), limit


def walked(g, tags):
    """Flow trees by the definition."""
    place = {r["id"]: (r["file"], r["line_start"], r["id"]) for r in g.nodes.collect()}
    calls = {}
    for r in g.edges.collect():
        if r["target_id"] in place:
            calls.setdefault(r["source_id"], set()).add(r["target_id"])
    out = []

    def visit(flow, entry, i, depth, parent, seen):
        seen.append(i)
        out.append((flow, entry, len(seen) - 1, depth, i, parent))
        for target in sorted(calls.get(i, ()), key=place.get):
            if target not in seen:
                visit(flow, entry, target, depth + 1, i, seen)

    for entry, kind, flow in tags:
        if kind == "flow" and entry in place:
            visit(flow, entry, entry, 0, None, [])
    return out


def test_more_labels_than_bits(spark):
    """130 flows, of which three words of bits are needed, along a chain and a cycle."""
    full = [f"a.py::n{i}" for i in range(130)]
    edges = [(a, b, "calls") for a, b in zip(full, full[1:], strict=False)] + [(full[129], full[120], "calls")]
    g = graph_of(spark, [node(i) for i in full], edges[100:], [(i, "flow", i) for i in full])
    want = {(a, a) for a in full} | {(full[i], full[j]) for i in range(100, 130) for j in range(min(i, 120) if i > 120 else i, 130)}
    assert set(map(tuple, closure.flow_membership(g).collect())) == want


def test_rounds_of_closures_shuffle_no_edges(spark, g):
    """Neither where frontiers are too large to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for steps, here in ((g.steps_on, "source_id"), (g.steps_back, "target_id")):
            fresh = spark.range(9).select(F.col("id").cast("string").alias("id"))
            plan = steps.join(fresh, steps[here] == fresh["id"])._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning(id") == 1 and plan.count("Exchange") == 1, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_are_numbered_without_gaps(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert [r["_number"] for r in closure.numbered(rows, "k").orderBy("k").collect()] == list(range(1000))
    assert closure.numbered(rows.limit(0), "k").count() == 0


def test_only(spark, g):
    assert [r["id"] for r in relational.only(g, "charge").collect()] == [CHARGE]
    assert relational.only(g, "nobody").count() == 0
    twice = g.with_tables(nodes=g.nodes.unionByName(graph_of(spark, [node("b.py::charge")]).nodes))
    with pytest.raises(Exception, match="Ambiguous symbol: charge"):
        relational.only(twice, "charge").collect()


# --- lint ---


def issues(g):
    return {(r["rule"], r["symbol"]): r for r in lint.lint(g, MARKER).collect()}


def test_lint_clean(spark):
    g = shop(spark, external=[(CHARGE, "stripe", "c"), (SAVE, "pg", "q")])
    assert {k for k in issues(g)} == {(7, "ts_submit")}


def test_lint_tags(spark):
    g = graph_of(
        spark,
        [node("a.py::C", kind="class"), *[node(f"a.py::f{i}") for i in range(6)]],
        [],
        [("a.py::C", "flow", "checkout"), ("a.py::f0", "flow", "checkout"), ("a.py::f1", "flow", "chekout"), ("a.py::f2", "emits", "gone"), ("a.py::f3", "handles", "nobody"),
         ("a.py::f4", "boundary", "ab"), ("a.py::f5", "boundary", "ac"), ("a.py::f0", "boundary", "ac")],
    )
    found = issues(g)
    assert found[(1, "C")]["severity"] == "error"
    assert found[(2, "f1")]["message"] == '@weft:flow "chekout" — did you mean "checkout"? (used 2 times elsewhere)'
    assert (3, "f2") in found and (4, "f3") in found
    assert not any(rule == 5 for rule, _ in found)  # no external call anywhere
    assert not any(rule == 2 and s != "f1" for rule, s in found)  # short names are no typos


def test_lint_boundaries(spark):
    nodes = [node(f"a.py::f{i}") for i in range(4)]
    g = graph_of(spark, nodes, [], [("a.py::f0", "boundary", "stripe"), ("a.py::f1", "boundary", "pg")], [("a.py::f1", "p", "s"), ("a.py::f2", "q", "s"), ("a.py::f2", "q", "t"), ("a.py::f2", "r", "t")])
    found = lint.lint(g, MARKER).collect()
    assert [(r["rule"], r["symbol"]) for r in found if r["rule"] == 5] == [(5, "f0")]
    assert sorted(r["message"] for r in found if r["rule"] == 6) == [f"Function calls external package '{p}' but has no @weft:boundary tag" for p in "qr"]


def test_lint_disconnected(spark):
    nodes = [node(f"a.py::f{i}") for i in range(3)] + [node("t.py::t", is_test=True)]
    calls = [(f"a.py::f{i}", f"x{k}", "calls") for i, n in ((0, 3), (1, 2)) for k in range(n)] + [("t.py::t", f"x{k}", "calls") for k in range(4)]
    found = lint.disconnected(graph_of(spark, nodes, calls), MARKER).collect()
    assert [(r["symbol"], r["severity"]) for r in found] == [("f0", "info")]


def test_coverage(spark):
    g = graph_of(spark, [node("a.py::f"), node("a.py::g")], [], [("a.py::f", "flow", "x")])
    assert tuple(relational.coverage(g).first()) == (1, 2, 50)


def test_typo_candidates_lose_no_pair(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab-") for _ in range(rng.randint(4, 9))) for _ in range(120)})
    values, known = words[::2], words[1::2]
    rows = lambda items, name: spark.createDataFrame([("flow", w) for w in items], f"kind string, {name} string")
    met = lint.close_values(rows(values, "value"), rows(known, "suggestion").withColumn("used", F.lit(2)))
    got = {(r["value"], r["suggestion"]) for r in met.collect()}
    want = {(a, b) for a in values for b in known if distance(a, b) <= 2}
    assert want <= got and len(got) < len(values) * len(known)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_pairs_of_ends_that_share_several_hubs_are_made_once_and_counted_without_being_made(spark, monkeypatch):
    from weftgraph import graph as graph_module

    monkeypatch.setattr(graph_module, "CELL", 3)
    tags = [(f"e{i}", "emits", v) for i in range(20) for v in "abcd"[: 1 + i % 4]] + [(f"h{i}", "handles", v) for i in range(17) for v in "dcba"[: 1 + i % 4]]
    tags += [("e0", "emits", "alone"), ("h1", "handles", "unheard"), ("e3", "handles", "a")]
    calls = [("e1", "x", "calls"), ("e1", "y", "calls"), ("z", "x", "calls"), ("z", "x", "imports")]
    empty = Graph.empty(spark)
    g = empty.with_tables(tags=spark.createDataFrame(tags, TABLES["tags"]), edges=spark.createDataFrame(calls, TABLES["edges"])).with_hubs()
    want = {(a, b) for a, k, v in tags if k == "emits" for b, kind, w in tags if kind == "handles" and v == w}
    got = [tuple(r)[:2] for r in g.edges.filter("kind = 'event'").collect()]
    assert sorted(got) == sorted(want)
    counts = Counter(a for a, _ in want) + Counter({"e1": 2, "z": 1})
    assert {r["id"]: r["callees"] for r in g.callees().collect()} == dict(counts)
    assert g.size().first()["edges"] == len(want) + len(calls)
    assert "Generate" not in g.size()._jdf.queryExecution().optimizedPlan().toString().replace("Generate explode(hubs", "")


def test_a_file_without_its_data_keeps_hubs(spark):
    rows = [(f"{f}::{i}", "function", str(i), f, 1, 2, "python", None, False, None) for f in "ab" for i in range(3)]
    tags = [(r[0], k, "v") for r in rows for k in ("emits", "handles")]
    g = Graph.empty(spark).with_tables(nodes=spark.createDataFrame(rows, TABLES["nodes"]), tags=spark.createDataFrame(tags, TABLES["tags"])).with_hubs()
    left = without_file(g, "a")
    assert left.hubs is not None and left.hubs.count() == 6
    assert sorted((r["source_id"], r["target_id"]) for r in left.edges.collect()) == [(f"b::{i}", f"b::{j}") for i in range(3) for j in range(3)]


def test_trace_walks_once_for_all_nodes_of_a_boundary(spark, monkeypatch):
    """On a graph with cycles, hubs, an entry that is a boundary itself, and boundaries beyond boundaries."""
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("f", "b"), ("c", "x")]
    rows = [(i, "function", i, "f", 1, 2, "python", None, False, None) for i in "abcdefx"]
    tags = [("a", "flow", "w"), ("d", "flow", "w"), ("d", "boundary", "s"), ("f", "boundary", "s"), ("c", "emits", "v"), ("e", "handles", "v"), ("x", "boundary", "one")]
    g = Graph.empty(spark).with_tables(
        nodes=spark.createDataFrame(rows, TABLES["nodes"]), tags=spark.createDataFrame(tags, TABLES["tags"]), edges=spark.createDataFrame([(*e, "calls") for e in edges], TABLES["edges"])
    ).with_hubs()
    want = {}
    for boundary, ends in (("s", "df"), ("one", "x")):
        pairs = spark.createDataFrame([(a, b) for a in "ad" for b in ends], "src string, dst string")
        want[boundary] = sorted((r["src"], r["dst"], r["path"]) for r in paths.simple_paths(g, pairs).collect())
    monkeypatch.setattr(paths, "_toward", None)  # a row for each end and each id that leads to it
    for boundary, rows in want.items():
        assert rows and sorted((r["src"], r["dst"], r["path"]) for r in paths.trace(g, "w", boundary).collect()) == rows


def test_dead_ends_read_each_table_of_edges_once(spark):
    from weftgraph.sources.star import star_graph

    rows = lint.dead_end_flows(star_graph(spark, "/root/testdata/sf0.001"), MARKER)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") <= 2  # calls of orders, and of parts
    assert plan.count("Relation [o_orderkey") <= 2  # nodes and calls


@pytest.mark.parametrize(("back", "limit", "made"), [(True, paths.WALKED, [2 * 144]), (False, 9, [0, 0, 70 * 5])])
def test_entries_that_reach_the_same_edges_walk_one_copy_of_them(spark, monkeypatch, back, limit, made):
    """70 entries, each with all 70 in reach if there are calls back: a copy an entry would be of 4,900 edges and more. Groups that are too large are divided."""
    full = [f"a.py::n{i}" for i in range(70)]
    edges = [(i, "a.py::x", "calls") for i in full] + [("a.py::x", "a.py::y", "calls"), ("a.py::x", "b.py::z", "calls")] + [("b.py::z", i, "calls") for i in full if back]
    tags = [(i, "flow", "w") for i in full] + [("a.py::y", "emits", "v"), ("b.py::z", "handles", "v")]
    g = relational.synthesize_event_edges(graph_of(spark, [node(i) for i in [*full, "a.py::x", "a.py::y", "b.py::z"]], edges, tags))
    got, subgraphs = [], paths._subgraphs
    monkeypatch.setattr(paths, "_subgraphs", lambda *a: got.append(subgraphs(*a)) or got[-1])
    default = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")  # 70 entries are enough for groups of 64
        tree = paths.flow_tree(g, walked=limit).select("flow", "entry", "ord", "depth", "id", "parent_id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", default)
    assert sorted(map(tuple, tree.collect()), key=str) == sorted(walked(g, [t for t in tags if t[1] == "flow"]), key=str)
    assert [rows.count() for rows in got] == made


def test_large_frontiers_are_hashed_and_edges_not_sorted(spark, g, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        steps = g.steps_on
        plan = lambda n: steps.join(closure._hashed(spark.range(9).select(F.col("id").cast("string").alias("id")), n), steps["source_id"] == F.col("id"))._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan(60_000) and "Sort " not in plan(60_000)
        assert "SortMergeJoin" in plan(10**9)  # too many to be held by tasks
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(closure, "HASHED", (1, 100))
    test_closures(g)
    assert closure.flow_membership(g).count() == 7


@pytest.mark.parametrize(("laid", "in_rounds"), [(paths.LAID, 0), (30, 1), (0, 2)])
def test_trees_whose_edges_no_task_holds_take_no_rounds(spark, monkeypatch, laid, in_rounds):
    """A chain of 24 with calls back and an event, as deep as it is long, and two small trees. What reaches too many nodes is ordered in rounds; y leads to no edge."""
    full = [f"a.py::n{i:02}" for i in range(24)]
    edges = [(a, b, "calls") for a, b in zip(full, full[1:], strict=False)] + [(full[i], full[i // 2], "calls") for i in range(3, 24, 4)] + [(full[0], full[9], "imports"), ("b.py::x", "b.py::y", "calls")]
    wide = [(full[5], f"c.py::w{i}", "calls") for i in range(9)]
    tags = [(full[0], "flow", "v"), ("b.py::x", "flow", "w"), ("b.py::y", "flow", "w"), (full[2], "emits", "e"), (full[20], "handles", "e"), (full[7], "handles", "e")]
    g = relational.synthesize_event_edges(graph_of(spark, [node(i) for i in [*full, "b.py::x", "b.py::y", *[w[1] for w in wide]]], edges + wide, tags))
    got, rounds = [], paths._in_rounds
    monkeypatch.setattr(paths, "_in_rounds", lambda entries, *a: got.append(entries.count()) or rounds(entries, *a))
    tree = paths.flow_tree(g, walked=0, laid=laid).select("flow", "entry", "ord", "depth", "id", "parent_id")
    want = walked(g, [(n, k, v) for n, k, v in tags if k == "flow"])
    assert sorted(map(tuple, tree.collect()), key=str) == sorted(want, key=str)
    assert max(r[3] for r in want) > 15 and sum(got) == in_rounds


@pytest.mark.parametrize("seed", range(5))
def test_edges_on_disk_are_walked_like_edges_in_memory(monkeypatch, seed):
    """By groups that end anywhere in a batch, with and without hubs, calls that repeat and entries without any."""
    rng = random.Random(seed)
    groups = []
    for group in range(4):
        nodes, hubs = rng.sample(range(1, 60), 12), [-7, -3][: group % 3]
        edges = [(rng.choice(nodes), rng.choice(nodes + hubs)) for _ in range(20 if group else 0)] + [(h, rng.choice(nodes)) for h in hubs for _ in range(3)]
        groups.append((sorted(edges), [(paths.START, e) for e in rng.sample(nodes, 3)], [(n, paths.START) for n in nodes + hubs]))
    table = lambda rows: pd.DataFrame(rows, columns=["group", "source", "target"])
    rows_of = lambda made: sorted(tuple(map(int, r)) for piece in made for r in piece.itertuples(index=False))
    want = sorted(r for g, (edges, starts, _) in enumerate(groups) for r in rows_of(paths._walks(iter([table([(g, *e) for e in edges + starts])]))))
    monkeypatch.setattr(paths, "MADE", 4)
    monkeypatch.setattr(paths, "RENUMBERED", 3)
    rows = table(sorted((g, *e) for g, parts in enumerate(groups) for e in sum(parts, [])))
    pieces = list(paths._walks_laid(rows[i : i + 7] for i in range(0, len(rows), 7)))
    assert rows_of(pieces) == want and all(len(p) <= 4 for p in pieces)


@pytest.mark.parametrize("least", [2, 500])
def test_walks_through_a_large_component_are_made_once_for_entries_that_enter_it_at_the_same_node(monkeypatch, least):
    """Random graphs with hubs and cycles, against a plain walk; and 40 entries before one cycle, which is walked once and not 40 times."""
    monkeypatch.setattr(paths, "TANGLED", least)
    monkeypatch.setattr(paths, "AT_ONCE", 2)
    table = lambda edges, entries: pd.DataFrame([*edges, *[(paths.START, e) for e in entries]], columns=["source", "target"])
    rows_of = lambda made: sorted(tuple(map(int, r)) for piece in made for r in piece.itertuples(index=False))
    for seed in range(100):
        rng = random.Random(seed)
        nodes, hubs = rng.sample(range(1, 60), 12), [-7, -3, -2][: seed % 4]
        edges = [(rng.choice(nodes), rng.choice(nodes + hubs)) for _ in range(22)] + [(h, rng.choice(nodes)) for h in hubs for _ in range(3)]
        calls = {n: {t for s, t in edges if s == n and t > 0} | {t for h, t in edges if (n, h) in edges and h < 0} for n in nodes}
        want = []

        def visit(entry, node, depth, parent, seen, want=want, calls=calls):
            seen.append(node)
            want.append((entry, len(seen) - 1, depth, node, parent))
            for target in sorted(calls[node]):
                if target not in seen:
                    visit(entry, target, depth + 1, node, seen)

        entries = rng.sample(nodes, 3)
        for entry in entries:
            visit(entry, entry, 0, paths.START, [])
        assert rows_of(paths._walks(iter([table(edges, entries)]))) == sorted(want), seed
    walks, tree = [], paths._Walks.tree
    monkeypatch.setattr(paths._Walks, "tree", lambda self, start, share=True: walks.append(share) or tree(self, start, share))
    cycle = [(100 + i, 100 + (i + 1) % 30) for i in range(30)]
    made = rows_of(paths._walks(iter([table([*cycle, *[(e, 100) for e in range(1, 41)]], range(1, 41))])))
    assert len(made) == 40 * 31 and walks.count(False) == (least == 2)


def test_trees_are_told_without_a_join_of_their_rows(spark):
    """Rows come from what the task tells of a node: nothing is joined or shuffled after the walk."""
    g = shop(spark)
    plan = paths.flow_tree(g, "checkout")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") > 0 and not any(step in plan[: plan.index("MapInArrow")] for step in ("Join", "Exchange")), plan


def test_event_lines_are_numbered_without_sorting_pairs(spark, monkeypatch):
    """As if pairs were sorted: ends that share file and name, names that are missing, several events, and cells of a few ends."""
    monkeypatch.setattr(lines, "CELL", 2)
    rng = random.Random(3)
    full = [f"{rng.choice('ab')}.py::n{i}" for i in range(30)]
    tags = {(i, kind, value) for i in full for kind in ("emits", "handles") for value in "uvw" if rng.random() < 0.4} | {(full[0], "emits", "alone")}
    g = graph_of(spark, [node(i) for i in full], [], tags)
    name = F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit(""), F.lit(None)), (F.crc32("id") % 4 + 1).cast("int"))
    g = g.with_tables(nodes=g.nodes.withColumn("name", name))
    rows = lambda df: sorted(map(tuple, df.collect()), key=lambda r: r[0])
    want = rows(lines.in_order(lines.events(g)))
    made = lines.events_in_order(g)
    assert rows(made) == want and len(want) > 100 and any(line is None for _, line in want)
    assert rows(lines.overview_in_order(g)) == rows(lines.in_order(lines.overview(g)))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan[: plan.index("Generate")] and "Repartition" not in plan[: plan.index("Generate")], plan
