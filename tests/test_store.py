"""Writes of the store: by parts, in numbered versions, by several writers."""

import random

import pytest
from pyspark.sql import functions as F

from tests.golden import CHARGE, CREATE, SAVE, graph_of, node, shop
from weftgraph.graph import HUB
from weftgraph.operators import closure, relational
from weftgraph.operators.relational import synthesize_event_edges
from weftgraph.schema import EDGES, KEYS, NODES, TAGS
from weftgraph.sources import store as module
from weftgraph.sources.store import GraphStore, StoreError, part_of, without_file

TABLES = ("nodes", "edges", "tags", "external_calls")


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture()
def store(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path / "graph"), parts=5)
    s.create()
    return s


def part(spark, key, parts=5):
    return spark.range(1).select(part_of(F.lit(key), parts)).first()[0]


def files_in_parts(spark, n, parts=5):
    """A file for each of the first n parts."""
    found = {}
    for i in range(200):
        found.setdefault(part(spark, f"f{i}.py", parts), f"f{i}.py")
        if len(found) == parts:
            break
    return [found[p] for p in range(n)]


class Interrupted(GraphStore):
    """A writer to which something happens after it has made its change and before it publishes it."""

    def meanwhile(self, *actions):
        self.actions, self.made = list(actions), 0
        return self

    def _commit(self, change):
        def counted(base):
            self.made += 1
            done = change(base)
            if self.actions:
                self.actions.pop(0)()
            return done

        super()._commit(counted)


def edge(spark, *pairs):
    return spark.createDataFrame([(a, b, "calls") for a, b in pairs], EDGES)


def test_writers_of_other_parts_both_win_without_repeating_their_work(spark, store):
    a, b = files_in_parts(spark, 2)
    slow = Interrupted(spark, store.path).meanwhile(lambda: store.insert_edges(edge(spark, (f"{b}::g", f"{a}::f"))))
    before = store.versions()[-1]
    slow.insert_edges(edge(spark, (f"{a}::f", f"{b}::g")))
    assert slow.made == 1 and store.versions()[-1] == before + 2
    assert rows(store.read("edges")) == rows(edge(spark, (f"{a}::f", f"{b}::g"), (f"{b}::g", f"{a}::f")))


def test_of_two_writers_of_a_part_one_does_its_work_again(spark, store):
    (a,) = files_in_parts(spark, 1)
    slow = Interrupted(spark, store.path).meanwhile(lambda: store.insert_edges(edge(spark, (f"{a}::f", "x"), (f"{a}::g", "y"))))
    slow.insert_edges(edge(spark, (f"{a}::f", "x"), (f"{a}::f", "z")))
    assert slow.made == 2
    assert rows(store.read("edges")) == rows(edge(spark, (f"{a}::f", "x"), (f"{a}::f", "z"), (f"{a}::g", "y")))


def test_a_tag_is_refused_if_its_node_went_meanwhile(spark, store):
    store.replace(shop(spark))
    slow = Interrupted(spark, store.path).meanwhile(lambda: store.delete_file_data("src/db.py"))
    with pytest.raises(StoreError, match="isn't in the graph"):
        slow.insert_tags(spark.createDataFrame([(SAVE, "emits", "saved")], TAGS))
    assert slow.made == 2 and store.read("tags").filter(F.col("node_id") == SAVE).isEmpty()


def test_a_writer_that_is_always_too_late_gives_up(spark, store, monkeypatch):
    monkeypatch.setattr(module, "ATTEMPTS", 2)
    slow = Interrupted(spark, store.path).meanwhile(*[lambda k=k: store.set_meta("k", str(k)) for k in range(2)])
    with pytest.raises(StoreError, match="another writer"):
        slow.set_meta("k", "slow")
    assert store.meta()["k"] == "1"


def test_a_number_is_given_once(store):
    first = store.version()
    again = module.Version(first.number, first.parts, {})
    assert not store._publish(again) and store.version() == first


def test_nodes_of_one_file_touch_its_part_only(spark, store):
    files = files_in_parts(spark, 4)
    store.replace(graph_of(spark, [node(f"{f}::a") for f in files]))
    before = store.version().folders
    store.insert_nodes(spark.createDataFrame([node(f"{files[2]}::a", (7, 8)), node(f"{files[2]}::b")], NODES))
    after = store.version().folders
    assert {k for k in before.keys() | after.keys() if before.get(k) != after.get(k)} == {("nodes", 2)}
    assert store.read("nodes").count() == 5


def test_an_id_is_looked_up_in_one_part(spark, store):
    store.replace(shop(spark))
    g = store.open()
    own = f"_part={part(spark, CHARGE)}/"
    for looked_up in (g.node_rows(CHARGE), g.direct_into(CHARGE), g.direct_from(CHARGE)):
        assert all(own in f for f in looked_up.inputFiles())
    assert rows(relational.callers(g, CHARGE)) == rows(relational.callers(shop(spark), CHARGE))
    assert rows(relational.callees(g, CREATE)) == rows(relational.callees(shop(spark), CREATE))
    emitter = "src/services.py::emit_created"
    assert [r["id"] for r in relational.callees(g, emitter).collect()] == ["src/workers.py::send_email"]
    assert [r["id"] for r in relational.callers(g, "src/workers.py::send_email").collect()] == [emitter]


def test_parts_of_many_folders_are_written_anew(spark, store):
    for i in range(module.CROWDED + 2):
        store.insert_edges(edge(spark, ("a.py::f", f"b.py::{i}")))
    assert max(len(f) for f in store.version().folders.values()) <= module.CROWDED
    assert store.read("edges").count() == module.CROWDED + 2
    assert store.open().direct_into("b.py::3").count() == 1


def test_old_versions_and_their_folders_go(spark, store):
    for i in range(module.KEPT + 3):
        store.set_meta("k", str(i))
    assert len(store.versions()) == module.KEPT
    fs, to = store._fs()
    assert len(fs.listStatus(to(f"{store.path}/meta"))) == module.KEPT
    assert not [s for s in fs.listStatus(to(f"{store.path}/log")) if "draft" in s.getPath().getName()]


def random_graph(spark, draw, own_files=True):
    ids = [f"f{draw.randrange(6)}.py::n{i}" for i in range(25)]
    nodes = [node(i) if own_files else (*node(i)[:3], f"f{draw.randrange(6)}.py", *node(i)[4:]) for i in ids]
    edges = {(draw.choice(ids), draw.choice([*ids, "gone.py::x"]), draw.choice(["calls", "contains"])) for _ in range(40)}
    tags = {(draw.choice(ids), draw.choice(["emits", "handles", "flow"]), draw.choice("uvw")) for _ in range(25)}
    return synthesize_event_edges(graph_of(spark, nodes, edges, tags, {(draw.choice(ids), "p", "s") for _ in range(9)}))


@pytest.mark.parametrize(("seed", "own_files"), [(1, True), (2, True), (3, False)])
def test_deleting_a_file_equals_filtering_whole_tables(spark, store, seed, own_files):
    """Also where nodes say another file than their ids."""
    g = random_graph(spark, random.Random(seed), own_files)
    store.replace(g)
    assert all(rows(getattr(store.open(), t)) == rows(getattr(g, t)) for t in TABLES)
    store.delete_file_data("f3.py")
    store.delete_file_data("nowhere.py")
    want, got = without_file(g, "f3.py"), store.open()
    for t in TABLES:
        assert rows(getattr(got, t).select(*KEYS[t])) == rows(getattr(want, t).select(*KEYS[t])), t
    version = store.version()
    both = [rows(store.rows_of(version, t).select("source_id", "target_id", "kind")) for t in ("edges", "edges_in")]
    assert both[0] == both[1]


def test_events_are_as_many_rows_as_tags(spark, store):
    """60 emitters and 70 handlers of one value: 130 rows instead of 4,200, and the same closure."""
    ids = [f"m{i % 9}.py::n{i}" for i in range(140)]
    tags = [(i, "emits", "e") for i in ids[:60]] + [(i, "handles", "e") for i in ids[60:130]] + [(ids[130], "flow", "x")]
    g = graph_of(spark, [node(i) for i in ids], [(ids[130], ids[0], "calls"), (ids[60], ids[131], "calls")], tags)
    store.replace(g)
    store.synthesize_event_edges()
    opened = store.open()
    assert opened.hubs.count() == 130 and opened.steps_on.count() == 132
    assert opened.edges.filter("kind = 'event'").count() == 60 * 70
    pairs = g.with_tables(edges=synthesize_event_edges(g).edges)  # a graph whose edges list them
    assert pairs.hubs is None and rows(closure.flow_membership(opened)) == rows(closure.flow_membership(pairs))
    assert not [r for r in closure.flow_membership(opened).collect() if r["id"].startswith(HUB)]
    for graph in (opened, pairs):
        assert rows(closure.impact_ids(graph, ids[131])) == rows(pairs.nodes.select("id").filter(F.col("id").isin(*ids[:61], ids[130])))


def test_event_edges_that_stand_as_pairs_are_made_anew(spark, store):
    plain = shop(spark)
    stale = plain.edges.unionByName(spark.createDataFrame([(SAVE, CHARGE, "event")], EDGES))
    store.replace(plain.with_tables(edges=stale))
    assert store.read("edges").filter("kind = 'event'").count() == 2
    store.synthesize_event_edges()
    assert rows(store.read("edges")) == rows(plain.edges)


def test_a_large_part_is_written_by_several_tasks(spark, tmp_path):
    """All rows of one file, in one part: no task sorts and writes them all."""
    rows = spark.range(4000).select(F.concat(F.lit("a.py::"), "id").alias("source_id"), F.lit("b.py::x").alias("target_id"), F.lit("calls").alias("kind"))
    store = GraphStore(spark, str(tmp_path / "g"), parts=2)
    store.create()
    store.insert_edges(rows)
    (folder,) = store.version().of("edges")
    assert len(list((tmp_path / "g" / folder).glob("*.parquet"))) > 1
    assert store.read("edges").count() == 4000


def test_a_large_part_is_written_by_several_tasks(spark, tmp_path):
    """Rows of one file are one part; what a task writes has a size that doesn't grow with them."""
    store = GraphStore(spark, str(tmp_path / "graph"))
    rows = spark.range(0, 40_000, 1, 8).select(F.concat(F.lit("a.py::n"), F.col("id").cast("string")).alias("node_id"), F.lit("flow").alias("kind"), F.lit("v").alias("value"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20KB")
    try:
        ((key, (folder,)),) = store._write("tags", rows, 16).items()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "graph" / folder).glob("*.parquet"))) > 2
    assert store._in("tags", [folder]).count() == 40_000
