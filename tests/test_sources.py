"""Store, extraction, configuration, command line and streaming."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tests.golden import CHARGE, CREATE, HANDLE, node, shop
from weftgraph import cli
from weftgraph.operators.relational import synthesize_event_edges
from weftgraph.schema import EDGES, EXTERNAL_CALLS, NODES, TAGS
from weftgraph.plans import build
from weftgraph.sources import calls, config, files, python_ast, references, symbols, tags
from weftgraph.sources.store import GraphStore, StoreError, part_of
from weftgraph.streaming.refresh import CHANGES, apply_changes, refresh


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture()
def store(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path / "graph"))
    s.create()
    return s


def test_store_writes(spark, store):
    make = spark.createDataFrame
    store.insert_nodes(make([node("a.py::f"), node("a.py::g")], NODES))
    store.insert_nodes(make([node("a.py::f", (5, 6))], NODES))
    assert [(r["id"], r["line_start"]) for r in store.read("nodes").orderBy("id").collect()] == [("a.py::f", 5), ("a.py::g", 1)]
    for _ in range(2):
        store.insert_edges(make([("a.py::f", "a.py::g", "calls"), ("a.py::f", "a.py::g", "calls")], EDGES))
        store.insert_tags(make([("a.py::f", "emits", "e"), ("a.py::g", "handles", "e")], TAGS))
        store.insert_external_calls(make([("a.py::f", "p", "s")], EXTERNAL_CALLS))
        store.synthesize_event_edges()
    assert rows(store.read("edges")) == [("a.py::f", "a.py::g", "calls"), ("a.py::f", "a.py::g", "event")]
    assert store.read("tags").count() == 2 and store.read("external_calls").count() == 1
    with pytest.raises(StoreError, match="isn't in the graph"):
        store.insert_tags(make([("nobody", "flow", "x")], TAGS))
    store.create()
    assert store.read("nodes").count() == 2
    store.clear()
    assert [store.read(t).count() for t in ("nodes", "edges", "tags", "external_calls")] == [0] * 4


def test_delete_file_data(spark, store):
    store.replace(shop(spark, external=[(CHARGE, "stripe", "c")]))
    store.delete_file_data("src/gateways.py")
    g = store.open()
    assert g.nodes.count() == 7 and g.external_calls.count() == 0
    assert CHARGE not in {x for r in g.edges.collect() for x in (r["source_id"], r["target_id"])}
    assert CHARGE not in {r["node_id"] for r in g.tags.collect()}


def test_a_write_is_seen_whole_or_not_at_all(spark, store, monkeypatch):
    store.replace(shop(spark))
    before = store.open()
    counts = [getattr(before, t).count() for t in ("nodes", "edges", "tags")]
    broken = spark.createDataFrame([(CHARGE, CHARGE, "calls")], EDGES).withColumn("kind", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        store.replace(shop(spark).with_tables(edges=broken))
    assert [getattr(store.open(), t).count() for t in ("nodes", "edges", "tags")] == counts
    for k in range(3):
        store.set_meta("turn", str(k))
    assert store.meta()["turn"] == "2" and before.nodes.count() == counts[0]  # an open graph keeps its files
    again = spark.createDataFrame([node(CHARGE, (1, 2)), node(CHARGE, (3, 4)), node(CHARGE, (5, 6))], NODES).coalesce(1)
    store.replace(shop(spark).with_tables(nodes=shop(spark).nodes.unionByName(again)))
    assert [r["line_start"] for r in store.open().nodes.filter(f"id = '{CHARGE}'").collect()] == [5]
    stray = spark.createDataFrame([("nobody", "flow", "x")], TAGS)
    with pytest.raises(StoreError, match="isn't in the graph"):
        store.replace(shop(spark).with_tables(tags=stray))


def test_metadata_and_version(spark, store):
    store.replace(shop(spark))
    kept = {r["id"]: r["metadata"] for r in store.open().nodes.collect()}
    assert kept[HANDLE] == {"route": "POST /api/checkout"} and kept[CHARGE] is None
    store.set_meta("last_build", "5")
    assert store.meta() == {"schema_version": "2", "last_build": "5"}
    store.set_meta("schema_version", "1")
    with pytest.raises(StoreError, match="schema version 1"):
        store.open()
    with pytest.raises(StoreError, match="build it first"):
        GraphStore(spark, store.path + "-none").open()
    spark.createDataFrame([("nodes", "nodes/1")], "tab string, folder string").write.parquet(f"{store.path}-old/versions/000000000001-a")
    with pytest.raises(StoreError, match="without a log"):
        GraphStore(spark, store.path + "-old").open()


# --- tags ---


def scanned(spark, text, nodes, language="typescript", file="a.ts"):
    sources = spark.createDataFrame([(file, language, text)], "file string, language string, text string")
    own = spark.createDataFrame([(f"{file}::{n}", k, file, a, b, i) for i, (n, k, a, b) in enumerate(nodes)], "id string, kind string, file string, line_start int, line_end int, ord int")
    return rows(tags.scan_tags(sources, own)), [r["error"] for r in tags.scan_errors(sources, own).orderBy("tag_line", "error").collect()]


def test_scan_binds_forward(spark):
    text = "// @weft:flow checkout\nfunction a() {\n}\n\n  /* @weft:boundary stripe\nfunction b() {}\n"
    assert scanned(spark, text, [("a", "function", 2, 3), ("b", "method", 6, 6)]) == ([("a.ts::a", "flow", "checkout"), ("a.ts::b", "boundary", "stripe")], [])


def test_scan_languages_and_values(spark):
    assert scanned(spark, "# @weft:flow checkout, payment,\ndef f(): pass", [("f", "function", 2, 2)], "python") == ([("a.ts::f", "flow", "checkout"), ("a.ts::f", "flow", "payment")], [])
    assert scanned(spark, "# @weft:flow checkout\nfunc f()", [("f", "function", 2, 2)], "go") == ([], [])
    assert scanned(spark, "-- @weft:flow checkout\nf", [("f", "function", 2, 2)], "lua")[0] == [("a.ts::f", "flow", "checkout")]
    assert scanned(spark, 'x = "@weft:flow no"\ndef f(): pass', [("f", "function", 2, 2)], "python") == ([], [])


def test_scan_errors(spark):
    text = "// @weft:flows x\n// @weft:flow Bad\n// @weft:flow ok\nfunction a() {}\n// @weft:emits late\n"
    good, errors = scanned(spark, text, [("a", "function", 4, 4)])
    assert good == [("a.ts::a", "flow", "ok")]
    assert errors == ["Line 1: unknown tag kind 'flows'", "Line 2: invalid tag name 'Bad' — must be lowercase kebab-case", "Line 5: @weft:emits late has no function below it"]


def test_scan_skips_types_and_binds_inside_functions(spark):
    assert scanned(spark, "// @weft:flow x\ntype T\nfunction a() {}", [("T", "type", 2, 2), ("a", "function", 3, 3)])[0] == [("a.ts::a", "flow", "x")]
    assert scanned(spark, "function a() {\n// @weft:flow x\n}\nfunction b() {}", [("a", "function", 1, 3), ("b", "function", 4, 4)])[0] == [("a.ts::b", "flow", "x")]


# --- symbols, calls, references ---


def symbol(name, kind, a, b, children=()):
    span = {"start": {"line": a, "character": 0}, "end": {"line": b, "character": 0}}
    return {"name": name, "kind": kind, "range": span, "selectionRange": span, "children": list(children)}


def test_symbols(spark):
    tree = [symbol("A", 5, 0, 9, [symbol("m", 6, 1, 3), symbol("v", 13, 4, 6, [symbol("in", 12, 5, 5)])]), symbol("init", 12, 10, 11), symbol("init", 12, 12, 13), symbol("S", 23, 14, 15), symbol("I", 11, 16, 17)]
    dump = spark.createDataFrame([("a.go", "go", json.dumps(tree)), ("tests/b_test.go", "go", json.dumps([symbol("t", 12, 0, 1)])), ("e.go", "go", None)], "file string, language string, symbols string")
    got = [(r["id"], r["kind"], r["line_start"], r["line_end"], r["is_test"]) for r in symbols.symbol_nodes(dump).orderBy("file", "ord").collect()]
    assert got == [
        ("a.go::A", "class", 1, 10, False), ("a.go::A.m", "method", 2, 4, False), ("a.go::A.in", "function", 6, 6, False), ("a.go::init", "function", 11, 12, False),
        ("a.go::init$2", "function", 13, 14, False), ("a.go::S", "class", 15, 16, False), ("a.go::I", "type", 17, 18, False), ("tests/b_test.go::t", "function", 1, 2, True),
    ]


URIS = {
    "file:///p/node_modules/stripe/index.d.ts": ("stripe", None, False),
    "file:///p/node_modules/%40aws/s3/x.js": ("@aws/s3", None, False),
    "file:///p/node_modules/@types/node/x.d.ts": ("@types/node", None, True),
    "file:///p/node_modules/typescript/lib.d.ts": ("typescript", None, True),
    "file:///h/go/pkg/mod/github.com/gin-gonic/gin@v1.9.1/context.go": (None, "github.com/gin-gonic/gin", False),
    "file:///usr/local/go/src/net/http/server.go": (None, "net/http", False),
    "file:///elsewhere/x.ts": (None, None, False),
}


def test_uris(spark):
    df = spark.createDataFrame([(u,) for u in URIS], "uri string")
    got = {r[0]: tuple(r)[1:] for r in df.select("uri", calls.package_name(df.uri), calls.go_module_name(df.uri), calls.is_type_declaration(df.uri)).collect()}
    assert got == URIS


def test_calls(spark):
    def to(*uris):
        return json.dumps([{"to": {"name": f"f{i}", "uri": u}} for i, u in enumerate(uris)])

    uris = list(URIS)
    dump = spark.createDataFrame(
        [("a::f", "function", "typescript", to("file:///p/src/a.ts", *uris)), ("a::g", "function", "go", to(uris[4], uris[5])), ("a::C", "class", "go", to(uris[4])), ("a::h", "function", "go", None)],
        "source_id string, kind string, language string, calls string",
    )
    found = calls.outgoing_calls(dump)
    assert rows(calls.call_edges(found, "file:///p")) == [("a::f", "src/a.ts::f0", "calls")]
    assert rows(calls.external_calls(found, "file:///p")) == [("a::f", "@aws/s3", "f2"), ("a::f", "stripe", "f1"), ("a::g", "github.com/gin-gonic/gin", "f0"), ("a::g", "net/http", "f1")]


def test_references(spark):
    own = spark.createDataFrame([("o", "function", "a.py", 1, 20, 0), ("i", "function", "a.py", 5, 8, 1), ("c", "class", "a.py", 1, 30, 2)], "id string, kind string, file string, line_start int, line_end int, ord int")
    location = lambda file, line: {"uri": f"file:///p/{file}", "range": {"start": {"line": line - 1, "character": 0}}}
    refs = json.dumps([location("a.py", 6), location("a.py", 6), location("a.py", 25), {**location("x", 1), "uri": "file:///q/a.py"}])
    found = references.located(spark.createDataFrame([("t", refs), ("o", refs)], "target_id string, refs string"), "file:///p")
    assert rows(references.reference_edges(found, own)) == [("o", "t", "calls")]
    assert rows(references.reference_edges(found, own, innermost=True)) == [("i", "o", "calls"), ("i", "t", "calls")]


def test_references_in_long_and_nested_functions(spark):
    spans = [("whole", 1, 900_000), ("long", 10, 200_000), ("mid", 4000, 8200), ("short", 4200, 4260), ("edge", 255, 256), ("line", 512, 512)]
    own = spark.createDataFrame([(n, "function", "a.py", a, b, i) for i, (n, a, b) in enumerate(spans)], "id string, kind string, file string, line_start int, line_end int, ord int")
    lines = [1, 9, 10, 254, 255, 256, 257, 511, 512, 513, 4000, 4200, 4255, 4260, 4261, 8200, 8201, 65536, 131072, 200_000, 200_001, 900_000, 900_001]
    refs = spark.createDataFrame([("t", "a.py", n) for n in lines], "target_id string, file string, line int")
    for innermost in (False, True):
        got = {r["line"]: r["caller_id"] for r in references.enclosing(refs, own, innermost).collect()}
        around = {n: [s for s in spans if s[1] <= n <= s[2]] for n in lines}
        assert got == {n: (max(s, key=lambda x: (x[1], -x[2])) if innermost else s[0])[0] for n, s in around.items() if s}


def test_symbols_under_every_kind_of_branch():
    text = """
try:
    from fast import run
except ImportError:
    def run(): return other()
else:
    def after(): pass
finally:
    def last(): pass
if x: pass
elif y:
    def elsewhere(): pass
else:
    class Other:
        if x: pass
        else:
            def inner(self): pass
for i in z:
    def looped(): pass
else:
    async def ended(): pass
while True:
    def again(): pass
match z:
    case 1:
        def cased(): pass
with a as b:
    def held(): pass
"""
    tree = json.loads(python_ast.parse_file("a.py", text)[0][1])
    assert [s["name"] for s in tree] == ["after", "last", "run", "elsewhere", "Other", "looped", "ended", "again", "cased", "held"]
    assert [s["name"] for s in tree[4]["children"]] == ["inner"]


# --- files and configuration ---


def test_discover(spark, tmp_path):
    for f in ("src/a.py", "src/dist_old/b.py", "src/deep/er/c.ts", "src/x.txt", "src/my.dist.py"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x")
    found = files.discover(spark, str(tmp_path), (".py", ".ts"), ("dist",))
    texts = files.discover(spark, str(tmp_path), (".py", ".ts"), ("dist",), text=True)
    assert sorted((r["file"], r["text"]) for r in texts.collect()) == [("src/a.py", "x"), ("src/deep/er/c.ts", "x"), ("src/my.dist.py", "x")]
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert "file_path" in plan.split("DataFilters")[1]  # other files aren't opened
    os.utime(tmp_path / "src/a.py", (5_000_000, 5_000_000))
    assert [r["file"] for r in files.changed_since(found, 5_000_000_000).orderBy("file").collect()] == ["src/deep/er/c.ts", "src/my.dist.py"]
    assert files.changed_share(found, 5_000_000_000).first().asDict() == {"changed": 2, "total": 3, "whole": True}
    assert sorted(r["file"] for r in found.collect()) == ["src/a.py", "src/deep/er/c.ts", "src/my.dist.py"]
    assert files.changed_since(found, 0).count() == 3 and files.changed_since(found, 10**14).count() == 0
    assert files.detect_languages(found) == ["python", "typescript"]


def test_config():
    c = config.parse_config('[project]\nlanguages = ["python", "go"]\n[python]\nsource_roots = ["src"]\n[lint]\nstrict = true\nignore = ["typos"]')
    assert [x.language for x in c.to_build()] == ["python", "go"] and c.language("python").source_roots == ("src",)
    assert c.language("python").test_paths == ("tests",) and c.strict and c.ignore == ("typos",) and c.marker == "@weft:"
    for bad, message in (("x = ", "Invalid TOML"), ("a = 1", "Missing"), ("[project]\nlanguages = []", "non-empty"), ("[project]\nlanguages = [1]", "non-empty")):
        with pytest.raises(config.ConfigError, match=message):
            config.parse_config(bad)
    assert config.parse_config(config.starter_config(["python", "typescript"], "src")).languages == ("python", "typescript")
    odd = config.parse_config('lint = 3\npython = "x"\n[project]\nlanguages = ["python"]\nroot = 5\nmarker = []\nexclude = "no"')
    assert odd.language("python") == config.LanguageConfig("python", (".",), ("tests",)) and (odd.root, odd.marker) == (".", "@weft:") and not odd.strict and odd.ignore == ()
    assert odd.exclude == config.EXCLUDED and "vendor" in odd.exclude
    assert not config.parse_config('[project]\nlanguages = ["go"]\n[lint]\nstrict = 1\nignore = [2]').strict


SHOP = {
    "src/routes.py": "from services import create_order\n\n# @weft:flow checkout\n@app.post('/x')\ndef handle_checkout(req):\n    return create_order(req)\n",
    "src/services.py": "import gateways\n\ndef create_order(req):\n    gateways.charge(req)\n    announce(req)\n\n# @weft:emits order.created\ndef announce(o):\n    pass\n",
    "src/gateways.py": "import stripe\n\n# @weft:boundary stripe\ndef charge(req):\n    return stripe.charge(req)\n",
    "src/workers.py": "class Mailer:\n    # @weft:handles order.created\n    def send(self, o):\n        self.send(o)\n",
}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, text in SHOP.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    return root


def command(spark, project, *argv):
    return cli.run(cli.parser().parse_args(["--project", str(project), *argv]), spark)


def test_command_line(spark, project):
    assert command(spark, project, "lint")[1] == 1  # no configuration yet
    assert command(spark, project, "init")[0].startswith("Initialized project")
    assert command(spark, project, "flows") == (f"No graph at {project}/.weftgraph: build it first", 1)
    text, code = command(spark, project, "build")
    assert code == 0 and text.startswith("Built graph: 4 files, 6 nodes, 4 edges, 4 tags"), text
    run = lambda *argv: command(spark, project, *argv)[0]
    assert run("flow", "checkout").split("\n") == [
        "handle_checkout (src/routes.py:5)", "  → create_order (src/services.py:3)", "    → charge (src/gateways.py:4) [stripe]", "    → announce (src/services.py:8) emits order.created", "      → send (src/workers.py:3)",
    ] or run("flow", "checkout").startswith("handle_checkout (src/routes.py:4)")
    assert run("trace", "checkout", "--to", "stripe").count("→") == 2
    assert run("impact", "charge").startswith("Direct callers:\n  ← create_order (src/services.py:3)\n\nTransitive callers:\n  ← handle_checkout")
    assert run("callers", "create_order").startswith("← handle_checkout")
    assert run("events") == "order.created → emitted by announce, handled by send"
    assert run("boundaries") == "stripe:\n  charge (src/gateways.py:4)"
    assert "stripe               → 1 function across 1 file" in run("overview")
    assert json.loads(run("context", "charge", "--json"))["boundary"] == "stripe"
    assert run("code", "charge").startswith("# src/gateways.py:3-5\n\n# @weft:boundary stripe\ndef charge")
    assert "Coverage: 4/5 entry points tagged (80%)" in run("lint")
    assert "`@weft:flow checkout` on `src/routes.py::handle_checkout`" in run("populate")
    assert command(spark, project, "flow", "none") == ("Unknown flow: none", 1)
    assert command(spark, project, "callers", "none") == ("Unknown symbol: none", 1)
    assert run("update").startswith("Updated: 0/4 files")
    (project / "src/new.py").write_text("def fresh():\n    pass\n")
    assert run("update").startswith("Updated: 1/5 files")
    assert json.loads(run("callees", "handle_checkout", "--json"))[0]["name"] == "create_order"


def test_imports_meet_the_listing_in_a_join(spark):
    """From the root or beside the importing file, modules before names, packages where no file is."""
    text = "import a.b as m\nfrom . import near\nfrom pack import inner, thing\nimport numpy as np\n\ndef f():\n    m.go(); near.run(); inner.x(); thing(); np.sum(); own(); other()\n\ndef own():\n    pass\n"
    sources = spark.createDataFrame([("src/x.py", text), ("src/bad.py", "def ("), ("src/none.py", None)], "file string, text string")
    rows = python_ast.parsed(sources)
    assert [(r["file"], bool(r["error"])) for r in rows.filter("error IS NOT NULL").collect()] == [("src/bad.py", True)]
    files_ = spark.createDataFrame([(f,) for f in ("src/x.py", "a/b.py", "src/a/b.py", "src/near.py", "pack/inner.py", "src/pack/__init__.py")], "file string")
    made = python_ast.dump(rows, files_, "file:///p").collect()
    got = {r["source_name"]: [(c["to"]["name"], c["to"]["uri"]) for c in json.loads(r["calls"])] for r in made if r["calls"]}
    assert got == {
        "f": [("go", "file:///p/a/b.py"), ("run", "file:///p/src/near.py"), ("x", "file:///p/pack/inner.py"), ("thing", "file:///p/src/pack/__init__.py"), ("sum", "file:///p/node_modules/numpy"), ("own", "file:///p/src/x.py")],
        "own": [],
    }
    assert {r["file"] for r in made if r["symbols"]} == {"src/x.py", "src/none.py"}


def test_update_equals_a_fresh_build(spark, tmp_path):
    """Files are modified, one after the other: only their parts are written. One that comes or goes asks for a whole build."""
    root = tmp_path / "p"
    own = config.parse_config('[project]\nlanguages = ["python"]\n[python]\nsource_roots = ["src"]')
    texts = SHOP | {f"src/m{i}.py": f"def f{i}():\n    pass\n" for i in range(8)}
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    kept = GraphStore(spark, str(tmp_path / "kept"))
    assert build.build(spark, str(root), kept, own).unparsed == 0
    changes = [
        ("src/gateways.py", "# @weft:boundary adyen\n# @weft:emits paid\ndef charge(req):\n    helper()\n\ndef helper():\n    pass\n"),
        ("src/workers.py", "import m3\n\nclass Mailer:\n    # @weft:handles paid\n    def send(self, o):\n        m3.f3()\n"),
        ("src/m8.py", "import services\n\ndef f8():\n    services.announce(1)\n"),
    ]
    for turn, (name, text) in enumerate(changes):
        before = kept.version().folders
        (root / name).write_text(text)
        later = 2_000_000_000 + 10 * turn
        os.utime(root / name, (later, later))
        if turn:
            kept.set_meta("last_build", str((later - 5) * 1000))
        assert build.update(spark, str(root), kept, own)[:2] == (1, 12 if turn < 2 else 13)
        fresh = GraphStore(spark, str(tmp_path / f"fresh{turn}"))
        build.build(spark, str(root), fresh, own)
        for t in ("nodes", "edges", "tags", "external_calls"):
            assert rows(getattr(kept.open(), t)) == rows(getattr(fresh.open(), t)), (name, t)
        if turn < 2:
            after = kept.version().folders
            untouched = [k for k in before if k[0] in ("nodes", "edges", "tags") and before[k] == after.get(k)]
            assert len(untouched) > len(before) / 4


def test_build_from_dumps(spark, tmp_path):
    for name, text in {"src/a.ts": "// @weft:flow go\nfunction a() { b() }\n", "src/b.ts": "function b() {}\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    folder = tmp_path / cli.STORE / "dumps"
    folder.mkdir(parents=True)
    symbols_of = lambda file, name, line: {"file": file, "language": "typescript", "symbols": json.dumps([symbol(name, 12, line, line)])}
    (folder / "symbols.json").write_text("\n".join(map(json.dumps, [symbols_of("src/a.ts", "a", 1), symbols_of("src/b.ts", "b", 0)])))
    call = {"source_id": "src/a.ts::a", "kind": "function", "language": "typescript", "calls": json.dumps([{"to": {"name": "x", "uri": "file:///q/node_modules/left-pad/i.js"}}])}
    (folder / "calls.json").write_text(json.dumps(call))
    (folder / "refs.json").write_text(json.dumps({"target_id": "src/b.ts::b", "refs": json.dumps([{"uri": f"file://{tmp_path}/src/a.ts", "range": {"start": {"line": 1, "character": 15}}}])}))
    (tmp_path / config.FILE).write_text('[project]\nlanguages = ["typescript"]\n')
    text, code = command(spark, tmp_path, "build")
    assert code == 0 and text.startswith("Built graph: 2 files, 2 nodes, 1 edges, 1 tags"), text
    g = GraphStore(spark, str(tmp_path / cli.STORE)).open()
    assert rows(g.edges) == [("src/a.ts::a", "src/b.ts::b", "calls")] and rows(g.external_calls) == [("src/a.ts::a", "left-pad", "x")]
    assert command(spark, tmp_path, "flow", "go")[0] == "a (src/a.ts:2)\n  → b (src/b.ts:1)"


def test_streamed_refresh(spark, store, tmp_path):
    store.replace(shop(spark))
    inbox = tmp_path / "inbox"
    inbox.mkdir()

    def change(name, line):
        call = json.dumps([{"source": "charge", "calls": json.dumps([{"to": {"name": "save_order", "uri": "file:///p/src/db.py"}}])}])
        record = {"file": "src/gateways.py", "language": "python", "text": "# @weft:boundary adyen\ndef charge(): ...", "symbols": json.dumps([symbol("charge", 12, line, line)]), "calls": call}
        (inbox / name).write_text(json.dumps(record))

    def drain():
        stream = spark.readStream.schema(CHANGES).json(str(inbox))
        own = config.parse_config('[project]\nlanguages = ["python"]')
        refresh(stream, store, "file:///p", own, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
        return store.open()

    for name, line in (("1.json", 1), ("2.json", 1)):
        change(name, line)
        g = drain()
        assert [(r["line_start"]) for r in g.nodes.filter(f"id = '{CHARGE}'").collect()] == [2]
        assert [r["value"] for r in g.tags.filter(f"node_id = '{CHARGE}'").collect()] == ["adyen"]
        assert (CHARGE, "src/db.py::save_order", "calls") in rows(g.edges) and (CREATE, CHARGE, "calls") in rows(g.edges)
        assert g.nodes.count() == 8 and g.edges.filter("kind = 'event'").count() == 1


def test_refresh_writes_touched_parts_only(spark, store):
    store.replace(shop(spark))
    before = store.version().folders
    file = "src/workers.py"
    record = (file, "python", "# @weft:handles order.created\n# @weft:emits mail.sent\ndef send_email(): ...", json.dumps([symbol("send_email", 12, 2, 2)]), None, 1)
    apply_changes(store, spark.createDataFrame([record], CHANGES), "file:///p", config.parse_config('[project]\nlanguages = ["python"]'))
    after = store.version().folders
    own = spark.range(1).select(part_of(F.lit(file), store.parts())).first()[0]
    assert {at for at in before.keys() | after.keys() if before.get(at) != after.get(at)} <= {(t, own) for t in ("nodes", "edges", "edges_in", "tags", "external_calls", "hubs")}
    g, plain = store.open(), shop(spark)
    assert g.nodes.filter(f"file = '{file}'").select("line_start").first()[0] == 3
    assert rows(g.edges) == rows(synthesize_event_edges(plain).edges)
    assert set(rows(g.tags)) == set(rows(plain.tags)) | {(f"{file}::send_email", "emits", "mail.sent")}
    gone = [(file, "python", "", "[]", None, 2)]
    apply_changes(store, spark.createDataFrame(gone, CHANGES), "file:///p", config.parse_config('[project]\nlanguages = ["python"]'))
    g = store.open()
    assert g.nodes.count() == 7 and g.edges.filter("kind = 'event'").isEmpty() and g.tags.filter("kind = 'handles'").isEmpty()


def test_the_latest_version_of_a_file_counts_and_a_batch_counts_once(spark, store):
    store.replace(shop(spark))
    own = config.parse_config('[project]\nlanguages = ["python"]')

    def record(value, version):
        return ("src/gateways.py", "python", f"# @weft:boundary {value}\ndef charge(): ...", json.dumps([symbol("charge", 12, 1, 1)]), None, version)

    def apply(mark, *records):
        apply_changes(store, spark.createDataFrame(list(records), CHANGES), "file:///p", own, mark)
        return [r["value"] for r in store.open().tags.filter(F.col("node_id") == CHARGE).collect()]

    assert apply("a 0", record("old", 1), record("new", 3), record("older", None), record("mid", 2)) == ["new"]
    assert apply("a 0", record("again", 9)) == ["new"]
    assert apply("a 1", record("same-b", 5), record("same-a", 5)) == ["same-b"]
