"""Command line: python -m weftgraph.cli COMMAND. Queries run on the graph in <project>/.weftgraph."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph
from .operators import closure, lint, paths, relational
from .operators.relational import SymbolError, in_order
from .plans import build as building
from .plans import lines, render, reports
from .sources import config as configs
from .sources import files
from .sources.store import GraphStore, StoreError

STORE = ".weftgraph"


class Failure(Exception):
    """Ends a command with a message and exit code 1."""


class Commands:
    """One method a command: what it prints is returned."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = GraphStore(spark, f"{self.root}/{STORE}")

    @property
    def config(self) -> configs.Config:
        path = Path(self.root, configs.FILE)
        if not path.exists():
            raise Failure(f"No {configs.FILE} in {self.root}: run init first")
        return configs.parse_config(path.read_text(encoding="utf-8"))

    @property
    def graph(self) -> Graph:
        return self.store.open()

    def _one(self, graph: Graph, symbol: str):
        try:
            return relational.resolve_one(graph, symbol)
        except SymbolError as bad:
            raise Failure("\n".join([str(bad), *(f"  {m}" for m in bad.matches)])) from bad

    def _listed(self, rows: DataFrame) -> list:
        return in_order(rows).collect()

    def _text(self, rows: DataFrame) -> str:
        """A table of lines as they are printed."""
        return "\n".join(r["line"] for r in rows.orderBy("o", "line").toLocalIterator())

    def init(self) -> str:
        path = Path(self.root, configs.FILE)
        Path(self.root, STORE).mkdir(parents=True, exist_ok=True)
        found = files.discover(self.spark, self.root, tuple(e for own in files.EXTENSIONS.values() for e in own), configs.EXCLUDED)
        languages = files.detect_languages(found)
        if not path.exists():
            path.write_text(configs.starter_config(languages, "src" if Path(self.root, "src").is_dir() else "."), encoding="utf-8")
        missing = [f"Warning: files in {n} need language-server dumps in {STORE}/dumps" for n in languages if n != "python" and not Path(self.root, STORE, "dumps").is_dir()]
        return "\n".join(["Initialized project", *missing])

    def build(self) -> str:
        s = building.build(self.spark, self.root, self.store, self.config)
        bad = f"\nWarning: {s.unparsed} files could not be parsed" if s.unparsed else ""
        return f"Built graph: {s.files} files, {s.nodes} nodes, {s.edges} edges, {s.tags} tags ({s.milliseconds}ms){bad}"

    def update(self) -> str:
        changed, total, ms = building.update(self.spark, self.root, self.store, self.config)
        return f"Updated: {changed}/{total} files re-indexed ({ms}ms)"

    def lint(self, strict: bool = False, honour_config: bool = False, as_json: bool = False) -> tuple[str, bool]:
        """(text, whether it is clean). honour_config: lint.strict and lint.ignore count."""
        own, graph = self.config, self.graph
        found = lint.lint(graph, own.marker, own.ignore if honour_config else ()).orderBy("rule", "file", "line", "symbol", "message").collect()
        covered = relational.coverage(graph).first()
        bad = {"error", "warning"} if strict or (honour_config and own.strict) else {"error"}
        clean = not any(r["severity"] in bad for r in found)
        if as_json:
            return render.as_json({"issues": [r.asDict() for r in found], "coverage": covered.asDict()}), clean
        return render.lint(found, covered), clean

    def populate(self) -> str:
        graph = self.graph
        tagged = graph.tags.orderBy("kind", "value", "node_id").collect()
        return render.populate(self.config.marker, relational.project_summary(graph).first(), tagged)

    def overview(self, as_json: bool = False) -> str:
        graph = self.graph
        if not as_json:
            return self._text(lines.overview(graph))
        return render.as_json(render.overview_data(self._listed(relational.flows(graph)), self._listed(relational.boundaries(graph)), self._events(graph)))

    def _events(self, graph: Graph) -> list:
        return relational.events(graph).orderBy("event_name", "emitter_file", "emitter_name", "handler_file", "handler_name").collect()

    def flows(self, as_json: bool = False) -> str:
        if not as_json:
            return self._text(lines.flows(self.graph))
        return render.as_json(render.overview_data(self._listed(relational.flows(self.graph)), [], [])["flows"])

    def flow(self, name: str, as_json: bool = False) -> str:
        graph = self.graph
        if graph.tags.filter((F.col("kind") == "flow") & (F.col("value") == name)).isEmpty():
            raise Failure(f"Unknown flow: {name}")
        if not as_json:
            return self._text(lines.flow(graph, name))
        trees = render.grouped(paths.flow_tree(graph, name).orderBy("entry", "ord").collect(), "entry")
        return render.as_json([[r.asDict() for r in own] for own in trees.values()])

    def context(self, symbol: str, as_json: bool = False) -> str:
        graph = self.graph
        node = self._one(graph, symbol)
        if not as_json:
            return self._text(lines.context(graph, node["id"]))
        bound = relational.boundary_of_node(graph, last=False).filter(F.col("node_id") == node["id"]).collect()
        flows = [r["flow"] for r in closure.flows_for_node(graph, node["id"]).orderBy("flow").collect()]
        near = [self._listed(step(graph, node["id"])) for step in (relational.callers, relational.callees)]
        return render.as_json(render.context_data(node, flows, *near, bound[0]["boundary"] if bound else None))

    def _near(self, step: str, symbol: str, as_json: bool) -> str:
        graph = self.graph
        node_id = self._one(graph, symbol)["id"]
        if not as_json:
            return self._text(getattr(lines, step)(graph, node_id))
        return render.as_json([r.asDict() for r in self._listed(getattr(relational, step)(graph, node_id))])

    def callers(self, symbol: str, as_json: bool = False) -> str:
        return self._near("callers", symbol, as_json)

    def callees(self, symbol: str, as_json: bool = False) -> str:
        return self._near("callees", symbol, as_json)

    def trace(self, flow: str, to: str, as_json: bool = False) -> str:
        graph = self.graph
        for kind, value in (("flow", flow), ("boundary", to)):
            if relational.tagged(graph, kind).filter(F.col("value") == value).isEmpty():
                raise Failure(f"Unknown {kind}: {value}")
        found = paths.trace(graph, flow, to).collect()
        if not found:
            return f"No path from {flow} to {to}"
        steps = self.spark.createDataFrame([(i,) for i in sorted({i for r in found for i in r["path"]})], "id string")
        nodes = {r["id"]: r for r in graph.nodes.join(steps, "id", "left_semi").collect()}
        bound = {r["node_id"]: r["boundary"] for r in relational.boundary_of_node(graph, last=False).join(steps.withColumnRenamed("id", "node_id"), "node_id").collect()}
        order = lambda i: (nodes[i]["file"], nodes[i]["line_start"], i) if i in nodes else ("", 0, i)
        found.sort(key=lambda r: (order(r["src"]), order(r["dst"]), [order(i) for i in r["path"]]))
        if as_json:
            return render.as_json([list(r["path"]) for r in found])
        return "\n".join(render.chain([nodes[i] for i in r["path"] if i in nodes], bound) for r in found)

    def impact(self, symbol: str, as_json: bool = False) -> str:
        graph = self.graph
        node = self._one(graph, symbol)
        if not as_json:
            return self._text(lines.impact(graph, node["id"]))
        rows = render.grouped(reports.impact_rows(graph, node["id"]).orderBy("item").collect(), "part")
        return render.as_json({p: [r["item"] for r in rows.get(p, [])] for p in ("direct", "transitive", "flow", "test")})

    def boundaries(self, as_json: bool = False) -> str:
        if not as_json:
            return self._text(lines.boundaries(self.graph))
        return render.as_json(render.overview_data([], self._listed(relational.boundaries(self.graph)), [])["boundaries"])

    def events(self, as_json: bool = False) -> str:
        if not as_json:
            return self._text(lines.events(self.graph))
        return render.as_json(render.overview_data([], [], self._events(self.graph))["events"])

    def code(self, symbol: str) -> str:
        node = self._one(self.graph, symbol)
        source = self.spark.read.text(f"{self.root}/{node['file']}", wholetext=True).select(F.col("value").alias("text"))
        row = reports.code_slices(source.withColumns({c: F.lit(node[c]) for c in ("line_start", "line_end")})).first()
        return f"# {node['file']}:{row['first']}-{node['line_end']}\n\n{row['code']}"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="weftgraph", description="Queries over a project's code knowledge graph")
    out.add_argument("--project", default=".", help="the project's folder")
    own = out.add_subparsers(dest="command", required=True)
    for name in ("init", "build", "update", "populate"):
        own.add_parser(name)
    check = own.add_parser("lint")
    check.add_argument("--strict", action="store_true", help="warnings fail too")
    check.add_argument("--use-config", action="store_true", help="heed lint.strict and lint.ignore")
    check.add_argument("--json", action="store_true")
    for name, argument in (
        ("overview", None), ("flows", None), ("boundaries", None), ("events", None), ("flow", "name"), ("context", "symbol"), ("callers", "symbol"), ("callees", "symbol"), ("impact", "symbol")
    ):
        command = own.add_parser(name)
        if argument:
            command.add_argument(argument)
        command.add_argument("--json", action="store_true")
    way = own.add_parser("trace")
    way.add_argument("flow")
    way.add_argument("--to", required=True, help="the boundary")
    way.add_argument("--json", action="store_true")
    own.add_parser("code").add_argument("symbol")
    return out


def run(args: argparse.Namespace, spark: SparkSession) -> tuple[str, int]:
    """(what to print, exit code)."""
    commands = Commands(spark, str(Path(args.project).resolve()))
    try:
        if args.command == "lint":
            text, clean = commands.lint(args.strict, args.use_config, args.json)
            return text, int(not clean)
        given = {k: v for k, v in vars(args).items() if k not in ("project", "command", "json")}
        if "json" in vars(args):
            given["as_json"] = args.json
        return getattr(commands, args.command)(**given), 0
    except (Failure, StoreError, configs.ConfigError) as bad:
        return str(bad), 1


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("weftgraph").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    text, code = run(args, spark)
    print(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
