"""Building and refreshing a project's graph.

Symbols, calls and references come as JSON dumps, one row per file or function, as language
servers answer; Python files without a dump are read by their syntax trees. Everything from
the dumps to the written tables is one lazy plan per table.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.relational import synthesize_event_edges
from ..sources import calls, files, python_ast, references, symbols, tags
from ..sources.config import Config
from ..sources.shared import saved
from ..sources.store import GraphStore


#: Languages whose edges come from references alone: their outgoing calls aren't asked for, and they have no external calls.
BY_REFERENCES = ("go",)


@dataclass(frozen=True)
class Stats:
    """Counts before keys are made unique, as extraction found them."""

    files: int
    nodes: int
    edges: int
    tags: int
    milliseconds: int
    unparsed: int = 0


def extract(
    sources: DataFrame, symbol_dump: DataFrame, call_dump: DataFrame, ref_dump: DataFrame, project: str, config: Config, seen: dict[str, Observation] | None = None
) -> tuple[Graph, DataFrame]:
    """The graph (its edges and tags still with repeats), and the tag errors. seen: gets counts (n) of nodes, edges and tags, made as they are written.

    sources: file, language, text. symbol_dump: file, language, symbols. call_dump:
    source_id, kind, language, calls. ref_dump: target_id, refs.
    """
    test_paths = tuple(p for c in config.to_build() for p in c.test_paths)
    seen = {} if seen is None else seen
    nodes = saved(_observed(symbols.symbol_nodes(symbol_dump, test_paths), seen, "nodes"), "symbols")
    found = saved(calls.outgoing_calls(call_dump.filter(~F.col("language").isin(*BY_REFERENCES))), "calls")
    refs = references.located(ref_dump, project)
    edges = saved(_observed(calls.call_edges(found, project).unionByName(references.reference_edges(refs, nodes)), seen, "edges"), "edges")
    scanned = saved(_observed(tags.scan(sources, nodes, config.marker), seen, "tags", F.count_if(F.col("error").isNull())), "tags")
    graph = Graph(
        nodes.drop("ord", "select_line", "select_character"),
        edges,
        scanned.filter("error IS NULL").select("node_id", "kind", "value"),
        calls.external_calls(found, project),
    )
    return graph, scanned.filter("error IS NOT NULL").select("file", "tag_line", "error")


def _observed(rows: DataFrame, seen: dict[str, Observation], name: str, count: Column | None = None) -> DataFrame:
    seen[name] = Observation()
    return rows.observe(seen[name], (F.count(F.lit(1)) if count is None else count).alias("n"))


def project_files(spark: SparkSession, root: str, config: Config, text: bool = False, since: int | None = None) -> DataFrame:
    """path, file (below root), modified, language (and text) of all source files, each once; since: of those modified later only."""
    out = None
    for c in config.to_build():
        for source_root in c.source_roots:
            below = "" if source_root in (".", "") else source_root.strip("/") + "/"
            rows = files.discover(spark, f"{root}/{below}".rstrip("/"), files.EXTENSIONS[c.language], config.exclude, text)
            rows = rows if since is None else files.changed_since(rows, since)
            rows = rows.withColumns({"file": F.concat(F.lit(below), "file"), "language": F.lit(c.language)})
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], "path string, file string, modified long, language string" + ", text string" * text)
    return out.dropDuplicates(["path"])


#: Dump files below a project's store, one JSON record a line.
DUMPS = {
    "symbols": "file string, language string, symbols string",
    "calls": "source_id string, kind string, language string, calls string",
    "refs": "target_id string, refs string",
}


def read_dumps(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The language-server dumps in a folder, <name>.json each; without symbols there are none."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    there = lambda name: path(f"{folder}/{name}.json").getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(f"{folder}/{name}.json"))
    found = {name: spark.read.schema(schema).json(f"{folder}/{name}.json") for name, schema in DUMPS.items() if there(name)}
    return found if "symbols" in found else {}


def _python_dumps(own: DataFrame, listed: DataFrame, project: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbol dump and call dump of Python sources, and the rows of their syntax trees."""
    rows = saved(python_ast.parsed(own), "parsed")
    made = saved(python_ast.dump(rows, listed, project), "python")
    symbol_dump = made.filter("symbols IS NOT NULL").select("file", "language", "symbols")
    named = symbols.symbol_nodes(symbol_dump)
    place = named.select("file", F.col("name").alias("source_name"), F.col("line_start").alias("source_line"), F.col("id").alias("source_id"), "kind", "language")
    call_dump = made.filter("calls IS NOT NULL").select("file", "source_name", "source_line", "calls").join(place, ["file", "source_name", "source_line"])
    return symbol_dump, call_dump.select("source_id", "kind", "language", "calls"), rows


def _digest(listed: DataFrame) -> Column:
    """An aggregate of a listing that tells its files' names, in any order."""
    return F.concat_ws("-", F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("file").cast("decimal(38,0)")), F.lit(0)))


def build(spark: SparkSession, root: str, store: GraphStore, config: Config, dumps: dict[str, DataFrame] | None = None) -> Stats:
    """Indexes all files below root and replaces the store's tables. dumps: by the names in DUMPS, else what the store's folder has.

    Counts are made while tables are written.
    """
    began = time.time()
    project = f"file://{root}"
    seen = {"listed": Observation()}
    found = project_files(spark, root, config)
    listed = saved(found.observe(seen["listed"], F.count(F.lit(1)).alias("n"), _digest(found).alias("digest")), "files")
    sources = saved(project_files(spark, root, config, text=True).select("file", "language", "text"), "sources")
    dumps = read_dumps(spark, f"{store.path}/dumps") if dumps is None else dumps
    own = sources.filter("language = 'python'")
    if "symbols" in dumps:
        own = own.join(dumps["symbols"].select("file"), "file", "left_anti")
    symbol_dump, call_dump, rows = _python_dumps(own, listed, project)
    ref_dump = spark.createDataFrame([], "target_id string, refs string")
    if dumps:
        symbol_dump = symbol_dump.unionByName(dumps["symbols"].select("file", "language", "symbols"))
        call_dump = call_dump.unionByName(dumps["calls"].select("source_id", "kind", "language", "calls")) if "calls" in dumps else call_dump
        ref_dump = dumps.get("refs", ref_dump)
    graph, _ = extract(sources, symbol_dump, call_dump, ref_dump, project, config, seen)
    store.create()
    store.replace(synthesize_event_edges(graph), last_build=str(int(began * 1000)), files=seen["listed"].get["digest"])
    unparsed = rows.filter("error IS NOT NULL").count()
    return Stats(*[seen[t].get["n"] for t in ("listed", "nodes", "edges", "tags")], round((time.time() - began) * 1000), unparsed)


def update(spark: SparkSession, root: str, store: GraphStore, config: Config) -> tuple[int, int, int]:
    """(changed files, all files, milliseconds).

    If files were modified, none came or went, no dumps are involved and they are at most
    files.REBUILD hundredths of all, they alone are read again, and their parts of the store
    written; what others call in them keeps its id. Else, or without a sound earlier build,
    everything is built anew.
    """
    began = time.time()
    meta = {}
    if store.exists():
        try:
            store.open()
            meta = store.meta()
            int(meta.get("last_build", ""))
        except (RuntimeError, ValueError):
            meta = {}
    listed = saved(project_files(spark, root, config), "files")
    if not meta:
        total = listed.count()
        build(spark, root, store, config)
        return total, total, round((time.time() - began) * 1000)
    share = files.changed_share(listed, int(meta["last_build"])).first()
    same = listed.agg(_digest(listed).alias("d")).first()["d"] == meta.get("files")
    if not same or (share["changed"] and (share["whole"] or read_dumps(spark, f"{store.path}/dumps"))):
        build(spark, root, store, config)
    elif share["changed"]:
        _rebuild_files(spark, root, store, config, listed, int(meta["last_build"]), began)
    return int(share["changed"]), int(share["total"]), round((time.time() - began) * 1000)


def _rebuild_files(spark: SparkSession, root: str, store: GraphStore, config: Config, listed: DataFrame, since: int, began: float) -> None:
    project = f"file://{root}"
    sources = saved(project_files(spark, root, config, text=True, since=since).select("file", "language", "text"), "sources")
    symbol_dump, call_dump, _ = _python_dumps(sources.filter("language = 'python'"), listed, project)
    graph, _ = extract(sources, symbol_dump, call_dump, spark.createDataFrame([], "target_id string, refs string"), project, config)
    store.replace_files(sources.select("file"), graph, last_build=str(int(began * 1000)))
