"""A graph on disk: a folder of Parquet tables, and a log of versions of the graph.

Tables lie in parts by the file in a row's own id: an edge's is its source's, and a second
copy of the edges has them by their targets. A write leaves files as they are: it puts the
rows of the parts that it changes into new folders (what only adds rows is laid beside the
part's folders) and then writes a version, which names every folder of every part.

Versions are numbered, and a version's file is made only if there is none of its number, in
one step: of two writers one makes version n + 1, and the other finds it taken. If what that
one read and replaced hasn't changed meanwhile, its folders go into version n + 2; else its
change is made anew from the version that it missed. A reader meets all of a write or nothing
of it. The KEPT latest versions stay for their readers; what only older ones name goes.

Event edges are kept as hubs, see `Graph`: as many rows as tags, not one a pair.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import Graph, event_hubs, is_hub, with_pairs
from ..schema import EDGES, KEYS, META, SCHEMA_VERSION, TABLES
from .shared import saved

#: Versions of a graph that stay on disk.
KEPT = 4
#: Parts of each table of a new graph.
PARTS = 16
#: Folders of a part from which on it is written anew as one.
CROWDED = 8
#: Times that a change is made anew because another writer was faster.
ATTEMPTS = 20

ROWS = ("nodes", "edges", "tags", "external_calls")
HUBS = "source_id string not null, target_id string not null, node_id string not null"
#: Of each stored table, the column whose id's file tells the part.
PLACE = {"nodes": "id", "edges": "source_id", "edges_in": "target_id", "tags": "node_id", "external_calls": "node_id", "hubs": "node_id"}

Key = tuple[str, int]


def part_of(key: Column, parts: int) -> Column:
    """Part of an id, or of a file: all ids of a file share its part."""
    return F.pmod(F.xxhash64(file_in(key)), F.lit(parts)).cast("int")


def file_in(key: Column) -> Column:
    return F.substring_index(key, "::", 1)


class StoreError(RuntimeError):
    pass


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old and new by keys, the last row winning: new over old, within new the greatest `order`, or else the row that stands last."""
    columns = old.columns
    own = old.select(*columns, F.lit(-1).cast("long").alias("_seq"))
    more = new.select(*columns, (F.col(order).cast("long") if order else F.monotonically_increasing_id()).alias("_seq"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_seq")))
    return own.unionByName(more).withColumn("_n", best).filter("_n = 1").select(*columns)


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose keys are new."""
    return old.unionByName(_fresh(old, new, keys))


def _fresh(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return new.select(*old.columns).dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns)


def _without(rows: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """rows none of whose columns is an id in gone."""
    for c in columns:
        rows = rows.join(gone, rows[c] == gone["id"], "left_anti")
    return rows


def without_file(graph: Graph, file: str) -> Graph:
    """The graph without a file's nodes, their tags and external calls, and all edges that touch them."""
    gone = graph.nodes.filter(F.col("file") == file).select("id")
    left = {t: _without(getattr(graph, t), gone, "node_id") for t in ("tags", "external_calls")} | {"nodes": graph.nodes.filter(F.col("file") != file)}
    if graph.hubs is None:
        return Graph(edges=_without(graph.edges, gone, "source_id", "target_id"), **left)
    direct, hubs = (_without(rows, gone, "source_id", "target_id") for rows in (graph.direct, graph.hubs))  # pairs are made of the ends that stay
    return Graph(edges=with_pairs(direct, hubs), hubs=hubs, direct=direct, **left)


@dataclass(frozen=True)
class Version:
    number: int
    parts: int
    folders: dict[Key, tuple[str, ...]]
    strays: bool = False  # has any node another file than its id

    def of(self, table: str, parts: Iterable[int] | None = None) -> list[str]:
        """Folders of a table, or of some of its parts."""
        wanted = None if parts is None else set(parts)
        return [f for (t, p), folders in sorted(self.folders.items()) if t == table and (wanted is None or p in wanted) for f in folders]

    def held(self, table: str) -> set[int]:
        return {p for t, p in self.folders if t == table}


@dataclass
class Change:
    """What a write does to the parts of the version it has read."""

    replaced: dict[Key, tuple[str, ...]] = field(default_factory=dict)
    added: dict[Key, tuple[str, ...]] = field(default_factory=dict)
    read: set[Key] = field(default_factory=set)
    whole: set[str] = field(default_factory=set)  # tables of which all parts were read or replaced
    strays: bool = False

    def clashes(self, base: Version, now: Version) -> bool:
        seen = self.read | set(self.replaced) | {k for v in (base, now) for k in v.folders if k[0] in self.whole}
        return any(base.folders.get(k) != now.folders.get(k) for k in seen)

    def onto(self, now: Version) -> Version:
        folders = {k: f for k, f in now.folders.items() if k[0] not in self.whole} | self.replaced
        for k, more in self.added.items():
            folders[k] = folders.get(k, ()) + more
        return Version(now.number + 1, now.parts, {k: f for k, f in folders.items() if f}, now.strays or self.strays)

    def made(self) -> set[str]:
        return {f for folders in (self.replaced, self.added) for fs in folders.values() for f in fs}


class StoredGraph(Graph):
    """A version of a graph on disk: what is asked of one id is read from the parts that can hold it."""

    def _near(self, table: str, node_id: str) -> DataFrame:
        store, version = self.source
        return store.rows_of(version, table, [store.part_of_id(node_id, version.parts)])

    def node_rows(self, node_id: str) -> DataFrame:
        return self._near("nodes", node_id).filter(F.col("id") == node_id)

    def direct_from(self, node_id: str) -> DataFrame:
        return self._near("edges", node_id).filter(F.col("source_id") == node_id)

    def direct_into(self, node_id: str) -> DataFrame:
        return self._near("edges_in", node_id).filter(F.col("target_id") == node_id)


class GraphStore:
    """Reads and writes the tables below `path`; parts: of a new graph's tables, more for larger graphs."""

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.spark, self.path, self._wanted = spark, path.rstrip("/"), parts

    # --- versions ---

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def exists(self) -> bool:
        return bool(self.versions())

    def versions(self) -> list[int]:
        """Numbers of the versions on disk, in order."""
        fs, to = self._fs()
        folder = to(f"{self.path}/log")
        if not fs.exists(folder):
            if fs.exists(to(f"{self.path}/versions")):
                raise StoreError(f"Graph at {self.path} was written without a log of versions: build it anew in an empty folder")
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def version(self, number: int | None = None) -> Version:
        """A version, the latest if not told; number 0, which has no rows, before there is one."""
        if number is None:
            numbers = self.versions()
            number = numbers[-1] if numbers else 0
        if number == 0:
            return Version(0, self._wanted, {})
        fs, to = self._fs()
        stream = fs.open(to(f"{self.path}/log/{number:012d}.json"))
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(number, found["parts"], {(t, p): tuple(f) for t, p, f in found["folders"]}, found["strays"])

    def _publish(self, version: Version) -> bool:
        """Makes a version's file, whole at once, unless there is one of its number."""
        fs, to = self._fs()
        jvm = self.spark._jvm
        target, draft = to(f"{self.path}/log/{version.number:012d}.json"), to(f"{self.path}/log/.draft-{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        text = json.dumps({"parts": version.parts, "strays": version.strays, "folders": [[t, p, f] for (t, p), f in sorted(version.folders.items())]})
        out = fs.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if fs.getScheme() == "file":  # whose rename isn't exclusive: a second name for a file is
                path = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(path(target), path(draft))
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
                files.rename(fs.makeQualified(draft), fs.makeQualified(target), none)
        except Py4JJavaError as error:
            if fs.exists(target) and "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        finally:
            fs.delete(draft, False)
        return True

    def _commit(self, change: Callable[[Version], Change]) -> None:
        """A new version by a change, which is made anew if another writer's version gets in its way."""
        for _ in range(ATTEMPTS):
            base = now = self.version()
            made = change(base)
            while not made.clashes(base, now):
                new = made.onto(now)
                if self._publish(new):
                    self._forget(new)
                    return
                now = self.version()
            self._drop(made.made())
        raise StoreError(f"Graph at {self.path}: {ATTEMPTS} times another writer was faster")

    def _drop(self, folders: set[str], in_use: set[str] = frozenset()) -> None:
        """Removes parts' folders, and what held them if nothing of it is in use."""
        fs, to = self._fs()
        held = {f.rsplit("/", 1)[0] for f in in_use}
        for folder in {f if f.rsplit("/", 1)[0] in held else f.rsplit("/", 1)[0] for f in folders}:
            fs.delete(to(f"{self.path}/{folder}"), True)

    def _forget(self, new: Version) -> None:
        """Removes all versions but the KEPT latest, and the folders that only they name."""
        fs, to = self._fs()
        numbers = [n for n in self.versions() if n <= new.number]
        old, kept = numbers[:-KEPT], numbers[-KEPT:]
        if not old:
            return
        in_use = {f for n in kept for folders in self.version(n).folders.values() for f in folders}
        for number in old:
            try:
                named = {f for folders in self.version(number).folders.values() for f in folders}
            except Py4JJavaError:  # another writer has removed it
                continue
            self._drop(named - in_use, in_use)
            fs.delete(to(f"{self.path}/log/{number:012d}.json"), False)

    # --- reading ---

    def parts(self) -> int:
        """Into how many parts the tables are divided."""
        return self.version().parts

    def part_of_id(self, node_id: str, parts: int) -> int:
        return self.spark.range(1).select(part_of(F.lit(node_id), parts).alias("part")).first()["part"]

    def _schema(self, table: str):
        return HUBS if table == "hubs" else EDGES if table == "edges_in" else TABLES[table]

    def rows_of(self, version: Version, table: str, parts: Iterable[int] | None = None) -> DataFrame:
        """A stored table of a version, or some of its parts."""
        return self._in(table, version.of(table, parts))

    def _in(self, table: str, folders: Iterable[str]) -> DataFrame:
        folders = list(folders)
        if not folders:
            return self.spark.createDataFrame([], self._schema(table))
        return self.spark.read.schema(self._schema(table)).parquet(*[f"{self.path}/{f}" for f in folders])

    def _open(self, version: Version) -> StoredGraph:
        tables = {t: self.rows_of(version, t) for t in ROWS}
        if not version.of("hubs"):
            return StoredGraph(**tables, source=(self, version))
        hubs, direct = self.rows_of(version, "hubs").select("source_id", "target_id"), tables.pop("edges")
        return StoredGraph(**tables, edges=with_pairs(direct, hubs), hubs=hubs, direct=direct, source=(self, version))

    def _present(self) -> Version:
        version = self.version()
        if not version.number:
            raise StoreError(f"No graph at {self.path}: build it first")
        return version

    def read(self, table: str) -> DataFrame:
        version = self._present()
        return self.rows_of(version, "meta") if table == "meta" else getattr(self._open(version), table)

    def meta(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.read("meta").collect()}

    def open(self) -> Graph:
        """The graph of the latest version, if its schema version is ours."""
        version = self._present()
        schema = {r["key"]: r["value"] for r in self.rows_of(version, "meta").collect()}.get("schema_version")
        if schema != SCHEMA_VERSION:
            raise StoreError(f"Graph at {self.path} has schema version {schema}, not {SCHEMA_VERSION}: rebuild it")
        return self._open(version)

    # --- writing ---

    def _write(self, table: str, rows: DataFrame, parts: int, place: str | None = None) -> dict[Key, tuple[str, ...]]:
        """The rows in a new folder a part. A large part is dealt to several tasks, by its size: ids of a graph may nearly all be of one file."""
        folder = f"{table}/{uuid.uuid4().hex}"
        part = F.lit(0) if table == "meta" else part_of(F.col(place or PLACE[table]), parts)
        rows = rows.withColumn("_part", part)
        if table != "meta":
            rows = rows.hint("rebalance", "_part")
        rows.write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        return {(table, p): (f"{folder}/_part={p}",) for p in self._written(folder)}

    def _written(self, folder: str) -> list[int]:
        fs, to = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(to(f"{self.path}/{folder}"))]
        return [int(n.split("=")[1]) for n in names if n.startswith("_part=")]

    def _fit(self, table: str, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in TABLES["edges" if table == "edges_in" else table]])

    def _staged(self, table: str, rows: DataFrame, parts: int) -> tuple[DataFrame, set[int]]:
        """Rows to come, written once so that a change can be made anew from them, and their parts."""
        rows = saved(rows.withColumn("_part", part_of(F.col(PLACE[table]), parts)), "staged")
        return rows.drop("_part"), {r["_part"] for r in rows.select("_part").distinct().collect()}

    def _replacing(self, table: str, rows: DataFrame, parts: int, which: Iterable[int]) -> dict[Key, tuple[str, ...]]:
        """These parts are now these rows; a part without any has no folder."""
        return {(table, p): () for p in which} | self._write(table, rows, parts)

    def create(self) -> None:
        """Empty tables where there are none; an existing store stays as it is."""
        if not self.exists():
            rows = self.spark.createDataFrame([("schema_version", SCHEMA_VERSION)], META)
            # a clash: another writer has created it
            made = Change(replaced=self._write("meta", rows.coalesce(1), self._wanted))
            if not self._publish(made.onto(Version(0, self._wanted, {}))):
                self._drop(made.made())

    def set_meta(self, key: str, value: str) -> None:
        self._set_meta({key: value})

    def _set_meta(self, entries: dict[str, str]) -> None:
        self._commit(lambda base: Change(replaced=self._meta_after(base, entries)))

    def _meta_after(self, base: Version, entries: dict[str, str]) -> dict[Key, tuple[str, ...]]:
        rows = upserted(self.rows_of(base, "meta"), self.spark.createDataFrame(list(entries.items()), META), KEYS["meta"])
        return {("meta", 0): ()} | self._write("meta", rows.coalesce(1), base.parts)

    def clear(self) -> None:
        self._commit(lambda _: Change(whole=set(PLACE)))

    def insert_nodes(self, rows: DataFrame, order: str | None = None) -> None:
        """Nodes over those of the same ids; only the parts that hold an id of `rows` are written."""
        parts = self.parts()
        seq = F.col(order).cast("long") if order else F.monotonically_increasing_id()
        staged, which = self._staged("nodes", rows.withColumn("_seq", seq), parts)

        def change(base: Version) -> Change:
            old = self.rows_of(base, "nodes", which)
            new = self._fit("nodes", upserted(old, staged, KEYS["nodes"], "_seq"))
            seen = Observation()
            made = self._replacing("nodes", new.observe(seen, F.coalesce(F.max(F.col("file") != file_in(F.col("id"))), F.lit(False)).alias("strays")), base.parts, which)
            return Change(replaced=made, strays=bool(which) and seen.get["strays"])

        self._commit(change)

    def _insert(self, table: str, rows: DataFrame, check: Callable[[Version, DataFrame, set[int]], None] | None = None) -> None:
        """Rows whose keys are new, laid beside their parts' folders."""
        staged, which = self._staged(table, self._fit(table, rows), self.parts())

        def change(base: Version) -> Change:
            made = Change(read={(table, p) for p in which})
            if check:
                check(base, staged, which)
                made.read |= {("nodes", p) for p in which}
            made.added = self._write(table, _fresh(self.rows_of(base, table, which), staged, KEYS[table]), base.parts)
            if table == "edges":
                made.added |= self._write("edges_in", self._in("edges", [f for fs in made.added.values() for f in fs]), base.parts)
            return made

        self._commit(change)
        self._uncrowd()

    def insert_edges(self, rows: DataFrame) -> None:
        self._insert("edges", rows)

    def insert_tags(self, rows: DataFrame) -> None:
        """Tags of unknown nodes are refused, all or nothing."""
        self._insert("tags", rows, lambda base, staged, which: self._known(staged, self.rows_of(base, "nodes", which)))

    def insert_external_calls(self, rows: DataFrame) -> None:
        self._insert("external_calls", rows)

    def _known(self, tags: DataFrame, nodes: DataFrame) -> None:
        """Refuses tags of unknown nodes. Looked for by an aggregate over all partitions: a first row of an anti join would be sought in one task."""
        ids = nodes.select(F.col("id").alias("node_id"), F.lit(True).alias("_known"))
        stray = tags.select("node_id").distinct().join(ids, "node_id", "left").filter("_known IS NULL").agg(F.min("node_id").alias("node_id")).first()
        if stray["node_id"] is not None:
            raise StoreError(f"Tag on a node that isn't in the graph: {stray['node_id']}")

    def _uncrowd(self) -> None:
        """Writes parts of many folders anew as one folder each."""
        crowded = {t: {p for (table, p), f in self.version().folders.items() if table == t and len(f) > CROWDED} for t in PLACE}

        def change(base: Version) -> Change:
            made = Change()
            for table, which in crowded.items():
                if which:
                    made.replaced |= self._replacing(table, self.rows_of(base, table, which), base.parts, which)
            return made

        if any(crowded.values()):
            self._commit(change)

    def _nodes_of(self, base: Version, files: DataFrame) -> tuple[DataFrame, set[int], set[int]]:
        """Ids of these files' nodes (file), the parts of the ids, and the parts in which they were sought."""
        own = {r["part"] for r in files.select(part_of(F.col("file"), base.parts).alias("part")).distinct().collect()}
        sought = base.held("nodes") if base.strays else own
        ids = saved(self.rows_of(base, "nodes", sought).join(F.broadcast(files) if not base.strays else files, "file", "left_semi").select("id"), "gone")
        return ids, {r["part"] for r in ids.select(part_of(F.col("id"), base.parts).alias("part")).distinct().collect()}, sought

    def _parts_met(self, edges: DataFrame, column: str, parts: int) -> set[int]:
        return {r["part"] for r in edges.select(part_of(F.col(column), parts).alias("part")).distinct().collect()}

    def delete_file_data(self, file: str) -> None:
        """A file's nodes, their tags and external calls, and all edges that touch them go, from the parts that hold any."""
        files = self.spark.createDataFrame([(file,)], "file string")

        def change(base: Version) -> Change:
            gone, own, sought = self._nodes_of(base, files)
            made = Change(read={("nodes", p) for p in sought})
            if not own:
                return made
            leaving = self.rows_of(base, "edges", own).join(gone, F.col("source_id") == gone["id"], "left_semi")
            entering = self.rows_of(base, "edges_in", own).join(gone, F.col("target_id") == gone["id"], "left_semi")
            by_source = own | self._parts_met(entering, "source_id", base.parts)
            by_target = own | self._parts_met(leaving, "target_id", base.parts)
            made.read |= {("edges", p) for p in own} | {("edges_in", p) for p in own}
            for table, which, columns in (
                ("nodes", own, ("id",)), ("tags", own, ("node_id",)), ("external_calls", own, ("node_id",)), ("hubs", own, ("node_id",)),
                ("edges", by_source, ("source_id", "target_id")), ("edges_in", by_target, ("source_id", "target_id")),
            ):
                held = which & base.held(table)
                if held:
                    made.replaced |= self._replacing(table, _without(self.rows_of(base, table, held), gone, *columns), base.parts, held)
            return made

        self._commit(change)

    def replace_files(self, files: DataFrame, new: Graph, **meta: str) -> None:
        """What the graph knows of these files (file) goes, and `new` comes, in one version; event hubs follow.

        Edges into the files from others stay: what they call keeps its id, or dangles until it is
        back. Tags without a node are left out. Only parts are written that hold something of the
        files, and of edges by their targets those that they call.
        """
        parts = self.parts()
        staged = {t: self._staged(t, self._fit(t, getattr(new, t)).dropDuplicates(KEYS[t]), parts) for t in ROWS}
        coming = set().union(*[which for _, which in staged.values()])

        def change(base: Version) -> Change:
            gone, own, sought = self._nodes_of(base, files)
            own = own | coming
            made = Change(read={("nodes", p) for p in sought})
            if meta:
                made.replaced |= self._meta_after(base, meta)
            if not own:
                return made
            after = {}
            for table in ROWS:
                column = PLACE[table]
                after[table] = saved(_without(self.rows_of(base, table, own), gone, column).unionByName(staged[table][0]).dropDuplicates(KEYS[table]), table)
            after["tags"] = after["tags"].join(after["nodes"].select(F.col("id").alias("node_id")), "node_id", "left_semi").select(*TABLES["tags"].names)
            seen = Observation()
            nodes = after["nodes"].observe(seen, F.coalesce(F.max(F.col("file") != file_in(F.col("id"))), F.lit(False)).alias("strays"))
            for table in ROWS:
                made.replaced |= self._replacing(table, nodes if table == "nodes" else after[table].filter("kind <> 'event'") if table == "edges" else after[table], base.parts, own)
            made.strays = bool(seen.get["strays"])
            made.replaced |= self._replacing("hubs", event_hubs(after["tags"]), base.parts, own)
            leaving = self.rows_of(base, "edges", own).join(gone, F.col("source_id") == gone["id"], "left_semi")
            by_target = self._parts_met(leaving.select("target_id").unionByName(staged["edges"][0].select("target_id")), "target_id", base.parts)
            if by_target:
                old = _without(self.rows_of(base, "edges_in", by_target), gone, "source_id")
                made.replaced |= self._replacing("edges_in", old.unionByName(staged["edges"][0]).filter("kind <> 'event'").dropDuplicates(KEYS["edges"]), base.parts, by_target)
            return made

        self._commit(change)

    def synthesize_event_edges(self) -> None:
        """Event edges anew from the tags: hubs of all parts, and edges of the kind that stand as pairs go."""

        def change(base: Version) -> Change:
            made = Change(whole={"hubs"}, read={("tags", p) for p in base.held("tags")})
            made.replaced = self._write("hubs", event_hubs(self.rows_of(base, "tags")), base.parts)
            for table in ("edges", "edges_in"):
                which = self._parts_met(self.rows_of(base, table).filter("kind = 'event'"), PLACE[table], base.parts)
                if which:
                    made.replaced |= self._replacing(table, self.rows_of(base, table, which).filter("kind <> 'event'"), base.parts, which)
            return made

        self._commit(change)

    def replace(self, graph: Graph, **meta: str) -> None:
        """All tables in one version, with keys made unique (of nodes the row that stands last stays), and entries of meta.

        Tags of unknown nodes are refused.
        """
        self._known(graph.tags, graph.nodes)
        nodes = upserted(self.spark.createDataFrame([], TABLES["nodes"]), graph.nodes, KEYS["nodes"])
        edges = self._fit("edges", graph.edges if graph.hubs is None else graph.direct).dropDuplicates(KEYS["edges"])
        if graph.hubs is not None:
            edges = edges.filter("kind <> 'event'")

        def change(base: Version) -> Change:
            made = Change(whole=set(PLACE))
            seen = Observation()
            rows = self._fit("nodes", nodes).observe(seen, F.coalesce(F.max(F.col("file") != file_in(F.col("id"))), F.lit(False)).alias("strays"))
            made.replaced = self._write("nodes", rows, base.parts)
            made.strays = bool(seen.get["strays"])
            for table in ("tags", "external_calls"):
                made.replaced |= self._write(table, self._fit(table, getattr(graph, table)).dropDuplicates(KEYS[table]), base.parts)
            made.replaced |= self._write("edges", edges, base.parts)
            made.replaced |= self._write("edges_in", self._in("edges", [f for (t, _), fs in made.replaced.items() if t == "edges" for f in fs]), base.parts)
            if graph.hubs is not None:
                node_id = F.when(is_hub(F.col("source_id")), F.col("target_id")).otherwise(F.col("source_id"))
                made.replaced |= self._write("hubs", graph.hubs.select("source_id", "target_id", node_id.alias("node_id")), base.parts)
            if meta:
                made.replaced |= self._meta_after(base, meta)
            return made

        self._commit(change)
