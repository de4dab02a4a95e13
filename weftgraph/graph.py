"""A graph: its tables as DataFrames.

Event edges lead from each emitter of a value to each of its handlers. A graph may hold them
as hubs: an edge from every emitter to the value's hub, and one from there to every handler,
which are as many as the tags. Closures and paths go through hubs; pairs are only made where
edges are listed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import FOLLOWED, TABLES
from .sources.shared import bucketed

#: Begins the id of a hub, and no other.
HUB = "\x01event:"
#: Emitters or handlers of a hub in a cell, on average.
CELL = 1_000


def is_hub(id_: Column) -> Column:
    return F.startswith(id_, F.lit(HUB))


def event_hubs(tags: DataFrame) -> DataFrame:
    """source_id, target_id, node_id: the hubs' edges by the tags, each by the node it belongs to."""
    hub, emits = F.concat(F.lit(HUB), F.col("value")), F.col("kind") == "emits"
    own = tags.filter("kind IN ('emits', 'handles')")
    return own.select(F.when(emits, F.col("node_id")).otherwise(hub).alias("source_id"), F.when(emits, hub).otherwise(F.col("node_id")).alias("target_id"), "node_id").distinct()


def _ends(hubs: DataFrame, emits: bool) -> DataFrame:
    """id, hub, and hubs (all of the id's, in order; null if it has one only) of emitters or of handlers."""
    id_, hub = ("source_id", "target_id") if emits else ("target_id", "source_id")
    rows = hubs.filter(is_hub(F.col(hub))).select(F.col(id_).alias("id"), F.col(hub).alias("hub")).distinct()
    every = rows.groupBy("id").agg(F.sort_array(F.collect_set("hub")).alias("hubs")).filter(F.size("hubs") > 1)
    return rows.join(every, "id", "left")


def _first_meeting(a: str, b: str) -> Column:
    """Is this hub the least of those that two ends with these hubs share: the one by which they are a pair."""
    return F.col(a).isNull() | F.col(b).isNull() | (F.array_min(F.array_intersect(a, b)) == F.col("hub"))


def _cells(ends: DataFrame, name: str) -> DataFrame:
    """hub, name_cell and name (an array of id and hubs): the ends of each hub, dealt to cells of some CELL."""
    sizes = ends.groupBy("hub").agg(F.ceil(F.count("*") / CELL).alias("_cells"))
    cell = F.pmod(F.xxhash64("id"), F.col("_cells")).alias(f"{name}_cell")
    return ends.join(sizes, "hub").select("hub", cell, F.struct("id", "hubs").alias("_end")).groupBy("hub", f"{name}_cell").agg(F.collect_list("_end").alias(name))


def pairs_of_hubs(hubs: DataFrame) -> DataFrame:
    """Event edges: each emitter of a value to each of its handlers, itself included.

    The ends of a hub are dealt to cells, and pairs made where two cells have been brought
    together: what is shuffled are cells, and a task holds two of them. A pair that several hubs make
    is made by the least of them, so that none has to be dropped afterwards.
    """
    n = int(hubs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _cells(_ends(hubs, True), "emits").join(_cells(_ends(hubs, False), "handles"), "hub").repartition(n, "hub", "emits_cell", "handles_cell")
    pairs = met.select("hub", "handles", F.explode("emits").alias("_from")).select("hub", "_from", F.explode("handles").alias("_to"))
    return pairs.filter(_first_meeting("_from.hubs", "_to.hubs")).select(F.col("_from.id").alias("source_id"), F.col("_to.id").alias("target_id"), F.lit("event").alias("kind"))


def pair_counts(hubs: DataFrame) -> DataFrame:
    """id and n: to how many handlers an emitter has an event edge. Ends with the same hubs are counted together, no pair is made."""

    def kinds(emits: bool) -> tuple[DataFrame, DataFrame]:
        ends = _ends(hubs, emits).select("id", F.coalesce("hubs", F.array("hub")).alias("hubs")).distinct()
        sizes = ends.groupBy("hubs").agg(F.count("*").alias("n"))
        return ends, sizes.withColumn("hub", F.explode("hubs"))

    emitters, own = kinds(True)
    theirs = kinds(False)[1].select("hub", F.col("hubs").alias("_others"), "n")
    met = own.select("hub", "hubs").join(theirs, "hub").filter(_first_meeting("hubs", "_others"))
    return emitters.join(met.groupBy("hubs").agg(F.sum("n").alias("n")), "hubs").select("id", "n")


def with_pairs(direct: DataFrame, hubs: DataFrame) -> DataFrame:
    """All edges of a graph with hubs."""
    return direct.filter("kind <> 'event'").unionByName(pairs_of_hubs(hubs))


@dataclass(frozen=True)
class Graph:
    """edges lists all edges; if there are hubs (source_id, target_id), direct has those that aren't pairs of a hub."""

    nodes: DataFrame
    edges: DataFrame
    tags: DataFrame
    external_calls: DataFrame
    hubs: DataFrame | None = None
    direct: DataFrame | None = None
    source: object = None

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        return cls(*[spark.createDataFrame([], TABLES[t]) for t in ("nodes", "edges", "tags", "external_calls")])

    def with_tables(self, **tables: DataFrame) -> Graph:
        """The graph with other tables; with other edges, its hubs go."""
        own = {"hubs": None, "direct": None} if "edges" in tables else {}
        now = {f: getattr(self, f) for f in ("nodes", "edges", "tags", "external_calls", "hubs", "direct")}
        return Graph(**(now | own | tables))

    def with_hubs(self) -> Graph:
        """The graph with event edges made anew from its tags, as hubs."""
        direct = (self.edges if self.direct is None else self.direct).filter("kind <> 'event'")
        hubs = event_hubs(self.tags).select("source_id", "target_id")
        return replace(self.with_tables(edges=with_pairs(direct, hubs)), hubs=hubs, direct=direct)

    def _followed_only(self, edges: DataFrame) -> DataFrame:
        return edges.filter(F.col("kind").isin(*FOLLOWED))

    @property
    def _listed(self) -> DataFrame:
        """Edges that stand for themselves."""
        return self.edges if self.hubs is None else self.direct.filter("kind <> 'event'")

    @cached_property
    def followed(self) -> DataFrame:
        """Edges that closures and paths follow, of all followed kinds (a bag of pairs)."""
        return self._followed_only(self.edges)

    def size(self) -> DataFrame:
        """edges: how many there are, in one row; pairs of events are counted, not made."""
        if self.hubs is None:
            return self.edges.agg(F.count("*").alias("edges"))
        counts = self._listed.agg(F.count("*").alias("n")).unionByName(pair_counts(self.hubs).agg(F.sum("n").alias("n")))
        return counts.agg(F.sum("n").alias("edges"))

    def callees(self) -> DataFrame:
        """id and callees: how many followed edges leave it; pairs of events are counted, not made."""
        rows = self._followed_only(self._listed).groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n"))
        if self.hubs is not None:
            rows = rows.unionByName(pair_counts(self.hubs))
        return rows.groupBy("id").agg(F.sum("n").alias("callees"))

    def sources(self) -> DataFrame:
        """id of what has a followed edge; no pair of an event is made."""
        rows = self._followed_only(self._listed).select(F.col("source_id").alias("id"))
        if self.hubs is None:
            return rows
        emits = self.hubs.filter(is_hub(F.col("target_id"))).select(F.col("source_id").alias("id"), F.col("target_id").alias("_hub"))
        handled = self.hubs.filter(is_hub(F.col("source_id"))).select(F.col("source_id").alias("_hub")).distinct()
        return rows.unionByName(emits.join(handled, "_hub", "left_semi").select("id"))

    def _steps(self) -> DataFrame:
        """(source_id, target_id) of followed edges, through hubs if there are any: from a copy in buckets, if there is one by now."""
        for made in ("steps_on", "steps_back"):
            if made in self.__dict__:
                return self.__dict__[made]
        rows = self._followed_only(self._listed).select("source_id", "target_id")
        return rows if self.hubs is None else rows.unionByName(self.hubs)

    @cached_property
    def steps_on(self) -> DataFrame:
        """The steps in buckets by their source, written once: every round of a closure reads them, and none shuffles them."""
        return bucketed(self._steps(), "source_id", "steps-on")

    @cached_property
    def steps_back(self) -> DataFrame:
        """The steps in buckets by their target."""
        return bucketed(self._steps(), "target_id", "steps-back")

    # --- what is asked of one id ---

    def node_rows(self, node_id: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node_id)

    def direct_from(self, node_id: str) -> DataFrame:
        return self._listed.filter(F.col("source_id") == node_id)

    def direct_into(self, node_id: str) -> DataFrame:
        return self._listed.filter(F.col("target_id") == node_id)

    def edges_from(self, node_id: str) -> DataFrame:
        """Followed edges from a node, once for each kind; of events only the node's own pairs are made."""
        rows = self._followed_only(self.direct_from(node_id)).select("source_id", "target_id", "kind")
        if self.hubs is None:
            return rows
        own = self.hubs.filter(F.col("source_id") == node_id).select(F.col("target_id").alias("_hub"))
        met = self.hubs.filter(is_hub(F.col("source_id"))).join(own, F.col("source_id") == F.col("_hub"), "left_semi").select("target_id").distinct()
        return rows.filter("kind <> 'event'").unionByName(met.select(F.lit(node_id).alias("source_id"), "target_id", F.lit("event").alias("kind")))

    def edges_into(self, node_id: str) -> DataFrame:
        """Followed edges to a node."""
        rows = self._followed_only(self.direct_into(node_id)).select("source_id", "target_id", "kind")
        if self.hubs is None:
            return rows
        own = self.hubs.filter(F.col("target_id") == node_id).select(F.col("source_id").alias("_hub"))
        met = self.hubs.filter(is_hub(F.col("target_id"))).join(own, F.col("target_id") == F.col("_hub"), "left_semi").select("source_id").distinct()
        return rows.filter("kind <> 'event'").unionByName(met.select("source_id", F.lit(node_id).alias("target_id"), F.lit("event").alias("kind")))
