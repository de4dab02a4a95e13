"""Transitive closures: what is new moves over the edges until nothing is.

Each round joins what the last one found with the edges and drops what was known before, so
cycles end and each node is expanded once for what reaches it. Edges lie in buckets by the
end that is joined, so that a round shuffles what it has found and no edge. Of many labels
(flows, entries) 64 share a row: its bits say which of them reach the id, and a round passes
only the bits that an id didn't have yet. Rounds are written to the shared folder, and go
when the result has been written. Ids without a node are expanded too, and leave only where
nodes are joined; hubs of events are passed through and leave at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import Graph, is_hub
from ..sources.shared import Scratch, saved

#: Labels that share a row: the bits of a long.
BITS = 64
#: Rows of a frontier from which on its rows are hashed to be joined, and up to which, a bucket: some 0.1 KB each.
HASHED = (50_000, 5_000_000)


def closure(graph: Graph, seeds: DataFrame, reverse: bool = False) -> DataFrame:
    """id of everything reachable from the seeds (id), themselves included."""
    steps, here, there = _steps(graph, reverse)
    with Scratch(seeds.sparkSession) as rounds:
        fresh, n = rounds.counted(seeds.select("id").distinct(), "frontier")
        seen = fresh
        while n:
            met = steps.join(_hashed(fresh, n), steps[here] == fresh["id"]).select(F.col(there).alias("id")).distinct()
            fresh, n = rounds.counted(met.join(seen, "id", "left_anti"), "frontier")
            seen = seen.unionByName(fresh)
        return saved(seen.filter(~is_hub(F.col("id"))), "closure")


def labelled_closure(graph: Graph, seeds: DataFrame, label: str, reverse: bool = False) -> DataFrame:
    """label and id of everything reachable from the label's seeds (label, id), themselves included."""
    reached, names = labelled_bits(graph, seeds, label, reverse)
    each = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda p: F.getbit(F.col("bits"), p) == 1)
    numbers = reached.select("id", "word", F.explode(each).alias("_bit")).select("id", (F.col("word") * BITS + F.col("_bit")).alias("_number"))
    return numbers.join(names, "_number").select(label, "id")


def labelled_bits(graph: Graph, seeds: DataFrame, label: str, reverse: bool = False, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The labelled closure, 64 labels a row: id, word and bits; and label and _number of the labels (names, if they have numbers already), of which word * BITS + bit is one."""
    if names is None:
        names = saved(seeds.select(label).distinct().withColumn("_number", F.monotonically_increasing_id()), "labels")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_number") % BITS).cast("int"))
    start = seeds.join(names, label).groupBy("id", F.shiftright("_number", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    steps, here, there = _steps(graph, reverse)
    with Scratch(seeds.sparkSession) as rounds:
        fresh, n = rounds.counted(start, "bits")
        log = fresh
        while n:
            met = steps.join(_hashed(fresh, n), steps[here] == fresh["id"]).groupBy(F.col(there).alias("id"), "word").agg(F.bit_or("bits").alias("bits"))
            known = log.groupBy("id", "word").agg(F.bit_or("bits").alias("_had"))
            new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(F.col("_had"), F.lit(0).cast("long"))))
            fresh, n = rounds.counted(met.join(known, ["id", "word"], "left").select("id", "word", new.alias("bits")).filter("bits <> 0"), "bits")
            log = log.unionByName(fresh)
        whole = log.filter(~is_hub(F.col("id"))).groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))
        return saved(whole, "closure"), names


def _hashed(fresh: DataFrame, n: int) -> DataFrame:
    """A frontier of n rows, to be hashed by the round's join, which then needs no order of the edges. A small one may be broadcast; of a very large one both sides are sorted."""
    buckets = int(fresh.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return fresh.hint("shuffle_hash") if HASHED[0] <= n <= HASHED[1] * buckets else fresh


def _steps(graph: Graph, reverse: bool) -> tuple[DataFrame, str, str]:
    """The steps in buckets by the end that a round joins, that end and the other."""
    return (graph.steps_back, "target_id", "source_id") if reverse else (graph.steps_on, "source_id", "target_id")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with _number, from 0 without gaps in their order, which must be a total one: no task holds all."""
    ranged = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).collect()  # as many as partitions
    before, firsts = 0, []
    for r in sorted(sizes, key=lambda r: r["_part"]):
        firsts.append((r["_part"], before))
        before += r["_n"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(firsts, "_part long, _first long"))
    own = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("_part", part).join(starts, "_part").withColumn("_number", F.col("_first") + own).drop("_at", "_part", "_first")


def summed(rows: DataFrame, weight: str, *order: str) -> DataFrame:
    """rows with _before, the sum of the weights of all rows before each in their order, which must be a total one: no task holds all."""
    ranged = saved(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = {r["_part"]: r["_n"] for r in ranged.groupBy("_part").agg(F.sum(weight).alias("_n")).collect()}  # as many as partitions
    firsts = [(part, sum(n for other, n in sums.items() if other < part)) for part in sums]
    starts = F.broadcast(rows.sparkSession.createDataFrame(firsts, "_part int, _first long"))
    own = F.sum(weight).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("_own", own).join(starts, "_part").withColumn("_before", F.col("_first") + F.coalesce("_own", F.lit(0))).drop("_own", "_part", "_first")


def flow_seeds(graph: Graph) -> DataFrame:
    return graph.tags.filter("kind = 'flow'").select(F.col("value").alias("flow"), F.col("node_id").alias("id"))


def flow_members(graph: Graph, flow: str) -> DataFrame:
    """Nodes of a flow: its entries and all that they reach."""
    reached = closure(graph, flow_seeds(graph).filter(F.col("flow") == flow))
    return graph.nodes.join(reached, "id", "left_semi")


def flow_membership(graph: Graph) -> DataFrame:
    """(flow, id) for every flow and every id that it reaches."""
    return labelled_closure(graph, flow_seeds(graph), "flow")


def flows_for_node(graph: Graph, node_id: str) -> DataFrame:
    """flow: flows of which an entry reaches the node, found from the node backwards."""
    seeds = graph.tags.sparkSession.createDataFrame([(node_id,)], "id string")
    return flow_seeds(graph).join(closure(graph, seeds, reverse=True), "id", "left_semi").select("flow").distinct()


def impact_ids(graph: Graph, node_id: str) -> DataFrame:
    """Ids upstream of a node; its own only if it is on a cycle."""
    direct = graph.steps_back.filter(F.col("target_id") == node_id).select(F.col("source_id").alias("id"))
    return closure(graph, direct, reverse=True)


def impact(graph: Graph, node_id: str) -> DataFrame:
    """Nodes upstream of a node."""
    return graph.nodes.join(impact_ids(graph, node_id), "id", "left_semi")


def reachable_from_flows(graph: Graph) -> DataFrame:
    """Ids that any flow reaches."""
    return closure(graph, flow_seeds(graph))
