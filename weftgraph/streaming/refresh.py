"""Incremental refresh: a stream of changed files replaces what the graph knows of them.

Each micro-batch holds (file, language, text, symbols, calls, version) of changed files. Their
nodes, tags, edges and external calls go, what the batch has of them comes, and the hubs of
their events follow, in one version of the store, which also names the batch: one that is
delivered again finds its number there and is passed over. Only parts of the store are written
that hold something of these files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..plans.build import extract
from ..sources import symbols
from ..sources.config import Config
from ..sources.shared import saved
from ..sources.store import GraphStore

#: A changed file; calls: JSON array of {source, calls}, source a symbol's qualified name; version: the greater is the later.
CHANGES = "file string, language string, text string, symbols string, calls string, version long"
_CALLS = "array<struct<source: string, calls: string>>"


def apply_changes(store: GraphStore, batch: DataFrame, project: str, config: Config, mark: str | None = None) -> None:
    """One micro-batch. Of several versions of a file in it the latest counts; of equal ones that with the greatest text.

    A file without text and symbols is gone. mark: the batch's name; the store keeps that of the
    last batch, which isn't applied again.
    """
    if mark is not None and store.meta().get("refreshed") == mark:
        return
    version = F.col("version") if "version" in batch.columns else F.lit(0)
    last = F.row_number().over(Window.partitionBy("file").orderBy(F.desc_nulls_last(version), F.desc_nulls_last("text"), F.desc_nulls_last("symbols"), F.desc_nulls_last("calls")))
    batch = saved(batch.withColumn("_nth", last).filter("_nth = 1").drop("_nth"), "changes")
    named = symbols.symbol_nodes(batch.filter("symbols IS NOT NULL").select("file", "language", "symbols"))
    each = batch.select("file", F.explode(F.from_json("calls", _CALLS)).alias("c"))
    each = each.select(F.concat("file", F.lit("::"), F.col("c.source")).alias("source_id"), F.col("c.calls").alias("calls"))
    call_dump = each.join(named.select(F.col("id").alias("source_id"), "kind", "language"), "source_id").select("source_id", "kind", "language", "calls")
    none = batch.sparkSession.createDataFrame([], "target_id string, refs string")
    new, _ = extract(batch.select("file", "language", "text"), batch.filter("symbols IS NOT NULL").select("file", "language", "symbols"), call_dump, none, project, config)
    store.replace_files(batch.select("file"), new, **({} if mark is None else {"refreshed": mark}))


def refresh(changes: DataFrame, store: GraphStore, project: str, config: Config, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the refresh of a store by a streaming DataFrame of CHANGES (`version` may be missing)."""
    apply = lambda batch, number: apply_changes(store, batch, project, config, f"{checkpoint} {number}")
    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
