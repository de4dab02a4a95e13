"""The five graph tables: schemas, kinds and keys."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, IntegerType, MapType, StringType, StructField, StructType

SCHEMA_VERSION = "2"

# The kinds of nodes, edges and tags.
NODE_KINDS = ("function", "method", "class", "type", "module")
EDGE_KINDS = ("calls", "imports", "implements", "contains", "event")
TAG_KINDS = ("flow", "boundary", "emits", "handles")
#: Edges that flows, impact and paths follow.
FOLLOWED = ("calls", "event")
CALLABLE = ("function", "method")


def _strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType(), False) for n in names])


NODES = StructType(
    [
        *_strings("id", "kind", "name", "file").fields,
        StructField("line_start", IntegerType(), False),
        StructField("line_end", IntegerType(), False),
        StructField("language", StringType(), False),
        StructField("signature", StringType()),
        StructField("is_test", BooleanType(), False),
        StructField("metadata", MapType(StringType(), StringType())),
    ]
)
EDGES = _strings("source_id", "target_id", "kind")
TAGS = _strings("node_id", "kind", "value")
EXTERNAL_CALLS = _strings("node_id", "package", "symbol")
META = _strings("key", "value")

TABLES = {"nodes": NODES, "edges": EDGES, "tags": TAGS, "external_calls": EXTERNAL_CALLS, "meta": META}
KEYS = {
    "nodes": ["id"],
    "edges": ["source_id", "target_id", "kind"],
    "tags": ["node_id", "kind", "value"],
    "external_calls": ["node_id", "package", "symbol"],
    "meta": ["key"],
}
