"""Calls out of a function, as a language server tells them: edges inside the project, external calls beyond."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, extracted, uri_decoded

# Where package managers put code, and where type declarations live.
PACKAGE_DIRS = ("/node_modules/", "/pkg/mod/")
TYPE_DECLARATIONS = ("/node_modules/@types/", "%40types", "/node_modules/typescript/", "/node_modules/bun-types/", "/typeshed/", "/typestubs/", "-stubs/")

#: What a dump holds for each function: the calls that leave it.
OUTGOING = (
    "array<struct<to: struct<name: string, kind: int, uri: string, range: struct<start: struct<line: int, character: int>, `end`: struct<line: int, character: int>>>>>"
)


def package_name(uri: Column) -> Column:
    """Package below the first node_modules folder, with its scope; null elsewhere."""
    return extracted(uri_decoded(uri), "^.*?/node_modules/(@[^/]*/[^/]*|[^/]+)")


def go_module_name(uri: Column) -> Column:
    """Module of a module cache path, or the standard package of a Go installation's source path; null elsewhere."""
    path = uri_decoded(uri)
    cached = extracted(path, "^.*?/pkg/mod/([^@]*)@")
    standard = F.when(~path.contains("@"), extracted(path, "^.*?/go/src/(.*)/[^/]*$"))
    return F.coalesce(cached, standard)


def is_type_declaration(uri: Column) -> Column:
    return contains_any(uri, TYPE_DECLARATIONS)


def is_external(uri: Column, project: str) -> Column:
    return ~uri.startswith(project) | contains_any(uri, PACKAGE_DIRS)


def outgoing_calls(dump: DataFrame) -> DataFrame:
    """source_id, language, name, uri of each call; the dump has source_id, kind, language and calls (JSON).

    Only functions and methods have calls; unreadable or missing JSON means none.
    """
    rows = dump.filter(F.col("kind").isin("function", "method"))
    call = F.explode(F.from_json("calls", OUTGOING)).alias("call")
    return rows.select("source_id", "language", call).select("source_id", "language", F.col("call.to.name").alias("name"), F.col("call.to.uri").alias("uri"))


def call_edges(calls: DataFrame, project: str) -> DataFrame:
    """Edges of the calls that stay in the project, to <file>::<name> (a bag; a call of itself stays)."""
    inside = calls.filter(~is_external(F.col("uri"), project))
    file = F.regexp_replace(F.substring(F.col("uri"), F.lit(len(project) + 1), F.length("uri")), "^/", "")
    return inside.select("source_id", F.concat(file, F.lit("::"), F.col("name")).alias("target_id"), F.lit("calls").alias("kind"))


def external_calls(calls: DataFrame, project: str) -> DataFrame:
    """node_id, package, symbol of calls into packages (a bag). Type declarations don't count, but for Go."""
    uri, go = F.col("uri"), F.col("language") == "go"
    package = F.when(go, go_module_name(uri)).otherwise(package_name(uri))
    outside = calls.filter(is_external(uri, project) & (go | ~is_type_declaration(uri)))
    return outside.select(F.col("source_id").alias("node_id"), package.alias("package"), F.col("name").alias("symbol")).filter("package IS NOT NULL")
