"""Symbol trees of files, as a language server tells them, become nodes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.text import starts_with_any

# The protocol's symbol kinds, by the kinds of nodes.
KINDS = {5: "class", 6: "method", 9: "method", 11: "type", 12: "function", 23: "class"}

_FLAT = StructType(
    [StructField("ord", IntegerType()), StructField("qualified", StringType()), StructField("kind", StringType()), StructField("name", StringType())]
    + [StructField(n, IntegerType()) for n in ("line_start", "line_end", "select_line", "select_character")]
)


class FlattenSymbols:
    """Table function: a file's symbol tree (JSON) in document order, qualified by its parents.

    Symbols of other kinds emit nothing; their children are taken as their parent's own.
    """

    def eval(self, symbols: str):
        if not symbols:
            return
        ord_, stack = 0, [(s, "") for s in reversed(json.loads(symbols) or [])]
        while stack:
            symbol, above = stack.pop()
            kind, inner = KINDS.get(symbol["kind"]), above
            if kind:
                qualified = inner = f"{above}.{symbol['name']}" if above else symbol["name"]
                span, pick = symbol["range"], symbol.get("selectionRange", symbol["range"])["start"]
                yield ord_, qualified, kind, symbol["name"], span["start"]["line"] + 1, span["end"]["line"] + 1, pick["line"], pick["character"]
                ord_ += 1
            stack.extend((c, inner) for c in reversed(symbol.get("children") or []))


def flatten_symbols(dump: DataFrame) -> DataFrame:
    """file, language, ord, qualified, kind, name, lines and selection of every symbol; the dump has file, language, symbols (JSON)."""
    spark = dump.sparkSession
    spark.udtf.register("flatten_symbols", F.udtf(FlattenSymbols, returnType=_FLAT))
    return spark.sql("SELECT d.file, d.language, f.* FROM {dump} d, LATERAL flatten_symbols(d.symbols) f", dump=dump)


def kind_of(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for number, kind in KINDS.items():
        out = F.when(code == number, kind).otherwise(out)
    return out


def deduplicated(rows: DataFrame, base: str, order: str, within: tuple[str, ...] = (), name: str = "id") -> DataFrame:
    """rows with ids: the n-th repeat of a base id gets $n, from the second on."""
    nth = F.row_number().over(Window.partitionBy(*within, base).orderBy(order))
    return rows.withColumn(name, F.when(nth > 1, F.concat(F.col(base), F.lit("$"), nth.cast("string"))).otherwise(F.col(base)))


def is_test(file: Column, language: Column, test_paths: tuple[str, ...] = ()) -> Column:
    """Go: by the file's name; else whether the path starts with a test path."""
    return F.when(language == "go", file.endswith("_test.go")).otherwise(starts_with_any(file, test_paths))


def symbol_nodes(dump: DataFrame, test_paths: tuple[str, ...] = ()) -> DataFrame:
    """Node columns, and ord, select_line and select_character, of a symbol dump."""
    flat = flatten_symbols(dump).withColumn("_base", F.concat("file", F.lit("::"), "qualified"))
    return deduplicated(flat, "_base", "ord", ("file",)).select(
        "id",
        "kind",
        "name",
        "file",
        "line_start",
        "line_end",
        "language",
        F.lit(None).cast("string").alias("signature"),
        is_test(F.col("file"), F.col("language"), test_paths).alias("is_test"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
        "ord",
        "select_line",
        "select_character",
    )
