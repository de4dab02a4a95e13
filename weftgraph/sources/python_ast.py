"""Symbol and call dumps of Python sources by their syntax trees, where no language server runs.

Files are parsed in tasks, one at a time. Calls are resolved by name: to the file's own
functions and methods, to names imported from files of the project, and to imported packages.
Which files an import may mean depends on the importing file alone; which of them exist is
asked of the listing of files, in a join.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DUMP = "file string, language string, symbols string, source_name string, source_line int, calls string"
#: A file's symbols, a function without calls, a call, or why a file has none. options: what a call may mean, the likeliest first; other: what else.
PARSED = "file string, symbols string, source_name string, source_line int, at int, options array<struct<file: string, name: string>>, other_uri string, other_name string, error string"


def _span(node: ast.AST) -> dict:
    start, end = {"line": node.lineno - 1, "character": node.col_offset}, {"line": (node.end_lineno or node.lineno) - 1, "character": node.end_col_offset or 0}
    return {"range": {"start": start, "end": end}, "selectionRange": {"start": start, "end": end}}


def _symbols(body: list[ast.stmt], in_class: bool = False) -> list[dict]:
    out = []
    for node in body:
        if isinstance(node, ast.ClassDef):
            out.append({"name": node.name, "kind": 5, **_span(node), "children": _symbols(node.body, True)})
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            out.append({"name": node.name, "kind": 6 if in_class else 12, **_span(node), "children": _symbols(node.body)})
        else:
            for inner in _statements(node):
                out += _symbols(inner, in_class)
    return out


def _statements(node: ast.stmt) -> Iterator[list[ast.stmt]]:
    """The statement lists of a compound statement: its body, other branches, handlers and cases."""
    for name in ("body", "orelse", "finalbody"):
        if inner := getattr(node, name, None):
            yield inner
    for part in (*getattr(node, "handlers", ()), *getattr(node, "cases", ())):
        yield part.body


def _places(module: list[str], here: list[str]) -> list[str]:
    """Files that a module may be, from the project's root or beside the importing file."""
    return ["/".join([*folder, path]) for path in ("/".join(module) + ".py", "/".join([*module, "__init__.py"])) for folder in ([], here)] if module else []


def _imports(tree: ast.Module, file: str) -> dict[str, tuple[list[tuple[str, str | None]], str, str | None]]:
    """local name -> (files that it may come from, each with its name there or None for a module; the package's uri, and the name there)."""
    found = {}
    here = file.split("/")[:-1]
    package = lambda module: "/node_modules/" + module[0] if module else ""
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                module = a.name.split(".")
                found[a.asname or module[0]] = ([(f, None) for f in _places(module, here)], package(module), None)
        elif isinstance(node, ast.ImportFrom):
            base = here[: len(here) - node.level + 1] if node.level else []
            module = [*base, *(node.module or "").split(".")] if node.module else base
            for a in node.names:
                options = [(f, None) for f in _places([*module, a.name], here)] + [(f, a.name) for f in _places(module, here)]
                found[a.asname or a.name] = (options, package(module), a.name)
    return found


def _calls(function: ast.AST, imports: dict, own: set[str], file: str) -> list[tuple[list[dict], str, str]]:
    """(options, other uri, other name) of each call whose target's name is known."""
    out = []

    def walk(node: ast.AST) -> Iterator[ast.Call]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                continue
            if isinstance(child, ast.Call):
                yield child
            yield from walk(child)

    for call in walk(function):
        target, parts = call.func, []
        while isinstance(target, ast.Attribute):
            parts.append(target.attr)
            target = target.value
        if not isinstance(target, ast.Name):
            continue
        name = parts[0] if parts else target.id
        there = lambda known: name if parts else (known or name)  # noqa: B023, E731
        if target.id in imports:
            options, uri, known = imports[target.id]
            out.append(([{"file": f, "name": there(n)} for f, n in options], uri, there(known)))
        elif name in own and (not parts or target.id in ("self", "cls")):
            out.append(([{"file": file, "name": name}], "", name))
    return out


def parse_file(file: str, text: str) -> list[tuple]:
    """Rows of PARSED: the file's symbols once, then one for each function, and for each of its calls."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as bad:
        return [(file, None, None, None, None, None, None, None, str(bad) or type(bad).__name__)]
    imports = _imports(tree, file)
    functions = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    own = {f.name for f in functions}
    rows: list[tuple] = [(file, json.dumps(_symbols(tree.body)), None, None, None, None, None, None, None)]
    for f in functions:
        rows.append((file, None, f.name, f.lineno, None, None, None, None, None))
        rows += [(file, None, f.name, f.lineno, at, *call, None) for at, call in enumerate(_calls(f, imports, own, file))]
    return rows


def parsed(sources: DataFrame) -> DataFrame:
    """PARSED of sources (file, text). A file that can't be parsed has one row, which says why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [p.split()[0] for p in PARSED.replace("array<struct<file: string, name: string>>", "array").split(", ")]
        for batch in batches:
            rows = [r for f, t in zip(batch["file"], batch["text"], strict=True) for r in parse_file(f, t or "")]
            yield pd.DataFrame(rows, columns=names).astype({"source_line": "Int32", "at": "Int32"})

    return sources.select("file", "text").mapInPandas(run, PARSED)


def dump(rows: DataFrame, files: DataFrame, project: str) -> DataFrame:
    """DUMP of PARSED rows, given all files of the project (file)."""
    call = ["file", "source_name", "source_line"]
    each = rows.filter("at IS NOT NULL").select(*call, "at", "other_uri", "other_name", F.posexplode_outer("options").alias("_place", "_option"))
    known = each.join(files.select(F.col("file").alias("_there")).distinct(), F.col("_option.file") == F.col("_there"), "left")
    met = known.groupBy(*call, "at", "other_uri", "other_name").agg(F.min(F.when(F.col("_there").isNotNull(), F.struct("_place", "_option"))).alias("_met"))
    own = F.col("_met._option.file")
    uri = F.when(own.isNotNull(), F.concat(F.lit(f"{project}/"), own)).when(F.col("other_uri") != "", F.concat(F.lit(project), F.col("other_uri")))
    to = F.struct(F.coalesce("_met._option.name", F.col("other_name")).alias("name"), F.lit(12).alias("kind"), uri.alias("uri"))
    calls = met.filter(uri.isNotNull()).groupBy(*call).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("at", to.alias("to")))), lambda c: F.struct(c["to"].alias("to")))).alias("calls"))
    functions = rows.filter("source_name IS NOT NULL AND at IS NULL").select(*call).distinct()
    with_calls = functions.join(calls, call, "left").select("file", F.lit("python").alias("language"), F.lit(None).cast("string").alias("symbols"), "source_name", "source_line", F.coalesce("calls", F.lit("[]")).alias("calls"))
    symbols = rows.filter("symbols IS NOT NULL").select("file", F.lit("python").alias("language"), "symbols", *[F.lit(None).cast(t).alias(c) for c, t in (("source_name", "string"), ("source_line", "int"), ("calls", "string"))])
    return symbols.unionByName(with_calls)
