"""Source files: finding, reading, and telling what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contains_any, ends_with_any

# What language detection passes over, and languages' extensions.
UNLIKELY = ("node_modules", ".git", "test", "fixture", "vendor", "dist")
EXTENSIONS = {"typescript": (".ts", ".tsx"), "python": (".py",), "go": (".go",)}
#: Hundredths of all files beyond which a change asks for a whole build.
REBUILD = 30


def is_excluded(name: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a folder's name contains one of the patterns."""
    return contains_any(name, patterns)


def discover(spark: SparkSession, root: str, extensions: tuple[str, ...], exclude: tuple[str, ...], text: bool = False) -> DataFrame:
    """path, file (below root), modified (epoch milliseconds) of the files below root with one of the extensions.

    A file goes if a folder between root and it is excluded; its own name isn't tested.
    Files that disappear meanwhile are passed over. With `text`, also each file's contents,
    whole and as UTF-8, of these files only; else no contents are read.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    if text:
        names = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modificationTime")
        listed = reader.text(root, wholetext=True).select(*names, F.col("value").alias("text"))
    else:
        listed = reader.format("binaryFile").load(root)
    start = root.rstrip("/")
    below = F.regexp_replace(F.col("path"), F.lit("^[a-zA-Z0-9+.-]*:/*(?=/)"), F.lit(""))
    plain = start if start.startswith("/") else start.split(":", 1)[-1]
    file = F.substring(below, F.lit(len(plain) + 2), F.length(below))
    rows = listed.select("path", file.alias("file"), F.unix_millis("modificationTime").alias("modified"), *(["text"] if text else []))
    folders = F.split("file", "/")
    folders = F.slice(folders, 1, F.size(folders) - 1)
    return rows.filter(ends_with_any(F.col("file"), extensions) & ~F.exists(folders, lambda x: is_excluded(x, exclude)))


def changed_since(found: DataFrame, last_build: int) -> DataFrame:
    """Files modified after last_build (epoch milliseconds); those of unknown time count as changed."""
    return found.filter(F.col("modified").isNull() | (F.col("modified") > last_build))


def changed_share(found: DataFrame, last_build: int) -> DataFrame:
    """One row: changed, total, whole: how many files changed, and whether these are over REBUILD hundredths of all."""
    new = F.coalesce(F.col("modified") > last_build, F.lit(True))
    counts = found.agg(F.count_if(new).alias("changed"), F.count("*").alias("total"))
    return counts.withColumn("whole", F.col("changed") * 100 > F.col("total") * REBUILD)


def language_flags(found: DataFrame) -> DataFrame:
    """One row: python, typescript: whether a file outside folders and names that speak of tests or packages has the language."""
    likely = found.filter(~contains_any(F.col("file"), UNLIKELY))
    return likely.agg(*[F.coalesce(F.bool_or(ends_with_any(F.col("file"), EXTENSIONS[n])), F.lit(False)).alias(n) for n in ("python", "typescript")])


def detect_languages(found: DataFrame) -> list[str]:
    """The languages that language_flags finds."""
    seen = language_flags(found).first()
    return [n for n in ("python", "typescript") if seen[n]]
