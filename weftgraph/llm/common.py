"""What several training-data operators share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import saved, table_path

__all__ = ["documents", "give_back", "hash_bucket", "labelled", "release_shuffles", "saved", "table_path"]

#: Keys that have more than this part of all rows are joined by a broadcast of their labels: there are fewer than so many.
HOT_PART = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def give_back() -> None:
    """Returns a Python worker's freed memory to the system: workers outlive their tasks, and stay as large as they once were."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with every C library
        return


def release_shuffles(spark: SparkSession) -> None:
    """Lets the files of shuffles that nothing refers to any more go now, not when the driver happens to collect garbage."""
    spark.range(1).collect()  # the scheduler refers to the last job until there is another
    gc.collect()
    spark._jvm.System.gc()


def hash_bucket(column: Column, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def labelled(rows: DataFrame, labels: DataFrame, key: str, total: int, count_col: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with labels on key, where no key's rows meet in one task.

    labels has one row per key, with count_col, how many of the `total` rows have it, which
    goes. Of keys with over one part in HOT_PART of the rows there are fewer than HOT_PART:
    their labels are broadcast. All other keys are shuffled. how: inner or left.
    """
    hot = F.col(count_col) * HOT_PART > total
    few = F.broadcast(labels.filter(hot).drop(count_col))
    many = rows.join(F.broadcast(labels.filter(hot).select(key)), key, "left_anti").join(labels.filter(~hot).drop(count_col), key, how)
    return rows.join(few, key).unionByName(many)
