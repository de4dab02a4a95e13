"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset: a temporary folder if driver and executors are one process, else one in the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        local = spark.sparkContext.master.split("[")[0] == "local"
        path = tempfile.mkdtemp(prefix="shared-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.shared-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str, n: int | None = None) -> DataFrame:
    """df written in n buckets by a key, and read again: joins by the key don't shuffle it. n: as many as partitions of a shuffle."""
    spark = df.sparkSession
    path, table = table_path(spark, name), f"t{uuid.uuid4().hex}"
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(table)
    rows = spark.read.table(table)
    rows.schema  # noqa: B018  the plan is made, with its buckets
    spark.sql(f"DROP TABLE {table}")  # the catalog's entry only: its files stay, and go with the shared folder's other tables
    return rows


class Scratch:
    """Tables of intermediate rounds: gone when the block ends, so that a long session keeps results only."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        path = table_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """df, saved, and how many rows it has, counted as they are written."""
        seen = Observation()
        rows = self.saved(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        return rows, seen.get["n"]

    def __exit__(self, *_) -> None:
        for path in self.paths:
            _remove(self.spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone by then  # noqa: BLE001
        return
