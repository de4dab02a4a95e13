"""Shared helpers."""

import zlib

from pyspark.sql import functions as F

from weftgraph.llm import common


def test_hash_bucket(spark):
    got = spark.range(200).select("id", common.hash_bucket(F.col("id"), 5).alias("b")).collect()
    assert all(r["b"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)
    assert spark.sql("SELECT cast(null AS bigint) AS id").select(common.hash_bucket(F.col("id"), 5)).first()[0] is None


def test_saved_table_is_read_again(spark):
    df = common.saved(spark.range(10).filter("id > 3"), "some")
    common.release_shuffles(spark)
    common.give_back()
    assert df.count() == 6 and df.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(spark.conf.get("spark.checkpoint.dir").split(":", 1)[-1].lstrip("/"))
