"""Graph tables out of a star schema: customers call orders, orders parts, parts suppliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph

#: What suppliers with these last digits handle.
HANDLED = ("economy", "promo", "small", "large", "legacy")


def _id(table: str, key: str) -> Column:
    return F.concat(F.lit(f"{table}::"), F.col(key).cast("string"))


def _nodes(rows: DataFrame, table: str, key: str, kind: str, name: Column, file: Column, language: str, is_test: Column | None = None) -> DataFrame:
    return rows.select(
        _id(table, key).alias("id"),
        F.lit(kind).alias("kind"),
        name.alias("name"),
        file.alias("file"),
        (F.col(key) * 10 + 1).cast("int").alias("line_start"),
        (F.col(key) * 10 + 9).cast("int").alias("line_end"),
        F.lit(language).alias("language"),
        F.lit(None).cast("string").alias("signature"),
        (F.lit(False) if is_test is None else is_test).alias("is_test"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
    )


def star_graph(spark: SparkSession, sf_dir: str, cyclic: bool = False) -> Graph:
    """The graph of the star tables in sf_dir; with `cyclic`, some suppliers call customers."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "orders", "part", "supplier", "lineitem", "events")}
    text = lambda c: F.col(c).cast("string")
    nodes = (
        _nodes(t["region"], "region", "r_regionkey", "module", F.col("r_name"), F.lit("region.sql"), "sql")
        .union(_nodes(t["nation"], "nation", "n_nationkey", "class", F.col("n_name"), F.lit("nation.sql"), "sql"))
        .union(_nodes(t["customer"], "customer", "c_custkey", "function", F.col("c_name"), F.concat(F.lit("customer/"), text("c_nationkey"), F.lit(".py")), "python"))
        .union(
            _nodes(
                t["orders"], "orders", "o_orderkey", "function", F.concat(F.lit("order_"), text("o_orderkey")),
                F.concat(F.lit("orders/"), (F.col("o_custkey") % 10).cast("string"), F.lit(".ts")), "typescript", F.col("o_orderstatus") == "P",
            )
        )
        .union(_nodes(t["part"], "part", "p_partkey", "method", F.col("p_name"), F.concat(F.lit("part/"), F.col("p_brand"), F.lit(".go")), "go"))
        .union(_nodes(t["supplier"], "supplier", "s_suppkey", "function", F.col("s_name"), F.concat(F.lit("supplier/"), text("s_nationkey"), F.lit(".go")), "go"))
    )

    def edge(rows: DataFrame, source: tuple[str, str], target: tuple[str, str], kind: str) -> DataFrame:
        """Edges, each once: what repeats is dropped by its keys, before they become ids, as no two kinds of rows make the same edge."""
        keys = rows.select(F.col(source[1]).alias("_source"), F.col(target[1]).alias("_target")).distinct()
        return keys.select(_id(source[0], "_source").alias("source_id"), _id(target[0], "_target").alias("target_id"), F.lit(kind).alias("kind"))

    lines = t["lineitem"]
    calls = (
        edge(t["orders"], ("customer", "o_custkey"), ("orders", "o_orderkey"), "calls")
        .union(edge(lines, ("orders", "l_orderkey"), ("part", "l_partkey"), "calls"))
        .union(edge(lines, ("part", "l_partkey"), ("supplier", "l_suppkey"), "calls"))
    )
    if cyclic:
        calls = calls.union(edge(t["supplier"].filter("s_suppkey % 25 = 0"), ("supplier", "s_suppkey"), ("customer", "s_suppkey"), "calls"))
    other = edge(t["supplier"], ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "contains").union(
        edge(t["nation"], ("nation", "n_nationkey"), ("region", "n_regionkey"), "imports")
    )

    def tag(rows: DataFrame, node: Column, kind: str, value: Column) -> DataFrame:
        return rows.select(node.alias("node_id"), F.lit(kind).alias("kind"), value.alias("value"))

    handled = F.element_at(F.array(*[F.lit(f"part.{h}") for h in HANDLED]), (F.col("s_suppkey") % 10).cast("int") + 1)
    tags = (
        tag(t["customer"].filter("c_custkey % 50 = 0"), _id("customer", "c_custkey"), "flow", F.lower("c_mktsegment"))
        .union(tag(t["customer"].filter("c_custkey = 1"), _id("customer", "c_custkey"), "flow", F.lit("buildng")))
        .union(tag(t["nation"].filter("n_nationkey = 0"), _id("nation", "n_nationkey"), "flow", F.lit("building")))
        .union(tag(t["supplier"].filter("s_suppkey % 2 = 0"), _id("supplier", "s_suppkey"), "boundary", F.concat(F.lit("nation-"), text("s_nationkey"))))
        .union(tag(t["part"].filter("p_partkey % 100 = 0"), _id("part", "p_partkey"), "emits", F.concat(F.lit("part."), F.lower("p_type"))))
        .union(tag(t["supplier"].filter("s_suppkey % 10 < 5"), _id("supplier", "s_suppkey"), "handles", handled))
    )
    edges = calls.union(other)
    users = t["events"].select("user_id", "event_type").distinct()
    external = t["supplier"].filter("s_suppkey % 3 = 0").join(users, F.col("s_suppkey") == F.col("user_id"))
    external = external.select(_id("supplier", "s_suppkey").alias("node_id"), F.col("event_type").alias("package"), F.concat("event_type", F.lit(".call")).alias("symbol"))
    return Graph(nodes, edges, tags, external).with_hubs()
