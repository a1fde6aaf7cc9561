"""The driver tables seen as an index: documents and parts as files and symbols, orders as a graph, events as calls."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tessera.session import spread, table


def doc_files(spark: SparkSession, sf: str) -> DataFrame:
    """path = source/lang/doc_id, language markdown, char_count in bytes."""
    docs = spread(table(spark, sf, "documents", "doc_id", "text", "lang", "source"))
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return docs.select(path.alias("path"), "text", F.lit("markdown").alias("language"), F.octet_length("text").cast("long").alias("char_count"))


def part_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """name = p_name, path = brand/size, kind = p_type, line = p_partkey, exported for every third part."""
    part = table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return part.select(
        F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"),
        F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("path"), F.col("p_type").alias("kind"),
        F.col("p_partkey").cast("int").alias("line"), F.lit(1).alias("col"), (F.col("p_partkey") % 3 == 0).alias("is_exported"),
    )


def part_files(spark: SparkSession, sf: str) -> DataFrame:
    """One file per brand and size, with a language that depends on the size and the retail prices as its characters."""
    part = table(spark, sf, "part", "p_brand", "p_size", "p_retailprice")
    kind = F.when(F.col("p_size") % 5 == 0, "markdown").when(F.col("p_size") % 5 == 1, "json").otherwise("rust")
    rows = part.groupBy(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("path"), kind.alias("language"))
    return rows.agg(F.sum(F.floor("p_retailprice")).cast("long").alias("char_count"))


def order_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Symbols region, nation, customer, order and edges from each to the one it belongs to; ids are strings."""
    region, nation = table(spark, sf, "region"), table(spark, sf, "nation")
    customer, orders = table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_name"), table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority")

    def key(prefix: str, column: str):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    parts = [
        region.select(key("r", "r_regionkey").alias("symbol_id"), F.col("r_name").alias("name"), F.lit("geo/region").alias("path")),
        nation.select(key("n", "n_nationkey").alias("symbol_id"), F.col("n_name").alias("name"), F.lit("geo/nation").alias("path")),
        customer.select(key("c", "c_custkey").alias("symbol_id"), F.col("c_name").alias("name"), F.concat(F.lit("customer/"), F.col("c_nationkey").cast("string")).alias("path")),
        orders.select(key("o", "o_orderkey").alias("symbol_id"), key("order ", "o_orderkey").alias("name"), F.concat(F.lit("orders/"), "o_orderpriority").alias("path")),
    ]
    edges = [
        nation.select(key("n", "n_nationkey").alias("from_id"), key("r", "n_regionkey").alias("to_id"), F.lit("import").alias("kind")),
        customer.select(key("c", "c_custkey").alias("from_id"), key("n", "c_nationkey").alias("to_id"), F.lit("function_call").alias("kind")),
        orders.select(key("o", "o_orderkey").alias("from_id"), key("c", "o_custkey").alias("to_id"), F.lit("function_call").alias("kind")),
    ]
    symbols, links = parts[0], edges[0]
    for p in parts[1:]:
        symbols = symbols.unionByName(p)
    for e in edges[1:]:
        links = links.unionByName(e)
    return symbols.withColumn("is_exported", F.lit(True)), links


def tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Events as calls: id, ts, tool, tokens_sent, tokens_saved, path of what was touched."""
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool"), F.floor("value").cast("long").alias("tokens_sent"),
        F.floor(F.col("value") * 2).cast("long").alias("tokens_saved"), F.concat(F.lit("repo/"), F.col("user_id").cast("string"), F.lit(".rs")).alias("path"), "user_id",
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
