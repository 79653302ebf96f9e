"""The provided tables read as trees and as types with contracts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.operators.hierarchy import Level
from canopy.session import spread


# Column types of the provided tables (fixed values): given, not inferred, so that naming a
# table starts no job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Sat:
    structs: DataFrame
    methods: DataFrame
    interfaces: DataFrame
    reqs: DataFrame
    struct_inherits: DataFrame
    interface_inherits: DataFrame


def sat(spark: SparkSession, sf_dir: str) -> Sat:
    """Customers as types, orders as contracts, parts as the items both sides name.

    A customer *offers* each part it ever bought, by name and signature text; customers of
    the BUILDING segment embed customer ``key div 10``. An order *requires* each of its parts;
    pending orders inherit the requirements of order ``key div 10``. Key 0 embeds itself.
    ``methods`` and ``reqs`` are bags here; the set operators dedup after their last join.
    """
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.col("p_name").alias("name"),
        F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("type"),
    )
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"))
    # Parts come last: their texts are longer than the keys that lead to them.
    buys = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(part, "l_partkey")
    return Sat(
        structs=customer.select(F.col("c_custkey").alias("type")),
        methods=buys.select("name", "type", F.col("o_custkey").alias("receiver_type")),
        interfaces=orders.select(F.col("o_orderkey").alias("interface")),
        reqs=lines.join(part, "l_partkey").select(F.col("l_orderkey").alias("interface"), "name", "type"),
        struct_inherits=customer.where(F.col("c_mktsegment") == "BUILDING").select(
            F.col("c_custkey").alias("type"), F.expr("c_custkey div 10").alias("embedded_type")
        ),
        interface_inherits=orders.where(F.col("o_orderstatus") == "P").select(
            F.col("o_orderkey").alias("type"), F.expr("o_orderkey div 10").alias("embedded_type")
        ),
    )


def tree(spark: SparkSession, sf_dir: str) -> list[Level]:
    """Region > nations > customers > orders as one forest of five trees, from the flat tables."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")

    def key(prefix: str, column: str):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    def level(kind, rows, prefix, column, data, parent=None, label=None):
        return Level(
            kind, rows, key(prefix, column), F.col(data), parent, label, F.col(column).cast("bigint")
        )

    return [
        level("Region", region, "R", "r_regionkey", "r_name"),
        level("Nation", nation, "N", "n_nationkey", "n_name", key("R", "n_regionkey"), "nations"),
        level("Customer", customer, "C", "c_custkey", "c_name", key("N", "c_nationkey"), "customers"),
        level("Order", orders, "O", "o_orderkey", "o_orderpriority", key("C", "o_custkey"), "orders"),
    ]
