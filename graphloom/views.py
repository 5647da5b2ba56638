"""A property graph over the star-schema tables: labels and edge types as projections, without copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import DST, EID, SRC, Graph
from .session import make_importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    make_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Region, Nation, Customer, Supplier, Part, Order and Document nodes; IN_REGION, LIVES_IN, BASED_IN, PLACED,
    CONTAINS and SUPPLIED edges. Line items are CONTAINS edges with properties, and SUPPLIED edges."""
    t = lambda name: table(spark, sf_dir, name)
    nation, customer, supplier, part, orders, lines = (t(n) for n in ("nation", "customer", "supplier", "part", "orders", "lineitem"))
    g = Graph(spark)
    g.add_nodes("Region", t("region").withColumn("name", F.col("r_name")), "r_regionkey")
    g.add_nodes("Nation", nation.withColumn("name", F.col("n_name")), "n_nationkey")
    g.add_nodes("Customer", customer.withColumn("name", F.col("c_name")), "c_custkey")
    g.add_nodes("Supplier", supplier.withColumn("name", F.col("s_name")), "s_suppkey")
    g.add_nodes("Part", part.withColumn("name", F.col("p_name")), "p_partkey")
    money = F.struct(F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"))
    g.add_nodes("Order", orders.withColumn("placed", F.date_format("o_orderdate", "yyyy-MM-dd")).withColumn("terms", money), "o_orderkey")
    g.add_nodes("Document", t("documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    key = lambda c: F.col(c).cast("string")
    g.add_edges("IN_REGION", "Nation", "Region", nation.select(F.col("n_nationkey").alias(SRC), F.col("n_regionkey").alias(DST), key("n_nationkey").alias(EID)))
    g.add_edges("LIVES_IN", "Customer", "Nation", customer.select(F.col("c_custkey").alias(SRC), F.col("c_nationkey").alias(DST), key("c_custkey").alias(EID)))
    g.add_edges("BASED_IN", "Supplier", "Nation", supplier.select(F.col("s_suppkey").alias(SRC), F.col("s_nationkey").alias(DST), key("s_suppkey").alias(EID)))
    g.add_edges("PLACED", "Customer", "Order", orders.select(F.col("o_custkey").alias(SRC), F.col("o_orderkey").alias(DST), key("o_orderkey").alias(EID)))
    line_id = F.concat_ws("-", key("l_orderkey"), key("l_linenumber")).alias(EID)
    g.add_edges("CONTAINS", "Order", "Part", lines.select(
        F.col("l_orderkey").alias(SRC), F.col("l_partkey").alias(DST), line_id, F.col("l_linenumber").alias("linenumber"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("extendedprice"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("returnflag"), F.col("l_suppkey").alias("suppkey"),
    ))
    g.add_edges("SUPPLIED", "Supplier", "Part", lines.select(F.col("l_suppkey").alias(SRC), F.col("l_partkey").alias(DST), line_id, F.col("l_quantity").alias("quantity")))
    return g


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested documents: key, id, name, customer (with its nation), and lines with what lies on the edge to
    each part in p_..._ fields."""
    t = lambda name: table(spark, sf_dir, name)
    part = t("part").select("p_partkey", "p_name", "p_brand")
    line = F.struct(F.col("l_linenumber").alias("number"), F.concat(F.lit("part-"), F.col("l_partkey")).alias("name"), F.col("p_brand").alias("brand"), F.col("l_quantity").alias("p_quantity_"), F.col("l_returnflag").alias("p_flag_"))
    # an order has a handful of lines
    lines = t("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    lines = lines.select("l_orderkey", F.transform("lines", lambda x: x.dropFields("number")).alias("lines"))
    customer = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    customer = customer.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.struct(F.col("n_name").alias("name")).alias("nation")).alias("customer"))
    orders = t("orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("_key"), F.col("o_orderkey").alias("_ord"),
        F.concat(F.lit("order-"), F.col("o_orderkey")).alias("name"), F.col("o_orderstatus").alias("status"), "customer",
        F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)).alias("lines"),
        F.create_map(F.lit("source"), F.lit("orders")).alias("metadata"),
    )
