"""Registered queries over documents, tables and vectors, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.export import cytoscape_edges, display_name
from .operators.extract import extract_edges, extract_nodes, field_documents
from .operators.upsert import keep_last, merge_nodes
from .operators.vector import chunk_documents, top_k
from .schema import EdgeSpec, GraphSchema, NodeSpec
from .session import run_folder
from .sources.tables import TableSource, distinct_keys, pull, with_order
from .store import GraphStore
from .views import order_documents, table, trade_graph

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Country:
    name: str


@dataclass
class Buyer:
    name: str
    segment: str | None
    nation: Country


@dataclass
class Item:
    name: str
    brand: str
    p_quantity_: float
    p_flag_: str


@dataclass
class OrderDocument:
    name: str
    status: str
    customer: Buyer
    lines: list[Item] = field(default_factory=list)
    metadata: dict[str, str] | None = None


def order_schema() -> GraphSchema:
    nodes = [NodeSpec(k, "name") for k in (OrderDocument, Buyer, Country, Item)]
    edges = [EdgeSpec(OrderDocument, Buyer, "ORDERED_BY"), EdgeSpec(Buyer, Country, "FROM_COUNTRY"), EdgeSpec(OrderDocument, Item, "HAS_ITEM")]
    return GraphSchema(OrderDocument, nodes, edges)


def extract_nodes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_nodes(order_documents(spark, sf_dir), order_schema(), "Item", "now")
    return found.select(F.col("_key").alias("key"), "name", "brand")


def extract_nested_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_nodes(order_documents(spark, sf_dir), order_schema(), "Country", "now")
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("documents"))


def extract_edges_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_schema()
    found = extract_edges(order_documents(spark, sf_dir), s, s.edges[1])
    return found.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))


def edge_property_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_schema()
    found = extract_edges(order_documents(spark, sf_dir), s, s.edges[2])
    return found.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "quantity", "flag")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as their orders show them, one after the other: the name changes and the priority is blank at times."""
    o = table(spark, sf_dir, "orders")
    priority = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority"))
    return o.select(
        F.struct("o_orderkey").alias("_at"), F.concat(F.lit("customer-"), F.col("o_custkey")).alias("_dedup_key"), F.concat(F.lit("order-"), F.col("o_orderkey") % 5).alias("name"),
        F.concat(F.lit("order-"), F.col("o_orderkey") % 5).alias("_original_name"), F.lit("t0").alias("_created_at"), F.lit("t0").alias("_updated_at"), F.array().cast("array<string>").alias("alternate_names"),
        priority.alias("priority"),
    )


def upsert_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches: orders of even keys are stored first, then the odd ones are merged in."""
    rows = versions(spark, sf_dir)
    even = merge_nodes(None, rows.filter("_at.o_orderkey % 2 = 0"), "Client")
    both = merge_nodes(even, rows.filter("_at.o_orderkey % 2 = 1"), "Client")
    return both.select(F.col("_dedup_key").alias("key"), "name", "priority", F.size("alternate_names").alias("alternates"))


def alternate_names_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge_nodes(None, versions(spark, sf_dir), "Client")
    return merged.select(F.col("_dedup_key").alias("key"), "name", F.array_join("alternate_names", ",").alias("alternates"))


def keep_last_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.struct("l_orderkey", "l_linenumber").alias("at"))
    return keep_last(lines, "l_partkey", "at").select(F.col("l_partkey").alias("partkey"), F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"))


def pull_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = pull(table(spark, sf_dir, "supplier"), "s_nationkey", table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey")
    return met.select(F.col("_value").alias("value"), F.col("c_custkey").alias("custkey"), F.col("c_name").alias("customer"))


def vector_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.filter("vec_id = 0").select("embedding").first()
    return top_k(vectors, list(first["embedding"]), 5, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


def field_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey").cast("string"))
    return field_documents(parts, "Part", ("p_name", "p_type"))


def chunk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(table(spark, sf_dir, "documents"), "doc_id", "text", 2000, 500)


def upsert_by_key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents without an order of their own: long keys that agree in their first bytes. The last by key
    overwrites a customer's segment."""
    o = table(spark, sf_dir, "orders")
    buyer = F.struct(F.concat(F.lit("customer-"), F.col("o_custkey")).alias("name"), F.col("o_orderpriority").alias("segment"), F.struct(F.lit("x").alias("name")).alias("nation"))
    docs = o.select(F.format_string("order-document-%012d", "o_orderkey").alias("_key"), F.lit("o").alias("name"), F.col("o_orderstatus").alias("status"), buyer.alias("customer"))
    found = extract_nodes(with_order(docs), order_schema(), "Buyer", "now")
    seen = found.groupBy("_dedup_key").agg(F.count(F.lit(1)).alias("documents"))
    return merge_nodes(None, found, "Buyer").join(seen, "_dedup_key").select("name", "segment", "documents")


def return_star_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole nodes and edges, as structs, of which a few fields are shown."""
    df = trade_graph(spark, sf_dir).cypher("MATCH (n:Nation)-[e:IN_REGION]->(r:Region) RETURN *")
    shown = {"n._id": "n_id", "n.n_name": "nation", "e._label": "type", "e._src": "src", "r._id": "r_id", "r.r_name": "region"}
    return df.select(*[F.col(k).alias(v) for k, v in shown.items()])


def own_folder(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store filled with nations, some renamed by SET, neighbours joined by CREATE."""
    store = GraphStore(spark, own_folder(spark, "store"))
    store.create_node_table("Nation", {"id": T.StringType(), "region": T.IntegerType(), "name": T.StringType()}, "id")
    store.append_nodes("Nation", table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_regionkey").alias("region"), F.col("n_name").alias("name")))
    store.cypher("MATCH (n:Nation) WHERE n.region >= 3 SET n.name = 'late ' + n.name", read_only=False)
    store.cypher("MATCH (a:Nation), (b:Nation) WHERE a.region = b.region AND a.id < b.id CREATE (a)-[:NEAR {km: 7}]->(b)", read_only=False)
    return store.cypher("MATCH (a:Nation)-[r:NEAR]->(b:Nation) RETURN a.name AS a, b.name AS b, r.km AS km").select("a", "b", F.col("km").cast("long").alias("km"))


def ledger_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two extracts imported one after the other, the first twice: of each key the last imported row holds."""
    folder, customer = own_folder(spark, "imports"), table(spark, sf_dir, "customer")
    for name, rows in (("first", customer), ("second", customer.filter("c_custkey % 3 = 0"))):
        rows.select(F.col("c_custkey").alias("Cust Key"), F.col("c_name").alias("Cust Name"), F.lit(name).alias("File")).coalesce(1).write.option("header", True).csv(f"{folder}/{name}.csv")
    source = TableSource(spark, f"{folder}/table", "cust_key", "Customers")
    for name in ("first", "second", "first"):
        source.import_file(f"{folder}/{name}.csv")
    return source.rows().select(F.col("Cust Key").cast("long").alias("custkey"), F.col("File").alias("file"), F.col("Cust Name").alias("name"))


def display_name_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trade_graph(spark, sf_dir).nodes["Part"]
    return t.df.select(F.col("p_partkey").alias("partkey"), display_name(t.df, "Part", ["p_type", "p_brand"], 10).alias("shown"))


QUERIES: dict[str, Query] = {
    "extract_nodes": extract_nodes_query,
    "extract_nested": extract_nested_query,
    "extract_edges": extract_edges_query,
    "edge_property_extract": edge_property_query,
    "upsert_first_last": upsert_query,
    "alternate_names": alternate_names_query,
    "dedup_keep_last": keep_last_query,
    "pull_lookup": pull_query,
    "distinct_keys": lambda spark, sf_dir: distinct_keys(table(spark, sf_dir, "orders"), "o_custkey"),
    "vector_topk": vector_query,
    "field_index": field_index_query,
    "chunk_documents": chunk_query,
    "display_name": display_name_query,
    "cytoscape_edges": lambda spark, sf_dir: cytoscape_edges(trade_graph(spark, sf_dir)),
    "upsert_by_document_key": upsert_by_key_query,
    "return_star": return_star_query,
    "store_set_create": store_query,
    "ledger_import": ledger_query,
    "info_counts": lambda spark, sf_dir: trade_graph(spark, sf_dir).counts(),
}

ORACLE_SQL: dict[str, str] = {
    "extract_nodes": "SELECT DISTINCT l_orderkey::VARCHAR AS key, 'part-' || l_partkey AS name, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey",
    "extract_nested": "SELECT n_name AS name, count(*) AS documents FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name",
    "extract_edges": "SELECT sha256('Buyer' || chr(1) || c_name) AS src, sha256('Country' || chr(1) || n_name) AS dst FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey",
    "edge_property_extract": "SELECT sha256('OrderDocument' || chr(1) || 'order-' || l_orderkey) AS src, sha256('Item' || chr(1) || 'part-' || l_partkey) AS dst, l_quantity AS quantity, l_returnflag AS flag FROM lineitem",
    "upsert_first_last": """WITH v AS (SELECT 'customer-' || o_custkey AS key, 'order-' || o_orderkey % 5 AS name, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS priority, (o_orderkey % 2) * 1000000000000 + o_orderkey AS k FROM orders)
        SELECT key, arg_min(name, k) AS name, coalesce(arg_max(priority, k) FILTER (WHERE priority <> ''), arg_min(priority, k)) AS priority, (count(DISTINCT name) - 1)::INTEGER AS alternates FROM v GROUP BY key""",
    "alternate_names": """WITH v AS (SELECT 'customer-' || o_custkey AS key, 'order-' || o_orderkey % 5 AS name, min(o_orderkey) AS k FROM orders GROUP BY 1, 2), f AS (SELECT key, arg_min(name, k) AS first FROM v GROUP BY key)
        SELECT f.key AS key, f.first AS name, coalesce(string_agg(v.name, ',' ORDER BY v.k) FILTER (WHERE v.name <> f.first), '') AS alternates FROM f JOIN v ON v.key = f.key GROUP BY f.key, f.first""",
    "dedup_keep_last": "SELECT l_partkey AS partkey, max(l_orderkey) AS orderkey, arg_max(l_linenumber, l_orderkey * 1000 + l_linenumber) AS linenumber FROM lineitem GROUP BY l_partkey",
    "pull_lookup": "SELECT c_nationkey::VARCHAR AS value, min(c_custkey) AS custkey, arg_min(c_name, c_custkey) AS customer FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier) GROUP BY c_nationkey",
    "distinct_keys": "SELECT DISTINCT o_custkey::VARCHAR AS key FROM orders",
    "vector_topk": "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 5",
    "field_index": """SELECT p_name AS content, 'Part' AS node_type, 'p_name' AS field_name, p_partkey::VARCHAR AS primary_key, 'Part.p_name' AS field_path FROM part
        UNION ALL SELECT p_type, 'Part', 'p_type', p_partkey::VARCHAR, 'Part.p_type' FROM part""",
    "display_name": "SELECT p_partkey AS partkey, CASE WHEN length(p_brand) > 10 THEN substr(p_brand, 1, 10) || '...' ELSE p_brand END AS shown FROM part",
    "cytoscape_edges": """SELECT source || '-' || label || '-' || target AS id, source, target, label FROM (
        SELECT 'Nation:' || n_nationkey AS source, 'Region:' || n_regionkey AS target, 'IN_REGION' AS label FROM nation
        UNION ALL SELECT 'Customer:' || c_custkey, 'Nation:' || c_nationkey, 'LIVES_IN' FROM customer
        UNION ALL SELECT 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey, 'BASED_IN' FROM supplier
        UNION ALL SELECT 'Customer:' || o_custkey, 'Order:' || o_orderkey, 'PLACED' FROM orders
        UNION ALL SELECT 'Order:' || l_orderkey, 'Part:' || l_partkey, 'CONTAINS' FROM lineitem
        UNION ALL SELECT 'Supplier:' || l_suppkey, 'Part:' || l_partkey, 'SUPPLIED' FROM lineitem)""",
    "upsert_by_document_key": "SELECT 'customer-' || o_custkey AS name, arg_max(o_orderpriority, o_orderkey) AS segment, count(*) AS documents FROM orders GROUP BY o_custkey",
    "return_star": "SELECT 'Nation:' || n_nationkey AS n_id, n_name AS nation, 'IN_REGION' AS type, 'Nation:' || n_nationkey AS src, 'Region:' || r_regionkey AS r_id, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey",
    "store_set_create": """WITH n AS (SELECT n_nationkey::VARCHAR AS id, n_regionkey AS region, CASE WHEN n_regionkey >= 3 THEN 'late ' || n_name ELSE n_name END AS name FROM nation)
        SELECT a.name AS a, b.name AS b, 7::BIGINT AS km FROM n a JOIN n b ON a.region = b.region AND a.id < b.id""",
    "ledger_import": """SELECT c_custkey AS custkey, CASE WHEN c_custkey % 3 = 0 THEN 'second' ELSE 'first' END AS file, c_name AS name FROM customer""",
    "chunk_documents": """WITH RECURSIVE t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
        c AS (
          SELECT doc_id, 0::BIGINT AS a, NULL::BIGINT AS b, 0::BIGINT AS following FROM t
          UNION ALL
          SELECT doc_id, a, b, CASE WHEN b = n THEN NULL WHEN p > 0 AND again + p - 1 < b - 1 AND again > a + 1 THEN again + p ELSE again END AS following
          FROM (
            SELECT *, instr(substr(text, again + 1, b - again), ' ') AS p FROM (
              SELECT *, greatest(a + 1, b - 500) AS again FROM (
                SELECT doc_id, text, n, a, CASE WHEN a + 2000 >= n THEN n ELSE coalesce(
                  CASE WHEN instr(w, reverse(chr(10) || '# ')) > 0 THEN a + 2000 - (instr(w, reverse(chr(10) || '# ')) - 1) - 3 END,
                  CASE WHEN instr(w, reverse(chr(10) || '## ')) > 0 THEN a + 2000 - (instr(w, reverse(chr(10) || '## ')) - 1) - 4 END,
                  CASE WHEN instr(w, reverse(chr(10) || '### ')) > 0 THEN a + 2000 - (instr(w, reverse(chr(10) || '### ')) - 1) - 5 END,
                  CASE WHEN instr(w, chr(10) || chr(10)) > 0 THEN a + 2000 - (instr(w, chr(10) || chr(10)) - 1) - 2 END,
                  CASE WHEN instr(w, chr(10)) > 0 THEN a + 2000 - (instr(w, chr(10)) - 1) - 1 END,
                  CASE WHEN instr(w, ' .') > 0 THEN a + 2000 - (instr(w, ' .') - 1) END,
                  CASE WHEN instr(w, ' ') > 0 THEN a + 2000 - (instr(w, ' ') - 1) END, a + 2000) END AS b
                FROM (SELECT t.doc_id, text, n, following AS a, reverse(substr(text, following + 1001, 1000)) AS w FROM c JOIN t ON t.doc_id = c.doc_id WHERE following IS NOT NULL)))))
        SELECT c.doc_id AS doc_id, a || ':' || b AS location, substr(text, a + 1, b - a) AS text FROM c JOIN t ON t.doc_id = c.doc_id WHERE b IS NOT NULL""",
    "info_counts": """SELECT 'Region' AS name, 'NODE' AS type, count(*) AS rows FROM region UNION ALL SELECT 'Nation', 'NODE', count(*) FROM nation UNION ALL SELECT 'Customer', 'NODE', count(*) FROM customer
        UNION ALL SELECT 'Supplier', 'NODE', count(*) FROM supplier UNION ALL SELECT 'Part', 'NODE', count(*) FROM part UNION ALL SELECT 'Order', 'NODE', count(*) FROM orders UNION ALL SELECT 'Document', 'NODE', count(*) FROM documents
        UNION ALL SELECT 'IN_REGION', 'REL', count(*) FROM nation UNION ALL SELECT 'LIVES_IN', 'REL', count(*) FROM customer UNION ALL SELECT 'BASED_IN', 'REL', count(*) FROM supplier
        UNION ALL SELECT 'PLACED', 'REL', count(*) FROM orders UNION ALL SELECT 'CONTAINS', 'REL', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIED', 'REL', count(*) FROM lineitem""",
}
