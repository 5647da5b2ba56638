"""Registered queries over the graph view, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import trade_graph

Query = Callable[[SparkSession, str], DataFrame]

#: name: (graph query, SQL)
CYPHER: dict[str, tuple[str, str]] = {
    "node_scan": (
        "MATCH (n:Nation) RETURN n.n_nationkey AS nationkey, n.n_name AS nation",
        "SELECT n_nationkey AS nationkey, n_name AS nation FROM nation",
    ),
    "node_scan_any": (
        "MATCH (n) RETURN labels(n)[0] AS label, id(n) AS id",
        """SELECT 'Region' AS label, 'Region:' || r_regionkey AS id FROM region UNION ALL SELECT 'Nation', 'Nation:' || n_nationkey FROM nation
        UNION ALL SELECT 'Customer', 'Customer:' || c_custkey FROM customer UNION ALL SELECT 'Supplier', 'Supplier:' || s_suppkey FROM supplier
        UNION ALL SELECT 'Part', 'Part:' || p_partkey FROM part UNION ALL SELECT 'Order', 'Order:' || o_orderkey FROM orders
        UNION ALL SELECT 'Document', 'Document:' || doc_id FROM documents""",
    ),
    "edge_scan_typed": (
        "MATCH (o:Order)-[r:CONTAINS]->(p:Part) RETURN o.o_orderkey AS orderkey, p.p_partkey AS partkey, r.linenumber AS linenumber",
        "SELECT l_orderkey AS orderkey, l_partkey AS partkey, l_linenumber AS linenumber FROM lineitem",
    ),
    "edge_scan_any": (
        "MATCH (n)-[r]->(m) RETURN id(n) AS src, type(r) AS type, id(m) AS dst",
        """SELECT 'Nation:' || n_nationkey AS src, 'IN_REGION' AS type, 'Region:' || n_regionkey AS dst FROM nation
        UNION ALL SELECT 'Customer:' || c_custkey, 'LIVES_IN', 'Nation:' || c_nationkey FROM customer
        UNION ALL SELECT 'Supplier:' || s_suppkey, 'BASED_IN', 'Nation:' || s_nationkey FROM supplier
        UNION ALL SELECT 'Customer:' || o_custkey, 'PLACED', 'Order:' || o_orderkey FROM orders
        UNION ALL SELECT 'Order:' || l_orderkey, 'CONTAINS', 'Part:' || l_partkey FROM lineitem
        UNION ALL SELECT 'Supplier:' || l_suppkey, 'SUPPLIED', 'Part:' || l_partkey FROM lineitem""",
    ),
    "label_histogram": (
        "MATCH (n) RETURN labels(n)[0] AS label, count(n) AS n ORDER BY n DESC, label",
        """SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer
        UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders
        UNION ALL SELECT 'Document', count(*) FROM documents""",
    ),
    "edge_type_histogram": (
        "MATCH ()-[r]->() RETURN type(r) AS type, count(r) AS n",
        """SELECT 'IN_REGION' AS type, count(*) AS n FROM nation UNION ALL SELECT 'LIVES_IN', count(*) FROM customer UNION ALL SELECT 'BASED_IN', count(*) FROM supplier
        UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIED', count(*) FROM lineitem""",
    ),
    "hop_directed": (
        "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN n.n_name AS nation, count(c) AS customers",
        "SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    ),
    "hop_reversed": (
        "MATCH (n:Nation)<-[:BASED_IN]-(s:Supplier) RETURN n.n_name AS nation, s.s_name AS supplier",
        "SELECT n_name AS nation, s_name AS supplier FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    ),
    "hop_undirected": (
        "MATCH (n:Nation)-[r]-(m) RETURN n.n_name AS nation, type(r) AS type, count(m) AS n",
        """SELECT n_name AS nation, 'IN_REGION' AS type, count(*) AS n FROM nation GROUP BY n_name
        UNION ALL SELECT n_name, 'LIVES_IN', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
        UNION ALL SELECT n_name, 'BASED_IN', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
    ),
    "two_hop_chain": (
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:LIVES_IN]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.r_name AS region, n.n_name AS nation, count(o) AS orders",
        "SELECT r_name AS region, n_name AS nation, count(*) AS orders FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name, n_name",
    ),
    "shared_neighbor_pairs": (
        "MATCH (a:Nation)-[:IN_REGION]->(r:Region)<-[:IN_REGION]-(b:Nation) WHERE a <> b RETURN a.n_name AS a, b.n_name AS b, r.r_name AS region",
        "SELECT a.n_name AS a, b.n_name AS b, r_name AS region FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey JOIN region ON r_regionkey = a.n_regionkey",
    ),
    "comma_patterns": (
        "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation), (s:Supplier)-[:BASED_IN]->(n) WHERE c.c_mktsegment = 'BUILDING' RETURN n.n_name AS nation, count(DISTINCT c) AS customers, count(DISTINCT s) AS suppliers",
        "SELECT n_name AS nation, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY n_name",
    ),
    "cross_match_filter": (
        "MATCH (c:Customer), (s:Supplier) WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal > s.s_acctbal RETURN s.s_name AS supplier, count(*) AS n",
        "SELECT s_name AS supplier, count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal > s_acctbal GROUP BY s_name",
    ),
    "inline_props": (
        "MATCH (c:Customer {c_mktsegment: 'AUTOMOBILE'})-[:PLACED]->(o:Order {o_orderstatus: 'F'}) RETURN c.c_name AS customer, o.o_orderkey AS orderkey",
        "SELECT c_name AS customer, o_orderkey AS orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'AUTOMOBILE' AND o_orderstatus = 'F'",
    ),
    "optional_match_counts": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) RETURN c.c_custkey AS custkey, count(DISTINCT o) AS orders",
        "SELECT c_custkey AS custkey, count(DISTINCT o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    ),
    "optional_match_where": (
        "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:BASED_IN]-(s:Supplier) WHERE s.s_acctbal > 5000 RETURN n.n_name AS nation, s.s_name AS supplier",
        "SELECT n_name AS nation, s_name AS supplier FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000",
    ),
    "orphan_nodes": (
        "MATCH (n) WHERE NOT (n)--() RETURN labels(n)[0] AS label, count(n) AS n",
        """SELECT * FROM (SELECT 'Document' AS label, count(*) AS n FROM documents
        UNION ALL SELECT 'Part', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)
        UNION ALL SELECT 'Region', count(*) FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)) WHERE n > 0""",
    ),
    "semi_pattern": (
        "MATCH (c:Customer) WHERE (c)-[:PLACED]->(:Order {o_orderstatus: 'P'}) RETURN c.c_custkey AS custkey",
        "SELECT c_custkey AS custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    ),
    "pattern_in_expression": (
        "MATCH (c:Customer) WHERE c.c_acctbal > 9000 OR NOT (c)-[:PLACED]->() RETURN c.c_custkey AS custkey",
        "SELECT c_custkey AS custkey FROM customer WHERE c_acctbal > 9000 OR c_custkey NOT IN (SELECT o_custkey FROM orders)",
    ),
    "with_having": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS orders WHERE orders > 12 RETURN c.c_name AS customer, orders",
        "SELECT c_name AS customer, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 12",
    ),
    "two_level_agg": (
        "MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer)-[:PLACED]->(o:Order) WITH n, c, count(o) AS orders RETURN n.n_name AS nation, max(orders) AS most, min(orders) AS least, count(c) AS customers",
        "SELECT n_name AS nation, max(k) AS most, min(k) AS least, count(*) AS customers FROM (SELECT n_name, c_custkey, count(*) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name, c_custkey) GROUP BY n_name",
    ),
    "collect_size": (
        "MATCH (n:Nation)<-[:BASED_IN]-(s:Supplier) WITH n, collect(s) AS suppliers WHERE size(suppliers) > 3 RETURN n.n_name AS nation, size(suppliers) AS n ORDER BY size(suppliers) DESC, nation",
        "SELECT n_name AS nation, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 3",
    ),
    "list_comp_filter": (
        "MATCH (n:Nation)<-[:BASED_IN]-(s:Supplier) WITH n, collect(s) AS suppliers RETURN n.n_name AS nation, size([x IN suppliers WHERE x.s_acctbal > 3000]) AS rich",
        "SELECT n_name AS nation, CAST(count(*) FILTER (WHERE s_acctbal > 3000) AS INTEGER) AS rich FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name",
    ),
    "list_comp_map": (
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r, collect(n) AS nations RETURN r.r_name AS region, array_join(array_sort([x IN nations | x.n_name]), ',') AS nations",
        "SELECT r_name AS region, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "unwind": (
        "MATCH (p:Part) UNWIND split(p.p_type, ' ') AS word RETURN word, count(*) AS n",
        "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part) GROUP BY word",
    ),
    "unwind_keys": (
        "MATCH (n:Nation) UNWIND keys(n) AS k WITH n.n_name AS nation, k WHERE k IN ['n_name', 'n_regionkey'] RETURN DISTINCT k AS property",
        "SELECT 'n_name' AS property UNION ALL SELECT 'n_regionkey'",
    ),
    "return_distinct": (
        "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN DISTINCT c.c_mktsegment AS segment, n.n_name AS nation",
        "SELECT DISTINCT c_mktsegment AS segment, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey",
    ),
    "union_paths": (
        "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) WHERE c.c_acctbal > 9000 RETURN n.n_name AS nation UNION MATCH (s:Supplier)-[:BASED_IN]->(n:Nation) WHERE s.s_acctbal > 9000 RETURN n.n_name AS nation",
        "SELECT n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 UNION SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 9000",
    ),
    "union_all_paths": (
        "MATCH (c:Customer) RETURN c.c_nationkey AS nationkey UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS nationkey",
        "SELECT c_nationkey AS nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    ),
    "var_length_1_4": (
        "MATCH (a)-[*1..4]->(m) RETURN labels(a)[0] AS start, labels(m)[0] AS label, count(*) AS n",
        """SELECT 'Nation' AS start, 'Region' AS label, count(*) AS n FROM nation UNION ALL SELECT 'Customer', 'Nation', count(*) FROM customer UNION ALL SELECT 'Supplier', 'Nation', count(*) FROM supplier
        UNION ALL SELECT 'Customer', 'Order', count(*) FROM orders UNION ALL SELECT 'Order', 'Part', count(*) FROM lineitem UNION ALL SELECT 'Supplier', 'Part', count(*) FROM lineitem
        UNION ALL SELECT 'Customer', 'Region', count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'Supplier', 'Region', count(*) FROM supplier JOIN nation ON n_nationkey = s_nationkey
        UNION ALL SELECT 'Customer', 'Part', count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
    ),
    "var_length_bounds": (
        "MATCH (c:Customer)-[*2..2]->(m) RETURN labels(m)[0] AS label, count(*) AS n",
        """SELECT 'Region' AS label, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey
        UNION ALL SELECT 'Part', count(*) FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey""",
    ),
    "var_length_undirected": (
        "MATCH (r:Region)-[:IN_REGION|LIVES_IN|PLACED*..3]-(m) RETURN r.r_name AS region, labels(m)[0] AS label, count(*) AS n",
        """WITH n AS (SELECT r_name AS region, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey), c AS (SELECT region, c_custkey FROM n JOIN customer ON c_nationkey = n_nationkey)
        SELECT region, 'Nation' AS label, count(*) AS n FROM n GROUP BY region UNION ALL SELECT region, 'Customer', count(*) FROM c GROUP BY region
        UNION ALL SELECT region, 'Order', count(*) FROM c JOIN orders ON o_custkey = c_custkey GROUP BY region""",
    ),
    "edge_uniqueness_var_length": (
        "MATCH (a:Customer)-[r:PLACED]->(o:Order)<-[:PLACED*1..1]-(b:Customer) RETURN count(*) AS n",
        "SELECT 0::BIGINT AS n",
    ),
    "trail_beside_edge": (
        "MATCH (n:Nation)-[:IN_REGION]->(r:Region)<-[:IN_REGION*1..1]-(m:Nation) RETURN n.n_name AS a, m.n_name AS b",
        "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey",
    ),
    "shortest_path_len": (
        "MATCH p = shortestPath((a:Nation)-[*..4]-(b:Nation)) WHERE a <> b RETURN a.n_name AS a, b.n_name AS b, length(p) AS hops",
        """WITH near AS (SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey),
        sells AS (SELECT DISTINCT n_name, l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
        far AS (SELECT DISTINCT x.n_name AS a, y.n_name AS b FROM sells x JOIN sells y ON x.l_partkey = y.l_partkey AND x.n_name <> y.n_name)
        SELECT a, b, 2::INTEGER AS hops FROM near UNION ALL SELECT a, b, 4 FROM (SELECT * FROM far EXCEPT SELECT * FROM near)""",
    ),
    "shortest_path_in_region": (
        "MATCH p = shortestPath((a:Nation)-[:IN_REGION*..2]-(b:Nation)) WHERE a <> b RETURN a.n_name AS a, b.n_name AS b, length(p) AS hops",
        "SELECT a.n_name AS a, b.n_name AS b, 2::INTEGER AS hops FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey",
    ),
    "join_delimiter": (
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r, collect(n.n_name) AS names RETURN r.r_name AS region, array_join(array_sort(names), '; ') AS nations",
        "SELECT r_name AS region, string_agg(n_name, '; ' ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "avg_distinct": (
        "MATCH (o:Order)-[r:CONTAINS]->() RETURN o.o_orderstatus AS status, avg(DISTINCT r.linenumber) AS mean, round(stdev(DISTINCT r.linenumber), 6) AS deviation, sum(DISTINCT r.linenumber) AS total",
        "SELECT o_orderstatus AS status, avg(DISTINCT l_linenumber) AS mean, round(stddev_samp(DISTINCT l_linenumber), 6) AS deviation, sum(DISTINCT l_linenumber)::BIGINT AS total FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
    ),
    "to_integer": (
        "MATCH (o:Order) RETURN o.o_orderkey AS orderkey, toInteger(toString(o.o_orderkey + 9007199254740993)) AS big, toInteger(toString(o.o_totalprice)) AS whole",
        "SELECT o_orderkey AS orderkey, o_orderkey + 9007199254740993 AS big, trunc(o_totalprice)::BIGINT AS whole FROM orders",
    ),
    "degree_topk": (
        "MATCH (n:Part)-[r]-() RETURN n.p_partkey AS partkey, count(r) AS degree ORDER BY degree DESC, partkey LIMIT 10",
        "SELECT l_partkey AS partkey, 2 * count(*) AS degree FROM lineitem GROUP BY l_partkey ORDER BY degree DESC, partkey LIMIT 10",
    ),
    "global_stats": (
        "MATCH (o:Order) RETURN count(*) AS n, max(o.o_totalprice) AS most, min(o.o_totalprice) AS least, round(avg(o.o_totalprice), 2) AS mean, count(DISTINCT o.o_orderstatus) AS kinds",
        "SELECT count(*) AS n, max(o_totalprice) AS most, min(o_totalprice) AS least, round(avg(o_totalprice), 2) AS mean, count(DISTINCT o_orderstatus) AS kinds FROM orders",
    ),
    "year_histogram": (
        "MATCH (o:Order) RETURN substring(o.placed, 0, 4) AS year, count(*) AS n ORDER BY year",
        "SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS n FROM orders GROUP BY 1",
    ),
    "string_contains": (
        "MATCH (p:Part) WHERE toLower(p.p_name) CONTAINS 'a' AND p.p_brand STARTS WITH 'Brand#1' AND NOT p.p_type ENDS WITH 'TIN' RETURN p.p_partkey AS partkey",
        "SELECT p_partkey AS partkey FROM part WHERE contains(lower(p_name), 'a') AND starts_with(p_brand, 'Brand#1') AND NOT ends_with(p_type, 'TIN')",
    ),
    "split_word_count": (
        "MATCH (p:Part) RETURN size(split(p.p_type, ' ')) AS words, split(p.p_type, ' ')[0] AS first, count(*) AS n",
        "SELECT CAST(len(string_split(p_type, ' ')) AS INTEGER) AS words, string_split(p_type, ' ')[1] AS first, count(*) AS n FROM part GROUP BY 1, 2",
    ),
    "date_filter": (
        "MATCH (o:Order) WHERE date(o.placed) >= date('1995-01-01') AND date(o.placed) < date('1996-01-01') RETURN o.o_orderstatus AS status, count(*) AS n",
        "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-01-01' GROUP BY 1",
    ),
    "in_list": (
        "MATCH (c:Customer) WHERE c.c_mktsegment IN ['BUILDING', 'MACHINERY'] AND c.c_acctbal IS NOT NULL RETURN c.c_mktsegment AS segment, count(*) AS n",
        "SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal IS NOT NULL GROUP BY 1",
    ),
    "case_bucket": (
        "MATCH (o:Order) RETURN CASE WHEN o.o_totalprice > 300000 THEN 'large' WHEN o.o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS bucket, count(*) AS n",
        "SELECT CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS bucket, count(*) AS n FROM orders GROUP BY 1",
    ),
    "struct_access": (
        "MATCH (o:Order) WHERE o.terms.total > 200000 RETURN o.terms.priority AS priority, count(*) AS n",
        "SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1",
    ),
    "edge_props": (
        "MATCH (o:Order)-[r:CONTAINS {returnflag: 'R'}]->(p:Part) WHERE r.discount > 0.05 RETURN p.p_brand AS brand, sum(r.quantity) AS quantity, count(r) AS n",
        "SELECT p_brand AS brand, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_discount > 0.05 GROUP BY 1",
    ),
    "edge_uniqueness": (
        "MATCH (a:Customer)-[:PLACED]->(o:Order)<-[:PLACED]-(b:Customer) RETURN count(*) AS n",
        "SELECT 0::BIGINT AS n",
    ),
    "order_multi_key": (
        "MATCH (s:Supplier)-[:BASED_IN]->(n:Nation) RETURN n.n_name AS nation, s.s_name AS supplier ORDER BY n.n_name, s.s_acctbal DESC, s.s_name",
        "SELECT n_name AS nation, s_name AS supplier FROM supplier JOIN nation ON s_nationkey = n_nationkey ORDER BY n_name, s_acctbal DESC, s_name",
    ),
    "arithmetic": (
        "MATCH (o:Order)-[r:CONTAINS]->() RETURN o.o_orderkey % 10 AS digit, round(sum(r.extendedprice * (1 - r.discount)), 2) AS revenue, count(*) + 1 AS n",
        "SELECT o_orderkey % 10 AS digit, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) + 1 AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
    ),
    "skip_limit": (
        "MATCH (c:Customer) RETURN c.c_custkey AS custkey ORDER BY custkey SKIP 5 LIMIT 7",
        "SELECT c_custkey AS custkey FROM customer ORDER BY 1 LIMIT 7 OFFSET 5",
    ),
    "show_tables": (
        "CALL show_tables() RETURN name, type WHERE type = 'NODE'",
        "SELECT unnest(['Region', 'Nation', 'Customer', 'Supplier', 'Part', 'Order', 'Document']) AS name, 'NODE' AS type",
    ),
    "table_info": (
        "CALL table_info('Nation') RETURN name, type",
        "SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey', 'name']) AS name, unnest(['INT32', 'STRING', 'INT32', 'STRING']) AS type",
    ),
}


def cypher_query(text: str) -> Query:
    return lambda spark, sf_dir: trade_graph(spark, sf_dir).cypher(text)


QUERIES: dict[str, Query] = {name: cypher_query(text) for name, (text, _) in CYPHER.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in CYPHER.items()}
