"""The query language on a small graph with literal expected rows, and against a plain evaluator on random graphs."""

import itertools
import random

import pytest

from graphloom.graph import DST, SRC, Graph
from graphloom.plans.parser import QueryError, parse


@pytest.fixture(scope="module")
def g(spark):
    graph = Graph(spark)
    people = [(1, "Ann", 30, ["a", "b"]), (2, "Bob", None, []), (3, "Cid", 41, None), (4, "O'Hara", 25, ["c"])]
    graph.add_nodes("Person", spark.createDataFrame(people, "id long, name string, age int, tags array<string>"), "id")
    firms = [("x", "Xeno", ("NY", 5)), ("y", "Yard", None)]
    graph.add_nodes("Firm", spark.createDataFrame(firms, "id string, name string, seat struct<city string, floor int>"), "id")
    graph.add_edges("KNOWS", "Person", "Person", spark.createDataFrame([(1, 2, 2001), (2, 3, None), (3, 1, 1999), (3, 3, 2020)], f"{SRC} long, {DST} long, since int"))
    graph.add_edges("WORKS_AT", "Person", "Firm", spark.createDataFrame([(1, "x", "boss"), (2, "x", None)], f"{SRC} long, {DST} string, role string"))
    return graph


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


CASES = [
    ("MATCH (p:Person) WHERE p.age > 26 RETURN p.name", [("Ann",), ("Cid",)]),
    ("MATCH (p:Person) RETURN p.name ORDER BY p.age, p.name LIMIT 2", [("Ann",), ("O'Hara",)]),
    ("MATCH (p:Person) RETURN p.name ORDER BY p.age DESC LIMIT 1", [("Bob",)]),
    ("MATCH (p:Person {name: 'O\\'Hara'}) RETURN p.id AS id", [(4,)]),
    ("MATCH (a)-[r:KNOWS]->(b) RETURN a.name, b.name, r.since", [("Ann", "Bob", 2001), ("Bob", "Cid", None), ("Cid", "Ann", 1999), ("Cid", "Cid", 2020)]),
    ("MATCH (a:Person)-[:KNOWS]-(b:Person) RETURN a.name AS n, count(*) AS k", [("Ann", 2), ("Bob", 2), ("Cid", 3)]),
    ("MATCH (a:Person)-[:KNOWS]->(b)-[:KNOWS]->(c) RETURN a.name, c.name", [("Ann", "Cid"), ("Bob", "Ann"), ("Bob", "Cid"), ("Cid", "Ann"), ("Cid", "Bob")]),
    ("MATCH (p:Person) OPTIONAL MATCH (p)-[w:WORKS_AT]->(f:Firm) RETURN p.name, f.name, w.role", [("Ann", "Xeno", "boss"), ("Bob", "Xeno", None), ("Cid", None, None), ("O'Hara", None, None)]),
    ("MATCH (n) WHERE NOT (n)--() RETURN n.name", [("O'Hara",), ("Yard",)]),
    ("MATCH (p:Person) WHERE EXISTS { MATCH (p)-[:WORKS_AT]->() } RETURN p.name", [("Ann",), ("Bob",)]),
    ("MATCH (p:Person) RETURN p.name AS n, (p)-[:WORKS_AT]->() AS works", [("Ann", True), ("Bob", True), ("Cid", False), ("O'Hara", False)]),
    ("MATCH (a:Person)-[:WORKS_AT]->(f)<-[:WORKS_AT]-(b) WHERE a <> b RETURN a.name, b.name", [("Ann", "Bob"), ("Bob", "Ann")]),
    ("MATCH (f:Firm) WHERE f.seat.floor > 4 RETURN f.seat.city", [("NY",)]),
    ("MATCH (p:Person) UNWIND p.tags AS t RETURN p.name, t", [("Ann", "a"), ("Ann", "b"), ("O'Hara", "c")]),
    ("MATCH (p:Person) RETURN size(p.tags) AS n, p.tags[0] AS first, p.tags[-1] AS last, p.tags[9] AS none ORDER BY p.id LIMIT 1", [(2, "a", "b", None)]),
    ("MATCH (p:Person) WITH collect(p) AS ps RETURN size([x IN ps WHERE x.age > 26]) AS n, array_sort([x IN ps | x.name])[0] AS first", [(2, "Ann")]),
    ("MATCH (p:Person) WITH p, CASE WHEN p.age IS NULL THEN 'none' WHEN p.age > 28 THEN 'old' ELSE 'young' END AS k RETURN k, count(p) AS n", [("none", 1), ("old", 2), ("young", 1)]),
    ("MATCH (p:Person) WHERE p.name =~ '.n.' OR p.name STARTS WITH 'B' XOR p.name ENDS WITH 'b' RETURN p.name", [("Ann",)]),
    ("MATCH (p:Person) WHERE p.id IN [1, 3] AND NOT p.name CONTAINS 'd' RETURN p.name + '!' AS x", [("Ann!",)]),
    ("MATCH p = shortestPath((a:Person)-[:KNOWS*..4]->(b:Person)) WHERE a.name = 'Ann' AND b.name = 'Cid' RETURN length(p) AS n, nodes(p) AS at", [(2, ["Person:1", "Person:2", "Person:3"])]),
    ("MATCH (a:Person {name: 'Ann'})-[:KNOWS*1..3]->(b) RETURN b.name, count(*) AS n", [("Ann", 1), ("Bob", 1), ("Cid", 2)]),
    ("MATCH (a:Person {name: 'Ann'})-[:KNOWS*0..1]->(b) RETURN b.name", [("Ann",), ("Bob",)]),
    ("MATCH p = (a:Person)-[:WORKS_AT]->(f) RETURN a.name, length(p) AS n", [("Ann", 1), ("Bob", 1)]),
    ("MATCH (a:Person), (f:Firm) WHERE a.age > 40 RETURN a.name, f.name", [("Cid", "Xeno"), ("Cid", "Yard")]),
    ("MATCH (p:Person) RETURN count(p) AS a, count(p.age) AS b, sum(p.age) AS c, avg(p.age) AS d, min(p.name) AS e, count(DISTINCT p.age) AS f", [(4, 3, 96, 32.0, "Ann", 3)]),
    ("MATCH (p:Person) WITH p.age AS age WHERE age IS NOT NULL RETURN max(age) - min(age) AS spread", [(16,)]),
    ("MATCH (p:Person)-[:WORKS_AT]->(f:Firm) RETURN f.name AS f, count(p) AS n UNION MATCH (f:Firm) RETURN f.name AS f, 2 AS n", [("Xeno", 2), ("Yard", 2)]),
    ("MATCH (n:Person|Firm) RETURN labels(n)[0] AS l, count(n) AS n", [("Firm", 2), ("Person", 4)]),
    ("MATCH (p:Person) WHERE p.name = 'Bob' RETURN keys(p) AS k", [(["id", "name", "tags"],)]),
    ("MATCH (p:Person) RETURN DISTINCT p.age / 0 AS x", [(None,)]),
    ("MATCH (p:Person {id: 1}) RETURN p", [(("Person:1", "Person", 1, "Ann", 30, ["a", "b"]),)]),
    ("MATCH (a)-[r:WORKS_AT]->(b) WHERE r.role IS NOT NULL RETURN *", None),
    ("MATCH (p:Person) RETURN p.name AS n, count(*) GROUP BY p.name ORDER BY n SKIP 1 LIMIT 1", [("Bob", 1)]),
    ("UNWIND [1, 2, 3] AS x RETURN x * 2 + 1 AS y, x % 2 AS odd", [(3, 1), (5, 0), (7, 1)]),
    ("MATCH (p:Person) RETURN substring(p.name, 1, 2) AS s, toInteger('7') AS i, toInteger('x') AS bad, date('2024-02-30') AS d ORDER BY s LIMIT 1", [("'H", 7, None, None)]),
    ("RETURN array_join(['a', 'b'], ';') AS j, toInteger('9007199254740993') AS i, toInteger('3.7') AS k, toInteger('1e30') AS big, round(0.125, 2) AS r", [("a;b", 9007199254740993, 3, None, 0.13)]),
    ("UNWIND [0, 1, 1, 1] AS x RETURN avg(DISTINCT x) AS a, stdev(DISTINCT x) AS s, stdevp(DISTINCT x) AS p, sum(DISTINCT x) AS t", [(0.5, 0.5**0.5, 0.5, 1)]),
    ("MATCH (a:Person)-[r:WORKS_AT]->(f:Firm)<-[:WORKS_AT*1..1]-(b:Person) RETURN a.name, b.name", [("Ann", "Bob"), ("Bob", "Ann")]),
    ("MATCH (a:Person)-[:WORKS_AT*1..1]->(f:Firm)<-[:WORKS_AT*1..2]-(b:Person) RETURN a.name, b.name", [("Ann", "Bob"), ("Bob", "Ann")]),
    ("MATCH (a)-[*0..1]->(f:Firm) RETURN labels(a)[0] AS l, f.name AS f", [("Firm", "Xeno"), ("Firm", "Yard"), ("Person", "Xeno"), ("Person", "Xeno")]),
    ("MATCH (a:Person)-[:KNOWS*1..2]->(m) RETURN a.name, m.name", [("Ann", "Bob"), ("Ann", "Cid"), ("Bob", "Cid"), ("Bob", "Ann"), ("Bob", "Cid"), ("Cid", "Ann"), ("Cid", "Bob"), ("Cid", "Cid"), ("Cid", "Ann")]),
    ("MATCH (a:Firm)-[:KNOWS*1..2]->(m) RETURN count(m) AS n", [(0,)]),
    ("MATCH p = shortestPath((a)-[*..3]-(f:Firm {id: 'x'})) RETURN a.name AS a, length(p) AS n", [("Ann", 1), ("Bob", 1), ("Cid", 2)]),
    ("MATCH (f:Firm) MATCH p = shortestPath((a:Person)-[*..3]->(f)) RETURN a.name AS a, nodes(p) AS n", [("Ann", ["Person:1", "Firm:x"]), ("Bob", ["Person:2", "Firm:x"]), ("Cid", ["Person:3", "Person:1", "Firm:x"])]),
    ("MATCH (n) WHERE NOT (n)--() RETURN labels(n)[0] AS l, n.name AS n", [("Firm", "Yard"), ("Person", "O'Hara")]),
    ("MATCH (n) WHERE (n)-[:WORKS_AT]->() OR n.name = 'Yard' RETURN id(n) AS i, count(n) AS k", [("Person:1", 1), ("Person:2", 1), ("Firm:y", 1)]),
    ("CALL table_info('Firm') RETURN name, type", [("id", "STRING"), ("name", "STRING"), ("seat", "STRUCT(city STRING, floor INT32)")]),
    ("CALL show_tables() RETURN *", [("Firm", "NODE"), ("KNOWS", "REL"), ("Person", "NODE"), ("WORKS_AT", "REL")]),
]


@pytest.mark.parametrize("text,want", CASES, ids=[c[0][:60] for c in CASES])
def test_query(g, text, want):
    got = rows(g.cypher(text))
    assert want is None and got or got == sorted(want, key=str)


def test_default_column_names(g):
    assert g.cypher("MATCH (p:Person) RETURN p.name, count( * )").columns == ["p.name", "count( * )"]
    assert g.cypher("MATCH (a:Person)-[r:KNOWS]->(b:Person) RETURN *").columns == ["a", "r", "b"]


def test_parameters(g):
    assert rows(g.cypher("MATCH (p:Person) WHERE p.id IN $ids AND p.age > $age RETURN p.name", {"ids": [1, 3], "age": 35})) == [("Cid",)]
    with pytest.raises(QueryError, match="no parameter"):
        g.cypher("MATCH (p:Person {id: $x}) RETURN p.name")


@pytest.mark.parametrize(
    "text,why",
    [
        ("MATCH (p:Persn) RETURN p", "no node label"), ("MATCH (p:Person)-[:KNEW]->() RETURN p", "no edge type"), ("MATCH (p:Person) RETURN p.nam", "no property"),
        ("MATCH (p:Person) RETURN q.name", "no variable"), ("MATCH (p:Person", "expected"), ("MATCH (p:Person) RETURN nosuch(p.name)", "no function"),
        ("CREATE (p:Person {id: 9}) RETURN p", "change the graph"), ("MATCH (p:Person)", "ends with RETURN"), ("RETURN ~", "unexpected character"),
    ],
)
def test_errors(g, text, why):
    with pytest.raises(QueryError, match=why):
        g.cypher(text)


def test_walks_may_reuse_edges(g):
    q = "MATCH (a:Person)-[:WORKS_AT]->(f)<-[:WORKS_AT]-(b) RETURN count(*) AS n"
    assert rows(g.cypher(q)) == [(2,)] and rows(g.cypher(q, walk=True)) == [(4,)]


def test_unbounded_length_stops_at_max_hops(g):
    assert rows(g.cypher("MATCH (a:Person {id: 1})-[:KNOWS*]->(b) RETURN count(*) AS n", max_hops=2)) == [(2,)]


def test_unlabelled_patterns_use_only_tables_that_fit(g):
    df = g.cypher("MATCH (a)-[:WORKS_AT]->(b) RETURN a.name, b.name")
    assert "KNOWS" not in df._jdf.queryExecution().analyzed().toString()


def test_comments_and_quoted_names():
    q = parse("MATCH (`odd name`:L) // a comment\n /* another */ RETURN `odd name`.`p q` AS x;")
    assert q.parts[0][0].paths[0].nodes[0].variable == "odd name"


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs_against_plain_evaluation(spark, seed):
    rng = random.Random(seed)
    n = 6
    edges = [(i, rng.randrange(n), rng.randrange(n)) for i in range(9)]
    graph = Graph(spark)
    graph.add_nodes("N", spark.createDataFrame([(i, i % 3) for i in range(n)], "id int, c int"), "id")
    graph.add_edges("E", "N", "N", spark.createDataFrame([(a, b, str(i)) for i, a, b in edges], f"{SRC} int, {DST} int, _eid string"))
    got = rows(graph.cypher("MATCH (a:N)-[r:E]->(b:N)-[s:E]-(c:N) WHERE a.c <> c.c RETURN a.id, b.id, c.id"))
    want = []
    for (i, a, b), (j, x, y) in itertools.product(edges, edges):
        if i != j:
            want += [(a, b, v) for u, v in ({(x, y), (y, x)}) if u == b and a % 3 != v % 3]
    assert got == sorted(want, key=str)
    trails = []

    def go(at, used, first):
        if 1 <= len(used) <= 3:
            trails.append((first, at))
        if len(used) < 3:
            for i, a, b in edges:
                if a == at and i not in used:
                    go(b, used | {i}, first)

    for v in range(n):
        go(v, frozenset(), v)
    assert rows(graph.cypher("MATCH (a:N)-[:E*1..3]->(b:N) RETURN a.id, b.id")) == sorted(trails, key=str)
    # a fixed edge beside a path of variable length, and two such paths: no edge is used twice
    hops = lambda at, used, k: [(b, used | {i}) for i, a, b in edges if a == at and i not in used] if k == 1 else [y for b, u in hops(at, used, 1) for y in hops(b, u, k - 1)]
    beside = [(a, b, c) for i, a, b in edges for k in (1, 2) for c, _ in hops(b, frozenset([i]), k)]
    assert rows(graph.cypher("MATCH (a:N)-[:E]->(b:N)-[:E*1..2]->(c:N) RETURN a.id, b.id, c.id")) == sorted(beside, key=str)
    twice = [(a, b, c) for a in range(n) for k in (1, 2) for b, used in hops(a, frozenset(), k) for j in (1, 2) for c, _ in hops(b, used, j)]
    assert rows(graph.cypher("MATCH (a:N)-[:E*1..2]->(b:N)-[:E*1..2]->(c:N) RETURN a.id, b.id, c.id")) == sorted(twice, key=str)


def test_loops(g):
    assert rows(g.cypher("MATCH (a:Person)-[:KNOWS]->(a) RETURN a.name")) == [("Cid",)]
    assert rows(g.cypher("MATCH (a:Person)-[:KNOWS]->(a) RETURN count(a) AS n")) == [(1,)]
    assert rows(g.cypher("MATCH (a:Firm)-[:KNOWS]->(b) RETURN count(b) AS n")) == [(0,)]
