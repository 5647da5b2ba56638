"""Exports, descriptions, questions, vectors and the command line."""

import enum
import json
from dataclasses import dataclass

import pytest

from graphloom.__main__ import main
from graphloom.ask import TemplateTranslator, ask, bare_query, limited, prompt_for, query_tool
from graphloom.docs import describe_schema, parse_schema_text
from graphloom.graph import DST, SRC, Graph
from graphloom.operators import export, vector
from graphloom.schema import EdgeSpec, GraphSchema, NodeSpec

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def g(spark):
    graph = Graph(spark)
    graph.add_nodes("Person", spark.createDataFrame([(1, " Ann ", "x" * 40, "t"), (2, "", "Title", None), (3, None, "", None)], "id long, name string, title string, _created_at string"), "id")
    graph.add_nodes("text_chunk", spark.createDataFrame([(1, "c")], "id long, name string"), "id")
    graph.add_edges("KNOWS", "Person", "Person", spark.createDataFrame([(1, 2, 2.0), (1, 2, 3.0), (2, 9, 1.0)], f"{SRC} long, {DST} long, weight double"), dangling=True)
    graph.add_edges("HAS", "Person", "text_chunk", spark.createDataFrame([(1, 1)], f"{SRC} long, {DST} long"))
    return graph


def test_node_names(g):
    got = {r["id"]: r for r in export.graph_nodes(g, ["Person"]).collect()}
    assert got["Person:1"]["name"] == "Ann" and got["Person:2"]["name"] == "Title" and got["Person:3"]["name"] == "3"
    assert got["Person:1"]["properties"] == {"id": "1", "name": "Ann", "title": "x" * 40, "_created_at": "t"}


def test_links_without_ends_go(g):
    assert export.graph_links(g).count() == 4
    assert export.graph_links(g, ["KNOWS"], export.graph_nodes(g)).count() == 2
    assert {r["weight"] for r in export.merged_links(export.graph_links(g)).collect()} == {1, 2}


def test_pages(g):
    page = export.graph_html(g, "A & B")
    data = json.loads(page.split("const graph = ")[1].split(";\nconst svg")[0].replace("<\\/", "</"))
    assert "A &amp; B" in page and len(data["nodes"]) == 4 and len(data["links"]) == 3
    only = export.result_html(g.cypher("MATCH (a:Person)-[r:KNOWS]->(b:Person) WHERE r.weight > 2 RETURN a, r, b"))
    data = json.loads(only.split("const graph = ")[1].split(";\nconst svg")[0])
    assert len(data["nodes"]) == 2 and len(data["links"]) == 1
    assert export.label_colour("Person") == export.label_colour("Person") and all(int(export.label_colour(x)[i : i + 2], 16) >= 100 for x in "abc" for i in (1, 3, 5))
    assert export.link_weight({"weight": "2"}) == (2.0, {"default": 2.0}) and export.link_weight({"weight_a": "1", "weights": '{"b": 2, "c": 5}'}) == (2.0, {"b": 2.0, "c": 5.0, "a": 1.0})
    assert export.link_weight({"weight": "x"})[0] == export.link_weight({"weight_a": "7", "weights": "no"})[0] == 1.0


def test_large_graphs_are_written_whole_or_refused(spark, g, tmp_path):
    assert "2 of 4 nodes" in export.graph_html(g, limit=2)
    for write in (export.graph_html, export.cytoscape_json):
        with pytest.raises(export.TooLarge, match="4 nodes|3 nodes"):
            write(g, most=2)
    export.write_graph(g, f"file://{tmp_path}/g")
    assert spark.read.json(f"file://{tmp_path}/g/nodes").count() == 4 and spark.read.json(f"file://{tmp_path}/g/links").count() == 4
    many = spark.range(700).selectExpr("named_struct('_id', concat('P:', id), '_label', 'P', 'name', cast(id as string)) AS p")
    assert len(export.result_entities(many)[0]) == 700 and len(export.result_entities(many, 5)[0]) == 5


def test_cytoscape(g):
    elements = json.loads(export.cytoscape_json(g))
    assert not any("text_chunk" in json.dumps(e) for e in elements) and any(e["data"].get("id") == "Person:1-KNOWS-Person:2" for e in elements)


def test_tables_of_results(spark, tmp_path):
    df = spark.createDataFrame([(i, f"a|{i}") for i in range(25)], "n int, s string").coalesce(1)
    assert export.markdown(df, 2).splitlines() == ["| n | s |", "|---|---|", "| 0 | a\\|0 |", "| 1 | a\\|1 |"]
    assert export.console(df).splitlines()[-1].startswith("...") and len(export.console(df).splitlines()) == 22
    export.write_csv(df, f"file://{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").count() == 25


class Colour(enum.Enum):
    RED = 1
    BLUE = 2


@dataclass
class Wheel:
    size: int
    p_side_: str


@dataclass
class Car:
    name: str
    colour: Colour | None
    wheels: list[Wheel]
    metadata: dict | None = None


TEXT = '''
// comment with class Fake {
class Car {
  name string @description("what it is
    called")
  colour Colour? @description(#"its "paint" }"#)
  wheels Wheel[]
  @@description("A vehicle")
}
class Wheel { size int
  p_side_ string @description("left or right") }
enum Colour {
  RED @description("warm")
  BLUE
}
'''


def test_descriptions():
    found = parse_schema_text(TEXT)
    assert found["Car"].description == "A vehicle" and found["Car"].fields["name"].description == "what it is called" and found["Car"].fields["colour"].description == 'its "paint" }'
    assert found["Colour"].values == {"RED": "warm", "BLUE": ""} and found["Wheel"].fields["p_side_"].type == "string"
    s = GraphSchema(Car, [NodeSpec(Car, "name"), NodeSpec(Wheel, "size")], [EdgeSpec(Car, Wheel, "HAS_WHEEL", "rolls on")])
    text = describe_schema([s, s], TEXT)
    assert "### Car: A vehicle" in text and "- colour: enum(Colour)? - its" in text and "- (Car)-[:HAS_WHEEL]->(Wheel) - rolls on" in text and "- side: string - left or right" in text and "- Colour: RED, BLUE" in text
    assert text.count("### Car") == 1 and "Enumerations" not in describe_schema(s, print_enums=False)


def test_questions(g):
    assert ask(g, "How many persons are there?").first()[0] == 3
    assert bare_query("Sure:\n```cypher\nMATCH (n) RETURN n;\n```") == "MATCH (n) RETURN n" and bare_query("Answer: MATCH (n) RETURN n") == "MATCH (n) RETURN n"
    assert limited("MATCH (n) RETURN n", 30).endswith("LIMIT 30") and limited("MATCH (n) RETURN n LIMIT 2", 30).endswith("LIMIT 2")
    with pytest.raises(RuntimeError, match="MATCH"):
        ask(g, "x", lambda prompt, question: "MATCH (n:Nope) RETURN n")
    with pytest.raises(ValueError):
        TemplateTranslator(g)("", "what is love")
    assert "Question: why" in prompt_for("# schema", "why")
    tool = query_tool(g)
    assert "| 3 |" in tool("MATCH (p:Person) RETURN count(p) AS n") and tool("MATCH (p:Person) SET p.name = 'x' RETURN p").startswith("Error")


def test_vectors(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", "# Cats\n\ncats purr and sleep\n\n" * 60), ("b.md", "# Ships\n\nships sail the sea\n\n" * 60), ("c.md", None)], "filename string, content string")
    store = vector.VectorStore(spark, f"file://{tmp_path}/v", vector.fake_embedder(64))
    assert store.add(docs, size=300, overlap=50).select("filename").distinct().count() == 2
    before = store.read().count()
    assert store.search("ships sea", 3).select("filename").distinct().collect() == [("b.md",)]
    store.add(docs.filter("filename = 'a.md'"), size=300, overlap=50)
    assert store.read().count() == before
    assert vector.chunk_text("", 10, 2) == [] and vector.chunk_text("abc", 10, 2) == [(0, 3)]
    with pytest.raises(ValueError):
        vector.chunk_text("abc", 10, 10)


def test_command_line(spark, capsys):
    assert main(["--tables", SF, "cypher", "MATCH (n:Nation) RETURN count(n) AS n"]) == 0
    assert capsys.readouterr().out.split() == ["n", "25"]
    assert main(["--tables", SF, "info", "-g", "Region", "-g", "IN_REGION"]) == 0
    assert "Region" in (out := capsys.readouterr().out) and "Customer" not in out
    assert main(["--tables", SF, "query", "how many nations?"]) == 0
    assert "25" in capsys.readouterr().out
