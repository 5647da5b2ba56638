"""Types, schemas, extraction, upserts and the store."""

import enum
import json
from dataclasses import dataclass, field
from typing import Optional

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.kg import DocumentSubgraph, KnowledgeGraph, Profile, TableSubgraph, get_subgraph, list_subgraphs, query_times, register_subgraph
from graphloom.operators.extract import extract_edges, extract_nodes
from graphloom.operators.upsert import merge_nodes
from graphloom.plans.parser import QueryError
from graphloom.schema import EdgeSpec, ExtraStruct, GraphSchema, NodeSpec, combined
from graphloom.sources.tables import TableSource, json_map, load_table, parse_pull, pull, read_documents, resolve_column, snake_case, text_files
from graphloom.store import GraphStore
from graphloom.streaming.ingest import ingest_stream, read_document_stream
from graphloom.types import ddl_name, ddl_of, embedded_field, human_name, source_type


class Level(enum.Enum):
    LOW = "low"
    HIGH = "high"


@dataclass
class Money:
    tcv: float | None = None
    margin: Optional[float] = None


@dataclass
class Firm:
    name: str
    segment: str | None = None


@dataclass
class Deal:
    deal_id: str
    name: str
    customer: Firm


@dataclass
class Person:
    name: str | None
    mail: str | None = None
    p_role_: str | None = None


@dataclass
class Risk:
    level: str | None
    p_note_: str | None = None


@dataclass
class Review:
    name: str
    deal: Deal
    team: list[Person]
    risks: list[Risk] | None = None
    money: Money | None = None
    keywords: list[str] | None = None
    metadata: dict[str, str] | None = None


SOURCE = ExtraStruct("file_metadata", T.StructType([T.StructField("source", T.StringType())]), lambda item, root, key: F.struct(F.coalesce(key, root["metadata"]["source"]).alias("source")))


def review_schema(**options):
    nodes = [
        NodeSpec(Review, "name", extra=(SOURCE,), embedded=(Money,)), NodeSpec(Deal, "name", deduplication_key="deal_id"), NodeSpec(Firm, "name"), NodeSpec(Person, "name"),
        NodeSpec(Risk, lambda item, label: F.concat(F.lit("risk-"), F.coalesce(item["level"], F.lit("other")))),
    ]
    edges = [EdgeSpec(Review, Deal, "REVIEWS"), EdgeSpec(Deal, Firm, "HAS_CUSTOMER"), EdgeSpec(Review, Person, "HAS_TEAM"), EdgeSpec(Review, Risk, "HAS_RISK")]
    return GraphSchema(Review, nodes, edges, **options)


def documents(spark, entries, first=0):
    kind = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_ord", T.LongType()), *source_type(Review).fields])
    return spark.read.schema(kind).json(spark.sparkContext.parallelize([json.dumps({"_key": f"d{i}", "_ord": i, **e}) for i, e in enumerate(entries, first)]))


DOCS = [
    {"name": "r1", "deal": {"deal_id": "D1", "name": "first", "customer": {"name": "Acme", "segment": "Retail"}}, "team": [{"name": "Ann", "mail": "a@x", "p_role_": "lead"}, {"name": "Ann", "mail": "other"}, {"name": "O'Hara"}], "risks": [{"level": None, "p_note_": "n1"}], "money": {"tcv": 5.0}, "keywords": ["k1", "k2"], "metadata": {"source": "s1"}},
    {"name": "r2", "deal": {"deal_id": "D1", "name": "second", "customer": {"name": "Acme", "segment": ""}}, "team": [{"name": "Ann", "mail": "", "p_role_": "dev"}], "risks": None, "keywords": [], "metadata": {"source": "s2"}},
    {"name": "r1", "deal": {"deal_id": "D2", "name": "third", "customer": {"name": "Acme", "segment": "Bank"}}, "team": [], "keywords": []},
]


@pytest.mark.parametrize(
    "annotation,name",
    [(str, "STRING"), (int, "INT64"), (float, "DOUBLE"), (bool, "STRING"), (list[str], "STRING[]"), (list[str | None], "STRING[]"), (Optional[list[str]], "STRING[]"), (list, "STRING"), (list[int], "STRING[]"), (None, "STRING"), (Money, "STRING"), (Level, "STRING"), (Optional[int], "INT64"), (float | None, "DOUBLE"), (int | str, "STRING"), (dict, "STRING")],
)
def test_type_names(annotation, name):
    assert ddl_of(annotation) == name


def test_struct_type_names():
    assert ddl_of(Money, {Money}) == "STRUCT(tcv DOUBLE, margin DOUBLE)" == ddl_of(Money | None, {Money})
    assert ddl_name(T.MapType(T.StringType(), T.LongType())) == "MAP(STRING, INT64)"


def test_human_names():
    assert [human_name(x) for x in (str, int | None, list[str], Optional[list[Money]], Level, dict, bool, int | str)] == ["string", "int?", "string[]", "Money[]?", "enum(Level)", "object", "boolean", "int | string"]


def test_embedded_fields():
    assert embedded_field(Review, Money) == "money" and embedded_field(Review, Person) == "team" and embedded_field(Review, Level) is None


def test_deduction():
    s = review_schema()
    assert s.node_paths == {"Review": [""], "Deal": ["deal"], "Firm": ["deal.customer"], "Person": ["team"], "Risk": ["risks"]}
    assert s.edge_paths[("Deal", "Firm", "HAS_CUSTOMER")] == [("deal", "deal.customer")] and s.edge_paths[("Review", "Risk", "HAS_RISK")] == [("", "risks")]
    columns = s.node_columns("Review")
    assert columns.names == ["file_metadata", "id", "name", "_original_name", "_created_at", "_updated_at", "_dedup_key", "alternate_names", "money", "keywords", "metadata"]
    assert ddl_name(columns["money"].dataType) == "STRUCT(tcv DOUBLE, margin DOUBLE)"
    assert s.node_columns("Person").names[-1] == "mail" and s.edge_columns(s.edges[2]).names == ["_src", "_dst", "role"]
    assert not s.warnings


def test_warnings_and_simplest_path():
    @dataclass
    class Root:
        boss: Person
        team: list[Person]
        deep: Deal
        metadata: dict | None = None

    @dataclass
    class Stray:
        name: str

    s = GraphSchema(Root, [NodeSpec(Root, "boss"), NodeSpec(Person, "name"), NodeSpec(Stray, "name")], [EdgeSpec(Root, Person, "A"), EdgeSpec(Root, Person, "B"), EdgeSpec(Root, Firm, "C")])
    assert s.edge_paths[("Root", "Person", "A")] == [("", "boss")]
    text = "\n".join(s.warnings)
    assert "several ways" in text and "several edge types" in text and "no node configuration" in text and "lies nowhere" in text


def test_nodes_below_lists():
    @dataclass
    class Group:
        name: str
        members: list[Person]

    @dataclass
    class Top:
        name: str
        groups: list[Group]
        metadata: dict | None = None

    specs = [NodeSpec(Top, "name"), NodeSpec(Group, "name"), NodeSpec(Person, "name")]
    edges = [EdgeSpec(Group, Person, "HAS_MEMBER")]
    assert GraphSchema(Top, specs, edges).node_paths["Person"] == ["groups.members"]
    assert GraphSchema(Top, specs, edges, deep_lists=False).node_paths["Person"] == []
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is not None:
        kind = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_ord", T.LongType()), *source_type(Top).fields])
        entry = {"_key": "k", "_ord": 0, "name": "t", "groups": [{"name": "g1", "members": [{"name": "a"}, {"name": "b"}]}, {"name": "g2", "members": [{"name": "c"}]}]}
        docs = spark.read.schema(kind).json(spark.sparkContext.parallelize([json.dumps(entry)]))
        assert extract_edges(docs, GraphSchema(Top, specs, edges), edges[0]).count() == 3


def test_combined_schemas():
    a, b = review_schema(), review_schema()
    nodes, edges = combined([a, b])
    assert len(nodes) == 5 and len(edges) == 4


def test_extraction(spark):
    s, docs = review_schema(), documents(spark, DOCS)
    people = {(r["_key"], r["name"]): r["mail"] for r in extract_nodes(docs, s, "Person", "t").collect()}
    assert people == {("d0", "Ann"): "a@x", ("d0", "O'Hara"): None, ("d1", "Ann"): ""}  # the first of a document holds
    reviews = {r["_key"]: r for r in extract_nodes(docs, s, "Review", "t").collect()}
    assert reviews["d0"]["file_metadata"]["source"] == "d0" and reviews["d0"]["money"]["tcv"] == 5.0 and reviews["d1"]["metadata"]["source"] == "s2"
    assert [r["name"] for r in extract_nodes(docs, s, "Risk", "t").collect()] == ["risk-other"]
    team = extract_edges(docs, s, s.edges[2]).collect()
    assert sorted(str(r["role"]) for r in team) == ["None", "None", "dev", "lead"]


def test_unnamed_nodes(spark):
    s = review_schema()
    docs = documents(spark, [{"name": "", "deal": {"deal_id": "", "name": "n", "customer": {"name": "c"}}, "team": [{"name": None}], "metadata": None}])
    assert extract_nodes(docs, s, "Review", "t").first()["name"] == "Review_unnamed"
    assert extract_nodes(docs, s, "Deal", "t").first()["_dedup_key"] == "n"
    assert extract_edges(docs, s, s.edges[2]).count() == 1


def test_ingest(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g")
    first = store.add_documents(documents(spark, DOCS), review_schema(), now="2024-01-01T00:00:00Z")
    assert (first.documents, first.created, first.unresolved_edges) == (3, 2 + 2 + 1 + 2 + 1, 0)
    got = {r["name"]: r for r in store.nodes["Deal"].df.collect()}
    assert got["first"]["alternate_names"] == ["second"] and set(got) == {"first", "third"}
    firm = store.nodes["Firm"].df.first()
    assert firm["segment"] == "Bank"  # the last that is not blank
    assert store.nodes["Review"].df.filter("name = 'r1'").first()["keywords"] == ["k1", "k2"]
    before = {r["id"]: r.asDict() for r in store.nodes["Person"].df.collect()}
    again = store.add_documents(documents(spark, DOCS), review_schema(), now="2025-01-01T00:00:00Z")
    assert again.created == 0 and again.matched == first.created + first.matched
    after = {r["id"]: r.asDict() for r in store.nodes["Person"].df.collect()}
    assert before.keys() == after.keys() and all(after[i]["_created_at"] == "2024-01-01T00:00:00Z" and after[i]["_updated_at"] == "2025-01-01T00:00:00Z" for i in after)
    assert store.cypher("MATCH ()-[r:HAS_TEAM]->() RETURN count(r) AS n").first()["n"] == 8  # edges are a bag
    assert store.add_documents(documents(spark, DOCS), review_schema(), dedup_edges=True).edges == 0
    got = store.cypher("MATCH (r:Review)-[:REVIEWS]->(d:Deal)-[:HAS_CUSTOMER]->(f:Firm) RETURN DISTINCT r.name AS r, d.name AS d, f.name AS f ORDER BY r, d").collect()
    assert [tuple(r) for r in got] == [("r1", "first", "Acme"), ("r1", "third", "Acme"), ("r2", "first", "Acme")]
    # another session sees the same
    assert GraphStore(spark, store.path).info()["nodes"] == store.info()["nodes"] == 8


def test_order_decides_what_stays(spark):
    def one(o, name, v):
        return (o, "k", name, name, f"t{o}", f"t{o}", [], v)

    schema = "_at long, _dedup_key string, name string, _original_name string, _created_at string, _updated_at string, alternate_names array<string>, v string"
    merged = merge_nodes(None, spark.createDataFrame([one(2, "B", "x"), one(1, "A", ""), one(3, "A", " "), one(4, "C", None)], schema), "L").first()
    assert (merged["name"], merged["v"], merged["alternate_names"], merged["_created_at"], merged["_updated_at"]) == ("A", "x", ["B", "C"], "t1", "t4")
    later = merge_nodes(merge_nodes(None, spark.createDataFrame([one(9, "A", "old")], schema), "L"), spark.createDataFrame([one(1, "D", "new")], schema), "L").first()
    assert (later["name"], later["v"], later["alternate_names"]) == ("A", "new", ["D"])


def test_tables_by_hand(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g")
    store.create_node_table("City", {"id": T.StringType(), "name": T.StringType()}, "id")
    store.create_node_table("City", {"id": T.StringType()}, "id")  # it is there already
    store.create_relationship_table("ROAD", "City", "City", {"km": T.LongType()})
    run = lambda q: store.cypher(q, read_only=False)
    assert run("CREATE (c:City {id: 'a', name: 'Aa'}) RETURN c.id").first()[0] == "a"
    run("CREATE (c:City {id: 'b', name: 'Bb'})")
    run("MATCH (x:City {id: 'a'}), (y:City {id: 'b'}) CREATE (x)-[:ROAD {km: 7}]->(y)")
    run("MATCH (c:City) WHERE c.id = 'b' SET c.name = 'New'")
    assert [tuple(r) for r in store.cypher("MATCH (x)-[r:ROAD]->(y) RETURN x.name, r.km, y.name").collect()] == [("Aa", 7, "New")]
    assert store.insert_relationship("ROAD", "City", "City", [("b", "a", 3), ("City", "a", "City", "a", "ROAD", {"km": 1})], ("km",)) == 2
    assert store.cypher("MATCH ()-[r:ROAD]->() RETURN sum(r.km) AS km").first()["km"] == 11
    (tmp_path / "roads.csv").write_text("from,to,km\na,b,20\nb,b,5\nz,a,1\n")
    q = "LOAD CSV WITH HEADERS FROM $f AS row MATCH (x:City), (y:City) WHERE x.id = row.from AND y.id = row.to CREATE (x)-[:ROAD {km: toInteger(row.km)}]->(y)"
    store.cypher(q, {"f": f"file://{tmp_path}/roads.csv"}, read_only=False)
    assert store.cypher("MATCH ()-[r:ROAD]->() RETURN sum(r.km) AS km, count(r) AS n").first().asDict() == {"km": 36, "n": 5}
    store.compact("ROAD")
    assert store.counts().filter("name = 'ROAD'").first()["rows"] == 5
    with pytest.raises(QueryError):
        store.cypher("CREATE (c:City {id: 'z'})")
    assert store.drop_table("City") and not store.drop_table("City") and store.info()["tables"] == 0
    assert store.delete() and not store.nodes


def test_metadata_is_needed(spark, tmp_path):
    @dataclass
    class Bare:
        name: str

    with pytest.raises(ValueError, match="metadata"):
        GraphStore(spark, f"file://{tmp_path}/g").add_documents(spark.createDataFrame([("k", 1, "n")], "_key string, _ord long, name string"), GraphSchema(Bare, [NodeSpec(Bare, "name")], []))


def test_document_files(spark, tmp_path):
    for i, d in enumerate(DOCS[:2]):
        (tmp_path / f"doc{i}.json").write_text(json.dumps(d))
    (tmp_path / "bad.json").write_text("{not json")
    rows = read_documents(spark, f"file://{tmp_path}", Review)
    assert {r["_key"]: r["_corrupt_record"] is None for r in rows.select("_key", "_corrupt_record").collect()} == {"doc0": True, "doc1": True, "bad": False}
    store = GraphStore(spark, f"file://{tmp_path}/g")
    got = store.add_documents(rows.cache(), review_schema())
    assert (got.documents, got.failed) == (2, 1)


def test_table_source(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("Deal ID,Account Name,Status\nD1,Acme,open\nD2,Best,open\nD1,Acme,won\n,None,lost\n")
    b.write_text("Deal ID,Account Name,Status\nD2,Best,lost\nD3,Cool,open\n")
    t = TableSource(spark, f"file://{tmp_path}/t", "deal_id", "CrmExtract")
    assert t.name == "crm_extract" and t.changed(f"file://{a}") is None
    assert t.import_file(f"file://{a}") == {"rows": 4, "skipped": 1, "inserted": 2, "updated": 0}
    assert t.import_file(f"file://{a}")["rows"] == 0 and t.changed(f"file://{a}") is False
    assert t.import_file(f"file://{b}") == {"rows": 2, "skipped": 0, "inserted": 1, "updated": 1}
    status = lambda: {r["Deal ID"]: r["Status"] for r in t.rows().collect()}
    assert status() == {"D1": "won", "D2": "lost", "D3": "open"} and [r["key"] for r in t.all_keys().collect()] == ["D1", "D2", "D3"]
    assert t.by_field("account name", "Best").first()["Status"] == "lost" and t.by_key("D9").count() == 0
    b.write_text("Deal ID,Account Name,Status\nD4,Dear,open\n")
    assert t.changed(f"file://{b}") is True
    t.import_file(f"file://{b}")
    assert set(status()) == {"D1", "D4"} and t.ledger().count() == 2  # only the changed file's rows were replaced
    t.delete_file(f"file://{a}")
    assert set(status()) == {"D4"}


def test_names_and_formats(spark, tmp_path):
    assert snake_case("CrmExtract") == "crm_extract" and snake_case("HTTPServer") == "http_server"
    assert resolve_column(["A b", "a_b"], "a_b") == "a_b" and resolve_column(["Account Name"], "account_name") == "Account Name"
    with pytest.raises(KeyError):
        resolve_column(["x"], "y")
    with pytest.raises(ValueError):
        load_table(spark, "file.txt")
    assert parse_pull("deal.deal_id", ["Deal"]) == ("Deal", "deal_id") and parse_pull("Nope.x", ["Deal"]) is None and parse_pull("deal", ["Deal"]) is None
    got = spark.createDataFrame([('{"a": 1}',), ("oops",), (None,)], "t string").select(json_map(F.col("t")).alias("m")).collect()
    assert [r["m"] for r in got] == [{"a": "1"}, {}, {}]
    (tmp_path / "x.md").write_text("one")
    (tmp_path / "y.txt").write_text("two")
    (tmp_path / "skip.md").write_text("three")
    assert [r["content"] for r in text_files(spark, f"file://{tmp_path}", ("*.md",), ("skip*",)).collect()] == ["one"]


def test_pull(spark):
    nodes = spark.createDataFrame([("D1",), ("D1",), (None,), ("",), ("D9",)], "deal_id string")
    rows = spark.createDataFrame([(2, "D1", "late"), (1, "D1", "early"), (3, "D5", "x")], "k int, deal string, v string")
    assert [tuple(r) for r in pull(nodes, "deal_id", rows, "deal", "k").select("_value", "v").collect()] == [("D1", "early")]


def test_build(spark, tmp_path):
    @dataclass
    class Extract:
        name: str
        lead: Person
        metadata: dict | None = None

    (tmp_path / "crm.csv").write_text("deal,lead\nD1,Lea\nD7,Max\n")
    source = TableSource(spark, f"file://{tmp_path}/t", "deal", "Extract", lambda df: df.select("_key", F.col("deal").alias("name"), F.struct(F.col("lead").alias("name")).alias("lead")))
    source.import_file(f"file://{tmp_path}/crm.csv")
    crm = GraphSchema(Extract, [NodeSpec(Extract, "name"), NodeSpec(Person, "name")], [EdgeSpec(Extract, Person, "LED_BY")])
    register_subgraph("reviews", DocumentSubgraph("reviews", review_schema(), lambda s: documents(s, DOCS), ["MATCH (r:Review) RETURN r.name"]))
    register_subgraph("crm", lambda: TableSubgraph("crm", crm, lambda s: None, source=source, pull_on="deal.deal_id", pull_column="deal"))
    assert list_subgraphs() == ["crm", "reviews"] and get_subgraph("reviews").node_labels().keys() == {"Review", "Deal", "Firm", "Person", "Risk"}
    with pytest.raises(KeyError):
        get_subgraph("none")
    kg = KnowledgeGraph(spark, f"file://{tmp_path}/kg", Profile("demo", ["reviews", "crm"]))
    result = kg.build(delete_first=True, export_html=True)
    assert result.statistics.documents == 4 and kg.recent_outcomes()[0]["documents"] == 4 and kg.files.exists(result.html)
    assert kg.store().cypher("MATCH (e:Extract)-[:LED_BY]->(p:Person) RETURN p.name").first()[0] == "Lea"
    for q in get_subgraph("reviews").sample_queries():
        assert kg.store().cypher(q).count() == 2
    times = query_times(lambda: kg.store().cypher("MATCH (n) RETURN count(n) AS n"), 2)
    assert times["least"] <= times["mean"] <= times["most"] and kg.info()["nodes"] == 10


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = GraphStore(spark, f"file://{tmp_path}/g")

    def put(name, entries, first):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"_key": f"d{i}", **e}) for i, e in enumerate(entries, first)))
        ingest_stream(read_document_stream(spark, f"file://{tmp_path}/in", Review), store, review_schema(), f"file://{tmp_path}/c").awaitTermination()

    put("a.json", DOCS[:1], 0)
    put("b.json", DOCS[1:], 1)
    deals = {r["name"]: r["alternate_names"] for r in store.nodes["Deal"].df.collect()}
    assert deals == {"first": ["second"], "third": []} and store.nodes["Person"].df.count() == 2


@dataclass
class Holder:
    items: list[Money] = field(default_factory=list)
