"""Order of documents, file names, workbooks, changes of a store, backends and the example subgraphs."""

import json
import random
import zipfile
from dataclasses import dataclass

import pytest

from graphloom import examples
from graphloom.ask import ask, limited, structured_prompt, structured_query
from graphloom.backends import ParquetBackend, backend_from_config, create_backend, create_in_memory_backend, register_backend
from graphloom.kg import DocumentSubgraph, KnowledgeGraph, Profile, register_subgraph
from graphloom.operators.extract import extract_nodes
from graphloom.operators.upsert import merge_nodes
from graphloom.schema import EdgeSpec, GraphSchema, NodeSpec
from graphloom.sources.tables import load_table, read_documents, text_files, with_order
from graphloom.store import ConcurrentChange, GraphStore
from graphloom.views import trade_graph


@dataclass
class Part:
    name: str
    part_id: str
    size: int | None = None


@dataclass
class Box:
    name: str
    part: Part
    metadata: dict | None = None


def box_schema():
    return GraphSchema(Box, [NodeSpec(Box, "name"), NodeSpec(Part, "name", deduplication_key="part_id")], [EdgeSpec(Box, Part, "HOLDS")])


KIND = "_key string, name string, part struct<name:string,part_id:string,size:string>, metadata map<string,string>"


def boxes(spark, keys, names=None, sizes=None):
    return [(k, f"box-{k}", ((names or {}).get(k, f"name{i:03d}"), "P", (sizes or {}).get(k, str(i))), None) for i, k in enumerate(keys)]


def test_whole_keys_order_documents(spark):
    """Forty keys that agree in twelve bytes, dealt five ways: the first by key names, the last overwrites."""
    keys = [f"opportunity-{i:03d}" for i in range(40)]
    for seed in range(5):
        rows = boxes(spark, keys)
        random.Random(seed).shuffle(rows)
        docs = with_order(spark.createDataFrame(rows, KIND).repartition(1 + 2 * seed))
        got = merge_nodes(None, extract_nodes(docs, box_schema(), "Part", "now"), "Part").first()
        assert (got["name"], got["size"]) == ("name000", 39) and got["alternate_names"] == [f"name{i:03d}" for i in range(1, 40)]


def test_file_names_are_read_as_written(spark, tmp_path):
    for name in ("my doc", "a+b", "50% off", "é"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"name": name, "part": {"name": "p", "part_id": "1"}}))
        (tmp_path / f"{name}.md").write_text(name)
    read = read_documents(spark, f"file://{tmp_path}", Box)
    assert {r["_key"]: r["name"] for r in read.collect()} == {n: n for n in ("my doc", "a+b", "50% off", "é")}
    assert read_documents(spark, f"file://{tmp_path}", Box, ["my doc", "a+b"]).count() == 2
    assert {r["filename"]: r["content"] for r in text_files(spark, f"file://{tmp_path}").collect()} == {f"{tmp_path}/{n}.md": n for n in ("my doc", "a+b", "50% off", "é")}


def workbook(path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cells = [
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>When</t></is></c><c r="E1" t="s"><v>1</v></c></row>',
        '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>7</v></c><c r="C2" s="1"><v>45292</v></c><c r="E2" t="b"><v>1</v></c></row>',
        '<row r="4"><c r="A4" t="str"><v>calc</v></c><c r="B4"><v>2.5</v></c></row>',
    ]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Deals" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Deal ID</t></si><si><r><t>Va</t></r><r><t>lue</t></r></si><si><t>D1</t></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(cells)}</sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "b.xlsx")
    df = load_table(spark, f"file://{tmp_path}/b.xlsx")
    assert df.columns == ["Deal ID", "Value", "When", "Unnamed: 3", "Value.1"]
    rows = df.collect()
    assert [(r[0], r[1], r[4]) for r in rows] == [("D1", 7.0, True), ("calc", 2.5, None)] and str(rows[0][2]) == "2024-01-01 00:00:00"
    assert load_table(spark, f"file://{tmp_path}/b.xlsx", sheet_name="Deals", skiprows=1, header=0).columns[0] == "D1"


def test_a_batch_changes_all_or_nothing(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g")
    store.add_documents(with_order(spark.createDataFrame(boxes(spark, ["a", "b"]), KIND)), box_schema())
    held, version = store.nodes["Box"].df, store.catalog["version"]
    with pytest.raises(RuntimeError, match="stop"):
        with store.batch():
            store.upsert_nodes("Part", spark.createDataFrame([("x", "x")], "name string, _dedup_key string"))
            raise RuntimeError("stop")
    again = GraphStore(spark, store.path)
    assert again.catalog["version"] == version and again.nodes["Part"].df.count() == 1 == store._read(store.catalog["nodes"]["Part"]).count()
    again.add_documents(with_order(spark.createDataFrame(boxes(spark, ["c"]), KIND)), box_schema())
    assert again.catalog["version"] == version + 1 and held.count() == 2  # a frame from before the change still reads
    with pytest.raises(ConcurrentChange):
        store.set_property("Part", "name", spark.createDataFrame([("i", "v")], "_id string, _value string"))


def test_upserts_rewrite_the_buckets_they_touch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(GraphStore, "BUCKET_ROWS", 20)
    store = GraphStore(spark, f"file://{tmp_path}/g")
    named = lambda names, v: spark.createDataFrame([(n, n, v) for n in names], "name string, _dedup_key string, v string")
    assert store.upsert_nodes("N", named([f"n{i}" for i in range(200)], "old")) == (200, 0)
    table = store.catalog["nodes"]["N"]
    before = set(table["parts"])
    assert table["buckets"] == 10 == len(before)
    assert store.upsert_nodes("N", named(["n7", "new"], "young")) == (1, 1)
    assert 8 <= len(before & set(table["parts"])) < 10 and store.nodes["N"].df.count() == 201
    assert sorted((r["name"], r["v"]) for r in store.nodes["N"].df.filter("v = 'young'").collect()) == [("n7", "young"), ("new", "young")]
    store.upsert_nodes("N", named([f"m{i}" for i in range(900)], "more"))  # so many that the buckets grow
    assert table["buckets"] == 56 and store.nodes["N"].df.count() == 1101 == store.nodes["N"].df.select("id").distinct().count()


def test_a_failing_document_is_left_out_alone(spark, tmp_path):
    rows = boxes(spark, [f"k{i}" for i in range(12)], sizes={"k5": "many"})
    register_subgraph("boxes", DocumentSubgraph("boxes", box_schema(), lambda s: with_order(s.createDataFrame(rows, KIND))))
    kg = KnowledgeGraph(spark, f"file://{tmp_path}", Profile("boxes", ["boxes"]))
    result = kg.build()
    assert result.statistics.failed == 1 and any("k5" in w for w in result.warnings)
    assert kg.store().cypher("MATCH (b:Box) RETURN count(b) AS n").first()["n"] == 11
    assert kg.recent_outcomes()[0]["failed"] == 1 and len(kg.recent_warnings()) == 1


def test_backends(spark, tmp_path):
    backend = create_in_memory_backend(spark)
    backend.create_node_table("City", {"id": "string", "people": "bigint"}, "id")
    backend.create_relationship_table("ROAD", "City", "City", {"km": "string"})
    for name, n in (("a", 5), ("b", None)):
        backend.insert_node("City", {"id": name, "people": n})
    backend.insert_relationship("ROAD", "City", "a", "City", "b", {"km": 3})
    assert backend.execute("MATCH (x:City)-[r:ROAD]->(y) RETURN x.people, r.km, y.id").first()[:] == (5, "3", "b") and backend.query_language == "cypher"
    assert backend.drop_table("ROAD")
    backend.close()
    with pytest.raises(RuntimeError):
        backend.execute("MATCH (n) RETURN n")
    with pytest.raises(ValueError, match="parquet"):
        create_backend(spark, "other")
    register_backend("Mine", ParquetBackend)
    (tmp_path / "c.json").write_text(json.dumps({"graph_db": {"default": {"type": "mine", "path": f"file://{tmp_path}/g"}, "bad": {"type": "mine"}}}))
    assert backend_from_config(spark, str(tmp_path / "c.json")).store.path == f"file://{tmp_path}/g"
    assert backend_from_config(spark, {"graph_db": {"bad": {"type": "mine"}}}, "bad", f"file://{tmp_path}/h").store.path.endswith("/h")
    for key in ("bad", "none"):
        with pytest.raises(ValueError):
            backend_from_config(spark, str(tmp_path / "c.json"), key)


def test_structured_questions(spark):
    g = trade_graph(spark, "/root/testdata/sf0.001")
    assert "<SCHEMA>\nLabels\n</SCHEMA>" in structured_prompt("Labels", "why?")
    assert structured_query('Sure: {"cypher": "MATCH (n)\nRETURN n;"}') == "MATCH (n) RETURN n"
    for bad in ("MATCH (n) RETURN n", '{"query": 1}', "{no}"):
        with pytest.raises(ValueError):
            structured_query(bad)
    answer = lambda prompt, question: '{"cypher": "MATCH (n:Nation) RETURN n.n_name AS x UNION MATCH (r:Region) RETURN r.r_name AS x"}'
    assert ask(g, "which?", answer, limit=4, structured=True).count() == 4 and "LIMIT" not in limited("MATCH (n) RETURN n UNION MATCH (m) RETURN m", 4)


REVIEW = {
    "opportunity": {"name": "Deal one", "opportunity_id": "O1", "status": "Active", "customer": {"name": "Acme", "segment": "Bank", "employees": [{"name": "Eve", "p_role_": "buyer"}]}},
    "start_date": "2024-05-01", "tech_stack": {"technical_stack": ["Java", "Spark"]}, "team": [{"name": "Ann", "p_role_": "lead"}], "financials": {"tcv": 5.5},
    "risks": [{"risk_category": None, "p_risk_description_": "late"}], "competition": {"differentiators": ["price"]}, "competitors": [{"name": "Other Ltd", "known_as": ""}], "partners": None,
}


def test_examples(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "one.json").write_text(json.dumps(REVIEW))
    (tmp_path / "crm.csv").write_text("Deal Opportunity ID,Opportunity Name,Account Name,Sub-Industry,Client Leader,Status,Reason\nO1,Deal 1,Acme,Bank,Lea,Won,price\nO2,Deal 2,Best,,Max,,\n")
    from graphloom.sources.tables import TableSource

    crm = TableSource(spark, f"file://{tmp_path}/t", "Deal Opportunity ID", "CrmExtract")
    crm.import_file(f"file://{tmp_path}/crm.csv")
    parts = examples.register_examples(f"file://{tmp_path}/r", crm=crm)
    kg = KnowledgeGraph(spark, f"file://{tmp_path}/kg", Profile("all", [p.name if p.name else "" for p in parts]))
    result = kg.build()
    assert result.statistics.failed == 0 and result.statistics.documents == 3, result.warnings
    store = kg.store()
    run = lambda q: sorted((tuple(r) for r in store.cypher(q).collect()), key=str)
    assert run("MATCH (x:ReviewedOpportunity)-[r:HAS_RISK]->(k:RiskAnalysis) RETURN x.name, k.name, r.risk_description") == [("Review:2024-05-01", "late", "late")]
    assert run("MATCH (x:ReviewedOpportunity)-[:HAS_TECH_STACK]->(t) RETURN t.name") == [("Java, Spark",)] and run("MATCH (c:Competitor) RETURN c.name") == [("Other Ltd",)]
    assert run("MATCH (x:ReviewedOpportunity) RETURN x.file_metadata.source, x.financials.tcv") == [("one", 5.5)]
    assert run("MATCH (c:Customer)-[r:HAS_CONTACT]->(p:Person) RETURN p.name, r.role") == [("Eve", "buyer")]
    assert run("MATCH (o:Opportunity) RETURN o.opportunity_id, o.name, o.win_loss.result") == [("O1", "Deal one", "Won"), ("O2", "Deal 2", None)]
    assert run("MATCH (o:Opportunity)-[:LEAD_BY]->(p:Person) RETURN o.name, p.name") == [("Deal 2", "Max"), ("Deal one", "Lea")]
    for p in parts:
        for q in p.sample_queries():
            store.cypher(q).collect()
    assert examples.architecture_schema().node_paths["Solution"] == ["used_solutions"]
