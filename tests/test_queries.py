"""Registered queries against their SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom import document_queries, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
GRAPH = {**queries.QUERIES, **document_queries.QUERIES}
SQL = {**queries.ORACLE_SQL, **document_queries.ORACLE_SQL}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(df):
    columns = sorted(df.columns)
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v)
    return columns, sorted((tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", list(SQL))
def test_equals_sql(spark, tables, name):
    assert rows_of(GRAPH[name](spark, SF).toPandas()) == rows_of(tables.execute(SQL[name]).df())


def test_chunks_cover_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    met = {}
    for r in GRAPH["chunk_documents"](spark, SF).collect():
        a, b = map(int, r.location.split(":"))
        assert texts[r.doc_id][a:b] == r.text and len(r.text) <= 2000
        met.setdefault(r.doc_id, []).append((a, b))
    for d, ranges in met.items():
        ranges.sort()
        assert ranges[0][0] == 0 and ranges[-1][1] == len(texts[d]) and all(b1 >= a2 for (_, b1), (a2, _) in zip(ranges, ranges[1:]))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_are_pruned_and_filters_pushed(spark):
    plan = GRAPH["inline_props"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,AUTOMOBILE)" in plan and "o_totalprice" not in plan.split("ReadSchema")[-1]


def test_unused_ends_are_not_joined(spark):
    """A count of edges reads no node table."""
    plan = GRAPH["edge_type_histogram"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
