"""The property graph as tables: one DataFrame per node label, one per (edge type, source label, target label)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import ddl_name

ID, LABEL, SRC, DST, EID = "_id", "_label", "_src", "_dst", "_eid"
HIDDEN = {ID, LABEL, SRC, DST, EID}


@dataclass(frozen=True)
class NodeTable:
    """Nodes of a label. df has _id, a key unique within the label, of any type, besides the properties."""

    label: str
    df: DataFrame
    primary_key: str = "id"

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c not in HIDDEN]


@dataclass(frozen=True)
class EdgeTable:
    """Edges of a type between two labels. df has _src and _dst, keys of the end labels, besides the properties; _eid
    tells edges apart and is made from the ends if missing. Each edge's ends exist unless dangling is set."""

    name: str
    source: str
    target: str
    df: DataFrame
    dangling: bool = False

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c not in HIDDEN]

    @property
    def with_id(self) -> DataFrame:
        if EID in self.df.columns:
            return self.df
        return self.df.withColumn(EID, F.concat_ws("\u0001", F.col(SRC).cast("string"), F.col(DST).cast("string")))


def global_id(label: Column | str, key: Column) -> Column:
    """An id that is unique across labels: "label:key"."""
    return F.concat(F.lit(label) if isinstance(label, str) else label, F.lit(":"), key.cast("string"))


@dataclass
class Graph:
    """A catalog of node and edge tables."""

    spark: SparkSession
    nodes: dict[str, NodeTable] = field(default_factory=dict)
    edges: list[EdgeTable] = field(default_factory=list)

    def add_nodes(self, label: str, df: DataFrame, key: str, primary_key: str | None = None) -> Graph:
        self.nodes[label] = NodeTable(label, df.withColumn(ID, F.col(key)), primary_key or key)
        return self

    def add_edges(self, name: str, source: str, target: str, df: DataFrame, dangling: bool = False) -> Graph:
        for end in (source, target):
            if end not in self.nodes:
                raise KeyError(f"edge type {name} ends in {end}, which is no node label")
        self.edges.append(EdgeTable(name, source, target, df, dangling))
        return self

    def edge_types(self) -> list[str]:
        return list(dict.fromkeys(e.name for e in self.edges))

    # catalog

    def show_tables(self) -> DataFrame:
        rows = [(n, "NODE") for n in self.nodes] + [(n, "REL") for n in self.edge_types()]
        return self.spark.createDataFrame(rows, "name string, type string")

    def table_info(self, name: str) -> DataFrame:
        """property id, name, type and whether it is the primary key; names and types of all end pairs of an edge type."""
        schema = "`property id` int, name string, type string, `primary key` boolean"
        if name in self.nodes:
            table = self.nodes[name]
            rows = [(i, f.name, ddl_name(f.dataType), f.name == table.primary_key) for i, f in enumerate(f for f in table.df.schema.fields if f.name not in HIDDEN)]
            return self.spark.createDataFrame(rows, schema)
        found: dict[str, T.DataType] = {}
        for e in self.edges:
            if e.name == name:
                found |= {f.name: f.dataType for f in e.df.schema.fields if f.name not in HIDDEN and f.name not in found}
        if not any(e.name == name for e in self.edges):
            raise KeyError(f"no table named {name}")
        return self.spark.createDataFrame([(i, n, ddl_name(t), False) for i, (n, t) in enumerate(found.items())], schema)

    # scans across tables

    def all_nodes(self, labels: list[str] | None = None) -> DataFrame:
        """_id ("label:key"), _label and name of every node: one narrow union."""
        out: DataFrame | None = None
        for label in labels if labels is not None else self.nodes:
            table = self.nodes[label]
            name = F.col("name").cast("string") if "name" in table.properties else F.lit(None).cast("string")
            one = table.df.select(global_id(label, F.col(ID)).alias(ID), F.lit(label).alias(LABEL), name.alias("name"))
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], f"{ID} string, {LABEL} string, name string")

    def all_edges(self, types: list[str] | None = None) -> DataFrame:
        """_src and _dst ("label:key") and _label of every edge."""
        out: DataFrame | None = None
        for e in self.edges:
            if types is None or e.name in types:
                one = e.df.select(global_id(e.source, F.col(SRC)).alias(SRC), global_id(e.target, F.col(DST)).alias(DST), F.lit(e.name).alias(LABEL))
                out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], f"{SRC} string, {DST} string, {LABEL} string")

    def counts(self, nodes: list[str] | None = None, edges: list[str] | None = None) -> DataFrame:
        """name, type, rows of every table, by one job: a union of counts."""
        out: DataFrame | None = None
        parts = [(n, "NODE", t.df) for n, t in self.nodes.items() if nodes is None or n in nodes]
        parts += [(e.name, "REL", e.df) for e in self.edges if edges is None or e.name in edges]
        for name, kind, df in parts:
            one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), F.lit(kind).alias("type"), "rows")
            out = one if out is None else out.unionByName(one)
        if out is None:
            return self.spark.createDataFrame([], "name string, type string, rows long")
        return out.groupBy("name", "type").agg(F.sum("rows").alias("rows"))

    def cypher(self, text: str, params: dict | None = None, read_only: bool = True, max_hops: int = 4, walk: bool = False) -> DataFrame:
        """Rows of a query. params binds $names; max_hops bounds a "*" without an upper end; walk lets a pattern use
        an edge twice."""
        from .plans.lower import run

        return run(self, text, params or {}, read_only=read_only, max_hops=max_hops, walk=walk)

    execute = cypher
