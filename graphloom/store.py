"""A graph kept as Parquet, with its catalog as one JSON file.

A table's rows lie in folders of their own version; a change writes new folders and then the catalog, by a rename, so
that readers never see half a change and no path is read and overwritten at once. The documents of one call are one
change. What a change replaced is deleted by the next one, so that a frame made before still reads. Merged nodes are
dealt into buckets by key, more as a table grows, and an upsert rewrites the buckets that its keys lie in. Edges are
appended as further folders. The catalog counts its versions, and a writer that did not see the last one is refused.
Everything goes through the Hadoop file system, so a store can lie wherever Spark can write.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import DST, EID, ID, SRC, EdgeTable, Graph, NodeTable
from .operators.extract import AT, extract_edges, extract_nodes
from .operators.upsert import merge_nodes, merge_statistics, resolved_edges
from .schema import BOOKKEEPING, GraphSchema
from .session import shared_dir


def now_text() -> str:
    return datetime.now(UTC).isoformat().replace("+00:00", "Z")


class Files:
    """Small files and folders in whatever store a path names."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Replaces a file by way of a new one beside it, which a rename puts in its place at once."""
        fs, p = self._at(path)
        aside = self.jvm.org.apache.hadoop.fs.Path(path + "." + uuid.uuid4().hex)
        stream = fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        over = self.gateway.new_array(hadoop.Options.Rename, 1)
        over[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(fs.getUri(), self.conf).rename(aside, p, over)

    def names(self, path: str) -> list[str]:
        """Names of what lies in a folder, ascending."""
        fs, p = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


class ConcurrentChange(RuntimeError):
    """Another writer has changed the store."""


def bucket_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


@dataclass
class IngestStatistics:
    documents: int = 0
    failed: int = 0
    created: int = 0
    matched: int = 0
    edges: int = 0
    unresolved_edges: int = 0

    def __add__(self, other: IngestStatistics) -> IngestStatistics:
        return IngestStatistics(*[a + b for a, b in zip(vars(self).values(), vars(other).values())])


class GraphStore(Graph):
    """A Graph whose tables can be made, filled and dropped."""

    query_language = "cypher"
    #: Rows of a bucket of merged nodes, about.
    BUCKET_ROWS = 1_000_000

    def __init__(self, spark: SparkSession, path: str | None = None):
        super().__init__(spark)
        self._depth, self._replaced, self._written = 0, [], []
        self.path = (path or f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}").rstrip("/")
        self.files = Files(spark)
        self.catalog: dict = {"nodes": {}, "edges": []}
        if self.files.exists(self.catalog_path):
            self.catalog = json.loads(self.files.read(self.catalog_path))
        self.refresh()

    @property
    def catalog_path(self) -> str:
        return f"{self.path}/catalog.json"

    def save(self) -> None:
        """Commits the catalog, unless a batch is open, which commits at its end."""
        if self._depth:
            return
        now = json.loads(self.files.read(self.catalog_path)) if self.files.exists(self.catalog_path) else {}
        if now.get("version", 0) != self.catalog.get("version", 0):
            raise ConcurrentChange(f"{self.path} was changed by another writer since it was read")
        before, self.catalog["replaced"] = self.catalog.get("replaced", []), self._replaced
        self.catalog["version"] = self.catalog.get("version", 0) + 1
        self.files.write(self.catalog_path, json.dumps(self.catalog, indent=1))
        self._replaced, self._written = [], []
        for p in before:
            self.files.delete(f"{self.path}/{p}")
        self.refresh()

    @contextlib.contextmanager
    def batch(self) -> Iterator[None]:
        """Changes made within are one change: all are kept, or after an error none."""
        before, kept = json.dumps(self.catalog), (list(self._replaced), list(self._written))
        self._depth += 1
        try:
            yield
        except BaseException:
            self.catalog = json.loads(before)
            for p in self._written[len(kept[1]) :]:
                self.files.delete(f"{self.path}/{p}")
            self._replaced, self._written = kept
            raise
        finally:
            self._depth -= 1
        self.save()

    def _replace(self, table: dict, parts: list[str]) -> None:
        self._replaced += [p for p in table["parts"] if p not in parts]
        table["parts"] = parts

    def refresh(self) -> None:
        self.nodes, self.edges = {}, []
        for label, t in self.catalog["nodes"].items():
            df = self._read(t)
            self.nodes[label] = NodeTable(label, df.withColumn(ID, F.col(t["key"])), t["key"])
        for t in self.catalog["edges"]:
            self.edges.append(EdgeTable(t["name"], t["from"], t["to"], self._read(t)))

    def _read(self, table: dict) -> DataFrame:
        schema = T.StructType.fromJson(table["schema"])
        if not table["parts"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in table["parts"]])

    def _write(self, df: DataFrame, name: str) -> str:
        part = f"{name}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{part}")
        self._written.append(part)
        return part

    def _write_buckets(self, df: DataFrame, name: str, key: str, n: int, touched: int) -> list[str]:
        """Writes rows by bucket of their key; the folders, one a bucket."""
        if n == 1:
            return [self._write(df, name)]
        part = f"{name}/{uuid.uuid4().hex}"
        dealt = df.withColumn("_bucket", bucket_of(F.col(key), n)).repartition(touched, "_bucket")
        dealt.write.option("compression", "zstd").partitionBy("_bucket").parquet(f"{self.path}/{part}")
        self._written.append(part)
        return [f"{part}/{x}" for x in self.files.names(f"{self.path}/{part}") if x.startswith("_bucket=")]

    # tables

    def create_schema(self, schema: GraphSchema) -> None:
        """Tables for all labels and edge types of a schema; those that exist are widened by new columns."""
        for n in schema.nodes:
            if schema.node_paths[n.label]:
                self._declare_nodes(n.label, schema.node_columns(n.label), "id")
        for e in schema.edges:
            if all(x.__name__ in self.catalog["nodes"] for x in (e.from_class, e.to_class)):
                self._declare_edges(e.name, e.from_class.__name__, e.to_class.__name__, schema.edge_columns(e))
        self.save()

    def create_node_table(self, name: str, fields: dict[str, T.DataType] | T.StructType, primary_key: str) -> None:
        columns = fields if isinstance(fields, T.StructType) else T.StructType([T.StructField(k, v) for k, v in fields.items()])
        if primary_key not in columns.names:
            raise ValueError(f"{name} has no column {primary_key}")
        if name not in self.catalog["nodes"]:
            self._declare_nodes(name, columns, primary_key)
            self.save()

    def create_relationship_table(self, name: str, source: str, target: str, props: dict[str, T.DataType] | None = None) -> None:
        key = lambda label: T.StructType.fromJson(self.catalog["nodes"][label]["schema"])[self.catalog["nodes"][label]["key"]].dataType
        columns = T.StructType([T.StructField(SRC, key(source)), T.StructField(DST, key(target)), *[T.StructField(k, v) for k, v in (props or {}).items()]])
        self._declare_edges(name, source, target, columns)
        self.save()

    def _declare_nodes(self, label: str, columns: T.StructType, key: str) -> None:
        table = self.catalog["nodes"].setdefault(label, {"schema": columns.jsonValue(), "key": key, "parts": []})
        self._widen(table, columns)

    def _declare_edges(self, name: str, source: str, target: str, columns: T.StructType) -> None:
        table = self._edge_entry(name, source, target)
        if table is None:
            with_id = T.StructType([*columns.fields, T.StructField(EID, T.StringType())])
            self.catalog["edges"].append({"name": name, "from": source, "to": target, "schema": with_id.jsonValue(), "parts": []})
        else:
            self._widen(table, columns)

    def _widen(self, table: dict, columns: T.StructType) -> None:
        have = T.StructType.fromJson(table["schema"])
        new = [f for f in columns.fields if f.name not in have.names]
        table["schema"] = T.StructType([*have.fields, *new]).jsonValue()

    def _edge_entry(self, name: str, source: str, target: str) -> dict | None:
        return next((t for t in self.catalog["edges"] if (t["name"], t["from"], t["to"]) == (name, source, target)), None)

    def drop_table(self, name: str) -> bool:
        """Drops a node table, with the edge tables that end in it, or an edge type. Whether there was one."""
        tables = [self.catalog["nodes"].pop(name)] if name in self.catalog["nodes"] else []
        gone = [t for t in self.catalog["edges"] if t["name"] == name or (tables and name in (t["from"], t["to"]))]
        self.catalog["edges"] = [t for t in self.catalog["edges"] if t not in gone]
        for t in tables + gone:
            self._replace(t, [])
        if tables or gone:
            self.save()
        return bool(tables or gone)

    def delete(self) -> bool:
        """Deletes everything stored."""
        self.catalog, self._replaced = {"nodes": {}, "edges": []}, []
        found = self.files.delete(self.path)
        self.refresh()
        return found

    def close(self) -> None:
        self.spark.catalog.clearCache()

    def compact(self, name: str) -> None:
        """Rewrites an edge type's parts as one."""
        for t in self.catalog["edges"]:
            if t["name"] == name and len(t["parts"]) > 1:
                self._replace(t, [self._write(self._read(t), f"edges/{name}")])
        self.save()

    # rows

    def _shaped(self, rows: DataFrame, schema: T.StructType) -> DataFrame:
        return rows.select(*[(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])

    def append_nodes(self, label: str, rows: DataFrame) -> DataFrame:
        """Adds nodes as they are, without merging; what is stored. Nodes without a key get one."""
        table = self.catalog["nodes"][label]
        self._widen(table, rows.schema)
        shaped = self._shaped(rows, T.StructType.fromJson(table["schema"]))
        if table["key"] not in rows.columns:
            shaped = shaped.withColumn(table["key"], F.expr("uuid()").cast(shaped.schema[table["key"]].dataType))
        part = self._write(shaped, f"nodes/{label}")
        table["parts"].append(part)
        table["rows"] = None
        self.save()
        stored = self.spark.read.parquet(f"{self.path}/{part}")
        return stored.withColumn(ID, F.col(table["key"]))

    insert_node = append_nodes

    def append_edges(self, name: str, source: str, target: str, rows: DataFrame, dedup: bool = False) -> int:
        """Adds edges, a bag; with dedup those that are stored already, or repeated, are left out. How many were added."""
        if self._edge_entry(name, source, target) is None:
            self._declare_edges(name, source, target, rows.schema)
        table = self._edge_entry(name, source, target)
        self._widen(table, rows.schema)
        schema = T.StructType.fromJson(table["schema"])
        shaped = self._shaped(rows.drop(EID) if EID in rows.columns else rows, schema)
        if dedup:
            same = [f.name for f in schema.fields if f.name != EID]
            shaped = shaped.dropDuplicates(same)
            if table["parts"]:
                old = self._read(table).select(*[F.col(c).alias("_old_" + c) for c in same])
                on = None
                for c in same:
                    test = shaped[c].eqNullSafe(old["_old_" + c])
                    on = test if on is None else on & test
                shaped = shaped.join(old, on, "left_anti")
        batch = uuid.uuid4().hex[:12]
        # written once and read from then on, so that the number a row gets here stays its own
        shaped = shaped.withColumn(EID, F.concat(F.lit(batch + "-"), F.monotonically_increasing_id().cast("string")))
        part = self._write(shaped, f"edges/{name}")
        table["parts"].append(part)
        self.save()
        return self.spark.read.parquet(f"{self.path}/{part}").count()

    def insert_relationship(self, name: str, source: str, target: str, tuples: Iterable[tuple], props: tuple[str, ...] = ()) -> int:
        """Edges from tuples: (from id, to id, values of props...), or records (from type, from id, to type, to id, name[, properties])."""
        rows = []
        for t in tuples:
            if len(t) in (5, 6) and t[0] == source and t[2] == target:
                extra = t[5] if len(t) == 6 and t[5] else {}
                rows.append((t[1], t[3], *[extra.get(p) for p in props]))
            else:
                rows.append(tuple(t))
        schema = f"{SRC} string, {DST} string" + "".join(f", {p} string" for p in props)
        return self.append_edges(name, source, target, self.spark.createDataFrame([tuple(None if x is None else str(x) for x in r) for r in rows], schema))

    def upsert_nodes(self, label: str, new: DataFrame, key: str = "_dedup_key") -> tuple[int, int]:
        """Merges nodes (with _at for their order, or in any order without) into a label's table: (created, matched)."""
        if AT not in new.columns:
            new = new.withColumn(AT, F.struct(F.lit(0)))
        if "_dedup_key" not in new.columns:
            new = new.withColumn("_dedup_key", F.col("name"))
        defaults = {"_original_name": F.col("name"), "_created_at": F.lit(now_text()), "_updated_at": F.lit(now_text()), "alternate_names": F.array().cast("array<string>")}
        for c, v in defaults.items():
            if c not in new.columns:
                new = new.withColumn(c, v)
        if label not in self.catalog["nodes"]:
            kinds = [f for f in new.schema.fields if f.name not in (AT, "_key", "id") and f.name not in BOOKKEEPING]
            fixed = [T.StructField(c, T.ArrayType(T.StringType()) if c == "alternate_names" else T.StringType()) for c in BOOKKEEPING]
            self._declare_nodes(label, T.StructType([*fixed, *kinds]), "id")
        table = self.catalog["nodes"][label]
        self._widen(table, T.StructType([f for f in new.schema.fields if f.name not in (AT, "_key")]))
        schema = T.StructType.fromJson(table["schema"])
        full = new.select(AT, *[(F.col(f.name).cast(f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
        # written first: what documents give is computed once
        aside = f"staging/{uuid.uuid4().hex}"
        full.write.parquet(f"{self.path}/{aside}")
        try:
            return self._merge(label, table, schema, self.spark.read.schema(full.schema).parquet(f"{self.path}/{aside}"), key)
        finally:
            self.files.delete(f"{self.path}/{aside}")

    def _merge(self, label: str, table: dict, schema: T.StructType, full: DataFrame, key: str) -> tuple[int, int]:
        """Merges rows of a table's columns, and _at, into the buckets that their keys lie in."""
        buckets = table.get("buckets", 1)
        if buckets > 1 and table.get("bucket_key") == key and all("/_bucket=" in p for p in table["parts"]):
            touched = {r[0] for r in full.select(bucket_of(F.col(key), buckets)).distinct().collect()}  # one row a bucket
            old = [p for p in table["parts"] if int(p.rsplit("=", 1)[1]) in touched]
        else:
            touched, old = None, list(table["parts"])
        stored = self._read(table | {"parts": old}) if old else None
        counts = merge_statistics(stored, full, key).first()
        merged = self._shaped(merge_nodes(stored, full, label, key), schema)
        rows = counts["created"] + (table.get("rows") if table.get("rows") is not None else self._read(table).count())
        if touched is None or rows > 4 * buckets * self.BUCKET_ROWS:  # all is written anew, in as many buckets as fit
            if touched is not None and len(old) < len(table["parts"]):
                rest = self._read(table | {"parts": [p for p in table["parts"] if p not in old]})
                merged, old = merged.unionByName(self._shaped(rest, schema)), list(table["parts"])
            buckets = max(1, -(-rows // self.BUCKET_ROWS))
            touched = set(range(buckets))
        new = self._write_buckets(merged, f"nodes/{label}", key, buckets, len(touched))
        self._replace(table, [p for p in table["parts"] if p not in old] + new)
        table |= {"buckets": buckets, "bucket_key": key, "rows": rows}
        self.save()
        return counts["created"], counts["matched"]

    def merge_node(self, label: str, new: DataFrame, on: str = "name") -> tuple[int, int]:
        return self.upsert_nodes(label, new, on)

    def set_property(self, label: str, name: str, changes: DataFrame) -> None:
        """Sets a property of nodes from (_id, _value); of several values of one node the largest holds."""
        table = self.catalog["nodes"][label]
        value = changes.schema["_value"].dataType
        self._widen(table, T.StructType([T.StructField(name, value)]))
        schema = T.StructType.fromJson(table["schema"])
        one = changes.groupBy(ID).agg(F.max("_value").alias("_value"), F.lit(True).alias("_set"))
        rows = self._read(table)
        rows = rows.join(one, rows[table["key"]] == one[ID], "left")
        kept: Column = F.col(name) if name in rows.columns else F.lit(None).cast(value)
        rows = rows.withColumn(name, F.when(F.col("_set"), F.col("_value").cast(schema[name].dataType)).otherwise(kept)).select(*schema.names)
        self._replace(table, [self._write(rows, f"nodes/{label}")])
        self.save()

    # documents

    def add_documents(self, docs: DataFrame, schema: GraphSchema, now: str | None = None, dedup_edges: bool = False, source_key: Column | None = None) -> IngestStatistics:
        """Extracts nodes and edges from documents (with _key, _ord and the root's fields) and merges them in.

        Documents whose _corrupt_record is set are counted as failed and left out; edges that lack an end are counted
        and left out. All tables change at once, or none."""
        with self.batch():
            return self._add_documents(docs, schema, now, dedup_edges, source_key)

    def _add_documents(self, docs: DataFrame, schema: GraphSchema, now: str | None, dedup_edges: bool, source_key: Column | None) -> IngestStatistics:
        schema_warnings(schema)
        failed = 0
        if "_corrupt_record" in docs.columns:
            failed = docs.filter(F.col("_corrupt_record").isNotNull()).count()
            docs = docs.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
        self.create_schema(schema)
        now = now or now_text()
        out = IngestStatistics(documents=docs.count(), failed=failed)
        for n in schema.nodes:
            found = extract_nodes(docs, schema, n.label, now, source_key)
            if found is not None:
                created, matched = self.upsert_nodes(n.label, found.drop("_key"))
                out.created += created
                out.matched += matched
        for e in schema.edges:
            found = extract_edges(docs, schema, e)
            if found is not None:
                a, b = e.from_class.__name__, e.to_class.__name__
                whole, lacking = resolved_edges(found, self._read(self.catalog["nodes"][a]), self._read(self.catalog["nodes"][b]))
                out.edges += self.append_edges(e.name, a, b, whole, dedup_edges)
                out.unresolved_edges += lacking.count()
        return out

    def info(self) -> dict:
        """Sizes and counts of what is stored."""
        counts = {(r["name"], r["type"]): r["rows"] for r in self.counts().collect()}
        return {
            "path": self.path, "bytes": self.files.size(self.path), "tables": len(counts),
            "nodes": sum(n for (_, k), n in counts.items() if k == "NODE"), "edges": sum(n for (_, k), n in counts.items() if k == "REL"),
            "by_table": {name: n for (name, _), n in counts.items()},
        }


def schema_warnings(schema: GraphSchema) -> None:
    """A root must be able to say where a document came from: a metadata field or a computed struct of its own."""
    from .types import model_fields

    root = next((n for n in schema.nodes if n.node_class is schema.root), None)
    if "metadata" not in model_fields(schema.root) and not (root and root.extra):
        raise ValueError(f"{schema.root.__name__} needs a metadata field or a computed struct that names the source")


def in_memory_store(spark: SparkSession) -> GraphStore:
    """A store in a new folder of its own, for tests and trials."""
    return GraphStore(spark)


__all__ = ["Files", "GraphStore", "IngestStatistics", "in_memory_store"]
