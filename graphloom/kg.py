"""Knowledge graphs by profile: what they are made of, where they lie, how they are built, and a log of both."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from statistics import mean, pstdev

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.export import TooLarge, graph_html, write_graph
from .schema import GraphSchema
from .sources.tables import TableSource, parse_pull, pull
from .store import Files, GraphStore, IngestStatistics, now_text


class Subgraph:
    """A named part of a graph: a schema and a source of documents. Subclasses give both."""

    name: str

    def schema(self) -> GraphSchema:
        raise NotImplementedError

    def documents(self, spark: SparkSession, keys: list[str] | None = None) -> DataFrame | None:
        """Documents with _key and _ord, all or those of keys; None if this part is filled by pulls only."""
        raise NotImplementedError

    def node_labels(self) -> dict[str, str]:
        return {n.label: n.description for n in self.schema().nodes}

    def relationship_labels(self) -> dict[str, str]:
        return {e.name: e.description for e in self.schema().edges}

    def sample_queries(self) -> list[str]:
        return []


@dataclass
class DocumentSubgraph(Subgraph):
    """A part whose documents a function reads."""

    name: str
    graph_schema: GraphSchema
    read: Callable[[SparkSession], DataFrame]
    queries: list[str] = field(default_factory=list)

    def schema(self) -> GraphSchema:
        return self.graph_schema

    def documents(self, spark: SparkSession, keys: list[str] | None = None) -> DataFrame | None:
        rows = self.read(spark)
        return rows if keys is None else rows.filter(F.col("_key").isin(*keys))

    def sample_queries(self) -> list[str]:
        return self.queries


@dataclass
class TableSubgraph(DocumentSubgraph):
    """A part whose documents are rows of a staging table; ``pull_on`` ("Label.field") fetches the rows that nodes of
    other parts name, by the table's column ``pull_column``."""

    source: TableSource | None = None
    pull_on: str = ""
    pull_column: str = ""

    def documents(self, spark: SparkSession, keys: list[str] | None = None) -> DataFrame | None:
        return None if self.pull_on and keys is None else self.source.documents(keys)


_registry: dict[str, Subgraph] = {}


def register_subgraph(name: str, part: Subgraph | type[Subgraph] | Callable[[], Subgraph]) -> Subgraph:
    """Registers an instance, a class, or a function that makes one."""
    made = part if isinstance(part, Subgraph) else part()
    if not isinstance(made, Subgraph):
        raise TypeError(f"{name} is no subgraph")
    _registry[name] = made
    return made


def get_subgraph(name: str) -> Subgraph:
    if name not in _registry:
        raise KeyError(f"no subgraph {name}; there are {', '.join(_registry) or 'none'}")
    return _registry[name]


def list_subgraphs() -> list[str]:
    return sorted(_registry)


@dataclass
class Profile:
    """What a graph is made of: subgraph names, and for each the keys to load at first (default: all)."""

    name: str
    subgraphs: list[str]
    tag: str = "default"
    initial_load: dict[str, list[str]] = field(default_factory=dict)
    dedup_edges: bool = False


@dataclass
class RunResult:
    path: str
    statistics: IngestStatistics
    warnings: list[str]
    seconds: float
    html: str | None = None


class KnowledgeGraph:
    """A profile's graph below a root folder, with its logs."""

    def __init__(self, spark: SparkSession, root: str, profile: Profile):
        self.spark, self.profile = spark, profile
        self.folder = f"{root.rstrip('/')}/{profile.name}"
        self.path = f"{self.folder}/{profile.name}-{profile.tag}"
        self.files, self.warnings = Files(spark), []

    def store(self) -> GraphStore:
        return GraphStore(self.spark, self.path)

    def warn(self, text: str) -> None:
        if text not in self.warnings:
            self.warnings.append(text)

    # logs: a folder of one-line JSON files, whose names are in order of time, so that an entry costs its own size

    def _append(self, name: str, entry: dict) -> None:
        self.files.write(f"{self.folder}/{name}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json", json.dumps(entry) + "\n")

    def _recent(self, name: str, n: int) -> list[dict]:
        path = f"{self.folder}/{name}"
        return [json.loads(self.files.read(f"{path}/{x}")) for x in self.files.names(path)[::-1][:n]]

    def log_outcome(self, result: RunResult) -> None:
        self._append("outcomes", {"at": now_text(), "path": result.path, "seconds": round(result.seconds, 3), **asdict(result.statistics), "warnings": len(result.warnings)})
        for w in result.warnings:
            self._append("warnings", {"at": now_text(), "warning": w})

    def recent_outcomes(self, n: int = 10) -> list[dict]:
        """Newest first."""
        return self._recent("outcomes", n)

    def recent_warnings(self, n: int = 50) -> list[dict]:
        return self._recent("warnings", n)

    # building

    def build(self, delete_first: bool = False, export_html: bool = False) -> RunResult:
        """First all schemas, then all documents, then what their nodes pull from tables."""
        began = time.time()
        if delete_first:
            self.store().delete()
        store, parts = self.store(), [get_subgraph(n) for n in self.profile.subgraphs]
        for p in parts:
            for w in p.schema().warnings:
                self.warn(f"{p.name}: {w}")
            store.create_schema(p.schema())
        total = IngestStatistics()
        for p in parts:
            keys = self.profile.initial_load.get(p.name)
            docs = p.documents(self.spark, keys)
            if docs is None:
                continue
            try:
                total += store.add_documents(docs, p.schema(), dedup_edges=self.profile.dedup_edges)
            except AnalysisException as e:  # the schema does not fit, whatever the document
                self.warn(f"{p.name}: {e}")
                total.failed += 1
            except Exception:
                total += self._one_by_one(store, docs, p)
        for p in parts:
            if isinstance(p, TableSubgraph) and p.pull_on:
                total += self._pull(store, p)
        result = RunResult(self.path, total, list(self.warnings), time.time() - began)
        if total.unresolved_edges:
            result.warnings.append(f"{total.unresolved_edges} edges lack an end")
        if export_html:
            try:
                page = graph_html(store, self.profile.name)
                result.html = f"{self.path}.html"
                self.files.write(result.html, page)
            except TooLarge as e:
                write_graph(store, f"{self.path}.graph")
                result.warnings.append(f"no page was written but {self.path}.graph: {e}")
        self.log_outcome(result)
        return result

    def _one_by_one(self, store: GraphStore, docs: DataFrame, p: Subgraph, most: int = 100) -> IngestStatistics:
        """Ingests documents of which some fail: parts by hash of key are halved until a failing document is alone, which
        is left out with a warning. After ``most`` such documents whole parts are left out."""
        total, place = IngestStatistics(), F.xxhash64("_key")

        def attempt(depth: int, rest: int) -> None:
            nonlocal total
            part = docs.filter(F.pmod(place, F.lit(1 << depth)) == rest)
            try:
                total += store.add_documents(part, p.schema(), dedup_edges=self.profile.dedup_edges)
                return
            except Exception as e:
                keys = [r["_key"] for r in part.select("_key").distinct().limit(2).collect()]
                if len(keys) < 2 or depth >= 62 or total.failed >= most:
                    n = part.count()
                    total += IngestStatistics(documents=n, failed=n)
                    self.warn(f"{p.name}: {', '.join(map(str, keys))}{' and more' if n > len(keys) else ''}: {str(e).splitlines()[0]}")
                    return
            attempt(depth + 1, rest)
            attempt(depth + 1, rest + (1 << depth))

        attempt(1, 0)
        attempt(1, 1)
        return total

    def _pull(self, store: GraphStore, p: TableSubgraph) -> IngestStatistics:
        found = parse_pull(p.pull_on, list(store.nodes))
        if found is None:
            self.warn(f"{p.name}: no label for {p.pull_on}")
            return IngestStatistics()
        label, name = found
        rows, key = p.source.rows(), p.source.key
        met = pull(store.nodes[label].df, name, rows, p.pull_column or key, key)
        docs = p.source.mapped(met.withColumn("_key", F.concat(F.lit(f"pull:{p.name}:"), F.col(key).cast("string"))))
        from .sources.tables import with_order

        return store.add_documents(with_order(docs), p.schema(), dedup_edges=self.profile.dedup_edges)

    def info(self) -> dict:
        return self.store().info() | {"profile": self.profile.name, "tag": self.profile.tag, "subgraphs": self.profile.subgraphs, "outcomes": self.recent_outcomes(1)}

    def delete(self) -> bool:
        return self.store().delete()


def query_times(run: Callable[[], DataFrame], iterations: int = 3) -> dict[str, float]:
    """Seconds of some runs: mean, least, most, population deviation."""
    seconds = []
    for _ in range(iterations):
        began = time.time()
        run().write.format("noop").mode("overwrite").save()
        seconds.append(time.time() - began)
    return {"mean": mean(seconds), "least": min(seconds), "most": max(seconds), "deviation": pstdev(seconds)}


def load_profile(path: str, name: str) -> Profile:
    """A profile from a JSON file: {name: {"subgraphs": [...], ...}}."""
    with open(os.fspath(path)) as f:
        entries = json.load(f)
    if name not in entries:
        raise KeyError(f"no profile {name}; there are {', '.join(entries)}")
    return Profile(name, **entries[name])
