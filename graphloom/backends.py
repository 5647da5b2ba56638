"""Graph backends by name: what can run queries, what can be filled, how one is made from a configuration."""

from __future__ import annotations

import json
import os
from abc import ABC, abstractmethod
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .store import GraphStore


class QueryExecutor(ABC):
    """Whatever runs queries."""

    @abstractmethod
    def execute(self, query: str, parameters: dict[str, Any] | None = None) -> DataFrame: ...


class GraphBackend(QueryExecutor):
    """A graph that can be opened, made, filled and closed."""

    @abstractmethod
    def connect(self, connection: str) -> None: ...

    @abstractmethod
    def create_node_table(self, name: str, fields: dict[str, str | T.DataType], primary_key: str) -> None: ...

    @abstractmethod
    def create_relationship_table(self, name: str, source: str, target: str, properties: dict[str, str | T.DataType] | None = None) -> None: ...

    @abstractmethod
    def drop_table(self, name: str) -> bool: ...

    @abstractmethod
    def insert_node(self, label: str, data: dict[str, Any]) -> None: ...

    @abstractmethod
    def insert_relationship(self, name: str, source: str, source_key: Any, target: str, target_key: Any, properties: dict[str, Any] | None = None) -> None: ...

    @abstractmethod
    def close(self) -> None: ...

    @property
    @abstractmethod
    def query_language(self) -> str: ...


def kind_of(kind: str | T.DataType) -> T.DataType:
    return kind if isinstance(kind, T.DataType) else T.DataType.fromDDL(kind)


class ParquetBackend(GraphBackend):
    """A GraphStore: the path is its folder; without one it lies in the shared folder. Single inserts are for trials;
    rows by the many go through the store's own methods."""

    def __init__(self, spark: SparkSession):
        self.spark, self._store = spark, None

    @property
    def store(self) -> GraphStore:
        if self._store is None:
            raise RuntimeError("not connected")
        return self._store

    def connect(self, connection: str = "") -> None:
        self._store = GraphStore(self.spark, connection or None)

    def execute(self, query: str, parameters: dict[str, Any] | None = None) -> DataFrame:
        return self.store.cypher(query, parameters, read_only=False)

    def create_node_table(self, name: str, fields: dict[str, str | T.DataType], primary_key: str) -> None:
        self.store.create_node_table(name, {k: kind_of(v) for k, v in fields.items()}, primary_key)

    def create_relationship_table(self, name: str, source: str, target: str, properties: dict[str, str | T.DataType] | None = None) -> None:
        self.store.create_relationship_table(name, source, target, {k: kind_of(v) for k, v in (properties or {}).items()})

    def drop_table(self, name: str) -> bool:
        return self.store.drop_table(name)

    def insert_node(self, label: str, data: dict[str, Any]) -> None:
        schema = T.StructType.fromJson(self.store.catalog["nodes"][label]["schema"])
        known = T.StructType([f for f in schema.fields if f.name in data])
        self.store.append_nodes(label, self.spark.createDataFrame([tuple(data[f.name] for f in known.fields)], known))

    def insert_relationship(self, name: str, source: str, source_key: Any, target: str, target_key: Any, properties: dict[str, Any] | None = None) -> None:
        extra = properties or {}
        self.store.insert_relationship(name, source, target, [(source_key, target_key, *extra.values())], tuple(extra))

    def close(self) -> None:
        if self._store is not None:
            self._store.close()
            self._store = None

    @property
    def query_language(self) -> str:
        return GraphStore.query_language


_kinds: dict[str, type[GraphBackend]] = {"parquet": ParquetBackend}


def register_backend(name: str, kind: type[GraphBackend]) -> None:
    _kinds[name.lower()] = kind


def create_backend(spark: SparkSession, kind: str = "parquet") -> GraphBackend:
    if kind.lower() not in _kinds:
        raise ValueError(f"unknown kind of backend: {kind}; there are {', '.join(_kinds)}")
    return _kinds[kind.lower()](spark)


def create_in_memory_backend(spark: SparkSession) -> GraphBackend:
    """A connected backend in a new folder of its own, for tests and trials."""
    backend = create_backend(spark)
    backend.connect("")
    return backend


def backend_from_config(spark: SparkSession, config: dict | str, key: str = "default", path: str | None = None) -> GraphBackend:
    """A connected backend from a configuration, or a JSON file of one: {"graph_db": {key: {"type": ..., "path": ...}}}.
    path, such as a profile's, goes before the configured one."""
    if isinstance(config, str):
        with open(os.fspath(config)) as f:
            config = json.load(f)
    entries = config.get("graph_db", {})
    if key not in entries:
        raise ValueError(f"no configuration {key} of a graph; there are {', '.join(entries) or 'none'}")
    entry = entries[key]
    for name in ("type", *([] if path else ["path"])):
        if not entry.get(name):
            raise ValueError(f"the configuration {key} of a graph lacks {name}")
    backend = create_backend(spark, entry["type"])
    backend.connect(path or entry["path"])
    return backend
