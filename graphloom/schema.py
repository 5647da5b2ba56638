"""Graph schemas, declared in part and deduced from model classes: where nodes lie in a document, how edges run between
them, which fields become columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product
from typing import Any

from pyspark.sql import Column
from pyspark.sql import types as T

from .types import element, embedded_field, is_model, model_fields, spark_type, struct_type, unwrap

#: Columns that every node table has.
BOOKKEEPING = ("id", "name", "_original_name", "_created_at", "_updated_at", "_dedup_key", "alternate_names")
RESERVED = {"id", "name", "created_at", "updated_at", "dedup_key", "alternate_names"}

Naming = str | Callable[[Column, str], Column]


def is_edge_property(name: str) -> bool:
    """p_..._ fields of a target lie on the edge that leads to it."""
    return name.startswith("p_") and name.endswith("_") and len(name) > 3


@dataclass(frozen=True)
class ExtraStruct:
    """A struct column that is computed: value takes the item's and the root's struct and a source key (or null)."""

    name: str
    type: T.StructType
    value: Callable[[Column, Column, Column], Column]


@dataclass(frozen=True)
class NodeSpec:
    """A node label: its class, where its name and key come from (a field or a function of the item and label),
    computed structs, classes kept as structs of its own columns, fields to index."""

    node_class: type
    name_from: Naming
    deduplication_key: Naming | None = None
    extra: tuple[ExtraStruct, ...] = ()
    embedded: tuple[type, ...] = ()
    index_fields: tuple[str, ...] = ()
    description: str = ""

    @property
    def label(self) -> str:
        return self.node_class.__name__


@dataclass(frozen=True)
class EdgeSpec:
    """An edge type between two classes; paths are deduced unless given as (from path, to path) pairs."""

    from_class: type
    to_class: type
    name: str
    description: str = ""
    field_paths: tuple[tuple[str, str], ...] = ()

    @property
    def key(self) -> tuple[str, str, str]:
        return self.from_class.__name__, self.to_class.__name__, self.name


@dataclass(frozen=True)
class Place:
    """A field path from the root and the path segments, up to and including its own, that are lists."""

    path: str
    kind: type
    lists: tuple[str, ...] = ()

    @property
    def is_list(self) -> bool:
        return self.path in self.lists


@dataclass
class GraphSchema:
    """What is deduced from a root class, node and edge specs.

    deep_lists also finds nodes below lists, paired with their own parents; without it a path through a list leads
    nowhere, as if it were null."""

    root: type
    nodes: list[NodeSpec]
    edges: list[EdgeSpec]
    deep_lists: bool = True
    places: list[Place] = field(default_factory=list)
    node_paths: dict[str, list[str]] = field(default_factory=dict)
    edge_paths: dict[tuple[str, str, str], list[tuple[str, str]]] = field(default_factory=dict)
    excluded: dict[str, set[str]] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.places = self._places()
        self.node_paths = {n.label: [""] if n.node_class is self.root else [p.path for p in self.places if p.kind is n.node_class] for n in self.nodes}
        for e in self.edges:
            self.edge_paths[e.key] = list(e.field_paths) or self._best_pair(e)
        for n in self.nodes:
            self.excluded[n.label] = self._excluded(n)
        self._check()

    # pass 1: where model classes lie

    def _places(self) -> list[Place]:
        out: list[Place] = []

        def visit(kind: type, prefix: str, lists: tuple[str, ...], above: tuple[type, ...]) -> None:
            for name, annotation in model_fields(kind).items():
                inner, many = element(annotation)
                if is_model(inner):
                    path = f"{prefix}.{name}" if prefix else name
                    own = (*lists, path) if many else lists
                    if lists and not self.deep_lists:
                        continue
                    out.append(Place(path, inner, own))
                    if inner not in above:  # a class within itself ends here
                        visit(inner, path, own, (*above, inner))

        visit(self.root, "", (), (self.root,))
        return out

    def place(self, path: str) -> Place | None:
        return next((p for p in self.places if p.path == path), None)

    # pass 3: which pair of paths an edge uses

    def _best_pair(self, e: EdgeSpec) -> list[tuple[str, str]]:
        pairs = [(a, b) for a, b in product(self._paths(e.from_class), self._paths(e.to_class)) if a != b and self._related(a, b)]
        pairs.sort(key=self._complexity)
        if len(pairs) > 1:
            others = ", ".join(f"{a or 'root'} -> {b}" for a, b in pairs[1:])
            self.warnings.append(f"{e.name}: several ways from {e.from_class.__name__} to {e.to_class.__name__}; taking {pairs[0][0] or 'root'} -> {pairs[0][1]}, not {others}")
        return pairs[:1]

    def _paths(self, kind: type) -> list[str]:
        return [""] if kind is self.root else [p.path for p in self.places if p.kind is kind]

    def _related(self, a: str, b: str) -> bool:
        """From the root, one below the other, below a common field, or both directly below the root."""
        if a == "" or b.startswith(a + ".") or (b and a.startswith(b + ".")):
            return True
        first_a, first_b = a.split(".")[0], b.split(".")[0]
        return (first_a == first_b and "." in a and "." in b) or ("." not in a and "." not in b)

    def _complexity(self, pair: tuple[str, str]) -> tuple[int, int, int, int]:
        """Fewest steps, then unnested pairs, then the least nesting, then the shortest text."""
        a, b = pair
        nested = bool(a) and (b.startswith(a + ".") or a.startswith(b + "."))
        return a.count(".") + b.count("."), int(nested), abs(a.count(".") - b.count(".")) if nested else 0, len(a) + len(b)

    # pass 4: which fields are no columns

    def _excluded(self, n: NodeSpec) -> set[str]:
        fields = model_fields(n.node_class)
        known = {x.node_class for x in self.nodes} - set(n.embedded)
        out = {f for f in fields if is_edge_property(f)}
        out |= {f for f, annotation in fields.items() if element(annotation)[0] in known}
        for e in self.edges:
            if e.from_class is n.node_class:
                for a, b in self.edge_paths[e.key]:
                    below = b[len(a) + 1 :] if a and b.startswith(a + ".") else b if not a else ""
                    if below:
                        out.add(below.split(".")[0])
        return out

    # pass 5: what looks wrong

    def _check(self) -> None:
        labels = {n.node_class for n in self.nodes}
        seen: dict[tuple[str, str], list[str]] = {}
        for e in self.edges:
            for kind in (e.from_class, e.to_class):
                if kind not in labels:
                    self.warnings.append(f"{e.name}: {kind.__name__} has no node configuration")
            seen.setdefault(e.key[:2], []).append(e.name)
            if not self.edge_paths[e.key]:
                self.warnings.append(f"{e.name}: no path from {e.from_class.__name__} to {e.to_class.__name__}")
        for (a, b), names in seen.items():
            if len(names) > 1:
                self.warnings.append(f"several edge types from {a} to {b}: {', '.join(names)}")
        ends = {e.from_class for e in self.edges} | {e.to_class for e in self.edges}
        for n in self.nodes:
            if not self.node_paths[n.label]:
                self.warnings.append(f"{n.label} lies nowhere below {self.root.__name__}; it is left out")
            if n.node_class not in ends:
                self.warnings.append(f"{n.label} has no edge")
            for kind in n.embedded:
                if embedded_field(n.node_class, kind) is None:
                    self.warnings.append(f"{n.label} has no field for the embedded {kind.__name__}")

    # columns

    def spec(self, label: str) -> NodeSpec:
        return next(n for n in self.nodes if n.label == label)

    def node_columns(self, label: str, strings_only: bool = False) -> T.StructType:
        """A node table's columns in order: computed structs, bookkeeping, and the model's own fields."""
        n = self.spec(label)
        out = [T.StructField(x.name, x.type) for x in n.extra]
        out += [T.StructField(c, T.ArrayType(T.StringType()) if c == "alternate_names" else T.StringType()) for c in BOOKKEEPING]
        taken = {f.name for f in out}
        for name, annotation in model_fields(n.node_class).items():
            if name in RESERVED or name in taken or name in self.excluded[label]:
                continue
            inner, many = element(annotation)
            if inner in n.embedded and not many:
                kind: T.DataType = struct_type(inner, strings_only)
            elif name == "metadata" and (unwrap(annotation)[0] is dict or getattr(unwrap(annotation)[0], "__origin__", None) is dict):
                kind = T.StructType([T.StructField("source", T.StringType())])
            elif is_model(inner) and not many:
                kind = struct_type(inner, strings_only)
            else:
                kind = spark_type(annotation, set(n.embedded), strings_only)
            out.append(T.StructField(name, kind))
        return T.StructType(out)

    def edge_properties(self, e: EdgeSpec) -> dict[str, Any]:
        """Names on the edge and the target's fields they come from."""
        return {f[2:-1]: f for f in model_fields(e.to_class) if is_edge_property(f)}

    def edge_columns(self, e: EdgeSpec) -> T.StructType:
        fields = model_fields(e.to_class)
        return T.StructType([T.StructField("_src", T.StringType()), T.StructField("_dst", T.StringType()), *[T.StructField(n, spark_type(fields[f])) for n, f in self.edge_properties(e).items()]])


def combined(schemas: list[GraphSchema]) -> tuple[list[NodeSpec], list[EdgeSpec]]:
    """Node specs by label, the first wins, and edge specs by (from, to, name)."""
    nodes: dict[str, NodeSpec] = {}
    edges: dict[tuple[str, str, str], EdgeSpec] = {}
    for s in schemas:
        for n in s.nodes:
            nodes.setdefault(n.label, n)
        for e in s.edges:
            edges.setdefault(e.key, e)
    return list(nodes.values()), list(edges.values())
