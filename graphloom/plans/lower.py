"""From syntax trees to DataFrames.

Patterns become joins of edge and node tables, WHERE becomes filters, semi and anti joins, WITH and RETURN become
projections and aggregates. Everything is handed to Catalyst as one logical plan; nothing runs here.

What a variable holds:

* a node: columns ``v$_id``, ``v$_label`` and ``v$p`` for its properties p. If the pattern allows one label only, ``_id``
  is that label's own key; otherwise it is "label:key".
* an edge: columns ``r$_eid``, ``r$_label``, ``r$_src``, ``r$_dst`` and its properties.
* any other value: one column, ``v``.

A node table is joined only where a query reads more of the node than its identity.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from itertools import count as counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import AGGREGATES, SCALARS, sql_type_rank
from ..graph import DST, EID, ID, LABEL, SRC, EdgeTable, Graph, global_id
from . import parser as P
from .parser import QueryError


@dataclass(frozen=True)
class Node:
    name: str
    labels: tuple
    props: tuple  # of the properties that columns exist for

    def col(self, part: str) -> Column:
        return F.col(f"`{self.name}${part}`")

    @property
    def columns(self) -> list[str]:
        return [f"{self.name}${p}" for p in (ID, LABEL, *self.props)]

    @property
    def gid(self) -> Column:
        """The id across labels."""
        return global_id(self.labels[0], self.col(ID)) if len(self.labels) == 1 else self.col(ID)

    def struct(self) -> Column:
        return F.when(self.col(ID).isNotNull(), F.struct(self.gid.alias(ID), self.col(LABEL).alias(LABEL), *[self.col(p).alias(p) for p in self.props]))


@dataclass(frozen=True)
class Edge:
    name: str
    types: tuple
    props: tuple
    tables: tuple  # positions in the graph's list of edge tables

    def col(self, part: str) -> Column:
        return F.col(f"`{self.name}${part}`")

    @property
    def columns(self) -> list[str]:
        return [f"{self.name}${p}" for p in (EID, LABEL, SRC, DST, *self.props)]

    def struct(self) -> Column:
        return F.when(self.col(EID).isNotNull(), F.struct(self.col(EID).alias(ID), self.col(SRC).alias(SRC), self.col(DST).alias(DST), self.col(LABEL).alias(LABEL), *[self.col(p).alias(p) for p in self.props]))


@dataclass(frozen=True)
class Trail:
    """The edges of a path of variable length: a column of their types and ids, and the positions of their tables."""

    name: str
    tables: tuple

    def apart(self, other: Edge | Trail) -> Column:
        """Whether other shares no edge with this one."""
        mine = F.col(f"`{self.name}`")
        if isinstance(other, Trail):
            return ~F.arrays_overlap(mine, F.col(f"`{other.name}`"))
        return ~F.array_contains(mine, F.concat(other.col(LABEL), F.lit(":"), other.col(EID)))


@dataclass(frozen=True)
class Value:
    column: Column
    name: str = ""

    @property
    def columns(self) -> list[str]:
        return [self.name]


Scope = dict[str, "Node | Edge | Value"]


def run(graph: Graph, text: str, params: dict, read_only: bool = True, max_hops: int = 4, walk: bool = False) -> DataFrame:
    query = P.parse(text, read_only)
    out: DataFrame | None = None
    for clauses in query.parts:
        one = Lowering(graph, params, max_hops, walk, clauses).result()
        if out is not None and len(out.columns) != len(one.columns):
            raise QueryError("the parts of a UNION return different numbers of columns")
        out = one if out is None else out.union(one)
    return out if query.all or len(query.parts) == 1 else out.distinct()


def conjuncts(e) -> list:
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, P.Binary) and e.op == "and" else [e]


class Lowering:
    def __init__(self, graph: Graph, params: dict, max_hops: int, walk: bool, clauses: tuple):
        self.graph, self.params, self.max_hops, self.walk, self.clauses = graph, params, max_hops, walk, clauses
        self.df: DataFrame | None = None
        self.scope: Scope = {}
        self.fresh = counter()
        self.uses = self._uses(clauses)

    # which properties of which variables are read

    def _uses(self, clauses: tuple) -> dict[str, set[str]]:
        """For each variable the properties that are read; "*" if it is returned or collected whole."""
        uses: dict[str, set[str]] = {}

        def whole(name: str) -> None:
            uses.setdefault(name, set()).add("*")

        def visit(e, quiet: bool = False) -> None:
            if isinstance(e, P.Property) and isinstance(e.of, P.Variable):
                uses.setdefault(e.of.name, set()).add(e.name)
            elif isinstance(e, P.Variable):
                if not quiet:
                    whole(e.name)
            elif isinstance(e, P.Call) and e.name in ("count", "id", "labels", "label", "type", "length"):
                for a in e.args:
                    visit(a, quiet=True)
            elif isinstance(e, P.Binary) and e.op in ("=", "<>"):
                visit(e.left, quiet=True)
                visit(e.right, quiet=True)
            elif isinstance(e, P.Unary) and e.op in ("null", "not null"):
                visit(e.of, quiet=True)
            elif isinstance(e, P.NodePattern | P.EdgePattern):
                for k, v in e.props:
                    if e.variable:
                        uses.setdefault(e.variable, set()).add(k)
                    visit(v)
            elif isinstance(e, P.Project):
                if e.star:
                    whole("*")
                for i in e.items:
                    # a variable handed on under its own name is used as later clauses use it
                    visit(i.expression, quiet=isinstance(i.expression, P.Variable) and not e.final and i.alias == i.expression.name)
                visit((e.order, e.skip, e.limit, e.where))
            elif isinstance(e, tuple):
                for x in e:
                    visit(x)
            elif hasattr(e, "__dataclass_fields__"):
                for f in e.__dataclass_fields__:
                    visit(getattr(e, f))

        visit(clauses)
        return uses

    def wanted(self, name: str, properties: list[str]) -> list[str]:
        uses = self.uses.get(name, set())
        everything = "*" in uses or ("*" in self.uses and not name.startswith("_"))
        return [p for p in properties if everything or p in uses]

    # clauses

    def result(self) -> DataFrame:
        names: list[str] | None = None
        for c in self.clauses:
            if isinstance(c, P.Match):
                self.optional_match(c) if c.optional else self.match(c)
            elif isinstance(c, P.Unwind):
                self.unwind(c)
            elif isinstance(c, P.LoadCsv):
                self.load_csv(c)
            elif isinstance(c, P.Project):
                names = self.project(c)
            elif isinstance(c, P.Procedure):
                self.procedure(c)
            elif isinstance(c, P.Create | P.SetItems):
                self.write(c)
        if names is None:
            if self.df is not None and isinstance(self.clauses[-1], P.Procedure):
                return self.df
            if any(isinstance(c, P.Create | P.SetItems) for c in self.clauses):
                return self.graph.spark.createDataFrame([], "done boolean")
            raise QueryError("a query ends with RETURN")
        return self.df

    def match(self, c: P.Match) -> None:
        if self.df is None and c.where is not None and len(c.paths) == 1 and not c.paths[0].edges and not c.paths[0].variable:
            n = c.paths[0].nodes[0]
            if len(self.labels_of(n)) > 1 and any(isinstance(x, P.PatternTest) for x in P.walk(c.where)):
                self.match_by_label(n, c.where)
                return
        self.df, self.scope = self.extend(self.df, self.scope, c.paths, c.where)

    def match_by_label(self, n: P.NodePattern, where) -> None:
        """Nodes of several labels that pass pattern tests: each label is tested by its own keys, against the edge tables
        that can touch it."""
        name, labels = n.variable or f"_anon{next(self.fresh)}", self.labels_of(n)
        self.uses.setdefault(name, set()).update(k for k, _ in n.props)
        frame, node = self.node_frame(name, labels)
        kinds = {p: frame.schema[f"{name}${p}"].dataType for p in node.props}
        out: DataFrame | None = None
        for x in labels:
            table = self.graph.nodes[x]
            one = table.df.select(F.col(ID).alias(f"{name}${ID}"), F.lit(x).alias(f"{name}${LABEL}"), *[(F.col(p) if p in table.properties else F.lit(None)).cast(kinds[p]).alias(f"{name}${p}") for p in node.props])
            scope: Scope = {name: Node(name, (x,), node.props)}
            one = self.with_props(one, scope, scope[name], n.props)
            for e in conjuncts(where):
                one = self.filtered(one, scope, e)
            one = one.select(global_id(x, F.col(f"`{name}${ID}`")).alias(f"{name}${ID}"), *[F.col(f"`{c}`") for c in node.columns[1:]])
            out = one if out is None else out.union(one)
        self.df, self.scope = out, {name: node}

    def extend(self, df: DataFrame | None, scope: Scope, paths: tuple, where) -> tuple[DataFrame, Scope]:
        """df joined with everything that matches paths, filtered by where."""
        scope = dict(scope)
        edges: list[Edge | Trail] = []
        for path in self.ordered(paths, scope):
            df, found = self.path(df, scope, path, where)
            edges += found
        if not self.walk:
            for i, a in enumerate(edges):
                for b in edges[:i]:
                    if not set(a.tables) & set(b.tables):
                        continue
                    if isinstance(a, Trail) or isinstance(b, Trail):
                        df = df.filter(a.apart(b) if isinstance(a, Trail) else b.apart(a))
                    else:
                        df = df.filter((a.col(LABEL) != b.col(LABEL)) | (a.col(EID) != b.col(EID)) if len(a.tables) > 1 or len(b.tables) > 1 else a.col(EID) != b.col(EID))
        df = df.drop(*[x.name for x in edges if isinstance(x, Trail)])
        for e in conjuncts(where) if where is not None else []:
            df = self.filtered(df, scope, e)
        return df, scope

    def ordered(self, paths: tuple, scope: Scope) -> list[P.PathPattern]:
        """Paths so that each shares a variable with what came before it, where it can."""
        rest, known, out = list(paths), set(scope), []
        while rest:
            best = next((p for p in rest if known & {n.variable for n in p.nodes}), None) or max(rest, key=lambda p: any(n.props for n in p.nodes))
            rest.remove(best)
            known |= {n.variable for n in best.nodes if n.variable}
            out.append(best)
        return out

    def filtered(self, df: DataFrame, scope: Scope, e) -> DataFrame:
        negative, inner = False, e
        while isinstance(inner, P.Unary) and inner.op == "not":
            negative, inner = not negative, inner.of
        if isinstance(inner, P.PatternTest):
            keys, frame, conditions = self.pattern_frame(scope, inner.path)
            # each key once: far fewer rows to shuffle than edges
            return df.join(frame.distinct() if keys else frame, reduce(lambda a, b: a & b, conditions) if keys else F.lit(True), "left_anti" if negative else "left_semi")
        if any(isinstance(x, P.PatternTest) for x in P.walk(e)):
            df, e = self.flagged(df, scope, e)
        return df.filter(self.expression(e, scope))

    def flagged(self, df: DataFrame, scope: Scope, e):
        """Pattern tests inside an expression become columns: a left join with what the pattern matches."""
        for test in [x for x in P.walk(e) if isinstance(x, P.PatternTest)]:
            keys, frame, conditions = self.pattern_frame(scope, test.path)
            name = f"_flag{next(self.fresh)}"
            frame = frame.distinct().withColumn(name, F.lit(True))
            df = df.join(frame, reduce(lambda a, b: a & b, conditions) if keys else F.lit(True), "left").drop(*keys)
            scope[name] = Value(F.coalesce(F.col(name), F.lit(False)), name)
            e = self.replaced(e, test, P.Variable(name))
        return df, e

    def replaced(self, e, old, new):
        if e == old:
            return new
        if isinstance(e, tuple):
            return tuple(self.replaced(x, old, new) for x in e)
        if hasattr(e, "__dataclass_fields__"):
            return replace(e, **{f: self.replaced(getattr(e, f), old, new) for f in e.__dataclass_fields__})
        return e

    def pattern_frame(self, scope: Scope, path: P.PathPattern) -> tuple[list[str], DataFrame, list[Column]]:
        """The ids that a pattern's outer variables take where it matches: (key columns, frame, join conditions)."""
        shared = [n.variable for n in path.nodes if n.variable in scope and isinstance(scope[n.variable], Node)]
        renamed = {v: f"_in{next(self.fresh)}_{v}" for v in dict.fromkeys(shared)}
        nodes = tuple(replace(n, variable=renamed.get(n.variable, n.variable), labels=n.labels or (scope[n.variable].labels if n.variable in renamed else ())) for n in path.nodes)
        frame, inner = self.extend(None, {}, (replace(path, nodes=nodes),), None)
        keys, conditions, columns = [], [], []
        for v, r in renamed.items():
            key = f"_key{next(self.fresh)}"
            own, other = self.same_kind(scope[v], inner[r])
            columns.append(other.alias(key))
            conditions.append(own == F.col(key))
            keys.append(key)
        return keys, frame.select(*columns) if columns else frame.select(F.lit(1).alias("_one")).limit(1), conditions

    def same_kind(self, a: Node, b: Node) -> tuple[Column, Column]:
        """Ids of two nodes in a form in which equal ones are the same node."""
        return (a.col(ID), b.col(ID)) if len(a.labels) == len(b.labels) == 1 and a.labels == b.labels else (a.gid, b.gid)

    def optional_match(self, c: P.Match) -> None:
        if self.df is None:
            self.df = self.graph.spark.range(1).select(F.lit(1).alias("_one"))
        shared = [v for v in dict.fromkeys(n.variable for p in c.paths for n in p.nodes) if v in self.scope]
        renamed = {v: f"_in{next(self.fresh)}_{v}" for v in shared}
        for v, r in renamed.items():
            self.uses[r] = set()
        paths = tuple(
            replace(p, nodes=tuple(replace(n, variable=renamed.get(n.variable, n.variable), labels=n.labels or (self.scope[n.variable].labels if n.variable in renamed else ())) for n in p.nodes))
            for p in c.paths
        )
        frame, inner = self.extend(None, {}, paths, None)
        new = {v: b for v, b in inner.items() if v not in renamed.values()}
        columns = [x for b in new.values() for x in b.columns]
        conditions, keys = [], []
        for v, r in renamed.items():
            key = f"_key{next(self.fresh)}"
            own, other = self.same_kind(self.scope[v], inner[r])
            frame = frame.withColumn(key, other)
            conditions.append(own == F.col(key))
            keys.append(key)
        frame = frame.select(*[F.col(f"`{x}`") for x in columns], *keys)
        scope = {**self.scope, **new}
        if c.where is not None:
            conditions.append(self.expression(c.where, scope))
        self.df = self.df.join(frame, reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True), "left").drop(*keys)
        self.scope = scope

    # patterns

    def labels_of(self, n: P.NodePattern) -> tuple:
        for x in n.labels:
            if x not in self.graph.nodes:
                raise QueryError(f"no node label {x}; there are {', '.join(self.graph.nodes)}")
        return n.labels or tuple(self.graph.nodes)

    def path(self, df: DataFrame | None, scope: Scope, path: P.PathPattern, where) -> tuple[DataFrame, list[Edge | Trail]]:
        names = [n.variable or f"_anon{next(self.fresh)}" for n in path.nodes]
        nodes = [replace(n, variable=v) for n, v in zip(path.nodes, names)]
        for n in nodes:
            self.uses.setdefault(n.variable, set()).update(k for k, _ in n.props)
        if path.shortest:
            return self.shortest(df, scope, path, nodes, where), []
        labels = self.possible(nodes, path.edges, scope)
        # begin at a variable that is bound, else at one with given properties, else at the first
        begin = next((i for i, n in enumerate(nodes) if n.variable in scope), None)
        if begin is None:
            begin = next((i for i, n in enumerate(nodes) if n.props), 0)
            first = path.edges[begin] if begin < len(path.edges) else path.edges[-1] if path.edges else None
            if df is not None or first is None or first.variable_length or not self.bare(nodes[begin], labels[begin]):
                df = self.scan(df, scope, nodes[begin], labels[begin])
        else:
            df = self.given(df, scope, nodes[begin])
        edges: list[Edge | Trail] = []
        parts: dict[int, Edge | None] = {}
        for i in [*range(begin, len(path.edges)), *range(begin - 1, -1, -1)]:
            forward = i >= begin
            e = path.edges[i] if forward else self.turned(path.edges[i])
            a, b = (i, i + 1) if forward else (i + 1, i)
            if e.variable_length:
                df, trail = self.many_hops(df, scope, nodes[a], e, nodes[b], labels[b])
                edges.append(trail)
                parts[i] = None
            else:
                df, parts[i] = self.hop(df, scope, nodes[a], e, nodes[b], labels[a], labels[b])
                edges.append(parts[i])
        if path.variable:
            if any(p is None for p in parts.values()):
                raise QueryError("a path variable needs edges of fixed length or shortestPath")
            self.bind_path(scope, path.variable, [scope[v] for v in names], [parts[i] for i in range(len(path.edges))])
        return df, edges

    def bind_path(self, scope: Scope, name: str, nodes: list[Node], edges: list[Edge]) -> None:
        column = F.struct(F.array(*[n.gid for n in nodes]).alias("nodes"), (F.array(*[e.col(LABEL) for e in edges]) if edges else F.array().cast("array<string>")).alias("types"), F.lit(len(edges)).alias("length"))
        scope[name] = Value(column, "")

    def turned(self, e: P.EdgePattern) -> P.EdgePattern:
        return replace(e, direction={"out": "in", "in": "out"}.get(e.direction, "both"))

    def possible(self, nodes: list[P.NodePattern], edges: tuple, scope: Scope) -> list[tuple]:
        """Labels that each node can have, given the edge tables that exist between them."""
        out = [scope[n.variable].labels if n.variable in scope and isinstance(scope[n.variable], Node) else self.labels_of(n) for n in nodes]
        changed = True
        while changed:
            changed = False
            for i, e in enumerate(edges):
                if e.variable_length:
                    continue
                pairs = {(t.source, t.target) if d == "out" else (t.target, t.source) for t, d in self.tables(e, out[i], out[i + 1])}
                for k, side in ((i, 0), (i + 1, 1)):
                    kept = tuple(x for x in out[k] if any(p[side] == x for p in pairs))
                    if kept != out[k]:
                        out[k], changed = kept, True
        return out

    def tables(self, e: P.EdgePattern, left: tuple, right: tuple) -> list[tuple[EdgeTable, str]]:
        """Edge tables, with direction, that lead from a left to a right label."""
        for t in e.types:
            if t not in self.graph.edge_types():
                raise QueryError(f"no edge type {t}; there are {', '.join(self.graph.edge_types())}")
        out = []
        for t in self.graph.edges:
            if e.types and t.name not in e.types:
                continue
            if e.direction in ("out", "both") and t.source in left and t.target in right:
                out.append((t, "out"))
            if e.direction in ("in", "both") and t.target in left and t.source in right:
                out.append((t, "in"))
        return out

    def node_frame(self, name: str, labels: tuple) -> tuple[DataFrame, Node]:
        kinds: dict[str, T.DataType] = {}
        for x in labels:
            for f in self.graph.nodes[x].df.schema.fields:
                if f.name in self.graph.nodes[x].properties:
                    kinds[f.name] = f.dataType if kinds.get(f.name, f.dataType) == f.dataType else T.StringType()
        props = self.wanted(name, list(kinds))
        node = Node(name, tuple(labels), tuple(props))
        out: DataFrame | None = None
        for x in labels:
            table = self.graph.nodes[x]
            key = F.col(ID) if len(labels) == 1 else global_id(x, F.col(ID))
            one = table.df.select(
                key.alias(f"{name}${ID}"), F.lit(x).alias(f"{name}${LABEL}"),
                *[(F.col(p).cast(kinds[p]) if p in table.properties else F.lit(None).cast(kinds[p])).alias(f"{name}${p}") for p in props],
            )
            out = one if out is None else out.union(one)
        if out is None:
            raise QueryError("no label fits this pattern")
        return out, node

    def bare(self, n: P.NodePattern, labels: tuple) -> bool:
        """Whether only the node's identity is read, so that its edges can stand for it."""
        props = {p for x in labels for p in self.graph.nodes[x].properties}
        return bool(labels) and not n.props and not self.wanted(n.variable, list(props)) and not any(t.dangling for t in self.graph.edges)

    def scan(self, df: DataFrame | None, scope: Scope, n: P.NodePattern, labels: tuple) -> DataFrame:
        if not labels:
            labels = self.labels_of(n)
            frame, node = self.node_frame(n.variable, labels)
            frame = frame.limit(0)
        else:
            frame, node = self.node_frame(n.variable, labels)
        scope[n.variable] = node
        frame = self.with_props(frame, scope, node, n.props)
        return frame if df is None else df.crossJoin(frame)

    def with_props(self, df: DataFrame, scope: Scope, bound: Node | Edge, props: tuple) -> DataFrame:
        for k, v in props:
            if k not in bound.props:
                raise QueryError(f"{bound.name} has no property {k}")
            df = df.filter(bound.col(k) == self.expression(v, scope))
        return df

    def given(self, df: DataFrame, scope: Scope, n: P.NodePattern) -> DataFrame:
        """A variable that is bound already: its labels and properties become filters."""
        node = scope[n.variable]
        if not isinstance(node, Node):
            raise QueryError(f"{n.variable} is no node")
        if n.labels and set(node.labels) - set(n.labels):
            df = df.filter(node.col(LABEL).isin(*n.labels))
        return self.with_props(df, scope, node, n.props)

    def edge_frame(self, name: str, e: P.EdgePattern, tables: list[tuple[EdgeTable, str]], native_left: bool, native_right: bool) -> tuple[DataFrame, Edge]:
        kinds: dict[str, T.DataType] = {}
        for t, _ in tables:
            for f in t.df.schema.fields:
                if f.name in t.properties:
                    kinds[f.name] = f.dataType if kinds.get(f.name, f.dataType) == f.dataType else T.StringType()
        props = self.wanted(name, list(kinds))
        edge = Edge(name, tuple(dict.fromkeys(t.name for t, _ in tables)), tuple(props), tuple(dict.fromkeys(self.graph.edges.index(t) for t, _ in tables)))
        out: DataFrame | None = None
        for t, d in tables:
            df = t.with_id
            src, dst = F.col(SRC), F.col(DST)
            left, right = (src, dst) if d == "out" else (dst, src)
            left_label, right_label = (t.source, t.target) if d == "out" else (t.target, t.source)
            if d == "in" and any(o is t and x == "out" for o, x in tables):
                df = df.filter(src.cast("string") != dst.cast("string")) if t.source == t.target else df  # a loop counts once
            one = df.select(
                (left if native_left else global_id(left_label, left)).alias(f"{name}$_a"), (right if native_right else global_id(right_label, right)).alias(f"{name}$_b"), F.lit(left_label).alias(f"{name}$_al"), F.lit(right_label).alias(f"{name}$_bl"),
                F.col(EID).cast("string").alias(f"{name}${EID}"), F.lit(t.name).alias(f"{name}${LABEL}"),
                global_id(t.source, src).alias(f"{name}${SRC}"), global_id(t.target, dst).alias(f"{name}${DST}"),
                *[(F.col(p).cast(kinds[p]) if p in t.properties else F.lit(None).cast(kinds[p])).alias(f"{name}${p}") for p in props],
            )
            out = one if out is None else out.union(one)
        return out, edge

    def hop(self, df: DataFrame | None, scope: Scope, a: P.NodePattern, e: P.EdgePattern, b: P.NodePattern, own: tuple, labels: tuple) -> tuple[DataFrame, Edge]:
        """df with an edge and the node it leads to; without a df the edges themselves begin the path."""
        left = scope[a.variable] if df is not None else Node(a.variable, own, ())
        bound = scope.get(b.variable)
        right_labels = bound.labels if isinstance(bound, Node) else labels
        tables = self.tables(e, left.labels, right_labels)
        name = e.variable or f"_anon{next(self.fresh)}"
        self.uses.setdefault(name, set()).update(k for k, _ in e.props)
        if name in scope:
            raise QueryError(f"{name} is bound already")
        if not tables:
            # nothing leads there: no rows, with the columns that later clauses expect
            edge = Edge(name, (), (), ())
            nothing = F.lit(None).cast("string")
            df = self.scan(df, scope, a, own) if df is None else df
            df = df.filter(F.lit(False)).withColumns({c: nothing for c in edge.columns})
            scope[name] = edge
            if bound is None:
                frame, node = self.node_frame(b.variable, self.labels_of(b))
                scope[b.variable] = node
                df = df.crossJoin(frame.limit(0))
            return df, edge
        native_left = len(left.labels) == 1
        reached = tuple(dict.fromkeys(t.target if d == "out" else t.source for t, d in tables))
        target = bound if isinstance(bound, Node) else None
        native_right = len(target.labels if target else reached) == 1
        frame, edge = self.edge_frame(name, e, tables, native_left, native_right)
        scope[name] = edge
        frame = self.with_props(frame, scope, edge, e.props)
        on = left.col(ID) == F.col(f"`{name}$_a`")
        if df is None:
            scope[a.variable] = left
            frame = frame.withColumn(f"{a.variable}${ID}", F.col(f"`{name}$_a`")).withColumn(f"{a.variable}${LABEL}", F.col(f"`{name}$_al`"))
            if b.variable == a.variable:
                target = left
        if target is not None and df is None:
            df = frame.filter(target.col(ID) == F.col(f"`{name}$_b`"))
        elif target is not None:
            df = df.join(frame, on & (target.col(ID) == F.col(f"`{name}$_b`")))
            df = self.given(df, scope, b)
        else:
            df = frame if df is None else df.join(frame, on)
            nodes, node = self.node_frame(b.variable, reached)
            if node.props or any(t.dangling for t, _ in tables):
                df = df.join(nodes, F.col(f"`{name}$_b`") == node.col(ID))
            else:
                df = df.withColumn(f"{b.variable}${ID}", F.col(f"`{name}$_b`")).withColumn(f"{b.variable}${LABEL}", F.col(f"`{name}$_bl`"))
            scope[b.variable] = node
            df = self.with_props(df, scope, node, b.props)
        return df.drop(f"{name}$_a", f"{name}$_al", f"{name}$_b", f"{name}$_bl"), edge

    # paths of many edges: a frame per label, by that label's own keys, with only the edge tables that can still lead to a goal

    def steps(self, e: P.EdgePattern) -> dict[str, list[tuple[EdgeTable, str, str]]]:
        """For each label the edge tables that lead away from it: (table, direction, label reached)."""
        everything = tuple(self.graph.nodes)
        out: dict[str, list[tuple[EdgeTable, str, str]]] = {}
        for t, d in self.tables(e, everything, everything):
            a, b = (t.source, t.target) if d == "out" else (t.target, t.source)
            out.setdefault(a, []).append((t, d, b))
        if not out:
            raise QueryError("no edge fits this pattern")
        return out

    def leading(self, steps: dict[str, list], goals: tuple, most: int) -> list[set[str]]:
        """Labels from which a goal can be met in at most n steps, by n."""
        out = [set(goals)]
        for _ in range(most):
            out.append(out[-1] | {a for a, some in steps.items() if any(b in out[-1] for *_, b in some)})
        return out

    def stepped(self, now: DataFrame, native: bool, label: str, t: EdgeTable, d: str, both: bool) -> DataFrame:
        """now joined with the edges of a table that begin at _to: _b (the key they lead to), _e and _t."""
        df = t.with_id
        if d == "in" and both and t.source == t.target:
            df = df.filter(F.col(SRC).cast("string") != F.col(DST).cast("string"))  # a loop counts once
        a, b = (SRC, DST) if d == "out" else (DST, SRC)
        key = F.col(a) if native else global_id(label, F.col(a))
        edges = df.select(key.alias("_a"), F.col(b).alias("_b"), F.concat(F.lit(t.name + ":"), F.col(EID).cast("string")).alias("_e"), F.lit(t.name).alias("_t"))
        return now.join(edges, F.col("_to") == F.col("_a"))

    def starts(self, df: DataFrame, left: Node, *more: Column) -> dict[str, tuple[DataFrame, bool]]:
        """For each label of left: (_from, _to and more, whether _to is the label's own key)."""
        if len(left.labels) == 1:
            return {left.labels[0]: (df.select(left.col(ID).alias("_from")).distinct().select("_from", F.col("_from").alias("_to"), *more), True)}
        now = df.select(left.col(ID).alias("_from"), left.col(LABEL).alias("_l")).distinct()
        return {x: (now.filter(F.col("_l") == x).select("_from", F.col("_from").alias("_to"), *more), False) for x in left.labels}

    def arrived(self, parts: list[tuple[str, DataFrame, bool]], wide: bool, columns: list[str], empty: DataFrame) -> DataFrame:
        """What led to goals as one frame: _from, _to (an id across labels if wide, else the one goal's key), _tl, columns."""
        out: DataFrame | None = None
        for label, df, native in parts:
            to = global_id(label, F.col("_to")) if wide and native else F.col("_to")
            one = df.select("_from", to.alias("_to"), F.lit(label).alias("_tl"), *columns)
            out = one if out is None else out.union(one)
        return out if out is not None else empty.filter(F.lit(False)).select("_from", "_to", F.lit(None).cast("string").alias("_tl"), *columns)

    def ended(self, df: DataFrame, scope: Scope, found: DataFrame, left: Node, b: P.NodePattern, goals: tuple, wide: bool) -> DataFrame:
        """df joined with the paths found from left, whose ends b names."""
        bound = scope.get(b.variable)
        on = left.col(ID) == F.col("_from")
        if isinstance(bound, Node):
            across = wide or len(bound.labels) > 1
            to = global_id(goals[0], F.col("_to")) if across and not wide else F.col("_to")
            return self.given(df.join(found, on & ((bound.gid if across else bound.col(ID)) == to)), scope, b)
        df = df.join(found, on)
        if self.bare(b, goals) and wide == (len(goals) > 1):
            scope[b.variable] = Node(b.variable, goals, ())
            return df.withColumn(f"{b.variable}${ID}", F.col("_to")).withColumn(f"{b.variable}${LABEL}", F.col("_tl"))
        frame, node = self.node_frame(b.variable, goals)
        scope[b.variable] = node
        return self.with_props(df.join(frame, (node.gid if wide else node.col(ID)) == F.col("_to")), scope, node, b.props)

    def goals_of(self, scope: Scope, left: Node, b: P.NodePattern, labels: tuple, steps: dict[str, list], least: int, most: int) -> tuple:
        """Labels that b can have at the end of such a path."""
        bound = scope.get(b.variable)
        wanted = bound.labels if isinstance(bound, Node) else labels
        met, level = set(left.labels) if least == 0 else set(), set(left.labels)
        for n in range(1, most + 1):
            level = {b for a in level for *_, b in steps.get(a, [])}
            met |= level if n >= least else set()
        return tuple(x for x in wanted if x in met) or tuple(wanted[:1])

    def many_hops(self, df: DataFrame, scope: Scope, a: P.NodePattern, e: P.EdgePattern, b: P.NodePattern, labels: tuple) -> tuple[DataFrame, Trail]:
        """Trails of least to most edges, unrolled into joins; no edge is used twice."""
        left = scope[a.variable]
        least, most = e.least if e.least is not None else 1, e.most if e.most is not None else self.max_hops
        if most < least:
            raise QueryError("a pattern of variable length needs an upper end that is not below its lower end")
        steps = self.steps(e)
        goals = self.goals_of(scope, left, b, labels, steps, least, most)
        leading = self.leading(steps, goals, most)
        texts = F.array().cast("array<string>")
        now = self.starts(df, left, texts.alias("_used"), texts.alias("_types"))
        used: dict[str, set[int]] = {x: set() for x in now}
        first = next(iter(now.values()))[0]
        columns = ["_used", "_types"]
        parts = [(x, one, native) for x, (one, native) in now.items() if x in goals] if least == 0 else []
        everywhere: set[int] = set()
        for n in range(1, most + 1):
            reached: dict[str, DataFrame] = {}
            tables: dict[str, set[int]] = {}
            for x, (one, native) in now.items():
                for t, d, y in steps.get(x, []):
                    if y not in leading[most - n]:
                        continue
                    k = self.graph.edges.index(t)
                    further = self.stepped(one, native, x, t, d, e.direction == "both")
                    if not self.walk and k in used[x]:
                        further = further.filter(~F.array_contains("_used", F.col("_e")))
                    further = further.select("_from", F.col("_b").alias("_to"), F.array_append("_used", F.col("_e")).alias("_used"), F.array_append("_types", F.col("_t")).alias("_types"))
                    reached[y] = reached[y].union(further) if y in reached else further
                    tables[y] = tables.get(y, set()) | used[x] | {k}
            now, used = {y: (one, True) for y, one in reached.items()}, tables
            everywhere |= set().union(*tables.values()) if tables else set()
            if n >= least:
                parts += [(y, one, native) for y, (one, native) in now.items() if y in goals]
        wide = len(goals) > 1 or not all(native for *_, native in parts)
        df = self.ended(df, scope, self.arrived(parts, wide, columns, first), left, b, goals, wide)
        number = next(self.fresh)
        trail = Trail(f"_trail{number}", tuple(everywhere))
        df = df.withColumnRenamed("_used", trail.name)
        if e.variable:
            name = f"_edges{number}"
            df = df.withColumn(name, F.col("_types"))
            scope[e.variable] = Value(F.col(name), name)
        return df.drop("_from", "_to", "_tl", "_types"), trail

    def shortest(self, df: DataFrame | None, scope: Scope, path: P.PathPattern, nodes: list[P.NodePattern], where) -> DataFrame:
        """One shortest path for each pair of ends, of equally short ones the first by its nodes' ids: levels of a
        breadth-first search, each with the best path to every node not met before. Ends that are not bound yet are
        joined to what the search has found."""
        if len(path.edges) != 1:
            raise QueryError("shortestPath takes one edge pattern")
        e, begin, end = path.edges[0], nodes[0], nodes[-1]
        back = end.variable in scope and begin.variable not in scope
        if back:
            e, begin, end = self.turned(e), end, begin
        df = self.given(df, scope, begin) if begin.variable in scope else self.scan(df, scope, begin, self.labels_of(begin))
        for c in conjuncts(where) if where is not None else []:
            names = {x.name for x in P.walk(c) if isinstance(x, P.Variable)}
            if names and names <= set(scope) and not any(isinstance(x, P.PatternTest) for x in P.walk(c)):
                df = self.filtered(df, scope, c)
        left = scope[begin.variable]
        most = (e.most if e.most is not None else self.max_hops) if e.variable_length else 1
        least = e.least if e.least is not None else 1
        steps = self.steps(e)
        goals = self.goals_of(scope, left, end, self.labels_of(end), steps, least, most)
        leading = self.leading(steps, goals, most)
        own = F.col("_from") if len(left.labels) > 1 else global_id(left.labels[0], F.col("_from"))
        now = self.starts(df, left, F.array(own).alias("_nodes"), F.array().cast("array<string>").alias("_types"))
        first = next(iter(now.values()))[0]
        columns = ["_nodes", "_types"]
        met = {x: one.select("_from", (F.col("_to") if native else F.col("_from")).alias("_to")) for x, (one, native) in now.items()}
        keyed = {x: native for x, (_, native) in now.items()}  # whether what is met is known by the label's own keys
        parts = [(x, one, native) for x, (one, native) in now.items() if x in goals] if least == 0 else []
        add = (lambda c, x: F.array_prepend(c, x)) if back else (lambda c, x: F.array_append(c, x))
        for n in range(1, most + 1):
            reached: dict[str, DataFrame] = {}
            for x, (one, native) in now.items():
                for t, d, y in steps.get(x, []):
                    if y in leading[most - n]:
                        further = self.stepped(one, native, x, t, d, e.direction == "both")
                        further = further.select("_from", F.col("_b").alias("_to"), add("_nodes", global_id(y, F.col("_b"))).alias("_nodes"), add("_types", F.col("_t")).alias("_types"))
                        reached[y] = reached[y].union(further) if y in reached else further
            now = {}
            for y, one in reached.items():
                if y in met:
                    known = met[y]
                    key = F.col("_to") if keyed[y] else global_id(y, F.col("_to"))
                    known = known.select(F.col("_from").alias("_kf"), F.col("_to").alias("_kt"))
                    one = one.join(known, (F.col("_from") == F.col("_kf")) & (key == F.col("_kt")), "left_anti")
                one = one.groupBy("_from", "_to").agg(F.min(F.struct("_nodes", "_types")).alias("_p")).select("_from", "_to", F.col("_p._nodes").alias("_nodes"), F.col("_p._types").alias("_types"))
                now[y] = (one, True)
                fresh = one.select("_from", (F.col("_to") if keyed.setdefault(y, True) else global_id(y, F.col("_to"))).alias("_to"))
                met[y] = met[y].union(fresh) if y in met else fresh
            if n >= least:
                parts += [(y, one, native) for y, (one, native) in now.items() if y in goals]
        wide = len(goals) > 1 or not all(native for *_, native in parts)
        df = self.ended(df, scope, self.arrived(parts, wide, columns, first), left, end, goals, wide)
        name = path.variable or f"_path{next(self.fresh)}"
        column = f"_path{next(self.fresh)}"
        df = df.withColumn(column, F.struct(F.col("_nodes").alias("nodes"), F.col("_types").alias("types"), F.size("_types").alias("length")))
        scope[name] = Value(F.col(column), column)
        return df.drop("_from", "_to", "_tl", "_nodes", "_types")

    # other clauses

    def unwind(self, c: P.Unwind) -> None:
        if self.df is None:
            self.df = self.graph.spark.range(1).select(F.lit(1).alias("_one"))
        name = f"{c.alias}"
        source = self.expression(c.expression, self.scope)
        self.df = self.df.withColumn(name, F.explode(source))
        self.scope = {**self.scope, c.alias: Value(F.col(f"`{name}`"), name)}

    def load_csv(self, c: P.LoadCsv) -> None:
        """One row for each of a file's: a struct by column name, or a list of texts without headers."""
        rows = self.graph.spark.read.option("header", c.headers).csv(self.constant(c.path))
        column = F.struct(*[F.col(f"`{x}`") for x in rows.columns]) if c.headers else F.array(*[F.col(f"`{x}`") for x in rows.columns])
        rows = rows.select(column.alias(c.alias))
        self.df = rows if self.df is None else self.df.crossJoin(rows)
        self.scope = {**self.scope, c.alias: Value(F.col(f"`{c.alias}`"), c.alias)}

    def procedure(self, c: P.Procedure) -> None:
        args = [self.constant(a) for a in c.args]
        if c.name == "show_tables":
            self.df = self.graph.show_tables()
        elif c.name == "table_info" and len(args) == 1:
            self.df = self.graph.table_info(args[0])
        else:
            raise QueryError(f"no procedure {c.name} with {len(args)} arguments")
        self.scope = {n: Value(F.col(f"`{n}`"), n) for n in self.df.columns}

    def constant(self, e):
        if isinstance(e, P.Literal):
            return e.value
        if isinstance(e, P.Param):
            if e.name not in self.params:
                raise QueryError(f"no parameter {e.name}")
            return self.params[e.name]
        if isinstance(e, P.Unary) and e.op == "-":
            return -self.constant(e.of)
        raise QueryError("a constant is needed here")

    def write(self, c: P.Create | P.SetItems) -> None:
        store = self.graph
        if not hasattr(store, "append_nodes"):
            raise QueryError("this graph can't be changed; use a GraphStore")
        if isinstance(c, P.SetItems):
            for variable, prop, e in c.items:
                node = self.scope[variable]
                label = node.labels[0]
                if len(node.labels) != 1:
                    raise QueryError("SET needs a node of one label")
                changes = self.df.select(node.col(ID).alias(ID), self.expression(e, self.scope).alias("_value"))
                store.set_property(label, prop, changes)
            return
        for path in c.paths:
            for n in path.nodes:
                if n.variable not in self.scope:
                    if len(n.labels) != 1:
                        raise QueryError("CREATE needs a node of one label")
                    base = self.df if self.df is not None else store.spark.range(1)
                    rows = base.select(*[self.expression(v, self.scope).alias(k) for k, v in n.props])
                    df = store.append_nodes(n.labels[0], rows)
                    if self.df is None and n.variable:
                        self.df, node = df.select(*[F.col(x).alias(f"{n.variable}${x}") for x in df.columns], F.lit(n.labels[0]).alias(f"{n.variable}${LABEL}")), Node(n.variable, n.labels, tuple(x for x in df.columns if x != ID))
                        self.scope = {**self.scope, n.variable: node}
            for i, e in enumerate(path.edges):
                a, b = (path.nodes[i], path.nodes[i + 1]) if e.direction != "in" else (path.nodes[i + 1], path.nodes[i])
                if a.variable not in self.scope or b.variable not in self.scope:
                    raise QueryError("CREATE of an edge needs both ends matched before")
                src, dst = self.scope[a.variable], self.scope[b.variable]
                rows = self.df.select(src.col(ID).alias(SRC), dst.col(ID).alias(DST), *[self.expression(v, self.scope).alias(k) for k, v in e.props])
                store.append_edges(e.types[0], src.labels[0], dst.labels[0], rows)

    # projections

    def project(self, c: P.Project) -> list[str]:
        if self.df is None:
            self.df = self.graph.spark.range(1).select(F.lit(1).alias("_one"))
        items = list(c.items)
        if c.star:
            items = [P.Item(P.Variable(v), v) for v in self.scope if not v.startswith("_")] + items
        if not items:
            raise QueryError("nothing to return")
        df, before = self.df, dict(self.scope)
        tests = [i.expression for i in items if any(isinstance(x, P.PatternTest) for x in P.walk(i.expression))]
        for t in tests:
            df, new = self.flagged(df, before, t)
            items = [replace(i, expression=new) if i.expression == t else i for i in items]
        aggregated = [self.aggregates(i.expression) for i in items]
        after: Scope = {}
        out: list[Column] = []
        hidden: list[tuple[str, Column]] = []
        grouped = any(aggregated)
        keys: list[Column] = []
        for i, a in zip(items, aggregated):
            bound = before.get(i.expression.name) if isinstance(i.expression, P.Variable) else None
            if isinstance(bound, Node | Edge) and not c.final:
                new = replace(bound, name=i.alias)
                columns = [F.col(f"`{x}`").alias(y) for x, y in zip(bound.columns, new.columns)]
                after[i.alias] = new
                keys += columns
                out += columns
            else:
                column = self.expression(i.expression, before).alias(i.alias)
                after[i.alias] = Value(F.col(f"`{i.alias}`"), i.alias)
                (out if a else keys).append(column) if grouped else out.append(column)
                if grouped and not a:
                    out.append(column)
        order: list[tuple[str, bool]] = []
        for e, down in c.order:
            match = next((i.alias for i in items if i.expression == e or (isinstance(e, P.Variable) and e.name == i.alias)), None)
            if match is not None and isinstance(after[match], Value):
                order.append((match, down))
            else:
                name = f"_order{next(self.fresh)}"
                if not self.resolves(e, before) or any(isinstance(x, P.Variable) and x.name in after and x.name not in before for x in P.walk(e)):
                    hidden.append((name, e))  # in terms of the results
                else:
                    column = self.expression(e, before).alias(name)
                    (out if self.aggregates(e) or not grouped else keys).append(column)
                order.append((name, down))
        if grouped:
            only = [x for x in out if not any(x is k for k in keys)]
            df = df.groupBy(*keys).agg(*only) if keys else df.agg(*only)
        else:
            df = df.select(*out)
        for name, e in hidden:
            df = df.withColumn(name, self.expression(e, after))
        visible = [x for b in after.values() for x in b.columns]
        if c.distinct:
            df = df.select(*[F.col(f"`{x}`") for x in visible]).distinct() if not any(n.startswith("_order") for n, _ in order) else df.dropDuplicates(visible)
        if c.where is not None:
            for e in conjuncts(c.where):
                df = self.filtered(df, after, e)
        if order:
            # null sorts as the largest value
            df = df.orderBy(*[F.col(f"`{n}`").desc_nulls_first() if down else F.col(f"`{n}`").asc_nulls_last() for n, down in order])
        if c.skip is not None:
            df = df.offset(int(self.constant(c.skip)))
        if c.limit is not None:
            df = df.limit(int(self.constant(c.limit)))
        self.df = df.select(*[F.col(f"`{x}`") for x in visible])
        self.scope = after
        return visible

    def resolves(self, e, scope: Scope) -> bool:
        bound = {x.variable for x in P.walk(e) if isinstance(x, P.Comprehension)}
        return all(x.name in scope or x.name in bound for x in P.walk(e) if isinstance(x, P.Variable))

    def aggregates(self, e) -> bool:
        return any(isinstance(x, P.Call) and x.name in AGGREGATES for x in P.walk(e))

    # expressions

    def expression(self, e, scope: Scope) -> Column:
        ev: Callable = lambda x: self.expression(x, scope)
        if isinstance(e, P.Literal):
            return F.lit(e.value)
        if isinstance(e, P.Param):
            v = self.constant(e)
            return F.array(*[F.lit(x) for x in v]) if isinstance(v, list | tuple) else F.lit(v)
        if isinstance(e, P.Variable):
            b = scope.get(e.name)
            if b is None:
                raise QueryError(f"no variable {e.name}; there are {', '.join(v for v in scope if not v.startswith('_'))}")
            return b.column if isinstance(b, Value) else b.struct()
        if isinstance(e, P.Property):
            if isinstance(e.of, P.Variable) and isinstance(b := scope.get(e.of.name), Node | Edge):
                if e.name in b.props:
                    return b.col(e.name)
                if e.name in (ID, LABEL) and isinstance(b, Node):
                    return b.gid if e.name == ID else b.col(LABEL)
                raise QueryError(f"{b.name} ({', '.join(b.labels if isinstance(b, Node) else b.types)}) has no property {e.name}")
            return ev(e.of).getField(e.name)
        if isinstance(e, P.Index):
            if isinstance(e.at, P.Literal) and isinstance(e.at.value, str):
                return ev(e.of).getField(e.at.value)
            at = ev(e.at)
            of = ev(e.of)
            return F.get(of, F.when(at < 0, F.size(of) + at).otherwise(at).cast("int"))
        if isinstance(e, P.Slice):
            of = ev(e.of)
            first = ev(e.first) if e.first is not None else F.lit(0)
            end = ev(e.end) if e.end is not None else F.size(of)
            return F.slice(of, (first + 1).cast("int"), F.greatest(F.lit(0), end - first).cast("int"))
        if isinstance(e, P.Unary):
            of = ev(e.of) if not self.entity(e.of, scope) else self.entity(e.of, scope).col(ID if isinstance(self.entity(e.of, scope), Node) else EID)
            return {"not": lambda: ~of, "-": lambda: -of, "null": lambda: of.isNull(), "not null": lambda: of.isNotNull()}[e.op]()
        if isinstance(e, P.Binary):
            return self.binary(e, scope)
        if isinstance(e, P.ListLiteral):
            return F.array(*[ev(x) for x in e.items])
        if isinstance(e, P.MapLiteral):
            return F.struct(*[ev(v).alias(k) for k, v in e.items])
        if isinstance(e, P.Comprehension):
            out = ev(e.of)
            inner = lambda x: {**scope, e.variable: Value(x)}
            if e.where is not None:
                out = F.filter(out, lambda x: self.expression(e.where, inner(x)))
            return F.transform(out, lambda x: self.expression(e.give, inner(x))) if e.give is not None else out
        if isinstance(e, P.Case):
            out = None
            for c, r in e.branches:
                test = ev(P.Binary("=", e.of, c)) if e.of is not None else ev(c)
                out = F.when(test, ev(r)) if out is None else out.when(test, ev(r))
            return out.otherwise(ev(e.otherwise)) if e.otherwise is not None else out
        if isinstance(e, P.Call):
            return self.call(e, scope)
        if isinstance(e, P.PatternTest):
            raise QueryError("a pattern can be tested in WHERE, WITH and RETURN only")
        raise QueryError(f"can't read {e}")

    def entity(self, e, scope: Scope) -> Node | Edge | None:
        b = scope.get(e.name) if isinstance(e, P.Variable) else None
        return b if isinstance(b, Node | Edge) else None

    def binary(self, e: P.Binary, scope: Scope) -> Column:
        a, b = self.entity(e.left, scope), self.entity(e.right, scope)
        if e.op in ("=", "<>") and a is not None and b is not None:
            if type(a) is not type(b):
                raise QueryError("a node is never an edge")
            left, right = self.same_kind(a, b) if isinstance(a, Node) else (a.col(EID), b.col(EID))
            return left == right if e.op == "=" else left != right
        if e.op == "in" and isinstance(e.right, P.ListLiteral) and all(isinstance(x, P.Literal) for x in e.right.items):
            return self.expression(e.left, scope).isin(*[x.value for x in e.right.items])
        left, right = self.expression(e.left, scope), self.expression(e.right, scope)
        ops: dict[str, Callable[[], Column]] = {
            "and": lambda: left & right, "or": lambda: left | right, "xor": lambda: (left & ~right) | (~left & right),
            "=": lambda: left == right, "<>": lambda: left != right, "<": lambda: left < right, "<=": lambda: left <= right, ">": lambda: left > right, ">=": lambda: left >= right,
            "+": lambda: F.concat(left, right) if self.text(e.left, scope) or self.text(e.right, scope) else left + right,
            "-": lambda: left - right, "*": lambda: left * right, "/": lambda: F.try_divide(left, right), "%": lambda: F.when(right != 0, left % right),
            "in": lambda: F.array_contains(right, left), "contains": lambda: left.contains(right), "starts": lambda: left.startswith(right), "ends": lambda: left.endswith(right),
            "=~": lambda: F.regexp_like(left, F.concat(F.lit("^(?:"), right, F.lit(")$"))),
        }
        return ops[e.op]()

    def text(self, e, scope: Scope) -> bool:
        """Whether + joins texts or lists here, as far as the tree tells."""
        if isinstance(e, P.Literal):
            return isinstance(e.value, str)
        if isinstance(e, P.Binary) and e.op == "+":
            return self.text(e.left, scope) or self.text(e.right, scope)
        if isinstance(e, P.Call):
            return sql_type_rank(e.name) == "text"
        if isinstance(e, P.Property) and (b := self.entity(e.of, scope)) is not None:
            tables = [self.graph.nodes[x].df for x in b.labels] if isinstance(b, Node) else [self.graph.edges[i].df for i in b.tables]
            return any(e.name in t.columns and isinstance(t.schema[e.name].dataType, T.StringType | T.ArrayType) for t in tables)
        return isinstance(e, P.ListLiteral | P.Comprehension)

    def call(self, e: P.Call, scope: Scope) -> Column:
        if e.name in AGGREGATES:
            if e.star:
                return F.count(F.lit(1))
            if len(e.args) != 1:
                raise QueryError(f"{e.name} takes one argument")
            b = self.entity(e.args[0], scope)
            if b is not None and e.name == "count":
                # what is there has a label, which costs nothing to read
                of = b.col(LABEL) if not e.distinct else (b.gid if len(b.labels) > 1 else b.col(ID)) if isinstance(b, Node) else b.col(EID)
            else:
                of = self.expression(e.args[0], scope)
            return AGGREGATES[e.name](of, e.distinct)
        b = self.entity(e.args[0], scope) if e.args else None
        if b is not None:
            if e.name in ("labels", "label") and isinstance(b, Node):
                return F.array(b.col(LABEL)) if e.name == "labels" else b.col(LABEL)
            if e.name == "type" and isinstance(b, Edge):
                return b.col(LABEL)
            if e.name == "id":
                return b.gid if isinstance(b, Node) else b.col(EID)
            if e.name == "keys":
                return F.filter(F.array(*[F.when(b.col(p).isNotNull(), F.lit(p)) for p in b.props]) if b.props else F.array().cast("array<string>"), lambda x: x.isNotNull())
            if e.name == "properties":
                return F.struct(*[b.col(p).alias(p) for p in b.props])
        if e.name == "exists":
            return self.expression(e.args[0], scope).isNotNull()
        if e.name not in SCALARS:
            raise QueryError(f"no function {e.name}")
        return SCALARS[e.name](*[self.expression(a, scope) for a in e.args])
