"""From nested documents to nodes and edges, set-wise: one explode a path, no loop over documents.

Documents are rows with the root class's fields, ``_key`` (the source key) and ``_ord`` (ingest order). Every node
gets ``_at``, an order within everything ingested: (document, node configuration, path, place in the list).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import RESERVED, EdgeSpec, GraphSchema, NodeSpec
from ..types import element, model_fields

AT = "_at"


def node_id(label: str, key: Column) -> Column:
    """One stable id for each (label, deduplication key)."""
    return F.sha2(F.concat_ws("\u0001", F.lit(label), key), 256)


def as_text(value: Column, kind: T.DataType) -> Column:
    """A name's text; null for what counts as no name: null, empty, zero, false."""
    if isinstance(kind, T.StringType):
        return F.when(value != "", value)
    if isinstance(kind, T.ArrayType):
        return F.when(F.size(value) > 0, F.concat(F.lit("['"), F.array_join(value.cast("array<string>"), "', '"), F.lit("']")))
    if isinstance(kind, T.BooleanType):
        return F.when(value, F.lit("True"))
    if isinstance(kind, T.NumericType):
        return F.when(value != 0, value.cast("string"))
    if isinstance(kind, T.StructType | T.MapType):
        return F.to_json(value)
    return value.cast("string")


def naming(df: DataFrame, item: str, how, label: str) -> Column:
    """The text that a field, or a function of the item, gives."""
    if callable(how):
        column = how(F.col(item), label)
        return as_text(column, df.select(column.alias("c")).schema["c"].dataType)
    kind = df.schema[item].dataType
    if how not in kind.names:
        return F.lit(None).cast("string")
    return as_text(F.col(item)[how], kind[how].dataType)


def items_at(docs: DataFrame, schema: GraphSchema, path: str, name: str = "_item") -> DataFrame:
    """docs with the item at a path, and its place: one row for each item; lists on the way are exploded."""
    root = [c for c in docs.columns if c not in ("_key", "_ord", AT)]
    df = docs if "_root" in docs.columns else docs.select("_key", "_ord", F.struct(*root).alias("_root"))
    df = df.withColumn(name, F.col("_root")).withColumn(f"{name}_place", F.array().cast("array<int>"))
    at = ""
    for part in path.split(".") if path else []:
        at = f"{at}.{part}" if at else part
        place = schema.place(at)
        kind = df.schema[name].dataType
        if part not in kind.names:
            return df.filter(F.lit(False))
        if place is not None and place.is_list:
            df = df.select(*[c for c in df.columns if c not in (name, f"{name}_place")], F.col(f"{name}_place").alias("_before"), F.posexplode(F.col(name)[part]).alias("_i", name))
            df = df.withColumn(f"{name}_place", F.array_append("_before", F.col("_i"))).drop("_before", "_i")
        else:
            df = df.withColumn(name, F.col(name)[part])
        df = df.filter(F.col(name).isNotNull())
    return df


def identity(df: DataFrame, item: str, n: NodeSpec) -> tuple[Column, Column]:
    """(name, deduplication key) of an item, alike for nodes and for the ends of edges."""
    name = F.coalesce(naming(df, item, n.name_from, n.label), F.lit(f"{n.label}_unnamed"))
    key = naming(df, item, n.deduplication_key, n.label) if n.deduplication_key is not None else F.lit(None).cast("string")
    return name, F.coalesce(key, name)


def property_of(df: DataFrame, item: str, name: str, kind: T.DataType) -> Column:
    """A field as its column's type."""
    have = df.schema[item].dataType
    if name not in have.names:
        return F.lit(None).cast(kind)
    value, source = F.col(item)[name], have[name].dataType
    if isinstance(kind, T.StructType) and isinstance(source, T.MapType):
        return F.when(value.isNotNull() & (F.size(value) > 0), F.struct(*[F.element_at(value, f.name).cast(f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.StructType) and isinstance(source, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[(value[f.name].cast(f.dataType) if f.name in source.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.StringType) and isinstance(source, T.StructType | T.MapType | T.ArrayType):
        return F.to_json(value)
    if isinstance(kind, T.ArrayType) and isinstance(source, T.ArrayType) and isinstance(source.elementType, T.StructType):
        return F.transform(value, lambda x: F.to_json(x))
    return value.cast(kind)


def extract_nodes(docs: DataFrame, schema: GraphSchema, label: str, now: str, source_key: Column | None = None) -> DataFrame | None:
    """The nodes of a label, of each document and key the first: _key, _at and the node table's columns without id.
    None if the label lies nowhere."""
    n = schema.spec(label)
    columns = schema.node_columns(label)
    out: DataFrame | None = None
    for k, path in enumerate(schema.node_paths[label]):
        df = items_at(docs, schema, path)
        name, key = identity(df, "_item", n)
        source = source_key if source_key is not None else F.col("_key")
        made = {"name": name, "_original_name": name, "_dedup_key": key, "_created_at": F.lit(now), "_updated_at": F.lit(now), "alternate_names": F.array().cast("array<string>")}
        made |= {x.name: x.value(F.col("_item"), F.col("_root"), source) for x in n.extra}
        order = F.struct(F.col("_ord").alias("doc"), F.lit(schema.nodes.index(n)).alias("node"), F.lit(k).alias("path"), F.col("_item_place").alias("place"))
        one = df.select("_key", order.alias(AT), *[(made[f.name].cast(f.dataType) if f.name in made else property_of(df, "_item", f.name, f.dataType)).alias(f.name) for f in columns.fields if f.name != "id"])
        out = one if out is None else out.unionByName(one)
    if out is None:
        return None
    rest = [c for c in out.columns if c not in ("_key", "_dedup_key")]
    # the first of each document: a minimum that is taken before the shuffle too
    first = out.groupBy("_key", "_dedup_key").agg(F.min_by(F.struct(*rest), AT).alias("_row"))
    return first.select("_key", "_dedup_key", *[F.col("_row")[c].alias(c) for c in rest])


def extract_edges(docs: DataFrame, schema: GraphSchema, e: EdgeSpec) -> DataFrame | None:
    """_src, _dst and the edge's properties, for every pair of items that the chosen paths lead to. An item below
    another is paired with its own; items of two fields side by side all with each other."""
    paths = schema.edge_paths[e.key]
    if not paths:
        return None
    a, b = paths[0]
    source, target = schema.spec(e.from_class.__name__), schema.spec(e.to_class.__name__)
    df = items_at(docs, schema, a, "_from")
    below = not a or b.startswith(a + ".")
    above = bool(b) and a.startswith(b + ".")
    if below:
        inner = _Below(schema, a)
        df = items_at(df.withColumn("_whole", F.col("_root")).withColumn("_root", F.col("_from")), inner, b[len(a) + 1 :] if a else b, "_to")
    else:
        df = items_at(df, schema, b, "_to")
        if above:
            # the target holds the source: the same places on the way to the target
            df = df.filter(F.slice("_from_place", 1, F.size("_to_place")) == F.col("_to_place")) if any(x in b or b.startswith(x) for p in schema.places for x in p.lists) else df
    _, src = identity(df, "_from", source)
    _, dst = identity(df, "_to", target)
    fields = {f.name: f.dataType for f in schema.edge_columns(e).fields}
    props = [property_of(df, "_to", f, fields[name]).alias(name) for name, f in schema.edge_properties(e).items()]
    return df.select(node_id(source.label, src).alias("_src"), node_id(target.label, dst).alias("_dst"), *props)


class _Below:
    """A schema as seen from one of its items."""

    def __init__(self, schema: GraphSchema, prefix: str):
        self.schema, self.prefix = schema, prefix

    def place(self, path: str):
        whole = f"{self.prefix}.{path}" if self.prefix else path
        found = self.schema.place(whole)
        if found is None:
            return None
        return type(found)(path, found.kind, (path,) if found.is_list else ())


def field_documents(nodes: DataFrame, label: str, fields: tuple[str, ...]) -> DataFrame:
    """One row for each indexed field that holds text: content, node_type, field_name, primary_key, field_path."""
    entries = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("content")) for f in fields])
    rows = nodes.select(F.col("id").alias("primary_key"), F.explode(entries).alias("e")).filter(F.col("e.content").isNotNull() & (F.trim(F.col("e.content")) != ""))
    return rows.select(F.col("e.content").alias("content"), F.lit(label).alias("node_type"), F.col("e.field_name").alias("field_name"), "primary_key", F.concat(F.lit(label + "."), F.col("e.field_name")).alias("field_path"))


def own_fields(n: NodeSpec) -> list[str]:
    return [f for f in model_fields(n.node_class) if f not in RESERVED and element(model_fields(n.node_class)[f])[0] not in n.embedded]
