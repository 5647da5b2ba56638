"""Idempotent upserts of nodes, set-wise: one aggregation by key over what is stored and what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .extract import AT, node_id

#: Columns that an update never takes from a later row.
KEPT = ("id", "name", "_original_name", "_created_at", "_dedup_key", "alternate_names")


def holds_something(column: Column, kind: T.DataType) -> Column:
    """Whether a value may overwrite: not null, not blank, not an empty list or map. Zero and false may."""
    if isinstance(kind, T.StringType):
        return column.isNotNull() & (F.trim(column) != "")
    if isinstance(kind, T.ArrayType | T.MapType):
        return column.isNotNull() & (F.size(column) > 0)
    return column.isNotNull()


def merge_nodes(stored: DataFrame | None, new: DataFrame, label: str, key: str = "_dedup_key") -> DataFrame:
    """Stored nodes with new ones merged in.

    new has _at, an order; its rows of one key are taken in that order. The first row of a key creates the node as it
    is; each later one overwrites a property only with a value that holds something, sets _updated_at, and adds its
    name to alternate_names if it differs from the first. Stored rows come before all new ones.
    """
    order = new.schema[AT].dataType
    columns = [c for c in new.columns if c not in (AT, "_key", "id")]
    both = new.select(F.lit(1).alias("_new"), AT, *columns)
    if stored is not None:
        both = stored.select(F.lit(0).alias("_new"), F.lit(None).cast(order).alias(AT), *[(F.col(c).cast(new.schema[c].dataType) if c in stored.columns else F.lit(None).cast(new.schema[c].dataType)).alias(c) for c in columns]).unionByName(both)
    both = both.withColumn("_o", F.struct("_new", AT))
    kinds = {f.name: f.dataType for f in both.schema.fields}
    aggregates = []
    for c in columns:
        if c == key:
            continue
        if c == "_created_at":
            aggregates.append(F.min(c).alias(c))
        elif c == "_updated_at":
            aggregates.append(F.max(c).alias(c))
        elif c == "alternate_names":
            aggregates.append(F.min_by(c, "_o").alias("_earlier"))
        elif c in KEPT:
            aggregates.append(F.min_by(c, "_o").alias(c))
        else:
            aggregates.append(F.coalesce(F.max_by(c, F.when(holds_something(F.col(c), kinds[c]), F.col("_o"))), F.min_by(c, "_o")).alias(c))
    main = both.groupBy(key).agg(*aggregates)
    # names in order of first sight; a key's distinct names are few however often it is seen
    seen = both.groupBy(key, "name").agg(F.min("_o").alias("_first"))
    names = seen.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_first", "name"))).alias("_names"))
    others = F.transform("_names", lambda x: x["name"])
    alternate = F.array_distinct(F.concat(F.coalesce("_earlier", F.array().cast("array<string>")), others))
    out = main.join(names, key).withColumn("alternate_names", F.filter(alternate, lambda x: x.isNotNull() & (x != F.col("name"))))
    found = node_id(label, F.col(key)) if key == "_dedup_key" else node_id(label, F.coalesce("_dedup_key", F.col(key)))
    return out.withColumn("id", found).select("id", *columns)


def merge_statistics(stored: DataFrame | None, new: DataFrame, key: str = "_dedup_key") -> DataFrame:
    """created, matched, total: how many rows of new made a node and how many met one."""
    keys = new.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if stored is None:
        total = F.coalesce(F.sum("n"), F.lit(0))
        return keys.agg(F.count(F.lit(1)).alias("created"), (total - F.count(F.lit(1))).alias("matched"), total.alias("total"))
    met = keys.join(stored.select(key, F.lit(1).alias("_old")).distinct(), key, "left")
    created = F.coalesce(F.sum(F.when(F.col("_old").isNull(), 1).otherwise(0)), F.lit(0))
    return met.agg(created.alias("created"), (F.coalesce(F.sum("n"), F.lit(0)) - created).alias("matched"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def resolved_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges whose ends exist, edges that lack one)."""
    ends_a, ends_b = sources.select(F.col("id").alias("_src")), targets.select(F.col("id").alias("_dst"))
    whole = edges.join(ends_a, "_src", "left_semi").join(ends_b, "_dst", "left_semi")
    lacking = edges.join(ends_a, "_src", "left_anti").unionByName(edges.join(ends_a, "_src", "left_semi").join(ends_b, "_dst", "left_anti"))
    return whole, lacking


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the last row by order; rows without a key go."""
    rest = [c for c in rows.columns if c != key]
    last = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return last.select(key, *[F.col("_row")[c].alias(c) for c in rest]).select(*rows.columns)


def keep_first(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of each key the first row by order."""
    rest = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return first.select(*key, *[F.col("_row")[c].alias(c) for c in rest]).select(*rows.columns)
