"""Ready computed structs for node tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import ExtraStruct


def text_struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def filled(value: Column) -> Column:
    return F.when(value != "", value)


def file_metadata(metadata: str | None = None) -> ExtraStruct:
    """file_metadata(source): where a document came from, which is the source key, else the "source" of the item's field
    ``metadata``; null if neither says."""

    def value(item: Column, root: Column, key: Column) -> Column:
        source = F.coalesce(filled(key), *([filled(item[metadata]["source"])] if metadata else []))
        return F.when(source.isNotNull(), F.struct(source.alias("source")))

    return ExtraStruct("file_metadata", text_struct("source"), value)


def win_loss(at: str = "win_loss") -> ExtraStruct:
    """win_loss(result, reason) from the root's field ``at``; null if there is no result."""

    def value(item: Column, root: Column, key: Column) -> Column:
        result, reason = filled(root[at]["result"]), filled(root[at]["reason"])
        return F.when(result.isNotNull(), F.struct(result.alias("result"), reason.alias("reason")))

    return ExtraStruct("win_loss", text_struct("result", "reason"), value)
