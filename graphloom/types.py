"""From annotations of model classes to Spark types, to DDL names and to names for people."""

from __future__ import annotations

import dataclasses
import enum
import types
import typing
from typing import Any, Union, get_args, get_origin, get_type_hints

from pyspark.sql import types as T


def is_model(kind: Any) -> bool:
    """A class with declared fields: a dataclass, or one that lists model_fields."""
    return isinstance(kind, type) and (dataclasses.is_dataclass(kind) or hasattr(kind, "model_fields")) and not issubclass(kind, enum.Enum)


def model_fields(kind: type) -> dict[str, Any]:
    """Field names and annotations, in order."""
    if hasattr(kind, "model_fields"):
        return {n: f.annotation for n, f in kind.model_fields.items()}
    hints = get_type_hints(kind)
    return {f.name: hints[f.name] for f in dataclasses.fields(kind)}


def unwrap(annotation: Any) -> tuple[Any, bool]:
    """(annotation without None, whether None was allowed). Of several members besides None all stay."""
    if get_origin(annotation) in (Union, types.UnionType):
        rest = [a for a in get_args(annotation) if a is not type(None)]
        optional = len(rest) < len(get_args(annotation))
        return (rest[0] if len(rest) == 1 else Union[tuple(rest)] if rest else None), optional
    return annotation, False


def element(annotation: Any) -> tuple[Any, bool]:
    """(class or type, whether it is a list of it), with None taken off on both levels."""
    inner, _ = unwrap(annotation)
    if get_origin(inner) is list:
        args = get_args(inner)
        return (unwrap(args[0])[0] if args else None), True
    return inner, False


def spark_type(annotation: Any, embedded: frozenset | set = frozenset(), strings_only: bool = False) -> T.DataType:
    """The column type of an annotation. Lists hold strings; classes named in embedded become structs of one level;
    whatever has no type of its own is a string. With strings_only booleans are strings too."""
    if annotation is None:
        return T.StringType()
    inner, _ = unwrap(annotation)
    if get_origin(inner) is list:
        return T.ArrayType(T.StringType())
    if is_model(inner) and inner in embedded:
        return struct_type(inner, strings_only)
    if inner is bool and not strings_only:
        return T.BooleanType()
    return {int: T.LongType(), float: T.DoubleType()}.get(inner, T.StringType())


def struct_type(model: type, strings_only: bool = False) -> T.StructType:
    return T.StructType([T.StructField(n, spark_type(a, frozenset(), strings_only)) for n, a in model_fields(model).items()])


def source_type(annotation: Any) -> T.DataType:
    """The full nested type in which a document of this annotation is read."""
    inner, _ = unwrap(annotation)
    origin = get_origin(inner)
    if origin is list:
        args = get_args(inner)
        return T.ArrayType(source_type(args[0]) if args else T.StringType())
    if origin is dict or inner is dict:
        return T.MapType(T.StringType(), T.StringType())
    if is_model(inner):
        return T.StructType([T.StructField(n, source_type(a)) for n, a in model_fields(inner).items()])
    return {int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType()}.get(inner, T.StringType())


def ddl_name(kind: T.DataType) -> str:
    """STRING, INT64, DOUBLE, T[], STRUCT(a T, ...) and so on."""
    if isinstance(kind, T.ArrayType):
        return ddl_name(kind.elementType) + "[]"
    if isinstance(kind, T.StructType):
        return "STRUCT(" + ", ".join(f"{f.name} {ddl_name(f.dataType)}" for f in kind.fields) + ")"
    if isinstance(kind, T.MapType):
        return f"MAP({ddl_name(kind.keyType)}, {ddl_name(kind.valueType)})"
    names = {T.StringType: "STRING", T.LongType: "INT64", T.IntegerType: "INT32", T.DoubleType: "DOUBLE", T.FloatType: "FLOAT", T.BooleanType: "BOOL", T.DateType: "DATE", T.TimestampType: "TIMESTAMP"}
    return names.get(type(kind), kind.simpleString().upper())


def ddl_of(annotation: Any, embedded: frozenset | set = frozenset()) -> str:
    """The DDL name of an annotation, booleans as STRING."""
    return ddl_name(spark_type(annotation, embedded, strings_only=True))


def human_name(annotation: Any) -> str:
    """string, int, float, boolean, T[], object, enum(X); a question mark where None is allowed."""
    inner, optional = unwrap(annotation)
    mark = "?" if optional else ""
    if get_origin(inner) is list:
        args = get_args(inner)
        return (human_name(args[0]).rstrip("?") if args else "any") + "[]" + mark
    if get_origin(inner) is dict or inner is dict:
        return "object" + mark
    if isinstance(inner, type) and issubclass(inner, enum.Enum):
        return f"enum({inner.__name__})" + mark
    if is_model(inner):
        return inner.__name__ + mark
    if get_origin(inner) in (Union, types.UnionType):
        return " | ".join(human_name(a) for a in get_args(inner)) + mark
    return {str: "string", int: "int", float: "float", bool: "boolean", None: "any", typing.Any: "any"}.get(inner, getattr(inner, "__name__", str(inner))) + mark


def embedded_field(parent: type, child: type) -> str | None:
    """The parent's field that holds the child: itself, optional, or in a list."""
    for name, annotation in model_fields(parent).items():
        if element(annotation)[0] is child:
            return name
    return None
