"""Functions of the query language, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """From a place counted from 0."""
    return F.substr(s, (start + 1).cast("int"), length.cast("int")) if length is not None else F.substr(s, (start + 1).cast("int"))


def split(s: Column, delimiter: Column) -> Column:
    """By a plain delimiter, not a pattern."""
    return F.split(s, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")))


def to_integer(x: Column) -> Column:
    """Whole numbers exactly, others cut to whole; null for what is no number or too large."""
    return F.coalesce(x.try_cast("bigint"), x.try_cast("double").try_cast("bigint"))


def to_date(s: Column, *_: Column) -> Column:
    return F.expr("try_cast(null as date)") if s is None else s.try_cast("date")


SCALARS: dict[str, Callable[..., Column]] = {
    "size": lambda x: F.size(x), "head": lambda x: F.get(x, F.lit(0)), "last": lambda x: F.get(x, F.size(x) - 1), "tail": lambda x: F.slice(x, F.lit(2), F.greatest(F.lit(0), F.size(x) - 1)),
    "reverse": F.reverse, "range": lambda a, b, s=None: F.sequence(a, b) if s is None else F.sequence(a, b, s),
    "substring": substring, "left": lambda s, n: F.left(s, n), "right": lambda s, n: F.right(s, n), "split": split, "replace": lambda s, a, b: F.replace(s, a, b),
    "tolower": F.lower, "lower": F.lower, "toupper": F.upper, "upper": F.upper, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "char_length": F.length,
    "date": to_date, "timestamp": lambda s: s.try_cast("timestamp"), "datetime": lambda s: s.try_cast("timestamp"), "year": F.year, "month": F.month, "day": F.dayofmonth,
    "coalesce": F.coalesce, "tostring": lambda x: x.cast("string"), "tointeger": to_integer, "tofloat": lambda x: x.try_cast("double"), "toboolean": lambda x: x.try_cast("boolean"),
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": lambda x, n=None: F.round(x) if n is None else F.round(x, n), "sqrt": F.sqrt, "sign": F.signum, "exp": F.exp, "log": F.log,
    "length": lambda p: p.getField("length"), "nodes": lambda p: p.getField("nodes"), "relationships": lambda p: p.getField("types"), "rels": lambda p: p.getField("types"),
    "labels": lambda n: F.array(n.getField("_label")), "label": lambda n: n.getField("_label"), "type": lambda r: r.getField("_label"), "id": lambda n: n.getField("_id"), "properties": lambda x: x,
    "md5": F.md5, "sha256": lambda s: F.sha2(s, 256), "array_sort": lambda x: F.array_sort(x), "list_sort": lambda x: F.array_sort(x), "array_join": lambda x, d: F.call_function("array_join", x.cast("array<string>"), d),
}


def _of(plain: Callable[[Column], Column], distinct: Callable[[Column], Column] | None = None) -> Callable[[Column, bool], Column]:
    return lambda x, d: (distinct or plain)(x) if d else plain(x)


def deviation_of_distinct(x: Column, sample: bool) -> Column:
    values = F.collect_set(x.cast("double"))
    n = F.size(values)
    middle = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    squares = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - middle) * (v - middle))
    return F.when(n > (1 if sample else 0), F.sqrt(squares / (n - (1 if sample else 0))))


AGGREGATES: dict[str, Callable[[Column, bool], Column]] = {
    "count": _of(F.count, F.count_distinct), "sum": _of(F.sum, F.sum_distinct), "avg": _of(F.avg, lambda x: F.try_divide(F.sum_distinct(x.cast("double")), F.count_distinct(x))), "min": _of(F.min), "max": _of(F.max),
    "collect": _of(F.collect_list, F.collect_set), "stdev": _of(F.stddev_samp, lambda x: deviation_of_distinct(x, True)), "stdevp": _of(F.stddev_pop, lambda x: deviation_of_distinct(x, False)),
}


def sql_type_rank(name: str) -> str:
    """"text" for functions that give texts or lists."""
    return "text" if name in {"substring", "left", "right", "replace", "tolower", "lower", "toupper", "upper", "trim", "ltrim", "rtrim", "tostring", "split", "labels", "nodes", "tail", "range", "collect", "label", "type"} else ""
