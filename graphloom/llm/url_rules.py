"""URL filters by a sort-merge range join.

A host's labels in reverse, each with a dot behind it, make its key ("www.example.com": "com.example.www."), so that a
rule's host and all its subdomains are the keys from the rule's own up to, not including, the same with a slash for the
last dot: an interval. Intervals of hosts nest or are disjoint. Urls and rules are dealt out by range of key; each task
reads both in key order and keeps a stack of the rules whose interval is open, innermost last. A url asks the stack.

Ranges are cut at keys of a sample, with a hash of the url behind the key, so that a host with a third of all rows lies
in many of them; a rule is sent to every range that its interval meets.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashes, n_partitions


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """What follows the first "://" up to a slash, question mark or hash sign, with A-Z in lower case; else empty."""
    rest = F.substring_index(F.substring_index(F.substring_index(after_scheme(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark or hash sign."""
    rest = after_scheme(url)
    bare = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    at = F.instr(bare, "/")
    return F.when(at > 0, bare.substr(at, F.length(bare))).otherwise("")


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def rule_key(host: str) -> str:
    return "".join(label + "." for label in reversed(host.split(".")))


class Sweep:
    """Goes through keys in ascending order with the rules whose intervals begin at or before them."""

    def __init__(self) -> None:
        self.open: list[tuple[str, list[Rule]]] = []  # key prefix, rules of that host

    def close(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def add(self, key: str, rule: Rule) -> None:
        self.close(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, []))
        self.open[-1][1].append(rule)

    def find(self, key: str, path: str) -> Rule | None:
        """The longest rule that fits; of equally long ones the one of the longer host."""
        self.close(key)
        best = None
        for _, rules in reversed(self.open):
            for rule in rules:
                if path.startswith(rule.path) and (best is None or len(rule.text) > len(best.text)):
                    best = rule
        return best


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES, default: str = "allow", sample: int = 20_000) -> DataFrame:
    """page_id, host, path, rule (host and path of the longest rule that fits, else null), verdict (the rule's, else default).

    pages needs page_id and url; other columns are ignored. A rule fits its host and all subdomains where the path
    starts with the rule's. A null url, or one without "://", has an empty host and path, which only a rule for the
    empty host could fit; repeated rows give a row each; an empty table gives none. rules is a tuple or a DataFrame of
    verdict, host and path, as large as may be. Of the keys ``sample`` at most come to the driver, to cut the ranges."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    # where a row was read is part of its tie, so that rows repeated whole lie in many ranges too
    rows = rows.withColumn("key", key_of(F.col("host"))).withColumn("tie", F.xxhash64("page_id", "path", F.spark_partition_id()))
    ranges = 4 * n_partitions(spark)
    drawn = least_hashes(rows.select("key", "tie", F.xxhash64("key", "tie").alias("h")), "h", pages.count(), sample).collect()
    keys = sorted((r["key"].encode(), r["tie"]) for r in drawn)
    cuts = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    cut_keys = [k for k, _ in cuts]

    def range_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect.bisect_right(cuts, (k.encode(), t)) for k, t in zip(batch.column("key").to_pylist(), batch.column("tie").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=[*batch.schema.names, "range"])

    def ranges_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for verdict, host, path in zip(*(batch.column(c).to_pylist() for c in ("verdict", "host", "path"))):
                key = rule_key(host)
                first, last = bisect.bisect_left(cut_keys, key.encode()), bisect.bisect_left(cut_keys, key[:-1].encode() + b"/")
                out += [(key, verdict, host, path, r) for r in range(first, last + 1)]
            kinds = (pa.string(),) * 4 + (pa.int32(),)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, kinds)], names=["key", "verdict", "host", "path", "range"])

    dealt = rows.mapInArrow(range_of, "page_id long, host string, path string, key string, tie long, range int")
    sent = rules.select("verdict", F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path")).mapInArrow(ranges_met, "key string, verdict string, host string, path string, range int")
    both = dealt.withColumn("verdict", F.lit(None).cast("string")).unionByName(sent, allowMissingColumns=True)
    both = both.repartition("range").sortWithinPartitions("range", "key", F.col("verdict").isNull(), "path")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = None, Sweep()
        for batch in batches:
            out = []
            for page_id, host, path, key, verdict, at in zip(*(batch.column(c).to_pylist() for c in ("page_id", "host", "path", "key", "verdict", "range"))):
                if at != now:
                    now, stack = at, Sweep()
                if verdict is not None:
                    stack.add(key, Rule(verdict, host, path))
                else:
                    rule = stack.find(key, path)
                    out.append((page_id, host, path, rule and rule.text, rule.verdict if rule else default))
            kinds = (pa.int64(),) + (pa.string(),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, kinds)], names=["page_id", "host", "path", "rule", "verdict"])

    return both.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")
