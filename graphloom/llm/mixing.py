"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots of equal size in words. Slot n gets the point frac((n + 1/2) / golden ratio), which the
cumulative target weights map to a source; the points spread so evenly that any stretch of slots holds every source
close to its weight. A slot's rank among its source's slots says which block of that source it takes: a source's
documents, in an order shuffled by hash, form a stream of words, repeated as often as needed, and block r is the r-th
piece of that stream. Each source's last block is cut so that its words are its target, rounded; blocks that the
schedule lacks to reach it (whole slots can miss a target of about a block) join slots spread over the mix. A document's
share is what these blocks cover of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, unused, written

GOLDEN = (math.sqrt(5) - 1) / 2
CELLS = 1024


def word_count(text: Column) -> Column:
    """Number of runs of characters other than \\x20 and \\x09-\\x0D; null: 0."""
    parts = F.size(F.split(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), " +"))
    return F.when(text.isNull() | (F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")) == ""), 0).otherwise(parts).cast("long")


def water_fill(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Targets that share sum(sizes) by weight, none above most times its size; the excess is shared anew by weight."""
    total = float(sum(sizes))
    targets = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    rest = total
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / weight >= most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = rest * weights[i] / weight
            break
        for i in over:
            targets[i] = float(most * sizes[i])
        rest -= sum(targets[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def whole_targets(targets: list[float], sizes: list[int], most: int) -> list[int]:
    """Targets in whole words with the same sum, each less than a word away: the largest remainders are rounded up."""
    floors = [min(most * n, math.floor(t + 1e-6)) for t, n in zip(targets, sizes)]
    rest = round(sum(targets)) - sum(floors)
    for i in sorted((i for i, n in enumerate(sizes) if floors[i] < most * n), key=lambda i: floors[i] - targets[i])[: max(0, rest)]:
        floors[i] += 1
    return floors


def prefix_by_bucket(rows: DataFrame, key: list[str], bucket: str, order: list[Column], value: str, name: str) -> DataFrame:
    """rows with name: the sum of value over the rows of the same key before this one, by (bucket, order). The buckets'
    sums come first, so that only a bucket's rows meet in one task."""
    before = Window.partitionBy(*key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(*key, bucket).agg(F.sum(value).alias("_s")).select(*key, bucket, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return local.join(bases, [*key, bucket]).withColumn(name, F.col("_base") + F.col("_local")).drop("_base", "_local")


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most_repeats: int = 3, seed: int = 17, least_slots: int = 65_536, most_block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). documents: source number s, place ``at`` in the source's stream of words, doc_id, source,
    row_hash, size, source_size, target. pieces: slot, s, rank, doc_id, at, words: how many words of which document each
    scheduled block takes.

    docs needs doc_id, text and source. Sources by code point, null last, get the weights in turn; their targets share
    the whole size, none above most_repeats times its source. A block holds total / least_slots words, from 1 to
    most_block. The driver gets one row per source, to share the targets out."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("row_hash"))
    rows = written(rows, "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("m")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["n"] for r in found]
    total = sum(sizes)
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(found))], most_repeats)
    block = max(1, min(most_block, total // least_slots))
    slots = total // block + (1 if total % block else 0)

    wholes = whole_targets(targets, sizes, most_repeats)
    per_source = spark.createDataFrame([(i, r["source"], n, t, w, max(1, -(-r["m"] // 5000))) for i, (r, n, t, w) in enumerate(zip(found, sizes, targets, wholes))], "s int, source string, source_size long, target double, whole long, buckets int")
    listed = rows.join(per_source, rows["source"].eqNullSafe(per_source["source"])).drop(per_source["source"])

    # a source's stream of words: documents in hash order; the bucket is the hash's leading part
    order = F.xxhash64("doc_id", "row_hash", F.lit(seed))
    placed = listed.withColumn("o", order).withColumn("bucket", F.floor((F.shiftrightunsigned("o", 33) / F.lit(float(1 << 31))) * F.col("buckets")).cast("int"))
    placed = prefix_by_bucket(placed, ["s"], "bucket", [F.col("o"), F.col("doc_id"), F.col("row_hash")], "size", "at")

    # the schedule: each slot's source by its point, its rank among that source's slots, and so its block
    shares, share = [], 0.0
    last = max((i for i, t in enumerate(targets) if t > 0), default=0)
    for i, t in enumerate(targets):
        before, share = share, share + (t / total if total else 0.0)
        if t > 0:  # the last source takes what rounding leaves
            shares.append((i, before, share if i < last else 2.0))
    # sources and points meet in equal cells of the unit interval
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1))
    held = spark.createDataFrame(shares, "s int, low double, high double")
    held = held.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    n = F.col("slot")
    point = F.pmod((n + F.lit(0.5)) * F.lit(GOLDEN), F.lit(1.0))
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("cell", cell(F.col("point")))
    schedule = points.join(held, "cell").filter("low <= point and point < high").withColumn("stretch", (n / F.lit(8192)).cast("long"))
    ranked = prefix_by_bucket(schedule.withColumn("one", F.lit(1).cast("long")).select("slot", "s", "stretch", "one"), ["s"], "stretch", [F.col("slot")], "one", "rank").select("slot", "s", "rank")
    # blocks that a source's target needs beyond its slots: each shares the slot at its even place
    had = ranked.groupBy("s").agg((F.max("rank") + 1).alias("had"))
    lacking = per_source.select("s", F.ceil(F.col("whole") / block).cast("long").alias("needs")).join(had, "s", "left").withColumn("had", F.coalesce("had", F.lit(0).cast("long"))).filter("needs > had")
    lacking = lacking.withColumn("rank", F.explode(F.sequence("had", F.col("needs") - 1)))
    ranked = ranked.unionByName(lacking.select(F.floor((F.col("rank") + 0.5) / F.col("needs") * slots).cast("long").alias("slot"), "s", "rank"))

    # blocks by rank: the pass of each repeat of a document meets the blocks that overlap it
    passes = F.explode(F.sequence(F.lit(0), F.lit(most_repeats - 1))).alias("pass")
    repeats = placed.filter("size > 0").select("s", "doc_id", "size", "at", "source_size", "whole", passes)
    # a source's blocks end at its whole target
    begin = F.col("pass") * F.col("source_size") + F.col("at")
    repeats = repeats.withColumn("begin", begin).withColumn("end", F.least(F.col("begin") + F.col("size"), "whole")).filter("begin < whole")
    overlaps = repeats.withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / block).cast("long"), F.floor((F.col("end") - 1) / block).cast("long"))))
    words = F.least("end", (F.col("rank") + 1) * block) - F.greatest("begin", F.col("rank") * block)
    pieces = ranked.join(overlaps.select("s", "rank", "doc_id", "at", words.cast("long").alias("words")), ["s", "rank"])
    return placed.select("s", "at", "doc_id", "source", "row_hash", "size", "source_size", "target"), pieces


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most_repeats: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, row_hash: how many words of each document the mix takes.

    Other columns are ignored; a null or wordless text has size 0 and gives 0 words; a null source is a source, the last;
    repeated rows are documents of their own; an empty table gives no rows. No document is taken more than most_repeats
    times."""
    documents, pieces = mix_plan(docs, weights, most_repeats, seed)
    taken = pieces.groupBy("s", "at").agg(F.sum("words").alias("taken"))
    full = documents.filter("size > 0").join(taken, ["s", "at"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    every = full.unionByName(documents.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return every.select("doc_id", "size", "source_size", "target", "taken", "source", "row_hash")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most_repeats: int = 3, seed: int = 17) -> DataFrame:
    """The mix as whole documents, with all columns of docs: each as often as what the mix takes of it, rounded to whole
    repeats (0 to most_repeats)."""
    share = mix_documents(docs, weights, most_repeats, seed).filter("taken > 0")
    share = share.groupBy("doc_id", "source", "row_hash").agg(F.round(F.avg(F.col("taken") / F.col("size"))).cast("int").alias("_times")).filter("_times > 0")
    d, src, h, times, row, k = (unused(docs.columns, c) for c in ("_d", "_s", "_h", "_times", "_row", "_k"))
    share = share.select(F.col("doc_id").alias(d), F.col("source").alias(src), F.col("row_hash").alias(h), F.col("_times").alias(times))
    rows = docs.withColumn(row, F.xxhash64(F.col("text").cast("string")))
    same = (rows[row] == share[h]) & rows["doc_id"].cast("long").eqNullSafe(share[d]) & rows["source"].cast("string").eqNullSafe(share[src])
    return rows.join(share, same).withColumn(k, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*quoted(docs.columns))
