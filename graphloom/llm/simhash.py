"""SimHash near-duplicates by anchor-point covering.

Two fingerprints that differ in at most ``distance`` of 64 bits differ in at most distance // blocks bits of at least one
of ``blocks`` blocks. In each block a covering code supplies the anchors: its bits are cut into parts of seven, each
with the Hamming (7, 4) code, of which every word is within one bit (what is left over is kept bit by bit). A
fingerprint lives at the one anchor that covers it, and visits every anchor within covering radius plus the block's
threshold, where its partners must live. Per anchor, visitors are compared with those who live there.

Only distinct fingerprints are compared; copies share theirs. Anchors with many fingerprints are dealt out as
(part of those who live there) x (part of the visitors). What leaves a task is a spanning forest of the links it
found, so a dense group costs as many rows as it has members. Components are then contracted in rounds of joins and
minima; nothing is collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import each_text, quoted, unused, written

BITS = 64
#: What moving a fingerprint to one more anchor costs, in comparisons of two fingerprints.
MOVE = 1000
#: The positions of the Hamming (7, 4) code's checks; a word belongs to the code if each has even parity.
HAMMING_CHECKS = (0b1010101, 0b1100110, 0b1111000)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64 bits of a whole text; 0 for null or no words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only \x20 and \x09-\x0D part words
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), parts), dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, text_hash (of the text, to tell rows of one doc_id apart) and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle, seed) for t in each_text(batch.column("text"))]
            signed = np.array(fps, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(signed)], names=["doc_id", "text_hash", "fp"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


@lru_cache
def part_table(width: int) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """For a part of one or seven bits: each word's covering code word, and for each word all code words with the
    excess of their distance over the covering radius."""
    words = range(1 << width)
    code = [w for w in words if width < 7 or all((w & c).bit_count() % 2 == 0 for c in HAMMING_CHECKS)]
    radius = 0 if width < 7 else 1
    lives = np.array([min(code, key=lambda c, w=w: (w ^ c).bit_count()) for w in words], dtype=np.int64)
    near = [[(c, max(0, (w ^ c).bit_count() - radius)) for c in code] for w in words]
    return lives, near


def block_parts(blocks: int) -> list[list[tuple[int, int]]]:
    """For each block its parts as (first bit, width)."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    out = []
    for a, b in zip(edges, edges[1:]):
        full = a + (b - a) // 7 * 7
        out.append([(x, 7) for x in range(a, full, 7)] + [(x, 1) for x in range(full, b)])
    return out


def anchors_at(fps: np.ndarray, blocks: int, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (place in fps, anchor, lives there) of unsigned fingerprints: for each block its home and the anchors it visits."""
    threshold = distance // blocks
    places, anchors, home = [], [], []
    for k, parts in enumerate(block_parts(blocks)):
        at = np.arange(len(fps))
        anchor = np.zeros(len(fps), dtype=np.int64)
        spent = np.zeros(len(fps), dtype=np.int64)
        own = np.zeros(len(fps), dtype=np.int64)
        for first, width in parts:
            lives, near = part_table(width)
            word = ((fps >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)
            own = (own << width) | lives[word]
            # each row goes on with every code word that its budget allows
            flat = [(w, c, e) for w, some in enumerate(near) for c, e in some if e <= threshold]
            counts = np.bincount([w for w, _, _ in flat], minlength=1 << width)
            starts = np.concatenate([[0], np.cumsum(counts)])
            code, excess = (np.array(x, dtype=np.int64) for x in zip(*((c, e) for _, c, e in flat)))
            w = word[at]
            times = counts[w]
            rows = np.repeat(np.arange(len(at)), times)
            pick = starts[w][rows] + np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
            total = spent[rows] + excess[pick]
            ok = total <= threshold
            at, anchor, spent = at[rows][ok], (anchor[rows][ok] << width) | code[pick][ok], total[ok]
        tag = np.int64(k) << np.int64(56)
        places.append(at)
        anchors.append(anchor | tag)
        home.append(own[at] == anchor)
    return tuple(np.concatenate(x) for x in (places, anchors, home))


def forest(nodes: np.ndarray, lives: np.ndarray, visits: np.ndarray, distance: int) -> np.ndarray:
    """For each node (distinct and ascending, signed) the place of the smallest node that the links between lives and
    visits (unsigned) connect it with."""
    parent = np.arange(len(nodes))
    li, vi = np.searchsorted(nodes, lives.view(np.int64)), np.searchsorted(nodes, visits.view(np.int64))
    step = max(1, 1_000_000 // max(1, len(visits)))
    for a in range(0, len(lives), step):
        i, j = np.nonzero(np.bitwise_count(lives[a : a + step, None] ^ visits[None, :]) <= distance)
        x, y = li[a + i], vi[j]
        while True:
            p, q = parent[x], parent[y]
            differ = p != q
            if not differ.any():
                break
            x, y = x[differ], y[differ]
            p, q = p[differ], q[differ]
            np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
            while (parent != (up := parent[parent])).any():
                parent = up
    return parent


def links(distinct: DataFrame, distance: int = 4, blocks: int = 3, most_home: int = 4096, most_visit: int = 32768) -> DataFrame:
    """Pairs (u, v), u > v, of a forest that connects whatever fingerprints (column fp) within distance connect."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for a in range(0, len(fps), 4096):
                part = fps[a : a + 4096]
                at, anchor, home = anchors_at(part, blocks, distance)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(home.astype(np.int32)), pa.array(part[at].view(np.int64))], names=["anchor", "home", "fp"])

    rows = distinct.select("fp").mapInArrow(deal, "anchor long, home int, fp long")
    sizes = rows.groupBy("anchor").agg(F.sum("home").alias("n_home"), F.count("*").alias("n_visit"))
    crowded = sizes.filter((F.col("n_home") > most_home) | (F.col("n_visit") > most_visit))
    crowded = crowded.select("anchor", F.ceil(F.col("n_home") / most_home).alias("hs"), F.ceil(F.col("n_visit") / most_visit).alias("vs"))
    rows = rows.join(crowded, "anchor", "left")
    hs, vs = F.greatest(F.coalesce("hs", F.lit(1)), F.lit(1)), F.coalesce("vs", F.lit(1))
    own_h, own_v = F.pmod(F.xxhash64("fp"), hs), F.pmod(F.xxhash64("fp", F.lit(1)), vs)
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # who lives at an anchor also visits it
    as_home = rows.filter("home = 1").select("anchor", own_h.alias("h"), F.explode(every(vs)).alias("v"), F.lit(1).alias("home"), "fp")
    as_visit = rows.select("anchor", F.explode(every(hs)).alias("h"), own_v.alias("v"), F.lit(0).alias("home"), "fp")
    dealt = as_home.unionByName(as_visit).repartition("anchor", "h", "v").sortWithinPartitions("anchor", "h", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def settle(home: np.ndarray, fp: np.ndarray) -> None:
            lives, visits = fp[home == 1], fp[home == 0]
            if len(lives) and len(visits) > 1:
                nodes = np.unique(fp.view(np.int64))
                parent = forest(nodes, lives, visits, distance)
                moved = parent != np.arange(len(nodes))
                if moved.any():
                    found.append((nodes[moved], nodes[parent[moved]]))

        rest: np.ndarray | None = None
        kept: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("anchor", "h", "v")])
            home, fp = batch.column("home").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if rest is not None:
                key = np.concatenate([kept[0], key], axis=1)
                home, fp = np.concatenate([kept[1], home]), np.concatenate([kept[2], fp])
            edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            cuts = [0, *edges.tolist()]
            for a, b in zip(cuts, cuts[1:]):
                settle(home[a:b], fp[a:b])
            rest = key[:, cuts[-1] :]
            kept = [rest, home[cuts[-1] :], fp[cuts[-1] :]]
            if found:
                u, v = (np.concatenate(x) for x in zip(*found))
                found.clear()
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        if rest is not None:
            settle(kept[1], kept[2])
        if found:
            u, v = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return dealt.mapInArrow(compare, "u long, v long").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (u, v): nodes have one label exactly if they are connected.

    Rounds of contraction: each node takes its smallest neighbour, or itself, as label, and edges go on between labels
    until none is left. Odd rounds compare by a hash, which settles long chains whatever their order. Each round's
    tables are written to the shared folder; only the number of edges left comes to the driver."""
    edges = written(edges.select("u", "v").filter("u <> v"), "edges")
    labels: DataFrame | None = None
    step = 0
    while not edges.isEmpty():
        hashed = step % 2 == 1

        def ranked(c: str, hashed: bool = hashed, step: int = step) -> Column:
            return F.struct((F.xxhash64(c, F.lit(step)) if hashed else F.lit(0)).alias("k"), F.col(c).alias("x"))

        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(ranked("v")).alias("m"))
        mapped = written(least.select("u", F.least("m", ranked("u"))["x"].alias("to")), "labels")
        labels = mapped.select(F.col("u").alias("node"), F.col("to").alias("label")) if labels is None else (
            labels.join(mapped, F.col("label") == F.col("u"), "left").select("node", F.coalesce("to", "label").alias("label"))
        )
        labels = written(labels, "components")
        over = edges.join(mapped, "u").select(F.col("to").alias("a"), "v").join(mapped.withColumnRenamed("u", "v"), "v")
        edges = written(over.filter("a <> to").select(F.greatest("a", "to").alias("u"), F.least("a", "to").alias("v")).distinct(), "edges")
        step += 1
    return labels if labels is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def cheapest_blocks(n: int, distance: int = 4, most: int = 4) -> int:
    """The number of blocks whose anchors cost least for n fingerprints that spread evenly: a fingerprint moved to an
    anchor counts as much as MOVE comparisons. Fewer blocks have more anchors, which hold less and are visited more."""
    costs = {}
    for blocks in range(1, most + 1):
        visits, compared = 0.0, 0.0
        for parts in block_parts(blocks):
            # visits of one fingerprint: code words by excess, part by part
            by_excess = np.eye(1, distance // blocks + 1)[0]
            for _, width in parts:
                near = part_table(width)[1]
                share = np.bincount([min(e, distance + 1) for some in near for _, e in some], minlength=distance + 2) / len(near)
                by_excess = np.convolve(by_excess, share)[: distance // blocks + 1]
            visits += by_excess.sum()
            compared += by_excess.sum() * n / math.prod(16 if width == 7 else 2 for _, width in parts)
        costs[blocks] = n * (MOVE * visits + compared)
    return min(costs, key=costs.get)


def components_of(prints: DataFrame, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """(fp, label) of every distinct fingerprint of prints; linked fingerprints share their label. blocks: how many
    blocks of bits have anchors of their own; by default what costs least for the number of fingerprints there are. The
    links, and so the labels' groups, are the same for any number."""
    distinct = written(prints.select("fp").distinct(), "fps")
    blocks = blocks or cheapest_blocks(max(1, distinct.count()), distance)
    labels = connected_components(links(distinct, distance, blocks))
    return distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42, blocks: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id, the smallest doc_id that links reach.

    docs needs doc_id and text; other columns are ignored. A null or wordless text has fingerprint zero and is linked
    like any other; rows of one doc_id, or without one, are separate documents; a component without any doc_id has a
    null component_id; an empty table gives no rows. blocks: as for components_of."""
    prints = written(fingerprints(docs, shingle, seed), "prints")
    comps = components_of(prints, distance, blocks)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    per_fp = comps.join(least, "fp")
    ids = per_fp.groupBy("label").agg(F.min("least").alias("component_id"))
    per_fp = written(per_fp.join(ids, "label").select("fp", "component_id"), "fps")
    return prints.join(per_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42, blocks: int | None = None) -> DataFrame:
    """docs with one row of each component: the smallest doc_id's (rows without one last), of these the smallest text hash's.

    docs needs doc_id and text and keeps all its columns, whatever their names. Null and wordless texts have fingerprint
    zero, so that one of them stays; of rows that are repeated whole one stays; an empty table gives no rows."""
    prints = written(fingerprints(docs, shingle, seed), "prints")
    comps = components_of(prints, distance, blocks)
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    per_fp = prints.groupBy("fp").agg(F.min(rank).alias("first"))
    keep = comps.join(per_fp, "fp").groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.d").alias("_d"), F.col("first.h").alias("_h")).distinct()
    th, n = unused(docs.columns, "_th"), unused(docs.columns, "_n")
    rows = docs.withColumn(th, F.xxhash64(F.col("text").cast("string")))
    met = rows.join(keep, rows[th].eqNullSafe(keep["_h"]) & rows["doc_id"].cast("long").eqNullSafe(keep["_d"]), "left_semi")
    one = Window.partitionBy(th, "doc_id").orderBy(F.lit(0))
    return met.withColumn(n, F.row_number().over(one)).filter(F.col(n) == 1).select(*quoted(docs.columns))
