"""Approximate nearest neighbours: score-aware (anisotropic) product quantisation with four-bit codes.

The smallest Euclidean distance is the largest inner product of (query, 1) with (vector, -|vector|^2 / 2). The second
part is kept exactly; the vector is quantised, two components to a subspace with sixteen centres each. Codes and
centres minimise a loss that weighs the part of the residual parallel to the vector ``parallel`` times as much as the
rest, since that part is what moves the largest inner products. Two codes share a byte; a query becomes one table of
256 sums per byte, and a scan adds a table entry per byte of code. How far each vector lies from its code is kept too:
by the triangle inequality a row's distance is at least its code's less that gap. The best codes are ranked by their
exact distance in double precision, and so is every other row whose bound does not exceed the tenth distance known by
then; no number limits how many these are, so dense groups, whose codes are nearly equal, lose nothing.

Rows are dealt out by coarse cell, and a cell in parts of bounded size. A query goes to the cells that can hold one of
its nearest: a cell's rows lie at least the distance to its centre less its radius away, and the sample's k nearest
rows bound how far they need to be looked for. With ``recall`` it goes only to so many of the nearest cells as brought
that share of nearest rows within the sample. A task holds one part's rows and reads queries past them, however many.

Centres of codes and cells are fitted on a bounded sample; every vector is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import least_hashes, record_batch, written

CENTRES = 16


@dataclass
class Codebook:
    centres: np.ndarray  # subspaces x 16 x 2
    parallel: float
    dim: int

    def padded(self, x: np.ndarray) -> np.ndarray:
        """Vectors as rows x subspaces x 2, with zeros behind."""
        wide = np.zeros((len(x), 2 * len(self.centres)), dtype=np.float32)
        wide[:, : self.dim] = x
        return wide.reshape(len(x), len(self.centres), 2)

    def encode(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes, rows x subspaces, by coordinate descent on the score-aware loss."""
        parts = self.padded(x)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None].astype(np.float32)
        n, m = parts.shape[:2]
        codes = np.zeros((n, m), dtype=np.uint8)
        along = np.zeros((n, m), dtype=np.float32)  # each subspace's part of the residual along the vector
        for k in range(m):
            codes[:, k] = np.argmin(((parts[:, k, None, :] - self.centres[k][None]) ** 2).sum(-1), axis=1)
            along[:, k] = ((parts[:, k] - self.centres[k][codes[:, k]]) * unit[:, k]).sum(-1)
        whole = along.sum(1)
        for _ in range(passes):
            for k in range(m):
                gap = parts[:, k, None, :] - self.centres[k][None]
                own = (gap * unit[:, k, None, :]).sum(-1)
                rest = whole - along[:, k]
                codes[:, k] = np.argmin((gap**2).sum(-1) + (self.parallel - 1) * (rest[:, None] + own) ** 2, axis=1)
                along[:, k] = own[np.arange(n), codes[:, k]]
                whole = rest + along[:, k]
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """What codes stand for, rows x dim."""
        return self.centres[np.arange(len(self.centres)), codes].reshape(len(codes), -1)[:, : self.dim].astype(np.float64)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """queries x bytes x 256: what a byte of two codes adds to the inner product."""
        q = self.padded(queries)
        each = np.einsum("qkd,kcd->qkc", q, self.centres)
        if each.shape[1] % 2:
            each = np.concatenate([each, np.zeros_like(each[:, :1])], axis=1)
        return (each[:, 0::2, :, None] + each[:, 1::2, None, :]).reshape(len(queries), -1, CENTRES * CENTRES)


def pack(codes: np.ndarray) -> np.ndarray:
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros_like(codes[:, :1])], axis=1)
    return (codes[:, 0::2] << 4) | codes[:, 1::2]


def fit(x: np.ndarray, threshold: float = 0.2, rounds: int = 6, seed: int = 3) -> Codebook:
    """Centres for vectors x: plain k-means a subspace first, then alternating score-aware codes and least squares.
    threshold is the cosine from which inner products matter; it sets the parallel weight."""
    dim = x.shape[1]
    m = (dim + 1) // 2
    rng = np.random.default_rng(seed)
    book = Codebook(np.zeros((m, CENTRES, 2), dtype=np.float32), max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2)), dim)
    parts = book.padded(x)
    for k in range(m):
        p = parts[:, k]
        centres = p[rng.choice(len(p), CENTRES, replace=len(p) < CENTRES)]
        for _ in range(8):
            at = np.argmin(((p[:, None] - centres[None]) ** 2).sum(-1), axis=1)
            n = np.bincount(at, minlength=CENTRES)
            sums = np.stack([np.bincount(at, weights=p[:, d], minlength=CENTRES) for d in range(2)], axis=1)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        book.centres[k] = centres
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None].astype(np.float32)
    extra = book.parallel - 1
    for _ in range(rounds):
        codes = book.encode(x, passes=1)
        chosen = np.stack([book.centres[k][codes[:, k]] for k in range(m)], axis=1)
        along = ((parts - chosen) * unit).sum(-1)
        whole = along.sum(1)
        for k in range(m):
            u, rest = unit[:, k].astype(float), (whole - along[:, k]).astype(float)
            target = parts[:, k] + extra * u * (rest + (parts[:, k] * u).sum(-1))[:, None]
            for c in range(CENTRES):
                mine = codes[:, k] == c
                if mine.any():
                    a = mine.sum() * np.eye(2) + extra * u[mine].T @ u[mine]
                    book.centres[k, c] = np.linalg.solve(a, target[mine].sum(0))
            along[:, k] = ((parts[:, k] - book.centres[k][codes[:, k]]) * unit[:, k]).sum(-1)
            whole = rest + along[:, k]
    return book


def usable(v: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def best_of(ids: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest values, ties to smaller ids."""
    if len(values) > 4 * k:
        edge = np.partition(values, k - 1)[k - 1]
        some = np.flatnonzero(values <= edge)
    else:
        some = np.arange(len(values))
    return some[np.lexsort((ids[some], values[some]))[:k]]


def fit_cells(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 4) -> np.ndarray:
    """Centres of cells by k-means on x."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds if cells > 1 else 1):
        at = nearest_centre(x, centres)
        n = np.bincount(at, minlength=cells)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(1)
    return np.concatenate([np.argmin(half - x[a : a + 4096] @ centres.T, axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, dtype=np.int64)


@dataclass
class Router:
    """Says which cells can hold a query's k nearest rows. centres, radius and size are the cells'; x, half (half the
    squares of its lengths) and ids the sample's, cell the cells it lies in; probes: how many of the nearest cells a query
    may go to."""

    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray
    x: np.ndarray
    half: np.ndarray
    ids: np.ndarray
    cell: np.ndarray
    probes: int
    k: int

    def __call__(self, own: int, q: np.ndarray) -> tuple[np.ndarray, float]:
        """(cells, a distance that the k-th nearest row in these does not exceed)."""
        to = np.sqrt(((self.centres - q) ** 2).sum(1))
        order = np.argsort(to, kind="stable")
        # so many cells that k other rows are to be found, with room for rows of the query's own
        enough = int(np.searchsorted(np.cumsum(self.size[order]), 4 * self.k)) + 1
        near = order[: max(self.probes, enough)]
        rough = self.half - self.x @ q
        rough[self.ids == own] = np.inf
        if len(near) < len(order):
            chosen = np.zeros(len(order), dtype=bool)
            chosen[near] = True
            rough[~chosen[self.cell]] = np.inf
        bound = np.inf
        if len(rough) >= self.k:
            some = np.argpartition(rough, self.k - 1)[: self.k]
            if np.isfinite(rough[some]).all():
                bound = float(np.sqrt(((self.x[some] - q) ** 2).sum(1)).max())
        return near[~(to[near] - self.radius[near] > bound * (1 + 1e-9) + 1e-9 * (1 + to[near]))], bound


def probes_for(recall: float, x: np.ndarray, cell: np.ndarray, centres: np.ndarray, k: int, queries: int = 256) -> int:
    """How many of the nearest cells hold the share ``recall`` of the k nearest rows, within the sample x."""
    ranks = []
    half = 0.5 * (x**2).sum(1)
    for i in range(min(queries, len(x))):
        rough = half - x @ x[i]
        rough[i] = np.inf
        order = np.argsort(np.sqrt(((centres - x[i]) ** 2).sum(1)), kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        ranks.append(place[cell[np.argpartition(rough, min(k, len(x)) - 1)[:k]]])
    return int(np.sort(np.concatenate(ranks))[min(len(ranks) * k, max(1, math.ceil(recall * len(ranks) * k))) - 1]) + 1 if ranks and len(x) > k else len(centres)


class Part:
    """Rows of one part of a cell. Equal vectors are scanned once; of their rows those stay that can be among the k
    nearest of a query, whichever row is its own: k of each vec_id, 2 * k in all, the smallest."""

    def __init__(self, book: Codebook, k: int, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, code_norm: np.ndarray, gap: np.ndarray):
        self.book, self.k = book, k
        rows = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
        _, first, number = np.unique(rows, return_index=True, return_inverse=True)
        order = np.lexsort((ids, number))
        number, ids = number[order], ids[order]
        number, ids = (v[rank_within(number, ids) < k] for v in (number, ids))
        kept = rank_within(number) < 2 * k
        self.number, self.ids = number[kept], ids[kept]
        self.begin = np.searchsorted(self.number, np.arange(len(first) + 1))
        self.x, self.half, self.gap = x[first], 0.5 * code_norm[first], gap[first] * (1 + 1e-9)
        self.codes = np.ascontiguousarray(codes[first].T)
        self.norm, self.size = (self.x**2).sum(1), np.sqrt(2 * self.half)
        self.single, self.double = ((book.dim + 16) * np.finfo(t).eps for t in (np.float32, np.float64))

    def best(self, own: int, q: np.ndarray, known: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of what is known and the rows of vectors at, but for own ones: vec_ids and distances."""
        if not len(at):
            return known
        exact = np.sqrt(((self.x[at] - q) ** 2).sum(1))
        times = self.begin[at + 1] - self.begin[at]
        rows = np.repeat(self.begin[at] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        near, score = self.ids[rows], np.repeat(exact, times)
        other = near != own
        near, score = np.concatenate([known[0], near[other]]), np.concatenate([known[1], score[other]])
        best = best_of(near, score, self.k)
        return near[best], score[best]

    def search(self, own: int, q: np.ndarray, table: np.ndarray, limit: float, rerank: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest rows, of those no farther than limit at least: vec_ids and exact distances."""
        inner = np.zeros(len(self.half), dtype=np.float32)
        for sums, code in zip(table, self.codes):
            inner += sums[code]
        far = self.half - inner
        first = np.argpartition(far, rerank)[:rerank] if len(far) > rerank else np.arange(len(far))
        known = self.best(own, q, (np.zeros(0, dtype=np.int64), np.zeros(0)), first)
        # half the square that a row's code may lie away from the query, and what single precision may add
        square = q @ q
        edge = min(limit * (1 + 1e-9), known[1][-1] if len(known[1]) == self.k else np.inf)
        bound = 0.5 * (edge + self.gap) ** 2 - 0.5 * square + self.single * (np.sqrt(square) + self.size) ** 2
        open_ = ~((far > bound) & np.isfinite(far))
        open_[first] = False
        at = np.flatnonzero(open_)
        if len(at) > 4 * rerank:  # so many that one product sorts most out
            slack = self.double * (np.sqrt(square) + np.sqrt(self.norm[at])) ** 2
            at = at[~((0.5 * self.norm[at] - self.x[at] @ q) > (0.5 * edge**2 - 0.5 * square + slack))]
        return self.best(own, q, known, at)


def rank_within(*keys: np.ndarray) -> np.ndarray:
    """Place of each element among those with equal keys, which lie together."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return np.arange(n) - np.repeat(starts, np.diff(np.concatenate([starts, [n]])))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, recall: float | None = None, rerank: int = 160, sample: int = 20_000, cell_rows: int = 8192, part_bytes: int = 16_000_000) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that is_query holds for, its k nearest other rows by
    Euclidean distance, nearest first, ties to the smaller vec_id. Score is the exact distance in double precision.
    Without recall no row is missed; with it queries go to fewer cells (see above).

    vectors needs vec_id and embedding; other columns are ignored. Vectors that are null, zero or hold null or non-finite
    components take no part, nor do rows without vec_id or of a length other than the most frequent one. Rows of one
    vec_id are candidates each; as a query it counts once, with the smallest of its vectors, and none of its rows is its
    candidate. An empty table gives no rows. rerank: how many of a part are ranked exactly for each query before bounds
    tell which others are. Centres are fitted on ``sample`` vectors at most, those with the smallest hash; there is a cell
    for every cell_rows rows, up to 1024 and a sixteenth of the sample."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    kinds = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not kinds:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = kinds[0]["d"], kinds[0]["count"]
    rows = rows.filter(F.size("v") == dim)
    drawn = least_hashes(rows.select("vec_id", "v", F.xxhash64("vec_id", "v").alias("h")), "h", n, min(sample, max(1000, 64_000_000 // (8 * dim)))).collect()
    x = np.array([r["v"] for r in drawn], dtype=np.float64)
    book = fit(x.astype(np.float32))
    centres = fit_cells(x, max(1, min(1024, -(-n // cell_rows), len(x) // 16)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, 4096) for b in batches for a in range(0, b.num_rows, 4096)):
            v = matrix(batch.column("v"), dim)
            codes, cell = book.encode(v.astype(np.float32)), nearest_centre(v, centres)
            stand = book.decode(codes)
            length = lambda d: pa.array(np.sqrt((d**2).sum(1)))
            more = [pa.array([c.tobytes() for c in pack(codes)], pa.binary()), pa.array((stand**2).sum(1)), length(v - stand), pa.array(cell, pa.int32()), length(v - centres[cell])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "code", "code_norm", "gap", "cell", "far"])

    indexed = written(rows.mapInArrow(index, "vec_id long, v array<double>, q boolean, code binary, code_norm double, gap double, cell int, far double"), "index")
    radius, size = np.zeros(len(centres)), np.zeros(len(centres), dtype=np.int64)
    for r in indexed.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # one row per cell
        radius[r["cell"]], size[r["cell"]] = r["far"], r["n"]
    cell = nearest_centre(x, centres)
    probes = len(centres) if recall is None else probes_for(recall, x, cell, centres, k)
    router = spark.sparkContext.broadcast(Router(centres, radius, size, x, 0.5 * (x**2).sum(1), np.array([r["vec_id"] for r in drawn], dtype=np.int64), cell, probes, k))  # bounded: the sample
    parts = np.maximum(1, -(-size // max(1024, part_bytes // (8 * dim))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cell", pa.int32()), ("part", pa.int32()), ("id", pa.int64()), ("v", pa.list_(pa.float64())), ("gap", pa.float64())])
        for batch in batches:
            v = matrix(batch.column("v"), dim)
            for i, own in enumerate(batch.column("vec_id").to_pylist()):
                cells, bound = router.value(own, v[i])
                out = [(c, p) for c in cells.tolist() for p in range(parts[c])]
                yield record_batch(schema, [*zip(*out), [own] * len(out), [v[i]] * len(out), [bound] * len(out)] if out else [()] * 5)

    queries = indexed.filter("q").groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = queries.mapInArrow(route, "cell int, part int, id long, v array<double>, gap double").withColumn("side", F.lit(1))
    number = spark.createDataFrame([(i, int(p)) for i, p in enumerate(parts)], "cell int, parts int")
    spread = F.pmod(F.xxhash64("vec_id", "v", F.spark_partition_id()), F.col("parts")).cast("int")
    held = indexed.join(number, "cell").select("cell", spread.alias("part"), F.col("vec_id").alias("id"), "v", "gap", "code", "code_norm", F.lit(0).alias("side"))
    dealt = held.unionByName(asked, allowMissingColumns=True).repartition("cell", "part").sortWithinPartitions("cell", "part", "side")
    found = dealt.select("cell", "part", "side", "id", "v", "gap", "code", "code_norm").mapInArrow(searcher(book, dim, k, rerank), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def searcher(book: Codebook, dim: int, k: int, rerank: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches sorted by cell, part and side: gathers a part's rows (side 0) and searches them for each of its
    queries (side 1, gap: a distance to look no farther than): query_id, vec_id, score, the k nearest of the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        rows: list[pa.RecordBatch] = []
        part: Part | None = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "part", "side")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                *key, side = keys[:, a].tolist()
                if key != now:
                    now, rows, part = key, [], None
                some = batch.slice(a, b - a)
                if side == 0:
                    rows.append(some)
                    continue
                if part is None and rows:
                    whole = pa.Table.from_batches(rows).combine_chunks()
                    codes = np.frombuffer(b"".join(whole.column("code").to_pylist()), dtype=np.uint8).reshape(len(whole), -1)
                    x = np.concatenate([matrix(c, dim) for c in whole.column("v").chunks])
                    part, rows = Part(book, k, *(whole.column(c).to_numpy() if c != "v" else x for c in ("id", "v")), codes, *(whole.column(c).to_numpy() for c in ("code_norm", "gap"))), []
                if part is not None:
                    yield from search(part, some)

    def search(part: Part, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, q, limit = asked.column("id").to_numpy(), matrix(asked.column("v"), dim), asked.column("gap").to_numpy()
        for a in range(0, len(ids), 256):
            tables = book.tables(q[a : a + 256].astype(np.float32))
            found = [part.search(int(ids[i]), q[i], tables[i - a], float(limit[i]), rerank) for i in range(a, min(a + 256, len(ids)))]
            near, score = (np.concatenate(v) for v in zip(*found))
            asker = np.repeat(ids[a : a + 256], [len(n) for n, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(asker), pa.array(near), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run
