"""Best-fit packing of documents into sequences of bounded length.

Documents are cut into pieces of at most ``capacity`` tokens; how many pieces there are of each length (at most
``capacity`` numbers, whatever the table's size) is all that the plan needs:

1. ``solve_configuration_lp``: the configuration linear program "fewest sequences that cover every length's count",
   by multiplicative weights. A length's price rises while it lags behind and falls once it is ahead; a knapsack
   dynamic program over the capacity prices configurations, and the configurations it finds get the amounts by which
   the lagging lengths lag.
2. ``round_configurations``: whole sequences of these configurations, heaviest first, as long as there are pieces.
   What is left is solved and rounded again while that settles enough of it.
3. ``best_fit``: the rest, longest first, into the fullest sequence with room, by counts and not piece by piece.
4. ``repair``: while there are more sequences than the program's dual allows, the least filled ones, ever more of them,
   are taken apart and fitted anew, and the new ones kept if they are fewer.

The plan is a list of (lengths, number of sequences). Each length's pieces are then numbered, in parallel, and a piece's
number says which sequence and which place in it is its own.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import encoder, n_partitions, spread, written

Plan = list[tuple[tuple[int, ...], int]]


def price_knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room from 0 to capacity the largest value of a multiset of lengths that fits into it, and the last
    length put in (0: none, take the answer of one less room). lengths ascend."""
    best = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        k = np.searchsorted(lengths, room, "right")
        if k:
            with_each = best[room - lengths[:k]] + values[:k]
            i = int(np.argmax(with_each))
            if with_each[i] > best[room]:
                best[room], last[room] = with_each[i], lengths[i]
    return best, last


def completion(last: np.ndarray, room: int, left: dict[int, float]) -> list[int]:
    """The knapsack's answer for a room, without more copies of a length than are left."""
    found: list[int] = []
    while room > 0:
        size = int(last[room])
        if size == 0 or left.get(size, 0) < 1:
            room -= 1
            continue
        found.append(size)
        left[size] -= 1
        room -= size
    return found


def solve_configuration_lp(counts: dict[int, int], capacity: int, rounds: int = 6, batch: int = 48, rate: float = 4.0) -> dict[tuple[int, ...], float]:
    """A fractional cover of counts (length: pieces) by configurations (sorted tuples of lengths): amounts by configuration.

    In round r every length should be covered to the share (r + 1) / rounds. Lengths that lag get their price raised by
    the multiplicative weight exp(rate * lag), those ahead get it lowered; after every ``batch`` configurations prices
    are renewed by another knapsack. A configuration is a lagging length with the knapsack's answer for the room beside it.
    """
    lengths = np.array(sorted(counts), dtype=np.int64)
    need = np.array([counts[int(x)] for x in lengths], dtype=float)
    index = {int(x): i for i, x in enumerate(lengths)}
    done = np.zeros(len(lengths))
    amounts: dict[tuple[int, ...], float] = {}
    for r in range(rounds):
        goal = (r + 1) / rounds
        while True:
            lag = goal - done / need
            late = np.flatnonzero(lag > 1e-9)
            if not len(late):
                break
            values = lengths * np.exp(rate * np.clip(lag, -1, 1)) / capacity
            _, last = price_knapsack(lengths, values, capacity)
            # the longest first: they leave the least choice
            for i in late[::-1][:batch]:
                size = int(lengths[i])
                lacking = (goal - done[i] / need[i]) * need[i]
                if lacking <= 1e-9:
                    continue
                left = {int(x): n for x, n in zip(lengths, np.floor(need))} if need[i] < 2 else dict.fromkeys(index, float(capacity))
                left[size] -= 1
                config = Counter(completion(last, capacity - size, left))
                config[size] += 1
                amount = lacking / config[size]
                key = tuple(sorted(config.elements(), reverse=True))
                amounts[key] = amounts.get(key, 0.0) + amount
                for x, n in config.items():
                    done[index[x]] += n * amount
    return amounts


def round_configurations(amounts: dict[tuple[int, ...], float], counts: dict[int, int], capacity: int, least_fill: float) -> Plan:
    """Whole sequences of the configurations that are filled to least_fill, largest amounts first, rounded up while
    counts (which this lowers) has the pieces."""
    plan: Plan = []
    for config, amount in sorted(amounts.items(), key=lambda x: (-x[1], x[0])):
        if sum(config) < least_fill * capacity:
            continue
        times = min(int(np.ceil(amount)), *(counts.get(x, 0) // n for x, n in Counter(config).items()))
        if times > 0:
            plan.append((config, times))
            for x, n in Counter(config).items():
                counts[x] -= n * times
    return plan


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit, longest first, on counts: equal sequences are kept as one entry with a number."""
    open_by_room: dict[int, list[list]] = {}
    rooms: list[int] = []
    full: Plan = []

    def put(room: int, config: tuple[int, ...], n: int) -> None:
        if room == 0:
            full.append((config, n))
            return
        if room not in open_by_room:
            open_by_room[room] = []
            bisect.insort(rooms, room)
        open_by_room[room].append([config, n])

    for size in sorted((x for x, n in counts.items() if n > 0), reverse=True):
        n = counts[size]
        while n:
            k = bisect.bisect_left(rooms, size)
            if k == len(rooms):
                per = min(capacity // size, n)
                times = n // per
                put(capacity - per * size, (size,) * per, times)
                n -= per * times
                continue
            room = rooms[k]
            config, have = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
                rooms.pop(k)
            per = min(room // size, n)
            times = min(have, n // per)
            if have > times:
                put(room, config, have - times)
            put(room - per * size, config + (size,) * per, times)
            n -= per * times
    return full + [(tuple(c), n) for entries in open_by_room.values() for c, n in entries]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: the value of two solutions of the configuration program's dual, whose prices
    let no configuration cost over one. One prices by length; the other, besides, takes lengths over half a sequence as
    half and a little more, of which two never meet."""
    lengths = np.array(sorted(counts), dtype=np.int64)
    need = np.array([counts[int(x)] for x in lengths], dtype=float)
    bounds = [0.0]
    for values in (lengths / capacity, np.where(2 * lengths > capacity, 0.5, lengths / capacity / 2) + lengths / capacity / 2):
        most = price_knapsack(lengths, values, capacity)[0][capacity] if len(lengths) else 1.0
        bounds.append(float((need * values).sum() / max(most, 1e-12)))
    return math.ceil(max(bounds) - 1e-6)


def repair(plan: Plan, capacity: int, bound: int) -> Plan:
    """plan, or one of fewer sequences. Takes apart the least filled sequences, twice as many each time up to all, until
    there are no more than bound."""
    plan = sorted(plan, key=lambda p: (sum(p[0]), p[0]))
    total = sum(n for _, n in plan)
    take = 4
    while total > bound:
        apart: Counter[int] = Counter()
        kept: Plan = []
        room = take
        for config, n in plan:
            k = min(n, room)
            room -= k
            for size in config:
                apart[size] += k
            if n > k:
                kept.append((config, n - k))
        fitted = best_fit(dict(apart), capacity)
        if sum(n for _, n in fitted) < min(take, total):
            plan = sorted(kept + fitted, key=lambda p: (sum(p[0]), p[0]))
            total = sum(n for _, n in plan)
        elif take >= total:
            break
        take *= 2
    return plan


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """Configurations and how many sequences of each hold exactly counts (length: pieces, lengths 1 to capacity)."""
    left = {x: n for x, n in counts.items() if n > 0 and x < capacity}
    plan: Plan = [((capacity,), counts[capacity])] if counts.get(capacity, 0) else []
    for _ in range(12):
        pieces = sum(left.values())
        if not pieces:
            break
        got = round_configurations(solve_configuration_lp(left, capacity), left, capacity, least_fill=0.995)
        left = {x: n for x, n in left.items() if n > 0}
        plan += got
        if sum(len(c) * n for c, n in got) < 0.05 * pieces:
            break
    return repair(plan + best_fit(left, capacity), capacity, lower_bound({x: n for x, n in counts.items() if n > 0}, capacity))


def token_pieces(docs: DataFrame, tokenizer_path: str, leading_space: bool, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids with end_id behind them, cut from the end into pieces of
    capacity, so that only the first may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, leading_space)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.encode(batch.column("text")), strict=True):
                ids += end
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    to = at + ((n - at) % capacity or capacity)
                    rows.append((doc_id, k, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    at, k = to, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for c, v, t in zip(("doc_id", "piece", "start", "length", "ids_crc32"), columns, kinds, strict=True)})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, plan: Plan) -> DataFrame:
    """Adds sequence_id and offset to pieces, whose counts by length are exactly the plan's.

    Pieces of a length are numbered in (chunk, doc_id, piece) order, a chunk being a hash of doc_id: numbers within
    (length, chunk) come from a window, and the chunks' first numbers from sums of their counts, so no length, however
    common, meets in one task."""
    spark = pieces.sparkSession
    chunks = n_partitions(spark)
    slots: dict[int, list[tuple[int, int, int]]] = {}  # length: first number, first sequence, offset
    taken: Counter[int] = Counter()
    base = 0
    for config, n in plan:
        offset = 0
        for size in config:
            slots.setdefault(size, []).append((taken[size], base, offset))
            taken[size] += n
            offset += size
        base += n
    lookup = {size: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for size, v in slots.items()}
    shared = spark.sparkContext.broadcast(lookup)  # bounded: it follows the number of lengths, at most the capacity

    keyed = pieces.withColumn("chunk", spread("doc_id", n=chunks))
    within = Window.partitionBy("length", "chunk").orderBy(F.col("doc_id").asc_nulls_first(), "piece", "start", "ids_crc32")
    numbered = keyed.withColumn("n", F.row_number().over(within) - 1)
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = keyed.groupBy("length", "chunk").agg(F.count("*").alias("m")).select("length", "chunk", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            length, n = (batch.column(c).to_numpy() for c in ("length", "n"))
            sequence, offset = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                first, at, shift = found[int(size)]
                k = np.searchsorted(first, n[rows], "right") - 1
                sequence[rows], offset[rows] = at[k] + n[rows] - first[k], shift[k]
            kept = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"])

    rows = numbered.join(firsts, ["length", "chunk"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("n") + F.col("first")).alias("n"))
    return rows.mapInArrow(look_up, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, leading_space: bool = True, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Packs every document into sequences of at most capacity tokens: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    docs needs doc_id and text; other columns are ignored. A null text is empty and so one piece, the end id; repeated
    rows are packed once each; equal doc_ids, null ones too, are kept apart only by their rows; an empty table gives no
    rows. The driver gets one row per length (at most capacity)."""
    pieces = written(token_pieces(docs, tokenizer_path, leading_space, end_id, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return place(pieces, plan_packing(counts, capacity))
