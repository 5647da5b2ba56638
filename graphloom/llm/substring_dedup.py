"""Suffix-array dedup: removes every byte that lies in a string of ``width`` bytes which also starts anywhere else.

Suffixes are sorted where equal ones can meet. From every place of a text a window reaches over ``width`` bytes, or over
``words`` words if these are fewer bytes; its anchor is the place in it where the hash of ``gram`` bytes is smallest
(the leftmost of equal ones). Equal windows have equal anchors at equal distances. Consecutive places of one anchor form
a run, a string of at most 2 * width - gram bytes. Then:

1. Runs are gathered by anchor hash, and within it into classes of equal runs by a 128-bit digest. An anchor hash with
   a single run has nothing to compare.
2. Of each class one run, of a class of several runs two, go to the suffix sort of their anchor hash. Of each run two
   suffixes are sorted: what follows the anchor's start, and what precedes it, backwards. The sort is a merge sort; two
   suffixes are compared by the length of their common extension, found by binary search on prefix polynomial hashes,
   and the byte behind it. Neighbours' common extensions are then verified byte by byte. A window is repeated if some
   other run shares enough of both sides, which the two orders and their common extensions tell for all runs at once.
   The two runs of a class must prove equal there; if any do not, all is done again with another digest.
3. An anchor hash with more classes than one task should hold is refined: its runs are cut into pieces of neighbouring
   windows, gathered by the bytes that all windows of a piece share, equal pieces told by their bytes, and groups that
   are small enough sorted as before; others are cut into smaller pieces, at last of one window each.

The result depends on a text alone, so copies are worked on once. Passages of ``words`` words that are shorter than
``width`` bytes are reported, not removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import record_batch, text_slices, written

#: The polynomial's base, odd, so that it has an inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93
SEGMENT = 1 << 19
#: Windows in a piece, at each round of refinement; a quarter of a window's bytes at most.
PIECES = (64, 16, 4, 1)
FAR = 1 << 40
BLANKS = b"\x09\x0a\x0b\x0c\x0d\x20"  # fixed values: the bytes that part words


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    n = SEGMENT + 4096
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


@lru_cache(maxsize=1)
def separators() -> np.ndarray:
    """Whether each byte parts words."""
    out = np.zeros(256, dtype=bool)
    out[list(BLANKS)] = True
    return out


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of bytes, from the empty one."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers()[0][: len(data)], out=out[1:])
    return out


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and where they end (the place behind their last byte)."""
    apart = separators()[data]
    return np.flatnonzero(~apart & np.concatenate([[True], apart[:-1]])), np.flatnonzero(~apart & np.concatenate([apart[1:], [True]])) + 1


def begins_word(data: bytes, at: int) -> bool:
    return data[at] not in BLANKS and (at == 0 or data[at - 1] in BLANKS)


def passages_of(data: np.ndarray, width: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all strings of ``words`` whole words that are shorter than width."""
    start, end = word_edges(data)
    if not words or len(start) < words:
        return np.zeros((2, 0), dtype=np.int64)
    start, end = start[: len(start) - words + 1], end[words - 1 :]
    short = end - start < width
    return start[short], end[short]


def reach(part: np.ndarray, width: int, words: int) -> np.ndarray:
    """How far the window of each place reaches: over width bytes, or over words words if these are fewer bytes. For
    places too near the end of part the reach lies beyond it. It depends only on the bytes that it reaches over and
    the one behind them."""
    out = np.full(len(part), width, dtype=np.int64)
    if words:
        ends = word_edges(part)[1]
        passed = np.zeros(len(part) + 1, dtype=np.int64)
        passed[ends] = 1
        np.cumsum(passed, out=passed)
        padded = np.concatenate([ends, np.full(words, FAR, dtype=np.int64)])
        np.minimum(out, padded[passed[: len(part)] + (words - 1)] - np.arange(len(part)), out=out)
    return out


def runs_of(data: bytes, width: int, gram: int, words: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(first place, number of places, anchor's distance from the first place, anchor hash) of a text's runs."""
    low = np.uint64((1 << 20) - 1)
    lo = 0
    while lo < len(data):
        part = np.frombuffer(data, dtype=np.uint8, count=min(SEGMENT, len(data) - lo), offset=lo)
        last = lo + len(part) == len(data)
        size = reach(part, width, words)
        # places whose window ends within the text; further segments begin where this one's places end
        n = int(np.searchsorted(-(size + np.arange(len(part)) <= len(part)).astype(np.int8), 0)) if last else SEGMENT - width - 1
        if not n:
            return
        h = prefix_hashes(part)
        z = (h[gram:] - h[:-gram]) * powers()[1][: len(h) - gram]
        z = (z ^ (z >> np.uint64(32))) * np.uint64(MIX)
        z ^= z >> np.uint64(29)
        # minima over 2 ** level keys; a window's grams are covered by two overlapping ranges of these
        least = (z & ~low) | np.arange(len(z), dtype=np.uint64)
        grams = size[:n] - gram + 1
        levels = np.frexp(grams.astype(np.float64))[1] - 1
        best = np.empty(n, dtype=np.uint64)
        level = 0
        for want in np.unique(levels).tolist():
            while level < want:
                least = np.minimum(least[: -(1 << level)], least[1 << level :])
                level += 1
            at = np.flatnonzero(levels == want)
            best[at] = np.minimum(least[at], least[at + grams[at] - (1 << want)])
        anchor = (best & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.concatenate([first, [n]]))
        yield from zip((first + lo).tolist(), count.tolist(), (anchor[first] - first).tolist(), z[anchor[first]].view(np.int64).tolist())
        if last:
            return
        lo += n


def digest(data: bytes, salt: int = 0) -> tuple[int, int]:
    """128 bits as two signed integers."""
    d = hashlib.blake2b(data, digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Suffixes:
    """Strings with the hashes of all their prefixes; common extensions of two are found by binary search on these."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.length = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        self.start = np.cumsum(self.length + 1) - self.length - 1
        self.bytes = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8)
        # hashes start anew in each string: sums over the buffer less the sum before the string
        place = np.arange(len(self.bytes)) - np.repeat(self.start, self.length + 1)
        terms = (self.bytes.astype(np.uint64) + np.uint64(1)) * powers()[0][place]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])[:-1]
        self.hash = sums - np.repeat(sums[self.start], self.length + 1)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of strings i and j."""
        low = np.zeros(len(i), dtype=np.int64)
        high = np.minimum(self.length[i], self.length[j])
        a, b = self.start[i], self.start[j]
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.hash[a + mid] == self.hash[b + mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether string i comes before string j; of equal strings neither does."""
        n = self.common(i, j)
        ends_i, ends_j = n == self.length[i], n == self.length[j]
        return np.where(ends_i | ends_j, ends_i & ~ends_j, self.bytes[self.start[i] + n] < self.bytes[self.start[j] + n])

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, common): strings by group, which ascends, and then by content, and what each shares with the one
        before it (-1 for a group's first). Bottom-up merge sort: an element's place is its place in its own run
        plus its rank in the run beside it, found by binary search, for all groups together."""
        n = len(group)
        order = np.arange(n)
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.concatenate([starts, [n]]))
        base, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        width = 1
        while width < sizes.max(initial=0):
            at = np.flatnonzero(size > width)
            place = at - base[at]
            run = place // width
            beside = (run ^ 1) * width
            low = np.minimum(beside, size[at])
            begin = low.copy()
            high = np.minimum(beside + width, size[at])
            right = (run & 1) == 1
            while (open_ := low < high).any():
                k = np.flatnonzero(open_)
                mid = (low[k] + high[k]) >> 1
                own, other = order[at[k]], order[base[at[k]] + mid]
                # those of the right run come after equal ones of the left run
                passed = np.where(right[k], ~self.less(own, other), self.less(other, own))
                low[k], high[k] = np.where(passed, mid + 1, low[k]), np.where(passed, high[k], mid)
            target = base[at] + (run & ~1) * width + place % width + (low - begin)
            order[target] = order[at].copy()
            width *= 2
        before = np.concatenate([[0], order[:-1]])
        common = np.where(np.concatenate([[True], group[1:] != group[:-1]]), -1, self.common(before, order))
        if self._broken(before, order, common):
            return self._sort_plainly(group)
        return order, common

    def _broken(self, before: np.ndarray, order: np.ndarray, common: np.ndarray) -> bool:
        """Verifies neighbours byte by byte: equal hashes of different strings would show here."""
        s = self.strings
        for i, j, n in zip(before.tolist(), order.tolist(), common.tolist()):
            if n >= 0:
                a, b = s[i], s[j]
                if a[:n] != b[:n] or a[n:] > b[n:]:
                    return True
        return False

    def _sort_plainly(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.array(sorted(range(len(group)), key=lambda i: (group[i], self.strings[i])), dtype=np.int64)
        common = np.full(len(group), -1, dtype=np.int64)
        for k in range(1, len(group)):
            if group[order[k]] == group[order[k - 1]]:
                a, b = (np.frombuffer(self.strings[i], dtype=np.uint8) for i in (order[k - 1], order[k]))
                m = min(len(a), len(b))
                differ = np.flatnonzero(a[:m] != b[:m])
                common[k] = differ[0] if len(differ) else m
        return order, common


def repeated_windows(strings: list[bytes], anchors: np.ndarray, windows: np.ndarray, group: np.ndarray, width: int) -> list[list[tuple[int, int]]]:
    """For each run the ranges of its windows of width bytes (first, end) that another run of its group has too. group
    ascends; windows says how many there are, from the run's first place on."""
    n = len(strings)
    lists: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n < 2 or not (windows > 0).any():
        return lists
    right, left = Suffixes([s[a:] for s, a in zip(strings, anchors)]), Suffixes([s[:a][::-1] for s, a in zip(strings, anchors)])
    order_r, common_r = right.sort(group)
    order_l, common_l = left.sort(group)
    place_r, place_l = np.argsort(order_r), np.argsort(order_l)
    opened = np.full(n, -1, dtype=np.int64)  # first window of a range that is still open

    def end(who: np.ndarray, at: np.ndarray) -> None:
        for i, b in zip(who.tolist(), at.tolist()):
            lists[i].append((int(opened[i]), b))
        opened[who] = -1

    for shift in range(int(anchors.max(initial=0)), -1, -1):  # the window begins this far before the anchor
        here = np.flatnonzero((anchors >= shift) & (shift > anchors - windows))
        twice = np.zeros(n, dtype=bool)
        if len(here) > 1:
            # strings that agree on the window's part behind the anchor's start, and on the part before it
            key = np.cumsum(common_r < width - shift)[place_r[here]] * (n + 1) + np.cumsum(common_l < shift)[place_l[here]]
            sorted_ = np.argsort(key, kind="stable")
            same = key[sorted_][1:] == key[sorted_][:-1]
            twice[here[sorted_[1:][same]]] = True
            twice[here[sorted_[:-1][same]]] = True
        over = np.flatnonzero((opened >= 0) & ~twice)
        end(over, anchors[over] - shift)
        new = np.flatnonzero(twice & (opened < 0))
        opened[new] = anchors[new] - shift
    rest = np.flatnonzero(opened >= 0)
    end(rest, np.minimum(anchors[rest] + 1, windows[rest]))
    return lists


def repeated_passages(strings: list[bytes], begins: np.ndarray, places: np.ndarray, group: np.ndarray, width: int, words: int, known: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """For each run the passages (start, end; see passages_of) from its places that another run of its group has too,
    without those that begin at a place of a known range. begins: whether a word begins at the run's first place.
    Passages are told by their hashes and then compared byte by byte."""
    lists: list[list[tuple[int, int]]] = [[] for _ in strings]
    all_ = Suffixes(strings)
    apart = all_.bytes.copy()
    apart[all_.start + all_.length] = 32  # blanks between strings
    start, end = word_edges(apart)
    owner = np.searchsorted(all_.start, start, "right") - 1
    whole = (start > all_.start[owner]) | begins[owner]
    start, owner = start[whole], owner[whole]
    last = np.searchsorted(end, start, "right") + words - 1
    ok = last < len(end)
    start, owner, stop = start[ok], owner[ok], end[last[ok]]
    base = all_.start[owner]
    ok = (stop - base <= all_.length[owner]) & (stop - start < width) & (start - base < places[owner])
    start, owner, stop, base = start[ok], owner[ok], stop[ok], base[ok]
    if not len(start):
        return lists
    h = (all_.hash[stop] - all_.hash[start]) * powers()[1][start - base]
    order = np.lexsort((h, group[owner]))
    g, h = group[owner[order]], h[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])])
    number = np.cumsum(new) - 1
    twice = np.bincount(number)[number] > 1
    order, number = order[twice], number[twice]
    owner, start, stop = owner[order], (start - base)[order], (stop - base)[order]
    open_ = np.fromiter((not any(a <= x < b for a, b in known[i]) for i, x in zip(owner.tolist(), start.tolist())), dtype=bool, count=len(order))
    wanted = np.bincount(number, weights=open_)[number] > 0 if len(order) else open_
    classes: dict[tuple[int, bytes], list[tuple[int, int, bool]]] = {}
    for k, i, a, b, o in zip(*(v[wanted].tolist() for v in (number, owner, start, stop, open_))):
        classes.setdefault((k, strings[i][a:b]), []).append((i, a, o))
    for (_, text), members in classes.items():
        if len(members) > 1:
            for i, a, o in members:
                if o:
                    lists[i].append((a, a + len(text)))
    return [merged(x) for x in lists]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


KEY = ["t1", "t2"]
PLACED = "t1 long, t2 long, x long, nw int, a int, single boolean, begins boolean, string binary"


def text_key(sha: Column) -> list[Column]:
    """128 bits of a text's SHA-256 as two longs."""
    return [F.conv(F.substring(sha, at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, "t1"), (17, "t2"))]


def unpacked(place: Column) -> tuple[Column, Column, Column]:
    """First place, number of places and anchor's distance of a run, from their one number."""
    return F.shiftright(place, 24), F.shiftright(place, 12).bitwiseAND(F.lit(0xFFF)).cast("int"), place.bitwiseAND(F.lit(0xFFF)).cast("int")


def text_runs(texts: DataFrame, width: int, gram: int, words: int, salt: int) -> DataFrame:
    """t1, t2, place (first place, number of places and anchor's distance in one number), h (anchor hash), s1 and s2
    (digest) of runs. Copies of a text that one task meets give their runs once. Of equal runs of one text, such as
    periodic text has for every period, two are rows of their own; what the others cover, compared byte by byte, comes
    as spans: h null, from place to s1, of width bytes where s2 is 1, else of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        schema = pa.schema([(c, pa.int64()) for c in (*KEY, "place", "h", "s1", "s2")])
        for batch in batches:
            if len(seen) > 200_000:
                seen.clear()
            for at, some in text_slices(batch.column("text")):
                rows = []
                keys = zip(*(batch.column(c).slice(at, len(some)).to_pylist() for c in KEY))
                for key, text in zip(keys, some):
                    if key not in seen:
                        seen.add(key)
                        data = text.encode()
                        met: dict[tuple, list] = {}
                        before, s, more = (None, b""), (0, 0), []
                        for x, nw, a, h in runs_of(data, width, gram, words):
                            string = data[x : x + nw + width - 1]
                            told = (nw << 1 | begins_word(data, x)).to_bytes(2, "little")
                            if before != (told, string):
                                before, s = (told, string), digest(string + told, salt)
                            equal = met.setdefault((h, *s), [x, 0])
                            equal[1] += 1
                            if equal[1] > 2 and data.startswith(string, equal[0]):
                                more.append((x, x + nw))
                            else:
                                rows.append((*key, (x << 24) | (nw << 12) | a, h, *s))
                        if more:
                            starts, ends = passages_of(np.frombuffer(data, dtype=np.uint8), width, words)
                            for x, to in merged(more):
                                last = min(to, len(data) - width + 1)
                                if last > x:
                                    rows.append((*key, x, None, last - 1 + width, 1))
                                some = slice(*np.searchsorted(starts, (x, to)).tolist())
                                rows += [(*key, b, None, e, 0) for b, e in merged(list(zip(starts[some].tolist(), ends[some].tolist())))]
                        if len(rows) > 100_000:
                            yield record_batch(schema, zip(*rows))
                            rows = []
                if rows:
                    yield record_batch(schema, zip(*rows))

    return texts.mapInArrow(run, "t1 long, t2 long, place long, h long, s1 long, s2 long")


def packed_texts(texts: DataFrame) -> DataFrame:
    """t1, t2, z: texts as zstandard frames, about half as much to shuffle; a task's copies once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        seen: set[tuple[int, int]] = set()
        schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("z", pa.binary())])
        for batch in batches:
            if len(seen) > 200_000:
                seen.clear()
            for at, some in text_slices(batch.column("text")):
                rows = []
                for key, text in zip(zip(*(batch.column(c).slice(at, len(some)).to_pylist() for c in KEY)), some):
                    if key not in seen:
                        seen.add(key)
                        rows.append((*key, squeeze(text.encode())))
                if rows:
                    yield record_batch(schema, zip(*rows))

    return texts.mapInArrow(run, "t1 long, t2 long, z binary")


def gather(suspects: DataFrame, width: int, flag: str, packed: bool = True) -> DataFrame:
    """The strings of the runs whose item has a flag set: g (their group), pair (equal for the runs of one class), t1, t2,
    x, nw, a, single, begins (whether a word begins at x), string (as a zstandard frame if packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        squeeze = zstandard.ZstdCompressor(level=3).compress if packed else bytes
        kinds = (pa.int64(),) * 5 + (pa.int32(),) * 2 + (pa.bool_(),) * 2 + (pa.binary(),)
        schema = pa.schema(list(zip(("g", "pair", *KEY, "x", "nw", "a", "single", "begins", "string"), kinds)))
        for batch in batches:
            for i in range(batch.num_rows):
                data = unpack(batch.column("z")[i].as_py())
                t1, t2 = (batch.column(c)[i].as_py() for c in KEY)
                rows = []
                for r in batch.column("items")[i].as_py():
                    if r[flag]:
                        x = r["x"]
                        rows.append((r["g"], r["s2"], t1, t2, x, r["nw"], r["a"], r["single"], begins_word(data, x), squeeze(data[x : x + r["nw"] + width - 1])))
                if rows:
                    yield record_batch(schema, zip(*rows))

    return suspects.filter(F.exists("items", lambda r: r[flag])).select(*KEY, "z", "items").mapInArrow(run, f"g long, pair long, {PLACED}")


FOUND = "t1 long, t2 long, first long, end long, whole boolean"


def compare(gathered: DataFrame, width: int, words: int, packed: bool = True, chunk: int = 4_000_000) -> DataFrame:
    """t1, t2, first, end, whole: spans of single runs that another run of the same group has too; whole: of width bytes
    at least, otherwise a passage of words. A row with first -1 tells that two runs of one class (pair, if it is not
    null) differ. packed: strings are zstandard frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        held: list[tuple] = []
        schema = pa.schema([(c, pa.int64()) for c in (*KEY, "first", "end")] + [("whole", pa.bool_())])

        def settle(rows: list[tuple]) -> pa.RecordBatch:
            g, pair, t1, t2, x, nw, a, single, begins, string = zip(*rows)
            group, places, strings = np.array(g, dtype=np.int64), np.array(nw, dtype=np.int64), list(string)
            windows = np.minimum(places, np.array([len(s) - width + 1 for s in strings]))
            found = repeated_windows(strings, np.array(a, dtype=np.int64), windows, group, width)
            out = [(t1[i], t2[i], x[i] + b, x[i] + e - 1 + width, True) for i, ranges in enumerate(found) if single[i] for b, e in ranges]
            if words:
                more = repeated_passages(strings, np.array(begins), places, group, width, words, found)
                out += [(t1[i], t2[i], x[i] + b, x[i] + e, False) for i, ranges in enumerate(more) if single[i] for b, e in ranges]
            classes: dict[tuple, int] = {}
            for i in range(len(rows)):
                if pair[i] is not None and not single[i]:
                    j = classes.setdefault((g[i], pair[i]), i)
                    # the sort has verified what it calls repeated; shorter strings are compared here
                    if j != i and (strings[i] != strings[j] or (windows[i] > 0 and (found[i] != [(0, windows[i])] or found[j] != found[i]))):
                        out.append((t1[i], t2[i], -1, -1, False))
            return record_batch(schema, zip(*out) if out else [()] * 5)

        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if packed:
                    row = (*row[:-1], unpack(row[-1]))
                if size >= chunk and row[0] != held[-1][0]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
        if held:
            yield settle(held)

    dealt = gathered.repartition("g").sortWithinPartitions("g", *KEY, "x")
    return dealt.mapInArrow(run, FOUND)


BYTES, WORDS = 1, 2  # what windows a piece is cut for


def pieces(runs: DataFrame, width: int, gram: int, words: int, size: int) -> DataFrame:
    """Runs (PLACED, and kind: BYTES, WORDS or null for both) cut into pieces of the windows that begin at up to ``size``
    neighbouring places, by what lies between the place and the anchor. g is a digest of bytes that all windows which
    could be in a piece share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(),) * 4 + (pa.int32(),) * 2 + (pa.bool_(),) * 2 + (pa.binary(), pa.int32())
        schema = pa.schema(list(zip(("g", *KEY, "x", "nw", "a", "single", "begins", "string", "kind"), kinds)))
        for batch in batches:
            rows: list[tuple] = []

            def add(core: bytes, kind: int, block: int, row: tuple, begin: int, last: int, end: int, rows: list = rows) -> None:
                """The windows that begin from begin to last, in a string that ends at end."""
                t1, t2, x, a, single, string = row
                told = digest(core + bytes([kind]) + block.to_bytes(2, "little"))[0]
                rows.append((told, t1, t2, x + begin, last - begin + 1, a - begin, single, kind == WORDS, string[begin:end], kind))

            for t1, t2, x, nw, a, single, begins, string, kind in zip(*(c.to_pylist() for c in batch.columns)):
                row = (t1, t2, x, a, single, string)
                first, low = a, a - min(nw, len(string) - width + 1) + 1  # windows begin from first to low bytes before the anchor
                while kind != WORDS and first >= low:
                    block = first // size
                    to = max(low, block * size)
                    add(string[a - block * size : a - (block + 1) * size + 1 + width], BYTES, block, row, a - first, a - to, a - to + width)
                    first = to - 1
                if kind == BYTES or not words:
                    continue
                head = 0 if begins else 1  # no word begins at the string's first byte
                data = np.frombuffer(b"x" * head + string, dtype=np.uint8)
                starts, ends = (v - head for v in passages_of(data, width, words))
                begun = word_edges(data)[0] - head
                here = (starts >= 0) & (starts < nw)
                starts, ends = starts[here], ends[here]
                blocks = (a - starts) // size
                for block in np.unique(blocks).tolist():
                    mine = blocks == block
                    begin, last, end = int(starts[mine][0]), int(starts[mine][-1]), int(ends[mine][-1])
                    # from the last word that begins in the block to the anchor's end; at last the whole passage
                    core = string[begin:end] if size == 1 else string[int(begun[begun <= a - block * size][-1]) : a + gram]
                    add(core, WORDS, block, row, begin, last, end)
            for at in range(0, len(rows), 20_000):
                yield record_batch(schema, zip(*rows[at : at + 20_000]))

    return runs.select(*KEY, "x", "nw", "a", "single", "begins", "string", "kind").mapInArrow(run, f"g long, {PLACED}, kind int")


def compare_crowded(runs: DataFrame, width: int, gram: int, words: int, most: int) -> DataFrame | None:
    """What compare gives, for runs of anchor hashes that have more than ``most`` classes."""
    out: DataFrame | None = None
    sizes = [n for n in PIECES if 4 * n <= width] or [1]
    runs = runs.withColumn("kind", F.lit(None).cast("int"))
    for size in sizes:
        cut = written(pieces(runs, width, gram, words, size).withColumn("u", F.xxhash64(*KEY, "x", "kind")), "pieces")
        # equal pieces by their bytes, one row for each; then how many different ones a group has
        row = F.struct(*KEY, "x", "nw", "a", "single", "begins")
        same = cut.groupBy("g", "kind", "string").agg(F.min_by(row, "u").alias("row"), F.min("u").alias("lo"), F.max("u").alias("hi"))
        same = written(same, "same")
        again = F.col("lo") < F.col("hi")
        repeated = cut.filter("single").join(same.filter(again), ["g", "kind", "string"], "left_semi")
        found = repeated.select(*KEY, F.col("x").alias("first"), (F.col("x") + F.length("string")).alias("end"), (F.col("kind") == BYTES).alias("whole"))
        kinds = same.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
        one = same.select("g", "kind", "string", "row.*", again.alias("again")).withColumn("single", F.col("single") & ~F.col("again")).withColumn("pair", F.lit(None).cast("long"))
        few = one.join(kinds.filter((F.col("m") > 1) & (F.col("m") <= most)), "g", "left_semi")
        few = compare(few.select("g", "pair", *KEY, "x", "nw", "a", "single", "begins", "string"), width, words, packed=False)
        found = found.unionByName(few)
        out = found if out is None else out.unionByName(found)
        runs = one.join(kinds.filter(F.col("m") > most), "g", "left_semi")
        if size == 1 or runs.isEmpty():
            break
    return out


def remove_repeats(docs: DataFrame, width: int = 400, gram: int = 50, words: int = 51, most: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs of bytes), kept_sha256 (of the bytes left, in order),
    n_passages and passage_bytes: maximal runs of bytes, and their size, that lie in a string of width bytes, or of words
    words if these are fewer bytes, which also starts anywhere else.

    docs needs doc_id and text; other columns are ignored. A null text is empty; a text of under width bytes keeps all;
    a text that occurs twice, in whichever rows, loses all if it has width bytes; matches never cross texts but may lie
    in one text; every row gives a row; an empty table gives none. most: how many different runs of one anchor hash one
    task compares before they are refined. words = 0 reports no passages by words."""
    if words and 2 * words - 1 < gram or gram > width or width > 4000:
        raise ValueError("a window must hold a gram, and have 4000 bytes at most")
    for salt in range(8):
        found = spans(docs, width, gram, words, most, salt)
        if found is not None:
            return removed(docs, *found, width, words)
    raise RuntimeError("digests collide under every salt")


def texts_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("sha", F.sha2("text", 256))


def spans(docs: DataFrame, width: int, gram: int, words: int, most: int, salt: int) -> tuple[DataFrame, DataFrame] | None:
    """(suspects, found): texts (t1, t2, z) with their runs that occur twice or were compared (items), and spans of the
    latter (t1, t2, first, end, whole). None if two different runs have one digest."""
    rows = texts_of(docs)
    long_rows = rows.filter(F.octet_length("text") >= (min(width, 2 * words - 1) if words else width)).select(*text_key(F.col("sha")), "text")
    told = written(text_runs(long_rows, width, gram, words, salt), "runs")
    runs = told.filter("h is not null")
    own = told.filter("h is null").select(*KEY, F.col("place").alias("first"), F.col("s1").alias("end"), (F.col("s2") == 1).alias("whole"))
    # most anchor hashes occur once; what follows is about the others
    met_twice = runs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    runs = written(runs.join(met_twice, "h", "left_semi"), "runs")
    placed = runs.withColumn("u", F.xxhash64(*KEY, "place"))
    classes = placed.groupBy("h", "s1", "s2").agg(F.min("u").alias("lo"), F.max("u").alias("hi"))
    several = classes.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    m, single = F.coalesce("m", F.lit(1)), F.col("lo") == F.col("hi")
    kept = classes.join(several, "h", "left").filter(~single | F.col("m").isNotNull()).select("h", "s1", "s2", "lo", "hi", m.alias("m"))
    # every place of a run that occurs twice; of the others the one place
    met = placed.join(kept, ["h", "s1", "s2"])
    crowded, first = F.col("m") > most, F.col("u") == F.col("lo")
    sorts = F.when((F.col("m") > 1) & ~crowded, first | (F.col("u") == F.col("hi"))).otherwise(~single & (first | (F.col("u") == F.col("hi"))))
    group = F.when((F.col("m") > 1) & ~crowded, F.col("h")).otherwise(F.xxhash64("h", "s1", "s2"))
    x, nw, a = unpacked(F.col("place"))
    item = F.struct(x.alias("x"), nw.alias("nw"), a.alias("a"), single.alias("single"), sorts.alias("sorts"), (crowded & first).alias("crowded"),
                    F.when(sorts, group).alias("g"), F.when(sorts & ~single, F.col("s2")).alias("s2"))
    # copies of a text give the same items
    per_text = met.select(*KEY, item.alias("item")).groupBy(*KEY).agg(F.collect_set("item").alias("items"))
    one = packed_texts(long_rows).groupBy(*KEY).agg(F.first("z").alias("z"))
    suspects = written(one.join(per_text, KEY), "suspects")

    found = written(compare(gather(suspects, width, "sorts"), width, words), "found")
    if not found.filter("first < 0").isEmpty():
        return None
    found = found.unionByName(own)
    crowd = suspects.filter(F.exists("items", lambda r: r["crowded"]))
    if not crowd.isEmpty():
        found = found.unionByName(compare_crowded(gather(crowd, width, "crowded", packed=False), width, gram, words, most))
    return suspects, found


def removed(docs: DataFrame, suspects: DataFrame, found: DataFrame, width: int, words: int) -> DataFrame:
    """The rows that remove_repeats gives."""
    extra = found.groupBy(*KEY).agg(F.collect_list(F.struct("first", "end", "whole")).alias("ranges"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        schema = pa.schema([(c, pa.int64()) for c in (*KEY, "removed", "spans", "passages", "passage_bytes")] + [("kept", pa.string())])
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                t1, t2, z, items, ranges = (batch.column(c)[i].as_py() for c in (*KEY, "z", "items", "ranges"))
                data = unpack(z)
                starts, ends = passages_of(np.frombuffer(data, dtype=np.uint8), width, words)
                gone = [(r["first"], r["end"]) for r in ranges or () if r["whole"]]
                told = [(r["first"], r["end"]) for r in ranges or () if not r["whole"]]
                for r in items:
                    if r["twice"]:
                        to = min(r["x"] + r["nw"], len(data) - width + 1)
                        if to > r["x"]:
                            gone.append((r["x"], to - 1 + width))
                        some = slice(*np.searchsorted(starts, (r["x"], r["x"] + r["nw"])))
                        told += zip(starts[some].tolist(), ends[some].tolist())
                gone = merged(gone)
                told = merged(told + gone)
                keep, at = hashlib.sha256(), 0
                for a, b in gone:
                    keep.update(data[at:a])
                    at = b
                keep.update(data[at:])
                out.append((t1, t2, sum(b - a for a, b in gone), len(gone), len(told), sum(b - a for a, b in told), keep.hexdigest()))
            if out:
                yield record_batch(schema, zip(*out))

    brief = F.transform("items", lambda r: F.struct(r["x"].alias("x"), r["nw"].alias("nw"), (~r["single"]).alias("twice")))
    joined = suspects.select(*KEY, "z", brief.alias("items")).join(extra, KEY, "left").select(*KEY, "z", "items", "ranges")
    done = written(joined.mapInArrow(cut, "t1 long, t2 long, removed long, spans long, passages long, passage_bytes long, kept string"), "cut")

    rows = texts_of(docs)
    # a whole text that has under width bytes: from its first word to the end of its last
    bare = F.regexp_replace("text", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    enough = F.size(F.split(bare, r"[\x20\x09-\x0D]+")) >= words if words else F.lit(False)
    short = F.when(F.col("n_bytes") < width, F.when(enough, F.octet_length(bare)).otherwise(0)).otherwise(F.col("n_bytes")).cast("long")
    light = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).select("doc_id", "n_bytes", "sha", *text_key(F.col("sha")), short.alias("whole"))
    light = written(light, "light")
    times = light.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"))
    out = light.join(times, KEY).join(done, KEY, "left")
    copied, zero = F.col("copies") > 1, F.lit(0).cast("long")
    all_ = copied & (F.col("n_bytes") >= width)
    return out.select(
        "doc_id", "n_bytes",
        F.when(all_, F.col("n_bytes")).otherwise(F.coalesce("removed", zero)).alias("n_removed"),
        F.when(all_, F.lit(1).cast("long")).otherwise(F.coalesce("spans", zero)).alias("n_spans"),
        F.when(all_, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(copied & (F.col("whole") > 0), F.lit(1).cast("long")).otherwise(F.coalesce("passages", zero)).alias("n_passages"),
        F.when(copied & (F.col("whole") > 0), F.col("whole")).otherwise(F.coalesce("passage_bytes", zero)).alias("passage_bytes"),
    )
