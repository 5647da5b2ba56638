"""What the corpus operators share: written tables in the shared folder, small Arrow helpers and the word-cached encoder."""

from __future__ import annotations

import contextlib
import functools
import os
import re
import sys
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import delete_path, make_importable, run_folder

_folders: list[str] = []  # of the scratch contexts that are open, innermost last


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder: within the innermost open scratch folder, else in this run's own folder, which
    the driver's end deletes."""
    if not _folders:
        base = run_folder(spark)
    else:
        base = _folders[-1]
    return f"{base}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for tables that are read no more when the context ends; it is deleted then."""
    path = f"{run_folder(spark)}/scratch-{uuid.uuid4().hex}"
    _folders.append(path)
    try:
        yield path
    finally:
        _folders.remove(path)
        delete_path(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back. It cuts the lineage, so that a lost executor costs no
    recomputation of what came before, and costly Python steps run once."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    make_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def unused(columns: list[str], name: str) -> str:
    """A column name that none of columns has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(columns: list[str]) -> list[Column]:
    """Columns by their whole names, whatever characters these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def map_rows(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], more: list[T.StructField] = []) -> DataFrame:  # noqa: B006
    """docs, all columns in their places, mapped batch by batch, with more columns behind. Within run columns go by place."""
    plain = [f"c{i}" for i in range(len(docs.columns) + len(more))]
    fields = [*docs.schema.fields, *more]
    out = docs.toDF(*plain[: len(docs.columns)]).mapInArrow(run, T.StructType([T.StructField(n, f.dataType) for n, f in zip(plain, fields)]))
    return out.toDF(*[f.name for f in fields])


def spread(*cols: Column | str, n: int) -> Column:
    """A bucket from 0 to n - 1 by hash; null hashes like a value."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def text_slices(texts: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of an Arrow column, about `most` bytes at once: only one such part is ever held as Python
    objects, so that working memory does not follow the batch size."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = before = 0
    while start < len(texts):
        to = min(int(np.searchsorted(ends, before + most)) + 1, len(texts))
        yield start, texts.slice(start, to - start).to_pylist()
        start, before = to, int(ends[to - 1])


def each_text(texts: pa.Array) -> Iterator[str | None]:
    return (t for _, part in text_slices(texts) for t in part)


def least_hashes(rows: DataFrame, h: str, n: int, most: int) -> DataFrame:
    """At most ``most`` of n rows, those with the smallest hashes in column h (a 64-bit one), ties by the other columns.

    A bound on the hash lets about that many rows through, and a little more, wherever they lie, so that the sort gets
    as many rows whatever the table's size."""
    share = (most + 6 * most**0.5 + 20) / max(1, n)
    if share < 1:
        rows = rows.filter(F.col(h) < -(1 << 63) + int(share * (1 << 64)))
    return rows.orderBy(h, *[c for c in rows.columns if c != h]).limit(most)


def record_batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


@functools.lru_cache(maxsize=1)
def encoder(path: str, leading_space: bool) -> CachedEncoder:
    """This process's encoder; a reused Python worker keeps its pieces from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return CachedEncoder(path, leading_space)


class CachedEncoder:
    """Encodes whole texts by the tokenizers library, each distinct piece of text once.

    The tokenizer's own first step cuts a text into pieces by a pattern and encodes each for itself. For texts of
    Latin-1 letters, where the pattern's classes leave no doubt, that cut is made here, and the ids of the pieces, kept
    as bytes, are joined; other texts go to the library as they are. Either way the ids are those of
    ``encode(text, add_special_tokens=False)``. With ``leading_space`` (byte-level vocabularies) a piece takes a space
    before it along; otherwise white space is dropped and letters are folded to lower case.
    """

    #: The two tokenizers' patterns, with the letters and numbers of Latin-1.
    _L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
    _SPACED = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
    _DROPPED = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")

    _MARK = "\u25a0"  # no Latin-1 character

    def __init__(self, path: str, leading_space: bool, capacity: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.leading_space, self.capacity = leading_space, capacity
        self.cut = (self._SPACED if leading_space else self._DROPPED).findall
        # tokens that begin a piece with a space before it, or end a piece: new pieces are encoded many in one text
        marks = [i for k, i in self.tokenizer.get_vocab().items() if (k.startswith("\u0120") if leading_space else k.endswith("</w>"))]
        self.marks = np.zeros(self.vocabulary, dtype=bool)
        self.marks[marks] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before the last trim

    def _ids(self, pieces: list[str]) -> Iterator[bytes]:
        for at in range(0, len(pieces), 20_000):
            for e in self.tokenizer.encode_batch_fast(pieces[at : at + 20_000], add_special_tokens=False):
                ids = array("I", e.ids)
                if sys.byteorder == "big":
                    ids.byteswap()
                yield ids.tobytes()

    def _learn(self, pieces: list[str]) -> None:
        together = [p for p in pieces if p[0] == " " and not p[1:2].isspace() and len(p) > 1] if self.leading_space else pieces
        for at in range(0, len(together), 2000):
            part = together[at : at + 2000]
            encoded = self.tokenizer.encode_batch_fast([("" if self.leading_space else " ").join(part)], add_special_tokens=False)[0].ids
            ids = np.array(encoded, dtype="<u4")
            found, data = np.flatnonzero(self.marks[ids]), ids.tobytes()
            edges = [*(4 * found).tolist(), len(data)] if self.leading_space else [0, *(4 * found + 4).tolist()]
            if len(found) == len(part) and edges[0] == 0 and edges[-1] == len(data):
                self.known.update(zip(part, (data[a:b] for a, b in zip(edges, edges[1:]))))
        rest = [p for p in pieces if p not in self.known]
        self.known.update(zip(rest, self._ids(rest)))

    def _plain(self, text: str) -> bool:
        """Whether the pattern's classes are certain: Latin-1, printable but for line feeds, no special token's text."""
        if any(t in text for t in self.special) or not text.replace("\n", " ").isprintable():
            return False
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        return True

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; null is taken as empty."""
        for _, some in text_slices(texts):
            if len(self.known) > self.capacity:  # pieces still in use come back from the older ones
                self.known, self.older = {}, self.known
            part = [t or "" for t in some]
            if not self.leading_space and self._plain("\n".join(part)):
                yield from self._together(part)
                continue
            cut = [(True, self.cut(t if self.leading_space else t.lower())) if self._plain(t) else (False, [t]) for t in part]
            self._meet(set().union(*(pieces for plain, pieces in cut if plain)))
            known = self.known
            for plain, pieces in cut:
                yield b"".join(map(known.__getitem__, pieces)) if plain else next(self._ids(pieces))

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        """Plain texts in one go, with a mark between them that none of them holds."""
        pieces = self.cut(f" {self._MARK} ".join(texts).lower())
        self.known[self._MARK] = b"\xff\xff\xff\xff"
        self._meet(set(pieces))
        data = b"".join(map(self.known.__getitem__, pieces))
        at = 0
        for end in (4 * np.flatnonzero(np.frombuffer(data, dtype="<u4") == 0xFFFFFFFF)).tolist():
            yield data[at:end]
            at = end + 4
        yield data[at:]

    def _meet(self, pieces: set[str]) -> None:
        """Makes pieces known."""
        new = pieces - self.known.keys()
        if self.older:
            back = new & self.older.keys()
            self.known.update((p, self.older[p]) for p in back)
            new -= back
        self._learn(list(new))
