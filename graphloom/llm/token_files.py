"""Token-ID output: documents as independent zstandard frames with a trailing seek table and per-frame checksums.

A shard file is the documents' frames, in ascending doc_id order, and then one zstandard skippable frame that holds
the seek table, so that a plain zstandard reader still sees only token ids:

    frame 0 | frame 1 | ... | magic 0x184D2A5E (4) | length (4) | entries (n * 28) | partition (4) | sequence (4) | n (4) | id width (1) | "ZTOK"

All numbers are little-endian. An entry is doc_id (8, signed), 1 if the doc_id is null (4), compressed bytes (4),
decompressed bytes (4), tokens (4) and the CRC-32 of the frame's decompressed bytes (4). A frame holds one document's
ids as unsigned integers of the id width (2 where the vocabulary allows, else 4). Readers take the last 17 bytes, then
the table, then only the frames they want.

Files are written by Spark's own writer (one record a file; the closing "ZTOK" is the record separator), so they
land, committed task by task, in whatever store holds the shared folder.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import encoder, n_partitions, shared_path, written

TAIL = "ZTOK"
SKIPPABLE = 0x184D2A5E
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "<u4"), ("packed", "<u4"), ("size", "<u4"), ("tokens", "<u4"), ("crc", "<u4")])
FOOTER = struct.Struct("<IIIB4s")


class ShardBuilder:
    """Collects documents and yields the bytes of a shard without its closing tail, which the writer adds."""

    def __init__(self, width: int, level: int = 1):
        import zstandard

        self.width, self.packer = width, zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.clear()

    def clear(self) -> None:
        self.frames: list[bytes] = []
        self.entries: list[tuple] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(f"<u{self.width}").tobytes()
        frame = self.packer.compress(raw)
        self.frames.append(frame)
        self.entries.append((doc_id or 0, doc_id is None, len(frame), len(raw), len(ids), zlib.crc32(raw)))
        self.size += len(frame)

    def build(self, partition: int, sequence: int) -> bytes:
        table = np.array(self.entries, dtype=ENTRY).tobytes()
        footer = FOOTER.pack(partition, sequence, len(self.entries), self.width, TAIL.encode())
        out = b"".join([*self.frames, struct.pack("<II", SKIPPABLE, len(table) + FOOTER.size), table, footer[: -len(TAIL)]])
        self.clear()
        return out


class Shard:
    """Reads one shard from ``read(start, length)`` and its total size; only what is asked for is read and decompressed."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        import zstandard

        self.read, self.unpack = read, zstandard.ZstdDecompressor()
        if size < FOOTER.size + 8:
            raise ValueError("not a token shard: too short")
        self.partition, self.sequence, n, self.width, tail = FOOTER.unpack(read(size - FOOTER.size, FOOTER.size))
        if tail != TAIL.encode():
            raise ValueError("not a token shard: no tail")
        at = size - FOOTER.size - n * ENTRY.itemsize
        if at < 8 or struct.unpack("<II", read(at - 8, 8)) != (SKIPPABLE, n * ENTRY.itemsize + FOOTER.size):
            raise ValueError("not a token shard: broken seek table")
        self.entries = np.frombuffer(read(at, n * ENTRY.itemsize), dtype=ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])

    @classmethod
    def of_bytes(cls, content) -> Shard:
        view = memoryview(content)
        return cls(lambda start, length: bytes(view[start : start + length]), len(view))

    @classmethod
    def of_file(cls, path: str) -> Shard:
        import os

        def read(start: int, length: int) -> bytes:
            with open(path, "rb") as f:
                f.seek(start)
                return f.read(length)

        return cls(read, os.path.getsize(path))

    def ids(self, i: int) -> np.ndarray:
        """The token ids of the shard's i-th document, checked against its checksum."""
        _, _, packed, size, _, crc = self.entries[i].item()
        raw = self.unpack.decompress(self.read(int(self.starts[i]), packed), max_output_size=max(1, size))
        if len(raw) != size or zlib.crc32(raw) != crc:
            raise ValueError(f"frame {i} of shard {self.partition}.{self.sequence} is damaged")
        return np.frombuffer(raw, dtype=f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int | None) -> list[int]:
        """Places of a document; doc_ids ascend, null first."""
        n_null = int(self.entries["null"].sum())
        if doc_id is None:
            return list(range(n_null))
        keys = self.entries["doc_id"][n_null:]
        return list(range(n_null + int(np.searchsorted(keys, doc_id, "left")), n_null + int(np.searchsorted(keys, doc_id, "right"))))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, leading_space: bool, end_id: int, shard_bytes: int = 8_000_000, partitions: int | None = None) -> str:
    """Encodes whole texts, appends end_id to each and writes shards under path, in ascending doc_id order over the
    files (partition, then sequence). docs needs doc_id and text; other columns are ignored.

    Null texts are empty (a document of end_id alone); a null doc_id comes first; rows of one doc_id follow by text,
    repeated rows are all kept; an empty table writes no shard. The table is dealt out by range of doc_id (and of the
    text's hash, so that many rows of one doc_id are no burden), encoded where it lands and written from there: one
    shuffle of the texts, none of the ids.
    """
    spark = docs.sparkSession
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = dealt.withColumn("h", F.xxhash64("text")).repartitionByRange(partitions or n_partitions(spark), F.col("doc_id").asc_nulls_first(), F.col("h"))
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, leading_space)
        builder = ShardBuilder(2 if max(encode.vocabulary, end_id + 1) <= 1 << 16 else 4)
        partition, sequence = TaskContext.get().partitionId(), 0
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            ids = encode.encode(batch.column("text"))
            for doc_id, one in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                builder.add(doc_id, np.frombuffer(one + end, dtype="<u4"))
                if builder.size >= shard_bytes:
                    yield pa.RecordBatch.from_pydict({"content": pa.array([builder.build(partition, sequence)], pa.binary())})
                    sequence += 1
        if builder.entries:
            yield pa.RecordBatch.from_pydict({"content": pa.array([builder.build(partition, sequence)], pa.binary())})

    out = dealt.select("doc_id", "text").mapInArrow(shards, "content binary")
    out.select(F.col("content").cast("string")).write.option("lineSep", TAIL).option("maxRecordsPerFile", 1).option("compression", "none").text(path)
    return path


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """One row per document of the files under path: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and, if asked for, ids. With doc_ids only the
    frames of those documents are decompressed. Frames are verified; a damaged one raises."""
    files = spark.read.format("binaryFile").load(path).select("content")
    wanted = None if doc_ids is None else sorted(set(doc_ids))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Shard.of_bytes(x.as_buffer()) for x in batch.column("content")]
            yield pa.RecordBatch.from_pydict({"p": pa.array([s.partition for s in found], pa.int64()), "q": pa.array([s.sequence for s in found], pa.int64()), "tokens": pa.array([int(s.entries["tokens"].sum(dtype=np.int64)) for s in found], pa.int64())})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("content"):
                s = Shard.of_bytes(x.as_buffer())
                places = range(len(s.entries)) if wanted is None else [i for d in wanted for i in s.find(d)]
                starts = np.concatenate([[0], np.cumsum(s.entries["tokens"], dtype=np.int64)])
                for a in range(0, len(places), 4096):
                    some = list(places[a : a + 4096])
                    ids = [s.ids(i) for i in some]
                    e = s.entries[some]
                    columns = {
                        "p": pa.array([s.partition] * len(some), pa.int64()),
                        "q": pa.array([s.sequence] * len(some), pa.int64()),
                        "doc_id": pa.array(e["doc_id"], pa.int64(), mask=e["null"].astype(bool)),
                        "local": pa.array(starts[some], pa.int64()),
                        "n_tokens": pa.array(e["tokens"].astype("int64"), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pc.cast(pa.array([x.astype("int64") for x in ids], pa.list_(pa.int64())), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(columns)

    found = files.mapInArrow(rows, "p long, q long, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    if wanted is None and not with_ids:
        found = written(found, "found")  # small, and its sums are the shards' totals: the files are read once
        sums = found.groupBy("p", "q").agg(F.sum("n_tokens").alias("tokens"))
    else:
        sums = files.mapInArrow(totals, "p long, q long, tokens long")
    # one row per shard meets in one task here: a shard holds thousands of documents
    base = F.coalesce(F.sum("tokens").over(Window.orderBy("p", "q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select("p", "q", base.alias("base"))
    return found.join(bases, ["p", "q"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_file_digest(docs: DataFrame, tokenizer_path: str, leading_space: bool, end_id: int) -> DataFrame:
    """Writes docs as token files in the shared folder and returns what the files say of each document."""
    spark = docs.sparkSession
    path = write_token_files(docs, shared_path(spark, "tokens"), tokenizer_path, leading_space, end_id)
    return read_token_files(spark, path)
