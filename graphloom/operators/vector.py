"""Text chunks, embeddings and exact cosine search over columns of vectors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a Markdown text may be parted, the best places first.
SEPARATORS = ("\n# ", "\n## ", "\n### ", "\n\n", "\n", ". ", " ")


def chunk_text(text: str, size: int = 2000, overlap: int = 500, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """Ranges of at most size characters that cover a text. A range ends at the best separator in its second half, and
    the next one begins up to overlap characters before that end, at a word where there is one."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            for s in separators:
                k = text.rfind(s, at + max(size // 2, overlap + 1), end)
                if k > 0:
                    end = k + (0 if s.startswith("\n") else len(s))
                    break
        out.append((at, end))
        if end == len(text):
            break
        begin = max(at + 1, end - overlap)
        word = text.find(" ", begin, end)
        at = word + 1 if 0 <= word < end - 1 and begin > at + 1 else begin
    return out


def chunk_documents(docs: DataFrame, id_column: str = "filename", text_column: str = "content", size: int = 2000, overlap: int = 500) -> DataFrame:
    """id, location ("start:end") and text of every chunk. A null text has none."""
    kind = docs.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, texts = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in chunk_text(text or "", size, overlap):
                    ids.append(i)
                    places.append(f"{a}:{b}")
                    texts.append(text[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(places, pa.string()), pa.array(texts, pa.string())], names=[id_column, "location", "text"])

    return docs.select(id_column, F.col(text_column).cast("string")).mapInArrow(run, f"`{id_column}` {kind.simpleString()}, location string, text string")


def hash_embedding(text: str, dimensions: int = 768) -> list[float]:
    """A unit vector that depends on the text's words only: each adds a signed one at a hashed place."""
    v = [0.0] * dimensions
    for w in text.lower().split():
        h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
        v[h % dimensions] += 1.0 if h >> 63 else -1.0
    n = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / n for x in v]


Embedder = Callable[[list[str]], list[list[float]]]


def fake_embedder(dimensions: int = 768) -> Embedder:
    return lambda texts: [hash_embedding(t, dimensions) for t in texts]


def embed(rows: DataFrame, text_column: str = "text", embedder: Embedder | None = None) -> DataFrame:
    """rows with an embedding column; the embedder gets a batch of texts."""
    f = embedder or fake_embedder()

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(f(texts.fillna("").tolist()))

    return rows.withColumn("embedding", run(F.col(text_column)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if either is zero."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def top_k(vectors: DataFrame, query: list[float], k: int = 5, tie: str | None = None) -> DataFrame:
    """The k rows nearest to a vector by cosine, with their score (the cosine), nearest first."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.withColumn("score", F.lit(1.0) - cosine_distance(F.col("embedding"), q)).filter(F.col("score").isNotNull())
    return rows.orderBy(F.desc("score"), *([F.col(tie)] if tie else [])).limit(k)


def preview(text: Column, length: int = 200) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


class VectorStore:
    """Chunks with embeddings as Parquet, one row for each (id, location); later writes of an id replace its chunks."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None):
        self.spark, self.path, self.embedder = spark, path.rstrip("/"), embedder or fake_embedder()

    def read(self) -> DataFrame | None:
        from ..store import Files

        files = Files(self.spark)
        pointer = f"{self.path}/current"
        return self.spark.read.parquet(f"{self.path}/{files.read(pointer).strip()}") if files.exists(pointer) else None

    def add(self, docs: DataFrame, id_column: str = "filename", text_column: str = "content", size: int = 2000, overlap: int = 500) -> DataFrame:
        import uuid

        from ..store import Files

        new = embed(chunk_documents(docs, id_column, text_column, size, overlap), "text", self.embedder).dropDuplicates([id_column, "location"])
        old = self.read()
        if old is not None:
            new = old.join(docs.select(id_column).distinct(), id_column, "left_anti").unionByName(new)
        version = uuid.uuid4().hex
        new.write.parquet(f"{self.path}/{version}")
        Files(self.spark).write(f"{self.path}/current", version)
        return self.read()

    def search(self, query: str, k: int = 5) -> DataFrame:
        """The k chunks nearest to a text, with score, nearest first."""
        found = self.read()
        if found is None:
            raise ValueError("nothing has been added yet")
        return top_k(found, self.embedder([query])[0], k).drop("embedding")
