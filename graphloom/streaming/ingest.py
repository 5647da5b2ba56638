"""Incremental ingest: a stream of documents, merged batch by batch as the same upserts that a batch run makes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..schema import GraphSchema
from ..store import GraphStore
from ..types import source_type


def read_document_stream(spark: SparkSession, path: str, root: type, files_per_trigger: int = 100) -> DataFrame:
    """New JSON documents (one a line, each with a _key) below a folder."""
    schema = T.StructType([T.StructField("_key", T.StringType()), *source_type(root).fields])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def ingest_stream(documents: DataFrame, store: GraphStore, schema: GraphSchema, checkpoint: str, dedup_edges: bool = True, available_now: bool = True) -> StreamingQuery:
    """Merges every micro-batch into the store. Batches keep their order: what comes later overwrites as a later
    document would; within a batch documents go by key. A batch that runs again merges to the same nodes, and with dedup_edges to the same edges."""

    def merge(batch: DataFrame, number: int) -> None:
        ordered = batch.withColumn("_ord", F.struct(F.lit(number).cast("long").alias("batch"), F.col("_key").alias("key")))
        store.add_documents(ordered, schema, dedup_edges=dedup_edges)

    writer = documents.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
