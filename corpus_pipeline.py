"""A corpus from documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents:

1. language: texts in no known language go.
2. near_duplicates: one document of each group of near copies stays.
3. secrets: secrets in texts are replaced by their kind.
4. mix: documents are repeated or left out so that sources come near their targets.
5. pack: pieces of documents and their places in sequences.

Null and letterless texts go in the first stage; of rows repeated whole one is left by the second; an empty table, or
one in which nothing is left, gives an empty table of the last stage's columns. Columns beside doc_id, text, lang and
source are carried along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import langid, mixing, packing, secret_scan, simhash
from graphloom.llm.common import scratch, shared_path
from graphloom.session import delete_path, make_importable


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    make_importable(spark)
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    make_importable(spark)
    return simhash.drop_near_duplicates(docs, distance=4, shingle=4, seed=42)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    make_importable(spark)
    return secret_scan.redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    make_importable(spark)
    return mixing.mixed_documents(docs, weights=(1.0, 2.0, 3.0), most_repeats=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    make_importable(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), leading_space=True, end_id=0, capacity=2048)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("pack", pack)]

#: SQL can express neither the fingerprints nor the tokens; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents in sf_dir."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        with scratch(spark):  # what a stage writes for itself goes when its rows are written
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return docs
