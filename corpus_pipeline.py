"""From documents to packed token sequences: classify, drop copies and near copies,
redact, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; run() writes
each result as Parquet and rereads it for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from honestpick.functions.lineage import shared_dir
from honestpick.llm import (exact_dedup, jaccard_join, packing, quality_classifier, queries,
                            secret_scan)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality; the model is trained on those with labels."""
    model = queries.quality_model(docs, queries.table(spark, sf_dir, "labels"))
    return quality_classifier.select(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.distinct_texts(docs)


def similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id."""
    return jaccard_join.one_of_each(docs, size=5, percent=75)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; a secret in a text becomes the name of its kind."""
    clean = secret_scan.redacted(docs)
    return queries.with_length(clean)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence."""
    return packing.pack(docs, queries.BPE_50K, length=2048)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", similar),
    ("secret scans", secrets),
    ("packing", pack),
]
ORACLE_SQL = None       # a trained model and a tokenizer are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
