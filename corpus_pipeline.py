"""The corpus pipeline: documents in, the training mix out.

Each stage reads the Parquet files its predecessor wrote, works on all of their rows, and
returns a DataFrame.  All but the last return the columns of the documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from mnemoframe.operators.groups import shared_folder


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking scores at least 0.3, learned as in the query."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learnable = ~quality.held_out(F.col("doc_id"), 5, 0)
    return quality.keep(docs, quality.train(quality.narrow(docs), labels, learnable))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that differ in white space only, the longest stays."""
    return exact_dedup.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays."""
    return near_dedup.kept_rows(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1 in turn; a document that the mix repeats comes repeatedly."""
    return mixing.mixed_rows(docs)


STAGES = [
    ("quality classifier", keep_good_quality),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("source mix", mix_sources),
]

# the stages are a trained model, hash sketches and a fitted subset: no SQL expresses them
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
