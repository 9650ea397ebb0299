"""SHA-256 fingerprints of files and id sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "length",
        F.sha2("content", 256).alias("sha256"))


def sample_fingerprint(ids: DataFrame, column: str, expected: str | None = None) -> DataFrame:
    """SHA-256 of the newline-joined sorted ids, compared with a pinned value.

    For a drawn sample, whose size is a parameter of the drawing; the ids meet in one string.
    """
    joined = F.concat_ws("\n", F.array_sort(F.collect_list(column)))
    return _compared(ids.agg(F.count("*").alias("n"), F.sha2(joined, 256).alias("sha256")), expected)


def id_set_fingerprint(ids: DataFrame, column: str, expected: str | None = None) -> DataFrame:
    """A fingerprint of any number of ids in any order, compared with a pinned value.

    Four sums over pieces of the ids' SHA-256 digests, hashed; sums are combined map-side.
    """
    digest = F.sha2(F.col(column).cast("string"), 256)
    pieces = [
        F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
        for i in range(4)]
    joined = F.concat_ws(":", *[F.coalesce(p, F.lit(0)).cast("string") for p in pieces])
    return _compared(ids.agg(F.count("*").alias("n"), F.sha2(joined, 256).alias("sha256")), expected)


def _compared(hashed: DataFrame, expected: str | None) -> DataFrame:
    return hashed.withColumn(
        "matches", F.lit(None).cast("boolean") if expected is None
        else F.col("sha256") == expected)
