"""Comparing memory policies over the same observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe import constants as C


def memories_per_policy(candidates: DataFrame, policies: DataFrame) -> DataFrame:
    """Memories every policy keeps: its threshold is at most the confidence.

    Policies are a handful of named settings; each candidate row is repeated once
    per policy inside its own task.
    """
    rules = [
        (r["name"], float(r["extraction_confidence_threshold"]))
        for r in policies.select("name", "extraction_confidence_threshold").collect()
    ]
    listed = F.array(*[
        F.struct(F.lit(name).alias("policy"), F.lit(limit).alias("threshold"))
        for name, limit in rules])
    return candidates.withColumn("_p", F.explode(listed)).filter(
        F.col("confidence") >= F.col("_p.threshold")
    ).withColumn("policy", F.col("_p.policy")).drop("_p")


def count_by_policy(kept: DataFrame) -> DataFrame:
    """Memory counts per policy: one column per type and the total."""
    return kept.groupBy("policy").agg(
        *[F.count_if(F.col("mem_type") == t).alias(f"n_{t}") for t in C.MEMORY_TYPES],
        F.count("*").alias("total"))


def policy_diff(first: DataFrame, second: DataFrame) -> DataFrame:
    """Full comparison on (scope, observation, type): added, removed, changed."""
    keys = ["scope_id", "obs_id", "mem_type"]

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(
            *keys, F.struct("content", "confidence", "status").alias(tag))

    joined = side(first, "before").join(side(second, "after"), keys, "full_outer")
    change = (
        F.when(F.col("before").isNull(), "added")
        .when(F.col("after").isNull(), "removed")
        .when(~F.col("before").eqNullSafe(F.col("after")), "changed"))
    return joined.select(
        *keys, change.alias("change"),
        F.col("before.status").alias("status_before"),
        F.col("after.status").alias("status_after"),
    ).filter(F.col("change").isNotNull())


def policy_yield(counts: DataFrame, accuracy: DataFrame, base: str, other: str) -> DataFrame:
    """Extra memories and accuracy difference of one policy against another."""
    joined = counts.join(accuracy, "policy")

    def of(name: str, column: str):
        return F.max(F.when(F.col("policy") == name, F.col(column)))

    return joined.agg(
        (of(other, "total") - of(base, "total")).alias("extra_memories"),
        (of(other, "accuracy") - of(base, "accuracy")).alias("accuracy_delta"))
