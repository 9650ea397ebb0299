"""Deterministic stratified sampling with largest-remainder allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.operators.groups import top_k


def allocate(instances: DataFrame, size: int) -> DataFrame:
    """(question_type, n, take): proportional shares, remainders by fraction.

    Ties between equal fractions go to the later type name.  The integer arithmetic
    avoids comparing rounded fractions.
    """
    types = instances.groupBy("question_type").agg(F.count("*").alias("n"))
    everyone = Window.partitionBy(F.lit(0))  # one row per type
    total = F.sum("n").over(everyone)
    shares = types.withColumn("total", total).withColumns({
        "base": F.floor(F.lit(size) * F.col("n") / F.col("total")).cast("long"),
        "left_over": F.pmod(F.lit(size).cast("long") * F.col("n"), F.col("total")),
    })
    order = everyone.orderBy(F.desc("left_over"), F.desc("question_type"))
    remaining = F.lit(size) - F.sum("base").over(everyone)
    take = F.col("base") + F.when(
        F.row_number().over(order) <= remaining, 1).otherwise(0)
    return shares.withColumn("take", F.least("n", take)).select(
        "question_type", "n", F.when(F.col("total") <= size, F.col("n"))
        .otherwise(F.col("take")).alias("take"))


def stratified_sample(instances: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """(question_id, question_type) of the sample.

    Within a type the order follows a hash of seed and id, so the same ids come out
    however the rows are partitioned.  No type can give more than ``size`` rows, which
    bounds what leaves each task.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "question_id"))
    ordered = instances.select("question_id", "question_type", key.alias("_key"))
    first = top_k(
        ordered, ["question_type"], [F.asc("_key"), F.asc("question_id")], size, "_rank")
    # one row per question type
    return first.join(F.broadcast(allocate(instances, size)), "question_type").filter(
        F.col("_rank") <= F.col("take")).select("question_id", "question_type")


def not_done(sample: DataFrame, records: DataFrame) -> DataFrame:
    """Resume: sampled questions without a done record."""
    done = records.filter("status = 'done'").select("question_id")
    return sample.join(done, "question_id", "left_anti")
