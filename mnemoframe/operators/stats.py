"""Paired statistics on aggregated rows, and resampling over question rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wilson_interval(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high); (0, 0) when there are no rows."""
    p = k / n
    denominator = 1 + z * z / n
    center = (p + z * z / (2 * n)) / denominator
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denominator
    empty = n == 0
    return F.struct(
        F.when(empty, 0.0).otherwise(center - half).alias("low"),
        F.when(empty, 0.0).otherwise(center + half).alias("high"))


def _log_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series, shifted by ten to be exact to double precision."""
    x = n.cast("double") + 11
    series = (
        (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi)
        + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0))))
    shift = F.lit(0.0)
    for i in range(1, 11):
        shift = shift + F.log(n.cast("double") + i)
    return series - shift


def exact_mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p on the discordant pairs; 1 when there are none.

    2 * sum over i <= k of C(n, i) / 2^n, built downwards from the largest term
    i = k.  Terms fall off like exp(-j^2 / n), so 40 * sqrt(n) of them are all that a
    double can hold, however large the counts.
    """
    n, k = b + c, F.least(b, c)
    n_terms = F.least(k, F.ceil(40 * F.sqrt(n)) + 50)
    one = F.lit(1).cast("long")
    tail = F.aggregate(
        F.sequence(one, F.greatest(n_terms, one)),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda acc, j: F.struct(
            (acc["term"] * (k - j + 1) / (n - k + j)).alias("term"),
            (acc["total"] + acc["term"] * (k - j + 1) / (n - k + j)).alias("total")),
        lambda acc: acc["total"],
    )
    log_largest = (
        _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) - n * math.log(2.0))
    p = 2 * F.exp(log_largest) * F.when(k > 0, tail).otherwise(1.0)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), p))


def mcnemar_chi2(b: Column, c: Column) -> Column:
    """Continuity-corrected chi-square; 0 when there are no discordant pairs."""
    n = b + c
    return F.when(n == 0, 0.0).otherwise(F.pow(F.abs(b - c) - 1, F.lit(2.0)) / n)


def chi2_p_value(chi2: Column) -> Column:
    """erfc(sqrt(x / 2)) on the few aggregated rows."""

    @F.pandas_udf("double")
    def survival(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(math.sqrt(v / 2)))

    return survival(chi2)


def mcnemar_table(counts: DataFrame) -> DataFrame:
    """Add net, exact p, chi-square and significance to b / c rows."""
    b, c = F.col("b"), F.col("c")
    exact = counts.withColumns({
        "net": c - b, "p_exact": exact_mcnemar(b, c), "chi2": mcnemar_chi2(b, c)})
    return exact.withColumn("significant", F.col("p_exact") < 0.05)


def accuracy_with_interval(rates: DataFrame) -> DataFrame:
    """Add accuracy and its Wilson interval to rows with k and n."""
    return rates.withColumn("_ci", wilson_interval(F.col("k"), F.col("n"))).withColumns({
        "accuracy": F.col("k") / F.nullif("n", F.lit(0)),
        "low": F.col("_ci.low"), "high": F.col("_ci.high")}).drop("_ci")


def holm_adjust(df: DataFrame, p: str, family: list[str] | None = None) -> DataFrame:
    """Holm and Bonferroni adjusted p-values within a family of tests.

    A family is a set of aggregated slices, so it is small.
    """
    keys = family or []
    frame = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    by_p = frame.orderBy(F.col(p), *[F.col(c) for c in df.columns if c != p])
    m = F.count("*").over(frame)
    ranked = df.withColumns({"_m": m, "_i": F.row_number().over(by_p)})
    scaled = F.least(F.lit(1.0), (F.col("_m") - F.col("_i") + 1) * F.col(p))
    return ranked.withColumn("_scaled", scaled).withColumns({
        "p_holm": F.max("_scaled").over(by_p.rowsBetween(Window.unboundedPreceding, 0)),
        "p_bonferroni": F.least(F.lit(1.0), F.col("_m") * F.col(p)),
    }).drop("_m", "_i", "_scaled")


def bootstrap_delta(
    pairs: DataFrame, replicates: int = 20_000, level: float = 0.95, salt: int = 0
) -> DataFrame:
    """Paired bootstrap interval of the accuracy difference (second - first).

    ``pairs`` has question_id, first and second (0/1).  A difference depends only on how
    many rows of each of the four outcomes a resample holds, so the rows are counted once
    and each replicate draws the four counts: n draws with replacement are one multinomial
    draw.  A replicate's generator is seeded by its number, so a rerun gives the same
    interval whatever the partitioning.
    """
    cells = pairs.groupBy(
        F.col("first").cast("int").alias("first"), F.col("second").cast("int").alias("second")
    ).agg(F.count("*").alias("n")).collect()  # four rows at most
    counts = np.array([c["n"] for c in cells], dtype=np.int64)
    gains = np.array([c["second"] - c["first"] for c in cells], dtype=np.int64)
    total = int(counts.sum())

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            drawn = [
                np.random.default_rng([salt, number]).multinomial(total, counts / total)
                for number in batch["id"]]
            yield pd.DataFrame({"delta": [float(d @ gains) / total for d in drawn]})

    spark = pairs.sparkSession
    observed = float(counts @ gains) / total if total else None
    tail = (1 - level) / 2
    deltas = spark.range(replicates if total else 0).mapInPandas(draw, "delta double")
    return deltas.agg(
        F.percentile("delta", F.lit(tail)).alias("low"),
        F.percentile("delta", F.lit(1 - tail)).alias("high"),
    ).select(F.lit(observed).cast("double").alias("delta"), "low", "high")


# ------------------------------------------------------------ gold-label measures


def precision_recall_at_k(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """recall@k and precision@k per question; both tables have query_id, mem_id."""
    wanted = gold.select("query_id", "mem_id").distinct()
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    shown = hits.filter(F.col("rank") <= k).select("query_id", "mem_id")
    found = (
        shown.join(wanted.withColumn("right", F.lit(1)), ["query_id", "mem_id"], "left")
        .groupBy("query_id")
        .agg(F.count("*").alias("n_shown"), F.count("right").alias("n_found")))
    joined = sizes.join(found, "query_id", "left").fillna(0, subset=["n_shown", "n_found"])
    return joined.select(
        "query_id", "n_gold", "n_shown", "n_found",
        (F.col("n_found") / F.col("n_gold")).alias("recall"),
        F.coalesce(F.col("n_found") / F.nullif("n_shown", F.lit(0)), F.lit(0.0))
        .alias("precision"))


def supersession_latency(changes: DataFrame) -> DataFrame:
    """Observations between a memory and the one that supersedes it, per scope."""
    return changes.filter(F.col("rel") == "supersedes").groupBy("scope_id").agg(
        F.count("*").alias("n"),
        F.avg(F.col("newer_seq") - F.col("older_seq")).alias("mean_latency"),
        F.max(F.col("newer_seq") - F.col("older_seq")).alias("max_latency"))


def edge_precision(edges: DataFrame, gold_pairs: DataFrame) -> DataFrame:
    """Per relation: edges, edges confirmed by gold pairs, precision, false-positive rate."""
    gold = gold_pairs.select("scope_id", "src_id", "dst_id").distinct().withColumn(
        "right", F.lit(1))
    return edges.join(gold, ["scope_id", "src_id", "dst_id"], "left").groupBy("rel").agg(
        F.count("*").alias("n"), F.count("right").alias("n_right"),
        (F.count("right") / F.count("*")).alias("precision"),
        (1 - F.count("right") / F.count("*")).alias("false_positive_rate"))


def extraction_rate(
    gold: DataFrame, found: DataFrame, keys: list[str], by: list[str] | None = None
) -> DataFrame:
    """Share of gold mentions that were extracted; ``by`` names keys to report apart.

    Both kinds of rows meet in one aggregate, cut to one row per key before the shuffle.
    """
    marked = gold.select(*keys, F.lit(True).alias("_gold"), F.lit(False).alias("_found")).union(
        found.select(*keys, F.lit(False), F.lit(True)))
    # a mention with an unknown key equals no other
    known = reduce(and_, (F.col(k).isNotNull() for k in keys))
    met = marked.groupBy(*keys).agg(
        F.max("_gold").alias("_gold"), F.max("_found").alias("_found")).filter("_gold")
    n_found = F.count_if(F.col("_found") & known)
    return met.groupBy(*(by or [])).agg(
        F.count("*").alias("n_gold"), n_found.alias("n_found"),
        (n_found / F.count("*")).alias("rate"))
