"""Mix sources to target weights by fitting each source's budget as a subset sum.

Every source gets a target number of words: its weight's share of all words, at most
``max_repeats`` times what it has; what is cut off goes to the others by weight.  A source
is repeated whole as often as its target allows.  The remaining budget is fitted on the
counts of its documents by exact length: each length gives its proportional share, rounded
down, then more documents until few words are missing, and a bounded-knapsack dynamic
programme over at most ``DP_BITS`` bits closes the gap; a small source is fitted by it alone.  Which documents of a length are taken is decided by a
seeded hash of doc_id, so reruns agree.

Only lengths and counts reach the fitting: one row per source and length, and one row per
source in the driver.  Ranks within a length are taken in hash buckets, as many as each has
rows beyond ``BUCKET_ROWS`` documents, so copies that share one length do not meet in one task.

Null text has size 0; null source is a source of its own, last in order; documents of size 0
take 0 words.  Rows with equal doc_id are ranked by their place in the files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.llm.rows import free_name, in_small_batches, scanned, with_row_key
from mnemoframe.operators.groups import stored

DP_BITS = 1 << 29
BUCKET_ROWS = 256
SIZE_SCHEMA = "doc_id long, source string, row_file long, row_number long, size long"
PLAN_SCHEMA = "source string, size long, n long, extra long, whole long"


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = pc.fill_null(batch.column("text").cast(pa.binary()), b"")
        sizes = [len(text.split()) for text in raw.to_pylist()]  # bytes split on ASCII white space
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "source", "row_file", "row_number")),
             pa.array(sizes, pa.int64())],
            names=["doc_id", "source", "row_file", "row_number", "size"])


def targets(
    sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), max_repeats: int = 3
) -> dict[str | None, float]:
    """Words wanted of each source, from the words it has."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, active, out = float(sum(sizes.values())), set(order), {}
    while active:
        total = sum(weight[s] for s in active)
        want = {s: left * weight[s] / total for s in active}
        over = {s for s in active if want[s] > max_repeats * sizes[s]}
        if not over:
            return out | want
        out |= {s: float(max_repeats * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        active -= over
    return out


def _closest(budget: int, lengths: list[int], counts: list[int]) -> dict[int, int]:
    """Bounded knapsack: documents by length whose sum is nearest to the budget, below in ties.

    Sums that can be reached are the bits of an integer, one integer kept per item; an item
    is a power of two of documents of one length.  Stops as soon as the budget is reached.
    """
    above = max([n for n in lengths if n <= 2 * budget], default=0)
    full = (1 << (budget + above + 1)) - 1
    reach, steps = 1, []
    for length, count in zip(lengths, counts):
        part, left = 1, min(count, (budget + above) // length)
        while left > 0 and not reach >> budget & 1:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & full
            left -= part
            part *= 2
    at = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    over = reach >> (budget + 1)
    next_up = budget + (over & -over).bit_length() if over else None
    if next_up is not None and next_up - budget < budget - at:
        at = next_up
    taken: dict[int, int] = {}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            at -= length * part
            taken[length] = taken.get(length, 0) + part
    return taken


def fit(budget: int, lengths: list[int], counts: list[int]) -> list[int]:
    """How many documents of each length to take, so that their words come near the budget."""
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    items = sum(c.bit_length() for c in counts)
    window = max(1 << 14, DP_BITS // items)
    take = [0] * len(lengths)
    if budget > window:
        take = [c * budget // total if n else 0 for n, c in zip(lengths, counts)]
    left = budget - sum(n * t for n, t in zip(lengths, take))
    by_rest = sorted(
        (i for i in range(len(lengths)) if lengths[i]),
        key=lambda i: (-(counts[i] * budget % total), -lengths[i]))
    for once in (True, False):  # one more of each length by largest remainder, then what fits
        for i in by_rest if once else sorted(by_rest, key=lambda i: -lengths[i]):
            wanted = -(-(left - window) // lengths[i])
            more = min(counts[i] - take[i], left // lengths[i], max(0, wanted), 1 if once else wanted)
            if more > 0:
                take[i] += more
                left -= more * lengths[i]
    place = {n: i for i, n in enumerate(lengths)}
    order = sorted(by_rest, key=lambda i: -lengths[i])
    for n, more in _closest(
            min(left, window), [lengths[i] for i in order],
            [counts[i] - take[i] for i in order]).items():
        take[place[n]] += more
    return take


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeats: int = 3, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per document: its size, its source's size and target, copies and words taken.

    Columns: doc_id, source, row_file, row_number, size, source_size, target, copies, taken.
    """
    spark = docs.sparkSession
    keyed, (file, row) = with_row_key(scanned(in_small_batches(docs)))
    narrow = keyed.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.col(file).alias("row_file"), F.col(row).alias("row_number"),
        F.col(text_col).cast("string").alias("text"))
    sized = stored(narrow.mapInArrow(_sizes, SIZE_SCHEMA))
    by_length = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    # one row per source: names and totals only
    held = {r["source"]: int(r["words"]) for r in sized.groupBy("source").agg(
        F.sum("size").alias("words")).collect()}
    wanted = targets(held, weights, max_repeats)

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        source = group["source"].iloc[0]
        source = None if pd.isna(source) else source
        group = group.sort_values("size")
        words, target = held[source], wanted[source]
        whole = min(int(target // words), max_repeats) if words else 0
        rest = round(target - whole * words) if whole < max_repeats else 0
        extra = fit(rest, group["size"].tolist(), group["n"].tolist()) if words else 0
        return group.assign(extra=extra, whole=whole)

    # a group is one source's distinct lengths, never its documents
    plans = by_length.groupBy("source").applyInPandas(plan, PLAN_SCHEMA)
    totals = spark.createDataFrame(
        [(s, held[s], wanted[s]) for s in held],
        "source string, source_size long, target double") if held else spark.createDataFrame(
        [], "source string, source_size long, target double")
    p, t = plans.alias("p"), totals.alias("t")
    plans = stored(p.join(t, F.col("p.source").eqNullSafe(F.col("t.source"))).select(
        F.coalesce("p.source", F.lit("")).alias("plan_source"),
        F.col("p.source").isNull().alias("plan_null"), F.col("size").alias("plan_size"),
        "n", "extra", "whole", "source_size", "target"))

    ranked_by = F.xxhash64(F.lit(seed).cast("long"), F.col("doc_id"))
    on = ((F.coalesce("source", F.lit("")) == F.col("plan_source"))
          & (F.col("source").isNull() == F.col("plan_null")) & (F.col("size") == F.col("plan_size")))
    n_buckets = F.when(F.col("n") > BUCKET_ROWS, F.ceil(F.sqrt("n"))).otherwise(1)
    rows = sized.join(plans, on).withColumn("hash", ranked_by).withColumn(
        "bucket", F.floor((F.col("hash") / F.lit(2.0 ** 64) + 0.5) * n_buckets))
    key = ["plan_source", "plan_null", "plan_size"]
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.filter(n_buckets > 1).groupBy(*key, "bucket").agg(
        F.count("*").alias("bucket_n")).select(
        *key, "bucket", F.coalesce(F.sum("bucket_n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*key, "bucket").orderBy(
        "hash", "doc_id", "row_number", "row_file")
    place = F.col("place") + F.coalesce("offset", F.lit(0))
    copies = F.col("whole") + F.when(place <= F.col("extra"), 1).otherwise(0)
    return (
        rows.withColumn("place", F.row_number().over(inside))
        .join(offsets, [*key, "bucket"], "left").withColumn("copies", copies)
        .select("doc_id", "source", "row_file", "row_number", "size", "source_size", "target",
                F.col("copies").cast("long").alias("copies"),
                (F.col("copies") * F.col("size")).cast("long").alias("taken")))


def mixed_rows(docs: DataFrame, **parameters) -> DataFrame:
    """The documents of the mix with all their columns, repeated rows numbered in ``copy``.

    A column of that name stays; the number's name then begins with an underscore.
    """
    docs = scanned(docs)
    chosen = mix(docs, **parameters).filter("copies > 0")
    keyed, (file, row) = with_row_key(docs)
    keys = chosen.select(F.col("row_file").alias(file), F.col("row_number").alias(row), "copies")
    numbers = F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix.copies")))
    own = keyed.alias("own")
    return own.join(
        keys.alias("mix"), (F.col(f"own.{file}") == F.col(f"mix.{file}"))
        & (F.col(f"own.{row}") == F.col(f"mix.{row}"))
    ).select(*[F.col(f"own.`{c}`") for c in docs.columns], numbers.alias(free_name(docs, "copy")))
