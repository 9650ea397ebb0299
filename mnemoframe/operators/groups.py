"""Group-wise ordering that stays safe when one group holds much of the data.

A plain window sorts every group in one task.  The helpers here work in two levels:
bounded chunks are handled in parallel and only one summary row per chunk is combined.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# consecutive numbers that one window of ``next_in_group`` may hold
CHUNK_ROWS = 1 << 16
# rows of a group that one task sorts
GROUP_ROWS = 1 << 18
# Spark limits a top-k before the shuffle by itself up to this k
NATIVE_TOP_K = 1_000
BATCH_BYTES = "4m"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    One is made up only on a local master, where all tasks run on this machine;
    a cluster that names none gets an error instead of files no other node can read.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and context.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="mnemoframe-")
        context.setCheckpointDir(named)
    return named


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    folder = shared_folder(spark)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet in the shared folder and read them back.

    Like ``materialize``, but compressed and with column pruning for the readers.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_small_batches(df: DataFrame) -> DataFrame:
    """Have the session hand texts to Python in Arrow batches of about 4 MB.

    The batches that a task holds at once, in the JVM and in Python, are what grows with the
    length of texts; Spark's own bound is 64 MB.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def by_shuffle(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the input, never broadcast.

    Spark counts an array as one element, so rows with vectors or token lists look small to it
    and would pass whole through the driver.
    """
    return df.hint("merge")


def number_in_group(
    df: DataFrame, keys: list[str], order: list, name: str, scanned: bool = False,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Add the dense 1-based position of each row in its group.

    ``order`` must be total within a group.  ``scanned`` tells that ``df`` is a plain table,
    cheap to read again: then groups of at most ``group_rows`` rows are sorted whole, with one
    shuffle of the rows, and only larger ones in ranges.
    """
    if not scanned:
        return _number_in_ranges(df, keys, order, name)
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    # at most one row per ``group_rows`` rows of the table
    large = stored(counts.filter(F.col("_n") > group_rows).select(*keys))
    whole = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    if large.isEmpty():
        return df.withColumn(name, whole)
    large = large.select(*[F.col(k).alias(f"_large_{k}") for k in keys])
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_large_{k}")) for k in keys))
    few = df.join(F.broadcast(large), same, "left_anti").withColumn(name, whole)
    many = df.join(F.broadcast(large), same, "left_semi")
    return few.unionByName(_number_in_ranges(many, keys, order, name))


def _number_in_ranges(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """The positions of rows of large groups.

    The rows are range-partitioned on keys and order; each range numbers its own rows and
    only groups that cross a range boundary need an offset, so the offset table has at most
    two rows per range and no group, however large, meets in one task.
    """
    n_ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_ranges = max(n_ranges, 2 * df.sparkSession.sparkContext.defaultParallelism)
    # fixed once, because range boundaries are sampled
    ranged = stored(
        df.repartitionByRange(n_ranges, *keys, *order).withColumn("_range", F.spark_partition_id()))
    local = ranged.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    )
    per_range = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    spread = per_range.withColumn(
        "_ranges", F.count("*").over(Window.partitionBy(*keys))
    ).filter("_ranges > 1")
    offsets = spread.select(
        *keys, "_range",
        F.coalesce(
            F.sum("_n").over(
                Window.partitionBy(*keys).orderBy("_range").rowsBetween(
                    Window.unboundedPreceding, -1)
            ), F.lit(0),
        ).alias("_offset"),
    )
    # at most two rows per range, whatever the data size
    return (
        local.join(F.broadcast(offsets), [*keys, "_range"], "left")
        .withColumn(name, (F.col("_local") + F.coalesce("_offset", F.lit(0))).cast("long"))
        .drop("_range", "_local", "_offset")
    )


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank.

    Spark cuts each map task's rows of a group to ``k`` before the shuffle, so a
    hot group never reaches one task whole.  For a ``k`` above Spark's own limit a
    salted first pass does the same.
    """
    if k > NATIVE_TOP_K:
        salt = F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.lit(64))
        salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_first", F.row_number().over(salted))
            .filter(F.col("_first") <= k).drop("_salt", "_first")
        )
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, ranked).filter(F.col(rank) <= k)


def next_in_group(
    df: DataFrame, keys: list[str], seq: str, name: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add the next higher ``seq`` in the group, or null for the last row.

    ``seq`` is unique in a group, so a chunk of ``chunk_rows`` consecutive numbers
    bounds every window.  The last row of a chunk takes the first ``seq`` of the
    next chunk that has rows of the group.  Reads ``df`` twice.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(seq) / chunk_rows))
    inside = F.lead(seq).over(Window.partitionBy(*keys, "_chunk").orderBy(seq))
    firsts = chunked.groupBy(*keys, "_chunk").agg(F.min(seq).alias("_first_seq"))
    # one row per chunk of a group
    earlier = F.lag("_chunk").over(Window.partitionBy(*keys).orderBy("_chunk"))
    following = firsts.withColumn("_earlier", earlier).filter("_earlier is not null").select(
        *keys, "_first_seq", F.col("_earlier").alias("_chunk"))
    return (
        chunked.withColumn("_inside", inside)
        .join(following, [*keys, "_chunk"], "left")
        .withColumn(name, F.coalesce("_inside", "_first_seq"))
        .drop("_chunk", "_inside", "_first_seq")
    )
