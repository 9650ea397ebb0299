"""Call a slow provider once per distinct text and keep what succeeded.

The cache is a Parquet table in buckets by the first digits of the key.  A refresh reads the
buckets its inputs touch and no others; of those only keys that a Bloom filter of the wanted
keys lets through meet the inputs in a join.  A key that concurrent fills stored twice counts
once; ``compact`` drops the repeats.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.functions.text import content_key, strip
from mnemoframe.operators.groups import materialize, stored
from mnemoframe.operators.hooks import call_provider

# hexadecimal digits of the key that name its bucket: 256 buckets
BUCKET_DIGITS = 2
# bits and hashes of the filter: 1 MB, 2 % false positives at about a million keys
FILTER_BITS = 1 << 23
FILTER_HASHES = 4


def cache_key(model: str, version: Column, text: Column) -> Column:
    return content_key(F.lit(model), version, text)


def bucket_of(key: Column) -> Column:
    return F.substring(key, 1, BUCKET_DIGITS)


def wanted_texts(inputs: DataFrame, text: str, key: str = "key") -> DataFrame:
    """Distinct keys of non-blank texts with one text each.

    Copies of a text collapse on the map side, so a much-repeated text is one row.
    """
    return inputs.filter(strip(F.col(text)) != "").groupBy(key).agg(
        F.min(strip(F.col(text))).alias(text))


def key_filter(keys: DataFrame, key: str = "key") -> np.ndarray:
    """A Bloom filter of the keys as 64-bit words; its size does not depend on their number."""
    places = [F.pmod(F.xxhash64(F.col(key), F.lit(k)), F.lit(FILTER_BITS))
              for k in range(FILTER_HASHES)]
    at = keys.select(F.explode(F.array(*places)).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def maybe_in(words: np.ndarray, key: Column) -> Column:
    """False only for keys that were not put into the filter."""
    @F.arrow_udf("boolean")
    def probe(*places: pa.Array) -> pa.Array:
        hit = np.ones(len(places[0]), dtype=bool)
        for at in places:
            at = at.to_numpy(zero_copy_only=False)
            hit &= (words[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) != 0
        return pa.array(hit)

    return probe(*[F.pmod(F.xxhash64(key, F.lit(k)), F.lit(FILTER_BITS))
                   for k in range(FILTER_HASHES)])


def read_buckets(
    spark: SparkSession, path: str, buckets: list[str], payload_type: str = "string"
) -> DataFrame:
    """Cache rows of some buckets; other buckets are not opened.  Empty before the first fill."""
    schema = f"key string, payload {payload_type}, bucket string"
    try:
        held = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # any other fault must not look like no cache
            raise
        held = spark.createDataFrame([], schema)
    return held.filter(F.col("bucket").isin(buckets))


def misses(wanted: DataFrame, held: DataFrame, key: str = "key") -> DataFrame:
    """Wanted texts whose key is not cached."""
    near = held.select(key).filter(maybe_in(key_filter(wanted, key), F.col(key)))
    return wanted.join(near, key, "left_anti")


def enrich_once(
    missing: DataFrame, text: str, provider: Callable[[pd.Series], pd.Series],
    payload_type: str = "string", key: str = "key",
) -> DataFrame:
    """New cache rows.  A failed call or a null from the provider is not kept; an empty
    result is a result."""
    def listed(texts: list) -> list:
        return list(provider(pd.Series(texts)))

    return call_provider(missing, [text], listed, payload_type).select(
        key, "payload").filter(F.col("payload").isNotNull())


def attach(inputs: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Add the payload; a key that concurrent fills stored twice counts once."""
    held = cache.groupBy(key).agg(F.min("payload").alias("payload"))
    return inputs.join(held, key, "left")


def refresh(
    spark: SparkSession, path: str, inputs: DataFrame, text: str,
    provider: Callable[[pd.Series], pd.Series], payload_type: str = "string",
) -> DataFrame:
    """Fill the cache table at ``path`` for ``inputs`` and return inputs with payloads."""
    wanted = materialize(wanted_texts(inputs, text))
    # at most 16 ** BUCKET_DIGITS values
    buckets = [r[0] for r in wanted.select(bucket_of(F.col("key"))).distinct().collect()]
    missing = misses(wanted, read_buckets(spark, path, buckets, payload_type))
    new = enrich_once(missing, text, provider, payload_type)
    new.withColumn("bucket", bucket_of(F.col("key"))).repartition("bucket").write.mode(
        "append").partitionBy("bucket").parquet(path)
    held = read_buckets(spark, path, buckets, payload_type).join(
        wanted.select("key"), "key", "left_semi")
    return attach(inputs, held)


def compact(spark: SparkSession, path: str, payload_type: str = "string") -> list[str]:
    """Rewrite the buckets that hold a key more than once; returns their names."""
    every = [f"{i:0{BUCKET_DIGITS}x}" for i in range(16 ** BUCKET_DIGITS)]
    held = read_buckets(spark, path, every, payload_type)
    repeated = held.groupBy("bucket", "key").count().filter("count > 1").select("bucket").distinct()
    buckets = sorted(r[0] for r in repeated.collect())
    if buckets:
        # written aside first, because a table cannot be replaced while it is read
        once = stored(read_buckets(spark, path, buckets, payload_type).groupBy(
            "key", "bucket").agg(F.min("payload").alias("payload")))
        once.repartition("bucket").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return buckets
