"""Calls of user-supplied providers: bounded batches, retries, failures per row, each text once.

A provider takes lists (one per input column) and returns one result per row.  It is called on
at most ``batch_rows`` rows.  If a call fails (an exception, or another number of results) it is
tried again; if it keeps failing its rows are called one by one, so that one bad row costs no
other its result.  A row that fails every time, or whose result is None, gets null and the
reason; a job never fails because of a provider.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.operators.groups import in_small_batches, materialize

BATCH_ROWS = 64
ATTEMPTS = 3


def _tried(provider: Callable, columns: list[list], attempts: int):
    """(results, None) of one call, or (None, reason) after the last attempt."""
    reason = None
    for _ in range(attempts):
        try:
            results = list(provider(*columns))
            if len(results) == len(columns[0]):
                return results, None
            reason = f"{len(results)} results for {len(columns[0])} rows"
        except Exception as error:  # a provider must never break the job
            reason = f"{type(error).__name__}: {error}"
    return None, reason


def results_of(
    provider: Callable, columns: list[list], batch_rows: int = BATCH_ROWS,
    attempts: int = ATTEMPTS,
) -> tuple[list, list]:
    """Results and failure reasons of all rows, in order."""
    results: list = []
    reasons: list = []
    for at in range(0, len(columns[0]), batch_rows):
        part = [c[at:at + batch_rows] for c in columns]
        found, reason = _tried(provider, part, attempts)
        if found is None and len(part[0]) > 1:
            for row in zip(*part):
                one, why = _tried(provider, [[x] for x in row], attempts)
                results.append(one[0] if one else None)
                reasons.append(why or ("no result" if one[0] is None else None))
            continue
        found = found or [None]
        results += found
        reasons += [reason or ("no result" if x is None else None) for x in found]
    return results, reasons


def call_provider(
    df: DataFrame, inputs: list[str], provider: Callable, result_type: str,
    result: str = "payload", reason: str = "failure", batch_rows: int = BATCH_ROWS,
    attempts: int = ATTEMPTS,
) -> DataFrame:
    """Add the provider's result and, where there is none, the reason."""
    @F.pandas_udf(f"result {result_type}, reason string")
    def call(*columns: pd.Series) -> pd.DataFrame:
        found, why = results_of(
            provider, [c.tolist() for c in columns], batch_rows, attempts)
        return pd.DataFrame({"result": pd.Series(found, dtype=object),
                             "reason": pd.Series(why, dtype=object)})

    # texts may be long, so that the rows of a batch do not bound its size
    called = in_small_batches(df).withColumn("_called", call(*[F.col(c) for c in inputs]))
    return called.withColumn(result, F.col("_called.result")).withColumn(
        reason, F.col("_called.reason")).drop("_called")


def call_once(
    df: DataFrame, inputs: list[str], provider: Callable, result_type: str,
    result: str = "payload", **options,
) -> DataFrame:
    """Like ``call_provider``, but equal inputs are one call; rows with null inputs are none.

    Calls are made once and kept, so that readers of the result do not repeat them.
    """
    key = F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in inputs])), 256)
    usable = ~F.greatest(*[F.col(c).isNull() for c in inputs], F.lit(False))
    keyed = df.withColumn("_key", F.when(usable, key))
    distinct = keyed.filter("_key is not null").groupBy("_key").agg(
        *[F.first(c).alias(c) for c in inputs])
    called = materialize(call_provider(
        distinct, inputs, provider, result_type, result, **options
    ).drop(*inputs))
    return keyed.join(called, "_key", "left").drop("_key")
