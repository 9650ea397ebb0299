"""The registry of this package's queries: a Spark function and its SQL check, if any."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a function under its own name."""
    def register(run):
        CATALOG[run.__name__] = Query(run, sql)
        return run

    return register


def load() -> dict[str, Query]:
    from mnemoframe.llm import queries  # noqa: F401  (registers the queries)

    CATALOG["pipeline"] = Query(corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)
    return CATALOG
