"""Nested conversation splits, JSON-lines fixtures, turns and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe import schemas
from mnemoframe.operators.groups import number_in_group
from mnemoframe.sources.json_array import read_array


def read_split(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """Read nested instances: one JSON array per file, or one instance per line.

    Either form is read by byte ranges, so one large file makes many tasks.
    """
    if json_lines:
        return spark.read.schema(schemas.INSTANCE).json(path)
    return read_array(spark, path, schemas.INSTANCE)


def instances(nested: DataFrame) -> DataFrame:
    """One row per question with its flags; no turns."""
    return nested.select(
        "question_id", "question_type", "question",
        F.coalesce("answer", F.lit("")).alias("answer"),
        "question_date",
        F.coalesce("answer_session_ids", F.array().cast("array<string>"))
        .alias("answer_session_ids"),
        is_abstention(F.col("question_id")).alias("is_abstention"),
    )


def turns(nested: DataFrame) -> DataFrame:
    """One row per turn; ids and dates are matched to sessions by position."""
    sessions = nested.select(
        F.col("question_id").alias("scope_id"),
        "haystack_session_ids", "haystack_dates",
        F.posexplode("haystack_sessions").alias("session_pos", "session"),
    )
    named = sessions.select(
        "scope_id", "session_pos",
        F.coalesce(
            F.get("haystack_session_ids", "session_pos"),
            F.concat(F.lit("session_"), F.col("session_pos")),
        ).alias("session_id"),
        F.get("haystack_dates", "session_pos").alias("session_date"),
        "session",
    )
    return named.select(
        "scope_id", "session_pos", "session_id", "session_date",
        F.posexplode("session").alias("turn_index", "turn"),
    ).select(
        "scope_id", "session_pos", "session_id", "session_date", "turn_index",
        F.coalesce("turn.role", F.lit("")).alias("role"),
        F.coalesce("turn.content", F.lit("")).alias("content"),
        F.coalesce("turn.has_answer", F.lit(False)).alias("has_answer"),
    )


def parse_session_date(text: Column) -> Column:
    """'2023/05/20 (Sat) 02:21', '2023/05/20 02:21' or '2023/05/20'; else null."""
    plain = F.regexp_replace(text, r" \([A-Za-z]{3}\) ", " ")
    return F.coalesce(
        F.try_to_timestamp(plain, F.lit("yyyy/M/d H:m")),
        F.try_to_timestamp(text, F.lit("yyyy/M/d")),
    )


def is_abstention(question_id: Column) -> Column:
    return F.endswith(question_id, F.lit("_abs"))


def filter_question_type(df: DataFrame, question_type: str | None) -> DataFrame:
    return df if question_type is None else df.filter(F.col("question_type") == question_type)


def observations(all_turns: DataFrame, source: str = "conversation") -> DataFrame:
    """Turns -> observations numbered in log order.

    Sessions are put in date order only when every session of the scope has a
    date; otherwise the source order stays.  Turns without content are dropped.
    """
    dated = all_turns.withColumn("session_at", parse_session_date(F.col("session_date")))
    undated_scopes = (
        dated.filter(F.col("session_at").isNull()).select("scope_id").distinct()
        .withColumn("_undated", F.lit(True))
    )
    ordered = (
        dated.filter(F.col("content") != "")
        .join(undated_scopes, "scope_id", "left")
        .withColumn("_date", F.when(F.col("_undated").isNull(), F.col("session_at")))
    )
    numbered = number_in_group(
        ordered, ["scope_id"],
        [F.col("_date"), F.col("session_pos"), F.col("turn_index")], "seq",
    )
    return numbered.select(
        "scope_id", "seq",
        F.concat(F.lit("memory_observation#"), F.col("seq")).alias("obs_id"),
        F.col("role").alias("actor"),
        "content",
        F.lit(source).alias("source"),
        F.concat_ws("::", "session_id", "turn_index").alias("source_id"),
        F.col("session_at").alias("occurred_at"),
        F.col("session_at").alias("observed_at"),
        "session_id", "turn_index", "role", "session_date", "has_answer",
    )


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FIXTURE_LINE).json(path)


def fixture_observations(lines: DataFrame) -> DataFrame:
    return lines.filter(F.coalesce("kind", F.lit("observation")) != "query").drop(
        "kind", "required_data")


def fixture_queries(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("kind") == "query").select(
        "actor", F.col("content").alias("question"), "required_data")
