"""Run records as Parquet: resumable upsert, evolution, codecs and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe import schemas

LIST_COLUMNS = (
    "pack_errors", "retrieved_object_ids", "used_memory_ids", "evidence_ids",
    "context_turn_ids", "context_session_ids",
)
FLAG_COLUMNS = ("is_abstention", "truncated", "turn_hit", "session_hit", "judge_correct")


def stamp(records: DataFrame, now: Column | None = None) -> DataFrame:
    """A new version of some records: updated_at always, created_at unless given."""
    moment = (F.current_timestamp() if now is None else now).cast("timestamp")
    seconds = F.unix_micros(moment) / 1e6
    stamped = records.withColumn("updated_at", seconds)
    if "created_at" not in records.columns:
        stamped = stamped.withColumn("created_at", seconds)
    return stamped


def current_records(
    versions: DataFrame, supplied: str | None = None, keys: tuple[str, ...] = ("question_id",)
) -> DataFrame:
    """Latest value of every column per key over append-only versions.

    A version overwrites only the columns it supplies.  Without ``supplied`` a null is
    an unsupplied column; ``supplied`` names an array column listing the supplied ones,
    so that an explicit null can overwrite too.
    """
    values = [c for c in versions.columns if c not in (*keys, "updated_at", supplied)]

    def latest(name: str) -> Column:
        given = (
            F.array_contains(supplied, F.lit(name)) if supplied else F.col(name).isNotNull())
        return F.max_by(F.col(name), F.when(given, F.col("updated_at"))).alias(name)

    return versions.groupBy(*keys).agg(
        *[latest(c) for c in values], F.max("updated_at").alias("updated_at"))


def completed_ids(records: DataFrame) -> DataFrame:
    return records.filter("status = 'done'").select("question_id")


def evolve(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Older stores keep working when columns were added later."""
    return older.unionByName(newer, allowMissingColumns=True)


def encode_columns(records: DataFrame) -> DataFrame:
    """Lists to JSON text and flags to 0/1, for row stores and text sinks."""
    present = set(records.columns)
    lists = {c: F.to_json(c) for c in LIST_COLUMNS if c in present}
    flags = {c: F.col(c).cast("int") for c in FLAG_COLUMNS if c in present}
    return records.withColumns({**lists, **flags})


def decode_columns(encoded: DataFrame) -> DataFrame:
    """The inverse of ``encode_columns``."""
    types = {f.name: f.dataType for f in schemas.RUN_RECORDS.fields}
    present = set(encoded.columns)
    lists = {c: F.from_json(c, types[c]) for c in LIST_COLUMNS if c in present}
    flags = {c: F.col(c).cast("boolean") for c in FLAG_COLUMNS if c in present}
    return encoded.withColumns({**lists, **flags})


def hypotheses(records: DataFrame) -> DataFrame:
    """Done rows, nine fields, sorted by id."""
    return records.filter("status = 'done'").select(
        "question_id", "question_type", "is_abstention", "question", "gold_answer",
        "hypothesis", "judge_correct", "turn_hit", "session_hit").orderBy("question_id")


def write_hypotheses(records: DataFrame, path: str) -> None:
    hypotheses(records).write.mode("overwrite").json(path)


def write_records(records: DataFrame, path: str) -> None:
    """Append a batch of versions; the store is partitioned by run."""
    records.write.mode("append").partitionBy("run_id").parquet(path)


def resolution(requested: Column, resolved: Column) -> Column:
    """A model snapshot counts as known only when it differs from the alias asked for."""
    known = (requested != "") & (resolved != "") & (resolved != requested)
    known = F.coalesce(known, F.lit(False))
    return F.struct(
        F.when(known, resolved).alias("resolved_model"),
        (~known).alias("resolved_model_unavailable"))


def manifest(records: DataFrame, metrics: DataFrame, config: dict) -> DataFrame:
    """One row per run: configuration, resolved models, status counts and metrics."""
    def last(name: str) -> Column:
        usable = F.nullif(F.col(name), F.lit(""))
        return F.max_by(usable, F.when(usable.isNotNull(), F.col("updated_at")))

    models = records.groupBy("run_id").agg(
        last("reader_requested_model").alias("reader_requested"),
        last("reader_resolved_model").alias("reader_resolved"),
        last("judge_requested_model").alias("judge_requested"),
        last("judge_resolved_model").alias("judge_resolved"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}")
          for s in ("done", "error", "pending")])
    settings = [F.lit(str(v)).alias(k) for k, v in sorted(config.items())]
    return models.join(metrics, "run_id").select(
        "run_id", F.struct(*settings).alias("config"),
        F.struct(
            resolution(F.col("reader_requested"), F.col("reader_resolved")).alias("reader"),
            resolution(F.col("judge_requested"), F.col("judge_resolved")).alias("judge"),
        ).alias("models"),
        F.struct("n_done", "n_error", "n_pending").alias("status_counts"),
        F.struct(*[c for c in metrics.columns if c != "run_id"]).alias("metrics"))
