"""Observations -> typed memories with provenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe import constants as C
from mnemoframe.functions.text import classify_observation, content_key, strip
from mnemoframe.operators.groups import number_in_group
from mnemoframe.operators.hooks import call_once
from mnemoframe.settings import DEFAULTS, Settings

DEFAULT_CONFIDENCE = 0.85


def _typed(candidates: DataFrame, settings: Settings) -> DataFrame:
    """Confidence gate, feature flags, and the fields each memory type carries.

    Expects the observation columns plus kind, memory_content, confidence, mem_seq.
    """
    enabled = {
        "procedural": settings.enable_procedural_memory,
        "episodic": settings.enable_episodic_memory,
        "semantic": settings.enable_semantic_memory,
    }
    kept = [kind for kind, on in enabled.items() if on]
    gated = candidates.filter(
        (strip(F.col("memory_content")) != "")
        & (F.col("confidence") >= settings.extraction_confidence_threshold)
    )
    # with every kind on there is nothing to filter; a filter would find the kind once more
    if len(kept) < len(enabled):
        gated = gated.filter(F.col("kind").isin(*kept))
    mem_type = (
        F.when(F.col("kind") == "procedural", C.PROCEDURAL)
        .when(F.col("kind") == "episodic", C.EPISODIC)
        .otherwise(C.CLAIM)
    )
    typed = gated.withColumn("mem_type", mem_type)
    episodic = F.col("mem_type") == C.EPISODIC
    procedural = F.col("mem_type") == C.PROCEDURAL
    no_names = F.array().cast("array<string>")
    applies_to = F.col("applies_to") if "applies_to" in typed.columns else no_names
    priority = F.col("priority") if "priority" in typed.columns else F.lit(0)
    return typed.select(
        "scope_id",
        F.col("mem_seq").alias("seq"),
        F.concat_ws("#", "mem_type", "mem_seq").alias("mem_id"),
        "mem_type",
        F.col("memory_content").alias("content"),
        "confidence",
        F.lit(C.ACTIVE).alias("status"),
        "obs_id",
        F.when(episodic, F.col("occurred_at")).alias("occurred_at"),
        F.when(episodic & (F.coalesce("actor", F.lit("")) != ""), F.array("actor"))
        .otherwise(no_names).alias("actors"),
        F.when(episodic, F.col("source")).alias("source"),
        F.when(procedural, applies_to).otherwise(no_names).alias("applies_to"),
        F.when(procedural, priority).otherwise(F.lit(0)).alias("priority"),
    )


def extracted_type(text: Column, settings: Settings = DEFAULTS) -> Column:
    """Type of the memory that ``extract_memories`` makes of a stripped text; null if none."""
    enabled = {
        "procedural": (settings.enable_procedural_memory, C.PROCEDURAL),
        "episodic": (settings.enable_episodic_memory, C.EPISODIC),
        "semantic": (settings.enable_semantic_memory, C.CLAIM),
    }
    kept = DEFAULT_CONFIDENCE >= settings.extraction_confidence_threshold
    return F.when(text != "", classify_observation(text, **{
        name: F.lit(stored if on and kept else None).cast("string")
        for name, (on, stored) in enabled.items()}))


def extract_memories(observations: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One memory per non-blank observation, typed by its cues."""
    content = strip(F.col("content"))
    candidates = (
        observations.withColumn("memory_content", content)
        .filter(F.col("memory_content") != "")
        .withColumns({
            "kind": classify_observation(F.col("memory_content")),
            "confidence": F.lit(DEFAULT_CONFIDENCE),
            "mem_seq": F.col("seq"),
        })
    )
    return _typed(candidates, settings)


def parse_payload(payload: Column) -> Column:
    """Provider JSON '{"memories": [...]}' -> array<struct(kind, content, confidence, reason)>.

    A malformed payload or a wrong shape is an empty extraction; an unknown type is
    semantic; a bad confidence is the default and the rest is clamped to [0, 1].
    """
    items = F.from_json(payload, "memories array<string>")["memories"]
    fields = "memory_type string, content string, confidence string, reason string"
    parsed = F.transform(items, lambda i: F.from_json(i, fields))

    def clean(m: Column) -> Column:
        kind = F.lower(strip(m["memory_type"]))
        known = F.when(kind.isin("procedural", "episodic"), kind).otherwise("semantic")
        confidence = F.coalesce(m["confidence"].try_cast("double"), F.lit(DEFAULT_CONFIDENCE))
        return F.struct(
            known.alias("kind"), strip(m["content"]).alias("content"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"),
            m["reason"].alias("reason"),
        )

    cleaned = F.transform(parsed, clean)
    usable = F.filter(cleaned, lambda m: m["content"] != "")
    return F.coalesce(
        usable,
        F.array().cast("array<struct<kind:string,content:string,confidence:double,reason:string>>"),
    )


def extract_from_payload(
    observations: DataFrame, payload: str, settings: Settings = DEFAULTS
) -> DataFrame:
    """Zero or more memories per observation from a provider's JSON column.

    Memories are numbered densely in the order of the log, before the confidence gate.
    """
    exploded = (
        observations.filter(strip(F.col("content")) != "")
        .select("*", F.posexplode(parse_payload(F.col(payload))).alias("_pos", "_m"))
        .withColumns({
            "kind": F.col("_m.kind"),
            "memory_content": F.col("_m.content"),
            "confidence": F.col("_m.confidence"),
        })
    )
    order = [F.col("seq"), F.col("_pos")]
    return _typed(number_in_group(exploded, ["scope_id"], order, "mem_seq"), settings)


def provider_payload(
    observations: DataFrame, extractor: Callable[[list, list], list],
    output: str = "payload", **options,
) -> DataFrame:
    """Add the JSON strings of ``extractor(contents, roles)``; null where the call failed.

    Equal (content, role) is one call; see ``hooks`` for retries and ``cache.refresh`` for
    keeping the answers.
    """
    asked = observations.withColumn("_content", strip(F.col("content"))).withColumn(
        "_role", F.coalesce(F.col("actor"), F.lit("")))
    return call_once(asked, ["_content", "_role"], extractor, "string", output, **options).drop(
        "_content", "_role", "failure")


def extraction_namespace(
    role: Column, retain_assistant_facts: bool, version: str = "v1",
    assistant_version: str = "v1-assistant",
) -> Column:
    """Version namespace of a turn: assistant turns have their own when retained."""
    assistant = F.lower(strip(role)) == "assistant"
    routed = assistant & F.lit(retain_assistant_facts)
    return F.when(routed, assistant_version).otherwise(version)


def extraction_key(model: Column, namespace: Column, content: Column) -> Column:
    return content_key(model, namespace, strip(content))


def provenance_edges(memories: DataFrame) -> DataFrame:
    """derived_from (memory -> observation) and supports (observation -> memory)."""
    def edge(src, src_type, dst, dst_type, rel):
        return F.struct(
            src.alias("src_id"), src_type.alias("src_type"), dst.alias("dst_id"),
            dst_type.alias("dst_type"), F.lit(rel).alias("rel"))

    memory = (F.col("mem_id"), F.col("mem_type"))
    observation = (F.col("obs_id"), F.lit(C.OBSERVATION))
    both = memories.select("scope_id", "seq", F.explode(F.array(
        edge(*memory, *observation, "derived_from"),
        edge(*observation, *memory, "supports"))).alias("e"))
    return both.select("scope_id", "e.*", "seq")
