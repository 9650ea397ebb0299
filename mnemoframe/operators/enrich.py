"""Time references and quantities attached to observations and memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe import constants as C
from mnemoframe.functions.numeric import describe_quantities, quantity_matches
from mnemoframe.functions.temporal import find_temporal_refs, resolve_mentions
from mnemoframe.functions.text import strip
from mnemoframe.operators.extract import extracted_type
from mnemoframe.settings import Settings


def _texts(
    observations: DataFrame, memories: DataFrame | None, extraction: Settings | None
) -> DataFrame:
    """Each text that enrichment reads, with the rows it is the text of.

    These are observations, claims and episodics.  The anchor of a row is occurred_at, else
    observed_at; claims carry neither.  With ``extraction`` the memories are those that
    deterministic extraction makes: they follow from the observation's own row, so their
    mentions are found there, together, and no text is shuffled.  Other memories are searched
    as rows of their own.
    """
    def source(seq, src_id, src_type, anchor):
        return F.struct(
            seq.alias("seq"), src_id.alias("src_id"), src_type.alias("src_type"),
            anchor.alias("anchor"))

    observed = source(
        F.col("seq"), F.col("obs_id"), F.lit(C.OBSERVATION),
        F.coalesce("occurred_at", "observed_at"))
    if extraction is not None:
        # the steps are separate projections so that each is evaluated once
        typed = observations.withColumn("_text", strip(F.col("content"))).withColumn(
            "_kind", extracted_type(F.col("_text"), extraction))
        text, kind = F.col("_text"), F.col("_kind")
        remembered = source(
            F.col("seq"), F.concat_ws("#", kind, "seq"), kind,
            F.when(kind == C.EPISODIC, F.col("occurred_at")))

        def entry(content, *sources):
            return F.struct(content.alias("content"), F.array(*sources).alias("sources"))

        own = F.col("content")
        texts = F.when(
            kind.isNull() | (kind == C.PROCEDURAL), F.array(entry(own, observed))
        ).when(text == own, F.array(entry(own, observed, remembered))).otherwise(
            F.array(entry(own, observed), entry(text, remembered)))
        # the outer form adds no filter on the array, which is never empty
        return typed.select("scope_id", F.explode_outer(texts).alias("t")).select(
            "scope_id", "t.content", "t.sources")
    alone = observations.select("scope_id", "content", F.array(observed).alias("sources"))
    if memories is None:
        return alone
    return alone.unionByName(memories.filter(F.col("mem_type") != C.PROCEDURAL).select(
        "scope_id", "content", F.array(source(
            F.col("seq"), F.col("mem_id"), F.col("mem_type"), F.col("occurred_at"))
        ).alias("sources")))


def _per_source(mentions: DataFrame) -> DataFrame:
    return mentions.select("*", F.explode("sources").alias("_source")).select(
        "*", "_source.*").drop("sources", "_source")


def temporal_refs(
    observations: DataFrame, memories: DataFrame | None = None,
    extraction: Settings | None = None,
) -> DataFrame:
    """One row per mention with its resolution; see ``_texts`` for the sources."""
    mentioned = (
        # the outer form keeps Spark from adding a filter on the array, which would
        # evaluate the whole search a second time
        _texts(observations, memories, extraction)
        .select("scope_id", "sources",
                F.posexplode_outer(find_temporal_refs(F.col("content"))).alias("pos", "m"))
        .filter("m is not null")
    ).select("scope_id", "sources", "pos", F.col("m.text").alias("text"), F.col("m.kind").alias("kind"))
    return resolve_mentions(_per_source(mentioned), "text", "kind", "anchor").select(
        "scope_id", "seq", "src_id", "src_type", "pos",
        F.concat_ws("/", "src_id", F.concat(F.lit("temporal_ref#"), F.col("pos"))).alias("ref_id"),
        "text", "kind", "resolved_at", "anchor_day", "resolution_method", "confidence",
    )


def quantities(
    observations: DataFrame, memories: DataFrame | None = None, strict_units: bool = False,
    extraction: Settings | None = None,
) -> DataFrame:
    """One row per quantity mention with owner, property and summability; sources as above."""
    found = (
        _texts(observations, memories, extraction).filter(F.col("content").rlike(r"\d"))
        .select("scope_id", "sources", "content",
                F.posexplode_outer(quantity_matches(F.col("content"), strict_units))
                .alias("pos", "m"))
        .filter("m is not null"))
    described = describe_quantities(found, "content", "m", strict_units)
    return _per_source(described).select(
        "scope_id", "seq", "src_id", "src_type", "pos",
        F.concat_ws("/", "src_id", F.concat(F.lit("quantity_claim#"), F.col("pos")))
        .alias("ref_id"),
        "raw_value", "value", "unit", "exactness", "owner", "property", "can_sum_exactly",
        F.col("owner").alias("item_or_event"),
        F.when(F.coalesce("owner", F.lit("")) != "", 0.8).otherwise(0.5).alias("confidence"),
    )


def mention_edges(mentions: DataFrame, rel: str) -> DataFrame:
    """has_temporal_ref or has_quantity edges from a mention table."""
    target = {"has_temporal_ref": "temporal_ref", "has_quantity": "quantity_claim"}[rel]
    return mentions.select(
        "scope_id", "src_id", "src_type", F.col("ref_id").alias("dst_id"),
        F.lit(target).alias("dst_type"), F.lit(rel).alias("rel"), "seq",
    )


def safe_sum(quantity_rows: DataFrame) -> DataFrame:
    """Sum only what may be summed; count what was refused."""
    return quantity_rows.groupBy("owner", "property", "unit").agg(
        F.sum(F.when(F.col("can_sum_exactly"), F.col("value"))).alias("total"),
        F.count_if(F.col("can_sum_exactly")).alias("n_summed"),
        F.count_if(~F.col("can_sum_exactly")).alias("n_refused"),
    )


def resolved_date_labels(refs: DataFrame) -> DataFrame:
    """'yesterday = 2022-03-20' labels of each source, joined in mention order.

    The mentions of one source are few: each distinct phrase occurs once.
    """
    dated = refs.select(
        "scope_id", "src_id", "pos", "resolution_method",
        F.date_format("resolved_at", "yyyy-MM-dd").alias("day"), strip(F.col("text")).alias("phrase"))
    day, phrase = F.col("day"), F.col("phrase")
    usable = (
        (F.col("resolution_method") != "unresolved") & day.isNotNull()
        & (phrase != "") & (F.lower(phrase) != day))
    since = F.when(F.col("resolution_method") == "duration_start", " = since ").otherwise(" = ")
    label = F.when(usable, F.concat(phrase, since, day))
    # a filter on what is exploded stays here; one on the columns would move down into the
    # resolution and evaluate its steps again
    labelled = dated.select(
        "scope_id", "src_id", "pos", F.explode_outer(F.array(label)).alias("label")
    ).filter("label is not null")
    # a window shuffles and sorts once; an aggregate of lists would sort on both sides
    source = Window.partitionBy("scope_id", "src_id").orderBy("pos", "label")
    whole = source.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        labelled.withColumn("found", F.collect_list("label").over(whole))
        .withColumn("nth", F.row_number().over(source)).filter("nth = 1")
        .select(
            "scope_id", "src_id",
            F.array_join(F.array_distinct("found"), "; ").alias("labels"))
    )
