"""Questions -> ranked memories: planning, keyword and vector legs, blending,
reranking, missing evidence and the fallback pass.

Memories come with scope_id, mem_id, mem_type, status, content and, for the
vector leg, ``embedding``.  Questions come with query_id, scope_id and question.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe import constants as C
from mnemoframe.functions.text import (
    detect_required_data,
    extract_keywords,
    query_mode,
    strip,
    tokenize,
)
from mnemoframe.functions.vectors import EMBED_DIM, cosine_similarity_arrow, hash_embedding
from mnemoframe.operators.groups import in_small_batches, top_k
from mnemoframe.operators.hooks import call_once
from mnemoframe.operators.scan import SCORE_DIGITS, best_of_tasks, distinct_tokens, never_shown
from mnemoframe.settings import DEFAULTS, Settings

VECTOR_WEIGHT = 0.6


# ------------------------------------------------------------ planning


def expand_types(short_names: Column) -> Column:
    """Short type names -> stored names; unknown dropped; nothing left means all."""
    pairs = [F.lit(x) for item in C.SHORT_TYPE_NAMES.items() for x in item]
    known = F.array_compact(
        F.transform(short_names, lambda n: F.try_element_at(F.create_map(*pairs), n)))
    everything = F.array(*[F.lit(t) for t in C.MEMORY_TYPES])
    return F.when(F.size(F.coalesce(known, F.array().cast("array<string>"))) > 0, known).otherwise(
        everything)


def _column_or(df: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in df.columns else default


def plan_retrieval(queries: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Keywords, mode, types and required data of every non-blank question; no row where
    planning is turned off."""
    no_names = F.array().cast("array<string>")
    question = strip(F.col("question"))
    planned = queries.withColumn("question", question).filter(
        (F.col("question") != "") & F.lit(settings.enable_retrieval_planning))
    mode = query_mode(F.col("question"))
    if "mode" in queries.columns:
        mode = F.coalesce(F.nullif(F.col("mode"), F.lit("")), mode)
    required = F.array_distinct(F.concat(
        _column_or(queries, "required_data", no_names),
        detect_required_data(F.col("question"))))
    deep = F.col("mode") == "deep"
    return planned.withColumns({
        "keywords": extract_keywords(F.col("question")),
        "mode": mode,
        "required_data": required,
        "types": expand_types(_column_or(queries, "memory_types", no_names)),
    }).withColumn(
        "show_superseded",
        deep | F.lit(settings.include_superseded_in_standard_retrieval),
    )


def with_embedding(
    df: DataFrame, text: str, embed: Callable[[Column], Column] | None = None,
    name: str = "embedding", tokens: str | None = None,
) -> DataFrame:
    """Add a vector column; ``embed`` maps a text Column to an array Column.

    ``tokens`` names a column to keep the tokens in, so that scoring finds them there
    instead of cutting up the text again.
    """
    df = in_small_batches(df)
    words = tokenize(F.col(text))
    if tokens:
        df = df.withColumn(tokens, words)
        words = F.col(tokens)
    return df.withColumn(name, embed(F.col(text)) if embed else hash_embedding(words, EMBED_DIM))


def with_provided_embedding(
    df: DataFrame, text: str, provider: Callable[[list], list], name: str = "embedding",
    **options,
) -> DataFrame:
    """Add the vectors of ``provider(texts)``, each distinct text called once.

    A text whose call fails has no vector: the keyword leg still finds it.
    """
    return call_once(df, [text], provider, "array<double>", name, **options).drop("failure")


def controlled_hits(
    controller: Callable[[DataFrame, DataFrame], DataFrame], memories: DataFrame,
    plans: DataFrame, keep: int | None = None,
) -> DataFrame:
    """Hits that ``controller(plans, memories)`` chose: (query_id, ids array) in its order.

    Only ids of memories of the question's scope that it may see count, each once; a question
    for which nothing usable comes back has no hits.
    """
    returned = controller(plans, memories).select("query_id", "ids")
    asked = plans.select("query_id", "scope_id", "types", "show_superseded")
    named = returned.join(asked, "query_id").select(
        "*", F.posexplode("ids").alias("_place", "mem_id"))
    seen = memories.filter(~never_shown()).select("scope_id", "mem_id", "mem_type", "status")
    offered = named.join(seen, ["scope_id", "mem_id"]).filter(
        _visible_to("status", "show_superseded", "mem_type", "types")).groupBy(
        "query_id", "mem_id").agg(F.min("_place").alias("rank"))
    return keep_trusted(returned, offered, keep, empty_means_original=False)


# ------------------------------------------------------------ visibility


def _visible_to(status: str, show: str, mem_type: str, types: str) -> Column:
    return (
        (F.coalesce(F.col(status) != C.SUPERSEDED, F.lit(True)) | F.col(show))
        & F.array_contains(F.col(types), F.col(mem_type))
    )


# ------------------------------------------------------------ keyword leg


def keyword_matches(memories: DataFrame, plans: DataFrame) -> DataFrame:
    """Score of every (question, memory) pair that shares a keyword.

    An inverted-index join: question keywords meet memory tokens on (scope, token).
    Counts are combined on the map side before the pair leaves its task.
    """
    asked = plans.select(
        "query_id", "scope_id", "types", "show_superseded",
        F.size("keywords").alias("n_keywords"), F.explode("keywords").alias("token"))
    stored = memories.filter(~never_shown()).select(
        "scope_id", "mem_id", "mem_type", "status",
        # the outer form keeps Spark from tokenizing once more in a filter of its own
        F.explode_outer(F.array_distinct(tokenize(F.col("content")))).alias("token"),
    ).filter("token is not null")
    matched = stored.join(asked, ["scope_id", "token"]).filter(
        _visible_to("status", "show_superseded", "mem_type", "types"))
    return matched.groupBy("query_id", "scope_id", "mem_id").agg(
        (F.count("*") / F.first("n_keywords")).alias("score"))


def _top_of_legs(best: DataFrame, limit: int) -> DataFrame:
    order = [F.desc("score"), F.asc("mem_id")]
    return top_k(best, ["query_id", "leg"], order, limit)


def keyword_search(
    memories: DataFrame, plans: DataFrame, limit: int = 10, **tuning
) -> DataFrame:
    """Top-k of every question by the share of its keywords that a memory holds."""
    best = best_of_tasks(memories, plans, limit, vector=False, **tuning)
    return _top_of_legs(best, limit).drop("leg")


def vector_search(
    memories: DataFrame, plans: DataFrame, limit: int = 10, **tuning
) -> DataFrame:
    """Exact cosine top-k of every question within its scope; scores above 0."""
    best = best_of_tasks(memories, plans, limit, keyword=False, **tuning)
    return _top_of_legs(best, limit).drop("leg")


# ------------------------------------------------------------ blending


def flat_retrieve(
    memories: DataFrame, plans: DataFrame, settings: Settings = DEFAULTS, **tuning
) -> DataFrame:
    """Both legs, of one scan, cut to the limit, then max(keyword, 0.6 * vector), then the limit."""
    limit = settings.retrieval_limit
    best = _top_of_legs(best_of_tasks(
        memories, plans, limit, settings.enable_keyword_retrieval,
        settings.enable_vector_retrieval, **tuning), limit)
    weighed = F.when(F.col("leg") == "vector", VECTOR_WEIGHT * F.col("score")).otherwise(
        F.col("score"))
    blended = best.groupBy("query_id", "scope_id", "mem_id").agg(F.max(weighed).alias("score"))
    return top_k(blended, ["query_id"], [F.desc("score"), F.asc("mem_id")], limit)


def blended_score(
    keywords: Column, tokens: Column, embedding: Column, question_vector: Column
) -> Column:
    """max(keyword, 0.6 * vector) of one question and one memory with its distinct tokens."""
    hits = F.size(F.array_intersect(keywords, tokens))
    keyword = F.when(F.size(keywords) > 0, hits / F.size(keywords)).otherwise(0.0)
    vector = F.round(cosine_similarity_arrow(embedding, question_vector), SCORE_DIGITS)
    return F.greatest(keyword, VECTOR_WEIGHT * vector)


def score_candidates(candidates: DataFrame, memories: DataFrame, plans: DataFrame) -> DataFrame:
    """max(keyword, 0.6 * vector) of given (query_id, mem_id) pairs; above 0 only."""
    stored = memories.select(
        "scope_id", "mem_id", "mem_type", "status", distinct_tokens(memories).alias("tokens"),
        "embedding")
    asked = plans.select(
        "query_id", "scope_id", "keywords", "show_superseded",
        F.col("embedding").alias("question_vector"))
    return (
        candidates.join(stored, ["scope_id", "mem_id"]).join(asked, ["query_id", "scope_id"])
        .filter(~never_shown() & (
            F.coalesce(F.col("status") != C.SUPERSEDED, F.lit(True)) | F.col("show_superseded")))
        .withColumn("score", blended_score(
            F.col("keywords"), F.col("tokens"), F.col("embedding"), F.col("question_vector")))
        .filter("score > 0")
        .drop("tokens", "embedding", "question_vector", "keywords", "show_superseded", "status")
    )


def rank_facts(
    memories: DataFrame, plans: DataFrame, limit: int, **tuning
) -> DataFrame:
    """Direct blended search over all visible memories: the best of
    max(keyword, 0.6 * vector) without a cut between the legs.

    The best ``limit`` by the maximum of two scores are among the best ``limit`` of
    each score, so cutting each leg there loses nothing.
    """
    all_types = plans.withColumn("types", F.array(*[F.lit(t) for t in C.MEMORY_TYPES]))
    settings = DEFAULTS.but(retrieval_limit=limit)
    return flat_retrieve(memories, all_types, settings, **tuning)


# ------------------------------------------------------------ reranking


def keep_trusted(
    returned: DataFrame, candidates: DataFrame, keep: int | None = None,
    empty_means_original: bool = True,
) -> DataFrame:
    """Guard against ids a provider made up.

    ``returned`` is (query_id, ids array or null).  Only candidate ids stay, each
    once, in the provider's order.  For a reranker nothing usable means the original
    order; for a retrieval controller it stays empty.
    """
    offered = candidates.select("query_id", "mem_id", F.col("rank").alias("_original"))
    named = returned.select("query_id", F.posexplode("ids").alias("_pos", "mem_id"))
    valid = (
        named.groupBy("query_id", "mem_id").agg(F.min("_pos").alias("_pos"))
        .join(offered, ["query_id", "mem_id"])
    )
    kept = valid.select("query_id", "mem_id", F.col("_pos").alias("_order"))
    if empty_means_original:
        untouched = offered.join(valid.select("query_id").distinct(), "query_id", "left_anti")
        kept = kept.unionByName(
            untouched.select("query_id", "mem_id", F.col("_original").alias("_order")))
    ranked = top_k(kept, ["query_id"], [F.asc("_order")], keep or DEFAULTS.retrieval_limit)
    return ranked.drop("_order")


def rerank(
    hits: DataFrame, memories: DataFrame, plans: DataFrame,
    reranker: Callable[[str, list, int], list], settings: Settings = DEFAULTS,
) -> DataFrame:
    """Let ``reranker(question, [(id, content), ...], keep)`` reorder each question's hits.

    A question has at most ``retrieval_limit`` hits, so its group is small.  An
    exception or a non-list result leaves the original order.
    """
    keep = settings.rerank_keep
    offered = hits.join(
        memories.select("scope_id", "mem_id", "content"), ["scope_id", "mem_id"]
    ).join(plans.select("query_id", "question"), "query_id")

    def call(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        pairs = list(zip(group["mem_id"], group["content"]))
        try:
            ids = [str(i) for i in reranker(group["question"].iloc[0], pairs, keep)]
        except Exception:  # a provider must never break retrieval
            ids = None
        return pd.DataFrame({"query_id": [group["query_id"].iloc[0]], "ids": [ids]})

    id_type = dict(hits.dtypes)["query_id"]
    returned = (
        offered.select("query_id", "question", "mem_id", "content", "rank")
        .groupBy("query_id").applyInPandas(call, f"query_id {id_type}, ids array<string>"))
    return keep_trusted(returned, hits, keep)


# ------------------------------------------------------------ results


def _any_signal(hits: DataFrame, relations: DataFrame) -> DataFrame:
    """Per question: does any retrieved memory carry a quantity / a time reference?"""
    carriers = (
        relations.filter(F.col("rel").isin("has_quantity", "has_temporal_ref"))
        .groupBy("scope_id", F.col("src_id").alias("mem_id"))
        .agg(F.max(F.col("rel") == "has_quantity").alias("numeric"),
             F.max(F.col("rel") == "has_temporal_ref").alias("temporal"))
    )
    return (
        hits.select("query_id", "scope_id", "mem_id")
        .join(carriers, ["scope_id", "mem_id"], "left")
        .groupBy("query_id")
        .agg(F.coalesce(F.max("numeric"), F.lit(False)).alias("has_numeric"),
             F.coalesce(F.max("temporal"), F.lit(False)).alias("has_temporal"),
             F.count("*").alias("n_hits"))
    )


def _still_missing(required: Column) -> Column:
    return F.filter(required, lambda need: ~(
        F.when(need == "numeric_value", F.coalesce("has_numeric", F.lit(False)))
        .when(need == "temporal_value", F.coalesce("has_temporal", F.lit(False)))
        .otherwise(F.coalesce("n_hits", F.lit(0)) > 0)))


def ordered_ids(hits: DataFrame, order: str = "rank") -> DataFrame:
    """(query_id, ids): the few retrieved ids of each question in order."""
    listed = F.array_sort(F.collect_list(F.struct(order, "mem_id")))
    return hits.groupBy("query_id").agg(listed["mem_id"].alias("ids"))


def retrieval_results(
    plans: DataFrame, hits: DataFrame, relations: DataFrame,
    agentic_confidence: DataFrame | None = None,
) -> DataFrame:
    """One result row per planned question: ids, missing data, confidence.

    ``agentic_confidence`` is (query_id, confidence) from the agentic strategy.
    """
    none = F.array().cast("array<string>")
    joined = (
        plans.select("query_id", "scope_id", "question", "required_data")
        .join(ordered_ids(hits), "query_id", "left")
        .join(_any_signal(hits, relations), "query_id", "left")
        .withColumn("retrieved_ids", F.coalesce("ids", none))
        .withColumn("missing_data", _still_missing(F.col("required_data")))
    )
    found, complete = F.size("retrieved_ids") > 0, F.size("missing_data") == 0
    if agentic_confidence is None:
        confidence = F.when(found & complete, 0.9).otherwise(0.5)
    else:
        joined = joined.join(
            agentic_confidence.withColumnRenamed("confidence", "_self"), "query_id", "left")
        own = F.when(found, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_self"))))
        base = F.coalesce(own, F.lit(0.2))
        confidence = F.when(complete, base).otherwise(F.least(base, F.lit(0.5)))
    return joined.select(
        "query_id", "scope_id", "question", "required_data", "retrieved_ids", "missing_data",
        confidence.alias("confidence"), F.lit(False).alias("is_fallback"))


def fallback_retrieve(
    results: DataFrame, memories: DataFrame, relations: DataFrame,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """A second result for every question whose first one misses something.

    Searches by keyword over all types, superseded included, for the question plus
    seed words of each missing kind; new ids follow the ones found before.
    """
    lacking = results.filter(~F.col("is_fallback") & (F.size("missing_data") > 0))
    seeds = [F.lit(x) for item in C.FALLBACK_WORDS.items() for x in item]
    extra = F.transform(
        "missing_data",
        lambda need: F.coalesce(F.try_element_at(F.create_map(*seeds), need), need))
    plans = lacking.select(
        "query_id", "scope_id",
        extract_keywords(F.concat_ws(" ", F.col("question"), F.array_join(extra, " ")))
        .alias("keywords"),
        F.array(*[F.lit(t) for t in C.MEMORY_TYPES]).alias("types"),
        F.lit(True).alias("show_superseded"),
    )
    found = ordered_ids(
        keyword_search(memories, plans, settings.fallback_retrieval_limit)
    ).withColumnRenamed("ids", "found_ids")
    none = F.array().cast("array<string>")
    combined = lacking.join(found, "query_id", "left").withColumn(
        "combined", F.array_distinct(F.concat("retrieved_ids", F.coalesce("found_ids", none))))
    hits = combined.select("query_id", "scope_id", F.explode("combined").alias("mem_id"))
    still = (
        combined.join(_any_signal(hits, relations), "query_id", "left")
        .withColumn("still_missing", _still_missing(F.col("missing_data")))
    )
    good = (F.size("combined") > 0) & (F.size("still_missing") == 0)
    return still.select(
        "query_id", "scope_id", "question", "required_data",
        F.col("combined").alias("retrieved_ids"),
        F.col("still_missing").alias("missing_data"),
        F.when(good, 0.7).otherwise(0.4).alias("confidence"),
        F.lit(True).alias("is_fallback"))


def retrieval_id() -> Column:
    return F.concat_ws(
        "/", F.col("query_id").cast("string"),
        F.when(F.col("is_fallback"), "memory_retrieval_result#2")
        .otherwise("memory_retrieval_result#1"))


def retrieved_for_edges(results: DataFrame) -> DataFrame:
    """Memory -> result edges, and memory -> question edges for first results only."""
    hit = results.select(
        "scope_id", "query_id", "is_fallback", retrieval_id().alias("result_id"),
        F.posexplode("retrieved_ids").alias("seq", "src_id"))
    targets = F.array_compact(F.array(
        F.struct(F.col("result_id").alias("dst_id"),
                 F.lit("memory_retrieval_result").alias("dst_type")),
        F.when(~F.col("is_fallback"), F.struct(
            F.col("query_id").cast("string").alias("dst_id"),
            F.lit("memory_query").alias("dst_type")))))
    return hit.select(
        "scope_id", "src_id", F.substring_index("src_id", "#", 1).alias("src_type"),
        F.explode(targets).alias("t"), "seq",
    ).select("scope_id", "src_id", "src_type", "t.*", F.lit("retrieved_for").alias("rel"), "seq")


def hybrid_context(
    hits: DataFrame, memories: DataFrame, observations: DataFrame, budget_tokens: int
) -> DataFrame:
    """Top claims plus the verbatim text they came from, within a token budget.

    Rows are taken in rank order while the running estimate stays in the budget.
    """
    joined = (
        hits.join(memories.select("scope_id", "mem_id", "content", "obs_id"),
                  ["scope_id", "mem_id"])
        .join(observations.select("scope_id", "obs_id", F.col("content").alias("span")),
              ["scope_id", "obs_id"])
        .withColumn("cost", F.floor(F.length("content") / 4) + F.floor(F.length("span") / 4))
    )
    running = F.sum("cost").over(
        Window.partitionBy("query_id").orderBy("rank")
        .rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("used_tokens", running).filter(
        F.col("used_tokens") <= budget_tokens)
