"""Answers with evidence, the evidence text for a reader, and baseline evaluation.

Every list here belongs to one question and is bounded by the retrieval limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe import constants as C
from mnemoframe.functions.text import date_only, strip
from mnemoframe.operators.retrieve import retrieval_id
from mnemoframe.settings import DEFAULTS, Settings

MAX_SHOWN_MESSAGES = 40


def _in_order(value: Column, order: str) -> Column:
    """Ordered list of ``value`` by ``order``, leaving nulls out."""
    pairs = F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order), value.alias("v"))))
    return F.array_sort(pairs)["v"]


def answers(
    results: DataFrame, memories: DataFrame, relations: DataFrame,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """One answer per result; a first result with gaps is left to the fallback."""
    if not settings.enable_answer_generation:
        results = results.filter(F.lit(False))
    if settings.enable_fallback_retrieval:
        results = results.filter(F.col("is_fallback") | (F.size("missing_data") == 0))
    base = results.withColumn("result_id", retrieval_id())
    used = base.select(
        "result_id", "scope_id", F.posexplode("retrieved_ids").alias("pos", "mem_id")
    ).join(memories.select("scope_id", "mem_id", "mem_type", "content"), ["scope_id", "mem_id"])
    procedural = F.col("mem_type") == C.PROCEDURAL
    text = used.groupBy("result_id").agg(
        _in_order(F.when(procedural, F.col("content")), "pos").alias("rules"),
        _in_order(F.when(~procedural, F.col("content")), "pos").alias("facts"),
        _in_order(F.col("mem_id"), "pos").alias("used"),
    )
    sources = relations.filter(F.col("rel") == "derived_from").select(
        "scope_id", F.col("src_id").alias("mem_id"), "dst_id", F.col("seq").alias("edge_seq"))
    evidence = used.join(sources, ["scope_id", "mem_id"]).groupBy("result_id").agg(
        F.array_distinct(F.array_sort(
            F.collect_list(F.struct("pos", "edge_seq", "dst_id")))["dst_id"]).alias("evidence"))
    none = F.array().cast("array<string>")
    joined = base.join(text, "result_id", "left").join(evidence, "result_id", "left").withColumns({
        "rules": F.coalesce("rules", none), "facts": F.coalesce("facts", none),
        "used_ids": F.coalesce("used", none), "evidence_ids": F.coalesce("evidence", none),
    })
    pieces = F.concat_ws(
        " ",
        F.when(F.size("rules") > 0,
               F.concat(F.lit("Style preferences: "), F.array_join("rules", " "))),
        F.when(F.size("facts") > 0, F.array_join("facts", " ")),
        F.when(F.size("missing_data") > 0,
               F.concat(F.lit("(Missing: "), F.array_join("missing_data", ", "), F.lit(".)"))),
    )
    nothing = (
        C.NO_MEMORY_ANSWER_GENERAL if settings.allow_general_knowledge_in_answers
        else C.NO_MEMORY_ANSWER
    )
    answer = F.when(F.size("retrieved_ids") == 0, F.lit(nothing)).otherwise(
        F.coalesce(F.nullif(pieces, F.lit("")), F.lit(C.NO_CONTENT_ANSWER)))
    sure = (F.size("used_ids") > 0) & (F.size("missing_data") == 0)
    return joined.select(
        "scope_id", "query_id", "result_id",
        F.concat_ws("/", "result_id", F.lit("memory_answer")).alias("answer_id"),
        answer.alias("answer"), "used_ids", "evidence_ids", "missing_data",
        F.when(sure, 0.85).otherwise(0.4).alias("confidence"),
        F.col("is_fallback").alias("from_fallback"))


def used_in_answer_edges(answer_rows: DataFrame) -> DataFrame:
    return answer_rows.select(
        "scope_id", F.col("answer_id").alias("dst_id"),
        F.posexplode("used_ids").alias("seq", "src_id"),
    ).select(
        "scope_id", "src_id", F.substring_index("src_id", "#", 1).alias("src_type"),
        "dst_id", F.lit("memory_answer").alias("dst_type"),
        F.lit("used_in_answer").alias("rel"), "seq")


def final_selection(answer_rows: DataFrame, results: DataFrame) -> DataFrame:
    """Per question the answer it settled on and the result behind it.

    The latest answer wins and names its result; without an answer the latest
    fallback result is taken, else the latest result.
    """
    latest = answer_rows.groupBy("query_id").agg(
        F.max_by(F.struct("answer_id", "result_id"), F.struct("from_fallback", "answer_id"))
        .alias("a"))
    backup = results.withColumn("result_id", retrieval_id()).groupBy("query_id").agg(
        F.max_by("result_id", F.struct("is_fallback", "result_id")).alias("backup_id"))
    return backup.join(latest, "query_id", "left").select(
        "query_id", "a.answer_id", F.coalesce("a.result_id", "backup_id").alias("result_id"))


# ------------------------------------------------------------ provenance


def source_observations(ids: DataFrame, relations: DataFrame) -> DataFrame:
    """(query_id, scope_id, object_id) -> the observations behind each object.

    An id that is an observation already stands for itself.
    """
    is_obs = F.startswith("object_id", F.lit(C.OBSERVATION + "#"))
    own = ids.filter(is_obs).select(
        "query_id", "scope_id", F.col("object_id").alias("obs_id"))
    sources = relations.filter(F.col("rel") == "derived_from").select(
        "scope_id", F.col("src_id").alias("object_id"), F.col("dst_id").alias("obs_id"))
    walked = ids.filter(~is_obs).join(sources, ["scope_id", "object_id"]).select(
        "query_id", "scope_id", "obs_id")
    return own.unionByName(walked).distinct()


def interest_ids(answer_rows: DataFrame, results: DataFrame) -> DataFrame:
    """Retrieved, used and evidence ids of the final chain, exploded."""
    final = final_selection(answer_rows, results)
    retrieved = results.withColumn("result_id", retrieval_id()).select(
        "query_id", "scope_id", "result_id", "retrieved_ids")
    ids = final.join(retrieved, ["query_id", "result_id"]).join(
        answer_rows.select("query_id", "answer_id", "used_ids", "evidence_ids"),
        ["query_id", "answer_id"], "left")
    none = F.array().cast("array<string>")
    everything = F.array_distinct(F.concat(
        "retrieved_ids", F.coalesce("used_ids", none), F.coalesce("evidence_ids", none)))
    return ids.select("query_id", "scope_id", F.explode(everything).alias("object_id"))


def context_turns(ids: DataFrame, relations: DataFrame, observations: DataFrame) -> DataFrame:
    """(query_id, scope_id, obs_id, seq, session_id, turn_index) of the evidence."""
    return source_observations(ids, relations).join(
        observations.select("scope_id", "obs_id", "seq", "session_id", "turn_index"),
        ["scope_id", "obs_id"])


# ------------------------------------------------------------ reader context


def fact_lines(answer_rows: DataFrame, results: DataFrame, memories: DataFrame) -> DataFrame:
    """'- [date] content' lines, used memories first, then other retrieved ones."""
    final = final_selection(answer_rows, results)
    retrieved = results.withColumn("result_id", retrieval_id()).select(
        "query_id", "scope_id", "result_id", "retrieved_ids")
    none = F.array().cast("array<string>")
    listed = final.join(retrieved, ["query_id", "result_id"]).join(
        answer_rows.select("query_id", "answer_id", "used_ids"),
        ["query_id", "answer_id"], "left",
    ).select(
        "query_id", "scope_id",
        F.posexplode(F.array_distinct(
            F.concat(F.coalesce("used_ids", none), "retrieved_ids"))).alias("pos", "mem_id"))
    content = strip(F.col("content"))
    day = date_only(F.col("occurred_at"))
    dated = (F.col("mem_type") == C.EPISODIC) & (day != "")
    return listed.join(
        memories.select("scope_id", "mem_id", "mem_type", "content", "occurred_at"),
        ["scope_id", "mem_id"],
    ).filter(content != "").select(
        "query_id", "scope_id", "pos",
        F.when(dated, F.concat(F.lit("- ["), day, F.lit("] "), content))
        .otherwise(F.concat(F.lit("- "), content)).alias("line"))


def shown_observations(
    evidence_turns: DataFrame, observations: DataFrame, max_shown: int = MAX_SHOWN_MESSAGES
) -> DataFrame:
    """Evidence turns, plus all turns of their sessions when those are at most two
    sessions and the whole stays within ``max_shown`` messages.

    Sizes are counted first, so a long session is never gathered.
    """
    spread = evidence_turns.groupBy("query_id").agg(
        F.count_distinct("session_id").alias("n_sessions"))
    few = spread.filter(F.col("n_sessions") <= 2).select("query_id")
    sessions = evidence_turns.select("query_id", "scope_id", "session_id").distinct().join(
        few, "query_id", "left_semi")
    lengths = observations.groupBy("scope_id", "session_id").agg(
        F.count("*").alias("session_turns"))
    fits = (
        sessions.join(lengths, ["scope_id", "session_id"]).groupBy("query_id")
        .agg(F.sum("session_turns").alias("n")).filter(F.col("n") <= max_shown)
        .select("query_id"))
    extra = sessions.join(fits, "query_id", "left_semi").join(
        observations.select("scope_id", "session_id", "obs_id", "seq"),
        ["scope_id", "session_id"],
    ).select("query_id", "scope_id", "obs_id", "seq")
    return evidence_turns.select("query_id", "scope_id", "obs_id", "seq").union(
        extra).distinct()


def message_lines(shown: DataFrame, observations: DataFrame, labels: DataFrame) -> DataFrame:
    """'[date] actor: content  (dates: ...)' lines in log order."""
    text = observations.select(
        "scope_id", "obs_id", "session_date", "actor", "role", strip(F.col("content"))
        .alias("content"))
    joined = shown.join(text, ["scope_id", "obs_id"]).join(
        labels.select("scope_id", F.col("src_id").alias("obs_id"), "labels"),
        ["scope_id", "obs_id"], "left")
    actor = F.coalesce(F.nullif("actor", F.lit("")), "role", F.lit(""))
    suffix = F.when(
        F.coalesce("labels", F.lit("")) != "",
        F.concat(F.lit("  (dates: "), "labels", F.lit(")"))).otherwise("")
    return joined.select(
        "query_id", "scope_id", "seq",
        F.concat(F.lit("["), F.coalesce("session_date", F.lit("")), F.lit("] "),
                 actor, F.lit(": "), "content", suffix).alias("line"))


def assemble_context(queries: DataFrame, facts: DataFrame, messages: DataFrame) -> DataFrame:
    """The evidence text of each question."""
    def joined(lines: DataFrame, order: str, name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(order, "line")))["line"]
        return lines.groupBy("query_id").agg(F.array_join(ordered, "\n").alias(name))

    parts = (
        queries.select("query_id")
        .join(joined(facts, "pos", "fact_text"), "query_id", "left")
        .join(joined(messages, "seq", "message_text"), "query_id", "left"))
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Remembered facts:\n"), "fact_text"),
        F.concat(F.lit("Relevant past messages:\n"), "message_text"))
    return parts.select(
        "query_id",
        F.coalesce(F.nullif(text, F.lit("")), F.lit(C.NO_CONTEXT)).alias("context"))


def cut_context(df: DataFrame, text: str, max_tokens: int) -> DataFrame:
    """Keep the outer lines of a text that is over the token budget.

    Deleting the middle line again and again keeps the first ceil(r/2) and the last
    floor(r/2) lines; r is the largest count that fits.
    """
    lines = F.split(F.col(text), "\n", -1)
    n = F.size("_lines")

    def outer(r: Column) -> Column:
        head = F.ceil(r / 2).cast("int")
        tail = F.floor(r / 2).cast("int")
        return F.array_join(F.concat(
            F.slice("_lines", 1, head),
            F.slice("_lines", n - tail + 1, tail)), "\n")

    # lines in the order in which they are kept: first, last, second, last but one, ...  Their
    # lengths grow the text, so a running total that stops at the budget gives r, in one pass
    # without an array that grows
    def kept(i: Column) -> Column:
        half = F.floor(i / 2).cast("int")
        return F.get("_lines", F.when(i % 2 == 0, half).otherwise(n - 1 - half))

    whole = F.floor(F.length(text) / 4) <= max_tokens
    measured = df.withColumn("_lines", lines)
    start = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).alias("r"), F.lit(True).alias("fits"))

    def take(acc: Column, i: Column) -> Column:
        size = acc["size"] + F.length(kept(i)) + F.when(i > 0, 1).otherwise(0)
        fits = acc["fits"] & (F.floor(size / 4) <= max_tokens)
        return F.struct(size.alias("size"), F.when(fits, i + 1).otherwise(acc["r"]).alias("r"),
                        fits.alias("fits"))

    best = F.aggregate(F.sequence(F.lit(0), n - 1), start, take, lambda acc: acc["r"])
    cut = measured.withColumn("_r", F.when(whole, n).otherwise(best))
    return cut.withColumns({
        "truncated": ~whole,
        "cut_text": F.when(whole, F.col(text)).otherwise(outer(F.col("_r"))),
        "kept_lines": F.col("_r"),
    }).drop("_lines", "_r")


# ------------------------------------------------------------ evaluation


def evaluations(answer_rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Conservative baseline outcome of every answer."""
    if not settings.enable_memory_evaluation:
        answer_rows = answer_rows.filter(F.lit(False))
    outcome = (
        F.when(F.size("used_ids") == 0, "unsupported")
        .when(F.size("missing_data") > 0, "partially_helpful")
        .otherwise("unknown"))
    return answer_rows.select(
        "scope_id", "query_id", "answer_id",
        F.concat_ws("/", "answer_id", F.lit("memory_evaluation")).alias("evaluation_id"),
        "used_ids", outcome.alias("outcome"), F.lit(None).cast("double").alias("score"),
        F.lit(C.AUTO_EVALUATION_NOTE).alias("notes"))


def evaluation_edges(rows: DataFrame) -> DataFrame:
    return rows.select(
        "scope_id", F.col("answer_id").alias("src_id"), F.lit("memory_answer").alias("src_type"),
        F.col("evaluation_id").alias("dst_id"), F.lit("memory_evaluation").alias("dst_type"),
        F.when(F.col("outcome") == "unknown", "validated_by").otherwise("invalidated_by")
        .alias("rel"), F.lit(0).cast("long").alias("seq"))


def score_retrieval(
    questions: DataFrame, gold_turns: DataFrame, gold_sessions: DataFrame, context: DataFrame
) -> DataFrame:
    """Turn and session recall and hit per question against gold evidence.

    ``questions`` has query_id and is_abstention; the gold tables and ``context`` have
    query_id with session_id (and turn_index).  Abstention questions and questions
    without gold get nulls.
    """
    seen_turns = context.select("query_id", "session_id", "turn_index").distinct().withColumn(
        "seen", F.lit(1))
    seen_sessions = context.select("query_id", "session_id").distinct().withColumn(
        "seen", F.lit(1))

    def recall(gold: DataFrame, seen: DataFrame, keys: list[str], name: str) -> DataFrame:
        return gold.select("query_id", *keys).distinct().join(
            seen, ["query_id", *keys], "left"
        ).groupBy("query_id").agg(
            F.count("*").alias(f"n_{name}"), F.count("seen").alias(f"found_{name}"))

    turn = recall(gold_turns, seen_turns, ["session_id", "turn_index"], "turns")
    session = recall(gold_sessions, seen_sessions, ["session_id"], "sessions")
    joined = questions.join(turn, "query_id", "left").join(session, "query_id", "left")
    answerable = ~F.col("is_abstention")

    def scored(name: str) -> list[Column]:
        n, found = F.col(f"n_{name}"), F.col(f"found_{name}")
        one = name[:-1]
        return [
            F.when(answerable & (n > 0), found / n).alias(f"{one}_recall"),
            F.when(answerable & (n > 0), found == n).alias(f"{one}_hit"),
            F.when(answerable, F.coalesce(n, F.lit(0))).otherwise(0).alias(f"n_gold_{name}"),
        ]

    return joined.select("query_id", *scored("turns"), *scored("sessions"))
