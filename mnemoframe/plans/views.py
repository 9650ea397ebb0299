"""Conversation-shaped views of the test tables, built by Spark."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe import constants as C
from mnemoframe.functions.text import estimate_tokens
from mnemoframe.operators import concepts as concept_ops
from mnemoframe.operators import enrich, extract, reconcile, retrieve
from mnemoframe.operators.groups import materialize, number_in_group, stored
from mnemoframe.settings import DEFAULTS
from mnemoframe.sources import conversations


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _as_observations(df: DataFrame, source: str) -> DataFrame:
    return df.select(
        "scope_id", "seq",
        F.concat(F.lit("memory_observation#"), F.col("seq")).alias("obs_id"),
        F.lit("user").alias("actor"), "content", F.lit(source).alias("source"),
        F.concat_ws("::", "scope_id", "seq").alias("source_id"),
        "occurred_at", F.col("occurred_at").alias("observed_at"),
    )


def order_observations(spark: SparkSession, folder: str) -> DataFrame:
    """One scope per customer, one observation per order in date order."""
    orders = table(spark, folder, "orders")
    text = F.concat(
        F.lit("Customer "), F.col("o_custkey").cast("string"),
        F.when(F.col("o_orderstatus") == "F", " now").otherwise(""),
        F.when(F.col("o_orderpriority") == "1-URGENT", " should have priority ")
        .otherwise(" has priority "),
        F.col("o_orderpriority"), F.lit(" on account"),
        F.when(F.col("o_orderstatus") == "P", " as announced yesterday").otherwise(""),
    )
    rows = orders.select(
        F.col("o_custkey").alias("scope_id"),
        F.col("o_orderdate").cast("timestamp").alias("occurred_at"), "o_orderkey",
        "o_custkey", "o_orderstatus", "o_orderpriority")
    numbered = number_in_group(
        rows, ["scope_id"], [F.col("occurred_at"), F.col("o_orderkey")], "seq", True)
    # the text is made once the rows are numbered, so it is neither sorted nor written
    return _as_observations(numbered.withColumn("content", text), "orders")


def shipment_observations(spark: SparkSession, folder: str) -> DataFrame:
    """One scope per order, one observation with quantities and a date per line."""
    lines = table(spark, folder, "lineitem")
    whole = F.col("l_quantity").cast("int")
    phrase: Column = F.lit("on May 26")
    choices = ["yesterday", "two weeks ago", "last month", "for about three months"]
    for i, words in enumerate(choices):
        phrase = F.when(F.col("l_partkey") % 6 == i, words).otherwise(phrase)
    phrase = F.when(
        F.col("l_partkey") % 6 == 4, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise(phrase)
    text = F.concat(
        F.lit("Supplier "), F.col("l_suppkey").cast("string"), F.lit(" revenue is $"),
        whole.cast("string"), F.lit("k or $"), whole.cast("string"), F.lit("-"),
        (whole + 5).cast("string"), F.lit("M with "),
        F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("% growth and "),
        F.col("l_linenumber").cast("string"), F.lit(" customers, renewed "), phrase, F.lit("."),
    )
    columns = [F.col(c) for c in lines.columns]
    numbered = number_in_group(
        lines.withColumn("scope_id", F.col("l_orderkey")), ["scope_id"], columns, "seq",
        True)
    # the text is made once the rows are numbered, so it is neither sorted nor written
    return _as_observations(numbered.withColumns({
        "content": text, "occurred_at": F.col("l_shipdate").cast("timestamp")}), "lineitem")


def conversation_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as turns; each is one scope with sessions of four turns."""
    rows = table(spark, folder, "conversations")
    session = F.floor(F.col("turn") / 4)
    day = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("conv_id") % 300).cast("int"))
    # every seventh conversation has one session without a date
    undated = (F.col("conv_id") % 7 == 0) & (session == 1)
    later = F.date_sub(day, session.cast("int"))
    return rows.select(
        F.col("conv_id").alias("scope_id"), session.cast("int").alias("session_pos"),
        F.concat_ws("-", F.lit("s"), "conv_id", session).alias("session_id"),
        F.when(~undated, F.date_format(later, "yyyy/MM/dd")).alias("session_date"),
        F.col("turn").alias("turn_index"), "role", F.col("text").alias("content"),
        (F.col("turn") == 1).alias("has_answer"))


def conversation_observations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.observations(conversation_turns(spark, folder))


def conversation_questions(spark: SparkSession, folder: str) -> DataFrame:
    """The first user turn of each conversation is its question."""
    rows = table(spark, folder, "conversations").filter("role = 'user'")
    first = rows.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    return first.select(
        F.col("conv_id").cast("string").alias("query_id"), F.col("conv_id").alias("scope_id"),
        "question")


def customer_questions(spark: SparkSession, folder: str) -> DataFrame:
    """One question per customer; by key it asks for a number, a date or a reason."""
    orders = table(spark, folder, "orders").select("o_custkey").distinct()
    key = F.col("o_custkey").cast("string")
    question = (
        F.when(F.col("o_custkey") % 4 == 0, F.concat(
            F.lit("What is the target number of customer "), key, F.lit(" on account")))
        .when(F.col("o_custkey") % 4 == 1, F.concat(
            F.lit("When was priority announced for customer "), key))
        .when(F.col("o_custkey") % 4 == 2, F.concat(
            F.lit("Why has this Customer "), key, F.lit(" low priority")))
        .otherwise(F.concat(F.lit("Which priority should customer have on account"))))
    return orders.select(
        F.concat(F.lit("q"), key).alias("query_id"), F.col("o_custkey").alias("scope_id"),
        question.alias("question"))


def document_memories(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as the memories of one global scope."""
    documents = table(spark, folder, "documents")
    return documents.select(
        F.lit(0).cast("long").alias("scope_id"), F.col("doc_id").alias("seq"),
        F.concat(F.lit("memory_claim#"), F.col("doc_id")).alias("mem_id"),
        F.lit(C.CLAIM).alias("mem_type"), F.lit(C.ACTIVE).alias("status"),
        F.col("text").alias("content"))


def benchmark_questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id")).alias("query_id"),
        F.lit(0).cast("long").alias("scope_id"), F.col("text").alias("question"))


def gold_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, mem_id) of documents that contain a benchmark passage.

    Only candidates the keyword index offers are compared as text, and a passage
    shares all of its keywords with a document that contains it.
    """
    plans = retrieve.plan_retrieval(benchmark_questions(spark, folder))
    memories = document_memories(spark, folder)
    complete = retrieve.keyword_matches(memories, plans).filter("score >= 1.0")
    return (
        complete.join(memories.select("mem_id", "content"), "mem_id")
        .join(plans.select("query_id", "question"), "query_id")
        .filter(F.contains("content", F.col("question"))).select("query_id", "mem_id"))


def requests(memories: DataFrame) -> DataFrame:
    """Every tenth memory of a customer is forgotten or archived two memories later."""
    asked = memories.filter((F.col("seq") + F.col("scope_id")) % 10 == 0)
    return asked.select(
        "scope_id", "mem_id",
        F.when(F.col("scope_id") % 2 == 0, "forget").otherwise("archive").alias("action"),
        (F.col("seq") + 1.5).alias("seq"))


def run_records(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs over labelled documents: one right by quality, one by toxicity."""
    labels = table(spark, folder, "labels")
    documents = table(spark, folder, "documents")
    joined = labels.join(documents, "doc_id")
    runs = joined.withColumn("run_id", F.explode(F.array(F.lit("flat"), F.lit("retain"))))
    flat = F.col("run_id") == "flat"
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", "doc_id", "run_id")), 1, 4), 16, 10).cast(
        "long")
    abstention = F.col("doc_id") % 17 == 0
    judged = F.col("doc_id") % 13 != 0
    return runs.select(
        "run_id", F.concat(F.lit("d"), F.col("doc_id"), F.when(abstention, "_abs").otherwise(""))
        .alias("question_id"),
        F.col("lang").alias("question_type"), abstention.alias("is_abstention"),
        F.when(draw % 29 == 0, "error").otherwise("done").alias("status"),
        F.col("text").alias("question"),
        F.col("source").alias("gold_answer"),
        F.col("text").alias("assembled_context"),
        F.concat(F.lit("Answer: "), F.col("source")).alias("hypothesis"),
        F.when(judged, F.when(flat, F.col("quality") == 1).otherwise(F.col("toxic") == 0))
        .alias("judge_correct"),
        F.when(~abstention, draw % 4 != 0).alias("turn_hit"),
        F.when(~abstention, (draw % 5) / 4.0).alias("turn_recall"),
        F.when(~abstention, draw % 3 != 0).alias("session_hit"),
        F.when(~abstention, (draw % 3) / 2.0).alias("session_recall"),
        estimate_tokens(F.col("text")).alias("context_tokens"),
        (F.col("n_chars") + draw % 7).alias("reader_prompt_tokens"),
        F.when(draw % 11 != 0, draw % 50).alias("reader_completion_tokens"),
        (F.col("n_chars") + draw % 7 + 10).alias("reader_total_tokens"),
        F.when(judged, draw % 90).alias("judge_total_tokens"),
        (F.col("doc_id") % 40 + 1).alias("ingest_n_obs"),
        (F.col("doc_id") % 33).alias("ingest_n_claims"),
    )


# ------------------------------------------------------------ lifecycle on customers


class CustomerLifecycle:
    """The stages from order observations to answers, each built once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.observations = order_observations(spark, folder)
        # kept, because every stage reads them
        self.memories = stored(extract.extract_memories(self.observations))

    @cached_property
    def changes(self) -> DataFrame:
        """Sought when first read: what knows no status has no use for them."""
        return reconcile.reconcile(self.memories)

    def current(self) -> DataFrame:
        """Memories with status and vector, kept as a table for the many readers."""
        current = reconcile.with_status(self.memories, self.changes)
        return materialize(retrieve.with_embedding(current, "content", tokens="tokens"))

    def relations(self, observations: DataFrame, memories: DataFrame) -> DataFrame:
        refs = enrich.temporal_refs(observations, extraction=DEFAULTS)
        amounts = enrich.quantities(observations, extraction=DEFAULTS)
        edges = (
            extract.provenance_edges(memories),
            enrich.mention_edges(refs, "has_temporal_ref"),
            enrich.mention_edges(amounts, "has_quantity"),
            concept_ops.about_entity_edges(memories),
        )
        out = edges[0]
        for more in edges[1:]:
            out = out.unionByName(more)
        return out

    def plans(self) -> DataFrame:
        asked = retrieve.plan_retrieval(customer_questions(self.spark, self.folder))
        return retrieve.with_embedding(asked, "question")
