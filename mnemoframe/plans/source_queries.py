"""Sources, sinks, stores and caches: write, read back and compare."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from mnemoframe.operators import cache, runs, sample
from mnemoframe.operators.groups import shared_folder
from mnemoframe.plans import report_queries  # noqa: F401  (defines the records table)
from mnemoframe.plans import views as V
from mnemoframe.plans.catalog import query
from mnemoframe.sources import conversations, fingerprint, store


def scratch(spark) -> str:
    """A fresh folder in the shared folder of the cluster."""
    return f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def _nested_split(spark, d):
    """Conversations as nested instances."""
    turns = V.conversation_turns(spark, d)
    one = F.struct("role", "content", "has_answer")
    sessions = turns.groupBy("scope_id", "session_pos", "session_id", "session_date").agg(
        F.array_sort(F.collect_list(F.struct("turn_index", one.alias("t"))))["t"].alias("turns"))
    nested = sessions.groupBy("scope_id").agg(
        F.array_sort(F.collect_list(
            F.struct("session_pos", "session_id", "session_date", "turns"))).alias("s"))
    abstention = F.when(F.col("scope_id") % 10 == 3, "_abs").otherwise("")
    return nested.select(
        F.concat(F.lit("c"), "scope_id", abstention).alias("question_id"),
        F.lit("single").alias("question_type"), F.lit("what?").alias("question"),
        F.col("scope_id").alias("answer"), F.lit("2023/06/01").alias("question_date"),
        F.slice("s.session_id", 1, 1).alias("answer_session_ids"),
        # the last id is left out, so the loader has to make one up
        F.expr("slice(s.session_id, 1, size(s) - 1)").alias("haystack_session_ids"),
        F.transform("s.session_date", lambda x: F.coalesce(x, F.lit("")))
        .alias("haystack_dates"),
        F.col("s.turns").alias("haystack_sessions"),
    )


def _write_split(spark, d) -> str:
    """One JSON object per line."""
    path = scratch(spark)
    _nested_split(spark, d).write.json(path)
    return path


def _array_lines(batches):
    """The rows of a task as the lines of one JSON array."""
    begin = "["
    for batch in batches:
        yield pd.DataFrame({"value": [begin + batch["value"].iloc[0], *("," + batch["value"].iloc[1:])]})
        begin = ","
    yield pd.DataFrame({"value": ["]" if begin == "," else "[]"]})


def _write_arrays(spark, d) -> str:
    """One JSON array per file; session dates in all three forms, by session."""
    nested = _nested_split(spark, d)
    hour = F.lpad((F.ascii(F.substring("question_id", -1, 1)) % 24).cast("string"), 2, "0")
    dates = F.transform(F.col("haystack_dates"), lambda x, i: F.when(
        (x == "") | (i % 3 == 0), x).when(i % 3 == 1, F.concat(x, F.lit(" "), hour, F.lit(":05")))
        .otherwise(F.concat(x, F.lit(" (Sat) "), hour, F.lit(":05"))))
    rows = nested.withColumn("haystack_dates", dates)
    path = scratch(spark)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).mapInPandas(
        _array_lines, "value string").write.text(path)
    return path


@query("S1 S2 S6", r"""
SELECT 'c' || t.scope_id || CASE WHEN t.scope_id % 10 = 3 THEN '_abs' ELSE '' END AS scope_id,
  t.turn_index % 4 AS turn_index, t.session_pos,
  CASE WHEN t.session_pos = m.last_pos THEN 'session_' || t.session_pos ELSE t.session_id END AS session_id,
  strftime(try_strptime(t.session_date, '%Y/%m/%d'), '%Y-%m-%d') AS day, t.role,
  md5(t.content) AS digest, t.has_answer::INT AS has_answer
FROM conv_turns t JOIN (SELECT scope_id, max(session_pos) AS last_pos FROM conv_turns GROUP BY ALL) m
  ON m.scope_id = t.scope_id""")
def nested_split_turns(spark, d):
    nested = conversations.read_split(spark, _write_split(spark, d), json_lines=True)
    turns = conversations.turns(nested)
    return turns.select(
        "scope_id", F.col("turn_index").cast("long").alias("turn_index"), "session_pos",
        "session_id",
        F.date_format(conversations.parse_session_date(F.col("session_date")), "yyyy-MM-dd")
        .alias("day"),
        "role", F.md5("content").alias("digest"), F.col("has_answer").cast("int")
        .alias("has_answer"))


@query("S1 S6", """
SELECT 'c' || conv_id || CASE WHEN conv_id % 10 = 3 THEN '_abs' ELSE '' END AS question_id,
  (conv_id % 10 = 3)::INT AS is_abstention, conv_id::VARCHAR AS answer,
  's-' || conv_id || '-0' AS answer_session FROM conversations GROUP BY ALL""")
def nested_split_questions(spark, d):
    nested = conversations.read_split(spark, _write_split(spark, d), json_lines=True)
    return conversations.instances(nested).select(
        "question_id", F.col("is_abstention").cast("int").alias("is_abstention"), "answer",
        F.get("answer_session_ids", F.lit(0)).alias("answer_session"))


@query("S1 S2", r"""
SELECT 'c' || t.scope_id || CASE WHEN t.scope_id % 10 = 3 THEN '_abs' ELSE '' END AS scope_id,
  t.turn_index % 4 AS turn_index, t.session_pos,
  strftime(try_strptime(t.session_date, '%Y/%m/%d') + CASE WHEN t.session_pos % 3 > 0 THEN to_minutes(
    5 + 60 * ((CASE WHEN t.scope_id % 10 = 3 THEN ascii('s') ELSE ascii(right(t.scope_id::VARCHAR, 1)) END) % 24)::INT)
    ELSE to_minutes(0) END, '%Y-%m-%d %H:%M') AS at, md5(t.content) AS digest FROM conv_turns t""")
def array_split_turns(spark, d):
    """The split as JSON arrays, which are read by byte ranges."""
    turns = conversations.turns(conversations.read_split(spark, _write_arrays(spark, d)))
    return turns.select(
        "scope_id", F.col("turn_index").cast("long").alias("turn_index"), "session_pos",
        F.date_format(conversations.parse_session_date(F.col("session_date")), "yyyy-MM-dd HH:mm")
        .alias("at"), F.md5("content").alias("digest"))


@query("S3", """
SELECT kind, count(*) AS n, count(DISTINCT content) AS n_texts, max(strftime(day, '%Y-%m-%d')) AS last_day,
  sum(required)::BIGINT AS n_required FROM (
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'query' ELSE 'observation' END AS kind,
    o_orderpriority AS content, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS day,
    CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS required FROM orders) GROUP BY ALL""")
def jsonl_fixture(spark, d):
    orders = V.table(spark, d, "orders")
    asked = F.col("o_orderkey") % 3 == 0
    path = scratch(spark)
    orders.select(
        F.lit("user").alias("actor"), F.col("o_orderpriority").alias("content"),
        F.lit("chat").alias("source"),
        F.when(~asked, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
        .alias("occurred_at"),
        F.when(asked, "query").alias("kind"),
        F.when(asked, F.array(F.lit("numeric_value"))).alias("required_data"),
    ).write.json(path)
    lines = conversations.read_jsonl(spark, path)
    observed = conversations.fixture_observations(lines).select(
        F.lit("observation").alias("kind"), "content", "occurred_at", F.lit(0).alias("required"))
    queries = conversations.fixture_queries(lines).select(
        F.lit("query").alias("kind"), F.col("question").alias("content"),
        F.lit(None).cast("timestamp").alias("occurred_at"),
        F.size("required_data").alias("required"))
    return observed.unionByName(queries).groupBy("kind").agg(
        F.count("*").alias("n"), F.count_distinct("content").alias("n_texts"),
        F.date_format(F.max("occurred_at"), "yyyy-MM-dd").alias("last_day"),
        F.sum("required").alias("n_required"))


# ------------------------------------------------------------ run store


def _versions(spark, d):
    """Every record as a pending row, then a result for most, then a late correction."""
    records = V.run_records(spark, d).filter("run_id = 'flat'")
    pending = records.select(
        "question_id", "question_type", F.lit("pending").alias("status"),
        F.lit(1.0).alias("updated_at"), F.lit(1.0).alias("created_at"))
    result = records.filter("context_tokens % 5 > 0").select(
        "question_id", "status", "context_tokens", F.lit(2.0).alias("updated_at"))
    corrected = records.filter("context_tokens % 7 = 0").select(
        "question_id", F.lit(0).cast("long").alias("context_tokens"),
        F.lit(3.0).alias("updated_at"))
    return store.evolve(store.evolve(pending, result), corrected)


@query("S10 S11", """
SELECT question_id, question_type,
  CASE WHEN context_tokens % 5 > 0 THEN status ELSE 'pending' END AS status,
  CASE WHEN context_tokens % 7 = 0 THEN 0 WHEN context_tokens % 5 > 0 THEN context_tokens END AS context_tokens,
  CASE WHEN context_tokens % 7 = 0 THEN 3.0 WHEN context_tokens % 5 > 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS updated_at,
  1.0::DOUBLE AS created_at
FROM records WHERE run_id = 'flat'""")
def upserted_records(spark, d):
    return store.current_records(_versions(spark, d))


@query("S12", """
SELECT question_id, '["' || question_type || '","' || status || '"]' AS encoded,
  is_abstention::INT AS flag, 2 AS n_back FROM records WHERE run_id = 'flat'""")
def column_codec(spark, d):
    records = V.run_records(spark, d).filter("run_id = 'flat'").withColumn(
        "evidence_ids", F.array("question_type", "status"))
    encoded = store.encode_columns(records.select("question_id", "evidence_ids", "is_abstention"))
    both = encoded.select(
        "question_id", F.col("evidence_ids").alias("encoded"),
        F.col("is_abstention").alias("flag"))
    back = store.decode_columns(encoded).select(
        "question_id", F.size("evidence_ids").alias("n_back"))
    return both.join(back, "question_id")


@query("S13", """
SELECT question_id, question_type, is_abstention::INT AS is_abstention, md5(question) AS question,
  gold_answer, hypothesis, judge_correct::INT AS judge_correct, turn_hit::INT AS turn_hit,
  session_hit::INT AS session_hit FROM records WHERE run_id = 'flat' AND status = 'done'""")
def hypotheses_sink(spark, d):
    """All nine written fields, read back."""
    path = scratch(spark)
    store.write_hypotheses(V.run_records(spark, d).filter("run_id = 'flat'"), path)
    schema = ("question_id string, question_type string, is_abstention boolean, question string, "
              "gold_answer string, hypothesis string, judge_correct boolean, turn_hit boolean, "
              "session_hit boolean")
    flags = ["is_abstention", "judge_correct", "turn_hit", "session_hit"]
    return spark.read.schema(schema).json(path).withColumns(
        {c: F.col(c).cast("int") for c in flags}).withColumn("question", F.md5("question"))


@query("S14 G1", """
SELECT run_id, 's' AS split, CASE run_id WHEN 'retain' THEN 'reader-2024' END AS reader_resolved,
  (run_id = 'flat')::INT AS unavailable, count(*) FILTER (status = 'done') AS n_done,
  count(*) FILTER (status = 'error') AS n_error,
  count(*) FILTER (status = 'done' AND judge_correct IS NOT NULL) AS n_judged
FROM records GROUP BY ALL""")
def run_manifest(spark, d):
    records = V.run_records(spark, d).withColumns({
        "reader_requested_model": F.lit("reader"),
        "reader_resolved_model": F.when(F.col("run_id") == "retain", "reader-2024")
        .otherwise("reader"),
        "judge_requested_model": F.lit("judge"), "judge_resolved_model": F.lit(""),
        "updated_at": F.col("context_tokens")})
    path = scratch(spark)
    written = store.manifest(records, runs.metrics(records), {"split": "s", "seed": 42})
    written.write.json(path)
    back = spark.read.schema(written.schema).json(path)
    return back.select(
        "run_id", "config.split", F.col("models.reader.resolved_model").alias("reader_resolved"),
        F.col("models.reader.resolved_model_unavailable").cast("int").alias("unavailable"),
        "status_counts.n_done", "status_counts.n_error", "metrics.n_judged")


@query("S15", """
SELECT count(*) AS n, sha256(string_agg(question_id, chr(10) ORDER BY question_id)) AS sha256 FROM sampled""")
def sample_fingerprint(spark, d):
    ids = sample.stratified_sample(V.run_records(spark, d).filter("run_id = 'flat'"), 50)
    return fingerprint.sample_fingerprint(ids, "question_id").drop("matches")


_PIECES = " || ':' || ".join(
    f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::UBIGINT::HUGEINT)" for i in range(4))


@query("S15", f"""
SELECT count(*) AS n, sha256({_PIECES}) AS sha256
FROM (SELECT sha256(doc_id::VARCHAR) AS h FROM documents)""")
def id_set_fingerprint(spark, d):
    ids = V.table(spark, d, "documents")
    return fingerprint.id_set_fingerprint(ids, "doc_id").drop("matches")


@query("S15")
def file_fingerprint(spark, d):
    """A file's bytes are not visible to SQL; checked against hashlib in the tests."""
    return fingerprint.file_fingerprints(spark, f"{d}/labels.parquet")


@query("S16", """
SELECT vec_id, len(embedding) AS dim, 0 AS n_changed FROM embeddings""")
def vector_round_trip(spark, d):
    vectors = V.table(spark, d, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") / 3).alias("v"))
    path = scratch(spark)
    vectors.write.parquet(path)
    back = spark.read.parquet(path).withColumnRenamed("v", "w")
    return vectors.join(back, "vec_id").select(
        "vec_id", F.size("w").alias("dim"),
        F.size(F.filter(F.zip_with("v", "w", lambda a, b: a != b), lambda x: x))
        .alias("n_changed"))


# ------------------------------------------------------------ content cache


def upper_or_fail(texts):
    """A stand-in provider: fails on texts of even length, is empty for a few others."""
    return texts.map(
        lambda t: None if len(t) % 2 == 0 else ("" if len(t) % 3 == 0 else str(len(t))))


@query("J10 T22 U1", """
SELECT doc_id, CASE WHEN length(t) % 2 = 0 THEN NULL WHEN length(t) % 3 = 0 THEN ''
  ELSE length(t)::VARCHAR END AS payload
FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)""")
def cached_enrichment(spark, d):
    documents = V.table(spark, d, "documents").select("doc_id", "text")
    keyed = documents.withColumn("key", cache.cache_key(
        "model", F.lit("v1"), F.btrim("text", F.lit(" \t\n\r"))))
    path = scratch(spark)
    # a first fill covers part of the texts, the second only what is missing
    cache.refresh(spark, path, keyed.filter("length(text) > 500"), "text", upper_or_fail)
    return cache.refresh(spark, path, keyed, "text", upper_or_fail).select("doc_id", "payload")
