"""Planning, retrieval, answers and evaluation over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.operators import (
    agentic,
    answer,
    enrich,
    extract,
    reconcile,
    retrieve,
    runs,
    stats,
    strategies,
)
from mnemoframe.operators import concepts as concept_ops
from mnemoframe.plans import oracle as O
from mnemoframe.plans import views as V
from mnemoframe.plans.catalog import query
from mnemoframe.settings import DEFAULTS


def _documents(spark, d):
    """Documents with vectors as memories, benchmark passages as planned questions."""
    memories = retrieve.with_embedding(
        V.document_memories(spark, d), "content", tokens="tokens")
    plans = retrieve.with_embedding(
        retrieve.plan_retrieval(V.benchmark_questions(spark, d)), "question")
    return memories, plans


def _conversations(spark, d):
    observed = V.conversation_observations(spark, d)
    memories = retrieve.with_embedding(
        extract.extract_memories(observed), "content", tokens="tokens")
    plans = retrieve.with_embedding(
        retrieve.plan_retrieval(V.conversation_questions(spark, d)), "question")
    return observed, memories, plans


def _scores(hits):
    return hits.select("query_id", "scope_id", "mem_id", F.round("score", 9).alias("score"))


# ------------------------------------------------------------ planning


@query("X7 X9", f"""
SELECT query_id, mode, array_to_string(required, ',') AS required, show_superseded::INT AS show_superseded,
  array_to_string({O.keywords('question')}, ' ') AS keywords,
  CASE scope_id % 3 WHEN 0 THEN 'memory_claim' WHEN 1 THEN 'procedural_memory,episodic_memory'
    ELSE 'memory_claim,episodic_memory,procedural_memory' END AS types
FROM plan_customers""")
def retrieval_plans(spark, d):
    key = F.col("scope_id") % 3
    asked = V.customer_questions(spark, d).withColumn(
        "memory_types",
        F.when(key == 0, F.array(F.lit("semantic"), F.lit("odd")))
        .when(key == 1, F.array(F.lit("procedural"), F.lit("episodic")))
        .otherwise(F.array(F.lit("unknown"))))
    return retrieve.plan_retrieval(asked).select(
        "query_id", "mode", F.array_join("required_data", ",").alias("required"),
        F.col("show_superseded").cast("int").alias("show_superseded"),
        F.array_join("keywords", " ").alias("keywords"),
        F.array_join("types", ",").alias("types"))


# ------------------------------------------------------------ legs and blends


@query("J3 K1 T8", """
SELECT query_id, scope_id, mem_id, round(score, 9) AS score FROM docs_kw
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) <= 10""")
def keyword_search_documents(spark, d):
    plans = retrieve.plan_retrieval(V.benchmark_questions(spark, d))
    return _scores(retrieve.keyword_search(V.document_memories(spark, d), plans))


@query("J4 K2 T9 T10", """
SELECT query_id, scope_id, mem_id, score FROM docs_vec
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) <= 10""")
def vector_search_documents(spark, d):
    return _scores(retrieve.vector_search(*_documents(spark, d)))


@query("K3 G16 G17", "SELECT query_id, scope_id, mem_id, round(score, 9) AS score, rank FROM docs_flat")
def flat_retrieval_documents(spark, d):
    hits = retrieve.flat_retrieve(*_documents(spark, d))
    return hits.select(
        "query_id", "scope_id", "mem_id", F.round("score", 9).alias("score"),
        F.col("rank").cast("long").alias("rank"))


@query("K3 X8", "SELECT query_id, scope_id, mem_id, round(score, 9) AS score FROM conv_flat")
def flat_retrieval_conversations(spark, d):
    _, memories, plans = _conversations(spark, d)
    return _scores(retrieve.flat_retrieve(memories, plans))


@query("K3 X8 R4", "SELECT query_id, scope_id, mem_id, round(score, 9) AS score FROM cust_flat")
def flat_retrieval_customers(spark, d):
    cycle = V.CustomerLifecycle(spark, d)
    return _scores(retrieve.flat_retrieve(cycle.current(), cycle.plans()))


@query("K4 X8", """
SELECT query_id, scope_id, mem_id, round(score, 9) AS score FROM (
  SELECT query_id, scope_id, mem_id, greatest(coalesce(k.score, 0), 0.6 * coalesce(v.score, 0)) AS score
  FROM cust_kw k FULL JOIN cust_vec v USING (query_id, scope_id, mem_id))
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) <= 7""")
def rank_facts_customers(spark, d):
    cycle = V.CustomerLifecycle(spark, d)
    return _scores(retrieve.rank_facts(cycle.current(), cycle.plans(), 7))


@query("Q7", """
SELECT g.query_id, count(*) AS n_gold, count(f.mem_id) AS n_found, count(f.mem_id) / count(*) AS recall,
  round(count(f.mem_id) / any_value(n_retrieved), 9) AS precision
FROM gold_docs g JOIN (
  SELECT query_id, count(*) AS n_retrieved FROM docs_flat WHERE rank <= 5 GROUP BY ALL) per
  ON per.query_id = g.query_id
LEFT JOIN (SELECT * FROM docs_flat WHERE rank <= 5) f
  ON f.query_id = g.query_id AND f.mem_id = g.mem_id GROUP BY g.query_id""")
def recall_at_5_documents(spark, d):
    hits = retrieve.flat_retrieve(*_documents(spark, d))
    return stats.precision_recall_at_k(hits, V.gold_documents(spark, d), 5).select(
        "query_id", "n_gold", "n_found", "recall", F.round("precision", 9).alias("precision"))


def reverse_by_length(question, candidates, keep):
    """A stand-in reranker: longest first, one made-up id, one repeated id."""
    ids = [i for i, text in sorted(candidates, key=lambda c: (-len(c[1]), c[0]))]
    return ["memory_claim#none", *ids[:1], *ids]


@query("K5 J11 U3", """
SELECT query_id, mem_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, mem_id) AS rank
FROM (SELECT f.query_id, f.mem_id, length(m.content) AS n FROM docs_flat f
  JOIN mem_documents m ON m.mem_id = f.mem_id)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, mem_id) <= 12""")
def reranked_documents(spark, d):
    memories, plans = _documents(spark, d)
    hits = V.materialize(retrieve.flat_retrieve(memories, plans))
    kept = retrieve.rerank(hits, memories, plans, reverse_by_length)
    return kept.select("query_id", "mem_id", F.col("rank").cast("long").alias("rank"))


def length_vectors(texts):
    """A stand-in embedding: refuses texts whose length ends in 7."""
    if any(len(t) % 10 == 7 for t in texts):
        raise ConnectionError("refused")
    return [[float(len(t) % 7 + 1), float(len(t) % 5), 1.0] for t in texts]


_LENGTHS = "[length(text) % 7 + 1, length(text) % 5, 1]::DOUBLE[]"


@query("U2 K2", f"""
SELECT 'b' || item_id AS query_id, 0 AS scope_id, 'memory_claim#' || doc_id AS mem_id,
  round(list_cosine_similarity(q, v), 9) AS score
FROM (SELECT item_id, {_LENGTHS} AS q FROM benchmark WHERE length(text) % 10 <> 7),
  (SELECT doc_id, {_LENGTHS} AS v FROM documents WHERE length(text) % 10 <> 7 AND text <> '')
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, mem_id) <= 5""")
def search_provided_vectors(spark, d):
    """Texts the provider refuses have no vector, as questions and as memories."""
    memories = retrieve.with_provided_embedding(
        V.document_memories(spark, d), "content", length_vectors, attempts=1)
    plans = retrieve.with_provided_embedding(
        retrieve.plan_retrieval(V.benchmark_questions(spark, d)), "question", length_vectors, attempts=1)
    return _scores(retrieve.vector_search(memories, plans, 5))


def every_third(plans, memories):
    """A stand-in controller: made-up ids, repeats, and nothing for some questions."""
    number = F.substring("query_id", 2, 9).cast("int")
    ids = F.array(F.lit("memory_claim#-1"), *[
        F.concat(F.lit("memory_claim#"), x) for x in (number * 3, number + 1, number * 3)])
    return plans.select("query_id", F.when(number % 4 == 0, F.array().cast("array<string>")).when(
        number % 4 == 1, F.array(F.lit("odd"))).otherwise(ids).alias("ids"))


@query("U5 J11", """
SELECT query_id, mem_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM (
  SELECT 'b' || item_id AS query_id, 'memory_claim#' || doc_id AS mem_id, min(place) AS place
  FROM (SELECT item_id, unnest([item_id * 3, item_id + 1]) AS doc_id, unnest([1, 2]) AS place
        FROM benchmark WHERE item_id % 4 > 1)
  JOIN documents USING (doc_id) GROUP BY ALL)""")
def controlled_documents(spark, d):
    memories = V.document_memories(spark, d)
    plans = retrieve.plan_retrieval(V.benchmark_questions(spark, d))
    hits = retrieve.controlled_hits(every_third, memories, plans)
    return hits.select("query_id", "mem_id", F.col("rank").cast("long").alias("rank"))


@query("K12", """
SELECT query_id, mem_id, used_tokens::BIGINT AS used_tokens FROM (
  SELECT f.query_id, f.mem_id, sum(length(m.content) // 4 + length(o.content) // 4)
    OVER (PARTITION BY f.query_id ORDER BY f.rank) AS used_tokens
  FROM conv_flat f JOIN mem_conv m ON m.scope_id = f.scope_id AND m.mem_id = f.mem_id
  JOIN obs_conversations o ON o.scope_id = m.scope_id AND o.seq = m.seq)
WHERE used_tokens <= 900""")
def hybrid_context_conversations(spark, d):
    observed, memories, plans = _conversations(spark, d)
    hits = retrieve.flat_retrieve(memories, plans)
    return retrieve.hybrid_context(hits, memories, observed, 900).select(
        "query_id", "mem_id", F.col("used_tokens").cast("long").alias("used_tokens"))


# ------------------------------------------------------------ results and fallback

O.define("signals", """
SELECT scope_id, src_id AS mem_id, max(rel = 'q') AS has_q, max(rel = 't') AS has_t FROM (
  SELECT scope_id, src_id, 't' AS rel FROM refs_orders
  UNION ALL SELECT scope_id, src_id, 'q' FROM qty_orders) GROUP BY ALL""")


def _results_sql(name: str, plans: str, hits: str, order: str) -> None:
    O.define(name, f"""
SELECT p.query_id, p.scope_id, p.question, p.required, coalesce(h.ids, []) AS ids,
  list_filter(p.required, lambda r: NOT (CASE r WHEN 'numeric_value' THEN coalesce(has_q, false)
    WHEN 'temporal_value' THEN coalesce(has_t, false) ELSE h.ids IS NOT NULL END)) AS missing
FROM {plans} p LEFT JOIN (
  SELECT f.query_id, list(f.mem_id ORDER BY {order}) AS ids, coalesce(bool_or(s.has_q), false) AS has_q,
    coalesce(bool_or(s.has_t), false) AS has_t
  FROM {hits} f LEFT JOIN signals s ON s.scope_id = f.scope_id AND s.mem_id = f.mem_id
  GROUP BY ALL) h ON h.query_id = p.query_id""")


_results_sql("res_first", "plan_customers", "cust_flat", "f.rank")
def _fallback_sql(p: str, first: str, second: str) -> None:
    """The second results that follow the first ones, over tables with prefix p."""
    O.define(p + "fb_plans", f"""
SELECT query_id, scope_id, ids AS previous, missing AS required, question || ' ' || array_to_string(
  list_transform(missing, lambda r: CASE r WHEN 'numeric_value' THEN 'amount number target size reserves'
    WHEN 'temporal_value' THEN 'date when year' ELSE r END), ' ') AS question,
  true AS show_superseded
FROM {first} WHERE len(missing) > 0""")
    O.define(p + "fb_kws", f"""
SELECT query_id, scope_id, len(kw) AS n_kw, unnest(kw) AS tok
FROM (SELECT *, {O.keywords('question')} AS kw FROM {p}fb_plans)""")
    O.define(p + "fb_hits", f"""
SELECT * FROM (
  SELECT p.query_id, p.scope_id, m.mem_id, count(*)::DOUBLE / any_value(n_kw) AS score
  FROM {p}fb_kws p JOIN cust_toks m ON m.scope_id = p.scope_id AND m.tok = p.tok
  WHERE m.status NOT IN ('archived', 'deleted') GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) <= 20""")
    O.define(p + "fb_combined", f"""
SELECT query_id, scope_id, mem_id, row_number() OVER (PARTITION BY query_id ORDER BY part, k) AS rank
FROM (
  SELECT query_id, scope_id, unnest(previous) AS mem_id, 0 AS part, generate_subscripts(previous, 1) AS k
  FROM {p}fb_plans
  UNION ALL
  SELECT h.query_id, h.scope_id, h.mem_id, 1, row_number() OVER (
    PARTITION BY h.query_id ORDER BY h.score DESC, h.mem_id)
  FROM {p}fb_hits h JOIN {p}fb_plans p ON p.query_id = h.query_id
  WHERE NOT list_contains(p.previous, h.mem_id))""")
    _results_sql(second, f"{p}fb_plans", f"{p}fb_combined", "f.rank")


_fallback_sql("", "res_first", "res_second")


class _Customers:
    """The question lifecycle over customers with every shared stage kept once."""

    def __init__(self, spark, d):
        cycle = V.CustomerLifecycle(spark, d)
        self.observations = cycle.observations
        self.memories = cycle.current()
        self.relations = V.materialize(cycle.relations(cycle.observations, self.memories))
        self.plans = V.materialize(cycle.plans())
        self.hits = retrieve.flat_retrieve(self.memories, self.plans)
        self.first = V.materialize(
            retrieve.retrieval_results(self.plans, self.hits, self.relations))

    def results(self):
        second = retrieve.fallback_retrieve(self.first, self.memories, self.relations)
        return V.materialize(self.first.unionByName(second))

    def answers(self, results):
        return V.materialize(answer.answers(results, self.memories, self.relations))


def _flat_results(rows):
    return rows.select(
        "query_id", F.array_join("retrieved_ids", ",").alias("ids"),
        F.array_join("missing_data", ",").alias("missing"), "confidence")


@query("J8 K9", """
SELECT query_id, array_to_string(ids, ',') AS ids, array_to_string(missing, ',') AS missing,
  CASE WHEN len(ids) > 0 AND len(missing) = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence
FROM res_first""")
def retrieval_results(spark, d):
    return _flat_results(_Customers(spark, d).first)


@query("K10", """
SELECT query_id, array_to_string(ids, ',') AS ids, array_to_string(missing, ',') AS missing,
  CASE WHEN len(ids) > 0 AND len(missing) = 0 THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence
FROM res_second""")
def fallback_results(spark, d):
    stage = _Customers(spark, d)
    return _flat_results(retrieve.fallback_retrieve(
        stage.first, stage.memories, stage.relations))


@query("K11", """
SELECT scope_id, unnest(ids) AS src_id, query_id || '/memory_retrieval_result#1' AS dst_id FROM res_first
UNION ALL SELECT scope_id, unnest(ids), query_id FROM res_first
UNION ALL SELECT scope_id, unnest(ids), query_id || '/memory_retrieval_result#2' FROM res_second""")
def retrieved_for_edges(spark, d):
    return retrieve.retrieved_for_edges(_Customers(spark, d).results()).select(
        "scope_id", "src_id", "dst_id")


# ------------------------------------------------------------ answers

def _answers_sql(p: str, first: str, second: str) -> None:
    O.define(p + "answered", f"""
SELECT *, false AS fb, query_id || '/memory_retrieval_result#1' AS result_id FROM {first} WHERE len(missing) = 0
UNION ALL SELECT *, true, query_id || '/memory_retrieval_result#2' FROM {second}""")
    O.define(p + "answer_rows", f"""
SELECT a.query_id, a.scope_id, a.result_id, a.fb, a.ids, a.missing,
  CASE WHEN len(a.ids) = 0 THEN 'I don''t have any stored memory that answers this question.'
    ELSE concat_ws(' ', 'Style preferences: ' || p.rules, p.facts,
      CASE WHEN len(a.missing) > 0 THEN '(Missing: ' || array_to_string(a.missing, ', ') || '.)' END)
  END AS answer
FROM {p}answered a LEFT JOIN (
  SELECT u.result_id, string_agg(CASE WHEN m.mem_type = 'procedural_memory' THEN m.content END, ' ' ORDER BY k) AS rules,
    string_agg(CASE WHEN m.mem_type <> 'procedural_memory' THEN m.content END, ' ' ORDER BY k) AS facts
  FROM (SELECT result_id, scope_id, unnest(ids) AS mem_id, generate_subscripts(ids, 1) AS k FROM {p}answered) u
  JOIN mem_status m ON m.scope_id = u.scope_id AND m.mem_id = u.mem_id GROUP BY ALL) p
  ON p.result_id = a.result_id""")


_answers_sql("", "res_first", "res_second")


@query("A1 A2", """
SELECT query_id, result_id || '/memory_answer' AS answer_id, answer, array_to_string(ids, ',') AS used,
  array_to_string([replace(replace(replace(i, 'memory_claim', 'memory_observation'),
    'episodic_memory', 'memory_observation'), 'procedural_memory', 'memory_observation') for i in ids], ',')
    AS evidence,
  CASE WHEN len(ids) > 0 AND len(missing) = 0 THEN 0.85 ELSE 0.4 END::DOUBLE AS confidence,
  fb::INT AS from_fallback
FROM answer_rows""")
def answers_customers(spark, d):
    stage = _Customers(spark, d)
    return stage.answers(stage.results()).select(
        "query_id", "answer_id", "answer", F.array_join("used_ids", ",").alias("used"),
        F.array_join("evidence_ids", ",").alias("evidence"), "confidence",
        F.col("from_fallback").cast("int").alias("from_fallback"))


@query("A2 A7", """
SELECT rel, count(*) AS n FROM (
  SELECT CASE WHEN len(ids) > 0 AND len(missing) = 0 THEN 'validated_by' ELSE 'invalidated_by' END AS rel
  FROM answer_rows
  UNION ALL SELECT 'used_in_answer' FROM (SELECT unnest(ids) FROM answer_rows)) GROUP BY ALL""")
def answer_edges(spark, d):
    stage = _Customers(spark, d)
    rows = stage.answers(stage.results())
    edges = answer.used_in_answer_edges(rows).select("rel").unionByName(
        answer.evaluation_edges(answer.evaluations(rows)).select("rel"))
    return edges.groupBy("rel").agg(F.count("*").alias("n"))


@query("A7", """
SELECT query_id, CASE WHEN len(ids) = 0 THEN 'unsupported' WHEN len(missing) > 0
  THEN 'partially_helpful' ELSE 'unknown' END AS outcome FROM answer_rows""")
def evaluations_customers(spark, d):
    stage = _Customers(spark, d)
    return answer.evaluations(stage.answers(stage.results())).select("query_id", "outcome")


@query("J15", """
SELECT query_id, max(result_id) AS result_id, max(result_id) || '/memory_answer' AS answer_id
FROM answer_rows GROUP BY ALL""")
def final_selection(spark, d):
    stage = _Customers(spark, d)
    results = stage.results()
    return answer.final_selection(stage.answers(results), results).select(
        "query_id", "result_id", "answer_id")


@query("A3", """
SELECT a.query_id, string_agg(CASE WHEN m.mem_type = 'episodic_memory'
    THEN '- [' || strftime(m.occurred_at, '%Y-%m-%d') || '] ' ELSE '- ' END || m.content, '|' ORDER BY k) AS lines
FROM (SELECT query_id, scope_id, unnest(ids) AS mem_id, generate_subscripts(ids, 1) AS k FROM answer_rows) a
JOIN mem_status m ON m.scope_id = a.scope_id AND m.mem_id = a.mem_id GROUP BY ALL""")
def fact_lines_customers(spark, d):
    stage = _Customers(spark, d)
    results = stage.results()
    lines = answer.fact_lines(stage.answers(results), results, stage.memories)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))["line"]
    return lines.groupBy("query_id").agg(F.array_join(ordered, "|").alias("lines"))


# ------------------------------------------------------------ reader context


class _ConversationContext:
    def __init__(self, spark, d):
        self.observations, memories, plans = _conversations(spark, d)
        self.memories, self.plans = V.materialize(memories), V.materialize(plans)
        self.relations = extract.provenance_edges(self.memories)
        hits = retrieve.flat_retrieve(self.memories, self.plans)
        self.results = V.materialize(
            retrieve.retrieval_results(self.plans, hits, self.relations))
        self.answers = V.materialize(
            answer.answers(self.results, self.memories, self.relations))
        ids = answer.interest_ids(self.answers, self.results)
        self.turns = V.materialize(
            answer.context_turns(ids, self.relations, self.observations))

    def questions(self):
        return self.plans.select(
            "query_id", F.concat(F.lit("t"), F.col("scope_id") % 3).alias("question_type"),
            (F.col("scope_id") % 10 == 3).alias("is_abstention"))

    def scores(self, spark, d):
        gold = V.conversation_turns(spark, d).filter("has_answer").select(
            F.col("scope_id").cast("string").alias("query_id"), "session_id", "turn_index")
        return answer.score_retrieval(self.questions(), gold, gold, self.turns)

    def context(self):
        shown = answer.shown_observations(self.turns, self.observations)
        labels = enrich.resolved_date_labels(enrich.temporal_refs(self.observations))
        return answer.assemble_context(
            self.plans, answer.fact_lines(self.answers, self.results, self.memories),
            answer.message_lines(shown, self.observations, labels))


O.define("conv_kw3", """
SELECT * FROM conv_kw QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) <= 40""")
O.define("conv_vec3", """
SELECT * FROM conv_vec QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) <= 40""")
O.define("conv_top3", """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) AS rank FROM (
  SELECT query_id, scope_id, mem_id, max(score) AS score FROM (
    SELECT * FROM conv_kw3
    UNION ALL SELECT query_id, scope_id, mem_id, 0.6 * score FROM conv_vec3) GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) <= 40""")
O.define("conv_seen", """
SELECT DISTINCT t.query_id, o.scope_id, o.seq, o.session_id, o.turn_index FROM conv_top3 t
JOIN mem_conv m ON m.scope_id = t.scope_id AND m.mem_id = t.mem_id
JOIN obs_conversations o ON o.scope_id = m.scope_id AND o.seq = m.seq""")


O.define("conv_scores", """
SELECT q.query_id,
  CASE WHEN t.n > 0 THEN t.found / t.n END AS turn_recall, (t.found = t.n)::INT AS turn_hit,
  CASE WHEN s.n > 0 THEN s.found / s.n END AS session_recall, (s.found = s.n)::INT AS session_hit,
  coalesce(t.n, 0) AS n_gold_turns
FROM plan_conv q LEFT JOIN (
  SELECT g.scope_id, count(*) AS n, count(c.query_id) AS found FROM conv_turns g LEFT JOIN conv_seen c
    ON c.scope_id = g.scope_id AND c.session_id = g.session_id AND c.turn_index = g.turn_index
  WHERE g.has_answer AND g.scope_id % 10 <> 3 GROUP BY ALL) t ON t.scope_id = q.scope_id
LEFT JOIN (
  SELECT g.scope_id, count(*) AS n, count(c.scope_id) AS found
  FROM (SELECT DISTINCT scope_id, session_id FROM conv_turns WHERE has_answer AND scope_id % 10 <> 3) g
  LEFT JOIN (SELECT DISTINCT scope_id, session_id FROM conv_seen) c
    ON c.scope_id = g.scope_id AND c.session_id = g.session_id GROUP BY ALL) s
  ON s.scope_id = q.scope_id""")


@query("J5 A8", "SELECT * FROM conv_scores")
def retrieval_scores_conversations(spark, d):
    """Gold is turn 1; every tenth conversation counts as an abstention question."""
    return _ConversationContext(spark, d).scores(spark, d).select(
        "query_id", "turn_recall", F.col("turn_hit").cast("int").alias("turn_hit"),
        "session_recall", F.col("session_hit").cast("int").alias("session_hit"),
        F.col("n_gold_turns").cast("long").alias("n_gold_turns"))


O.define("conv_shown", """
SELECT DISTINCT query_id, scope_id, seq FROM conv_seen
UNION SELECT s.query_id, o.scope_id, o.seq
FROM (SELECT DISTINCT query_id, scope_id, session_id FROM conv_seen) s
JOIN obs_conversations o ON o.scope_id = s.scope_id AND o.session_id = s.session_id
WHERE s.query_id IN (SELECT query_id FROM conv_seen GROUP BY query_id HAVING count(DISTINCT session_id) <= 2)
  AND s.query_id IN (SELECT x.query_id FROM (SELECT DISTINCT query_id, scope_id, session_id FROM conv_seen) x
    JOIN obs_conversations y ON y.scope_id = x.scope_id AND y.session_id = x.session_id
    GROUP BY x.query_id HAVING count(*) <= 40)""")
O.define("conv_context", f"""
SELECT p.query_id, coalesce(nullif(concat_ws(chr(10) || chr(10),
    'Remembered facts:' || chr(10) || f.lines, 'Relevant past messages:' || chr(10) || m.lines), ''),
    '(no relevant memory retrieved)') AS context
FROM plan_conv p
LEFT JOIN (SELECT t.query_id, string_agg('- ' || CASE WHEN m.mem_type = 'episodic_memory' AND m.occurred_at IS NOT NULL
      THEN '[' || strftime(m.occurred_at, '%Y-%m-%d') || '] ' ELSE '' END || m.content, chr(10) ORDER BY t.rank) AS lines
  FROM conv_top3 t JOIN mem_conv m ON m.scope_id = t.scope_id AND m.mem_id = t.mem_id GROUP BY ALL) f
  ON f.query_id = p.query_id
LEFT JOIN (SELECT s.query_id, string_agg('[' || coalesce(o.session_date, '') || '] ' || o.role || ': '
      || {O.strip('o.content')}, chr(10) ORDER BY o.seq) AS lines
  FROM conv_shown s JOIN obs_conversations o ON o.scope_id = s.scope_id AND o.seq = s.seq GROUP BY ALL) m
  ON m.query_id = p.query_id""")


@query("A4 A5", "SELECT query_id, md5(context) AS digest, length(context) AS n_chars FROM conv_context")
def assembled_contexts(spark, d):
    return _ConversationContext(spark, d).context().select(
        "query_id", F.md5("context").alias("digest"), F.length("context").alias("n_chars"))


O.define("conv_read", """
SELECT query_id, CASE WHEN query_id::BIGINT % 11 <> 5 THEN
    CASE WHEN length(context) % 2 = 0 THEN ' "Yes, it does.' ELSE 'No.' END END AS judge_text,
  length(context) // 4 + 100 AS reader_total_tokens, query_id::BIGINT % 70 AS judge_total_tokens
FROM conv_context WHERE query_id::BIGINT % 13 <> 6""")
O.define("conv_records", """
SELECT 't' || q.scope_id % 3 AS question_type, q.scope_id % 10 = 3 AS is_abstention, s.*,
  length(c.context) // 4 AS context_tokens, r.query_id IS NOT NULL AS done,
  CASE WHEN r.judge_text IS NOT NULL THEN r.judge_text LIKE '%Yes%' END AS judge_correct,
  r.reader_total_tokens, r.judge_total_tokens
FROM plan_conv q JOIN conv_scores s ON s.query_id = q.query_id
JOIN conv_context c ON c.query_id = q.query_id LEFT JOIN conv_read r ON r.query_id = q.query_id""")


@query("A8 G1 G2 T19", """
SELECT coalesce(question_type, 'OVERALL') AS slice, count(*) FILTER (done) AS n_questions,
  count(*) FILTER (judge_correct IS NOT NULL) AS n_judged,
  round(count(*) FILTER (judge_correct) / count(*) FILTER (judge_correct IS NOT NULL), 9) AS overall_accuracy,
  round(avg(turn_recall) FILTER (done AND NOT is_abstention), 9) AS turn_recall,
  round(avg(session_recall) FILTER (done AND NOT is_abstention), 9) AS session_recall,
  round(count(*) FILTER (done AND NOT is_abstention AND turn_hit = 1)
    / count(*) FILTER (done AND NOT is_abstention AND turn_hit IS NOT NULL), 9) AS turn_hit_rate,
  count(*) FILTER (NOT done) AS n_errors, sum(reader_total_tokens)::BIGINT AS reader_total_tokens,
  sum(judge_total_tokens)::BIGINT AS judge_total_tokens,
  sum(context_tokens)::BIGINT AS context_tokens
FROM conv_records GROUP BY GROUPING SETS ((question_type), ())""")
def conversation_run_metrics(spark, d):
    """From retrieval scores, contexts and a stand-in reader and judge to the run's report."""
    stage = _ConversationContext(spark, d)
    contexts = V.materialize(stage.context())
    key, size = F.col("query_id").cast("long"), F.length("context")
    read = contexts.filter(key % 13 != 6).select(
        "query_id", F.lit("ANSWER: x").alias("hypothesis"),
        F.when(key % 11 != 5, F.when(size % 2 == 0, ' "Yes, it does.').otherwise("No."))
        .alias("judge_text"),
        (F.floor(size / 4) + 100).alias("reader_total_tokens"), (key % 70).alias("judge_total_tokens"))
    records = V.materialize(runs.evaluated_records(
        "flat", stage.questions(), stage.scores(spark, d), contexts, read))
    overall = records.withColumn("question_type", F.lit(runs.OVERALL))
    rows = records.unionByName(overall)
    sizes = rows.groupBy("question_type").agg(F.sum("context_tokens").alias("context_tokens"))
    report = runs.metrics(rows, ("question_type",)).join(sizes, "question_type")
    rates = ("overall_accuracy", "turn_recall", "session_recall", "turn_hit_rate")
    return report.select(
        F.col("question_type").alias("slice"), "n_questions", "n_judged",
        *[F.round(c, 9).alias(c) for c in rates], "n_errors", "reader_total_tokens",
        "judge_total_tokens", "context_tokens")


@query("A6", """
SELECT doc_id, (length(text) // 4 > 300)::INT AS truncated, r AS kept_lines,
  md5(array_to_string(lines[1:((r + 1) // 2)] || lines[n - r // 2 + 1:n], chr(10))) AS digest
FROM (SELECT d.doc_id, text, lines, n, max(r) AS r FROM (
    SELECT doc_id, text, string_split(text, chr(10)) AS lines, len(string_split(text, chr(10))) AS n
    FROM documents) d, LATERAL (SELECT unnest(generate_series(0, n)) AS r) c
  WHERE r = n AND length(text) // 4 <= 300 OR (
    coalesce(list_sum(list_transform(lines[1:((r + 1) // 2)], lambda x: length(x))), 0)
    + coalesce(list_sum(list_transform(lines[n - r // 2 + 1:n], lambda x: length(x))), 0)
    + greatest(r - 1, 0)) // 4 <= 300
  GROUP BY ALL)""")
def cut_contexts(spark, d):
    documents = V.table(spark, d, "documents")
    return answer.cut_context(documents, "text", 300).select(
        "doc_id", F.col("truncated").cast("int").alias("truncated"),
        F.col("kept_lines").cast("long").alias("kept_lines"), F.md5("cut_text").alias("digest"))


# ------------------------------------------------------------ concept-based retrieval

_PLAN_CONCEPTS = O.keywords("question")
O.define("question_names", rf"""
SELECT DISTINCT query_id, scope_id, {O.norm('name')} AS normalized FROM (
  SELECT query_id, scope_id, unnest((list_filter(raw, lambda x, i: list_position(norms, norms[i]) = i))[1:6]) AS name
  FROM (SELECT *, list_transform(raw, lambda n: {O.norm('n')}) AS norms FROM (
    SELECT *, list_filter(regexp_extract_all(question, '\b([A-Z][\w&.\-]*(?:\s+[A-Z][\w&.\-]*){{0,3}})\b', 1)
        || {_PLAN_CONCEPTS}, lambda n: length(n) >= 2) AS raw FROM plan_customers)))""")
O.define("concept_rows", """
SELECT scope_id, normalized, 'memory_concept#' || md5(normalized) AS concept_id,
  arg_min(name, seq * 100 + pos) AS name FROM concept_mentions GROUP BY ALL""")
O.define("concept_cvec", O.embed_sql("concept_rows", "scope_id, concept_id", "name"))
O.define("concept_hits", """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, concept_id) AS rank FROM (
  SELECT a.query_id, a.scope_id, b.concept_id, round(sum(a.w * b.w), 9) AS score
  FROM cust_qvec a JOIN concept_cvec b ON b.scope_id = a.scope_id AND b.idx = a.idx
  GROUP BY ALL) WHERE score > 0""")


@query("C3", "SELECT query_id, concept_id, score FROM concept_hits WHERE rank <= 5")
def concept_search(spark, d):
    cycle = V.CustomerLifecycle(spark, d)
    found = concept_ops.build_concepts(cycle.memories)
    return concept_ops.search_concepts(found, cycle.plans(), 5).select(
        "query_id", "concept_id", "score")


@query("J6", """
SELECT DISTINCT n.query_id, 'memory_concept#' || md5(n.normalized) AS concept_id FROM question_names n
JOIN concept_mentions c ON c.scope_id = n.scope_id AND c.normalized = n.normalized""")
def concept_lookup(spark, d):
    cycle = V.CustomerLifecycle(spark, d)
    found = concept_ops.build_concepts(cycle.memories)
    return concept_ops.lookup_concepts(found, cycle.plans()).select("query_id", "concept_id")


@query("J7 C4", """
SELECT n.query_id, c.mem_id, count(DISTINCT n.normalized) AS n_shared FROM question_names n
JOIN concept_mentions c ON c.scope_id = n.scope_id AND c.normalized = n.normalized GROUP BY ALL""")
def linked_facts_with_overlap(spark, d):
    cycle = V.CustomerLifecycle(spark, d)
    plans = cycle.plans()
    edges = concept_ops.about_entity_edges(cycle.memories)
    found = concept_ops.lookup_concepts(concept_ops.build_concepts(cycle.memories), plans)
    facts = concept_ops.facts_for_concepts(found, edges)
    return concept_ops.entity_overlap(facts, edges, plans).select("query_id", "mem_id", "n_shared")


def _pool(k: int, with_direct: bool) -> str:
    inside = f"coalesce(round <= {k}, false)" + (" OR direct" if with_direct else "")
    return (f"max(score) FILTER ({inside}) AS top, count(*) FILTER (({inside}) AND score >= 0.3) AS strong, "
            f"count(*) FILTER ({inside}) AS n")


_STAGES = [(1, False)] + [(k, True) for k in range(1, 5)]
O.define("fact_scores", """
SELECT query_id, scope_id, mem_id, greatest(coalesce(k.score, 0), 0.6 * coalesce(v.score, 0)) AS score
FROM cust_kw k FULL JOIN cust_vec v USING (query_id, scope_id, mem_id)""")
O.define("agentic_pool", """
SELECT s.query_id, s.scope_id, s.mem_id, s.score, r.round,
  row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.mem_id) <= 40 AS direct
FROM fact_scores s LEFT JOIN (
  SELECT h.query_id, m.mem_id, min((h.rank + 9) // 10) AS round FROM concept_hits h
  JOIN concept_mentions m ON m.scope_id = h.scope_id AND 'memory_concept#' || md5(m.normalized) = h.concept_id
  WHERE h.rank <= 40 GROUP BY ALL) r ON r.query_id = s.query_id AND r.mem_id = s.mem_id""")
O.define("agentic_stages", " UNION ALL ".join(
    f"SELECT query_id, {i} AS stage, {k} AS iterations, {str(direct).lower()} AS with_direct, {_pool(k, direct)} "
    f"FROM agentic_pool GROUP BY query_id" for i, (k, direct) in enumerate(_STAGES)))
O.define("agentic_decision", """
SELECT query_id, iterations, with_direct, conf FROM (
  SELECT *, CASE WHEN top IS NULL THEN 0.0
    ELSE least(1.0, 0.5 * top + 0.5 * least(strong / 3.0, 1.0)) END AS conf FROM agentic_stages)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY
  CASE WHEN conf >= 0.75 AND n >= 3 THEN stage WHEN stage = 4 THEN 90 ELSE 100 END, stage) = 1""")


def _agentic(spark, d):
    cycle = V.CustomerLifecycle(spark, d)
    memories, plans = cycle.current(), V.materialize(cycle.plans())
    concepts = concept_ops.build_concepts(memories)
    edges = concept_ops.about_entity_edges(memories)
    return agentic.agentic_retrieve(memories, concepts, edges, plans)


@query("K6 K7 K8", """
SELECT query_id, mem_id, round(score, 9) AS score FROM agentic_pool p JOIN agentic_decision x USING (query_id)
WHERE coalesce(p.round <= x.iterations, false) OR (p.direct AND x.with_direct)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) <= 40""")
def agentic_hits(spark, d):
    hits, _ = _agentic(spark, d)
    return hits.select("query_id", "mem_id", F.round("score", 9).alias("score"))


@query("K6 K7 K9", """
SELECT p.query_id, coalesce(x.iterations, 4) AS iterations, round(coalesce(x.conf, 0.0), 9)::DOUBLE AS confidence
FROM plan_customers p LEFT JOIN agentic_decision x ON x.query_id = p.query_id""")
def agentic_decisions(spark, d):
    _, decision = _agentic(spark, d)
    return decision.select(
        "query_id", "iterations", F.round("confidence", 9).alias("confidence"))


# ------------------------------------------------------------ strategies

O.define("agentic_top", """
SELECT query_id, p.scope_id, mem_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) AS rank
FROM agentic_pool p JOIN agentic_decision x USING (query_id)
WHERE coalesce(p.round <= x.iterations, false) OR (p.direct AND x.with_direct)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) <= 40""")
_results_sql("res_agentic", "plan_customers", "agentic_top", "f.rank")
_fallback_sql("a_", "res_agentic", "res_agentic_second")
_answers_sql("a_", "res_agentic", "res_agentic_second")

O.define("reranked_top", """
SELECT f.query_id, f.scope_id, f.mem_id, row_number() OVER (
  PARTITION BY f.query_id ORDER BY length(m.content) DESC, f.mem_id) AS rank
FROM cust_flat f JOIN mem_status m ON m.scope_id = f.scope_id AND m.mem_id = f.mem_id
QUALIFY row_number() OVER (PARTITION BY f.query_id ORDER BY length(m.content) DESC, f.mem_id) <= 2""")
_results_sql("res_reranked", "plan_customers", "reranked_top", "f.rank")
_fallback_sql("r_", "res_reranked", "res_reranked_second")


def _strategy(spark, d, reranker=None, **changes):
    cycle = V.CustomerLifecycle(spark, d)
    memories = cycle.current()
    relations = V.materialize(cycle.relations(cycle.observations, memories))
    return strategies.answer_questions(
        memories, V.materialize(cycle.plans()), relations, DEFAULTS.but(**changes), reranker)


@query("K6 K9 K10 J8", """
SELECT r.query_id, false AS is_fallback, array_to_string(ids, ',') AS ids, array_to_string(missing, ',') AS missing,
  round(CASE WHEN len(missing) > 0 THEN least(own, 0.5) ELSE own END, 9)::DOUBLE AS confidence
FROM (SELECT r.*, CASE WHEN len(ids) > 0 THEN greatest(0.0, least(1.0, x.conf)) ELSE 0.2 END AS own
  FROM res_agentic r LEFT JOIN agentic_decision x USING (query_id)) r
UNION ALL
SELECT query_id, true, array_to_string(ids, ','), array_to_string(missing, ','),
  CASE WHEN len(ids) > 0 AND len(missing) = 0 THEN 0.7 ELSE 0.4 END::DOUBLE FROM res_agentic_second""")
def agentic_results(spark, d):
    results = _strategy(spark, d, retrieval_strategy="agentic").results
    return results.select(
        "query_id", "is_fallback", F.array_join("retrieved_ids", ",").alias("ids"),
        F.array_join("missing_data", ",").alias("missing"),
        F.round("confidence", 9).alias("confidence"))


@query("K6 A1 A7", """
SELECT query_id, result_id || '/memory_answer' AS answer_id, answer,
  CASE WHEN len(ids) = 0 THEN 'unsupported' WHEN len(missing) > 0
    THEN 'partially_helpful' ELSE 'unknown' END AS outcome FROM a_answer_rows""")
def agentic_answers(spark, d):
    outcome = _strategy(spark, d, retrieval_strategy="agentic")
    judged = outcome.evaluations.select("answer_id", "outcome")
    return outcome.answers.join(judged, "answer_id").select(
        "query_id", "answer_id", "answer", "outcome")


@query("K5 U3 J8 K10", """
SELECT query_id, array_to_string(ids, ',') AS ids, array_to_string(missing, ',') AS missing,
  CASE WHEN len(ids) > 0 AND len(missing) = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence
FROM res_reranked
UNION ALL SELECT query_id, array_to_string(ids, ','), array_to_string(missing, ','),
  CASE WHEN len(ids) > 0 AND len(missing) = 0 THEN 0.7 ELSE 0.4 END::DOUBLE FROM res_reranked_second""")
def reranked_results(spark, d):
    """Two facts are left per question, so signals go missing and the fallback seeks them."""
    return _flat_results(
        _strategy(spark, d, reverse_by_length, enable_rerank=True, rerank_keep=2).results)


@query("R5 K11 A2 A7", """
SELECT m.scope_id, m.mem_id, m.status, coalesce(r.n, 0) AS n_retrievals, coalesce(a.n, 0) AS n_answers,
  coalesce(a.n, 0) AS n_evaluations
FROM mem_status m LEFT JOIN (
  SELECT scope_id, mem_id, sum(k)::BIGINT AS n FROM (
    SELECT scope_id, unnest(ids) AS mem_id, 2 AS k FROM res_first
    UNION ALL SELECT scope_id, unnest(ids), 1 FROM res_second) GROUP BY ALL) r
  ON r.scope_id = m.scope_id AND r.mem_id = m.mem_id
LEFT JOIN (SELECT scope_id, mem_id, count(*) AS n FROM (
    SELECT scope_id, unnest(ids) AS mem_id FROM answer_rows) GROUP BY ALL) a
  ON a.scope_id = m.scope_id AND a.mem_id = m.mem_id""")
def lifecycle_audit_of_use(spark, d):
    """How often each memory was retrieved, used in an answer and judged with it."""
    outcome = _strategy(spark, d)
    relations = (
        retrieve.retrieved_for_edges(outcome.results)
        .unionByName(answer.used_in_answer_edges(outcome.answers))
        .unionByName(answer.evaluation_edges(outcome.evaluations)))
    memories = V.CustomerLifecycle(spark, d).current()
    return reconcile.lifecycle_audit(memories, V.materialize(relations)).select(
        "scope_id", "mem_id", "status", "n_retrievals", "n_answers", "n_evaluations")


_BOOST, _RATIO = 0.1, 0.7
O.define("weighted_pool", f"""
SELECT p.*, p.score + {_BOOST}::DOUBLE * coalesce(s.n, 0) AS final, split_part(p.mem_id, '#', 2)::BIGINT AS num
FROM agentic_pool p LEFT JOIN (
  SELECT n.query_id, c.mem_id, count(DISTINCT n.normalized) AS n FROM question_names n
  JOIN concept_mentions c ON c.scope_id = n.scope_id AND c.normalized = n.normalized GROUP BY ALL) s
  ON s.query_id = p.query_id AND s.mem_id = p.mem_id""")
O.define("weighted_stages", " UNION ALL ".join(
    f"SELECT query_id, {i} AS stage, {k} AS iterations, {str(direct).lower()} AS with_direct, "
    f"first(score ORDER BY final DESC, num DESC) AS top, count(*) FILTER (score >= 0.3) AS strong, "
    f"count(*) AS n FROM weighted_pool WHERE coalesce(round <= {k}, false)"
    + (" OR direct" if direct else "") + " GROUP BY query_id"
    for i, (k, direct) in enumerate(_STAGES)))
O.define("weighted_decision", """
SELECT query_id, iterations, with_direct FROM (
  SELECT *, 0.5 * top + 0.5 * least(strong / 3.0, 1.0) AS conf FROM weighted_stages)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY
  CASE WHEN least(1.0, conf) >= 0.75 AND n >= 3 THEN stage WHEN stage = 4 THEN 90 ELSE 100 END, stage) = 1""")


@query("K6 K8 C4", f"""
SELECT query_id, mem_id, round(score, 9) AS score, row_number() OVER (
  PARTITION BY query_id ORDER BY final DESC, num DESC, mem_id) AS rank
FROM (SELECT p.*, max(final) OVER (PARTITION BY query_id) AS best
  FROM weighted_pool p JOIN weighted_decision x USING (query_id)
  WHERE coalesce(p.round <= x.iterations, false) OR (p.direct AND x.with_direct))
WHERE final >= best * {_RATIO}::DOUBLE
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY final DESC, num DESC, mem_id) <= 5""")
def agentic_weighted(spark, d):
    """Facts that share the question's entities first, those far below the best left out."""
    outcome = _strategy(
        spark, d, retrieval_strategy="agentic", agentic_entity_overlap_weight=_BOOST,
        agentic_rerank_keep_ratio=_RATIO, agentic_rerank_limit=5)
    return outcome.hits.select(
        "query_id", "mem_id", F.round("score", 9).alias("score"),
        F.col("rank").cast("long").alias("rank"))
