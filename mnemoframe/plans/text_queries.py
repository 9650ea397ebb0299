"""Text functions, time references and quantities over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe import constants as C
from mnemoframe.functions import concepts as N
from mnemoframe.functions import text as T
from mnemoframe.functions.vectors import EMBED_DIM, cosine_similarity, hash_embedding
from mnemoframe.operators import enrich, extract
from mnemoframe.operators.retrieve import vector_search
from mnemoframe.plans import oracle as O
from mnemoframe.plans import views as V
from mnemoframe.plans.catalog import query
from mnemoframe.settings import DEFAULTS


@query("T1 T4 T14 T17", f"""
SELECT doc_id, {O.norm('text')} AS normalized, length(text) // 4 AS est_tokens FROM documents""")
def text_normalize(spark, d):
    return V.table(spark, d, "documents").select(
        "doc_id", T.normalize(F.col("text")).alias("normalized"),
        T.estimate_tokens(F.col("text")).alias("est_tokens"))


@query("T2", f"""
SELECT doc_id, len(toks) AS n_tokens, len(list_distinct(toks)) AS n_distinct,
  md5(array_to_string(toks, ' ')) AS digest
FROM (SELECT doc_id, {O.tokens('text')} AS toks FROM documents)""")
def text_tokens(spark, d):
    toks = V.table(spark, d, "documents").select(
        "doc_id", T.tokenize(F.col("text")).alias("toks"))
    return toks.select(
        "doc_id", F.size("toks").alias("n_tokens"),
        F.size(F.array_distinct("toks")).alias("n_distinct"),
        F.md5(F.array_join("toks", " ")).alias("digest"))


@query("T3", f"""
SELECT doc_id, array_to_string({O.keywords('text')}, ' ') AS keywords FROM documents""")
def text_keywords(spark, d):
    return V.table(spark, d, "documents").select(
        "doc_id", F.array_join(T.extract_keywords(F.col("text")), " ").alias("keywords"))


@query("T5 T6 T7", f"""
SELECT scope_id, seq, {O.subject('content')} AS subject, {O.kind_of('content')} AS kind,
  {O.replaces('content')}::INT AS replaces
FROM (SELECT scope_id, seq, content FROM obs_orders UNION ALL
      SELECT -1 - doc_id, 0, text FROM documents)""")
def subject_and_cues(spark, d):
    orders = V.order_observations(spark, d).select("scope_id", "seq", "content")
    documents = V.table(spark, d, "documents").select(
        (-1 - F.col("doc_id")).alias("scope_id"), F.lit(0).cast("long").alias("seq"),
        F.col("text").alias("content"))
    content = F.col("content")
    return orders.unionByName(documents).select(
        "scope_id", "seq", T.subject_key(content).alias("subject"),
        T.classify_observation(content).alias("kind"),
        T.text_signals_supersession(content).cast("int").alias("replaces"))


@query("T8", f"""
SELECT scope_id, seq, len(list_intersect(kw, toks))::DOUBLE / len(kw) AS score FROM (
  SELECT o.scope_id, o.seq, {O.keywords('p.question')} AS kw, {O.tokens('o.content')} AS toks
  FROM obs_conversations o JOIN plan_conv p ON p.scope_id = o.scope_id)
WHERE len(kw) > 0""")
def keyword_scores(spark, d):
    questions = V.conversation_questions(spark, d).select(
        "scope_id", T.extract_keywords(F.col("question")).alias("kw"))
    turns = V.conversation_observations(spark, d).select(
        "scope_id", "seq", F.array_distinct(T.tokenize(F.col("content"))).alias("toks"))
    return turns.join(questions, "scope_id").filter(F.size("kw") > 0).select(
        "scope_id", "seq", T.keyword_score(F.col("kw"), F.col("toks")).alias("score"))


@query("T9", """
SELECT a.label, a.vec_id, b.vec_id AS other_id,
  round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN (
  SELECT label, arg_min(embedding, vec_id) AS embedding, min(vec_id) AS vec_id
  FROM embeddings GROUP BY label) b ON a.label = b.label""")
def cosine_to_first_of_label(spark, d):
    vectors = V.table(spark, d, "embeddings")
    first = vectors.groupBy("label").agg(
        F.min_by("embedding", "vec_id").alias("first"), F.min("vec_id").alias("other_id"))
    return vectors.join(F.broadcast(first), "label").select(
        "label", "vec_id", "other_id",
        F.round(cosine_similarity(F.col("embedding"), F.col("first")), 6).alias("similarity"))


@query("T10", f"""
SELECT doc_id, idx, round(w, 9) AS weight FROM ({O.embed_sql('documents', 'doc_id', 'text')})""")
def hash_embeddings(spark, d):
    vectors = V.table(spark, d, "documents").select(
        "doc_id", hash_embedding(T.tokenize(F.col("text")), EMBED_DIM).alias("v"))
    return vectors.select("doc_id", F.posexplode("v").alias("idx", "w")).filter("w != 0").select(
        "doc_id", F.col("idx").cast("long").alias("idx"), F.round("w", 9).alias("weight"))


@query("T11 T12", """
SELECT query_id, mode, array_to_string(required, ',') AS required FROM plan_customers""")
def question_modes(spark, d):
    q = F.col("question")
    return V.customer_questions(spark, d).select(
        "query_id", T.query_mode(q).alias("mode"),
        F.array_join(T.detect_required_data(q), ",").alias("required"))


_LEADS = "|".join(C.SENTENCE_LEADS)
_CONCEPTS = rf"""
SELECT key, array_to_string((list_filter(names, lambda x, i: list_position(norms, norms[i]) = i))[1:6], ' | ') AS concepts
FROM (SELECT key, names, list_transform(names, lambda n: {O.norm('n')}) AS norms FROM (
  SELECT key, list_filter(list_transform(found || {O.keywords('body')},
    lambda n: regexp_replace(trim(regexp_replace(n, '^\s+|\s+$', '', 'g'), {O.quote(C.OWNER_EDGE_CHARS)}), '^\s+|\s+$', '', 'g')),
    lambda n: length(n) >= 2 AND {O.norm('n')} <> '') AS names
  FROM (SELECT key, body, list_transform(regexp_extract_all(body, {O.quote(C.CAPITALISED_PHRASE)}, 1),
    lambda p: regexp_replace(regexp_replace(p, '\s+', ' ', 'g'), '^(?i:(?:(?:{_LEADS})(?: |$))+)', '')) AS found
    FROM (SELECT 'o' || scope_id || '-' || seq AS key, content AS body FROM obs_shipments
          UNION ALL SELECT 'p' || p_partkey, p_name || ' The ' || p_brand || ', ' || p_type FROM part))))"""


@query("T13", _CONCEPTS)
def concept_names(spark, d):
    shipments = V.shipment_observations(spark, d).select(
        F.concat(F.lit("o"), F.col("scope_id"), F.lit("-"), F.col("seq")).alias("key"),
        F.col("content").alias("body"))
    parts = V.table(spark, d, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey")).alias("key"),
        F.concat("p_name", F.lit(" The "), "p_brand", F.lit(", "), "p_type").alias("body"))
    return shipments.unionByName(parts).select(
        "key",
        F.array_join(N.deterministic_concepts(F.col("body")), " | ").alias("concepts"))


@query("T15", rf"""
SELECT p_partkey, array_to_string((list_filter(names, lambda x, i: list_position(
  list_transform(names, lambda n: {O.norm('n')}), {O.norm('x')}) = i))[1:3], ' | ') AS concepts
FROM (SELECT p_partkey, list_filter([trim(n) for n in [' ' || p_name, upper(p_name), '', p_brand,
  '--', p_type, p_type || '!', p_name || ' ' || p_brand]], lambda n: {O.norm('n')} <> '') AS names
  FROM part)""")
def supplied_concept_names(spark, d):
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    supplied = F.array(
        F.concat(F.lit(" "), name), F.upper(name), F.lit(""), brand, F.lit("--"), kind,
        F.concat(kind, F.lit("!")), F.concat_ws(" ", name, brand), F.lit(None))
    return V.table(spark, d, "part").select(
        "p_partkey", F.array_join(N.cap_concepts(supplied, 3), " | ").alias("concepts"))


def _cover_words(x: str) -> str:
    return (f"list_distinct(list_filter(regexp_extract_all(lower({x}), '([a-z0-9]+)', 1), "
            f"lambda w: length(w) > 2 AND NOT list_contains({O.listed(C.COVERAGE_STOP_WORDS)}, w)))")


@query("T16", f"""
SELECT doc_id, CASE WHEN len(g) = 0 THEN 1.0 ELSE round(len(list_intersect(g, c))::DOUBLE / len(g), 9) END AS coverage
FROM (SELECT d.doc_id, {_cover_words('b.text')} AS g, {_cover_words('d.text')} AS c
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))""")
def answer_coverage(spark, d):
    benchmark = V.table(spark, d, "benchmark").select("item_id", F.col("text").alias("gold"))
    size = benchmark.agg(F.count("*").alias("n_items"))
    documents = V.table(spark, d, "documents").join(F.broadcast(size)).withColumn(
        "item_id", F.col("doc_id") % F.col("n_items"))
    return documents.join(benchmark, "item_id").select(
        "doc_id", F.round(T.gold_coverage(F.col("gold"), F.col("text")), 9).alias("coverage"))


_OUTPUT = """CASE doc_id % 4 WHEN 0 THEN 'ANSWER: no. Answer: ' || text
  WHEN 1 THEN text WHEN 2 THEN ' ' || text || ' answer:  ' ELSE '"Yes, ' || source || ' ANSWER: yes' END"""


@query("T18 T19", rf"""
SELECT doc_id, md5(CASE WHEN tail = '' THEN whole ELSE tail END) AS answer,
  starts_with(ltrim(lower(whole), '.,:;!"'' '), 'yes')::INT AS is_yes
FROM (SELECT doc_id, {O.strip('raw')} AS whole,
    {O.strip(r"regexp_extract(" + O.strip('raw') + r", '(?is)^.*ANSWER:(.*)$', 1)")} AS tail
  FROM (SELECT doc_id, {_OUTPUT} AS raw FROM documents))""")
def parse_outputs(spark, d):
    key = F.col("doc_id") % 4
    raw = (
        F.when(key == 0, F.concat(F.lit("ANSWER: no. Answer: "), "text"))
        .when(key == 1, F.col("text"))
        .when(key == 2, F.concat(F.lit(" "), "text", F.lit(" answer:  ")))
        .otherwise(F.concat(F.lit('"Yes, '), "source", F.lit(" ANSWER: yes"))))
    return V.table(spark, d, "documents").withColumn("raw", raw).select(
        "doc_id", F.md5(T.answer_after_marker(F.col("raw"))).alias("answer"),
        T.verdict_is_yes(F.col("raw")).cast("int").alias("is_yes"))


_TYPE = """CASE doc_id % 4 WHEN 0 THEN 'temporal-reasoning' WHEN 1 THEN 'knowledge-update'
  WHEN 2 THEN 'single-session-preference' ELSE 'multi-session' END"""


def _filled(template: str, note: str = "''") -> str:
    text = O.quote(template)
    for name, sql in (("question", "source"), ("answer", "lang"), ("hypothesis", "text"),
                      ("note", note)):
        text = f"replace({text}, '{{{name}}}', {sql})" if name != "hypothesis" else text
    return f"replace({text}, '{{hypothesis}}', text)"


_NOTE = "CASE qt " + " ".join(
    f"WHEN '{k}' THEN {O.quote(v)}" for k, v in T.JUDGE_NOTES.items()) + " ELSE '' END"


@query("T20 T21", f"""
SELECT doc_id, md5('Conversation history:' || chr(10) || text || chr(10) || chr(10)
    || 'Today''s date: ' || coalesce(CASE WHEN doc_id % 3 > 0 THEN '2023/05/0' || doc_id % 3 END, 'unknown')
    || chr(10) || 'Question: ' || source || chr(10) || 'Answer:') AS reader,
  md5('Conversation history:' || chr(10) || text || chr(10) || chr(10) || 'Today''s date: '
    || coalesce(CASE WHEN doc_id % 3 > 0 THEN '2023/05/0' || doc_id % 3 END, 'unknown') || chr(10)
    || 'Question: ' || source || chr(10) || chr(10) || 'Reason step by step using the steps above, '
    || 'then end with a single line ''ANSWER: <concise answer>''.') AS scaffolded,
  md5(CASE WHEN doc_id % 17 = 0 THEN {_filled(T.JUDGE_ABSTENTION)}
    WHEN qt = 'single-session-preference' THEN {_filled(T.JUDGE_PREFERENCE)}
    ELSE {_filled(T.JUDGE_DEFAULT, _NOTE)} END) AS judge
FROM (SELECT *, {_TYPE} AS qt FROM documents)""")
def request_texts(spark, d):
    key = F.col("doc_id") % 4
    kind = (
        F.when(key == 0, "temporal-reasoning").when(key == 1, "knowledge-update")
        .when(key == 2, "single-session-preference").otherwise("multi-session"))
    third = F.col("doc_id") % 3
    date = F.when(third > 0, F.concat(F.lit("2023/05/0"), third))
    return V.table(spark, d, "documents").select(
        "doc_id",
        F.md5(T.reader_request(F.col("text"), date, F.col("source"))).alias("reader"),
        F.md5(T.reader_request(F.col("text"), date, F.col("source"), scaffolded=True))
        .alias("scaffolded"),
        F.md5(T.judge_request(kind, F.col("doc_id") % 17 == 0, F.col("source"), F.col("lang"),
                              F.col("text"))).alias("judge"))


@query("T22 X6", """
SELECT conv_id, turn, sha256('m1' || chr(0) || CASE WHEN role = 'assistant' THEN 'v1-assistant'
  ELSE 'v1' END || chr(0) || regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS key
FROM conversations""")
def extraction_keys(spark, d):
    return V.table(spark, d, "conversations").select(
        "conv_id", "turn",
        extract.extraction_key(
            F.lit("m1"), extract.extraction_namespace(F.col("role"), True), F.col("text"))
        .alias("key"))


@query("T23 T24 T25 T26", r"""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id END AS number,
  strftime(ts, '%Y-%m-%d') AS day,
  CASE WHEN event_id % 3 = 1 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed,
  CASE WHEN length(flat) <= 24 THEN flat
    ELSE CASE WHEN head = '' THEN '[...]' ELSE head || ' [...]' END END AS short
FROM (SELECT *, CASE WHEN flat[19:19] = ' ' THEN flat[1:18]
    ELSE regexp_replace(flat[1:18], ' ?[^ ]*$', '') END AS head
  FROM (SELECT *, event_type || ' by user ' || user_id || ' worth ' || value::INT AS flat FROM events))""")
def ids_dates_and_shortening(spark, d):
    events = V.table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    named = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("event-"), "event_id")).otherwise(
        F.concat(F.lit("memory_claim#"), "event_id"))
    iso = F.concat(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), F.when(
        F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "?").otherwise(""))
    words = F.concat(
        "event_type", F.lit("  by user\n"), F.col("user_id").cast("string"), F.lit(" worth "),
        F.rint("value").cast("int").cast("string"))
    return events.select(
        "event_id", T.id_number(named).alias("number"), T.date_only(F.col("at")).alias("day"),
        F.date_format(T.parse_iso_timestamp(iso), "yyyy-MM-dd HH:mm:ss").alias("parsed"),
        T.shorten(words, 24).alias("short"))


# ------------------------------------------------------------ time and quantities

_REF_COLUMNS = """scope_id, src_id, pos, text, kind,
  strftime(resolved_at, '%Y-%m-%d %H:%M:%S') AS resolved_at, anchor_day, resolution_method,
  CASE resolution_method WHEN 'explicit_date' THEN 1.0 WHEN 'relative_to_observation' THEN 0.9
    WHEN 'duration_start' THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence"""


def _flat_refs(refs):
    return refs.select(
        "scope_id", "src_id", F.col("pos").cast("long").alias("pos"), "text", "kind",
        F.date_format("resolved_at", "yyyy-MM-dd HH:mm:ss").alias("resolved_at"),
        "anchor_day", "resolution_method", "confidence")


@query("D1 D2 D3 D4 D5 D6 D7 D8", f"SELECT {_REF_COLUMNS} FROM refs_shipments")
def temporal_refs_shipments(spark, d):
    observed = V.shipment_observations(spark, d)
    return _flat_refs(enrich.temporal_refs(observed, extraction=DEFAULTS))


@query("D8", f"SELECT {_REF_COLUMNS} FROM refs_orders")
def temporal_refs_orders(spark, d):
    observed = V.order_observations(spark, d)
    return _flat_refs(enrich.temporal_refs(observed, extraction=DEFAULTS))


@query("D9", """
SELECT scope_id, src_id, string_agg(label, '; ' ORDER BY pos) AS labels FROM (
  SELECT scope_id, src_id, pos, text || CASE resolution_method WHEN 'duration_start'
    THEN ' = since ' ELSE ' = ' END || strftime(resolved_at, '%Y-%m-%d') AS label
  FROM refs_shipments WHERE resolution_method <> 'unresolved'
    AND lower(text) <> strftime(resolved_at, '%Y-%m-%d'))
GROUP BY ALL""")
def resolved_date_labels(spark, d):
    observed = V.shipment_observations(spark, d)
    return enrich.resolved_date_labels(
        enrich.temporal_refs(observed, extraction=DEFAULTS))


_QTY_COLUMNS = """scope_id, src_id, pos, raw_value, value, unit, exactness, owner, property,
  can_sum_exactly::INT AS can_sum, CASE WHEN coalesce(owner, '') <> '' THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence"""


def _flat_quantities(rows):
    return rows.select(
        "scope_id", "src_id", F.col("pos").cast("long").alias("pos"), "raw_value", "value",
        "unit", "exactness", "owner", "property",
        F.col("can_sum_exactly").cast("int").alias("can_sum"), "confidence")


@query("N1 N2 N3 N4 N5 N6 N7", f"SELECT {_QTY_COLUMNS} FROM qty_shipments")
def quantities_shipments(spark, d):
    observed = V.shipment_observations(spark, d)
    return _flat_quantities(enrich.quantities(observed, extraction=DEFAULTS))


@query("N8", """
SELECT owner, property, unit, sum(CASE WHEN can_sum_exactly THEN value END) AS total,
  count(*) FILTER (can_sum_exactly) AS n_summed, count(*) FILTER (NOT can_sum_exactly) AS n_refused
FROM qty_shipments GROUP BY ALL""")
def safe_sums(spark, d):
    observed = V.shipment_observations(spark, d)
    return enrich.safe_sum(enrich.quantities(observed, extraction=DEFAULTS))


@query("D8 N7 S9", """
SELECT rel, src_type, count(*) AS n FROM (
  SELECT 'has_temporal_ref' AS rel, src_type FROM refs_shipments
  UNION ALL SELECT 'has_quantity', src_type FROM qty_shipments) GROUP BY ALL""")
def mention_edge_counts(spark, d):
    observed = V.shipment_observations(spark, d)
    edges = enrich.mention_edges(
        enrich.temporal_refs(observed, extraction=DEFAULTS), "has_temporal_ref"
    ).unionByName(enrich.mention_edges(
        enrich.quantities(observed, extraction=DEFAULTS), "has_quantity"))
    return edges.groupBy("rel", "src_type").agg(F.count("*").alias("n"))


@query("K2", """
SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[],
  v.embedding::DOUBLE[]), 9) AS score
FROM (SELECT arg_min(embedding, vec_id) AS embedding, min(vec_id) AS vec_id
      FROM embeddings GROUP BY label) q CROSS JOIN embeddings v
WHERE round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) > 0
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY
  round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC,
  'memory_claim#' || v.vec_id) <= 10""")
def nearest_vectors(spark, d):
    vectors = V.table(spark, d, "embeddings")
    scope = F.lit(0).cast("long").alias("scope_id")
    memories = vectors.select(
        scope, F.concat(F.lit("memory_claim#"), F.col("vec_id")).alias("mem_id"),
        F.lit(C.CLAIM).alias("mem_type"), F.lit(C.ACTIVE).alias("status"),
        F.lit("stored").alias("content"), "embedding")
    questions = vectors.groupBy("label").agg(
        F.min("vec_id").alias("query_id"), F.min_by("embedding", "vec_id").alias("embedding"),
    ).select("query_id", scope, "embedding", F.array(F.lit(C.CLAIM)).alias("types"),
             F.lit(True).alias("show_superseded"))
    return vector_search(memories, questions, 10).select(
        "query_id", T.id_number(F.col("mem_id")).alias("vec_id"), "score")
