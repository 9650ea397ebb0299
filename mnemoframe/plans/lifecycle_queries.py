"""Extraction, reconciliation, requests, policies and concepts."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemoframe import constants as C
from mnemoframe import schemas
from mnemoframe.operators import concepts as concept_ops
from mnemoframe.operators import enrich, extract, policy, reconcile, stats
from mnemoframe.operators.groups import stored
from mnemoframe.plans import oracle as O
from mnemoframe.plans import views as V
from mnemoframe.plans.catalog import query
from mnemoframe.settings import DEFAULTS


def _memories(spark, d):
    return extract.extract_memories(V.order_observations(spark, d))


def _kept_memories(spark, d):
    """Memories that several steps read: numbered and typed once."""
    return stored(_memories(spark, d))


# ------------------------------------------------------------ extraction


@query("S4 S5 S2", """
SELECT scope_id, seq, 'memory_observation#' || seq AS obs_id, role AS actor,
  session_id || '::' || turn_index AS source_id, strftime(occurred_at, '%Y-%m-%d') AS day,
  md5(content) AS digest FROM obs_conversations""")
def observations_conversations(spark, d):
    return V.conversation_observations(spark, d).select(
        "scope_id", "seq", "obs_id", "actor", "source_id",
        F.date_format("occurred_at", "yyyy-MM-dd").alias("day"),
        F.md5("content").alias("digest"))


@query("X1 X3 X4", """
SELECT scope_id, seq, mem_id, mem_type, content, confidence::DOUBLE AS confidence,
  strftime(occurred_at, '%Y-%m-%d') AS day,
  CASE WHEN mem_type = 'episodic_memory' THEN 'user' ELSE '' END AS actors,
  CASE WHEN mem_type = 'episodic_memory' THEN 'orders' END AS source FROM mem_orders""")
def extract_memories(spark, d):
    return _memories(spark, d).select(
        "scope_id", "seq", "mem_id", "mem_type", "content", "confidence",
        F.date_format("occurred_at", "yyyy-MM-dd").alias("day"),
        F.array_join("actors", ",").alias("actors"), "source")


@query("X3 X4", """
SELECT mem_type, count(*) AS n FROM mem_orders WHERE mem_type <> 'episodic_memory'
GROUP BY ALL""")
def extract_without_episodic(spark, d):
    settings = DEFAULTS.but(enable_episodic_memory=False)
    kept = extract.extract_memories(V.order_observations(spark, d), settings)
    return kept.groupBy("mem_type").agg(F.count("*").alias("n"))


@query("X5", """
SELECT scope_id, mem_id AS src_id, mem_type AS src_type, obs_id AS dst_id,
  'memory_observation' AS dst_type, 'derived_from' AS rel FROM mem_orders
UNION ALL SELECT scope_id, obs_id, 'memory_observation', mem_id, mem_type, 'supports' FROM mem_orders""")
def provenance_edges(spark, d):
    return extract.provenance_edges(_memories(spark, d)).drop("seq")


def _payload(doc):
    """A provider answer per document: several shapes, some of them malformed."""
    good = F.concat(
        F.lit('{"memories":[{"memory_type":" Episodic ","content":" seen '), doc,
        F.lit('","confidence":"1.7"},{"memory_type":"odd","content":"kept '), doc,
        F.lit('"},{"content":"  "},{"memory_type":"procedural","content":"low","confidence":0.3}]}'))
    key = F.col("doc_id") % 5
    return (
        F.when(key == 0, "not json").when(key == 1, '{"memories":"none"}')
        .when(key == 2, '{"memories":[]}').otherwise(good))


@query("X2", """
SELECT doc_id AS scope_id, mem_type, content, confidence FROM documents, (
  VALUES ('episodic_memory', 'seen ', 1.0::DOUBLE), ('memory_claim', 'kept ', 0.85::DOUBLE)
) v(mem_type, head, confidence), LATERAL (SELECT head || doc_id AS content)
WHERE doc_id % 5 > 2 AND regexp_replace(text, '\\s', '', 'g') <> ''""")
def extract_from_provider(spark, d):
    documents = V.table(spark, d, "documents")
    observed = documents.select(
        F.col("doc_id").alias("scope_id"), F.lit(1).cast("long").alias("seq"),
        F.lit("memory_observation#1").alias("obs_id"), F.lit("user").alias("actor"),
        F.col("text").alias("content"), "source",
        F.lit(None).cast("timestamp").alias("occurred_at"),
        _payload(F.col("doc_id").cast("string")).alias("payload"))
    return extract.extract_from_payload(observed, "payload").select(
        "scope_id", "mem_type", "content", "confidence")


def refuses_announcements(contents, _):
    """A stand-in extractor: one announced text in a call makes the whole call fail."""
    if any("announced" in c for c in contents):
        raise TimeoutError("no answer")
    return [json.dumps({"memories": [
        {"memory_type": "semantic", "content": c},
        {"memory_type": "episodic", "content": "note " + c, "confidence": 0.9},
        {"memory_type": "procedural", "content": "unsure " + c, "confidence": 0.1}]})
        for c in contents]


@query("U1 X2 X3 J10", """
SELECT scope_id, mem_type, mem_type || '#' || seq AS mem_id, seq, md5(content) AS digest FROM (
  SELECT scope_id, mem_type, confidence, row_number() OVER (PARTITION BY scope_id ORDER BY o.seq, pos) AS seq,
    head || content AS content
  FROM obs_orders o, (VALUES (0, 'memory_claim', '', 0.85), (1, 'episodic_memory', 'note ', 0.9),
    (2, 'procedural_memory', 'unsure ', 0.1)) v(pos, mem_type, head, confidence)
  WHERE NOT contains(content, 'announced')) WHERE confidence >= 0.65""")
def extract_with_failing_provider(spark, d):
    """Many observations per scope; rows the provider refuses give nothing."""
    observed = extract.provider_payload(
        V.order_observations(spark, d), refuses_announcements, batch_rows=16, attempts=2)
    return extract.extract_from_payload(observed, "payload").select(
        "scope_id", "mem_type", "mem_id", "seq", F.md5("content").alias("digest"))


def names_of(contents, types):
    """A stand-in concept extractor: names, repeats and blanks; claims only."""
    if "procedural_memory" in types:
        raise ValueError("rules have no names")
    return [["Account", " account. ", "", c.split("priority ")[1].split(" ")[0]] for c in contents]


@query("U4 T15 C1", """
SELECT scope_id, name, count(*) AS mention_count FROM (
  SELECT scope_id, unnest(['Account', split_part(split_part(content, 'priority ', 2), ' ', 1)]) AS name
  FROM mem_orders WHERE mem_type <> 'procedural_memory') GROUP BY ALL""")
def concepts_from_provider(spark, d):
    named = concept_ops.provided_concepts(_memories(spark, d), names_of, attempts=1)
    return concept_ops.build_concepts(named).select("scope_id", "name", "mention_count")


# ------------------------------------------------------------ reconciliation


@query("J1 J2 R1", """
SELECT scope_id, mem_type, older_id, newer_id, kind, round(overlap, 9) AS overlap,
  round(confidence, 9)::DOUBLE AS confidence, rel, new_status FROM changes""")
def reconcile_changes(spark, d):
    return reconcile.reconcile(_memories(spark, d)).select(
        "scope_id", "mem_type", "older_id", "newer_id", "kind",
        F.round("overlap", 9).alias("overlap"), F.round("confidence", 9).alias("confidence"),
        "rel", "new_status")


@query("R1", """
SELECT scope_id, newer_id AS src_id, older_id AS dst_id, rel, newer_seq AS seq
FROM changes WHERE kind = 'conflict'""")
def supersession_edges(spark, d):
    edges = reconcile.reconcile_edges(reconcile.reconcile(_memories(spark, d)))
    return edges.select("scope_id", "src_id", "dst_id", "rel", "seq")


@query("R2", """
SELECT scope_id, consolidation_id, src_id, consolidated_memory_id FROM (
  SELECT scope_id, 'memory_consolidation#' || newer_seq AS consolidation_id,
    unnest([older_id, newer_id]) AS src_id, newer_id AS consolidated_memory_id
  FROM changes WHERE kind = 'duplicate')""")
def consolidation_edges(spark, d):
    records = reconcile.consolidations(reconcile.reconcile(_memories(spark, d)))
    return reconcile.consolidation_edges(records).join(
        records.select("scope_id", F.col("consolidation_id").alias("dst_id"),
                       "consolidated_memory_id"), ["scope_id", "dst_id"],
    ).select("scope_id", F.col("dst_id").alias("consolidation_id"), "src_id",
             "consolidated_memory_id")


@query("R4", "SELECT scope_id, mem_id, status FROM mem_status")
def memory_status(spark, d):
    memories = _kept_memories(spark, d)
    return reconcile.with_status(memories, reconcile.reconcile(memories)).select(
        "scope_id", "mem_id", "status")


@query("R3 R4", "SELECT scope_id, mem_id, status FROM mem_status_requested")
def memory_status_with_requests(spark, d):
    memories = _kept_memories(spark, d)
    asked = V.requests(memories)
    changes = reconcile.reconcile(memories, requests=asked)
    return reconcile.with_status(memories, changes, asked).select("scope_id", "mem_id", "status")


O.define("edges_requested", """
SELECT scope_id, 'derived_from' AS rel, mem_id AS src_id, obs_id AS dst_id FROM mem_orders
UNION ALL SELECT scope_id, 'supports', obs_id, mem_id FROM mem_orders
UNION ALL SELECT scope_id, rel, newer_id, older_id FROM changes_requested WHERE kind = 'conflict'
UNION ALL SELECT scope_id, 'consolidated_into', unnest([older_id, newer_id]),
  'memory_consolidation#' || newer_seq FROM changes_requested WHERE kind = 'duplicate'
UNION ALL SELECT scope_id, 'about_entity', mem_id, 'memory_concept#' || md5(normalized) FROM concept_mentions""")


@query("R6", """
SELECT 'memory' AS what, scope_id, mem_id AS src_id, NULL AS dst_id FROM mem_status_requested WHERE status <> 'deleted'
UNION ALL SELECT DISTINCT e.rel, e.scope_id, e.src_id, e.dst_id FROM edges_requested e
WHERE NOT EXISTS (SELECT 1 FROM mem_status_requested m WHERE m.status = 'deleted' AND m.scope_id = e.scope_id
  AND m.mem_id IN (e.src_id, e.dst_id))""")
def compaction(spark, d):
    """Edges of five relations, cut where either end is deleted."""
    memories = _kept_memories(spark, d)
    asked = V.requests(memories)
    changes = V.materialize(reconcile.reconcile(memories, requests=asked))
    edges = (
        extract.provenance_edges(memories)
        .unionByName(reconcile.reconcile_edges(changes))
        .unionByName(reconcile.consolidation_edges(reconcile.consolidations(changes)))
        .unionByName(concept_ops.about_entity_edges(memories)))
    kept, kept_edges = reconcile.compact(reconcile.with_status(memories, changes, asked), edges)
    return kept_edges.select(F.col("rel").alias("what"), "scope_id", "src_id", "dst_id").distinct().unionByName(
        kept.select(F.lit("memory").alias("what"), "scope_id", F.col("mem_id").alias("src_id"),
                    F.lit(None).cast("string").alias("dst_id")))


@query("R5", """
SELECT m.scope_id, m.mem_id, m.status, 1 AS n_sources, 1 AS n_evidence,
  (c.rel IS NOT NULL AND c.rel = 'supersedes')::INT AS n_superseded_by,
  CASE WHEN c.rel = 'supersedes' THEN c.newer_id END AS superseded_by,
  (coalesce(x.n, 0) + (c.rel IS NOT NULL AND c.rel = 'contradicts')::INT)::BIGINT AS n_conflicts,
  m.obs_id AS source_obs
FROM mem_status m LEFT JOIN changes c ON c.scope_id = m.scope_id AND c.older_id = m.mem_id
LEFT JOIN (SELECT scope_id, newer_id, count(*) AS n FROM changes WHERE rel = 'contradicts'
  GROUP BY ALL) x ON x.scope_id = m.scope_id AND x.newer_id = m.mem_id""")
def lifecycle_audit(spark, d):
    memories = _kept_memories(spark, d)
    changes = V.materialize(reconcile.reconcile(memories))
    relations = extract.provenance_edges(memories).unionByName(
        reconcile.reconcile_edges(changes))
    audit = reconcile.lifecycle_audit(reconcile.with_status(memories, changes), relations)
    return audit.select(
        "scope_id", "mem_id", "status", "n_sources", "n_evidence", "n_superseded_by",
        "superseded_by", "n_conflicts", "source_obs")


@query("S8", """
SELECT broken AS constraint_name, count(*) AS n FROM (
  SELECT unnest(list_filter([
    CASE WHEN l_discount * 20 - 0.3 < 0 OR l_discount * 20 - 0.3 > 1 THEN 'confidence_range' END,
    CASE WHEN l_returnflag = 'R' THEN 'status_known' END,
    CASE WHEN l_linestatus = 'F' AND l_linenumber = 1 THEN 'content_required' END],
    lambda b: b IS NOT NULL)) AS broken FROM lineitem) GROUP BY ALL""")
def constraint_violations(spark, d):
    lines = V.table(spark, d, "lineitem")
    rows = lines.select(
        F.when(~((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1)), "text")
        .alias("content"),
        (F.col("l_discount") * 20 - 0.3).alias("confidence"),
        F.when(F.col("l_returnflag") == "R", "gone").otherwise("active").alias("status"),
        F.lit(C.CLAIM).alias("mem_type"))
    _, violations = schemas.check_rows(rows, "memories")
    return violations.groupBy(F.col("constraint").alias("constraint_name")).agg(
        F.count("*").alias("n"))


@query("S9", """
SELECT scope_id, seq, src_id, dst_id, rel FROM (
  SELECT scope_id, seq, mem_id AS src_id, obs_id AS dst_id, seq % 4 AS k,
    CASE seq % 4 WHEN 0 THEN 'derived_from' WHEN 1 THEN 'supports' WHEN 2 THEN 'about_entity'
    ELSE 'governed_by_policy' END AS rel FROM mem_orders) WHERE k <> 0""")
def endpoint_violations(spark, d):
    edges = extract.provenance_edges(_memories(spark, d)).filter("rel = 'derived_from'")
    key = F.col("seq") % 4
    wrong = edges.withColumn(
        "rel", F.when(key == 0, "derived_from").when(key == 1, "supports")
        .when(key == 2, "about_entity").otherwise("governed_by_policy"))
    return schemas.endpoint_violations(wrong).select("scope_id", "seq", "src_id", "dst_id", "rel")


# a row that keeps all rules, and one value that breaks each
_VALID = {
    "confidence": 0.5, "status": "active", "mem_type": C.CLAIM, "mode": "deep", "memory_types": ["semantic"],
    "exactness": "exact", "resolution_method": "unresolved", "outcome": "helpful",
    "extraction_confidence_threshold": 0.0, "contradiction_confidence_threshold": 1.0,
    "retrieval_limit": 1, "retrieval_mode_default": "standard", "action": "archive", "kind": "topic"}
_BREAKS = {
    "content_required": ("content", None), "confidence_range": ("confidence", 1.5),
    "status_known": ("status", "gone"), "type_known": ("mem_type", "odd"),
    "question_required": ("question", None), "mode_known": ("mode", "odd"),
    "types_known": ("memory_types", ["semantic", "odd"]), "query_required": ("query_id", None),
    "answer_required": ("answer", None), "raw_required": ("raw_value", None),
    "exactness_known": ("exactness", "odd"), "text_required": ("text", None),
    "method_known": ("resolution_method", "odd"), "sources_required": ("source_memory_ids", None),
    "reason_required": ("reason", None), "outcome_known": ("outcome", "odd"),
    "name_required": ("name", None), "extraction_range": ("extraction_confidence_threshold", -0.1),
    "contradiction_range": ("contradiction_confidence_threshold", 1.1),
    "limit_positive": ("retrieval_limit", 0), "target_required": ("mem_id", None),
    "action_known": ("action", "odd"), "kind_known": ("kind", "odd")}


def _rows_breaking_rules(orders, table):
    """Per order one row of a table: by key it keeps all rules or breaks one of them."""
    rules = list(schemas.CONSTRAINTS[table])
    breaks = {}
    for k, rule in enumerate(rules, 1):
        column, bad = _BREAKS[rule]
        if table == "policies" and rule == "mode_known":
            column = "retrieval_mode_default"
        breaks[column] = k, bad

    def value(x, kind):
        if isinstance(x, list):
            return F.array(*[F.lit(i) for i in x])
        return F.lit(x).cast(kind)

    turn = F.col("o_orderkey") % (len(rules) + 1)
    columns = []
    for field in getattr(schemas, table.upper()).fields:
        kind = field.dataType.simpleString()
        good = _VALID.get(field.name, [] if kind.startswith("array") else None if kind.startswith("map") else "1")
        out = F.array().cast(kind) if good == [] else value(good, kind)
        if field.name in breaks:
            k, bad = breaks[field.name]
            out = F.when(turn == k, value(bad, kind)).otherwise(out)
        columns.append(out.alias(field.name))
    return orders.select("o_orderkey", *columns)


@query("S8", f"""
SELECT name, CASE k WHEN 0 THEN 0 ELSE 1 << (k - 1)::INT END AS mask, count(*) AS n,
  sum(o_orderkey)::BIGINT AS keys
FROM (SELECT name, o_orderkey, o_orderkey % (n_rules + 1) AS k FROM orders, (VALUES
  {', '.join(f"('{t}', {len(r)})" for t, r in schemas.CONSTRAINTS.items())}) v(name, n_rules))
GROUP BY ALL""")
def constraint_masks(spark, d):
    """Every rule of every table, each broken by some rows."""
    orders = V.table(spark, d, "orders")
    out = None
    for name in schemas.CONSTRAINTS:
        rows = _rows_breaking_rules(orders, name).select(
            F.lit(name).alias("name"), "o_orderkey", schemas.rule_mask(name).alias("mask"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("name", "mask").agg(
        F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


_RELATIONS = list(C.RELATION_ENDPOINTS)


@query("S9", f"""
SELECT rel, CASE WHEN rel = 'odd' THEN 1 WHEN v = 1 AND rel <> 'governed_by_policy' THEN 2
  WHEN v = 2 THEN 4 WHEN v = 3 THEN CASE WHEN rel = 'governed_by_policy' THEN 4 ELSE 6 END
  ELSE 0 END AS mask, count(*) AS n, sum(o_orderkey)::BIGINT AS keys
FROM (SELECT o_orderkey, (o_orderkey // 15) % 4 AS v,
  {O.listed([*_RELATIONS, 'odd'])}[1 + o_orderkey % 15] AS rel FROM orders) GROUP BY ALL""")
def endpoint_masks(spark, d):
    """All relations, each with right ends, a wrong source, a wrong target, or both."""
    variant = F.floor(F.col("o_orderkey") / 15) % 4
    rel = F.element_at(F.array(*[F.lit(r) for r in [*_RELATIONS, "odd"]]),
                       (F.col("o_orderkey") % 15 + 1).cast("int"))
    ends = {"src_type": F.lit("odd"), "dst_type": F.lit("odd")}
    for name, (sources, targets) in C.RELATION_ENDPOINTS.items():
        for column, types, wrong in (("src_type", sources or ("any",), (1, 3)),
                                     ("dst_type", targets, (2, 3))):
            ends[column] = F.when(
                F.col("rel") == name, F.when(variant.isin(*wrong), "odd").otherwise(types[-1])
            ).otherwise(ends[column])
    edges = V.table(spark, d, "orders").withColumn("rel", rel).withColumns(ends)
    return edges.groupBy("rel", schemas.endpoint_mask().alias("mask")).agg(
        F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


# ------------------------------------------------------------ measures over the edges


@query("Q8", """
SELECT scope_id, count(*) AS n, avg(newer_seq - older_seq) AS mean_latency,
  max(newer_seq - older_seq) AS max_latency FROM changes WHERE rel = 'supersedes' GROUP BY ALL""")
def supersession_latency(spark, d):
    return stats.supersession_latency(reconcile.reconcile(_memories(spark, d)))


O.define("status_history", """
SELECT * FROM (SELECT scope_id, mem_id, regexp_extract(content, 'priority (\\S+)', 1) AS own,
    lag(mem_id) OVER w AS earlier, lag(regexp_extract(content, 'priority (\\S+)', 1)) OVER w AS before
  FROM mem_orders WINDOW w AS (PARTITION BY scope_id, mem_type ORDER BY seq)) WHERE own <> before""")


@query("Q9", """
SELECT rel, count(*) AS n, count(h.mem_id) AS n_right, count(h.mem_id) / count(*) AS precision,
  round(1 - count(h.mem_id) / count(*), 9) AS false_positive_rate
FROM changes c LEFT JOIN status_history h
  ON h.scope_id = c.scope_id AND h.mem_id = c.newer_id AND h.earlier = c.older_id
WHERE kind = 'conflict' GROUP BY ALL""")
def edge_precision(spark, d):
    """Gold comes from the memories alone: one that names another priority than the last of its
    type corrects that one."""
    memories = V.materialize(_memories(spark, d))
    history = Window.partitionBy("scope_id", "mem_type").orderBy("seq")
    own = F.regexp_extract("content", r"priority (\S+)", 1)
    gold = memories.select(
        "scope_id", F.col("mem_id").alias("src_id"), F.lag("mem_id").over(history).alias("dst_id"),
        own.alias("own"), F.lag(own).over(history).alias("before")).filter("own <> before")
    edges = reconcile.reconcile_edges(reconcile.reconcile(memories))
    return stats.edge_precision(edges, gold).withColumn(
        "false_positive_rate", F.round("false_positive_rate", 9))


O.define("shipment_gold", """
SELECT o.scope_id, 'memory_observation#' || o.seq AS src_id, unnest([
  struct_pack(what := 'date', wanted := strftime(CASE l.kind WHEN 'yesterday' THEN occurred_at - INTERVAL 1 DAY
    WHEN 'two weeks ago' THEN occurred_at - INTERVAL 14 DAY WHEN 'last month' THEN occurred_at - INTERVAL 1 MONTH
    WHEN 'for about three months' THEN occurred_at - INTERVAL 3 MONTH
    WHEN 'on May 26' THEN make_date(year(occurred_at), 5, 26) ELSE occurred_at END, '%Y-%m-%d')),
  struct_pack(what := 'growth', wanted := regexp_extract(content, '([0-9]+)% growth', 1)),
  struct_pack(what := 'customers', wanted := regexp_extract(content, '([0-9]+) customers', 1))], recursive := true)
FROM obs_shipments o, LATERAL (SELECT rtrim(split_part(o.content, ', renewed ', 2), '.') AS kind) l""")
O.define("shipment_found", """
SELECT scope_id, src_id, 'date' AS what, strftime(resolved_at, '%Y-%m-%d') AS wanted FROM refs_shipments
UNION SELECT scope_id, src_id, CASE unit WHEN '%' THEN 'growth' ELSE unit END, value::BIGINT::VARCHAR
FROM qty_shipments WHERE value = floor(value)""")


@query("Q10", """
SELECT g.what, count(*) AS n_gold, count(f.src_id) AS n_found, count(f.src_id) / count(*) AS rate
FROM shipment_gold g LEFT JOIN shipment_found f ON f.scope_id = g.scope_id AND f.src_id = g.src_id
  AND f.what = g.what AND f.wanted = g.wanted GROUP BY ALL""")
def extraction_rates(spark, d):
    """Gold is what the shipment texts were made from: the day meant, the growth, the customers.

    A date only counts with the right day, and "on May 26" lacks the year.
    """
    observed = V.stored(V.shipment_observations(spark, d))
    day, phrase = F.col("occurred_at").cast("date"), F.regexp_extract("content", r", renewed (.*)\.$", 1)
    meant = (
        F.when(phrase == "yesterday", F.date_sub(day, 1))
        .when(phrase == "two weeks ago", F.date_sub(day, 14))
        .when(phrase == "last month", F.add_months(day, -1))
        .when(phrase == "for about three months", F.add_months(day, -3))
        .when(phrase == "on May 26", F.make_date(F.year(day), F.lit(5), F.lit(26))).otherwise(day))

    def mention(what, wanted):
        return F.struct(F.lit(what).alias("what"), wanted.cast("string").alias("wanted"))

    gold = observed.select("scope_id", F.col("obs_id").alias("src_id"), F.inline(F.array(
        mention("date", meant), mention("growth", F.regexp_extract("content", "([0-9]+)% growth", 1)),
        mention("customers", F.regexp_extract("content", "([0-9]+) customers", 1)))))
    dates = enrich.temporal_refs(observed).select(
        "scope_id", "src_id", F.lit("date").alias("what"),
        F.date_format("resolved_at", "yyyy-MM-dd").alias("wanted"))
    # a filter on what is exploded does not move down, where it would find the values again
    whole = F.when(F.expr("value = floor(value)"), F.col("value").cast("long").cast("string"))
    amounts = enrich.quantities(observed).select(
        "scope_id", "src_id", F.when(F.col("unit") == "%", "growth").otherwise(F.col("unit")).alias("what"),
        F.explode_outer(F.array(whole)).alias("wanted")).filter("wanted is not null")
    keys = ["scope_id", "src_id", "what", "wanted"]
    return stats.extraction_rate(gold, dates.unionByName(amounts), keys, by=["what"])


@query("Q10", """
SELECT count(*) AS n_gold, count(f.src_id) AS n_found, count(f.src_id) / count(*) AS rate
FROM obs_shipments o LEFT JOIN (SELECT DISTINCT scope_id, src_id FROM refs_shipments) f
  ON f.scope_id = o.scope_id AND f.src_id = 'memory_observation#' || o.seq""")
def temporal_extraction_rate(spark, d):
    """Gold: every shipment text carries one time expression."""
    observed = V.shipment_observations(spark, d)
    gold = observed.select("scope_id", F.col("obs_id").alias("src_id"))
    found = enrich.temporal_refs(observed).select("scope_id", "src_id")
    return stats.extraction_rate(gold, found, ["scope_id", "src_id"])


# ------------------------------------------------------------ policies

_POLICIES = [("conservative", 0.85), ("aggressive", 0.4), ("strict", 0.95)]
_DOC_CONFIDENCE = "(length(content) % 10) / 10.0"


def _policies(spark):
    return spark.createDataFrame(
        _POLICIES, "name string, extraction_confidence_threshold double")


def _by_policy(spark, d):
    candidates = _memories(spark, d).withColumn(
        "confidence", (F.length("content") % 10) / F.lit(10.0))
    return policy.memories_per_policy(candidates, _policies(spark))


_POLICY_ROWS = f"""
SELECT p.name AS policy, m.* FROM mem_orders m, (VALUES
  {', '.join(f"('{n}', {t})" for n, t in _POLICIES)}) p(name, threshold)
WHERE {_DOC_CONFIDENCE} >= p.threshold"""


@query("G14", f"""
SELECT policy, count(*) FILTER (mem_type = 'memory_claim') AS n_memory_claim,
  count(*) FILTER (mem_type = 'episodic_memory') AS n_episodic_memory,
  count(*) FILTER (mem_type = 'procedural_memory') AS n_procedural_memory,
  count(*) AS total FROM ({_POLICY_ROWS}) GROUP BY ALL""")
def memories_by_policy(spark, d):
    return policy.count_by_policy(_by_policy(spark, d))


@query("J14", f"""
SELECT scope_id, obs_id, mem_type, CASE WHEN b.status IS NULL THEN 'added'
  WHEN a.status IS NULL THEN 'removed' WHEN a.status <> b.status THEN 'changed' END AS change,
  b.status AS status_before, a.status AS status_after
FROM (SELECT scope_id, obs_id, mem_type, status FROM mem_status WHERE {_DOC_CONFIDENCE} >= 0.4) b
FULL JOIN (SELECT scope_id, obs_id, mem_type, status FROM mem_status_requested
  WHERE seq % 3 > 0) a USING (scope_id, obs_id, mem_type)
WHERE b.status IS DISTINCT FROM a.status""")
def policy_differences(spark, d):
    memories = _kept_memories(spark, d)
    asked = V.requests(memories)
    changes = V.materialize(reconcile.reconcile(memories))
    requested = V.materialize(reconcile.reconcile(memories, requests=asked, unasked=changes))
    confidence = (F.length("content") % 10) / F.lit(10.0)
    before = reconcile.with_status(memories, changes).filter(confidence >= 0.4)
    after = reconcile.with_status(memories, requested, asked).filter("seq % 3 > 0")
    return policy.policy_diff(before, after)


@query("Q11", f"""
SELECT max(total) FILTER (policy = 'aggressive') - max(total) FILTER (policy = 'conservative')
    AS extra_memories,
  round(max(acc) FILTER (policy = 'aggressive') - max(acc) FILTER (policy = 'conservative'), 9)
    AS accuracy_delta
FROM (SELECT policy, count(*) AS total, avg((seq % 2)::DOUBLE) AS acc
  FROM ({_POLICY_ROWS}) GROUP BY ALL)""")
def policy_yield(spark, d):
    kept = _by_policy(spark, d)
    accuracy = kept.groupBy("policy").agg(F.avg((F.col("seq") % 2).cast("double"))
                                          .alias("accuracy"))
    return policy.policy_yield(
        policy.count_by_policy(kept), accuracy, "conservative", "aggressive"
    ).withColumn("accuracy_delta", F.round("accuracy_delta", 9))


# ------------------------------------------------------------ concepts

@query("C1 C5", """
SELECT scope_id, normalized, 'memory_concept#' || md5(normalized) AS concept_id,
  arg_min(name, seq * 100 + pos) AS name,
  arg_min(CASE WHEN mem_type = 'procedural_memory' THEN 'topic' ELSE 'entity' END,
    seq * 100 + pos) AS kind,
  count(*) AS mention_count, count(DISTINCT name) - 1 AS n_aliases
FROM concept_mentions GROUP BY ALL""")
def concepts(spark, d):
    return concept_ops.build_concepts(_memories(spark, d)).select(
        "scope_id", "normalized", "concept_id", "name", "kind", "mention_count",
        F.size("aliases").alias("n_aliases"))


@query("C2", """
SELECT scope_id, mem_id AS src_id, 'memory_concept#' || md5(normalized) AS dst_id
FROM concept_mentions""")
def about_entity_edges(spark, d):
    return concept_ops.about_entity_edges(_memories(spark, d)).select(
        "scope_id", "src_id", "dst_id")


O.define("concept_nvec", O.embed_sql(
    "(SELECT DISTINCT scope_id, normalized, 'memory_concept#' || md5(normalized) AS concept_id "
    "FROM concept_mentions)", "scope_id, concept_id", "normalized"))
O.define("concept_pairs", """
SELECT x.scope_id, x.concept_id AS a, y.concept_id AS b
FROM concept_nvec x JOIN concept_nvec y
  ON x.scope_id = y.scope_id AND x.idx = y.idx AND x.concept_id <> y.concept_id
GROUP BY ALL HAVING round(sum(x.w * y.w), 9) >= 0.92""")


@query("C6", """
SELECT scope_id, concept_id, min(root) AS root FROM (
  WITH RECURSIVE reached(scope_id, concept_id, root) AS (
    SELECT scope_id, a, a FROM concept_pairs
    UNION SELECT r.scope_id, p.b, r.root FROM reached r
    JOIN concept_pairs p ON p.scope_id = r.scope_id AND p.a = r.concept_id)
  SELECT * FROM reached) GROUP BY ALL""")
def concept_alias_groups(spark, d):
    found = concept_ops.build_concepts(_memories(spark, d))
    return concept_ops.merge_groups(concept_ops.similar_concepts(found))
