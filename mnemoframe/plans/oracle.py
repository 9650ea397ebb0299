"""Plain SQL for checking results: named common table expressions and helpers.

``with_tables(query)`` puts the expressions a query mentions, and those they mention
in turn, in front of it.
"""

from __future__ import annotations

import re

from mnemoframe import constants as C

_TABLES: dict[str, str] = {}


def define(name: str, sql: str) -> None:
    _TABLES[name] = sql


def with_tables(query: str) -> str:
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in set(re.findall(r"\b[a-z_0-9]+\b", sql)) & set(_TABLES):
            if name not in needed:
                needed.add(name)
                visit(_TABLES[name])

    visit(query)
    # definition order, so that a table only refers to earlier ones
    parts = [f"{name} AS (\n{sql.strip()}\n)" for name, sql in _TABLES.items() if name in needed]
    return f"WITH {', '.join(parts)}\n{query.strip()}" if parts else query.strip()


# ------------------------------------------------------------ helpers


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(quote(w) for w in words) + "]"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda t: t <> '')"


def distinct(items: str) -> str:
    """First occurrences in order."""
    # the one-element list binds the items, so that they are computed once
    return (f"list_transform([{items}], lambda k: "
            "list_filter(k, lambda x, i: list_position(k, x) = i))[1]")


def keywords(x: str) -> str:
    kept = f"list_filter({tokens(x)}, lambda t: length(t) >= 2 AND NOT list_contains({listed(C.STOP_WORDS)}, t))"
    return f"({distinct(kept)})[1:20]"


def subject(x: str) -> str:
    kept = f"list_filter({tokens(x)}, lambda t: NOT list_contains({listed(C.SUBJECT_MARKERS)}, t))"
    return f"array_to_string(({kept})[1:2], ' ')"


def contains_any(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {quote(n)})" for n in needles) + ")"


def padded(x: str) -> str:
    return f"(' ' || lower(coalesce({x}, '')) || ' ')"


def kind_of(x: str) -> str:
    return (
        f"CASE WHEN {contains_any(padded(x), C.PROCEDURAL_CUES)} THEN 'procedural' "
        f"WHEN {contains_any(padded(x), C.EPISODIC_CUES)} THEN 'episodic' ELSE 'semantic' END")


def replaces(x: str) -> str:
    return contains_any(padded(x), C.SUPERSESSION_CUES)


def mode_of(x: str) -> str:
    low = f"lower({x})"
    return (f"CASE WHEN {contains_any(low, C.DEEP_HINTS)} OR regexp_matches({low}, '[0-9]') "
            f"THEN 'deep' ELSE 'standard' END")


def required_of(x: str) -> str:
    low = f"lower({x})"
    return (
        f"list_filter([CASE WHEN regexp_matches({low}, {quote(C.NUMERIC_QUESTION)}) THEN 'numeric_value' END, "
        f"CASE WHEN regexp_matches({low}, {quote(C.TEMPORAL_QUESTION)}) THEN 'temporal_value' END, "
        f"CASE WHEN list_contains(regexp_split_to_array({low}, '\\s+'), 'why') THEN 'reason' END], "
        f"lambda r: r IS NOT NULL)")


_TYPE_OF = {"procedural": C.PROCEDURAL, "episodic": C.EPISODIC, "semantic": C.CLAIM}


def type_name(kind: str) -> str:
    return "CASE " + kind + "".join(
        f" WHEN {quote(k)} THEN {quote(v)}" for k, v in _TYPE_OF.items()) + " END"


# ------------------------------------------------------------ observations

define("obs_orders", f"""
SELECT o_custkey AS scope_id,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq,
  'Customer ' || o_custkey || CASE WHEN o_orderstatus = 'F' THEN ' now' ELSE '' END
  || CASE WHEN o_orderpriority = '1-URGENT' THEN ' should have priority ' ELSE ' has priority ' END
  || o_orderpriority || ' on account'
  || CASE WHEN o_orderstatus = 'P' THEN ' as announced yesterday' ELSE '' END AS content,
  o_orderdate AS occurred_at
FROM orders""")

define("obs_shipments", """
SELECT l_orderkey AS scope_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey,
    l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
    l_linestatus, l_shipdate) AS seq,
  'Supplier ' || l_suppkey || ' revenue is $' || l_quantity::INT || 'k or $' || l_quantity::INT
  || '-' || (l_quantity::INT + 5) || 'M with ' || round(l_discount * 100)::INT || '% growth and '
  || l_linenumber || ' customers, renewed '
  || CASE l_partkey % 6 WHEN 0 THEN 'yesterday' WHEN 1 THEN 'two weeks ago'
     WHEN 2 THEN 'last month' WHEN 3 THEN 'for about three months'
     WHEN 4 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE 'on May 26' END || '.' AS content,
  l_shipdate AS occurred_at
FROM lineitem""")


def _memories(obs: str) -> str:
    return f"""
SELECT scope_id, seq, {type_name('kind')} AS mem_type,
  {type_name('kind')} || '#' || seq AS mem_id, content, 0.85 AS confidence,
  'memory_observation#' || seq AS obs_id,
  CASE WHEN kind = 'episodic' THEN occurred_at END AS occurred_at
FROM (SELECT *, {kind_of('content')} AS kind FROM {obs})"""


define("mem_orders", _memories("obs_orders"))
define("mem_shipments", _memories("obs_shipments"))

# ------------------------------------------------------------ reconciliation

define("mem_keys", f"""
SELECT scope_id, mem_type, seq, mem_id, {norm('content')} AS sig, {subject('content')} AS subject,
  list_distinct({tokens('content')}) AS toks, {replaces('content')} AS repl
FROM mem_orders""")

define("successor_pairs", """
SELECT o.scope_id, o.mem_type, o.seq AS older_seq, o.mem_id AS older_id, n.seq AS newer_seq,
  n.mem_id AS newer_id, n.repl,
  CASE WHEN o.sig = n.sig THEN 'duplicate' ELSE 'conflict' END AS kind,
  CASE WHEN o.sig = n.sig THEN 1.0 ELSE
    len(list_intersect(o.toks, n.toks))::DOUBLE / greatest(1, least(len(o.toks), len(n.toks)))
  END AS overlap
FROM mem_keys o JOIN mem_keys n ON o.scope_id = n.scope_id AND o.mem_type = n.mem_type
  AND n.seq > o.seq AND (o.sig = n.sig OR (o.subject = n.subject AND o.subject <> ''))""")

_RELATION = """CASE WHEN kind = 'duplicate' THEN 'consolidated_into'
  WHEN confidence >= 0.75 AND repl THEN 'supersedes' ELSE 'contradicts' END"""
_CONFIDENCE = "CASE WHEN kind = 'duplicate' THEN 0.9 ELSE least(1.0, 0.7 + overlap / 5) END"
_STATUS = """CASE rel WHEN 'consolidated_into' THEN 'archived' WHEN 'supersedes'
  THEN 'superseded' ELSE 'needs_review' END"""


def _changes(condition: str) -> str:
    return f"""
SELECT *, {_STATUS} AS new_status FROM (
  SELECT *, {_RELATION} AS rel FROM (
    SELECT *, {_CONFIDENCE} AS confidence FROM (
      SELECT *, row_number() OVER (PARTITION BY scope_id, older_seq ORDER BY newer_seq) AS rn
      FROM successor_pairs WHERE overlap >= 0.4)
    WHERE rn = 1) ) {condition}"""


define("changes", _changes(""))
define("mem_status", """
SELECT m.*, coalesce(c.new_status, 'active') AS status
FROM mem_orders m LEFT JOIN changes c ON c.scope_id = m.scope_id AND c.older_seq = m.seq""")
define("requested", """
SELECT scope_id, mem_id, CASE WHEN scope_id % 2 = 0 THEN 'deleted' ELSE 'archived' END AS asked,
  seq + 1.5 AS request_seq FROM mem_orders WHERE (seq + scope_id) % 10 = 0""")
define("changes_requested", """
SELECT c.* FROM changes c LEFT JOIN requested r
  ON r.scope_id = c.scope_id AND r.mem_id = c.older_id
WHERE r.request_seq IS NULL OR c.newer_seq < r.request_seq""")
define("mem_status_requested", """
SELECT m.*, coalesce(r.asked, c.new_status, 'active') AS status FROM mem_orders m
LEFT JOIN changes_requested c ON c.scope_id = m.scope_id AND c.older_seq = m.seq
LEFT JOIN requested r ON r.scope_id = m.scope_id AND r.mem_id = m.mem_id""")

# ------------------------------------------------------------ time references


def temporal_sql(sources: str) -> str:
    """Mentions of (scope_id, seq, src_id, src_type, anchor, content) rows, resolved."""
    def part(pattern: str, kind: str) -> str:
        return (f"list_transform(regexp_extract_all(content, {quote(pattern)}, 0), "
                f"lambda m: struct_pack(text := m, kind := '{kind}'))")

    phrases = (f"list_transform(list_filter({listed(C.FIXED_PHRASE_DAYS)}, "
               "lambda p: contains(lower(content), p)), "
               "lambda p: struct_pack(text := p, kind := 'relative'))")
    found = " || ".join([
        part(C.ISO_DATE, "iso"), part(C.UNITS_AGO, "relative"), part(C.LAST_NEXT, "relative"),
        part(C.DURATION, "duration"), phrases, part(C.MONTH_DAY, "month_day")])
    fixed = "CASE low " + " ".join(
        f"WHEN {quote(p)} THEN {d}" for p, d in C.FIXED_PHRASE_DAYS.items()) + " END"
    number = ("coalesce(CASE word " + " ".join(
        f"WHEN {quote(w)} THEN {n}" for w, n in C.NUMBER_WORDS.items())
        + " END, try_cast(word AS INT))")
    return f"""
SELECT scope_id, seq, src_id, src_type, pos, text, kind,
  coalesce(explicit, shifted) AS resolved_at,
  CASE WHEN explicit IS NULL THEN strftime(anchor, '%Y-%m-%d') END AS anchor_day,
  CASE WHEN explicit IS NOT NULL THEN 'explicit_date'
    WHEN shifted IS NOT NULL AND kind = 'relative' THEN 'relative_to_observation'
    WHEN shifted IS NOT NULL THEN 'duration_start' ELSE 'unresolved' END AS resolution_method
FROM (SELECT *,
  CASE WHEN kind = 'iso' THEN try_cast(text AS TIMESTAMP) END AS explicit,
  CASE WHEN kind = 'relative' AND fixed IS NOT NULL THEN anchor + to_days(fixed)
    WHEN kind IN ('relative', 'duration') AND unit = 'day' THEN anchor - to_days(n)
    WHEN kind IN ('relative', 'duration') AND unit = 'week' THEN anchor - to_days(7 * n)
    WHEN kind IN ('relative', 'duration') AND unit = 'month' THEN anchor - to_months(n)
    WHEN kind IN ('relative', 'duration') AND unit = 'year' THEN anchor - to_months(12 * n)
    WHEN kind = 'relative' AND turn <> '' THEN anchor + to_months(
      CASE turn WHEN 'last' THEN -1 ELSE 1 END * CASE turn_unit WHEN 'month' THEN 1 ELSE 12 END)
  END AS shifted
 FROM (SELECT *, {fixed} AS fixed, {number} AS n FROM (
  SELECT *, lower(text) AS low,
   CASE WHEN kind = 'duration' THEN regexp_extract(lower(text), {quote(C.DURATION)}, 1)
     ELSE regexp_extract(lower(text), {quote(C.UNITS_AGO)}, 1) END AS word,
   CASE WHEN kind = 'duration' THEN regexp_extract(lower(text), {quote(C.DURATION)}, 2)
     ELSE regexp_extract(lower(text), {quote(C.UNITS_AGO)}, 2) END AS unit,
   regexp_extract(lower(text), {quote(C.LAST_NEXT)}, 1) AS turn,
   regexp_extract(lower(text), {quote(C.LAST_NEXT)}, 2) AS turn_unit
  FROM (SELECT scope_id, seq, src_id, src_type, anchor, pos - 1 AS pos,
      found[pos].text AS text, found[pos].kind AS kind
    FROM (SELECT *, generate_subscripts(found, 1) AS pos FROM (
      SELECT *, list_filter(raw, lambda x, i: list_position(
        list_transform(raw, lambda y: lower(y.text) || '|' || y.kind),
        lower(x.text) || '|' || x.kind) = i) AS found
      FROM (SELECT *, {found} AS raw FROM {sources})))))))"""


def _enriched_sources(obs: str, mem: str) -> str:
    return f"""
SELECT scope_id, seq, 'memory_observation#' || seq AS src_id, 'memory_observation' AS src_type,
  content, occurred_at AS anchor FROM {obs}
UNION ALL
SELECT scope_id, seq, mem_id, mem_type, content, occurred_at FROM {mem}
WHERE mem_type <> 'procedural_memory'"""


define("src_shipments", _enriched_sources("obs_shipments", "mem_shipments"))
define("src_orders", _enriched_sources("obs_orders", "mem_orders"))
define("refs_shipments", temporal_sql("src_shipments"))
define("refs_orders", temporal_sql("src_orders"))

# ------------------------------------------------------------ quantities


def quantity_sql(sources: str) -> str:
    scale = "CASE lower(coalesce({0}, '')) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 WHEN 't' THEN 1e12 ELSE 1.0 END"
    patterns = {"range": C.MONEY_RANGE, "money": C.MONEY, "percent": C.PERCENT,
                "counted": C.COUNTED_UNIT}
    legs = []
    for i, (kind, pattern) in enumerate(patterns.items()):
        p = quote(pattern)
        legs.append(f"""
SELECT scope_id, seq, src_id, src_type, content, {i} AS leg, k, raw[k] AS raw,
  (list_sum(list_transform(gaps[1:k], lambda g: length(g)))
   + coalesce(list_sum(list_transform(raw[1:k-1], lambda g: length(g))), 0))::INT AS start,
  '{kind}' AS kind
FROM (SELECT *, generate_subscripts(raw, 1) AS k FROM (
  SELECT *, regexp_extract_all(content, {p}, 0) AS raw, string_split_regex(content, {p}) AS gaps
  FROM {sources}))""")
    edge = quote(C.OWNER_EDGE_CHARS)
    prop = "CASE " + " ".join(
        f"WHEN contains(nearby, '{w}') THEN '{w}'" for w in C.PROPERTY_WORDS) + " END"
    return f"""
SELECT scope_id, seq, src_id, src_type,
  row_number() OVER (PARTITION BY scope_id, src_id ORDER BY leg, k) - 1 AS pos,
  raw AS raw_value,
  CASE kind WHEN 'range' THEN (number + upper_number) / 2 * {scale.format('letter')}
    WHEN 'money' THEN number * {scale.format('letter')} ELSE number END AS value,
  CASE WHEN kind IN ('range', 'money') THEN 'USD' WHEN kind = 'percent' THEN '%' ELSE counted END AS unit,
  CASE kind WHEN 'range' THEN 'range' ELSE 'exact' END AS exactness,
  owner,
  CASE WHEN kind = 'counted' THEN counted ELSE {prop} END AS property,
  kind IN ('money', 'counted') AS can_sum_exactly
FROM (SELECT *, CASE WHEN found_at > 0 THEN words[found_at]
    || CASE WHEN regexp_matches(coalesce(words[found_at + 1], ''), '^(\\p{{Lu}}|\\p{{Nd}}+$)')
       THEN ' ' || words[found_at + 1]
         || CASE WHEN regexp_matches(coalesce(words[found_at + 2], ''), '^(\\p{{Lu}}|\\p{{Nd}}+$)')
            THEN ' ' || words[found_at + 2] ELSE '' END
       ELSE '' END END AS owner
 FROM (SELECT *, coalesce(list_position(list_transform(words,
     lambda w: regexp_matches(w, '^\\p{{Lu}}.*[\\p{{Ll}}\\p{{Lt}}]')), true), 0) AS found_at
  FROM (SELECT *, list_transform(regexp_split_to_array(sentence, '\\s+'), lambda w: trim(w, {edge})) AS words
   FROM (SELECT *,
     regexp_replace(regexp_extract(substr(content, 1, start), '[^.\\n]*$', 0) || raw
       || CASE WHEN contains(after, '.') THEN regexp_extract(after, '^[^.]*', 0)
          WHEN contains(after, chr(10)) THEN regexp_extract(after, '^[^\\n]*', 0) ELSE '' END,
       '^\\s+|\\s+$', '', 'g') AS sentence,
     lower(substr(content, greatest(start - 40, 0) + 1, least(start, 40))) AS nearby,
     regexp_extract(raw, '(\\d+(?:\\.\\d+)?)', 1)::DOUBLE AS number,
     try_cast(regexp_extract(raw, {quote(C.MONEY_RANGE)}, 2) AS DOUBLE) AS upper_number,
     CASE kind WHEN 'range' THEN regexp_extract(raw, {quote(C.MONEY_RANGE)}, 3)
       WHEN 'money' THEN regexp_extract(raw, {quote(C.MONEY)}, 2) END AS letter,
     lower(regexp_extract(raw, {quote(C.COUNTED_UNIT)}, 2)) AS counted
    FROM (SELECT *, substr(content, start + length(raw) + 1) AS after FROM (
      SELECT a.* FROM ({' UNION ALL '.join(legs)}) a
      WHERE NOT (a.kind = 'money' AND EXISTS (
        SELECT 1 FROM ({legs[0]}) r WHERE r.scope_id = a.scope_id AND r.src_id = a.src_id
        AND r.start = a.start))))))))"""


define("qty_shipments", quantity_sql("src_shipments"))
define("qty_orders", quantity_sql("src_orders"))

# ------------------------------------------------------------ embeddings


def embed_sql(source: str, key: str, text: str) -> str:
    """Sparse unit vectors (key, idx, w)."""
    return f"""
SELECT {key}, idx, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM (
  SELECT {key}, h % 64 AS idx, sum(CASE WHEN (h >> 8) & 1 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS w
  FROM (SELECT {key}, ('0x' || substr(md5(tok), 1, 8))::BIGINT AS h
    FROM (SELECT {key}, unnest({tokens(text)}) AS tok FROM {source}))
  GROUP BY ALL) WHERE w <> 0"""


# ------------------------------------------------------------ retrieval


def retrieval_sql(prefix: str, memories: str, plans: str) -> None:
    """Define the keyword and vector legs and their blend.

    memories: scope_id, mem_id, mem_type, status, content; plans: query_id, scope_id,
    question, show_superseded.
    """
    visible = "m.status NOT IN ('archived', 'deleted') AND (m.status <> 'superseded' OR p.show_superseded)"
    define(f"{prefix}_toks", f"""
SELECT DISTINCT scope_id, mem_id, mem_type, status, unnest({tokens('content')}) AS tok
FROM {memories}""")
    define(f"{prefix}_kws", f"""
SELECT query_id, scope_id, show_superseded, len(kw) AS n_kw, unnest(kw) AS tok
FROM (SELECT *, {keywords('question')} AS kw FROM {plans})""")
    define(f"{prefix}_kw", f"""
SELECT p.query_id, p.scope_id, m.mem_id, count(*)::DOUBLE / any_value(n_kw) AS score
FROM {prefix}_kws p JOIN {prefix}_toks m ON m.scope_id = p.scope_id AND m.tok = p.tok
WHERE {visible} GROUP BY ALL""")
    define(f"{prefix}_mvec", embed_sql(memories, "scope_id, mem_id", "content"))
    define(f"{prefix}_qvec", embed_sql(plans, "query_id, scope_id", "question"))
    define(f"{prefix}_vec", f"""
SELECT * FROM (
  SELECT p.query_id, p.scope_id, m.mem_id, round(sum(a.w * b.w), 9) AS score
  FROM {plans} p JOIN {memories} m ON m.scope_id = p.scope_id
  JOIN {prefix}_qvec a ON a.query_id = p.query_id
  JOIN {prefix}_mvec b ON b.scope_id = m.scope_id AND b.mem_id = m.mem_id AND b.idx = a.idx
  WHERE {visible} GROUP BY ALL) WHERE score > 0""")
    for leg in ("kw", "vec"):
        define(f"{prefix}_{leg}40", f"""
SELECT * FROM {prefix}_{leg}
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) <= 40""")
    define(f"{prefix}_flat", f"""
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) AS rank FROM (
  SELECT query_id, scope_id, mem_id, max(score) AS score FROM (
    SELECT * FROM {prefix}_kw40
    UNION ALL SELECT query_id, scope_id, mem_id, 0.6 * score FROM {prefix}_vec40)
  GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) <= 40""")


define("plan_customers", f"""
SELECT *, mode = 'deep' AS show_superseded FROM (
  SELECT *, {mode_of('question')} AS mode, {required_of('question')} AS required FROM (
    SELECT DISTINCT 'q' || o_custkey AS query_id, o_custkey AS scope_id,
      CASE o_custkey % 4
        WHEN 0 THEN 'What is the target number of customer ' || o_custkey || ' on account'
        WHEN 1 THEN 'When was priority announced for customer ' || o_custkey
        WHEN 2 THEN 'Why has this Customer ' || o_custkey || ' low priority'
        ELSE 'Which priority should customer have on account' END AS question
    FROM orders))""")
retrieval_sql("cust", "mem_status", "plan_customers")

define("mem_documents", """
SELECT 0 AS scope_id, doc_id AS seq, 'memory_claim#' || doc_id AS mem_id,
  'memory_claim' AS mem_type, 'active' AS status, text AS content FROM documents""")
define("plan_benchmark", """
SELECT 'b' || item_id AS query_id, 0 AS scope_id, text AS question, true AS show_superseded
FROM benchmark""")
retrieval_sql("docs", "mem_documents", "plan_benchmark")
define("gold_docs", """
SELECT 'b' || item_id AS query_id, 'memory_claim#' || doc_id AS mem_id
FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")

# ------------------------------------------------------------ conversations

define("conv_turns", """
SELECT conv_id AS scope_id, (turn // 4)::INT AS session_pos,
  's-' || conv_id || '-' || (turn // 4) AS session_id,
  CASE WHEN NOT (conv_id % 7 = 0 AND turn // 4 = 1) THEN strftime(
    DATE '2023-01-01' + (conv_id % 300)::INT - (turn // 4)::INT, '%Y/%m/%d') END AS session_date,
  turn AS turn_index, role, text AS content, turn = 1 AS has_answer
FROM conversations""")
define("conv_dated", """
SELECT t.*, try_strptime(session_date, '%Y/%m/%d') AS session_at,
  bool_and(session_date IS NOT NULL) OVER (PARTITION BY scope_id) AS all_dated
FROM conv_turns t""")
define("obs_conversations", """
SELECT scope_id, row_number() OVER (PARTITION BY scope_id ORDER BY
    CASE WHEN all_dated THEN session_at END, session_pos, turn_index) AS seq,
  content, session_at AS occurred_at, session_id, turn_index, role, session_date, has_answer
FROM conv_dated WHERE content <> ''""")
define("mem_conv", f"""
SELECT scope_id, seq, {type_name(kind_of('content'))} AS mem_type,
  {type_name(kind_of('content'))} || '#' || seq AS mem_id, 'active' AS status, {strip('content')} AS content,
  'memory_observation#' || seq AS obs_id, occurred_at
FROM obs_conversations""")
define("plan_conv", f"""
SELECT *, mode = 'deep' AS show_superseded FROM (
  SELECT *, {mode_of('question')} AS mode, {required_of('question')} AS required FROM (
    SELECT conv_id::VARCHAR AS query_id, conv_id AS scope_id, {strip('arg_min(text, turn)')} AS question
    FROM conversations WHERE role = 'user' GROUP BY conv_id) WHERE question <> '')""")
retrieval_sql("conv", "mem_conv", "plan_conv")

# ------------------------------------------------------------ concepts

define("concept_mentions", rf"""
SELECT scope_id, seq, mem_id, mem_type, pos, name, {norm('name')} AS normalized FROM (
  SELECT scope_id, seq, mem_id, mem_type, names[pos] AS name, pos FROM (
    SELECT *, generate_subscripts(names, 1) AS pos FROM (
      SELECT *, (list_filter(raw, lambda x, i: list_position(norms, norms[i]) = i))[1:6] AS names
      FROM (SELECT *, list_transform(raw, lambda n: {norm('n')}) AS norms FROM (
        SELECT *, list_filter(list_transform(caps || {keywords('content')},
          lambda n: trim(n, {quote(C.OWNER_EDGE_CHARS)})),
          lambda n: length(n) >= 2 AND {norm('n')} <> '') AS raw
        FROM (SELECT *, regexp_extract_all(content, {quote(C.CAPITALISED_PHRASE)}, 1) AS caps
          FROM mem_orders))))))""")
