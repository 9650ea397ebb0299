"""Table schemas, row constraints and edge endpoint checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoframe import constants as C


_TYPES = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
    "array<turn>": T.ArrayType(T.StructType([
        T.StructField("session_id", T.StringType()),
        T.StructField("turn_index", T.IntegerType())])),
}


def _table(spec: str) -> T.StructType:
    """'name type, name type' -> StructType; needs no running session."""
    pairs = [field.split(" ") for field in spec.strip().split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


TURN = _table("role string, content string, has_answer boolean")
INSTANCE = T.StructType([
    *_table(
        "question_id string, question_type string, question string, answer string, "
        "question_date string, answer_session_ids array<string>, "
        "haystack_session_ids array<string>, haystack_dates array<string>"
    ).fields,
    T.StructField("haystack_sessions", T.ArrayType(T.ArrayType(TURN))),
])
FIXTURE_LINE = _table(
    "actor string, content string, source string, occurred_at timestamp, "
    "observed_at timestamp, kind string, required_data array<string>"
)

_KEYS = "scope_id string, seq long, "
OBSERVATIONS = _table(
    _KEYS + "obs_id string, actor string, content string, source string, source_id string, "
    "occurred_at timestamp, observed_at timestamp, metadata map<string,string>"
)
MEMORIES = _table(
    _KEYS + "mem_id string, mem_type string, content string, confidence double, "
    "status string, obs_id string, occurred_at timestamp, actors array<string>, "
    "source string, applies_to array<string>, priority int, metadata map<string,string>"
)
QUERIES = _table(
    _KEYS + "query_id string, question string, requester string, mode string, "
    "memory_types array<string>, required_data array<string>, "
    "allow_general_knowledge boolean, metadata map<string,string>"
)
PLANS = _table(
    _KEYS + "query_id string, vector_queries array<string>, keywords array<string>, "
    "memory_types array<string>, mode string, required_data array<string>, "
    "filters map<string,string>, metadata map<string,string>"
)
RETRIEVALS = _table(
    _KEYS + "query_id string, plan_id string, retrieved_ids array<string>, summary string, "
    "missing_data array<string>, confidence double, is_fallback boolean"
)
ANSWERS = _table(
    _KEYS + "query_id string, retrieval_id string, answer string, used_ids array<string>, "
    "evidence_ids array<string>, missing_data array<string>, confidence double"
)
QUANTITIES = _table(
    _KEYS + "src_id string, raw_value string, value double, unit string, owner string, "
    "property string, item_or_event string, exactness string, can_sum_exactly boolean, "
    "confidence double"
)
TEMPORAL_REFS = _table(
    _KEYS + "src_id string, text string, resolved_at timestamp, anchor_day string, "
    "resolution_method string, confidence double"
)
CONSOLIDATIONS = _table(
    _KEYS + "source_memory_ids array<string>, consolidated_memory_id string, "
    "reason string, confidence double"
)
EVALUATIONS = _table(
    _KEYS + "answer_id string, query_id string, used_ids array<string>, outcome string, "
    "score double, notes string"
)
POLICIES = _table(
    "name string, description string, extraction_confidence_threshold double, "
    "contradiction_confidence_threshold double, retrieval_limit int, "
    "retrieval_mode_default string, consolidate_duplicates boolean, "
    "allow_general_knowledge_in_answers boolean"
)
REQUESTS = _table(_KEYS + "mem_id string, action string, reason string")
CONCEPTS = _table(
    _KEYS + "concept_id string, name string, kind string, normalized string, "
    "aliases array<string>, mention_count long"
)
RELATIONS = _table(
    _KEYS + "src_id string, src_type string, dst_id string, dst_type string, rel string"
)
RUN_RECORDS = _table(
    "run_id string, question_id string, question_type string, is_abstention boolean, "
    "status string, error string, question string, question_date string, gold_answer string, "
    "ingest_n_obs int, ingest_n_claims int, extractor_resolved_model string, "
    "pack_errors array<string>, retrieved_object_ids array<string>, "
    "used_memory_ids array<string>, evidence_ids array<string>, "
    "context_turn_ids array<turn>, "
    "context_session_ids array<string>, retrieval_summary string, assembled_context string, "
    "hypothesis string, reader_requested_model string, reader_resolved_model string, "
    "reader_prompt_tokens int, reader_completion_tokens int, reader_total_tokens int, "
    "context_tokens int, truncated boolean, turn_recall double, turn_hit boolean, "
    "session_recall double, session_hit boolean, n_gold_turns int, n_gold_sessions int, "
    "judge_requested_model string, judge_resolved_model string, judge_correct boolean, "
    "judge_raw string, judge_total_tokens int, t_ingest double, t_read double, "
    "t_judge double, t_total double, created_at double, updated_at double"
)

# ---- row constraints: table -> {constraint name: SQL that must not be false} ----
_UNIT_RANGE = "confidence BETWEEN 0.0 AND 1.0"


def _one_of(column: str, values) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def _only(column: str, values) -> str:
    listed = ", ".join(repr(v) for v in values)
    return f"size(array_except({column}, array({listed}))) <= 0"


_MODES = ("standard", "deep")
CONSTRAINTS: dict[str, dict[str, str]] = {
    "observations": {"content_required": "content IS NOT NULL"},
    "memories": {
        "content_required": "content IS NOT NULL",
        "confidence_range": _UNIT_RANGE,
        "status_known": _one_of("status", C.ALL_STATUSES),
        "type_known": _one_of("mem_type", C.MEMORY_TYPES),
    },
    "queries": {
        "question_required": "question IS NOT NULL",
        "mode_known": _one_of("mode", _MODES),
        "types_known": _only("memory_types", C.SHORT_TYPE_NAMES),
    },
    "plans": {
        "query_required": "query_id IS NOT NULL",
        "mode_known": _one_of("mode", _MODES),
        "types_known": _only("memory_types", C.SHORT_TYPE_NAMES),
    },
    "retrievals": {"query_required": "query_id IS NOT NULL", "confidence_range": _UNIT_RANGE},
    "answers": {
        "query_required": "query_id IS NOT NULL",
        "answer_required": "answer IS NOT NULL",
        "confidence_range": _UNIT_RANGE,
    },
    "quantities": {
        "raw_required": "raw_value IS NOT NULL",
        "confidence_range": _UNIT_RANGE,
        "exactness_known": _one_of(
            "exactness",
            ("exact", "approximate", "lower_bound", "upper_bound", "range", "unknown")),
    },
    "temporal_refs": {
        "text_required": "text IS NOT NULL",
        "confidence_range": _UNIT_RANGE,
        "method_known": _one_of(
            "resolution_method",
            ("explicit_date", "relative_to_observation", "relative_to_event",
             "relative_to_benchmark_now", "duration_start", "unresolved")),
    },
    "consolidations": {
        "sources_required": "source_memory_ids IS NOT NULL",
        "reason_required": "reason IS NOT NULL",
        "confidence_range": _UNIT_RANGE,
    },
    "evaluations": {
        "outcome_known": _one_of(
            "outcome",
            ("helpful", "unhelpful", "incorrect", "unsupported", "partially_helpful",
             "unknown")),
    },
    "policies": {
        "name_required": "name IS NOT NULL",
        "extraction_range": "extraction_confidence_threshold BETWEEN 0.0 AND 1.0",
        "contradiction_range": "contradiction_confidence_threshold BETWEEN 0.0 AND 1.0",
        "limit_positive": "retrieval_limit >= 1",
        "mode_known": _one_of("retrieval_mode_default", _MODES),
    },
    "requests": {
        "target_required": "mem_id IS NOT NULL",
        "action_known": _one_of("action", ("forget", "archive")),
    },
    "concepts": {
        "name_required": "name IS NOT NULL",
        "kind_known": _one_of("kind", ("entity", "topic")),
    },
}


def _broken(rule: str):
    """A rule that evaluates to null passes: only a required value names null."""
    return ~F.coalesce(F.expr(rule), F.lit(True))


def rule_mask(table: str) -> Column:
    """All rules of a table in one number: bit k is set where its rule k is broken."""
    bits = [F.when(_broken(rule), F.lit(1 << k)).otherwise(F.lit(0))
            for k, rule in enumerate(CONSTRAINTS[table].values())]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def broken_rules(mask: Column, table: str) -> Column:
    """Names of the rules whose bits are set, in the order of the rules."""
    names = [F.when(mask.bitwiseAND(F.lit(1 << k)) != 0, F.lit(name))
             for k, name in enumerate(CONSTRAINTS[table])]
    return F.array_compact(F.array(*names))


def check_rows(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, violations): a violation row carries the broken constraint."""
    checked = df.withColumn("_broken", rule_mask(table))
    valid = checked.filter("_broken = 0").drop("_broken")
    violations = checked.filter("_broken <> 0").withColumn(
        "constraint", F.explode(broken_rules(F.col("_broken"), table))).drop("_broken")
    return valid, violations


def observed_rows(df: DataFrame, table: str) -> tuple[DataFrame, Observation]:
    """The valid rows, and an observation of all: ``n_rows`` and a count per broken rule.

    The counts are there once the valid rows have been written; the table is read once.
    """
    seen = Observation(f"rules of {table}")
    counts = [F.count_if(F.col("_broken").bitwiseAND(F.lit(1 << k)) != 0).alias(name)
              for k, name in enumerate(CONSTRAINTS[table])]
    checked = df.withColumn("_broken", rule_mask(table)).observe(
        seen, F.count(F.lit(1)).alias("n_rows"), *counts)
    return checked.filter("_broken = 0").drop("_broken"), seen


def require_rows(df: DataFrame, table: str) -> DataFrame:
    """Fail the job on the first row that breaks a constraint."""
    bad = reduce(
        lambda a, b: a | b, [_broken(r) for r in CONSTRAINTS[table].values()], F.lit(False)
    )
    guard = F.when(bad, F.raise_error(F.lit(f"row breaks a constraint of {table}")))
    return df.filter(F.coalesce(guard.cast("boolean"), F.lit(True)))


UNKNOWN_RELATION, WRONG_SOURCE, WRONG_TARGET = 1, 2, 4


def endpoint_mask() -> Column:
    """Faults of an edge in one number: unknown relation, wrong source type, wrong target type.

    A relation without source types takes any source.
    """
    def types(end: int) -> Column:
        pairs = [(F.lit(rel), F.array(*[F.lit(t) for t in ends[end]]).cast("array<string>"))
                 for rel, ends in C.RELATION_ENDPOINTS.items()]
        return F.try_element_at(F.create_map(*[x for pair in pairs for x in pair]), F.col("rel"))

    def wrong(end: int, column: str, bit: int) -> Column:
        fits = F.coalesce(F.array_contains(types(end), F.col(column)), F.lit(False))
        if end == 0:
            fits = fits | (F.size(types(end)) == 0)
        return F.when(~fits, F.lit(bit)).otherwise(F.lit(0))

    known = F.coalesce(F.col("rel").isin(*C.RELATION_ENDPOINTS), F.lit(False))
    return F.when(~known, F.lit(UNKNOWN_RELATION)).otherwise(
        wrong(0, "src_type", WRONG_SOURCE).bitwiseOR(wrong(1, "dst_type", WRONG_TARGET)))


def endpoint_violations(relations: DataFrame) -> DataFrame:
    """Edges whose relation is unknown or whose endpoint types it does not allow."""
    return relations.filter(endpoint_mask() != 0)
