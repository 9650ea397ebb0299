"""Run reports, paired statistics and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.operators import runs, sample, stats
from mnemoframe.plans import oracle as O
from mnemoframe.plans import views as V
from mnemoframe.plans.catalog import query
from mnemoframe.sources.conversations import filter_question_type

O.define("records", """
SELECT run_id, 'd' || doc_id || CASE WHEN abst THEN '_abs' ELSE '' END AS question_id,
  lang AS question_type, abst AS is_abstention,
  CASE WHEN draw % 29 = 0 THEN 'error' ELSE 'done' END AS status,
  text AS question, source AS gold_answer, text AS assembled_context,
  'Answer: ' || source AS hypothesis,
  CASE WHEN doc_id % 13 <> 0 THEN CASE run_id WHEN 'flat' THEN quality = 1 ELSE toxic = 0 END END AS judge_correct,
  CASE WHEN NOT abst THEN draw % 4 <> 0 END AS turn_hit,
  CASE WHEN NOT abst THEN (draw % 5) / 4.0 END AS turn_recall,
  CASE WHEN NOT abst THEN draw % 3 <> 0 END AS session_hit,
  CASE WHEN NOT abst THEN (draw % 3) / 2.0 END AS session_recall,
  length(text) // 4 AS context_tokens, n_chars + draw % 7 AS reader_prompt_tokens,
  CASE WHEN draw % 11 <> 0 THEN draw % 50 END AS reader_completion_tokens,
  n_chars + draw % 7 + 10 AS reader_total_tokens,
  CASE WHEN doc_id % 13 <> 0 THEN draw % 90 END AS judge_total_tokens,
  doc_id % 40 + 1 AS ingest_n_obs, doc_id % 33 AS ingest_n_claims
FROM (SELECT *, doc_id % 17 = 0 AS abst,
    ('0x' || substr(md5(doc_id || '|' || run_id), 1, 4))::BIGINT AS draw
  FROM labels JOIN documents USING (doc_id), (VALUES ('flat'), ('retain')) r(run_id))""")
O.define("aligned", """
SELECT a.question_id, a.question_type, a.is_abstention, a.judge_correct AS ca, b.judge_correct AS cb,
  a.turn_hit AS ha, b.turn_hit AS hb
FROM records a JOIN records b ON a.question_id = b.question_id
WHERE a.run_id = 'flat' AND b.run_id = 'retain' AND a.status = 'done' AND b.status = 'done'""")


def _rate(hit: str, of: str) -> str:
    return f"round(count(*) FILTER ({of} AND {hit}) / nullif(count(*) FILTER ({of}), 0), 9)"


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


_DONE, _ANS, _JUDGED = "status = 'done'", "(status = 'done' AND NOT is_abstention)", \
    "(status = 'done' AND judge_correct IS NOT NULL)"


@query("G1", f"""
SELECT run_id, count(*) FILTER ({_DONE}) AS n_questions, count(*) FILTER ({_JUDGED}) AS n_judged,
  {_rate('judge_correct', _JUDGED)} AS overall_accuracy,
  {_rate('judge_correct', _JUDGED + ' AND NOT is_abstention')} AS answerable_accuracy,
  {_rate('judge_correct', _JUDGED + ' AND is_abstention')} AS abstention_accuracy,
  round(avg(turn_recall) FILTER ({_ANS}), 9) AS turn_recall,
  {_rate('turn_hit', _ANS + ' AND turn_hit IS NOT NULL')} AS turn_hit_rate,
  round(avg(session_recall) FILTER ({_ANS}), 9) AS session_recall,
  {_rate('session_hit', _ANS + ' AND session_hit IS NOT NULL')} AS session_hit_rate,
  count(*) FILTER (status = 'error') AS n_errors,
  (sum(reader_total_tokens) FILTER ({_DONE}))::BIGINT AS reader_total_tokens,
  (sum(judge_total_tokens) FILTER ({_DONE}))::BIGINT AS judge_total_tokens
FROM records GROUP BY ALL""")
def run_metrics(spark, d):
    return _rounded(
        runs.metrics(V.run_records(spark, d)), "overall_accuracy", "answerable_accuracy",
        "abstention_accuracy", "turn_recall", "turn_hit_rate", "session_recall",
        "session_hit_rate")


@query("G2", f"""
SELECT run_id, coalesce(question_type, 'OVERALL') AS slice, count(*) FILTER ({_JUDGED}) AS n,
  {_rate('judge_correct', _JUDGED)} AS accuracy
FROM records WHERE {_DONE} GROUP BY GROUPING SETS ((run_id, question_type), (run_id))""")
def accuracy_by_type(spark, d):
    return _rounded(runs.accuracy_by_type(V.run_records(spark, d)), "accuracy")


@query("G3", "SELECT run_id, status, count(*) AS n FROM records GROUP BY ALL")
def status_counts(spark, d):
    return runs.status_counts(V.run_records(spark, d))


@query("G5", f"""
SELECT run_id, count(*) AS n_answerable, round(count(*) FILTER (judge_correct) / count(*), 9) AS accuracy,
  round(count(*) FILTER (turn_hit) / count(*), 9) AS hit_rate,
  {_rate('judge_correct', 'turn_hit')} AS accuracy_given_hit,
  {_rate('judge_correct', 'NOT turn_hit')} AS accuracy_given_miss,
  round(count(*) FILTER (turn_hit AND NOT judge_correct) / count(*), 9) AS reasoning_error_share,
  round(count(*) FILTER (NOT turn_hit AND NOT judge_correct) / count(*), 9) AS retrieval_miss_share
FROM records WHERE {_ANS} AND turn_hit IS NOT NULL GROUP BY ALL""")
def recall_conditioned(spark, d):
    return _rounded(
        runs.recall_conditioned(V.run_records(spark, d)), "accuracy", "hit_rate",
        "accuracy_given_hit", "accuracy_given_miss", "reasoning_error_share",
        "retrieval_miss_share")


@query("G6", f"""
SELECT coalesce(question_type, 'OVERALL') AS slice,
  count(*) FILTER (run_id = 'flat') AS n_flat, {_rate('turn_hit', "run_id = 'flat'")} AS hit_rate_flat,
  count(*) FILTER (run_id = 'retain') AS n_retain, {_rate('turn_hit', "run_id = 'retain'")} AS hit_rate_retain
FROM records WHERE {_ANS} AND turn_hit IS NOT NULL GROUP BY ROLLUP (question_type)""")
def turn_hit_by_type(spark, d):
    return _rounded(
        runs.turn_hit_by_type(V.run_records(spark, d), ["flat", "retain"]),
        "hit_rate_flat", "hit_rate_retain")


@query("G7", f"""
SELECT run_id, len(v) AS n, round(list_sum(v) / len(v), 9) AS mean, v[len(v) // 2 + 1] AS median,
  v[floor(len(v) * 0.9::DOUBLE)::INT + 1] AS p90
FROM (SELECT run_id, list(context_tokens ORDER BY context_tokens) AS v FROM records
  WHERE {_DONE} GROUP BY ALL)""")
def context_sizes(spark, d):
    return _rounded(runs.context_sizes(V.run_records(spark, d)), "mean")


@query("G8", f"""
SELECT run_id, count(*) AS n, count(*) FILTER (judge_correct) AS correct,
  round(count(*) FILTER (judge_correct) / count(*), 9) AS accuracy,
  count(*) - count(*) FILTER (judge_correct) AS answered
FROM records WHERE {_DONE} AND is_abstention GROUP BY ALL""")
def abstention_table(spark, d):
    return _rounded(runs.abstention_table(V.run_records(spark, d)), "accuracy")


_COSTS = ["reader_prompt_tokens", "reader_completion_tokens", "context_tokens",
          "ingest_n_claims", "ingest_n_obs"]


@query("G11", "SELECT run_id, " + ", ".join(
    f"sum({c})::BIGINT AS {c}_sum, round(avg({c}), 9) AS {c}_mean" for c in _COSTS)
    + f" FROM records WHERE {_DONE} GROUP BY ALL")
def cost_table(spark, d):
    return _rounded(
        runs.cost_table(V.run_records(spark, d)), *[f"{c}_mean" for c in _COSTS])


@query("G13", f"""
SELECT run_id, round(count(*) FILTER (NOT turn_hit) / count(*), 9) AS retrieval_miss,
  round(count(*) FILTER (turn_hit AND NOT coalesce(judge_correct, false)) / count(*), 9) AS reasoning_error,
  round(count(*) FILTER (turn_hit AND judge_correct) / count(*), 9) AS correct
FROM records WHERE {_ANS} GROUP BY ALL""")
def outcome_split(spark, d):
    return _rounded(
        runs.outcome_split(V.run_records(spark, d)), "retrieval_miss", "reasoning_error",
        "correct")


# ------------------------------------------------------------ failures


@query("G15", f"SELECT run_id, question_id FROM records WHERE {_ANS} AND turn_hit AND NOT judge_correct")
def evidence_present_wrong(spark, d):
    return runs.evidence_present_wrong(V.run_records(spark, d)).select("run_id", "question_id")


def _words(x: str) -> str:
    from mnemoframe import constants as C

    return (f"list_distinct(list_filter(regexp_extract_all(lower({x}), '([a-z0-9]+)', 1), "
            f"lambda w: length(w) > 2 AND NOT list_contains({O.listed(C.COVERAGE_STOP_WORDS)}, w)))")


_THINNED = ("lower(gold_answer) || "
            "regexp_replace(lower(assembled_context), '[a-z0-9]*e[a-z0-9]*', ' ', 'g')")


@query("G9 T16", f"""
SELECT run_id, question_type, count(*) AS n, count(*) FILTER (label = 'A') AS "n_A",
  count(*) FILTER (label = 'B') AS "n_B", count(*) FILTER (label = 'C') AS "n_C",
  count(*) FILTER (label = 'D') AS "n_D", count(*) FILTER (coverage < 0.5) AS n_low_coverage
FROM (SELECT *, chr((65 + length(question_id) % 4)::INT) AS label,
    CASE WHEN len(g) = 0 THEN 1.0 ELSE len(list_intersect(g, c)) / len(g) END AS coverage
  FROM (SELECT *, {_words('question')} AS g, {_words(_THINNED)} AS c
    FROM records WHERE {_ANS} AND turn_hit AND NOT judge_correct)) GROUP BY ALL""")
def triage_counts(spark, d):
    failed = runs.evidence_present_wrong(V.run_records(spark, d))
    labelled = failed.select(
        "run_id", "question_type", F.col("question").alias("gold_answer"),
        # the text without its words that have an e
        F.concat(F.lower("gold_answer"), F.regexp_replace(
            F.lower("assembled_context"), "[a-z0-9]*e[a-z0-9]*", " ")).alias("context"),
        F.char(65 + F.length("question_id") % 4).alias("label"))
    return runs.triage_counts(labelled)


@query("G12 T23", f"""
SELECT run_id, question_type, category, question_id FROM (
  SELECT *, CASE WHEN turn_hit THEN 'evidence_present' ELSE 'retrieval_miss' END AS category
  FROM records WHERE {_ANS} AND NOT judge_correct)
QUALIFY row_number() OVER (PARTITION BY run_id, question_type, category ORDER BY question_id) <= 3""")
def failure_samples(spark, d):
    return runs.failure_samples(V.run_records(spark, d)).select(
        "run_id", "question_type", "category", "question_id")


# ------------------------------------------------------------ pairs of runs


def _aligned(spark, d):
    return runs.align_runs(V.run_records(spark, d), ["flat", "retain"])


@query("J12 G17", "SELECT question_id, question_type FROM aligned")
def aligned_questions(spark, d):
    return _aligned(spark, d).select("question_id", "question_type")


@query("J13", """
SELECT count(*) AS n, count(*) FILTER (ca) AS first_right, count(*) FILTER (cb) AS second_right
FROM aligned WHERE NOT is_abstention AND ha AND hb""")
def matched_hits(spark, d):
    sub = runs.matched_hits(_aligned(spark, d), "flat", "retain")
    return sub.agg(
        F.count("*").alias("n"), F.count_if("flat.judge_correct").alias("first_right"),
        F.count_if("retain.judge_correct").alias("second_right"))


_COUNTS = """
SELECT coalesce(question_type, 'OVERALL') AS slice, count(*) AS n,
  count(*) FILTER (ca AND NOT cb) AS b, count(*) FILTER (NOT ca AND cb) AS c
FROM aligned GROUP BY ROLLUP (question_type)"""


@query("Q2 Q3 Q4", f"""
SELECT slice, n, b, c, c - b AS net,
  round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(generate_series(0, least(b, c)),
    lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0))))) END, 8) AS p_exact,
  round(CASE WHEN b + c = 0 THEN 0.0 ELSE power(abs(b - c) - 1, 2) / (b + c) END, 9)::DOUBLE AS chi2
FROM ({_COUNTS})""")
def mcnemar(spark, d):
    table = stats.mcnemar_table(runs.discordant_counts(_aligned(spark, d), "flat", "retain"))
    return table.select(
        "slice", "n", "b", "c", "net", F.round("p_exact", 8).alias("p_exact"),
        F.round("chi2", 9).alias("chi2"))


@query("Q4")
def mcnemar_chi2_p(spark, d):
    """erfc has no SQL form; checked against math.erfc in the tests."""
    counts = runs.discordant_counts(_aligned(spark, d), "flat", "retain")
    return counts.select("slice", F.round(stats.chi2_p_value(
        stats.mcnemar_chi2(F.col("b"), F.col("c"))), 9).alias("p"))


@query("G10 G17", """
SELECT question_id, question_type, CASE WHEN ca AND NOT cb THEN 'regression' ELSE 'gain' END AS change
FROM aligned WHERE ca <> cb""")
def gains_and_regressions(spark, d):
    return runs.gains_and_regressions(_aligned(spark, d), "flat", "retain")


@query("Q1", f"""
SELECT run_id, question_type, k, n, round(k / n, 9) AS accuracy,
  round((k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 9)::DOUBLE AS low,
  round((k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 9)::DOUBLE AS high
FROM (SELECT run_id, question_type, count(*) FILTER (judge_correct) AS k, count(*) AS n
  FROM records WHERE {_DONE} GROUP BY ALL)""")
def wilson_intervals(spark, d):
    rates = V.run_records(spark, d).filter("status = 'done'").groupBy(
        "run_id", "question_type").agg(
        F.count_if("judge_correct").alias("k"), F.count("*").alias("n"))
    return _rounded(stats.accuracy_with_interval(rates), "accuracy", "low", "high")


@query("Q6", f"""
SELECT slice, round(max(scaled) OVER (ORDER BY p, slice), 8) AS p_holm,
  round(least(1.0, m * p), 8) AS p_bonferroni
FROM (SELECT *, least(1.0, (m - row_number() OVER (ORDER BY p, slice) + 1) * p) AS scaled
  FROM (SELECT slice, exp(-n / 100.0)::DOUBLE AS p, count(*) OVER () AS m FROM ({_COUNTS})))""")
def holm_adjusted(spark, d):
    counts = runs.discordant_counts(_aligned(spark, d), "flat", "retain")
    tests = counts.select("slice", F.exp(-F.col("n") / 100.0).alias("p"))
    return stats.holm_adjust(tests, "p").select(
        "slice", F.round("p_holm", 8).alias("p_holm"),
        F.round("p_bonferroni", 8).alias("p_bonferroni"))


@query("Q5")
def bootstrap_interval(spark, d):
    """Seeded resampling has no SQL twin; checked for coverage in the tests."""
    pairs = _aligned(spark, d).select(
        "question_id", F.coalesce(F.col("flat.judge_correct").cast("int"), F.lit(0))
        .alias("first"),
        F.coalesce(F.col("retain.judge_correct").cast("int"), F.lit(0)).alias("second"))
    return stats.bootstrap_delta(pairs)


# ------------------------------------------------------------ sampling

O.define("sample_types", """
SELECT question_type, count(*) AS n, sum(count(*)) OVER () AS total FROM records
WHERE run_id = 'flat' GROUP BY ALL""")
O.define("sample_alloc", """
SELECT question_type, n, base + (row_number() OVER (ORDER BY rest DESC, question_type DESC)
  <= 50 - sum(base) OVER ())::INT AS take
FROM (SELECT *, (50 * n // total)::BIGINT AS base, 50 * n % total AS rest FROM sample_types)""")
O.define("sampled", """
SELECT r.question_id, r.question_type FROM (
  SELECT question_id, question_type, row_number() OVER (
    PARTITION BY question_type ORDER BY md5('42|' || question_id), question_id) AS k
  FROM records WHERE run_id = 'flat') r
JOIN sample_alloc a ON a.question_type = r.question_type WHERE k <= take""")


def _instances(spark, d):
    return V.run_records(spark, d).filter("run_id = 'flat'")


@query("G4", "SELECT question_id, question_type FROM sampled")
def stratified_sample(spark, d):
    return sample.stratified_sample(_instances(spark, d), 50)


@query("J9 G4", """
SELECT question_id FROM sampled WHERE question_id NOT IN (
  SELECT question_id FROM records WHERE run_id = 'retain' AND status = 'done')""")
def not_done_yet(spark, d):
    done = V.run_records(spark, d).filter("run_id = 'retain'")
    return sample.not_done(sample.stratified_sample(_instances(spark, d), 50), done).select(
        "question_id")


@query("S7 G16", """
SELECT question_id FROM records WHERE run_id = 'flat' AND question_type = 'en'
ORDER BY question_id LIMIT 25""")
def first_of_type(spark, d):
    return filter_question_type(_instances(spark, d), "en").select("question_id").orderBy(
        "question_id").limit(25)
