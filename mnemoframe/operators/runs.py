"""Reports over run records: one wide row per (run_id, question_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions.text import (
    estimate_tokens,
    gold_coverage,
    shorten,
    verdict_is_yes,
)
from mnemoframe.operators.groups import top_k

OVERALL = "OVERALL"


def _rate(hit: Column, of: Column) -> Column:
    """Share of rows in ``of`` that also satisfy ``hit``; null when there are none."""
    return F.count_if(of & hit) / F.nullif(F.count_if(of), F.lit(0))


def _true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


# ------------------------------------------------------------ one run


def evaluated_records(
    run_id: str, questions: DataFrame, scores: DataFrame, contexts: DataFrame, read: DataFrame
) -> DataFrame:
    """The run records of one evaluation loop, one row per question.

    ``questions``: query_id, question_type, is_abstention; ``scores``: the retrieval scores;
    ``contexts``: query_id, context.  ``read`` has a row per question that a reader answered:
    query_id, hypothesis, judge_text (null if no judge saw it), reader_total_tokens,
    judge_total_tokens.  A question without such a row is an error.
    """
    scored = scores.drop("is_abstention")
    context = contexts.select(
        "query_id", F.col("context").alias("assembled_context"),
        estimate_tokens(F.col("context")).alias("context_tokens"))
    judged = read.select(
        "query_id", "hypothesis",
        F.when(F.col("judge_text").isNotNull(), verdict_is_yes(F.col("judge_text")))
        .alias("judge_correct"),
        "reader_total_tokens", "judge_total_tokens", F.lit("done").alias("status"))
    return (
        questions.join(scored, "query_id", "left").join(context, "query_id", "left")
        .join(judged, "query_id", "left")
        .withColumns({"run_id": F.lit(run_id), "status": F.coalesce("status", F.lit("error"))})
        .withColumnRenamed("query_id", "question_id"))


def metrics(records: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Accuracy, recall, hit rates, errors and tokens, in one pass per run."""
    done = F.col("status") == "done"
    judged = done & F.col("judge_correct").isNotNull()
    abstention = _true("is_abstention")
    answerable = done & ~abstention
    right = _true("judge_correct")
    return records.groupBy(*by).agg(
        F.count_if(done).alias("n_questions"),
        F.count_if(judged).alias("n_judged"),
        _rate(right, judged).alias("overall_accuracy"),
        _rate(right, judged & ~abstention).alias("answerable_accuracy"),
        _rate(right, judged & abstention).alias("abstention_accuracy"),
        F.avg(F.when(answerable, F.col("turn_recall"))).alias("turn_recall"),
        _rate(_true("turn_hit"), answerable & F.col("turn_hit").isNotNull())
        .alias("turn_hit_rate"),
        F.avg(F.when(answerable, F.col("session_recall"))).alias("session_recall"),
        _rate(_true("session_hit"), answerable & F.col("session_hit").isNotNull())
        .alias("session_hit_rate"),
        F.count_if(F.col("status") == "error").alias("n_errors"),
        F.coalesce(F.sum(F.when(done, F.col("reader_total_tokens"))), F.lit(0))
        .alias("reader_total_tokens"),
        F.coalesce(F.sum(F.when(done, F.col("judge_total_tokens"))), F.lit(0))
        .alias("judge_total_tokens"),
    )


def accuracy_by_type(records: DataFrame) -> DataFrame:
    """Judged rows and accuracy per run and type, with an OVERALL row per run."""
    done = records.filter("status = 'done'")
    judged = F.col("judge_correct").isNotNull()
    return with_overall(done, ["run_id"], [
        F.count_if(judged).alias("n"),
        _rate(_true("judge_correct"), judged).alias("accuracy"),
    ])


def with_overall(df: DataFrame, keys: list[str], measures: list[Column]) -> DataFrame:
    """Aggregate by keys and question_type plus one OVERALL row per key."""
    level = F.grouping_id().alias("_level")
    rolled = df.rollup(*keys, "question_type").agg(level, *measures)
    return rolled.filter(F.col("_level") <= 1).withColumn(
        "slice", F.when(F.col("_level") == 1, OVERALL).otherwise(F.col("question_type"))
    ).drop("_level", "question_type")


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("run_id", "status").agg(F.count("*").alias("n"))


def recall_conditioned(records: DataFrame) -> DataFrame:
    """Accuracy given hit or miss, and what share of questions each error takes."""
    rows = records.filter(
        (F.col("status") == "done") & ~_true("is_abstention") & F.col("turn_hit").isNotNull())
    hit, right = F.col("turn_hit"), _true("judge_correct")
    wrong = F.coalesce(~F.col("judge_correct"), F.lit(False))
    n = F.count("*")
    return rows.groupBy("run_id").agg(
        n.alias("n_answerable"),
        (F.count_if(right) / n).alias("accuracy"),
        (F.count_if(hit) / n).alias("hit_rate"),
        F.coalesce(_rate(right, hit), F.lit(0.0)).alias("accuracy_given_hit"),
        F.coalesce(_rate(right, ~hit), F.lit(0.0)).alias("accuracy_given_miss"),
        (F.count_if(hit & wrong) / n).alias("reasoning_error_share"),
        (F.count_if(~hit & wrong) / n).alias("retrieval_miss_share"),
    )


def turn_hit_by_type(records: DataFrame, runs: list[str]) -> DataFrame:
    """Turn-hit rate per slice, one column per run."""
    rows = records.filter(
        (F.col("status") == "done") & ~_true("is_abstention") & F.col("turn_hit").isNotNull())
    measures = []
    for run in runs:
        mine = F.col("run_id") == run
        measures.append(F.count_if(mine).alias(f"n_{run}"))
        measures.append(
            F.coalesce(_rate(_true("turn_hit"), mine), F.lit(0.0)).alias(f"hit_rate_{run}"))
    total = rows.agg(*measures).withColumn("slice", F.lit(OVERALL))
    per_type = rows.groupBy(F.col("question_type").alias("slice")).agg(*measures)
    return per_type.unionByName(total)


def context_sizes(records: DataFrame) -> DataFrame:
    """Mean, median and p90 of context tokens by nearest rank: v[n//2], v[int(.9n)].

    Counting equal sizes first leaves one row per distinct size, so the running
    total never sorts the rows of a run themselves.
    """
    sizes = (
        records.filter((F.col("status") == "done") & F.col("context_tokens").isNotNull())
        .groupBy("run_id", "context_tokens").agg(F.count("*").alias("n")))
    by_size = Window.partitionBy("run_id").orderBy("context_tokens")
    placed = sizes.withColumns({
        "below_or_at": F.sum("n").over(
            by_size.rowsBetween(Window.unboundedPreceding, 0)),
        "total": F.sum("n").over(Window.partitionBy("run_id")),
    })

    def at(position: Column) -> Column:
        """Smallest size whose rank range contains the 0-based position."""
        return F.min(F.when(F.col("below_or_at") > position, F.col("context_tokens")))

    return placed.groupBy("run_id").agg(
        F.max("total").alias("n"),
        (F.sum(F.col("n") * F.col("context_tokens")) / F.max("total")).alias("mean"),
        at(F.floor(F.col("total") / 2)).alias("median"),
        at(F.floor(F.col("total") * F.lit(0.9))).alias("p90"),
    )


def abstention_table(records: DataFrame) -> DataFrame:
    rows = records.filter((F.col("status") == "done") & _true("is_abstention"))
    correct = F.count_if(_true("judge_correct"))
    return rows.groupBy("run_id").agg(
        F.count("*").alias("n"), correct.alias("correct"),
        (correct / F.count("*")).alias("accuracy"),
        (F.count("*") - correct).alias("answered"))


def cost_table(records: DataFrame) -> DataFrame:
    names = ["reader_prompt_tokens", "reader_completion_tokens", "context_tokens",
             "ingest_n_claims", "ingest_n_obs"]
    measures = [m for n in names for m in (
        F.coalesce(F.sum(n), F.lit(0)).alias(f"{n}_sum"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias(f"{n}_mean"))]
    return records.filter("status = 'done'").groupBy("run_id").agg(*measures)


def outcome_split(records: DataFrame) -> DataFrame:
    """Correct with evidence, wrong with evidence, evidence missed."""
    rows = records.filter((F.col("status") == "done") & ~_true("is_abstention"))
    hit, right, n = _true("turn_hit"), _true("judge_correct"), F.count("*")
    return rows.groupBy("run_id").agg(
        (F.count_if(~hit) / n).alias("retrieval_miss"),
        (F.count_if(hit & ~right) / n).alias("reasoning_error"),
        (F.count_if(hit & right) / n).alias("correct"))


# ------------------------------------------------------------ failures


def evidence_present_wrong(records: DataFrame) -> DataFrame:
    """Answerable, evidence hit, judged wrong."""
    return records.filter(
        (F.col("status") == "done") & (F.col("is_abstention") == F.lit(False))
        & (F.col("turn_hit") == F.lit(True)) & (F.col("judge_correct") == F.lit(False)))


def triage_counts(labelled: DataFrame) -> DataFrame:
    """Labels A-D per run and type, and how often the gold words are mostly absent.

    ``labelled`` has run_id, question_type, label, gold_answer and context.
    """
    covered = labelled.withColumn(
        "coverage", gold_coverage(F.col("gold_answer"), F.col("context")))
    return covered.groupBy("run_id", "question_type").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("label") == v).alias(f"n_{v}") for v in "ABCD"],
        F.count_if(F.col("coverage") < 0.5).alias("n_low_coverage"))


def failure_samples(records: DataFrame, per_category: int = 3) -> DataFrame:
    """The first failures by id of every run, type and failure category."""
    wrong = F.col("judge_correct") == F.lit(False)
    category = F.when(
        F.col("turn_hit") == F.lit(True), "evidence_present").when(
        F.col("turn_hit") == F.lit(False), "retrieval_miss")
    rows = records.filter(
        (F.col("status") == "done") & (F.col("is_abstention") == F.lit(False)) & wrong
    ).withColumn("category", category).filter(F.col("category").isNotNull())
    first = top_k(
        rows.select("run_id", "question_type", "category", "question_id", "question"),
        ["run_id", "question_type", "category"], [F.asc("question_id")], per_category)
    return first.withColumn("question", shorten(F.col("question"), 200))


# ------------------------------------------------------------ several runs


def align_runs(records: DataFrame, runs: list[str]) -> DataFrame:
    """Questions done in every run, one row each with a struct column per run.

    One grouped pass over the records instead of a chain of joins.
    """
    fields = F.struct(
        "is_abstention", "judge_correct", "turn_hit", "context_tokens")
    columns = [
        F.max(F.when(F.col("run_id") == run, fields)).alias(run) for run in runs]
    types = F.max(F.when(F.col("run_id") == runs[0], F.col("question_type")))
    grouped = records.filter(
        (F.col("status") == "done") & F.col("run_id").isin(*runs)
    ).groupBy("question_id").agg(types.alias("question_type"), *columns)
    present = reduce(lambda a, b: a & b, [F.col(run).isNotNull() for run in runs])
    return grouped.filter(present)


def _pair(aligned: DataFrame, first: str, second: str) -> tuple[Column, Column]:
    a, b = F.col(f"{first}.judge_correct"), F.col(f"{second}.judge_correct")
    return (
        F.coalesce(a & ~b, F.lit(False)),
        F.coalesce(~a & b, F.lit(False)),
    )


def matched_hits(aligned: DataFrame, first: str, second: str) -> DataFrame:
    """Both answerable and both with the gold turn retrieved."""
    def ok(run: str) -> Column:
        return (F.col(f"{run}.is_abstention") == F.lit(False)) & (
            F.col(f"{run}.turn_hit") == F.lit(True))

    return aligned.filter(ok(first) & ok(second))


def discordant_counts(aligned: DataFrame, first: str, second: str) -> DataFrame:
    """b (only the first right) and c (only the second right) per slice and overall."""
    only_first, only_second = _pair(aligned, first, second)
    measures = [F.count("*").alias("n"), F.count_if(only_first).alias("b"),
                F.count_if(only_second).alias("c")]
    total = aligned.agg(*measures).withColumn("slice", F.lit(OVERALL))
    return aligned.groupBy(F.col("question_type").alias("slice")).agg(*measures).unionByName(
        total)


def gains_and_regressions(aligned: DataFrame, first: str, second: str) -> DataFrame:
    """Ids the second run gained or lost against the first, one row per id."""
    only_first, only_second = _pair(aligned, first, second)
    change = F.when(only_first, "regression").when(only_second, "gain")
    return aligned.select("question_id", "question_type", change.alias("change")).filter(
        F.col("change").isNotNull())
