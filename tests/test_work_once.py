"""Costly steps appear once in a plan, and rows move no more than they must."""

from datetime import datetime

from conftest import FOLDER
from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemoframe.functions import numeric
from mnemoframe.operators import agentic, concepts, enrich, extract, groups, reconcile, retrieve, scan, stats
from mnemoframe.plans import catalog, views
from mnemoframe.settings import DEFAULTS


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def observed(spark, *texts):
    at = datetime(2024, 5, 20)
    rows = [(1, k, f"memory_observation#{k}", t, at, at) for k, t in enumerate(texts, 1)]
    return spark.createDataFrame(
        rows, "scope_id long, seq long, obs_id string, content string, occurred_at timestamp, "
              "observed_at timestamp")


def test_kind_of_a_text_is_found_once(spark):
    rows = observed(spark, "Bo met 7 people yesterday")
    for found in (enrich.temporal_refs(rows, extraction=DEFAULTS),
                  enrich.quantities(rows, extraction=DEFAULTS)):
        assert plan(found).count("on june") == 1
        assert {r.src_id for r in found.collect()} == {"memory_observation#1", "episodic_memory#1"}


def test_blanks_around_a_text_make_two_texts(spark):
    rows = observed(spark, " Bo met 7 people yesterday ", "Always use 5 days", "   ")
    found = enrich.quantities(rows, extraction=DEFAULTS).collect()
    assert sorted((r.src_id, r.raw_value) for r in found) == [
        ("episodic_memory#1", "7 people"), ("memory_observation#1", "7 people"),
        ("memory_observation#2", "5 days")]


def test_labels_resolve_a_mention_once(spark):
    rows = observed(spark, "yesterday and today and 2024-05-01 and may 3", "nothing", "today")
    labels = enrich.resolved_date_labels(enrich.temporal_refs(rows))
    assert plan(labels).count("make_dt_interval") == 1
    assert sorted((r.src_id, r.labels) for r in labels.collect()) == [
        ("memory_observation#1", "today = 2024-05-20; yesterday = 2024-05-19"),
        ("memory_observation#3", "today = 2024-05-20")]


def test_matches_of_any_number(spark):
    for n in (0, 1, 2, 3, 130, 300):
        text = "é" + " and ".join(f"{k} users" for k in range(n))
        found = spark.createDataFrame([(text,)], "t string").select(
            numeric.quantity_matches(F.col("t"))).first()[0]
        assert [m.raw for m in found] == [f"{k} users" for k in range(n)][n > 0:]
        assert all(text[m.start:m.start + len(m.raw)] == m.raw for m in found)


def test_small_and_large_groups_are_numbered_alike(spark):
    rows = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 7 > 0, F.col("id") % 50).alias("k"),
        (F.col("id") * 7919 % 2000).alias("o"))
    plain = sorted(rows.withColumn("s", F.row_number().over(
        Window.partitionBy("k").orderBy("o")).cast("long")).collect(), key=str)
    whole = groups.number_in_group(rows, ["k"], ["o"], "s", True)
    assert "_range" not in plan(whole)
    mixed = groups.number_in_group(rows, ["k"], ["o"], "s", True, group_rows=300)
    assert "_range" in plan(mixed)
    assert sorted(whole.collect(), key=str) == plain == sorted(mixed.collect(), key=str)


def test_extraction_rate_joins_nothing(spark):
    gold = spark.createDataFrame(
        [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, None)], "k long, w string")
    found = spark.createDataFrame([(1, "a"), (2, None), (2, "c"), (2, "c")], "k long, w string")
    rate = stats.extraction_rate(gold, found, ["k", "w"], by=["k"])
    assert "Join" not in plan(rate)
    assert sorted(map(tuple, rate.collect())) == [(1, 2, 1, 0.5), (2, 2, 0, 0.0)]


def test_all_kinds_on_need_no_filter_on_the_kind(spark):
    rows = observed(spark, "Always use blue", "x").withColumns(
        {"actor": F.lit("user"), "source": F.lit("s")})
    assert plan(extract.extract_memories(rows)).count("for future") == 1
    few = extract.extract_memories(rows, DEFAULTS.but(enable_procedural_memory=False))
    assert [r.mem_type for r in few.collect()] == ["memory_claim"]


def test_many_questions_are_one_pass_over_the_memories(spark):
    """Parts of whole scopes, cut into cells, and one scope in rounds give what one pack gives."""
    words = "ana bo lives works rome bonn big small green blue fund team".split()
    pick = [F.element_at(F.array(*map(F.lit, words)), (F.col("id") * p % 12 + 1).cast("int"))
            for p in (1, 5, 7, 11)]
    scope = F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 50 > 1, F.col("id") % 50)
    rows = spark.range(600).select(
        scope.cast("long").alias("scope_id"), F.concat(F.lit("m#"), F.col("id")).alias("mem_id"),
        F.when(F.col("id") % 4 == 0, "memory_claim").otherwise("episodic_memory").alias("mem_type"),
        F.when(F.col("id") % 5 == 0, "superseded").otherwise("active").alias("status"),
        F.concat_ws(" ", *pick[:3]).alias("content"))
    asked = spark.range(300).select(
        scope.cast("long").alias("scope_id"), F.col("id").cast("string").alias("query_id"),
        F.concat_ws(" ", F.lit("when"), *pick[1:]).alias("question"))
    memories = groups.stored(retrieve.with_embedding(rows, "content"))
    plans = groups.stored(retrieve.with_embedding(retrieve.plan_retrieval(asked), "question"))

    def hits(**tuning):
        return sorted(map(tuple, retrieve.flat_retrieve(memories, plans, **tuning).select(
            "query_id", "scope_id", "mem_id", "rank", F.round("score", 9)).collect()))

    want = hits()
    assert len({row[1] for row in want}) > 30
    calls = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    assert hits(per_round=64, cell_memories=7, counted=calls) == want
    assert calls[0].value > 0
    found = scan.best_of_tasks(memories, plans.filter("scope_id != 1"), 5, per_round=100)
    # one scan of the memories, whatever the number of questions
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_successors_are_sought_once(spark, monkeypatch):
    sought, search = [], reconcile.first_successors

    def watched(memories, *args, **kwargs):
        sought.append(memories)
        return search(memories, *args, **kwargs)

    monkeypatch.setattr(reconcile, "first_successors", watched)
    catalog.load()["policy_differences"].run(spark, FOLDER)
    assert len(sought) == 1
    # linked facts and found concepts do not depend on any status
    for name in ("linked_facts_with_overlap", "concept_search"):
        catalog.load()[name].run(spark, FOLDER)
    assert len(sought) == 1


def test_hits_score_facts_once_beside_the_decision(spark):
    cycle = views.CustomerLifecycle(spark, FOLDER)
    memories, plans = cycle.current(), views.materialize(cycle.plans())
    hits, decision = agentic.agentic_retrieve(
        memories, concepts.build_concepts(memories), concepts.about_entity_edges(memories), plans,
        DEFAULTS.but(agentic_entity_overlap_weight=0.1, agentic_rerank_keep_ratio=0.7))
    # the cosine of linked facts is an Arrow function; direct facts come out of their scan
    assert plan(hits).count("ArrowEvalPython") == 1 and plan(decision).count("ArrowEvalPython") == 0
