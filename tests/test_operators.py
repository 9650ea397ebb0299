"""Closed forms against plain sequential replays, two-level helpers, guards, streams."""

import hashlib
import math
import random
from datetime import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemoframe import schemas
from mnemoframe.operators import (
    agentic,
    answer,
    cache,
    extract,
    groups,
    hooks,
    reconcile,
    retrieve,
    runs,
    stats,
    strategies,
)
from mnemoframe.operators import concepts as concept_ops
from mnemoframe.settings import DEFAULTS
from mnemoframe.sources import conversations, fingerprint, store

NAMES = ["ana lives", "bo owns", "the fund"]
WORDS = "rome bonn oslo red blue green big small one two three four five six seven".split()


def random_memories(spark, n, seed, scopes=2, tail=6):
    rng = random.Random(seed)
    rows = []
    for scope in range(scopes):
        for seq in range(1, n + 1):
            words = [rng.choice(WORDS) for _ in range(rng.randint(1, tail))]
            head = rng.choice(NAMES)
            cue = rng.choice(["", "", " now"])
            rows.append((scope, seq, f"{head}{cue} {' '.join(words)}"))
    observed = spark.createDataFrame(rows, "scope_id long, seq long, content string").withColumns({
        "obs_id": F.concat(F.lit("memory_observation#"), "seq"), "actor": F.lit("user"),
        "source": F.lit("chat"), "occurred_at": F.lit(None).cast("timestamp")})
    return extract.extract_memories(observed)


def replay(rows, requests=()):
    """The sequential reference: every new memory meets the still-active older ones."""
    from collections import defaultdict

    markers = set("update updated actually correction note fyi btw so well okay ok now today "
                  "yesterday edit fix".split())
    cues = (" now ", " now,", "now called", " changed to ", " renamed ", " actually ",
            " correction", " updated to ", " is now ", " was renamed")
    status, changes, seen = {}, {}, defaultdict(list)
    events = [(r.seq, 0, r) for r in rows] + [(q[2], 1, q) for q in requests]
    for _, what, e in sorted(events, key=lambda x: x[:2]):
        if what == 1:
            if (e[0], e[1]) in status:
                status[e[0], e[1]] = {"forget": "deleted", "archive": "archived"}[e[3]]
            continue
        tokens = e.content.split()
        key = [t for t in tokens if t not in markers][:2]
        for old in seen[e.scope_id, e.mem_type]:
            old_id = (e.scope_id, old.mem_id)
            if status[old_id] != "active":
                continue
            other = old.content.split()
            if other == tokens:
                status[old_id] = "archived"
                changes[old_id] = (e.seq, "consolidated_into")
                continue
            if [t for t in other if t not in markers][:2] != key:
                continue
            a, b = set(tokens), set(other)
            if len(a & b) / max(1, min(len(a), len(b))) < 0.4:
                continue
            replaces = any(c in f" {e.content} " for c in cues)
            status[old_id] = "superseded" if replaces else "needs_review"
            changes[old_id] = (e.seq, "supersedes" if replaces else "contradicts")
        status[e.scope_id, e.mem_id] = "active"
        seen[e.scope_id, e.mem_type].append(e)
    return status, changes


@pytest.mark.parametrize("tail, tuning", [
    (6, {}), (14, {"look_ahead": 1, "block_rows": 8}), (14, {"look_ahead": 3, "block_rows": 1024})])
def test_reconcile_equals_replay(spark, tail, tuning):
    memories = groups.materialize(random_memories(spark, 120, seed=tail, tail=tail))
    rows = memories.collect()
    status, changes = replay(rows)
    found = reconcile.reconcile(memories, **tuning)
    got = {(r.scope_id, r.older_id): (r.newer_seq, r.rel) for r in found.collect()}
    assert got == changes
    current = reconcile.with_status(memories, found).collect()
    assert {(r.scope_id, r.mem_id): r.status for r in current} == status


def hot_subject(n, seed=0, tail=12, short_from=None):
    """One subject of ``n`` texts that hardly match: mostly unique words, a few shared ones."""
    rng = random.Random(seed)
    rows = []
    for seq in range(1, n + 1):
        words = [f"u{seed}x{seq}y{i}" for i in range(tail - 4)] + [
            f"w{rng.randrange(3 * n)}" for _ in range(4)]
        if seq % 40 == 0:  # a text much like one long before
            words = rows[rng.randrange(len(rows))][2].split()[2:8] + words[:6]
        if short_from and seq >= short_from and seq % 9 == 0:
            words = [f"s{seq % 2}"]
        rows.append((0, seq, "ana lives " + " ".join(words)))
    return rows


@pytest.mark.parametrize("short_from", [None, 150])
def test_far_conflicts_of_a_hot_subject(spark, short_from):
    rows = hot_subject(260, short_from=short_from)
    observed = spark.createDataFrame(rows, "scope_id long, seq long, content string").withColumns({
        "obs_id": F.concat(F.lit("memory_observation#"), "seq"), "actor": F.lit("user"),
        "source": F.lit("chat"), "occurred_at": F.lit(None).cast("timestamp")})
    memories = groups.materialize(extract.extract_memories(observed))
    _, changes = replay(memories.collect())
    found = reconcile.reconcile(memories, look_ahead=2, block_rows=16).collect()
    assert {(r.scope_id, r.older_id): (r.newer_seq, r.rel) for r in found} == changes
    assert any(r.newer_seq - r.older_seq > 40 for r in found)


def test_twice_the_hot_subject_at_most_twice_the_work(spark):
    """Candidates and index entries of a subject whose texts do not match grow linearly."""
    work = []
    for n in (200, 400):
        rows = spark.createDataFrame(
            [(0, "memory_claim", s, "ana lives", t.split(), str(s)) for _, s, t in hot_subject(n, 1)],
            "scope_id long, mem_type string, seq long, subject string, tokens array<string>, sig string")
        sized = reconcile._sized(rows)
        half = F.floor(F.col("seq") / (n // 2 + 1))
        entries = groups.materialize(reconcile._overlap_entries(sized).withColumn("cell", half))
        asking = sized.filter(half == 0).withColumn("cell", F.lit(1).cast("long"))
        work.append((entries.count(), reconcile._sharing_pairs(asking, entries).count()))
    assert work[1][0] <= 2.1 * work[0][0] and work[1][1] <= 2.5 * max(work[0][1], 20)


def test_requests_equal_replay(spark):
    memories = groups.materialize(random_memories(spark, 60, seed=3))
    rows = memories.collect()
    asked = [(r.scope_id, r.mem_id, r.seq + 2.5, "forget" if r.seq % 2 else "archive")
             for r in rows if r.seq % 4 == 0]
    status, _ = replay(rows, asked)
    requests = spark.createDataFrame(
        [(a[0], a[1], a[3], a[2]) for a in asked],
        "scope_id long, mem_id string, action string, seq double")
    changes = reconcile.reconcile(memories, requests=requests)
    current = reconcile.with_status(memories, changes, requests).collect()
    assert {(r.scope_id, r.mem_id): r.status for r in current} == status


def test_lower_threshold_never_keeps_fewer(spark):
    observed = random_memories(spark, 20, seed=1).select(
        "scope_id", "seq", "content", "obs_id", F.lit("u").alias("actor"), "source",
        "occurred_at")
    strict = extract.extract_memories(
        observed, DEFAULTS.but(extraction_confidence_threshold=0.9)).count()
    loose = extract.extract_memories(
        observed, DEFAULTS.but(extraction_confidence_threshold=0.4)).count()
    assert strict == 0 and loose == 40


def test_two_level_numbering_and_next(spark):
    rows = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"),
        (F.col("id") * 7919 % 2000).alias("o"))
    plain = rows.withColumn("s", F.row_number().over(
        Window.partitionBy("k").orderBy("o")).cast("long"))
    split = groups.number_in_group(rows, ["k"], ["o"], "s")
    assert sorted(plain.collect()) == sorted(split.collect())
    near = groups.next_in_group(plain, ["k"], "s", "n")
    chunked = groups.next_in_group(plain, ["k"], "s", "n", chunk_rows=16)
    assert sorted(near.collect(), key=str) == sorted(chunked.collect(), key=str)


def test_salted_top_k(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    top = groups.top_k(rows, ["k"], [F.desc("v")], 1500)
    assert top.groupBy("k").agg(F.min("v").alias("m")).orderBy("k").collect() == [
        (0, 2000), (1, 2001)]


def embedded(spark, n=40, seed=5):
    memories = random_memories(spark, n, seed)
    current = reconcile.with_status(memories, reconcile.reconcile(memories))
    stored = groups.materialize(retrieve.with_embedding(current, "content"))
    questions = spark.createDataFrame(
        [(f"q{i}", i % 2, t) for i, t in enumerate([
            "where has ana lives rome", "when big fund", "list all seven", "bo owns green two",
            "nothing known here"])],
        "query_id string, scope_id long, question string")
    plans = groups.materialize(
        retrieve.with_embedding(retrieve.plan_retrieval(questions), "question"))
    return stored, plans


@pytest.mark.parametrize("per_round", [1, 2, 10_000])
def test_scan_equals_all_pairs(spark, per_round):
    """Both legs against every pair scored one by one, in one round and in many."""
    stored, plans = embedded(spark)
    rows, asked = stored.collect(), plans.collect()
    for limit in (2, 7):
        want = {"keyword": [], "vector": []}
        for q in asked:
            scores = {"keyword": [], "vector": []}
            for m in rows:
                if (m.scope_id != q.scope_id or m.mem_type not in q.types
                        or m.status in ("archived", "deleted")
                        or (m.status == "superseded" and not q.show_superseded)):
                    continue
                shared = len(set(q.keywords) & set(m.content.lower().split()))
                scores["keyword"].append((-shared / max(1, len(q.keywords)), m.mem_id))
                cosine = sum(a * b for a, b in zip(q.embedding, m.embedding))
                scores["vector"].append((-round(cosine, 9), m.mem_id))
            for leg, found in scores.items():
                first = sorted(x for x in found if x[0] < 0)[:limit]
                want[leg] += [(q.query_id, i, round(-s, 9), r) for r, (s, i) in enumerate(first, 1)]
        for leg, search in (("keyword", retrieve.keyword_search), ("vector", retrieve.vector_search)):
            got = search(stored, plans, limit, per_round=per_round).collect()
            assert sorted((r.query_id, r.mem_id, round(r.score, 9), r["rank"]) for r in got) == sorted(
                want[leg])
        assert want["keyword"] and want["vector"]


def test_null_status_is_visible_in_both_legs_and_for_candidates(spark):
    stored, plans = embedded(spark)
    plain = stored.withColumn("status", F.lit(None).cast("string"))
    pairs = plans.select("query_id", "scope_id").join(plain.select("scope_id", "mem_id"), "scope_id")
    named = {(r.query_id, r.mem_id) for r in
             retrieve.score_candidates(pairs, plain, plans).collect()}
    found = {(r.query_id, r.mem_id) for r in retrieve.keyword_search(plain, plans).collect()}
    assert found and found <= named


def test_pivots_leave_groups_out_and_lose_nothing():
    """Questions in tight clusters: most pairs are not scored, the top-k stays exact."""
    import numpy as np
    import pyarrow as pa

    from mnemoframe.operators import scan

    rng = np.random.default_rng(4)
    centres = scan.unit_rows(rng.normal(size=(20, 16)).ravel(), 16)
    asked = scan.unit_rows((np.repeat(centres, 30, 0) + 0.01 * rng.normal(size=(600, 16))).ravel(), 16)
    held = scan.unit_rows((centres[rng.integers(0, 20, 4000)]
                           + 0.3 * rng.normal(size=(4000, 16))).ravel(), 16)
    n = len(asked)
    pack = scan.pack_questions(pa.table({
        "query_id": pa.array(range(n)), "scope_id": pa.array([1] * n),
        "types": pa.array([["memory_claim"]] * n), "show_superseded": pa.array([True] * n),
        "embedding": pa.array(asked.tolist())}))
    work = scan.Scan(pack, 5)
    for at in range(0, len(held), 500):
        part = held[at:at + 500]
        work.batch(pa.RecordBatch.from_pydict({
            "scope_id": pa.array([1] * len(part)),
            "mem_id": pa.array([f"m{i:05d}" for i in range(at, at + len(part))]),
            "mem_type": pa.array(["memory_claim"] * len(part)),
            "status": pa.array([None] * len(part), pa.string()),
            "embedding": pa.array(part.tolist())}))
        work.vector.cut()
    question, score, ids = work.vector.cut()
    every = np.round(asked @ held.T, 9)
    for q in range(0, n, 7):
        best = sorted((-s, f"m{i:05d}") for i, s in enumerate(every[q]) if s > 0)[:5]
        assert [(-s, i) for s, i in zip(score[question == q], ids[question == q])] == best
    assert work.scored < 0.4 * work.possible


def loop(question, hits, links, scores, direct, overlap, s):
    """The published controller, round by round, on collected tables."""
    def conf(pool):
        if not pool:
            return 0.0
        first = order(pool)[0]
        strong = sum(1 for f in pool if scores[f] >= 0.3)
        return max(0.0, min(1.0, 0.5 * scores[first] + 0.5 * min(strong / 3, 1.0)))

    w = s.agentic_entity_overlap_weight

    def final(f):
        return scores[f] + w * overlap.get(f, 0)

    def order(pool):
        if w <= 0:
            return sorted(pool, key=lambda f: (-scores[f], f))
        return sorted(pool, key=lambda f: (-final(f), -int(f.split("#")[1]), f))

    pool, it, c = set(), 0, 0.0
    for it in range(1, s.agentic_max_iterations + 1):
        for concept in hits[: s.agentic_concept_search_limit * it]:
            pool |= {f for f in links.get(concept, ()) if f in scores}
        c = conf(pool)
        if s.agentic_direct_fact_fallback and (
                c < s.agentic_confidence_threshold or len(pool) < 3):
            pool |= set(direct)
            c = conf(pool)
        if c >= s.agentic_confidence_threshold and len(pool) >= 3:
            break
    ranked = order(pool)
    if s.agentic_rerank_keep_ratio > 0 and ranked:
        floor = final(ranked[0]) * s.agentic_rerank_keep_ratio
        ranked = [f for f in ranked if final(f) >= floor]
    return it, round(c, 9), ranked[: min(s.agentic_max_facts, s.agentic_rerank_limit)]


@pytest.mark.parametrize("changes", [
    {}, {"agentic_direct_fact_fallback": False, "agentic_concept_search_limit": 1},
    {"agentic_entity_overlap_weight": 0.1, "agentic_concept_search_limit": 2},
    {"agentic_rerank_keep_ratio": 0.7, "agentic_max_facts": 5}])
def test_agentic_equals_loop(spark, changes):
    s = DEFAULTS.but(**changes)
    stored, plans = embedded(spark)
    concepts = concept_ops.build_concepts(stored)
    edges = groups.materialize(concept_ops.about_entity_edges(stored))
    hits, decision = agentic.agentic_retrieve(stored, concepts, edges, plans, s)
    found = concept_ops.search_concepts(
        concepts, plans, s.agentic_concept_search_limit * s.agentic_max_iterations).collect()
    everything = plans.select("query_id", "scope_id").join(
        stored.select("scope_id", "mem_id"), "scope_id")
    scored = retrieve.score_candidates(everything, stored, plans).collect()
    shared = concept_ops.entity_overlap(everything, edges, plans).collect()
    link_rows = edges.collect()
    kept = hits.orderBy("rank").collect()
    for d in decision.collect():
        q = d.query_id
        scores = {r.mem_id: r.score for r in scored if r.query_id == q}
        links = {}
        for e in link_rows:
            if e.scope_id == d.scope_id:
                links.setdefault(e.dst_id, []).append(e.src_id)
        direct = sorted(scores, key=lambda f: (-scores[f], f))[: s.agentic_max_facts]
        order = [r.concept_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == q]
        overlap = {r.mem_id: r.n_shared for r in shared if r.query_id == q}
        want = loop(q, order, links, scores, direct, overlap, s)
        got = (d.iterations, round(d.confidence, 9), [r.mem_id for r in kept if r.query_id == q])
        assert got == want


def test_reranker_guard(spark):
    stored, plans = embedded(spark)
    hits = groups.materialize(retrieve.flat_retrieve(stored, plans))
    original = {(r.query_id, r.rank): r.mem_id for r in hits.collect() if r["rank"] <= 12}

    def broken(question, candidates, keep):
        raise RuntimeError("down")

    for bad in (broken, lambda q, c, k: None, lambda q, c, k: 7, lambda q, c, k: ["made-up"]):
        got = retrieve.rerank(hits, stored, plans, bad).collect()
        assert {(r.query_id, r.rank): r.mem_id for r in got} == original


def test_provider_payload_shapes(spark):
    texts = ["not json", "[1]", '{"memories": 3}', '{"memories": [1, "x"]}',
             '{"memories": [{"content": "a", "confidence": "high"}]}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(extract.parse_payload(F.col("t")).alias("m")).collect()
    assert [len(r.m) for r in rows] == [0, 0, 0, 0, 1]
    assert rows[-1].m[0].confidence == 0.85 and rows[-1].m[0].kind == "semantic"


def test_cache_keeps_empty_but_not_failed(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("bb",), ("a",), (" ",)], "text string").withColumn(
        "key", cache.cache_key("m", F.lit("v"), F.trim("text")))
    path = str(tmp_path / "cache")
    answer = lambda s: s.map(lambda t: None if t == "bb" else "")
    got = cache.refresh(spark, path, df, "text", answer).collect()
    assert sorted((r.text, r.payload) for r in got if r.text != " ") == [
        ("a", ""), ("a", ""), ("bb", None)]
    assert spark.read.parquet(path).count() == 1


def test_refresh_opens_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "cache")
    texts = spark.range(600).select(F.concat(F.lit("t"), "id").alias("text")).withColumn(
        "key", F.sha2("text", 256))
    def provider(batch):
        return batch.map(lambda t: None if t == "t13" else t.upper())

    first = cache.refresh(spark, path, texts.filter("text < 't5'"), "text", provider)
    assert first.filter("payload is null").count() == 1
    few = texts.filter("text in ('t13', 't20', 't500', 't501')")
    buckets = sorted(r[0] for r in few.select(F.substring("key", 1, 2)).collect())
    read = cache.read_buckets(spark, path, buckets)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and len(buckets) <= 4
    opened = {r[0].split("bucket=")[1][:2] for r in
              read.select(F.input_file_name()).distinct().collect()}
    assert opened <= set(buckets)
    wanted = cache.wanted_texts(few, "text")
    missing = {r.text for r in cache.misses(wanted, read).collect()}
    assert missing == {"t13", "t500", "t501"}  # a failed call is not cached
    words = cache.key_filter(wanted)
    let_through = texts.filter(cache.maybe_in(words, F.col("key"))).count()
    assert 4 <= let_through < 20
    # the same key stored twice counts once, and compaction drops the repeat
    texts.filter("text = 't20'").select("key", F.lit("T20").alias("payload"), F.substring(
        "key", 1, 2).alias("bucket")).write.mode("append").partitionBy("bucket").parquet(path)
    before = spark.read.parquet(path).count()
    got = {r.text: r.payload for r in cache.refresh(spark, path, few, "text", provider).collect()}
    assert got == {"t13": None, "t20": "T20", "t500": "T500", "t501": "T501"}
    assert len(cache.compact(spark, path)) == 1
    assert spark.read.parquet(path).count() == before + 2 - 1
    assert cache.compact(spark, path) == []


def test_provider_calls_are_bounded_retried_and_fail_by_row():
    calls = []

    def provider(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise ValueError("no")
        if len(calls) == 1:
            raise TimeoutError("once")
        return [None if t == "none" else t.upper() for t in texts]

    found, why = hooks.results_of(
        provider, [["a", "b", "none", "c", "bad", "d"]], batch_rows=3, attempts=2)
    assert found == ["A", "B", None, "C", None, "D"]
    assert why == [None, None, "no result", None, "ValueError: no", None]
    assert max(calls) == 3 and calls == [3, 3, 3, 3, 1, 1, 1, 1]
    assert hooks.results_of(lambda t: ["x"], [["a", "b"]], attempts=1)[0] == ["x", "x"]
    assert hooks.results_of(lambda t: [], [["a"]])[1] == ["0 results for 1 rows"]


def test_equal_inputs_are_one_call(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    folder = str(log)

    def provider(texts):
        import os
        import uuid

        for t in texts:
            open(os.path.join(folder, f"{t}-{uuid.uuid4().hex}"), "w").close()
        return [f"{t}!" for t in texts]

    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("a",)], "text string")
    called = hooks.call_once(df, ["text"], provider, "string")
    assert sorted(str(r.payload) for r in called.collect()) == ["None", "a!", "a!", "a!", "b!"]
    called.count()
    assert sorted(f.name[0] for f in log.iterdir()) == ["a", "b"]


def test_exact_mcnemar(spark):
    pairs = [(0, 0), (1, 14), (27, 141), (14, 17), (29, 36), (3, 3), (0, 9)]
    df = spark.createDataFrame(pairs, "b long, c long")
    got = df.select("b", "c", stats.exact_mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
    for r in got:
        n, k = r.b + r.c, min(r.b, r.c)
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2 ** n) if n else 1.0
        assert r.p == pytest.approx(want, rel=1e-9, abs=1e-300)
    big = spark.createDataFrame([(10**9, 10**9 + 10**5)], "b long, c long").select(
        stats.exact_mcnemar(F.col("b"), F.col("c")).alias("p")).first().p
    assert big == pytest.approx(math.erfc((10**5 - 1) / math.sqrt(2 * (2 * 10**9 + 10**5))), rel=1e-2)


def test_chi2_p_and_bootstrap(spark):
    df = spark.createDataFrame([(3.84,), (0.0,)], "x double")
    got = [r.p for r in df.select(stats.chi2_p_value(F.col("x")).alias("p")).collect()]
    assert got == pytest.approx([math.erfc(math.sqrt(1.92)), 1.0])
    pairs = spark.range(2000).select(
        F.col("id").cast("string").alias("question_id"), (F.col("id") % 2).alias("first"),
        F.when(F.col("id") % 10 < 6, 1).otherwise(0).alias("second"))
    row = stats.bootstrap_delta(pairs, replicates=100).first()
    assert row.low < row.delta < row.high and row.high - row.low < 0.2


def test_constraints_and_required(spark):
    rows = spark.createDataFrame(
        [("x", 0.5, "active", "memory_claim"), (None, 2.0, "gone", "other")],
        "content string, confidence double, status string, mem_type string")
    valid, violations = schemas.check_rows(rows, "memories")
    assert valid.count() == 1 and violations.count() == 4
    with pytest.raises(Exception, match="breaks a constraint"):
        schemas.require_rows(rows, "memories").collect()


def test_rules_are_counted_while_the_valid_rows_are_written(spark, tmp_path):
    rows = spark.createDataFrame(
        [("x", 0.5, "active", "memory_claim"), (None, 2.0, "gone", "other"), ("y", None, "gone", None)],
        "content string, confidence double, status string, mem_type string")
    valid, seen = schemas.observed_rows(rows, "memories")
    valid.write.parquet(str(tmp_path / "valid"))
    assert seen.get == {"n_rows": 3, "content_required": 1, "confidence_range": 1,
                        "status_known": 2, "type_known": 1}
    assert [r.content for r in spark.read.parquet(str(tmp_path / "valid")).collect()] == ["x"]
    masks = [r[0] for r in rows.select(schemas.rule_mask("memories")).collect()]
    assert masks == [0, 15, 4]


def test_alias_groups_equal_brute_force(spark):
    stored, _ = embedded(spark, 30)
    concepts = retrieve.with_embedding(
        concept_ops.build_concepts(stored).select("scope_id", "concept_id", "normalized"),
        "normalized").collect()
    parent = {(r.scope_id, r.concept_id): r.concept_id for r in concepts}

    def root(k):
        while parent[k] != k[1]:
            k = (k[0], parent[k])
        return k[1]

    for a in concepts:
        for b in concepts:
            if a.scope_id == b.scope_id and sum(
                    x * y for x, y in zip(a.embedding, b.embedding)) >= 0.92 - 1e-9:
                ra, rb = root((a.scope_id, a.concept_id)), root((b.scope_id, b.concept_id))
                parent[a.scope_id, max(ra, rb)] = min(ra, rb)
    pairs = concept_ops.similar_concepts(concept_ops.build_concepts(stored), block_rows=5)
    got = {(r.scope_id, r.concept_id): r.root for r in concept_ops.merge_groups(pairs).collect()}
    assert got
    assert all(root(k) == v for k, v in got.items())
    grouped = {k for k in parent if any(root(k) == root(o) for o in parent if o != k and o[0] == k[0])}
    assert grouped == set(got)


def test_prefixes_keep_every_close_pair(spark):
    """Random vectors with near copies: every pair above the limit shares a key of both."""
    import numpy as np

    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 12)) * (rng.random((40, 12)) < 0.4)
    near = base[rng.integers(0, 40, 60)] + 0.12 * rng.normal(size=(60, 12)) * (rng.random((60, 12)) < 0.5)
    rows = np.vstack([base, near])
    rows = rows[np.linalg.norm(rows, axis=1) > 0]
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    df = spark.createDataFrame(
        [(1, f"c{i:03d}", [float(x) for x in v]) for i, v in enumerate(rows)],
        "scope_id long, id string, v array<double>")
    prefix = {r.id: r.prefix for r in concept_ops.prefix_keys(df, 0.92).collect()}
    close = [(f"c{i:03d}", f"c{j:03d}") for i in range(len(rows)) for j in range(i)
             if rows[i] @ rows[j] >= 0.92]
    assert len(close) > 20 and all(set(prefix[a]) & set(prefix[b]) for a, b in close)
    assert sum(map(len, prefix.values())) < 0.7 * (rows != 0).sum()


def test_concept_on_every_fact_is_met_in_cells(spark):
    links = spark.range(900).select(
        F.lit(1).alias("scope_id"), F.concat(F.lit("m#"), "id").alias("mem_id"), F.col("id").alias("seq"),
        F.when(F.col("id") % 9 == 0, F.concat(F.lit("c"), F.col("id") % 5)).otherwise("hot")
        .alias("concept_id"))
    asked = spark.createDataFrame(
        [("q1", 1, "hot"), ("q2", 1, "hot"), ("q2", 1, "c3"), ("q3", 2, "hot")],
        "query_id string, scope_id int, concept_id string")
    plain = asked.join(links, ["scope_id", "concept_id"])
    met = concept_ops.meet_links(asked, links, cell_rows=50)
    columns = ["query_id", "concept_id", "mem_id", "seq"]
    assert sorted(met.select(*columns).collect()) == sorted(plain.select(*columns).collect())
    exchanged = met._jdf.queryExecution().toString()
    assert "_cell" in exchanged


def test_store_round_trip_and_fingerprints(spark, tmp_path):
    old = spark.createDataFrame([("r", "a", "done", 1.0)],
                                "run_id string, question_id string, status string, updated_at double")
    new = spark.createDataFrame([("r", "a", 5, 2.0)],
                                "run_id string, question_id string, context_tokens int, updated_at double")
    path = str(tmp_path / "runs")
    store.write_records(store.evolve(old, new), path)
    row = store.current_records(spark.read.parquet(path)).first()
    assert (row.status, row.context_tokens, row.updated_at) == ("done", 5, 2.0)
    stamped = store.stamp(old.select("question_id"), F.lit(datetime(2024, 1, 1))).first()
    assert stamped.created_at == stamped.updated_at == 1704067200.0
    ids = spark.createDataFrame([("b",), ("a",)], "id string")
    want = hashlib.sha256(b"a\nb").hexdigest()
    assert fingerprint.sample_fingerprint(ids, "id", want).first().matches is True
    found = fingerprint.id_set_fingerprint(ids, "id").first().sha256
    again = fingerprint.id_set_fingerprint(ids.repartition(3), "id", found).first()
    assert again.matches and again.n == 2
    file = tmp_path / "f.bin"
    file.write_bytes(b"hello")
    assert fingerprint.file_fingerprints(spark, str(file)).first().sha256 == hashlib.sha256(
        b"hello").hexdigest()


def test_undated_session_keeps_source_order(spark):
    rows = [("s", i, f"x{i}", day, 0, "user", f"t{i}", False)
            for i, day in enumerate(["2023/05/03", "2023/05/01"])]
    turns = "scope_id string, session_pos int, session_id string, session_date string, " \
            "turn_index int, role string, content string, has_answer boolean"
    dated = conversations.observations(spark.createDataFrame(rows, turns)).orderBy("seq")
    assert [r.content for r in dated.collect()] == ["t1", "t0"]
    rows[1] = (*rows[1][:3], "unknown", *rows[1][4:])
    mixed = conversations.observations(spark.createDataFrame(rows, turns)).orderBy("seq")
    assert [r.content for r in mixed.collect()] == ["t0", "t1"]


def test_strategies_follow_the_settings(spark):
    stored, plans = embedded(spark)
    stored, plans = groups.materialize(stored), groups.materialize(plans)
    relations = groups.materialize(extract.provenance_edges(
        stored.withColumn("obs_id", F.concat(F.lit("memory_observation#"), "seq"))
    ).unionByName(concept_ops.about_entity_edges(stored)))

    def run(reranker=None, **changes):
        return strategies.answer_questions(
            stored, plans, relations, DEFAULTS.but(**changes), reranker)

    n = plans.count()
    whole = run()
    assert whole.results.filter("not is_fallback").count() == n
    assert whole.evaluations.count() == whole.answers.count() > 0
    assert run(enable_answer_generation=False).answers.count() == 0
    silent = run(enable_memory_evaluation=False)
    assert silent.evaluations.count() == 0 and silent.answers.count() == whole.answers.count()
    assert run(enable_fallback_retrieval=False).results.filter("is_fallback").count() == 0
    backwards = lambda q, c, k: [i for i, _ in c][::-1]
    order = lambda x: {(r.query_id, r["rank"]): r.mem_id for r in x.hits.collect()}
    assert order(run(backwards)) == order(whole)
    kept = order(run(backwards, enable_rerank=True, rerank_keep=2))
    last = {q: max(r for p, r in order(whole) if p == q) for q, _ in order(whole)}
    assert kept == {(q, r): order(whole)[q, end - r + 1] for q, end in last.items()
                    for r in (1, 2) if end - r + 1 > 0}
    agentic_hits = run(retrieval_strategy="agentic").hits
    expected, _ = agentic.agentic_retrieve(stored, concept_ops.build_concepts(stored), relations, plans)
    rows = lambda df: sorted((r.query_id, r["rank"], r.mem_id) for r in df.collect())
    assert rows(agentic_hits) == rows(expected)
    with pytest.raises(ValueError):
        run(retrieval_strategy="guess")
    asked = plans.select("query_id", "scope_id", "question")
    assert retrieve.plan_retrieval(asked, DEFAULTS.but(enable_retrieval_planning=False)).count() == 0


def test_cut_context_by_deleting_the_middle(spark):
    rng = random.Random(5)
    texts = ["", "x" * 50, "\n" * 30, *("\n".join("y" * rng.randint(0, 12) for _ in range(k))
                                        for k in range(1, 30)), "\n".join(["z"] * 3000)]

    def cut(text, limit):
        lines, n = text.split("\n"), len(text.split("\n"))
        while lines and len("\n".join(lines)) // 4 > limit:
            del lines[len(lines) // 2]
        return "\n".join(lines), len(lines)

    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for limit in (0, 3, 10):
        for r in answer.cut_context(df, "text", limit).collect():
            assert (r.cut_text, r.kept_lines) == cut(r.text, limit), (r.i, limit)


def test_evaluated_records_keep_every_question(spark):
    questions = spark.createDataFrame(
        [("a", "t", False), ("b", "t", True), ("c", "u", False)],
        "query_id string, question_type string, is_abstention boolean")
    scores = spark.createDataFrame(
        [("a", 1.0, True, 1.0, True), ("c", 0.5, False, 1.0, True)], "query_id string, turn_recall double, "
        "turn_hit boolean, session_recall double, session_hit boolean")
    contexts = spark.createDataFrame([("a", "x" * 9), ("b", "")], "query_id string, context string")
    read = spark.createDataFrame(
        [("a", "h", "Yes.", 5, 6), ("b", "h", None, 7, None)], "query_id string, hypothesis string, "
        "judge_text string, reader_total_tokens long, judge_total_tokens long")
    rows = {r.question_id: r for r in runs.evaluated_records(
        "r", questions, scores, contexts, read).collect()}
    assert [(rows[k].status, rows[k].judge_correct, rows[k].context_tokens) for k in "abc"] == [
        ("done", True, 2), ("done", None, 0), ("error", None, None)]
    report = runs.metrics(runs.evaluated_records("r", questions, scores, contexts, read)).first()
    assert (report.n_questions, report.n_judged, report.overall_accuracy, report.n_errors,
            report.turn_recall, report.reader_total_tokens) == (2, 1, 1.0, 1, 1.0, 12)


def test_alias_search_broadcasts_no_vectors(spark, monkeypatch):
    """Rows with vectors look small to Spark; none of them may pass through the driver."""
    plans, keep = [], concept_ops.materialize

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(concept_ops, "materialize", watched)
    found = spark.createDataFrame(
        [(1, f"c{i}", f"alpha beta w{i % 7}") for i in range(40)],
        "scope_id long, concept_id string, normalized string")
    pairs = concept_ops.similar_concepts(found)
    plans.append(pairs._jdf.queryExecution().executedPlan().toString())
    concept_ops.merge_groups(pairs)
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)


def test_named_concepts_are_those_of_cleaning_every_name(spark):
    """Against the plain form: every phrase and keyword cleaned, then the first of each form."""
    from mnemoframe import constants as C
    from mnemoframe.functions import concepts as N
    from mnemoframe.functions.text import extract_keywords, first_distinct, normalize, unicode_pattern

    texts = ["The Acme Corp. met Acme corp in Berlin", "so then THE", "", None, "x y", "A-B & C_D 'Q.'",
             "\u0130stanbul \u03a3\u039f\u03a3 caf\u00e9 Zo\u00eb", "Also Bob's [Data] Team, bob's data", "___ a_b _x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    body = F.coalesce("t", F.lit(""))
    leads = "|".join(C.SENTENCE_LEADS)
    phrases = F.transform(
        F.regexp_extract_all(body, F.lit(unicode_pattern(C.CAPITALISED_PHRASE)), 1),
        lambda p: F.regexp_replace(
            F.regexp_replace(p, unicode_pattern(r"\s+"), " "), rf"^(?i)(?:(?:{leads})(?: |$))+", ""))
    names = F.filter(F.transform(F.concat(phrases, extract_keywords(body)), N._clean),
                     lambda n: (F.length(n) >= 2) & (normalize(n) != ""))
    plain = F.slice(first_distinct(names, normalize), 1, 6)
    rows = df.select(plain.alias("want"), N.deterministic_concepts(F.col("t")).alias("got"),
                     N.named_concepts(F.col("t")).alias("both"),
                     F.transform(plain, normalize).alias("normal")).collect()
    for r in rows:
        assert r.got == r.want and [n.normalized for n in r.both] == r.normal
    assert any(len(r.want) > 2 for r in rows)
