"""Keyed-state reconciliation: any order of arrival gives what the batch operator gives."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from mnemoframe.operators import enrich, extract, groups, reconcile
from mnemoframe.settings import DEFAULTS
from mnemoframe.streaming import ingest
from mnemoframe.streaming.reconcile import Reconciler, current_records, start_reconcile

WORDS = ["red", "blue", "green", "tea", "now", "ship", "oak"]


class State:
    """Value and map state in memory, counting what is read."""

    def __init__(self):
        self.rows, self.reads = {}, 0

    def iterator(self):
        self.reads += len(self.rows)
        return iter(list(self.rows.items()))

    def getValue(self, key):
        self.reads += 1
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        self.rows.pop(key, None)

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows[()]

    def update(self, value):
        self.rows[()] = value


class Handle:
    def __init__(self):
        self.states = {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, State())

    getValueState = getMapState


def processor(settings=DEFAULTS):
    handle = Handle()
    work = Reconciler(settings, "long")
    work.init(handle)
    return work, handle.states


def memory(seq, text):
    tokens = text.split()
    return Row(seq=seq, mem_id=f"memory_claim#{seq}", sig=text, tokens=sorted(set(tokens)),
               replaces="now" in tokens, action=None, asked=None)


def asked(seq, at, action):
    return Row(seq=seq, mem_id=f"memory_claim#{seq}", sig=None, tokens=None, replaces=None,
               action=action, asked=at)


def expected(texts, requests, settings):
    """Status of every memory from all rows at once."""
    out = {}
    for j, old in texts.items():
        killer = None
        for i in sorted(texts):
            if i > j and killer is None:
                new, a, b = texts[i], set(texts[i].split()), set(old.split())
                if new == old:
                    hit = settings.enable_consolidation
                    status, confidence = "archived", 0.9
                else:
                    overlap = len(a & b) / min(len(a), len(b))
                    hit = settings.enable_contradiction_detection and overlap >= 0.4
                    confidence = min(1.0, 0.7 + overlap / 5)
                    sure = confidence >= settings.contradiction_confidence_threshold
                    status = "superseded" if sure and "now" in a else "needs_review"
                if hit:
                    killer = i, status
        own = sorted((at, action) for seq, at, action in requests if seq == j)
        status = "active"
        if killer and (not own or killer[0] < own[0][0]):
            status = killer[1]
        if own:
            status = {"forget": "deleted", "archive": "archived"}[own[-1][1]]
        out[j] = status
    return out


@pytest.mark.parametrize("settings", [
    DEFAULTS, DEFAULTS.but(enable_consolidation=False),
    DEFAULTS.but(enable_contradiction_detection=False),
    DEFAULTS.but(contradiction_confidence_threshold=0.9)])
def test_any_order_equals_all_at_once(settings):
    rng = random.Random(21)
    for _ in range(400):
        n = rng.randrange(1, 14)
        texts = {2 * k: " ".join(["box", "lid", *rng.choices(WORDS, k=rng.randrange(5))])
                 for k in range(1, n + 1)}
        requests = [(s, at, rng.choice(["forget", "archive"]))
                    for s, at in {(rng.choice(list(texts)), 2 * rng.randrange(1, n + 2) + 1)
                                  for _ in range(rng.randrange(4))} if at > s]
        rows = [memory(*r) for r in texts.items()]
        rng.shuffle(rows)
        left = [asked(*r) for r in requests]
        work, _ = processor(settings)
        last = {}
        while rows or left:
            take = rng.randrange(1, 5)
            batch, rows = rows[:take], rows[take:]
            known = set(texts) - {r.seq for r in rows}
            ready = [r for r in left if r.seq in known and (not rows or rng.random() < 0.5)]
            left = [r for r in left if r not in ready]
            batch = batch + ready + ([memory(2, texts[2])] if 2 in known else [])  # comes again
            for event in work.handleInputRows(("s", "memory_claim", "s:box lid"), iter(batch), None):
                if event.seq not in last or event.version > last[event.seq].version:
                    last[event.seq] = event
        assert {k: e.status for k, e in last.items()} == expected(texts, requests, settings)


def test_rows_in_order_read_open_memories_only():
    """With a hot subject whose memories replace one another, a batch reads one row."""
    work, states = processor()
    reads = []
    for k in range(200):
        before = sum(s.reads for s in states.values())
        list(work.handleInputRows(
            (1, "memory_claim", "s:box lid"), iter([memory(k, f"box lid w{k}")]), None))
        reads.append(sum(s.reads for s in states.values()) - before)
    assert max(reads) <= 2 and len(states["settled"].rows) == 199


def test_streams_equal_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(scope, 2 * k, f"memory_claim#{2 * k}", "memory_claim",
             rng.choice(["", "box lid ", "box lid ", "cat tail "]) + " ".join(
                 rng.choices(WORDS, k=rng.randrange(4))))
            for scope in range(4) for k in range(1, 16)]
    memories = spark.createDataFrame(
        rows, "scope_id long, seq long, mem_id string, mem_type string, content string")
    requests = spark.createDataFrame(
        [(s, f"memory_claim#{2 * k}", rng.choice(["forget", "archive"]), 2 * k + 2 * rng.randrange(6) - 1)
         for s in range(4) for k in (2, 5, 9)] + [(9, "memory_claim#2", "forget", 50)],
        "scope_id long, mem_id string, action string, seq long")
    memories, requests = groups.materialize(memories), groups.materialize(requests)
    place = F.pmod(F.xxhash64("scope_id", "mem_id"), F.lit(3))  # no order at all
    for i in range(3):
        streams = []
        for name, rows_in in (("m", memories), ("r", requests)):
            rows_in.filter(place == (i if name == "m" else (i + 1) % 3)).write.mode(
                "append").parquet(str(tmp_path / name))
            streams.append(ingest.read_stream(spark, str(tmp_path / name), rows_in.schema))
        start_reconcile(*streams, str(tmp_path / "out")).awaitTermination()
    got = current_records(spark.read.parquet(str(tmp_path / "out/events")))
    changes = reconcile.reconcile(memories, requests=requests)
    want = reconcile.with_status(memories.withColumn("status", F.lit("active")), changes, requests)
    key = ["scope_id", "mem_id", "status"]
    assert sorted(got.select(*key).collect()) == sorted(want.select(*key).collect())
    change = ["scope_id", F.col("seq").alias("older_seq"), "newer_seq", "kind", "confidence", "rel"]
    wanted = changes.select("scope_id", "older_seq", "newer_seq", "kind", "confidence", "rel")
    assert sorted(got.filter("newer_seq is not null").select(*change).collect()) == sorted(
        wanted.collect())
    assert len({r.status for r in got.collect()}) >= 4


TEXTS = ["  we met yesterday about $5k\n", "Always pay 20% by 2024-02-03", "", "   ", None,
         "Tokyo Fund target is $3M-$5M, last month", "three days ago it had 40 customers "]


def observed_texts(spark, texts):
    return spark.createDataFrame(
        [(i % 2, i, f"memory_observation#{i}", t) for i, t in enumerate(texts)],
        "scope_id long, seq long, obs_id string, content string").withColumns({
            "actor": F.lit("user"), "source": F.lit("chat"),
            "occurred_at": F.lit("2024-03-05 10:00:00").cast("timestamp"),
            "observed_at": F.lit("2024-03-06 10:00:00").cast("timestamp")})


@pytest.mark.parametrize("settings", [
    DEFAULTS, DEFAULTS.but(enable_episodic_memory=False),
    DEFAULTS.but(extraction_confidence_threshold=0.9)])
def test_mentions_of_a_row_equal_mentions_of_its_memories(spark, settings):
    observed = groups.materialize(observed_texts(spark, TEXTS))
    memories = extract.extract_memories(observed, settings)
    for find in (enrich.temporal_refs, enrich.quantities):
        apart = find(observed, memories).collect()
        together = find(observed, extraction=settings).collect()
        assert sorted(map(str, together)) == sorted(map(str, apart)) and together


def test_a_batch_played_again_changes_nothing(spark, tmp_path):
    observed = groups.materialize(observed_texts(spark, TEXTS * 3))
    sink = ingest.IngestSink(str(tmp_path / "out"))
    parts = [observed.filter(F.col("seq") % 3 == k) for k in range(3)]
    for k, part in [*enumerate(parts), (1, parts[1]), (2, parts[2])]:
        sink.take(part, k)
    memories = extract.extract_memories(observed)
    want = {
        "memories": memories, "provenance": extract.provenance_edges(memories),
        "temporal_refs": enrich.temporal_refs(observed, memories),
        "quantities": enrich.quantities(observed, memories)}
    for name, rows in want.items():
        got = sink.table(spark, name)
        assert {r.batch_id for r in got.select("batch_id").distinct().collect()} == {0, 1, 2}
        assert sorted(map(str, got.drop("batch_id").collect())) == sorted(map(str, rows.collect()))
