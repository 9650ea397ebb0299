import random
import re
from collections import Counter

import pytest
from conftest import FOLDER
from messy import ROWS, documents

import corpus_pipeline
from mnemoframe.llm import mixing
from mnemoframe.llm.catalog import load


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == pytest.approx(
        {"a": 187.5, "b": 75, "c": 37.5})
    # a stops at three times its size, the rest goes by weight
    got = mixing.targets({"b": 500, "a": 10, None: 90})
    assert got == pytest.approx({"a": 30, "b": 570 * 2 / 3, None: 570 / 3})
    assert mixing.targets({"a": 0, "b": 0}) == {"a": 0, "b": 0}
    assert mixing.targets({}) == {}


def test_fit_by_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        lengths = sorted(rng.sample(range(0, 40), rng.randint(1, 6)))
        counts = [rng.randint(1, 4) for _ in lengths]
        budget = rng.randint(0, sum(n * c for n, c in zip(lengths, counts)) + 5)
        take = mixing.fit(budget, lengths, counts)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        got = sum(n * t for n, t in zip(lengths, take))
        assert abs(got - budget) == min(abs(s - budget) for s in sums)
    many = list(range(1, 3000))
    assert sum(n * t for n, t in zip(many, mixing.fit(2_000_001, many, [3] * len(many)))) == 2_000_001


def test_knapsack_by_brute_force():
    rng = random.Random(5)
    for _ in range(100):
        lengths, counts = rng.sample(range(1, 30), 4), [rng.randint(1, 4) for _ in range(4)]
        budget = rng.randint(0, 150)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        take = mixing._closest(budget, lengths, counts)
        got = sum(n * k for n, k in take.items())
        assert abs(got - budget) == min(abs(s - budget) for s in sums)
        assert all(take.get(n, 0) <= c for n, c in zip(lengths, counts))


def test_mix_of_the_documents(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    first = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert first.keys() == texts.keys()
    words, taken, target = Counter(), Counter(), {}
    for i, r in first.items():
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[i] or ""))
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        words[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(r["source_size"] == words[r["source"]] for r in first.values())
    assert target == pytest.approx(mixing.targets(dict(words)))
    for source, want in target.items():
        whole = int(want // words[source])
        rest, sums = round(want - whole * words[source]), {0}
        for r in first.values():
            if r["source"] == source:
                sums |= {s + r["size"] for s in sums}
        nearest = min(abs(s - rest) for s in sums)
        assert abs(taken[source] - whole * words[source] - rest) == nearest
    # reruns agree, also when lengths are dealt to many buckets
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {i: r["taken"] for i, r in first.items()}


def test_messy_table(spark):
    docs = documents(spark)
    rows = mixing.mix(docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    assert {r["source"] for r in rows} == {"s1", "s2", "s3", "", None}
    out = mixing.mixed_rows(docs)
    assert out.columns == [*docs.columns, "_copy"]
    assert out.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(documents(spark, rows=[])).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {r["doc_id"] for r in docs.collect()}
    frame = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, FOLDER)
        if k < 4:
            assert frame.columns == docs.columns
            after = {r["doc_id"] for r in frame.collect()}
            assert after <= before
            before = after
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows} <= before
    assert Counter(r["doc_id"] for r in rows) == Counter(
        r["doc_id"] for r in frame.collect())


def test_pipeline_on_a_messy_table(spark, tmp_path):
    docs = documents(spark, tmp_path / "documents.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, "seven wizards box")], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "_copy"]


def test_registered_queries_have_their_names():
    names = [n for n in load() if n != "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
