import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import FOLDER
from messy import ROWS, documents
from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemoframe.llm import quality, toxicity
from mnemoframe.llm.catalog import load


def test_measures_do_not_depend_on_neighbours():
    texts = [r[1] for r in ROWS]
    together = quality.measures(pa.array(texts, pa.string()))
    alone = np.concatenate([quality.measures(pa.array([t], pa.string())) for t in texts])
    assert together.shape == (len(texts), len(quality.MEASURES))
    assert np.allclose(together, alone) and np.isfinite(together).all()


def test_repetition_measures_by_brute_force():
    text = "a b a b c a b a b d d d"
    words = text.split()
    x = dict(zip(quality.MEASURES, quality.measures(pa.array([text]))[0]))
    runs = [tuple(words[i:i + 2]) for i in range(len(words) - 1)]
    assert x["distinct"] == pytest.approx(len(set(words)) / len(words))
    assert x["distinct_2"] == pytest.approx(len(set(runs)) / len(runs))
    assert x["adjacent"] == pytest.approx(2 / 12) and x["top_word"] == pytest.approx(4 / 12)


def test_ranking_orders_pairs_and_cuts_at_the_quantile():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, len(quality.MEASURES)))
    good = x[:, 3] + 0.1 * rng.normal(size=600) > -0.8
    model = quality.learn(x, good)
    raw = model.raw(x)
    wins = (raw[good][:, None] > raw[~good][None, :]).mean()
    assert wins > 0.98
    share = (model.score(x) < 0.3).mean()
    assert share == pytest.approx((~good).mean(), abs=0.01)


def test_held_out_rows_by_crc(spark):
    rows = spark.range(200).select("id", quality.held_out(F.col("id"), 5, 0).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def grams(text):
    padded = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in f" {text.lower()} ")
    for size in toxicity.SIZES:
        for i in range(len(padded) - size + 1):
            gram = padded[i:i + size]
            if " " not in gram[1:-1]:
                yield gram


def test_ngrams_by_brute_force():
    texts = ["", "Idiot!", "an ñandú, IDIOT", "a", "xx yy", None]
    seen = {}
    for _, n, rows, places, times in toxicity._pairs(pa.array(texts)):
        for r, p, t in zip(rows.tolist(), places.tolist(), times.tolist()):
            seen[r, p] = t
    names = {}
    for i, t in enumerate(texts):
        own = list(grams(t or ""))
        for g in own:
            where = {p for r, p in seen if r == i}
            names.setdefault(g, where)
            names[g] = names[g] & where
        assert sum(v for (r, _), v in seen.items() if r == i) == len(own)
    assert all(len(v) >= 1 for v in names.values())


def test_toxic_words_are_learned(spark):
    rng = random.Random(2)
    plain = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(80)]
    rows, labels = [], []
    for i in range(500):
        words = rng.choices(plain, k=30)
        bad = i % 5 == 0
        if bad:
            words[7] = "grumpf" + rng.choice("abc")
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks, F.col("doc_id") < 400)
    score = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((score[i] >= 0.5) == (i % 5 == 0) for i in range(400, 500))


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_messy_tables(spark, module, label):
    docs = documents(spark)
    marks = spark.createDataFrame(
        [(1, 1), (2, 0), (2, 1), (5, 1), (6, 0), (7, None), (None, 1), (99, 1), (8, 0), (8, 0)],
        f"doc_id long, {label} int")
    for given in (marks, marks.limit(0)):
        model = module.train(quality.narrow(docs), given, F.lit(True), label)
        rows = module.score(docs, model).collect()
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
        assert all(0 <= r["score"] <= 1 for r in rows)
    assert module.score(documents(spark, rows=[]), model).count() == 0


def test_kept_rows_are_those_of_the_scores(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.train(quality.narrow(docs), labels, F.lit(True))
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns
    good = {r["doc_id"] for r in quality.score(docs, model).filter("score >= 0.3").collect()}
    assert {r["doc_id"] for r in kept.collect()} == good


@pytest.mark.parametrize("name, label, modulus, remainder, least", [
    ("op4_quality", "quality", 5, 0, 0.97), ("op6_toxicity", "toxic", 3, 1, 0.95)])
def test_held_out_accuracy(spark, name, label, modulus, remainder, least):
    folder = FOLDER.replace("sf0.001", "sf0.1")
    rows = load()[name].run(spark, folder).join(
        spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder for r in rows)
    assert np.mean([r["predicted"] == r[label] for r in rows]) > least


def test_ranking_ignores_the_order_of_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    models = [quality.train(d, labels, F.lit(True)) for d in (
        docs.coalesce(1).orderBy("doc_id"), docs.repartition(5, F.xxhash64("text")))]
    assert (models[0].weights == models[1].weights).all()
    assert models[0].threshold == models[1].threshold


def test_every_label_is_learned_from(spark):
    """More labels than the 20,000 that training once stopped at, against the arrays at hand."""
    n = 21_000
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"), F.concat_ws(
            " ", F.lit("word"), F.col("id") % 7, F.when(F.col("id") % 3 == 0, "SPAM!! $$$"),
            F.repeat(F.lit("text here, "), (F.col("id") % 11).cast("int"))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    model = quality.train(docs, labels, F.lit(True))
    rows = docs.orderBy("doc_id").toArrow()
    x = quality.measures(rows["text"].combine_chunks())
    whole = quality.learn(x, rows["doc_id"].to_numpy() % 3 > 0)
    assert (model.edges == whole.edges).all() and (model.weights == whole.weights).all()
    assert model.threshold == whole.threshold
    turns, _ = quality._turns(14_000, 7_000)
    assert turns * 14_000 >= quality.MIN_PAIRS and quality._turns(10**6, 10**5)[0] == 1


def test_no_label_is_left_out_by_its_hash(spark):
    """The only bad texts are those whose ids hash last: once they were never seen."""
    n = 20_200
    ids = spark.range(n).select(
        F.col("id").alias("doc_id"), F.row_number().over(
            Window.orderBy(F.xxhash64("id"), "id")).alias("place")).localCheckpoint()
    bad = F.col("place") > 20_000
    docs = ids.select("doc_id", F.when(bad, "$$$ !!! $$$").otherwise("a plain text").alias("text"))
    labels = ids.select("doc_id", F.when(bad, 0).otherwise(1).alias("quality"))
    model = quality.train(docs, labels, F.lit(True))
    worst = quality.score(docs, model).join(ids, "doc_id").groupBy(bad.alias("bad")).agg(
        F.min("score").alias("low"), F.max("score").alias("high")).collect()
    found = {r["bad"]: r for r in worst}
    assert found[True]["high"] < found[False]["low"]
