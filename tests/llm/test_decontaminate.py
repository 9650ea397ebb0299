import random

import pyarrow as pa
import pytest
from conftest import FOLDER
from messy import documents

from mnemoframe.llm import decontaminate as D


def distance(item, text):
    """Fewest edits to any stretch of the text, by the table."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before)


def normal(text):
    return " ".join("".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " "
                            for c in (text or "").lower()).split())


def test_edits_by_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        item = "".join(rng.choices("abc", k=rng.randint(1, 14)))
        text = "".join(rng.choices("abc", k=rng.randint(0, 25)))
        want = distance(item, text)
        limit = rng.randint(0, 8)
        assert D.edits_within(item, text, limit) == min(want, limit + 1)
        assert want > limit or len(item) < D.GRAM or D._may_hold(item, text, limit)


def items(n=60, seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    return rng, vocabulary, [" ".join(rng.choices(vocabulary, k=rng.randint(12, 60))) for _ in range(n)]


@pytest.mark.parametrize("by_words, ratio", [(True, 0.1), (False, 0.05)])
def test_recall_against_brute_force(by_words, ratio):
    import numpy as np
    rng, vocabulary, texts = items(200)
    index = D.build_index(list(range(len(texts))), texts)
    noise = np.random.default_rng(3)
    docs = []
    for t in texts:
        around = [" ".join(rng.choices(vocabulary, k=80)) for _ in range(2)]
        docs.append(f"{around[0]} {D._edited(t, ratio, by_words, noise)} {around[1]}")
    within = {(i, i) for i, d in enumerate(docs)
              if D.edits_within(normal(texts[i]), normal(d), index.limits[i]) <= index.limits[i]}
    found = {(row, item) for row, item, _ in D.contaminated(index, pa.array(docs))}
    assert len(within) > 150 and len(found & within) >= 0.95 * len(within)
    for row, item in found:
        assert distance(normal(texts[item]), normal(docs[row])) <= index.limits[item]


@pytest.mark.parametrize("ratio", [0.1, 0.14])
def test_recall_on_characters_edited_up_to_the_limit(ratio):
    import numpy as np
    rng, vocabulary, texts = items(200, seed=5)
    index = D.build_index(list(range(len(texts))), texts)
    noise = np.random.default_rng(6)
    docs = [" ".join([*rng.choices(vocabulary, k=40), D._edited(t, ratio, False, noise),
                      *rng.choices(vocabulary, k=40)]) for t in texts]
    within = {(i, i) for i, d in enumerate(docs)
              if D.edits_within(normal(texts[i]), normal(d), index.limits[i]) <= index.limits[i]}
    found = {(row, item) for row, item, _ in D.contaminated(index, pa.array(docs))}
    assert len(within) > 150 and len(found & within) >= 0.93 * len(within)


def test_verbatim_passages_are_all_found_and_nothing_else(spark):
    folder = FOLDER.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    passages = {r["item_id"]: f" {normal(r['text'])} " for r in benchmark.collect()}
    want = set()
    for r in docs.collect():
        text = f" {normal(r['text'])} "
        want |= {(r["doc_id"], i) for i, p in passages.items() if p in text}
    rows = D.find(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["edits"] == 0} == want
    assert all(r["edits"] <= 0.15 * r["item_chars"] for r in rows)
    gone = {r["doc_id"] for r in rows}
    kept = {r["doc_id"] for r in D.clean_rows(docs, benchmark).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - gone


def test_blocks_of_items_and_messy_tables(spark):
    _, _, texts = items(12)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    rows += [(50, None, "x"), (51, "", "x"), (None, "quick brown fox", "x"), (52, "QUICK  brown", "x"),
             (52, "quick brown", "x"), (53, "never there", "x"), (54, texts[3], "x")]
    benchmark = spark.createDataFrame(rows, "item_id long, text string, doc_id string")
    docs = documents(spark, rows=[
        (100, f"before {texts[3].upper()}, after", "", ""), (101, texts[5], "", ""), (None, texts[6], "", ""),
        (102, "the quick, brown fox", "", ""), (103, None, "", ""), (104, "", "", ""),
        (101, texts[5], "", ""), (105, ("noise " * 50_000) + texts[7], "", ""), (106, "quick", "", "")])
    want = sorted(map(str, [(100, 3, 0), (100, 54, 0), (101, 5, 0), (101, 5, 0), (None, 6, 0),
                            (102, None, 0), (102, 52, 0), (102, 52, 0), (105, 7, 0)]))
    for size in (D.MAX_INDEX_BYTES, 900):
        found = D.find(docs, benchmark, max_index_bytes=size).collect()
        assert sorted(str((r["doc_id"], r["item_id"], r["edits"])) for r in found) == want
    kept = D.clean_rows(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["103", "104", "106"]
    assert D.find(docs, benchmark.limit(0)).count() == 0
    assert D.clean_rows(docs, benchmark.limit(0)).count() == 9
    assert D.find(documents(spark, rows=[]), benchmark).count() == 0


def test_runs_in_step_lose_nothing():
    rng = random.Random(5)
    for _ in range(300):
        letters = rng.choice(["ab", "abcdefgh"])
        item = "".join(rng.choices(letters, k=rng.randint(5, 90)))
        copy = list(item)
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(copy))
            copy[at:at + rng.randint(0, 1)] = rng.choices(letters, k=rng.randint(0, 1))
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)) + copy + rng.choices(letters, k=9))
        limit = rng.randint(0, 8)
        if distance(item, text) <= limit:
            assert D._in_step(D._grams(D._points(item)), D._grams(D._points(text)), limit)


def test_a_passage_is_measured_once_and_other_text_of_its_words_is_not(monkeypatch):
    """Many walks meet at a copy; all of their windows are one."""
    import numpy as np
    rng, vocabulary, texts = items(40)
    noise = np.random.default_rng(3)
    docs = [f"{' '.join(rng.choices(vocabulary, k=300))} {D._edited(t, 0.05, True, noise)}" for t in texts]
    index = D.build_index(list(range(len(texts))), texts)
    calls = []
    measure = D.edits_within
    monkeypatch.setattr(D, "edits_within", lambda *given: calls.append(1) or measure(*given))
    found = list(D.contaminated(index, pa.array(docs)))
    assert len(found) >= 36 and len(calls) <= len(found) + 4
