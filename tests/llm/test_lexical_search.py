import math
import random
import re
from collections import Counter

import numpy as np
from messy import LONG, ROWS, documents

from mnemoframe.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=10):
    """Every document scored for every item."""
    counted = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    n_docs = sum(1 for _, c in counted if c)
    total = sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in counted:
            score = 0
            for t in terms(text):
                if c[t]:
                    m = 25 + (75 * c.total() * n_docs) // total
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, null, doc_id) in enumerate(sorted(scored)[:k], 1):
            out.append((item_id, rank, None if null else doc_id, -score))
    return sorted(map(str, out))


def items_table(spark, items):
    return spark.createDataFrame(
        [(*i, "x", "y") for i in items], "item_id long, text string, score string, block string")


def test_graphs_sum_exactly_the_terms_of_their_items():
    rng = random.Random(2)
    for part_terms in (3, 8, 64):
        items = [Counter(rng.choices([b"%d" % i for i in range(25)], k=rng.randrange(40)))
                 for _ in range(60)]
        graph = lexical_search.mine(items, part_terms)
        value = [Counter({t: n}) for t, n in zip(graph.leaf, graph.times)]
        for a, b in zip(graph.left, graph.right):
            value.append(value[a] + value[b])
        for item, nodes in zip(items, graph.sums):
            assert sum((value[x] for x in nodes), Counter()) == item
        plain = sum(max(0, len(i) - 1) for i in items)
        shared = len(graph.left) + sum(max(0, len(s) - 1) for s in graph.sums)
        assert shared < 0.8 * plain


def test_a_node_is_summed_once_for_all_its_items():
    shared = Counter([b"a", b"b", b"c", b"d"])
    graph = lexical_search.mine([shared + Counter([b"%d" % i]) for i in range(9)])
    assert len(graph.left) == 3 and all(len(s) == 2 for s in graph.sums)


def test_messy_tables_equal_brute_force(spark, tmp_path):
    rng = random.Random(11)
    words = [f"W{i}" for i in range(40)] + ["Été", "ñ", "été", "x²"]
    more = [(i, " ".join(rng.choices(words, k=rng.randrange(30)))) for i in range(50, 120)]
    rows = [*ROWS, *[(*r, "en", "s") for r in more], (60, more[20][1], None, None)]
    items = [
        (1, "w1 W2, w3. w1"), (2, "été ÉTÉ ñ W4"), (3, None), (4, ""), (5, "zzz unknown"), (1, "w5 w6"),
        (None, "w7 w8 dolor"), (6, "abc"), (7, "lorem lorem amet end"), (8, "w1 w2 w3 w4 w5 w6"),
        (9, " ".join(words)), (9, " ".join(words)), (10, "the quick brown fox jumps " * 40), (11, "!?")]
    docs = documents(spark, tmp_path / "d", rows)
    got = lexical_search.search(docs, items_table(spark, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    pairs = [(r[0], r[1]) for r in rows]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(pairs, items)
    three = lexical_search.search(docs, items_table(spark, items), k=3)
    assert sorted(str(tuple(r)) for r in three.collect()) == brute(pairs, items, 3)


def test_many_blocks_and_rounds_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=25)), "en", "s") for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=6))) for i in range(80)]
    want = brute([(r[0], r[1]) for r in rows], items)
    docs = documents(spark, rows=rows)
    monkeypatch.setattr(lexical_search, "MINE_BYTES", 300)
    monkeypatch.setattr(lexical_search, "SCAN_BYTES", 400)
    got = lexical_search.search(docs, items_table(spark, items)).collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_empty_tables(spark):
    docs = documents(spark, rows=[])
    assert lexical_search.search(docs, items_table(spark, [(1, "a")])).count() == 0
    assert lexical_search.search(documents(spark), items_table(spark, [])).count() == 0


def test_terms_that_chunks_cut_stay_whole(monkeypatch):
    text = (LONG[:5000] + "ÉÀ" * 700 + " A_b-C é²").encode()
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(lexical_search, "CHUNK_BYTES", size)
        got = lexical_search.term_counts(text)
        assert got == Counter(t.encode() for t in terms(text.decode()))


def test_best_keeps_ties_by_id():
    best = lexical_search.Best(2)
    for ids, scores in [([9, 4], [5, 5]), ([1, 7], [5, 0]), ([8], [6])]:
        best.add(np.array(scores), np.array(ids), np.zeros(len(ids), bool))
    assert best.doc.tolist() == [8, 1] and best.score.tolist() == [6, 5]
