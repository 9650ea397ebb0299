import hashlib
import random
import re
import time
import zlib

import pytest
from messy import ROWS, documents

from mnemoframe.llm import periodic


def brute(ids, min_length=6, min_exponent=4):
    """All runs by trying every period at every place."""
    out, n = [], len(ids)
    for q in range(1, n // min_exponent + 1):
        i = q
        while i < n:
            first = i
            while i < n and ids[i] == ids[i - q]:
                i += 1
            start = first - q
            if i - start >= max(min_length, min_exponent * q) and all(
                    ids[start:i - r] != ids[start + r:i] for r in range(1, q)):
                out.append((start, i - start, q))
            i += 1
    return sorted(out)


def test_runs_equal_brute_force():
    rng = random.Random(13)
    total = 0
    for _ in range(6_000):
        k = rng.choice([1, 2, 3, 4])
        ids = []
        for _ in range(rng.randrange(1, 5)):
            base = [rng.randrange(k) for _ in range(rng.randrange(1, 9))]
            if rng.random() < 0.4:  # runs inside the periods of a longer run
                base = base * rng.randrange(1, 6) + [9]
            ids += (base * rng.randrange(1, 8))[:rng.randrange(1, 90)]
        for length, exponent in [(6, 4), (2, 2), (6, 3)]:
            want = brute(ids, length, exponent)
            assert periodic.runs(ids, length, exponent) == want, ids
            total += len(want)
    assert total > 20_000


@pytest.mark.parametrize("ids, want", [
    ([], []),
    ([1] * 5, []),
    ([1] * 6, [(0, 6, 1)]),
    ([1, 2] * 3, []),
    ([1, 2] * 4, [(0, 8, 2)]),
    ([1, 2] * 4 + [1], [(0, 9, 2)]),
    ([0, *[1, 1, 2] * 4, 9], [(1, 12, 3)]),
    (([1] * 7 + [2]) * 4, [(0, 7, 1), (0, 32, 8), (8, 7, 1), (16, 7, 1), (24, 7, 1)]),
])
def test_small_cases(ids, want):
    assert periodic.runs(ids) == want


@pytest.mark.parametrize("ids, n_runs", [
    ([0] * 300_000, 1),
    ([0, 1, 2, 3, 4] * 60_000, 1),
    ([0, 0, 1] * 100_000, 1),
    (([0] * 1000 + [1]) * 100, 101),
    (([0] * 30_000 + [1]) * 5, 6),
])
def test_long_repetitive_texts_take_about_linear_time(ids, n_runs):
    begin = time.process_time()
    assert len(periodic.runs(ids)) == n_runs
    assert time.process_time() - begin < 20


def test_words_of_long_texts_are_cut_at_white_space():
    words = [b"w%d" % (i % 977) for i in range(400_000)]
    text = b" \n".join(words) + b"\x0b" + b"y" * 3_000_000 + b"\x1f\xc2\xa0z "
    ids, known = periodic.word_ids(text)
    name = {v: k for k, v in known.items()}
    assert [name[i] for i in ids] == re.findall(rb"[^\x20\x09-\x0D]+", text)


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_query_equals_brute_force_on_a_messy_table(spark, tmp_path):
    import __spark_entry__

    rng = random.Random(5)
    more = [(i, " ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(80))), "en", "s")
            for i in range(100, 180)]
    rows = [*ROWS, *more, (105, "x " * 9, None, None)]
    documents(spark, tmp_path / "documents.parquet", rows)
    got = __spark_entry__.queries()["op13_periodic_runs"](spark, str(tmp_path)).collect()
    want = []
    for doc_id, text, *_ in rows:
        words = planted(doc_id, text)
        if len(words) > 10_000:  # the long texts are a run of period 5, with or without an end
            found = [(0, 200_000, 5)]
        else:
            found = brute(words)
        best = min(((-n, s, q) for s, n, q in found), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want.append((
            doc_id, len(found), *([None] * 4 if best is None else (
                best[1], -best[0], best[2], 1000 * -best[0] // best[2])),
            hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(collapsed(words, found).encode()).hexdigest()))
    key = str
    assert sorted(map(key, (tuple(r) for r in got))) == sorted(map(key, want))
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows if r[0] is not None) > 3


def test_empty_table_and_least_exponent(spark):
    docs = documents(spark, rows=[])
    assert periodic.find_runs(docs).count() == 0
    assert periodic.with_planted_runs(docs).columns == docs.columns
    with pytest.raises(ValueError):
        periodic.find_runs(docs, min_exponent=1)
