import hashlib
import random
import re
from collections import defaultdict

import pytest
from messy import ROWS, documents

from mnemoframe.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, (doc_id, text, *_) in enumerate(rows):
        bare = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups[hashlib.sha256(bare.encode()).hexdigest()].append((-len(text or ""), doc_id is None, doc_id or 0))
    return {k: (len(v), min(v)) for k, v in groups.items()}


@pytest.mark.parametrize("from_parquet", [True, False])
def test_messy_table(spark, tmp_path, from_parquet):
    docs = documents(spark, tmp_path / "d" if from_parquet else None)
    rows = exact_dedup.deduplicate(docs).collect()
    assert len(rows) == len(ROWS)
    want = brute(ROWS)
    for digest, (n, best) in want.items():
        own = [r for r in rows if r["text_sha256"] == digest]
        assert len(own) == n == own[0]["group_size"]
        assert sum(r["kept"] for r in own) == 1
        keep = None if best[1] else best[2]
        assert {r["keep_id"] for r in own} == {keep}
        assert [r["doc_id"] for r in own if r["kept"]] == [keep]
    kept = exact_dedup.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() == len(want)


def test_empty_table(spark):
    docs = documents(spark, rows=[])
    assert exact_dedup.deduplicate(docs).count() == 0
    assert exact_dedup.kept_rows(docs).columns == docs.columns


def test_index_inserts_deletes_and_grows():
    rng = random.Random(3)
    index, live = exact_dedup.CuckooIndex(n_buckets=2, max_moves=8), {}
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for step in range(20_000):
        d = rng.choice(digests)
        if d in live and rng.random() < 0.4:
            assert index.delete(d, 5)
            del live[d]
        elif d not in live:
            index.insert(d, 5, step)
            live[d] = step
        assert index.get(d, 5) == live.get(d)
    assert len(index) == len(live) and index.n_buckets > 2
    assert all(index.get(d, 5) == live.get(d) for d in digests)
    assert not index.delete(b"\0" * 32, 5)


def test_hit_is_verified_against_content():
    index = exact_dedup.CuckooIndex()
    one = hashlib.sha256(b"1").digest()
    same_places = one[:10] + bytes(22)  # fingerprint and buckets of the first, other content
    index.insert(one, 4, "first")
    assert index.get(same_places, 4) is None and index.get(one, 5) is None
    index.insert(same_places, 4, "second")
    assert index.get(one, 4) == "first" and index.get(same_places, 4) == "second"
    assert index.delete(one, 4) and index.get(one, 4) is None
    assert index.get(same_places, 4) == "second"


def test_more_equal_fingerprints_than_slots_still_resize():
    index = exact_dedup.CuckooIndex(n_buckets=1)
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(200)]
    for d in digests:
        index.insert(d, 1, d)
    assert all(index.get(d, 1) == d for d in digests)
