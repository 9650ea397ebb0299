import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from messy import EXTRA, ROWS, documents

from mnemoframe.llm import sharding
from mnemoframe.operators.groups import stored


def order(doc_id, text):
    return hashlib.md5((text or "").encode()).digest(), doc_id is None, doc_id or 0


def brute(rows, n_shards):
    """Each row's shard and slot: boundaries nearest to their targets in the sorted rows."""
    own = sorted(rows, key=lambda r: order(r[0], r[1]))
    sizes = [len((r[1] or "").encode()) + 1 for r in own]
    below = [sum(sizes[:i]) for i in range(len(own) + 1)]
    cuts = [min(below, key=lambda b: (abs(n_shards * b - k * below[-1]), b))
            for k in range(1, n_shards)]
    out, slots = [], defaultdict(int)
    for (doc_id, text, *_), size, b in zip(own, sizes, below):
        k = sum(c <= b for c in cuts)
        out.append((doc_id, size, zlib.crc32((text or "").encode()), k, slots[k]))
        slots[k] += 1
    return sorted(map(str, out))


def placed(df):
    size, crc, shard, slot = df.columns[-4:]
    return sorted(str((r["doc_id"], r[size], r[crc], r[shard], r[slot])) for r in df.collect())


@pytest.mark.parametrize("n_shards", [1, 4, 16, 40])
def test_messy_table(spark, tmp_path, n_shards):
    docs = documents(spark, tmp_path / "d")
    out = sharding.shard(docs, n_shards)
    assert out.columns == [*docs.columns, "_size", "text_crc32", "shard", "slot"]
    assert placed(out) == brute(ROWS, n_shards)
    assert {r["size"] for r in out.collect()} == {"x"}  # columns of such a name stay


def test_many_rounds_and_a_group_of_a_third(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["a", "bb", "é"], k=rng.randrange(12))) + str(i), "en", "s")
            for i in range(1200)]
    rows += [(5000 + i, "one text", "en", "s") for i in range(600)] + [(7, "same row", "en", "s")] * 200
    docs = documents(spark, rows=rows).repartition(7)
    narrow = stored(documents(spark, rows=rows).repartition(5))
    keyed, (file, row) = sharding.with_row_key(narrow)
    from pyspark.sql import functions as F

    text = F.col("text").cast("binary")
    keys = stored(keyed.select(
        sharding.sort_key(text, F.col("doc_id"), F.col(file), F.col(row)).alias("key"),
        (F.octet_length(text) + 1).cast("long").alias("size")))
    split = sharding.find_splitters(keys, 16, probes=40)
    assert split.rounds > 2 and len(split.shards) == 15
    rough = sharding.find_splitters(keys, 16, tolerance=0.05, probes=200)
    assert rough.rounds < split.rounds
    share = split.total_bytes / 16
    for k, (_, below, _) in enumerate(rough.shards, 1):
        assert abs(below - k * share) <= 0.05 * share
    out = sharding.shard(docs)
    assert placed(out) == brute(rows, 16)
    copies = {r["shard"] for r in out.filter("text = 'one text'").collect()}
    assert copies == set(range(min(copies), max(copies) + 1))  # equal texts lie side by side


def test_result_does_not_depend_on_files(spark, tmp_path):
    rows = [(i, f"text {i % 50}" * (i % 9), "en", "s") for i in range(400)]
    one = documents(spark, tmp_path / "one", rows)
    other = documents(spark, rows=rows[::-1]).repartition(6)
    assert placed(sharding.shard(one)) == placed(sharding.shard(other)) == brute(rows, 16)


def test_written_shards_hold_whole_rows(spark, tmp_path):
    docs = documents(spark, tmp_path / "d")
    sharding.write_shards(docs, str(tmp_path / "out"), n_shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ROWS) and set(EXTRA) <= set(back.columns)
    texts = sorted(str(r["text"]) for r in back.collect())
    assert texts == sorted(str(r[1]) for r in ROWS)


def test_empty_table(spark):
    assert sharding.shard(documents(spark, rows=[])).count() == 0
