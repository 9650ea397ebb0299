"""What Python workers hold is bounded in bytes, not only in rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mnemoframe.operators import hooks, retrieve, scan

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def a_pack(n):
    return scan.pack_questions(pa.table({
        "query_id": [f"q{i}" for i in range(n)], "scope_id": pa.array([1] * n, pa.int64()),
        "types": [["t"]] * n, "show_superseded": [False] * n, "keywords": [["word"]] * n}))


def test_ids_are_held_a_byte_a_character_in_the_order_of_code_points():
    ids = ["memory#" + x for x in ("é", "z", "￮", "\U0001f600", "a")]
    batch = pa.RecordBatch.from_pydict({
        "scope_id": pa.array([1] * 5, pa.int64()), "mem_id": ids, "mem_type": ["t"] * 5,
        "status": ["active"] * 5, "tokens": [["word"]] * 5})
    work = scan.Scan(a_pack(1), 5)
    work.batch(batch)
    assert work.keyword.trim()[2].dtype.kind == "S"
    assert work.keyword.cut()[2].tolist() == sorted(ids)


def test_results_leave_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(scan, "RESULT_ROWS", 7)
    work = scan.Scan(a_pack(4), 5)
    work.keyword.add(np.repeat(np.arange(4), 5), np.ones(20),
                     np.array([f"m{i}" for i in range(20)], dtype=bytes))
    schema = pa.schema([("query_id", pa.string()), ("scope_id", pa.int64()),
                        ("mem_id", pa.string()), ("leg", pa.string()), ("score", pa.float64())])
    found = list(work.results(schema))
    assert [b.num_rows for b in found] == [7, 7, 6]
    assert pa.Table.from_batches(found)["mem_id"].to_pylist() == [f"m{i}" for i in range(20)]


def test_texts_go_to_providers_and_embeddings_in_small_batches(spark):
    texts = spark.createDataFrame([("a b",), ("c",)], "text string")
    spark.conf.set(SETTING, "64m")
    called = hooks.call_provider(texts, ["text"], lambda t: [x.upper() for x in t], "string")
    assert spark.conf.get(SETTING) == "4m"
    assert {r["payload"] for r in called.collect()} == {"A B", "C"}
    spark.conf.set(SETTING, "64m")
    with_vector = retrieve.with_embedding(texts, "text")
    assert spark.conf.get(SETTING) == "4m"
    assert with_vector.filter(F.size("embedding") > 0).count() == 2
