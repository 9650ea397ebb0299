"""Arrays cut by byte ranges give the elements of the whole array."""

import json
import random

import pytest

from mnemoframe import schemas
from mnemoframe.sources import conversations, json_array

SMALL = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
ODD = ["plain", 'a "quoted" } brace', "back\\\\slash}", "]}{[", "\u00e9}\n{", "\\", '\\"', "}" * 9, ""]


def instances(n, seed):
    rng = random.Random(seed)
    return [{
        "question_id": f"q{i}", "question_type": rng.choice(ODD), "question": rng.choice(ODD),
        "answer": rng.choice(ODD), "question_date": "2023/05/20 (Sat) 02:21",
        "answer_session_ids": [rng.choice(ODD) for _ in range(rng.randrange(3))],
        "haystack_session_ids": ["s"], "haystack_dates": ["2023/05/20 02:21"],
        "haystack_sessions": [[
            {"role": "user", "content": rng.choice(ODD) * rng.choice([1, 1, 200])}
            for _ in range(rng.randrange(4))]],
    } for i in range(n)]


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_ranges_equal_the_whole_array(spark, tmp_path, small_ranges, indent):
    want = {}
    for name, n in (("a", 40), ("b", 25), ("c", 0)):
        rows = instances(n, len(want))
        for i, r in enumerate(rows):
            r["question_id"] = f"{name}{i}"
        want |= {r["question_id"]: r for r in rows}
        (tmp_path / f"{name}.json").write_text(
            json.dumps(rows, indent=indent, ensure_ascii=indent is None))
    got = conversations.read_split(spark, str(tmp_path))
    assert json_array._fragments(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    found = {r.question_id: r for r in got.collect()}
    assert set(found) == set(want)
    for key, r in found.items():
        assert (r.question_type, r.question, r.answer) == tuple(
            want[key][c] for c in ("question_type", "question", "answer"))
        assert list(r.answer_session_ids) == want[key]["answer_session_ids"]
        assert [[t.content for t in s] for s in r.haystack_sessions] == [
            [t["content"] for t in s] for s in want[key]["haystack_sessions"]]
    whole = spark.read.schema(schemas.INSTANCE).option("multiLine", True).json(str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, found.values()))
