import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from messy import ROWS, documents

from mnemoframe.llm import near_dedup as N
from mnemoframe.llm.arrays import lower_words


def shingles(text):
    words = "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " "
                    for c in (text or "").lower()).split()
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def probability_jaccard(a, b):
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in {*a, *b}) for i in {*a} & {*b})


def brute(rows, threshold=0.8):
    """Smallest doc_id of the component of each doc_id, by all pairs."""
    known = [(d, shingles(t)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in known}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(known):
        for e, b in known[:i]:
            if a and b and probability_jaccard(a, b) >= threshold - 1e-9:
                low, high = sorted((root(d), root(e)))
                parent[high] = low
    return {d: root(d) for d, _ in known}


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10_000)}"
    return words


def test_similarity_by_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        a = [rng.choice("abc") for _ in range(rng.randint(5, 30))]
        b = edited(a, rng.randint(0, 4), rng)
        one, two = N.weighted_sets([" ".join(a), " ".join(b)])
        assert N.similarity(one, two) == pytest.approx(
            probability_jaccard(shingles(" ".join(a)), shingles(" ".join(b))))


def test_sketches_estimate_the_similarity():
    rng = random.Random(6)
    errors = []
    for _ in range(40):
        a = [f"v{rng.randrange(60)}" for _ in range(150)]
        b = edited(a, rng.randint(0, 25), rng)
        texts = [" ".join(a + a[:40]), " ".join(b)]
        for row, end, w in lower_words(pa.array(texts)):
            found = N.sketches(*N.weighted(*N.shingles(w)), end - row)
        errors.append((found[0] == found[1]).mean()
                      - probability_jaccard(*map(shingles, texts)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_early_end_changes_no_sketch():
    """Against the plain definition: all arrivals of every shingle up to a late time."""
    rng = np.random.default_rng(3)
    value = rng.integers(1 << 63, size=30).astype(np.uint64)
    weight = rng.integers(1, 5, size=30)
    got = N.sketches(value, np.zeros(30, dtype=np.int64), weight, 1)[0]
    best = [(np.inf, 0)] * N.COMPONENTS
    time = np.zeros(30)
    for arrival in range(400):
        time -= np.log(N._uniform(N.mix(value, 2 * arrival + 101))) / weight
        place = N.mix(value, 2 * arrival + 102) % np.uint64(N.COMPONENTS)
        for v, t, p in zip(value.tolist(), time.tolist(), place.tolist()):
            best[p] = min(best[p], (t, v))
    assert [b[1] for b in best] == got.tolist()


def test_groups_by_brute_force(spark):
    rng = random.Random(9)
    rows, doc = [], 0
    for g in range(14):
        base = [f"g{g}x{rng.randrange(400)}" for _ in range(rng.choice([3, 40, 120, 300]))]
        for k in range(rng.choice([1, 2, 4, 30])):
            # a chain: each copy changes the one before
            base = edited(base, rng.choice([0, 0, 1, 2]), rng) if k else base
            rows.append((doc, " ".join(base)))
            doc += 1
    rng.shuffle(rows)
    found = {r["doc_id"]: r for r in N.group(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert {d: r["group_id"] for d, r in found.items()} == want
    assert {d for d, r in found.items() if r["kept"]} == set(want.values())
    classes = defaultdict(list)
    for d, t in rows:
        classes[t].append(d)
    assert {d: r["class_id"] for d, r in found.items()} == {
        d: min(c) for c in classes.values() for d in c}


def test_blocks_find_links_that_pivots_miss(spark):
    """Many texts around one centre: each is near the centre, few are near one another."""
    rng = random.Random(12)
    centre = [f"c{i}" for i in range(200)]
    rows = [(1000, " ".join(centre))]
    rows += [(i, " ".join(edited(centre, 4, rng))) for i in range(40)]
    found = N.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["group_id"] for r in found} == brute(rows)


def test_last_round_takes_pairs_with_few_agreements():
    """A pair at 0.8 may agree on 80 of 120 components; it is verified, not dropped."""
    one = np.arange(1, N.COMPONENTS + 1, dtype=np.uint32)
    two = one.copy()
    two[80:] += 1000
    ids = [np.array([k]).tobytes() for k in (7, 3)]
    packs = pa.RecordBatch.from_pylist([{
        "reps": ids[0], "roots": ids[0], "sketches": one.tobytes(), "reps_2": ids[1],
        "roots_2": ids[1], "sketches_2": two.tobytes(), "band": 0, "tried": None}])
    rows = next(N._agreements(iter([packs]), best=False)).to_pylist()
    assert rows == [{"a": 7, "b": 3, "agree": 80}]


def test_components_of_a_long_chain(spark):
    order = list(range(80))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([*zip(order[:-1], order[1:]), (200, 201)], "a long, b long")
    found = {r["node"]: r["root"] for r in N.components(links).collect()}
    assert found == {**{i: 0 for i in range(1, 80)}, 201: 200}


def test_components_of_a_chain_take_few_rounds(spark, monkeypatch):
    """A round was two writes and five shuffles; tasks link what they hold before and after one."""
    order = list(range(300))
    random.Random(2).shuffle(order)
    links = spark.createDataFrame([*zip(order[:-1], order[1:])], "a long, b long").repartition(6)
    written = []

    def counted(df):
        written.append(1)
        return stored(df)

    stored = N.stored
    monkeypatch.setattr(N, "stored", counted)
    found = {r["node"]: r["root"] for r in N.components(links).collect()}
    assert found == {i: 0 for i in range(1, 300)}
    assert len(written) <= 8


def test_components_in_small_parts(spark, monkeypatch):
    """A part that is full hands its last node on, so parts never keep a component apart."""
    rng = random.Random(3)
    pairs = [(rng.randrange(-40, 40), rng.randrange(-40, 40)) for _ in range(70)] + [
        (90, k) for k in range(60, 90)]
    rows = np.array([[max(p), min(p)] for p in pairs if p[0] != p[1]])
    monkeypatch.setattr(N, "HELD_EDGES", 4)
    whole = {tuple(r) for r in N._stars(rows).tolist()}
    while True:
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        batches = (pa.RecordBatch.from_arrays([pa.array(c) for c in rows[i:i + 3].T], names=["u", "v"])
                   for i in range(0, len(rows), 3))
        parts = [np.column_stack([c.to_numpy() for c in b.columns]) for b in N._contracted(batches)]
        assert max(map(len, parts)) <= 4 + 3
        rows = np.unique(np.concatenate(parts), axis=0)
        assert {tuple(r) for r in N._stars(rows).tolist()} == whole
        roots = dict(sorted(rows.tolist(), reverse=True))
        moved = np.array([[u, roots.get(v, v)] for u, v in rows.tolist()])
        if (moved == rows).all():
            break
        rows = moved
    assert {tuple(r) for r in rows.tolist()} == whole


def test_small_tables_take_few_tasks(spark):
    rows = spark.range(1000).repartition(100)
    cores = spark.sparkContext.defaultParallelism
    assert N._in_tasks(rows, 1000, 500).rdd.getNumPartitions() == 2 * cores
    assert N._in_tasks(rows, 1000, 20).rdd.getNumPartitions() == max(2 * cores, 51)
    assert N._in_tasks(rows, 1000, 1).rdd.getNumPartitions() == 100


def test_messy_table(spark):
    docs = documents(spark)
    rows = N.group(docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    group = {r["doc_id"]: r["group_id"] for r in rows}
    # the same words, also in the repeated rows; the long texts differ in one word
    assert group[6] == 5 and group[8] == 7 and group[2] == 2 and group[1] == 1
    assert group[3] == 3 and group[4] == 4 and group[11] == 11 and group[None] is None
    kept = N.kept_rows(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(ROWS) - 2
    assert N.group(documents(spark, rows=[])).count() == 0


def packs_of(reps, tried=None):
    """A pair of packs of classes that agree on every component, each its own root."""
    own = np.array(reps, dtype=np.int64)
    pack = {"reps": own.tobytes(), "roots": own.tobytes(), "pack": int(own.min()),
            "sizes": np.full(len(own), 100, dtype=np.int64).tobytes(),
            "sketches": np.ones((len(own), N.COMPONENTS), dtype=np.uint32).tobytes(),
            "tried": [(tried or {}).get(r) for r in reps]}
    return pa.RecordBatch.from_pylist([{
        "bucket": 5, "band": 0, **pack, **{f"{c}_2": v for c, v in pack.items()}}])


def pairs_in(chunks):
    out = []
    for c in chunks:
        at = np.frombuffer(c["pairs"], np.int32).reshape(-1, 2)
        out += [tuple(sorted((c["reps"][i], c["reps"][j]))) for i, j in at.tolist()]
    return out


def test_last_round_makes_chunks_and_no_row_per_pair(monkeypatch):
    """1,770 pairs, two of them tried before: one row, and bounded ones that hold each pair once."""
    reps = list(range(100, 160))
    tried = {103: [101], 110: [140, 999]}
    want = {(a, b) for a in reps for b in reps if a < b} - {(101, 103), (110, 140)}
    chunks = next(N._chunks(iter([packs_of(reps, tried)]))).to_pylist()
    assert len(chunks) == 1 and sorted(pairs_in(chunks)) == sorted(want)
    monkeypatch.setattr(N, "CHUNK_BYTES", 2_000)
    small = next(N._chunks(iter([packs_of(reps, tried)]))).to_pylist()
    assert sorted(pairs_in(small)) == sorted(want)
    assert all(len(c["reps"]) <= 20 for c in small)
    assert len({c["part"] for c in small}) == len(small)


def test_chunks_return_the_links_that_join_components():
    rng = random.Random(3)
    centre = [f"c{i}" for i in range(200)]
    near = [" ".join(edited(centre, 1, rng)) for _ in range(6)]
    far = [" ".join(edited(centre, 60, rng)) for _ in range(6)]
    reps = list(range(12))
    chunk = next(N._chunks(iter([packs_of(reps)]))).to_pylist()[0]
    rows = [{**chunk, "rep": None, "text": None}]
    rows += [{"rep": r, "text": t, "pairs": None} for r, t in zip(reps, near + far)]
    links = N._joining(pa.Table.from_pylist(rows), 0.8).to_pylist()
    # five links join six near texts; the fifteen between them are not all returned
    assert len(links) == 5 and {x for p in links for x in p.values()} == set(range(6))


def test_kept_rows_shuffles_no_text_for_a_few_ids(spark):
    """The ids that go are few and known to be, so the rows stay where they are."""
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(random.Random(i // 2).sample(words, 60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kept = N.kept_rows(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 40, 2))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
