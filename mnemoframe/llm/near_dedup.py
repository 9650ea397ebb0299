"""Near-duplicate detection by ProbMinHash.

Texts are weighted sets of word shingles (five lower-cased words; the weight is how often a
shingle occurs).  Their similarity is the probability Jaccard index, which for weights of 1
is the plain one.  Two texts are linked from ``threshold`` (0.8) on; a group is a component of
links.

1. *Sketch.*  In Arrow batches, every shingle is a Poisson process whose rate is its weight:
   arrivals in order of time, each at one of ``COMPONENTS`` places, drawn from the shingle's
   hash alone.  A component is won by the shingle that arrives first.  All shingles of a
   block make their first arrival together; only those whose next arrival can still win go
   on, so the processes end early.  Texts with equal words share a digest and form a class;
   the class with its smallest doc_id goes on alone.
2. *Bands.*  ``BANDS`` bands of ``ROWS`` components are bucketed by hash.
3. *Links.*  In each bucket, every class is compared with one pivot, not with all others, and
   pairs are verified on the texts.  Verified links join classes to components.  For buckets
   in which several components meet, members are packed into blocks of sketches and blocks
   are compared with blocks.  In rounds, each class outside its bucket's largest component
   tries the partners whose sketches agree most with its own and that it has not tried, until
   a round joins next to nothing.  Then all pairs that still lie across components and agree
   on ``MIN_AGREE`` are verified, none left out.  A bucket of many copies of one text costs a
   comparison per member; one of many texts that are near but not near enough costs a
   verification per pair of components.  That one runs inside blocks: pairs are numbers in a
   chunk, a chunk gets each of its texts once, and what leaves it are the links that join
   components, not the pairs.
4. *Components*: each task makes stars of its links; nodes move up to the roots of their roots
   and the links of a node meet again, to a fixpoint.

At similarity 0.8 a pair shares no bucket with probability (1 - 0.8^5)^24 < 1e-4.  Pivots are
verified whatever their sketches say.  The sketches of a pair at 0.8 agree on less than 0.64
with probability below 2e-5.

A text of one to four words is one shingle; texts without words are linked to nothing.  Null
counts as empty.  Rows with a null doc_id are linked to nothing.  Rows that repeat a doc_id
with different texts are linked by each text; the document then belongs to all of these
groups, hence they are one group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.llm.arrays import Words, lower_words, mix
from mnemoframe.llm.rows import in_small_batches
from mnemoframe.operators.groups import stored

SHINGLE = 5
BANDS, ROWS = 24, 5
COMPONENTS = BANDS * ROWS
# share of sketch components that must agree
MIN_AGREE = 0.64
# partners that a class tries in one round
TRIES = 4
# rounds go on while they join more than this share of the pairs they verify
ROUND_SHARE = 0.01
HELD_BYTES = 32 << 20
# edges whose components a task finds at once
HELD_EDGES = 1 << 20
BLOCK = 1024
# bytes of text and number of pairs that are verified together in the last round
CHUNK_BYTES = 4 << 20
CHUNK_PAIRS = 1 << 18
# rows that are worth a task: of numbers, and with sketches or texts
LIGHT_ROWS = 1 << 17
HEAVY_ROWS = 1 << 13
SKETCH_SCHEMA = "doc_id long, digest binary, sketch binary, size long"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _in_tasks(df: DataFrame, rows: int, per_task: int, per_core: int = 2) -> DataFrame:
    """The rows in fewer tasks where ``rows``, about as many as they are, are not worth more.

    Tables of ids are small beside the texts, and there is a price for each task and file.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(per_core * cores, rows // per_task + 1))


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a block, and the row of each."""
    n_words = np.diff(w.bounds)
    rows = np.repeat(np.arange(len(n_words)), n_words)
    if len(w.hashes) >= SHINGLE:
        n = len(w.hashes) - SHINGLE + 1
        value = w.hashes[:n].copy()
        for k in range(1, SHINGLE):
            value = value * _FACTOR + w.hashes[k:n + k]
        whole = rows[:n] == rows[SHINGLE - 1:]
        value, of = value[whole], rows[:n][whole]
    else:
        value, of = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        own = []
        for row in short.tolist():
            total = np.zeros(1, dtype=np.uint64)
            for h in w.hashes[w.bounds[row]:w.bounds[row + 1]]:
                total = total * _FACTOR + h
            own.append(mix(total, 9)[0])
        value = np.concatenate([value, np.array(own, dtype=np.uint64)])
        of = np.concatenate([of, short])
    return mix(value, 5), of


def weighted(value: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) pairs and how often each occurs, in order of rows."""
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return value[at], rows[at], np.diff(np.append(at, len(value)))


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def sketches(value: np.ndarray, rows: np.ndarray, weight: np.ndarray, n_rows: int) -> np.ndarray:
    """ProbMinHash components (n_rows x COMPONENTS) of weighted sets; 0 where a set is empty."""
    best = np.full(n_rows * COMPONENTS, np.inf)
    winner = np.zeros(n_rows * COMPONENTS, dtype=np.uint64)
    time = np.zeros(len(value))
    arrival = 0
    while len(value):
        bits = mix(value, 2 * arrival + 101)
        time = time - np.log(_uniform(bits)) / weight
        place = (mix(value, 2 * arrival + 102) % np.uint64(COMPONENTS)).astype(np.int64)
        at = rows * COMPONENTS + place
        order = np.lexsort((value, time, at))
        first = np.ones(len(order), dtype=bool)
        first[1:] = at[order][1:] != at[order][:-1]
        lead = order[first]
        wins = (time[lead] < best[at[lead]]) | (
            (time[lead] == best[at[lead]]) & (value[lead] < winner[at[lead]]))
        lead = lead[wins]
        best[at[lead]], winner[at[lead]] = time[lead], value[lead]
        # an arrival later than the latest component cannot win, nor can its successors
        latest = best.reshape(n_rows, COMPONENTS).max(axis=1) if n_rows else np.zeros(0)
        on = time < latest[rows]
        value, rows, weight, time = value[on], rows[on], weight[on], time[on]
        arrival += 1
    return winner.reshape(n_rows, COMPONENTS)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, text = batch.column("doc_id"), batch.column("text")
        size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
        for row, end, w in lower_words(text):
            value, of = shingles(w)
            found = sketches(*weighted(value, of), end - row).astype(np.uint32)
            some = np.diff(w.bounds) > 0
            digests = [
                hashlib.blake2b(w.hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None
                for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(row, end - row), pa.array(digests, pa.binary()),
                 pa.array([s.tobytes() if k else None for s, k in zip(found, some.tolist())],
                          pa.binary()), size.slice(row, end - row)],
                names=["doc_id", "digest", "sketch", "size"])


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per class and band."""
    for batch in batches:
        raw = b"".join(batch.column("sketch").to_pylist())
        found = np.frombuffer(raw, dtype=np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        value = np.zeros(found.shape[:2], dtype=np.uint64)
        for k in range(ROWS):
            value = mix(value ^ found[:, :, k], 20 + k)
        value = mix(value + np.arange(BANDS, dtype=np.uint64), 30)
        ids = np.repeat(batch.column("rep").to_numpy(), BANDS)
        bands = np.tile(np.arange(BANDS, dtype=np.int32), len(found))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(value.ravel().view(np.int64)), pa.array(bands)],
            names=["rep", "bucket", "band"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard index of two weighted sets (sorted hashes, weights).

    Sum over common elements i of 1 / sum over all j of max(a_j / a_i, b_j / b_i), where the
    elements with equal pairs of weights are counted together.
    """
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at_b = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    at_a = np.flatnonzero(b[0][at_b] == a[0])
    at_b = at_b[at_a]
    if not len(at_a):
        return 0.0
    if a[1].max() == b[1].max() == 1:
        return len(at_a) / (len(a[0]) + len(b[0]) - len(at_a))
    only_a, only_b = np.ones(len(a[0]), dtype=bool), np.ones(len(b[0]), dtype=bool)
    only_a[at_a], only_b[at_b] = False, False
    pairs = np.concatenate([
        np.column_stack([a[1][at_a], b[1][at_b]]),
        np.column_stack([a[1][only_a], np.zeros(only_a.sum(), dtype=np.int64)]),
        np.column_stack([np.zeros(only_b.sum(), dtype=np.int64), b[1][only_b]])])
    span = int(pairs.max()) + 1
    codes, counts = np.unique(pairs[:, 0] * span + pairs[:, 1], return_counts=True)
    kinds = np.column_stack(np.divmod(codes, span))
    common = kinds[:, 0] * kinds[:, 1] > 0
    ratio = np.maximum(kinds[None, :, 0] / kinds[common][:, :1],
                       kinds[None, :, 1] / kinds[common][:, 1:])
    return float((counts[common] / (ratio * counts).sum(axis=1)).sum())


def weighted_sets(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Shingles and weights of single texts."""
    out = []
    for row, end, w in lower_words(pa.array(texts, pa.large_string())):
        value, of, weight = weighted(*shingles(w))
        cuts = np.searchsorted(of, np.arange(end - row + 1))
        out += [(value[x:y], weight[x:y]) for x, y in zip(cuts[:-1], cuts[1:])]
    return out


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float, rows: int) -> DataFrame:
    """The pairs (a, b) that are similar enough.  ``texts``: rep, text; ``rows``: of pairs, at most."""
    left = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}  # texts that many pairs share are cut up once
        size = 0
        for batch in batches:
            texts = [batch.column(c).to_pylist() for c in ("text_a", "text_b")]
            new = [t for t in dict.fromkeys(texts[0] + texts[1]) if t not in held]
            for text, found in zip(new, weighted_sets(new)):
                held[text] = found
                size += len(text) + found[0].nbytes + found[1].nbytes
            keep = [similarity(held[a], held[b]) >= threshold - 1e-12 for a, b in zip(*texts)]
            if size > HELD_BYTES:
                held, size = {}, 0
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # skewed joins may split into very many small tasks
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.select("a", "b", "text_a", "text_b").coalesce(tasks)
    return _in_tasks(dealt, rows, HEAVY_ROWS, 8).mapInArrow(verified, "a long, b long")


def _stars(edges: np.ndarray) -> np.ndarray:
    """Rows (node, smallest node of its component) of the components of (u, v) rows; a component
    has a row for each node but the smallest."""
    nodes, at = np.unique(edges, return_inverse=True)
    u, v = at.reshape(-1, 2).T
    low = np.arange(len(nodes))
    while True:
        near = np.minimum(low[u], low[v])
        before = low.copy()
        # roots are hooked to the smaller ones, then paths are halved
        for x in (u, v):
            np.minimum.at(low, before[x], near)
            np.minimum.at(low, x, near)
        low = low[low]
        if np.array_equal(low, before):
            break
    own = np.flatnonzero(low < np.arange(len(nodes)))
    return np.column_stack([nodes[own], nodes[low[own]]])


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges as stars of the components that they make among ``HELD_EDGES`` or so.

    The last node of a part goes into the next one too, so that all edges of a node u are
    linked where they come in order of u.
    """
    def batch_of(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in np.ascontiguousarray(rows.T)], names=["u", "v"])

    held: list[np.ndarray] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.column_stack([batch.column(c).to_numpy() for c in ("u", "v")]))
        n += batch.num_rows
        if n >= HELD_EDGES:
            rows = _stars(np.concatenate(held))
            yield batch_of(rows)
            held = [rows[rows[:, 0] == held[-1][-1, 0]]]
            n = len(held[0])
    if held:
        yield batch_of(_stars(np.concatenate(held)))


def _by_node(edges: DataFrame, rows: int) -> DataFrame:
    """All edges of a node u meet in a task, which links whatever they connect."""
    return stored(_in_tasks(edges.repartition("u"), rows, LIGHT_ROWS).sortWithinPartitions("u").mapInArrow(
        _contracted, "u long, v long"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for every other node that has a link.

    Each task makes stars of the components among its own edges.  In rounds, a node goes from
    its root to that one's root (all edges keep their components), then the edges of a node
    meet in a task again, until every node has one root and no root has a root.  What is
    shuffled has a row per node and task at most; each round is written to the shared folder.
    """
    rows = links.count()
    edges = _by_node(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u <> v").mapInArrow(_contracted, "u long, v long"), rows)
    while True:
        none = F.lit(None).cast("long")
        seen = edges.select("u", "v", F.lit(False).alias("is_root")).unionByName(
            edges.select(F.col("v").alias("u"), none.alias("v"), F.lit(True).alias("is_root")))
        # nodes with two roots, or one that are a root as well
        odd = seen.groupBy("u").agg(
            F.min("v").alias("low"), F.max("v").alias("high"), F.max("is_root").alias("is_root"),
        ).filter("low < high or (low is not null and is_root)")
        odd = stored(_in_tasks(odd, rows, LIGHT_ROWS))
        if odd.isEmpty():
            return edges.distinct().select(F.col("u").alias("node"), F.col("v").alias("root"))
        above = odd.filter("is_root").select(F.col("u").alias("v"), "low")
        edges = _by_node(edges.join(above, "v", "left").select(
            "u", F.coalesce("low", "v").alias("v")), rows)


def _with_root(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    known = roots.select(F.col("node").alias("rep"), "root")
    return buckets.join(known, "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def _mixed(buckets: DataFrame) -> DataFrame:
    """Rows of buckets in which more than one component meets, with the number of rows of the
    bucket and its largest component."""
    mixed = buckets.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("roots"),
    ).filter("roots > 1").select("bucket", "n", F.col("m.root").alias("main"))
    return buckets.join(mixed, "bucket")


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of up to BLOCK rows of one part of a bucket: their classes, roots and sketches."""
    for batch in batches:
        bucket, band, main, part, rep, root, size = (
            batch.column(c).to_numpy(zero_copy_only=False)
            for c in ("bucket", "band", "is_main", "part", "rep", "root", "size"))
        raw, tried = batch.column("sketch").to_pylist(), batch.column("tried").to_pylist()
        new = (bucket[1:] != bucket[:-1]) | (main[1:] != main[:-1]) | (part[1:] != part[:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(rep)]
        runs = [(x, min(x + BLOCK, b)) for a, b in zip(cuts[:-1], cuts[1:])
                for x in range(a, b, BLOCK)]
        first = [a for a, _ in runs]
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[first]), pa.array(band[first]), pa.array(main[first].astype(bool)),
             pa.array([tried[a:b] for a, b in runs], pa.list_(pa.list_(pa.int64()))),
             pa.array([int(rep[a:b].min()) for a, b in runs], pa.int64()),
             *(pa.array([x[a:b].tobytes() for a, b in runs], pa.binary()) for x in (rep, root, size)),
             pa.array([b"".join(raw[a:b]) for a, b in runs], pa.binary())],
            names=["bucket", "band", "is_main", "tried", "pack", "reps", "roots", "sizes", "sketches"])


def _agreements(batches: Iterator[pa.RecordBatch], best: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of two packs whose roots differ and whose sketches agree often enough.

    A pair comes from the first band that its sketches share only.  With ``best``, only the
    partners that agree most of each class of the first pack, without those it has tried.
    """
    for batch in batches:
        found = [np.zeros((0, 3), dtype=np.int64)]
        columns = (batch.column(c).to_pylist() for c in (
            "reps", "roots", "sketches", "reps_2", "roots_2", "sketches_2", "band", "tried"))
        for row in zip(*columns):
            (reps, roots), (reps_2, roots_2) = (
                [np.frombuffer(x, np.int64) for x in part] for part in (row[0:2], row[3:5]))
            one, two = (np.frombuffer(x, np.uint32).reshape(-1, COMPONENTS)
                        for x in (row[2], row[5]))
            for i in range(len(reps)):
                same = two == one[i]
                agree = np.count_nonzero(same, axis=1)
                agree[roots_2 == roots[i]] = 0
                if best and row[7][i]:
                    agree[np.isin(reps_2, row[7][i])] = 0
                hit = np.flatnonzero(agree >= MIN_AGREE * COMPONENTS)
                shared = same[hit].reshape(-1, BANDS, ROWS).all(axis=2)
                hit = hit[shared.argmax(axis=1) == row[6]]
                if best:
                    hit = hit[np.argsort(-agree[hit], kind="stable")[:TRIES]]
                if len(hit):
                    found.append(np.column_stack(
                        [np.full(len(hit), reps[i]), reps_2[hit], agree[hit]]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in np.concatenate(found).T], names=["a", "b", "agree"])


def _meeting_packs(
    buckets: DataFrame, sketched: DataFrame, tried: DataFrame, rows: int
) -> DataFrame:
    """Packs of a bucket's classes outside its largest component, with every pack of the bucket.

    Members of that component are never compared with one another.  Rows become packs before
    they meet, so a bucket joins a row per pair of packs.
    """
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / BLOCK))
    members = buckets.select(
        "bucket", "band", (F.col("root") == F.col("main")).alias("is_main"), part.alias("part"), "rep", "root")
    key = ["bucket", "is_main", "part"]
    own = tried.groupBy(F.col("a").alias("rep")).agg(F.collect_set("b").alias("tried"))
    dealt = members.join(sketched, "rep").join(own, "rep", "left").select(
        *key, "band", "rep", "root", "size", "sketch", "tried").repartition(*key)
    packs = stored(_in_tasks(dealt, rows, HEAVY_ROWS).sortWithinPartitions(*key).mapInArrow(
        _packs, "bucket long, band int, is_main boolean, tried array<array<long>>, pack long, "
                "reps binary, roots binary, sizes binary, sketches binary"))
    second = packs.select("bucket", *[
        F.col(c).alias(f"{c}_2") for c in packs.columns if c not in ("bucket", "band")])
    return _in_tasks(packs.filter(~F.col("is_main")).join(second, "bucket"), rows, HEAVY_ROWS, 8)


def _best_pairs(buckets: DataFrame, sketched: DataFrame, tried: DataFrame, rows: int) -> DataFrame:
    """Pairs (a, b) across components that meet in a bucket: ``TRIES`` at most for each class a
    outside the largest component of its bucket, and none that ``tried`` holds in this order."""
    met = _meeting_packs(buckets, sketched, tried, rows).drop("tried_2")
    pairs = met.mapInArrow(partial(_agreements, best=True), "a long, b long, agree long")
    order = Window.partitionBy("a").orderBy(F.desc("agree"), "b")
    return pairs.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= TRIES).select("a", "b")


def _cut(at: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of positions in parts of a bounded number, whose texts have bounded bytes."""
    named = [np.unique(c) for c in at.T]
    total = size[np.union1d(*named)].sum()
    if len(at) == 1 or (total <= CHUNK_BYTES and len(at) <= CHUNK_PAIRS):
        yield at
        return
    side = int(len(named[1]) > len(named[0]))
    low = at[:, side] < named[side][len(named[side]) // 2]
    yield from _cut(at[low], size)
    yield from _cut(at[~low], size)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All untried pairs of two packs that agree often enough, in chunks: the classes of a chunk,
    their roots, and pairs of places among them."""
    for batch in batches:
        found: list[tuple] = []
        for k in range(batch.num_rows):
            pair = batch.slice(k, 1)
            a, b, _ = (c.to_numpy() for c in next(_agreements(iter([pair]), best=False)).columns)
            if not len(a):
                continue
            row = pair.to_pylist()[0]
            reps, roots, sizes = (
                np.concatenate([np.frombuffer(row[c + x], np.int64) for x in ("", "_2")])
                for c in ("reps", "roots", "sizes"))
            reps, first = np.unique(reps, return_index=True)
            roots, sizes = roots[first], sizes[first]
            at = np.searchsorted(reps, np.column_stack([a, b]))
            at = np.unique(np.sort(at, axis=1), axis=0)  # a pack meets itself in both orders
            own = np.frombuffer(row["reps"], np.int64), np.frombuffer(row["reps_2"], np.int64)
            done = np.array([(r, t) for x, c in zip(own, ("tried", "tried_2"))
                             for r, ts in zip(x.tolist(), row[c]) for t in ts or ()],
                            dtype=np.int64).reshape(-1, 2)
            place = np.minimum(np.searchsorted(reps, done), len(reps) - 1)
            place = np.sort(place[(reps[place] == done).all(axis=1)], axis=1)
            at = at[~np.isin(at @ [len(reps), 1], place @ [len(reps), 1])]
            for part, own_pairs in enumerate(_cut(at, sizes) if len(at) else ()):
                named, places = np.unique(own_pairs, return_inverse=True)
                found.append((row["bucket"], row["pack"], row["pack_2"], part, reps[named],
                              roots[named], places.astype(np.int32).tobytes()))
        columns = zip(*found) if found else [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()),
                 pa.list_(pa.int64()), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)],
            names=["bucket", "pack", "pack_2", "part", "reps", "roots", "pairs"])


def _joining(chunk: pa.Table, threshold: float) -> pa.Table:
    """The links of a chunk that join components: the others follow from them."""
    head = chunk.filter(pc.is_valid(chunk["pairs"])).to_pylist()[0]
    texts = chunk.filter(pc.is_valid(chunk["text"])).select(["rep", "text"]).to_pydict()
    distinct = list(dict.fromkeys(texts["text"]))
    sets = dict(zip(distinct, weighted_sets(distinct)))
    own: dict[int, dict] = {}
    for rep, text in zip(texts["rep"], texts["text"]):
        own.setdefault(rep, {})[text] = sets[text]
    parent = {r: r for r in head["roots"]}

    def top(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    links = []
    for i, j in np.frombuffer(head["pairs"], np.int32).reshape(-1, 2).tolist():
        one, two = top(head["roots"][i]), top(head["roots"][j])
        a, b = head["reps"][i], head["reps"][j]
        if one != two and any(
                similarity(x, y) >= threshold - 1e-12
                for x in own.get(a, {}).values() for y in own.get(b, {}).values()):
            parent[one] = two
            links.append((a, b))
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()),
                     "b": pa.array([b for _, b in links], pa.int64())})


def _last_links(
    buckets: DataFrame, sketched: DataFrame, tried: DataFrame, texts: DataFrame, threshold: float,
    rows: int,
) -> DataFrame:
    """Links among all untried pairs across components whose sketches agree, none left out.

    Texts go to the chunks that name them, once each, however many pairs they are in.
    """
    met = _meeting_packs(buckets, sketched, tried, rows).filter(
        F.col("is_main_2") | (F.col("pack") <= F.col("pack_2")))
    chunks = stored(met.mapInArrow(
        _chunks, "bucket long, pack long, pack_2 long, part int, reps array<long>, "
                 "roots array<long>, pairs binary"))
    key = ["bucket", "pack", "pack_2", "part"]
    sent = chunks.select(*key, F.explode("reps").alias("rep")).join(texts, "rep")
    return chunks.unionByName(sent, allowMissingColumns=True).groupBy(*key).applyInArrow(
        lambda chunk: _joining(chunk, threshold), "a long, b long")


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """Distinct pairs, the larger class first, without those tried in either order."""
    pairs, done = (
        x.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")) for x in (pairs, tried))
    return pairs.distinct().join(done, ["a", "b"], "left_anti")


def group(
    docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, class_id, group_id, kept.

    ``class_id`` is the smallest doc_id with the same words, ``group_id`` the smallest of the
    group; the document whose id that is stays.  Both are the own doc_id, null included,
    where nothing is linked.
    """
    narrow = in_small_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stored(narrow.mapInArrow(_sketched, SKETCH_SCHEMA))
    linkable = rows.filter(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    n_rows = rows.count()

    def kept(df: DataFrame, n: int, per_task: int = LIGHT_ROWS) -> DataFrame:
        return stored(_in_tasks(df, n, per_task))

    classes = kept(linkable.groupBy("digest").agg(F.min("doc_id").alias("rep")), n_rows)
    # a doc_id that repeats with several texts has a sketch for each
    sketched = kept(
        linkable.withColumnRenamed("doc_id", "rep").join(classes, ["digest", "rep"])
        .dropDuplicates(["rep", "digest"]).select("rep", "sketch", "size"), n_rows, HEAVY_ROWS)
    banded = kept(
        sketched.select("rep", "sketch").mapInArrow(_bucketed, "rep long, bucket long, band int")
        .distinct(), n_rows * BANDS)
    crowded = banded.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("rep").alias("pivot")).filter("n > 1").drop("n")
    buckets = kept(banded.join(crowded, "bucket"), n_rows * BANDS)
    n = buckets.count()
    # written, so that Spark knows how few ids they are before it would shuffle the texts
    wanted = kept(buckets.select(F.col("rep").alias("doc_id")).distinct(), min(n, n_rows))
    texts = stored(narrow.join(wanted, "doc_id").select(F.col("doc_id").alias("rep"), "text"))

    pairs = kept(buckets.filter("rep <> pivot").select(
        F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), n)
    tried, links = pairs, stored(_verify(pairs, texts, threshold, pairs.count()))
    mixed, goes_on = buckets, True

    def still_mixed() -> DataFrame:
        # a bucket of one component stays one
        left = mixed.select("rep", "bucket", "band")
        return kept(_mixed(_with_root(left, components(links))), n)

    mixed = still_mixed()
    while goes_on:
        n = mixed.count()
        best = kept(_best_pairs(mixed, sketched, tried, n), n * TRIES)
        pairs = kept(_untried(best, tried), n * TRIES)
        n_pairs = pairs.count()
        more = stored(_verify(pairs, texts, threshold, n_pairs))
        tried, links = tried.unionByName(best), links.unionByName(more)
        joined = more.count()
        if joined:
            mixed = still_mixed()
        goes_on = joined > ROUND_SHARE * n_pairs
    n = mixed.count()
    last = _last_links(mixed, sketched, tried, texts, threshold, n)
    links = links.unionByName(stored(_in_tasks(last, n, HEAVY_ROWS, 8)))

    members = kept(linkable.join(classes, "digest").groupBy("doc_id", "rep").agg(F.lit(1)).select(
        "doc_id", "rep"), n_rows)
    by_id = members.groupBy("doc_id").agg(F.min("rep").alias("class_id"))
    several = members.join(by_id, "doc_id").filter("rep <> class_id").select(
        F.col("rep").alias("a"), F.col("class_id").alias("b"))
    roots = components(links.unionByName(several))
    by_id = by_id.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left")
    out = rows.select("doc_id").join(by_id, "doc_id", "left")
    class_id = F.coalesce("class_id", "doc_id")
    group_id = F.coalesce("root", class_id)
    return out.select(
        "doc_id", class_id.alias("class_id"), group_id.alias("group_id"),
        group_id.eqNullSafe(F.col("doc_id")).alias("kept"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one document per group, with all their columns."""
    # written, so that Spark knows how few ids they are before it would shuffle the texts
    gone = stored(group(docs, id_col=id_col, text_col=text_col).filter(~F.col("kept")).select(
        F.col("doc_id").alias("gone_id")).distinct())
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")
