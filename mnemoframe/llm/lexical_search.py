"""Ranked lexical search of many items at once, sharing what their term sets have in common.

A term is a maximal stretch of ASCII letters and digits and of all characters beyond ASCII,
with A-Z lower-cased.  A document scores, for an item, the sum over the item's terms (repeats
included) of the term's weight times its saturated frequency in the document.

Items are evaluated by common subexpressions.  The term sets of a block of items are mined for
pairs that several items share, the most shared first; a mined pair becomes a node that other
pairs may hold in turn.  The result is a graph that items share: its leaves are terms, an
inner node sums two nodes, and an item sums the few nodes that are left of it.  For a block of
documents every node that is needed is materialised once, as one accumulator over the block's
documents, and is given up after its last use.

Steps, all in Spark: mine the blocks of items (one task each); read the documents once, keeping
of each document its number of terms and the frequencies of the items' terms; add up document
frequencies; run the stored frequencies through the graphs, each task keeping the best ``k``
documents of each item; merge the best of all tasks.  Only the graphs and the frequencies of
their terms reach the driver.  They are bounded: a round takes blocks up to ``SCAN_BYTES`` of
item texts, and more items take more rounds over the documents.

Null texts have no terms.  Every row of documents and of items counts by itself, also under an
id that repeats; of equal scores and ids either row may be named.  Null ids rank last among
equal scores.  An item without terms, or without a document that scores above 0, has no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from mnemoframe.llm.rows import in_small_batches
from mnemoframe.operators.groups import stored, top_k

# texts of items that are mined together, and that one round over the documents takes at most
MINE_BYTES = 1 << 16
SCAN_BYTES = 1 << 24
# terms of an item that are paired with one another; a longer item is mined in parts
PART_TERMS = 64
# documents that one accumulator covers
BLOCK_DOCS = 1024
# bytes of a long text that are cut into terms at once
CHUNK_BYTES = 1 << 20

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256))
PLAN_SCHEMA = (
    "block long, item_id array<long>, terms array<binary>, leaf array<long>, times array<long>, "
    "left array<long>, right array<long>, sums array<array<long>>")
POSTING_SCHEMA = "doc_id long, n long, terms array<int>, counts array<long>"


def term_counts(text: bytes) -> Counter:
    """How often each term occurs in a text."""
    out: Counter = Counter()
    at = 0
    while at < len(text):
        part = text[at:at + CHUNK_BYTES].translate(_FOLD)
        end = at + len(part)
        if end < len(text):  # carry a term that the chunk cuts over to its end
            cut = part.rfind(b" ") + 1
            if cut:
                part, end = part[:cut], at + cut
            else:
                rest = re.search(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", text[end:])
                end = end + rest.start() if rest else len(text)
                part = text[at:end].translate(_FOLD)
        out.update(part.split())
        at = end
    return out


@dataclass
class SharedSums:
    """The graph of a block of items.  Nodes are numbered, leaves first.

    Leaf k stands for ``times[k]`` copies of term ``leaf[k]``; node len(leaf) + k sums the
    nodes ``left[k]`` and ``right[k]``; item i sums the nodes ``sums[i]``.
    """

    leaf: list
    times: list[int]
    left: list[int]
    right: list[int]
    sums: list[list[int]]


def mine(items: list[Counter], part_terms: int = PART_TERMS) -> SharedSums:
    """Share the sums of pairs of terms, and of sums, that at least two items need."""
    spread = Counter((t, n) for item in items for t, n in item.items())
    leaves = sorted(spread, key=lambda x: (-spread[x], x))
    number = {x: k for k, x in enumerate(leaves)}
    # frequent terms first, so that parts of different items hold the same terms
    held = [sorted(number[x] for x in item.items()) for item in items]
    parts = [set(own[at:at + part_terms]) for own in held for at in range(0, len(own), part_terms)]
    owner = [i for i, own in enumerate(held) for _ in range(0, len(own), part_terms)]
    users: dict[tuple[int, int], set[int]] = defaultdict(set)
    for p, part in enumerate(parts):
        own = sorted(part)
        for k, a in enumerate(own):
            for b in own[k + 1:]:
                users[a, b].add(p)
    heap = [(-len(ps), pair) for pair, ps in users.items() if len(ps) > 1]
    heapify(heap)
    left: list[int] = []
    right: list[int] = []
    while heap:
        size, (a, b) = heappop(heap)
        now = [p for p in users.pop((a, b), ()) if a in parts[p] and b in parts[p]]
        if len(now) < 2:
            continue
        if len(now) < -size:  # some items have used a or b elsewhere since
            users[a, b] = set(now)
            heappush(heap, (-len(now), (a, b)))
            continue
        node = len(leaves) + len(left)
        left.append(a)
        right.append(b)
        near: dict[int, set[int]] = defaultdict(set)
        for p in now:
            parts[p] -= {a, b}
            for x in parts[p]:
                near[x].add(p)
            parts[p].add(node)
        for x, ps in near.items():
            if len(ps) > 1:
                users[x, node] = ps
                heappush(heap, (-len(ps), (x, node)))
    sums: list[list[int]] = [[] for _ in items]
    for i, part in zip(owner, parts):
        sums[i] += sorted(part)
    return SharedSums([t for t, _ in leaves], [n for _, n in leaves], left, right, sums)


def plan_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per block of items: its terms and its graph."""
    size = F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    total = items.agg(F.sum(size)).first()[0] or 0
    n_blocks = max(1, -(-total // MINE_BYTES))

    def mined(group: pd.DataFrame) -> pd.DataFrame:
        counted = [term_counts((t or "").encode()) for t in group["text"].tolist()]
        graph = mine(counted)
        terms = sorted(set(graph.leaf))
        place = {t: k for k, t in enumerate(terms)}
        ids = [None if pd.isna(x) else int(x) for x in group["item_id"].tolist()]
        return pd.DataFrame({
            "block": [int(group["block"].iloc[0])], "item_id": [ids], "terms": [terms],
            "leaf": [[place[t] for t in graph.leaf]], "times": [graph.times],
            "left": [graph.left], "right": [graph.right], "sums": [graph.sums]})

    # a block holds about MINE_BYTES of items, whatever their number
    block = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_blocks))
    narrow = items.select(
        F.col(id_col).cast("long").cast("decimal(20,0)").alias("item_id"),
        F.col(text_col).cast("string").alias("text"), block.cast("long").alias("block"))
    return narrow.groupBy("block").applyInPandas(mined, PLAN_SCHEMA)


class Accumulators:
    """Scores of a block of documents for the items of one graph, node by node."""

    def __init__(self, plan: Row, term_number: dict[bytes, int]):
        terms = [term_number[bytes(t)] for t in plan["terms"]]
        self.leaf = [terms[k] for k in plan["leaf"]]
        self.times = list(plan["times"])
        self.pairs = list(zip(plan["left"], plan["right"]))
        self.sums = plan["sums"]
        self.uses = np.zeros(len(self.leaf) + len(self.pairs), dtype=np.int64)
        for users in [*self.pairs, *self.sums]:
            for node in users:
                self.uses[node] += 1

    def items(self, gains: dict[int, tuple[np.ndarray, np.ndarray]], n_docs: int):
        """Yield (item, scores) of the items that any document scores for.

        ``gains`` has of each term the documents that hold it and what one copy adds to them.
        A node is None where no document of the block holds any of its terms.
        """
        first = len(self.leaf)
        value: dict[int, np.ndarray] = {}
        left = self.uses.copy()

        def take(node: int) -> np.ndarray | None:
            if node < first and node not in value and self.leaf[node] in gains:
                docs, gain = gains[self.leaf[node]]
                value[node] = np.zeros(n_docs, dtype=np.int64)
                value[node][docs] = gain * self.times[node]
            left[node] -= 1
            return value.get(node) if left[node] else value.pop(node, None)

        for k, (a, b) in enumerate(self.pairs):
            held = [x for x in (take(a), take(b)) if x is not None]
            if held:
                value[first + k] = held[0] + held[1] if len(held) > 1 else held[0]
        for item, nodes in enumerate(self.sums):
            held = [x for x in map(take, nodes) if x is not None]
            if held:
                yield item, sum(held[1:], held[0])


def _frequencies(number: dict[bytes, int]):
    """Of each document its terms (with repeats) and how often it holds the numbered ones."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
            sizes, terms, counts = [], [], []
            for row in range(len(texts)):
                own = term_counts(texts[row].as_py())
                sizes.append(own.total())
                found = [(number[t], c) for t, c in own.items() if t in number]
                terms.append([t for t, _ in found])
                counts.append([c for _, c in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "counts"])

    return counted


# rows of the corpus statistics that stand for no term
DOCUMENTS, TERMS = -1, -2


def _statistics(n_terms: int):
    """Documents per term, documents with terms, and terms with repeats, summed per task."""
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents, total = np.zeros(n_terms, dtype=np.int64), 0, 0
        for batch in batches:
            df += np.bincount(pc.list_flatten(batch.column("terms")), minlength=n_terms)
            documents += pc.sum(pc.greater(batch.column("n"), 0)).as_py() or 0
            total += pc.sum(batch.column("n")).as_py() or 0
        yield pa.RecordBatch.from_arrays(
            [pa.array([*range(n_terms), DOCUMENTS, TERMS], pa.int32()),
             pa.array([*df.tolist(), documents, total], pa.int64())], names=["term", "n"])

    return added


class Best:
    """The best ``k`` documents of one item so far."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.score = np.zeros(0, dtype=np.int64)
        self.doc = np.zeros(0, dtype=np.int64)
        self.no_id = np.zeros(0, dtype=bool)

    def add(self, scores: np.ndarray, docs: np.ndarray, no_id: np.ndarray) -> None:
        hit = np.flatnonzero(scores >= self.floor)
        if not len(hit):
            return
        score = np.concatenate([self.score, scores[hit]])
        doc = np.concatenate([self.doc, docs[hit]])
        null = np.concatenate([self.no_id, no_id[hit]])
        first = np.lexsort((doc, null, -score))[:self.k]
        self.score, self.doc, self.no_id = score[first], doc[first], null[first]
        if len(first) == self.k:
            self.floor = max(1, int(self.score[-1]))


def _scores(plans: list[Row], number: dict[bytes, int], weight: np.ndarray, n_docs: int,
            n_terms: int, k: int):
    """Best documents of a task for every item."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs = [Accumulators(plan, number) for plan in plans]
        best: dict[tuple[int, int], Best] = {}
        for batch in batches:
            for at in range(0, len(batch), BLOCK_DOCS):
                part = batch.slice(at, BLOCK_DOCS)
                gains = _gains(part, weight, n_docs, n_terms)
                docs = pc.fill_null(part.column("doc_id"), 0).to_numpy()
                no_id = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                for g, graph in enumerate(graphs):
                    for item, scores in graph.items(gains, len(part)):
                        if (g, item) not in best:
                            best[g, item] = Best(k)
                        best[g, item].add(scores, docs, no_id)
        for (g, item), held in best.items():
            n = len(held.score)
            yield pa.RecordBatch.from_arrays(
                [pa.array([plans[g]["block"]] * n, pa.int64()), pa.array([item] * n, pa.int64()),
                 pa.array([plans[g]["item_id"][item]] * n, pa.int64()),
                 pa.array(held.doc, pa.int64(), mask=held.no_id), pa.array(held.score, pa.int64())],
                names=["block", "item", "item_id", "doc_id", "score"])

    return found


def _gains(part: pa.RecordBatch, weight: np.ndarray, n_docs: int, n_terms: int) -> dict:
    """Of each term in some documents: the documents that hold it, and what it adds to each."""
    terms = pc.list_flatten(part.column("terms")).to_numpy()
    if not len(terms):
        return {}
    tf = pc.list_flatten(part.column("counts")).to_numpy()
    sizes = pc.list_value_length(part.column("terms")).to_numpy()
    doc = np.repeat(np.arange(len(part)), sizes)
    m = 25 + (75 * n_docs * part.column("n").to_numpy()) // n_terms
    gain = weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    order = np.argsort(terms, kind="stable")
    terms, doc, gain = terms[order], doc[order], gain[order]
    cuts = [0, *(np.flatnonzero(terms[1:] != terms[:-1]) + 1).tolist(), len(terms)]
    return {
        int(terms[a]): (doc[a:b], gain[a:b]) for a, b in zip(cuts, cuts[1:]) if gain[a:b].any()}


def _round(docs: DataFrame, plans: DataFrame, k: int) -> DataFrame:
    """Best documents per task of the items of some blocks: block, item, item_id, doc_id, score."""
    held = plans.orderBy("block").collect()  # at most about SCAN_BYTES of terms
    number = {t: i for i, t in enumerate(sorted({bytes(t) for p in held for t in p["terms"]}))}
    rows = stored(docs.mapInArrow(_frequencies(number), POSTING_SCHEMA))
    counted = {r["term"]: r["n"] for r in rows.mapInArrow(
        _statistics(len(number)), "term int, n long").groupBy("term").agg(
        F.sum("n").alias("n")).collect()}  # one row per term of these items
    n_docs, n_terms = counted.get(DOCUMENTS, 0), counted.get(TERMS, 0)
    weight = np.array([
        math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counted.get(t, 0) + 1)))
        for t in range(len(number))], dtype=np.int64)
    return rows.mapInArrow(
        _scores(held, number, weight, n_docs, max(1, n_terms), k),
        "block long, item long, item_id long, doc_id long, score long")


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` best documents of each item."""
    spark = docs.sparkSession
    plans = stored(plan_items(items, item_col, item_text_col))
    heads = [(r["block"], r["n"]) for r in plans.select(
        "block", F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t))
        .alias("n")).orderBy("block").collect()]
    narrow = in_small_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    best, round_blocks, held = [], [], 0
    for block, n in [*heads, (None, SCAN_BYTES)]:
        if round_blocks and held + n > SCAN_BYTES:
            best.append(_round(narrow, plans.filter(F.col("block").isin(round_blocks)), k))
            round_blocks, held = [], 0
        round_blocks.append(block)
        held += n
    if not best:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    merged = best[0]
    for more in best[1:]:
        merged = merged.unionByName(more)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # one row of ``item`` per row of the items, so that repeated ids stay apart
    return top_k(merged, ["block", "item"], order, k).select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
