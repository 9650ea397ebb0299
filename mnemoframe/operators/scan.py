"""One scan of the memories that scores both retrieval legs for all questions.

Questions are packed in bounded numbers (keywords as an inverted index per scope, vectors
grouped around pivots).  Few questions are one pack that every task gets: a task reads its
memories once, tokenized once, and keeps a running top-k per question and leg over all of its
Arrow batches, and neither the memories nor matching pairs are shuffled.  Where there are more
questions, whole scopes are dealt to parts by a hash, and memories are shuffled once to the part
of their scope: a task takes a part's questions first and then its memories, so the work grows
with the tables and not with their product.  Parts of many memories are cut into cells that each
get the part's questions.  Only a scope that alone has very many questions is still scanned in
rounds.  What leaves a task is at most k rows per question, leg and cell.

The vector leg is exact without scoring all pairs.  The unit vectors of a scope's questions
are grouped around the nearest of about sqrt(n) pivots.  By the triangle inequality on angles
a memory whose angle to a pivot exceeds the group's radius by more than the angle of the worst
score still of use cannot enter any top-k of the group, so the group is left out for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe import constants as C
from mnemoframe.functions.text import tokenize
from mnemoframe.functions.vectors import row_slices
from mnemoframe.operators.groups import in_small_batches, stored

# what a pack needs of a question beside its legs, and the legs by the memories' columns
ASKED = ["query_id", "scope_id", "types", "show_superseded"]
LEGS = {"tokens": "keywords", "embedding": "embedding"}
# scores are rounded before ranking so that summation order never decides a tie
SCORE_DIGITS = 9
# questions of a round: with vectors of 64 doubles and 20 keywords about 16 MB
QUESTIONS_PER_ROUND = 16_384
# memories of a part that meet its questions in one cell
CELL_MEMORIES = 1 << 18
# questions of a scope that are scored pair by pair, all scopes of a batch together
FEW_QUESTIONS = 8
# vector pairs that are scored at once
PAIRS_AT_ONCE = 1 << 15
# (token, question) matches that are counted at once
MATCHES_AT_ONCE = 500_000
# rows waiting for the next cut of a running top-k
PENDING_ROWS = 50_000
# rows of one batch of results
RESULT_ROWS = 10_000


def never_shown() -> Column:
    return F.coalesce(F.col("status").isin(*C.ALWAYS_HIDDEN), F.lit(False))


def distinct_tokens(memories: DataFrame) -> Column:
    """The distinct tokens of the content, from the column ``tokens`` if there is one."""
    if "tokens" in memories.columns:
        return F.array_distinct("tokens")
    return F.array_distinct(tokenize(F.col("content")))


@dataclass
class Group:
    """Questions around a pivot: no member is further from it than ``radius`` (an angle)."""

    pivot: np.ndarray
    radius: float
    members: np.ndarray
    vectors: np.ndarray


@dataclass
class Few:
    """Questions of scopes that have few of them: unit vectors, sorted by scope."""

    first: np.ndarray  # of each scope's questions, and the end
    members: np.ndarray
    vectors: np.ndarray


@dataclass
class Pack:
    """The questions of a round, sorted by scope."""

    query_ids: list
    scopes: list
    scope_of: np.ndarray
    types: list[str]
    allowed: np.ndarray
    shows: np.ndarray
    n_keywords: np.ndarray
    vocabulary: list[str]
    keys: np.ndarray  # scope * len(vocabulary) + token, sorted
    bounds: np.ndarray  # of each key's questions
    asking: np.ndarray
    groups: dict[tuple[int, int], list[Group]]  # by scope and vector length
    few: dict[int, Few]  # by vector length: scopes of few questions, which have no groups


def _lists(column, n: int) -> list:
    return [x or [] for x in column.to_pylist()] if column is not None else [[]] * n


def pivot_groups(vectors: np.ndarray, members: np.ndarray) -> list[Group]:
    """Group unit vectors around about sqrt(n) pivots, each the one furthest from those before."""
    n_pivots = int(np.ceil(np.sqrt(len(vectors))))
    closest = np.full(len(vectors), -2.0)
    nearest = np.zeros(len(vectors), dtype=np.int64)
    pivots = [0]
    for k in range(n_pivots):
        if k:
            pivots.append(int(closest.argmin()))
        cosine = vectors @ vectors[pivots[-1]]
        nearer = cosine > closest
        closest[nearer], nearest[nearer] = cosine[nearer], k
    out = []
    for k, pivot in enumerate(pivots):
        own = np.flatnonzero(nearest == k)
        if len(own):
            radius = float(np.arccos(np.clip(closest[own].min(), -1.0, 1.0)))
            out.append(Group(vectors[pivot], radius, members[own], vectors[own]))
    return out


def unit_rows(flat: np.ndarray, dim: int) -> np.ndarray:
    """Rows of length 1; a zero row stays zero."""
    matrix = np.asarray(flat, dtype=np.float64).reshape(-1, dim)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    norms[norms == 0] = 1.0
    return matrix / norms


def pack_questions(table: pa.Table) -> Pack:
    """Pack the rows query_id, scope_id, types, show_superseded, keywords and/or embedding."""
    n = table.num_rows
    scopes = [s for s in pc.unique(table["scope_id"]).to_pylist() if s is not None]
    number = {s: i for i, s in enumerate(scopes)}
    scope_of = np.array([number.get(s, -1) for s in table["scope_id"].to_pylist()], dtype=np.int64)
    order = np.argsort(scope_of, kind="stable")
    order = order[scope_of[order] >= 0]
    table, scope_of, n = table.take(pa.array(order)), scope_of[order], len(order)
    types = sorted({t for row in _lists(table["types"], n) for t in row if t is not None})
    allowed = np.zeros((n, len(types) + 1), dtype=bool)  # the last column: any other type
    for q, row in enumerate(_lists(table["types"], n)):
        allowed[q, [types.index(t) for t in row if t is not None]] = True
    keywords = _lists(table["keywords"] if "keywords" in table.column_names else None, n)
    vocabulary = sorted({w for row in keywords for w in row})
    place = {w: i for i, w in enumerate(vocabulary)}
    asked = [(scope_of[q] * len(vocabulary) + place[w], q)
             for q, row in enumerate(keywords) for w in row]
    asked.sort()
    codes = np.array([c for c, _ in asked], dtype=np.int64)
    keys, first = np.unique(codes, return_index=True)
    groups: dict[tuple[int, int], list[Group]] = {}
    few: dict[int, Few] = {}
    if "embedding" in table.column_names:
        vectors = table["embedding"].combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths[lengths > 0]).tolist():
            members = np.flatnonzero(lengths == dim)
            flat = pc.list_flatten(vectors.take(pa.array(members))).to_numpy(zero_copy_only=False)
            used = (flat.reshape(-1, dim) != 0).any(axis=1)
            members, unit = members[used], unit_rows(flat, dim)[used]
            sizes = np.bincount(scope_of[members], minlength=len(scopes))
            small = sizes <= FEW_QUESTIONS
            own = small[scope_of[members]]
            begin = np.concatenate([[0], np.cumsum(np.where(small, sizes, 0))])
            few[dim] = Few(begin, members[own], unit[own])
            ends = np.cumsum(sizes)
            for scope in np.flatnonzero(~small):
                rows = slice(ends[scope] - sizes[scope], ends[scope])
                groups[int(scope), dim] = pivot_groups(unit[rows], members[rows])
    return Pack(
        table["query_id"].to_pylist(), scopes, scope_of, types, allowed,
        np.array([bool(x) for x in table["show_superseded"].to_pylist()], dtype=bool),
        np.array([len(row) for row in keywords], dtype=np.int64), vocabulary, keys,
        np.append(first, len(asked)), np.array([q for _, q in asked], dtype=np.int64), groups, few)


class RunningTop:
    """The best ``k`` memories of every question so far: higher scores, then smaller ids.

    Ids are held in UTF-8, whose order is that of the code points, at a byte a character.
    """

    def __init__(self, n_questions: int, k: int):
        self.k = k
        self.floor = np.zeros(n_questions)  # a score below it is of no use
        self.held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, dtype="S1"))
        self.waiting: list[tuple] = []
        self.n_waiting = 0

    def add(self, question: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        useful = (score > 0) & (score >= self.floor[question])
        if useful.any():
            self.waiting.append((question[useful], score[useful], ids[useful]))
            self.n_waiting += int(useful.sum())
            if self.n_waiting > max(PENDING_ROWS, len(self.held[0])):
                self.trim()

    def cut(self) -> tuple:
        """Questions, scores and ids of what is held."""
        question, score, ids = self.trim()
        return question, score, np.char.decode(ids, "utf-8")

    def trim(self) -> tuple:
        if self.waiting:
            question, score, ids = (
                np.concatenate(c) for c in zip(self.held, *self.waiting))
            order = np.lexsort((ids, -score, question))
            question, score, ids = question[order], score[order], ids[order]
            rank = np.arange(len(question)) - np.searchsorted(question, question)
            kept = rank < self.k
            last = rank == self.k - 1
            self.floor[question[last]] = score[last]
            self.held = question[kept], score[kept], ids[kept]
            self.waiting, self.n_waiting = [], 0
        return self.held


class Scan:
    """Scores batches of memories against a pack and keeps the best of both legs."""

    def __init__(self, pack: Pack, k: int):
        self.pack = pack
        self.keyword = RunningTop(len(pack.query_ids), k)
        self.vector = RunningTop(len(pack.query_ids), k)
        self.vocabulary, self.scopes = pa.array(pack.vocabulary, pa.string()), None
        self.scored = self.possible = 0

    def batch(self, batch: pa.RecordBatch) -> None:
        if self.scopes is None:
            self.scopes = pa.array(self.pack.scopes, batch.column("scope_id").type)
        scope = pc.fill_null(pc.index_in(batch.column("scope_id"), self.scopes), -1)
        scope = scope.to_numpy(zero_copy_only=False).astype(np.int64)
        types = pa.array(self.pack.types, pa.string())
        kind = pc.fill_null(pc.index_in(batch.column("mem_type"), types), len(types)).to_numpy(
            zero_copy_only=False)
        superseded = pc.fill_null(pc.equal(batch.column("status"), C.SUPERSEDED), False).to_numpy(
            zero_copy_only=False)
        ids = np.array([str(x).encode() for x in batch.column("mem_id").to_pylist()], dtype=bytes)
        if "tokens" in batch.schema.names and len(self.pack.keys):
            for first, n in row_slices(batch.column("tokens")):
                own = slice(first, first + n)
                self._keywords(batch.column("tokens").slice(first, n), scope[own], kind[own],
                               superseded[own], ids[own])
        if "embedding" in batch.schema.names and self.pack.few:
            self._vectors(batch.column("embedding"), scope, kind, superseded, ids)

    def _visible(self, question, kind, superseded) -> np.ndarray:
        return self.pack.allowed[question, kind] & (self.pack.shows[question] | ~superseded)

    def _keywords(self, tokens, scope, kind, superseded, ids) -> None:
        pack = self.pack
        row = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        token = pc.fill_null(pc.index_in(pc.list_flatten(tokens), self.vocabulary), -1).to_numpy(
            zero_copy_only=False)
        known = (token >= 0) & (scope[row] >= 0)
        row = row[known]
        code = scope[row] * len(pack.vocabulary) + token[known]
        key = np.searchsorted(pack.keys, code)
        hit = key < len(pack.keys)
        hit[hit] = pack.keys[key[hit]] == code[hit]
        row, key = row[hit], key[hit]
        fan = pack.bounds[key + 1] - pack.bounds[key]
        # whole rows at a time, so that the matches of a pair are counted together
        before = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(np.bincount(row, weights=fan, minlength=len(ids)), out=before[1:])
        first = 0
        while first < len(ids) and before[first] < before[-1]:
            end = int(np.searchsorted(before, before[first] + MATCHES_AT_ONCE, side="right")) - 1
            end = max(end, first + 1)
            a, b = np.searchsorted(row, [first, end])
            self._count(row[a:b], key[a:b], fan[a:b], kind, superseded, ids)
            first = end

    def _count(self, row, key, fan, kind, superseded, ids) -> None:
        pack = self.pack
        if not len(row):
            return
        ends = np.cumsum(fan)
        at = np.arange(ends[-1]) - np.repeat(ends - fan, fan) + np.repeat(pack.bounds[key], fan)
        pair, shared = np.unique(
            np.repeat(row, fan) * len(pack.query_ids) + pack.asking[at], return_counts=True)
        row, question = pair // len(pack.query_ids), pair % len(pack.query_ids)
        seen = self._visible(question, kind[row], superseded[row])
        row, question, shared = row[seen], question[seen], shared[seen]
        self.keyword.add(question, shared / pack.n_keywords[question], ids[row])

    def _vectors(self, vectors, scope, kind, superseded, ids) -> None:
        pack = self.pack
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        for dim, few in pack.few.items():
            fitting = np.flatnonzero((sizes == dim) & (scope >= 0))
            if not len(fitting):
                continue
            flat = pc.list_flatten(vectors.take(pa.array(fitting))).to_numpy(zero_copy_only=False)
            unit = unit_rows(flat, dim)
            self._pairs(few, scope, unit, fitting, kind, superseded, ids)
            if not pack.groups:
                continue
            order = np.argsort(scope[fitting], kind="stable")
            own = scope[fitting][order]
            cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            for a, b in zip(cuts, [*cuts[1:], len(own)]):
                for group in pack.groups.get((int(own[a]), dim), ()):
                    rows = order[a:b]
                    self._group(group, unit[rows], fitting[rows], kind, superseded, ids)

    def _pairs(self, few: Few, scope, unit, rows, kind, superseded, ids) -> None:
        first = few.first[scope[rows]]
        fan = few.first[scope[rows] + 1] - first
        ends = np.cumsum(fan)
        at = 0
        while at < len(rows):
            end = int(np.searchsorted(ends, ends[at] - fan[at] + PAIRS_AT_ONCE, side="right"))
            end = max(end, at + 1)
            own = np.repeat(np.arange(at, end), fan[at:end])
            if len(own):
                start = ends[at:end] - fan[at:end]
                number = np.arange(len(own)) - np.repeat(start - start[0], fan[at:end])
                place = np.repeat(first[at:end], fan[at:end]) + number
                scores = np.round(
                    np.einsum("ij,ij->i", unit[own], few.vectors[place]), SCORE_DIGITS)
                self.possible += len(own)
                self.scored += len(own)
                row, question = rows[own], few.members[place]
                seen = self._visible(question, kind[row], superseded[row])
                self.vector.add(question[seen], scores[seen], ids[row[seen]])
            at = end

    def _group(self, group: Group, unit, rows, kind, superseded, ids) -> None:
        cosine = unit @ group.pivot
        floor = float(self.vector.floor[group.members].min())
        reach = min(np.pi, group.radius + float(np.arccos(np.clip(floor, 0.0, 1.0))))
        near = np.flatnonzero(cosine >= np.cos(reach) - 1e-7)
        self.possible += len(rows) * len(group.members)
        self.scored += len(near) * len(group.members)
        if not len(near):
            return
        scores = np.round(unit[near] @ group.vectors.T, SCORE_DIGITS)
        i, j = np.nonzero((scores > 0) & (scores >= self.vector.floor[group.members]))
        row, question = rows[near[i]], group.members[j]
        seen = self._visible(question, kind[row], superseded[row])
        self.vector.add(question[seen], scores[i, j][seen], ids[row[seen]])

    def results(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for leg, top in (("keyword", self.keyword), ("vector", self.vector)):
            pack = self.pack
            held = top.trim()
            for at in range(0, len(held[0]), RESULT_ROWS):
                question, score, ids = (c[at:at + RESULT_ROWS] for c in held)
                yield pa.RecordBatch.from_arrays([
                    pa.array([pack.query_ids[q] for q in question], schema.field("query_id").type),
                    pa.array([pack.scopes[s] for s in pack.scope_of[question]],
                             schema.field("scope_id").type),
                    pa.array([x.decode() for x in ids.tolist()], pa.string()),
                    pa.array([leg] * len(ids), pa.string()), pa.array(score)], names=schema.names)


def _rounds(asked: DataFrame, per_round: int) -> Iterator[tuple[pa.Table, bool]]:
    """The questions in rounds of about ``per_round``, neighbouring scopes together, and
    whether there is one round only."""
    head = asked.limit(per_round + 1).toArrow()
    if head.num_rows <= per_round:
        if head.num_rows:
            yield head, True
        return
    n_rounds = -(-asked.count() // per_round)
    parts = stored(asked.repartitionByRange(n_rounds, "scope_id", "query_id").withColumn(
        "_round", F.spark_partition_id()))
    for k in range(n_rounds):
        part = parts.filter(F.col("_round") == k).drop("_round").toArrow()
        if part.num_rows:
            yield part, False


def _scan_parts(columns: list[str], k: int, schema: pa.Schema, counted=None):
    """Packs the questions of each part and cell as they come, then scans its memories."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, questions, work = None, [], None
        for batch in batches:
            part, cell, asked = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("_part", "_cell", "_asked"))
            cuts = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (cell[1:] != cell[:-1])
                                            | (asked[1:] != asked[:-1])))
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                rows = batch.slice(a, b - a)
                if (part[a], cell[a]) != key:
                    if work is not None:
                        yield from _finished(work, counted, schema)
                    key, questions, work = (part[a], cell[a]), [], None
                if asked[a]:
                    questions.append(rows.select([*ASKED, *columns]))
                elif questions or work is not None:
                    if work is None:
                        table = pa.Table.from_batches(questions)
                        work, questions = Scan(pack_questions(table.rename_columns(
                            [*ASKED, *[LEGS[c] for c in columns]])), k), []
                    work.batch(rows)
        if work is not None:
            yield from _finished(work, counted, schema)

    return scan


def _finished(work: Scan, counted, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if counted is not None:
        counted[0].add(work.scored)
        counted[1].add(work.possible)
    yield from work.results(schema)


def _best_of_parts(
    shown: DataFrame, asked: DataFrame, columns: list[str], k: int, per_round: int,
    schema: str, arrow: pa.Schema, counted=None, cell_memories: int = CELL_MEMORIES,
) -> DataFrame:
    """All scopes at once: memories and questions are shuffled to the part of their scope."""
    # half full on average, so that an uneven hash does not overfill one; enough for all cores
    n_parts = max(-(-asked.count() // max(1, per_round // 2)),
                  4 * asked.sparkSession.sparkContext.defaultParallelism)
    part = F.pmod(F.xxhash64("scope_id"), F.lit(n_parts)).alias("_part")
    placed = shown.select("*", part)
    # one row per part
    cells = placed.groupBy("_part").agg(
        F.ceil(F.count("*") / cell_memories).cast("int").alias("_cells"))
    cells = F.broadcast(stored(cells))
    none = {c: F.lit(None).cast(t) for c, t in (*asked.dtypes, *shown.dtypes)}
    layout = ["_part", "_cell", "_asked", *ASKED, *columns, "mem_id", "mem_type", "status"]
    questions = asked.select("*", part).join(cells, "_part").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)).alias("_cell"),
        F.lit(True).alias("_asked"), *[F.col(LEGS[c]).alias(c) for c in columns if LEGS[c] != c],
        *[none[c].alias(c) for c in ("mem_id", "mem_type", "status")]).select(*layout)
    memories = placed.join(cells, "_part").select(
        "*", F.pmod(F.xxhash64("mem_id"), F.col("_cells")).cast("int").alias("_cell"),
        F.lit(False).alias("_asked"),
        *[none[c].alias(c) for c in ASKED if c != "scope_id"]).select(*layout)
    together = questions.unionByName(memories).repartition(
        n_parts, "_part", "_cell").sortWithinPartitions(
        "_part", "_cell", F.desc("_asked"), "scope_id")
    return together.mapInArrow(_scan_parts(columns, k, arrow, counted), schema)


def best_of_tasks(
    memories: DataFrame, plans: DataFrame, k: int, keyword: bool = True, vector: bool = True,
    per_round: int = QUESTIONS_PER_ROUND, counted=None, cell_memories: int = CELL_MEMORIES,
) -> DataFrame:
    """query_id, scope_id, mem_id, leg and score: every task's best ``k`` of each question and leg.

    ``counted`` is a pair of accumulators for the vector pairs scored and those possible.
    """
    legs = [name for name, on in (("keywords", keyword), ("embedding", vector)) if on]
    asked = plans.select("query_id", "scope_id", "types", "show_superseded", *legs)
    content = F.col("content")
    stored_columns = ["scope_id", "mem_id", "mem_type", "status"]
    if keyword:
        stored_columns.append(distinct_tokens(memories).alias("tokens"))
    if vector:
        stored_columns.append(F.col("embedding").cast("array<double>").alias("embedding"))
    shown = in_small_batches(memories).filter(~never_shown() & (F.coalesce(content, F.lit("")) != ""))
    fields = dict(asked.dtypes) | {"leg": "string", "mem_id": "string", "score": "double"}
    schema = ", ".join(
        f"{c} {fields[c]}" for c in ("query_id", "scope_id", "mem_id", "leg", "score"))
    arrow = pa.schema([(c, pa.int64() if fields[c] == "bigint" else pa.int32()
                        if fields[c] == "int" else pa.float64() if c == "score"
                        else pa.string())
                       for c in ("query_id", "scope_id", "mem_id", "leg", "score")])
    context = memories.sparkSession.sparkContext
    shown = shown.select(*stored_columns)
    found = []

    def by_rounds(rounds: Iterator[tuple[pa.Table, bool]]) -> None:
        for table, only in rounds:
            # a round is bounded, see QUESTIONS_PER_ROUND
            pack = context.broadcast(pack_questions(table))

            def scan(batches: Iterator[pa.RecordBatch], pack=pack) -> Iterator[pa.RecordBatch]:
                work = Scan(pack.value, k)
                for batch in batches:
                    work.batch(batch)
                yield from _finished(work, counted, arrow)

            bounds = pc.min_max(table["scope_id"]).as_py()
            if bounds["min"] is None:
                continue
            own = shown.filter(
                F.col("scope_id").between(F.lit(bounds["min"]), F.lit(bounds["max"])))
            best = own.mapInArrow(scan, schema)
            found.append(best if only else stored(best))

    head = asked.limit(per_round + 1).toArrow()
    if head.num_rows <= per_round:
        by_rounds([(head, True)] if head.num_rows else [])
    else:
        asked, shown = stored(asked.filter("scope_id is not null")), shown.filter("scope_id is not null")
        # at most four of these per round of questions
        large = stored(asked.groupBy("scope_id").agg(F.count("*").alias("n")).filter(
            F.col("n") > per_round // 4).select(F.col("scope_id").alias("_large")))
        if large.isEmpty():
            few, others = asked, shown
        else:
            known = F.broadcast(large), F.col("scope_id") == F.col("_large")
            by_rounds(_rounds(asked.join(*known, "left_semi"), per_round))
            few, others = asked.join(*known, "left_anti"), shown.join(*known, "left_anti")
        columns = [c for c, on in (("tokens", keyword), ("embedding", vector)) if on]
        found.append(_best_of_parts(
            others, few, columns, k, per_round, schema, arrow, counted, cell_memories))
    if not found:
        return memories.sparkSession.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
