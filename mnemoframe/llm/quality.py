"""Quality scores learned from preferences (Bradley-Terry).

Every text becomes a short vector of its own measures: shares of character classes, word
lengths, repetition of words and of runs of words.  Preference pairs are made of labelled
documents, the better one first; a pair's logistic loss on the difference of the two vectors
teaches one weight per measure, where each measure is cut into ranges at its quantiles so
that too little and too much can both be bad.  The threshold is the quantile of the training
scores below which the training share of rejected documents lies; it is mapped to the score
``cut``.

Training reads every labelled document: quantiles, pairs and threshold are over all of them.
Each document of the commoner kind is in a pair at least once, those of the rarer kind take
turns, so the pairs grow with the documents and no faster.  Quantiles come from counts of
values shortened to 12 bits of their mantissa, and Newton's sums are of whole numbers, so the
ranking is the same however the rows are spread; only the sums reach the driver.  Null and
empty texts have a vector and a score as well.  Labels that are null or contradict one another
for one id are not learned from.  Without both kinds of labels every text scores ``cut``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.arrays import Words, per_row, row_blocks, utf8, words
from mnemoframe.llm.rows import in_small_batches
from mnemoframe.operators.groups import by_shuffle, number_in_group, stored

CLASSES = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz",
    "digit": "0123456789", "space": " \t", "line": "\n\r", "stop": ".", "comma": ",;:",
    "call": "!?", "sign": "#$%&*@^~+=<>/\\_", "bar": "|", "bracket": "()[]{}", "quote": "'\"`-",
}
MEASURES = [
    "chars", "words", *CLASSES, "beyond_ascii", "word_length", "long_words", "distinct", "adjacent",
    "top_word", "distinct_2", "distinct_5", "words_per_line", "words_per_stop", "words_per_sign",
]
RANGES = 12
# pairs that few documents are put into at least, if they have so many
MIN_PAIRS = 60_000
# whole numbers that make 1 in Newton's sums, and in raw scores when their quantile is sought
SCALE, GRADES = 1 << 20, 1 << 12


def _table(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars.encode())] = True
    return table


_TABLES = {name: _table(chars) for name, chars in CLASSES.items()}


def _distinct(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values per row, and how often the most frequent one occurs."""
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(v)))
    most = np.zeros(n_rows, dtype=np.int64)
    np.maximum.at(most, r[at], runs)
    return np.bincount(r[at], minlength=n_rows), most


def _measures(w: Words, offsets: np.ndarray) -> np.ndarray:
    """One row of measures per text of a block."""
    n = len(offsets) - 1
    at_least = lambda x: np.maximum(x, 1)
    chars = per_row((w.data & 0xC0) != 0x80, offsets)
    n_words = np.diff(w.bounds)
    rows = np.repeat(np.arange(n), n_words)
    counts = {name: per_row(table[w.data], offsets) for name, table in _TABLES.items()}
    length = w.ends - w.starts
    distinct, most = _distinct(w.hashes, rows, n)

    def runs(size: int) -> np.ndarray:
        """Share of distinct runs of some words."""
        if len(w.hashes) < size:
            return np.ones(n)
        value = w.hashes[:len(w.hashes) - size + 1].copy()
        for k in range(1, size):
            value = value * np.uint64(0x9E3779B97F4A7C15) + w.hashes[k:len(w.hashes) - size + 1 + k]
        whole = rows[:len(value)] == rows[size - 1:]
        of = rows[:len(value)][whole]
        total = np.bincount(of, minlength=n)
        return np.where(total, _distinct(value[whole], of, n)[0] / at_least(total), 1.0)

    same = np.zeros(len(rows), dtype=bool)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (rows[1:] == rows[:-1])
    columns = [
        np.log1p(chars), np.log1p(n_words), *(counts[c] / at_least(chars) for c in CLASSES),
        per_row(w.data >= 0xC0, offsets) / at_least(chars),
        per_row(length, w.bounds) / at_least(n_words),
        per_row(length > 24, w.bounds) / at_least(n_words), distinct / at_least(n_words),
        per_row(same, w.bounds) / at_least(n_words), most / at_least(n_words), runs(2), runs(5),
        np.log1p(n_words / at_least(counts["line"])), np.log1p(n_words / at_least(counts["stop"])),
        np.log1p((counts["sign"] + counts["bar"]) / at_least(n_words)),
    ]
    return np.column_stack(columns)


def measures(texts: pa.Array) -> np.ndarray:
    """The vector of every text."""
    data, offsets = utf8(texts)
    parts = [np.zeros((0, len(MEASURES)))]
    for row, end in row_blocks(offsets):
        own = offsets[row:end + 1]
        own, piece = own - own[0], data[own[0]:own[-1]]
        parts.append(_measures(words(piece, own), own))
    return np.concatenate(parts)


@dataclass
class Ranking:
    """Weights of the measures' ranges, and the raw score that maps to ``cut``."""

    edges: np.ndarray
    weights: np.ndarray
    threshold: float
    cut: float

    def ranges(self, x: np.ndarray) -> np.ndarray:
        """Place of every measure among all ranges of all measures."""
        at = np.column_stack(
            [np.searchsorted(self.edges[j], x[:, j], side="right") for j in range(x.shape[1])])
        return at + np.arange(x.shape[1]) * RANGES

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.ranges(x)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(
            self.raw(x) - self.threshold + np.log(self.cut / (1 - self.cut)), -50, 50)))


def _short(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the measures (none is negative), 12 bits of mantissa each."""
    return (x.astype(np.float32).view(np.int32) >> 12).astype(np.int64)


def _long(short: np.ndarray) -> np.ndarray:
    return (np.asarray(short, dtype=np.int64) << 12).astype(np.int32).view(np.float32).astype(float)


def _at_levels(values: np.ndarray, counts: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The smallest values that at least the given shares of the counted rows do not exceed."""
    order = np.argsort(values)
    upto = np.cumsum(counts[order])
    at = np.searchsorted(upto, np.ceil(levels * upto[-1]), side="left")
    return values[order][np.minimum(at, len(order) - 1)]


def _edges(better: list, worse: list) -> np.ndarray:
    """Borders of the ranges, from the (values, counts) that either kind has of each measure.

    Both kinds alike, so that ranges lie where the rarer kind lies, too.
    """
    first = np.linspace(0, 1, (RANGES + 1) // 2 + 1)[1:-1]
    second = np.linspace(0, 1, RANGES - len(first) + 1)[1:-1]
    return np.array([np.sort(_long(np.concatenate([
        _at_levels(*b, first), _at_levels(*w, second)]))) for b, w in zip(better, worse)])


def _turns(n_better: int, n_worse: int) -> tuple[int, int]:
    """How often each document of the commoner kind is paired, and the step between partners."""
    many, few = max(n_better, n_worse), min(n_better, n_worse)
    turns = min(few, -(-MIN_PAIRS // many))
    return turns, few // turns


def _sums(better: np.ndarray, worse: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Gradient and curvature of pairs, one after the other, as whole numbers of 1/SCALE."""
    size = len(weights)
    gradient, curve = np.zeros(size), np.zeros((size, size))
    for at in range(0, len(better), 4096):
        up, down = better[at:at + 4096], worse[at:at + 4096]
        d = np.zeros((len(up), size))
        row = np.arange(len(up))[:, None]
        d[row, up] += 1
        d[row, down] -= 1
        margin = weights[up].sum(axis=1) - weights[down].sum(axis=1)
        p = 1 / (1 + np.exp(np.clip(margin, -50, 50)))  # chance of the wrong order
        gradient += d.T @ np.rint(p * SCALE)
        curve += (d * np.rint(p * (1 - p) * SCALE)[:, None]).T @ d
    return np.concatenate([gradient, curve.ravel()]).astype(np.int64)


def _newton(sums: Callable[[np.ndarray], np.ndarray], ridge: float) -> np.ndarray:
    """Weights of least loss, where ``sums`` adds up ``_sums`` over all pairs."""
    size = len(MEASURES) * RANGES
    weights = np.zeros(size)
    for _ in range(12):
        found = sums(weights) / SCALE
        gradient = ridge * weights - found[:size]
        step = np.linalg.solve(ridge * np.eye(size) + found[size:].reshape(size, size), gradient)
        weights -= step
        if np.abs(step).max() < 1e-4:
            break
    return weights


def _nothing(cut: float) -> Ranking:
    return Ranking(
        np.zeros((len(MEASURES), RANGES - 1)), np.zeros(len(MEASURES) * RANGES), 0.0, cut)


def learn(x: np.ndarray, good: np.ndarray, cut: float = 0.3, ridge: float = 5.0) -> Ranking:
    """The ranking of vectors at hand: what ``train`` does, without Spark.

    Partners follow from the order of the rows.
    """
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(better) or not len(worse):
        return _nothing(cut)
    model = _nothing(cut)
    model.edges = _edges(*(
        [np.unique(v, return_counts=True) for v in _short(x[rows]).T] for rows in (better, worse)))
    places = model.ranges(x)
    turns, step = _turns(len(better), len(worse))
    many, few = (better, worse) if len(better) >= len(worse) else (worse, better)
    own = np.tile(many, turns)
    other = few[(np.arange(len(many)) + np.arange(turns)[:, None] * step).ravel() % len(few)]
    first, second = (own, other) if many is better else (other, own)
    model.weights = _newton(lambda w: _sums(places[first], places[second], w), ridge)
    model.threshold = float(_at_levels(
        *np.unique(_graded(model, x), return_counts=True), np.array([len(worse) / len(x)]))[0] / GRADES)
    return model


def _graded(model: Ranking, x: np.ndarray) -> np.ndarray:
    return np.floor(model.raw(x) * GRADES).astype(np.int64)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether an id is kept from training: by the CRC-32 of its decimal text."""
    return F.coalesce(
        F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def clear_labels(labels: DataFrame, label: str, learnable: Column) -> DataFrame:
    """label_id and good of every id that may be learned from and has one label only.

    ``learnable`` is over the labels' ``doc_id``.
    """
    return (
        labels.filter(learnable & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.min(label).alias("low"), F.max(label).alias("high"))
        .filter("low = high").select(F.col("doc_id").alias("label_id"), (F.col("low") == 1).alias("good"))
    )


def labelled(
    docs: DataFrame, labels: DataFrame, label: str, learnable: Column, max_labels: int
) -> DataFrame:
    """Text and label of at most ``max_labels`` labelled documents, first by hash of their id.

    The chosen ids are few by that bound.
    """
    clear = clear_labels(labels, label, learnable)
    chosen = clear.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labels)
    return docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select(
        "doc_id", "text", "good")


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = measures(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), _lists(x, pa.float64())], names=["doc_id", "x"])


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = pa.array(rows.ravel(), kind)
    return pa.FixedSizeListArray.from_arrays(flat, rows.shape[1]).cast(pa.list_(kind))


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(pc.list_flatten(lists).to_numpy(zero_copy_only=False)).reshape(
        -1, len(MEASURES))


def _counts(rows: DataFrame, keys: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Distinct rows of whole numbers that ``keys`` makes of (x, good), the count last."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            found, n = np.unique(keys(_matrix(batch.column("x")), good), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (*found.T, n)], names=["kind", "measure", "value", "n"])

    totals = rows.mapInArrow(counted, "kind long, measure long, value long, n long").groupBy(
        "kind", "measure", "value").agg(F.sum("n").alias("n")).toArrow()
    return np.column_stack([c.to_numpy() for c in totals.columns])


def _by_measure(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    kind, measure = np.broadcast_arrays(good[:, None], np.arange(x.shape[1]))
    return np.column_stack([kind.ravel(), measure.ravel(), _short(x).ravel()]).astype(np.int64)


def _pairs(rows: DataFrame, model: Ranking, n_better: int, n_worse: int) -> DataFrame:
    """``better`` and ``worse`` (places of the ranges) of all pairs, partners by number."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([
                batch.column("number"), batch.column("good"),
                _lists(model.ranges(_matrix(batch.column("x"))), pa.int16())],
                names=["number", "good", "places"])

    numbered = number_in_group(rows, ["good"], [F.col("doc_id"), F.col("x")], "number")
    places = stored(numbered.select("number", "good", "x").mapInArrow(
        placed, "number long, good boolean, places array<short>"))
    turns, step = _turns(n_better, n_worse)
    more_good = n_better >= n_worse
    many = places.filter(F.col("good") == more_good).select(
        F.col("places").alias("own"), F.explode(F.transform(
            F.sequence(F.lit(0), F.lit(turns - 1)),
            lambda t: (F.col("number") - 1 + t * step) % min(n_better, n_worse))).alias("partner"))
    few = places.filter(F.col("good") != more_good).select(
        (F.col("number") - 1).alias("partner"), F.col("places").alias("other"))
    better, worse = ("own", "other") if more_good else ("other", "own")
    return stored(many.join(by_shuffle(few), "partner").select(
        F.col(better).alias("better"), F.col(worse).alias("worse")))


def _summed(pairs: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """``_sums`` over all pairs: each task adds up its own, Spark the tasks."""
    size = len(MEASURES) * RANGES

    def total(weights: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(size + size * size, dtype=np.int64)
            for batch in batches:
                sums += _sums(
                    _matrix(batch.column("better")), _matrix(batch.column("worse")), weights)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(sums[at])], names=["at", "value"])

        rows = pairs.mapInArrow(part, "at long, value long").groupBy("at").agg(
            F.sum("value").alias("value")).toArrow()
        sums = np.zeros(size + size * size)
        sums[rows["at"].to_numpy()] = rows["value"].to_numpy()
        return sums

    return total


def train(
    docs: DataFrame, labels: DataFrame, learnable: Column, label: str = "quality",
    cut: float = 0.3, ridge: float = 5.0,
) -> Ranking:
    """A ranking learned from all labelled documents; ``docs`` has doc_id and text.

    Vectors are joined with the labels, so no text is shuffled.  Partners follow from the order
    of ids and measures, not from how the rows are spread over files and tasks.
    """
    clear = clear_labels(labels, label, learnable)
    vectors = docs.filter("doc_id is not null").mapInArrow(_vectors, "doc_id long, x array<double>")
    rows = stored(vectors.join(
        by_shuffle(clear), F.col("doc_id") == F.col("label_id")).select("doc_id", "x", "good"))
    sizes = {r["good"]: r["count"] for r in rows.groupBy("good").count().collect()}
    n_better, n_worse = sizes.get(True, 0), sizes.get(False, 0)
    model = _nothing(cut)
    if not n_better or not n_worse:
        return model
    seen = _counts(rows, _by_measure)
    of = lambda kind, m: seen[(seen[:, 0] == kind) & (seen[:, 1] == m), 2:].T
    model.edges = _edges(*([of(k, m) for m in range(len(MEASURES))] for k in (1, 0)))
    model.weights = _newton(_summed(_pairs(rows, model, n_better, n_worse)), ridge)
    grades = _counts(rows, lambda x, good: np.column_stack(
        [np.zeros((len(x), 2), dtype=np.int64), _graded(model, x)]))
    model.threshold = float(_at_levels(
        grades[:, 2], grades[:, 3], np.array([n_worse / (n_better + n_worse)]))[0] / GRADES)
    return model


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """Add ``score`` (0 to 1) to doc_id; one row per document."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.score(measures(batch.column("text"))))],
                names=["doc_id", "score"])

    return narrow(docs).mapInArrow(scored, "doc_id long, score double")


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return in_small_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def keep(docs: DataFrame, model: Ranking, text_col: str = "text") -> DataFrame:
    """The rows that score at least ``cut``, with all their columns, in one pass."""

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(measures(texts)) >= model.cut)

    return in_small_batches(docs).filter(good(F.col(text_col).cast("string")))
