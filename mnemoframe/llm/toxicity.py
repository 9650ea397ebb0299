"""Toxicity scores: a linear model on character n-grams scaled by naive Bayes.

Features are the n-grams (3 to 6 characters) of the lower-cased words of a text, a word's
ends included, hashed into ``1 << BITS`` places; what counts is how many separate places in
a text hold an n-gram, damped by a logarithm.  Labelled texts give each n-gram a smoothed
log-count ratio of toxic to other texts.  Counting is a sum per place over map-side partial
sums.  The ``max_features`` n-grams whose counts differ most (by the chi-square of presence)
become features; each is scaled by its ratio, and a logistic regression with a ridge
penalty gives the weights.

Training reads at most ``max_labels`` labelled documents, the first by a hash of their id.
Null counts as empty; an empty text scores by the intercept alone.  Labels that are null or
contradict one another for one id are not learned from.  Without both kinds of labels every
text scores 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.arrays import mix, row_blocks, utf8
from mnemoframe.llm.quality import labelled, narrow

BITS = 20
SIZES = (3, 4, 5, 6)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _points(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of rows: code points with a space before, between and after texts, and row bounds."""
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    for row, end in row_blocks(offsets):
        raw = data[offsets[row]:offsets[end]].tobytes()
        at = (offsets[row:end + 1] - offsets[row]).tolist()
        parts = [raw[a:b].decode() for a, b in zip(at[:-1], at[1:])]
        text = " " + "".join(part + " " for part in parts)
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).copy()
        bounds = np.cumsum([0, *(len(part) + 1 for part in parts)])
        ascii_sign = (points < 128) & ~_LETTER[np.minimum(points, 127)]
        points[ascii_sign] = 32
        yield row, end, points, bounds


_LETTER = np.array([chr(i).isalnum() for i in range(128)])


def ngrams(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per size: the place of each n-gram, and where it starts; none reaches over a space."""
    inner = points != 32
    value = points.astype(np.uint64)
    single = mix(value)
    hashed, whole = single, np.ones(len(points), dtype=bool)
    for size in range(2, max(SIZES) + 1):
        hashed = hashed[:-1] * _FACTOR + single[size - 1:]
        if size > 2:  # the characters between the ends are no spaces
            whole = whole[:-1] & inner[size - 2:len(inner) - 1]
        else:
            whole = whole[:-1]
        if size in SIZES:
            at = np.flatnonzero(whole)
            yield (mix(hashed[at], size) >> np.uint64(64 - BITS)).astype(np.int64), at


def _pairs(texts: pa.Array, chosen: np.ndarray | None = None):
    """Per block: first row, number of rows, (row, n-gram) pairs found, and how often each.

    ``chosen`` maps a place to a feature, or -1 to none.
    """
    for row, end, points, bounds in _points(texts):
        keys = []
        for places, at in ngrams(points):
            if chosen is not None:
                places = chosen[places]
                hit = places >= 0
                places, at = places[hit], at[hit]
            rows = np.searchsorted(bounds, at, side="right") - 1
            keys.append((rows << BITS) | places)
        found, times = np.unique(np.concatenate(keys), return_counts=True)
        rows = np.minimum(found >> BITS, end - row - 1)
        yield row, end - row, rows, found & ((1 << BITS) - 1), times


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either label that hold each n-gram, summed over the task."""
    sums = np.zeros((2, 1 << BITS), dtype=np.int64)
    for batch in batches:
        toxic = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
        for row, n, rows, places, _ in _pairs(batch.column("text")):
            is_toxic = toxic[row:row + n][rows]
            for k in (0, 1):
                sums[k] += np.bincount(places[is_toxic == k], minlength=1 << BITS)
    at = np.flatnonzero(sums.any(axis=0))
    for part in np.array_split(at, len(at) // 50_000 + 1):
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(sums[1][part]), pa.array(sums[0][part])],
            names=["place", "toxic", "other"])


@dataclass
class Model:
    """Places of the features, their weights (ratio times coefficient), and the intercept."""

    places: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        table = np.full(1 << BITS, -1, dtype=np.int32)
        table[self.places] = np.arange(len(self.places))
        return table

    def score(self, texts: pa.Array, table: np.ndarray) -> np.ndarray:
        raw = np.full(len(texts), self.intercept)
        for row, n, rows, features, times in _pairs(texts, table):
            raw[row:row + n] += np.bincount(
                rows, weights=self.weights[features] * np.log1p(times), minlength=n)
        return 1 / (1 + np.exp(-np.clip(raw, -50, 50)))


def fit(
    rows: np.ndarray, features: np.ndarray, values: np.ndarray, toxic: np.ndarray,
    n_features: int, ridge: float = 1e-4, rounds: int = 2000,
) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse values by accelerated gradient steps."""
    n = len(toxic)
    w, b, v, vb = np.zeros(n_features), 0.0, np.zeros(n_features), 0.0
    # a bound of the curvature: the largest row norm, intercept included
    norm = np.bincount(rows, weights=values ** 2, minlength=n).max(initial=0.0) + 1
    mean = np.bincount(features, weights=values ** 2, minlength=n_features).sum() / max(n, 1) + 1
    step = 1 / (0.25 * min(norm, 20 * mean) + ridge)
    y = toxic.astype(float)
    for k in range(rounds):
        raw = np.bincount(rows, weights=v[features] * values, minlength=n) + vb
        error = 1 / (1 + np.exp(-np.clip(raw, -50, 50))) - y
        gradient = np.bincount(features, weights=error[rows] * values, minlength=n_features) / n
        new, new_b = v - step * (gradient + ridge * v), vb - step * error.mean()
        momentum = k / (k + 3)
        v, vb = new + momentum * (new - w), new_b + momentum * (new_b - b)
        w, b = new, new_b
    return w, float(b)


def train(
    docs: DataFrame, labels: DataFrame, learnable: Column, label: str = "toxic",
    max_labels: int = 20_000, max_features: int = 2048,
) -> Model:
    """A model learned from labelled documents; ``docs`` has doc_id and text."""
    chosen = labelled(docs, labels, label, learnable, max_labels)
    sums = chosen.mapInArrow(_counts, "place long, toxic long, other long").groupBy("place").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    sizes = {r["good"]: r["count"] for r in chosen.groupBy("good").count().collect()}
    n_toxic, n_other = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_other:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    p, q = F.col("toxic") / n_toxic, F.col("other") / n_other
    share = (F.col("toxic") + F.col("other")) / (n_toxic + n_other)
    strength = (p - q) * (p - q) / (share * (1 - share) + 1 / (n_toxic + n_other))
    best = (
        sums.filter(F.col("toxic") + F.col("other") >= 5)
        .orderBy(strength.desc(), "place").limit(max_features).toArrow())
    places = best["place"].to_numpy()
    ratio = np.log((best["toxic"].to_numpy() + 1) / (n_toxic + 2)) - np.log(
        (best["other"].to_numpy() + 1) / (n_other + 2))
    table = Model(places, ratio, 0.0).table()

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, rows, features, times in _pairs(batch.column("text"), table):
                at = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("good").slice(row, n),
                     pa.ListArray.from_arrays(at, pa.array(features.astype(np.int32))),
                     pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32)))],
                    names=["good", "features", "times"])

    # at most max_labels rows of at most max_features numbers
    rows = chosen.mapInArrow(
        present, "good boolean, features array<int>, times array<int>").toArrow()
    lengths = pc.list_value_length(rows["features"]).to_numpy()
    features = pc.list_flatten(rows["features"]).to_numpy()
    times = pc.list_flatten(rows["times"]).to_numpy()
    toxic = rows["good"].to_numpy().astype(bool)
    of = np.repeat(np.arange(len(lengths)), lengths)
    w, b = fit(of, features, ratio[features] * np.log1p(times), toxic, len(places))
    return Model(places, w * ratio, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    table = model.table()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.score(batch.column("text"), table))],
                names=["doc_id", "score"])

    return narrow(docs).mapInArrow(scored, "doc_id long, score double")
