"""Periodic runs of words: an online, sparse dynamic programme over diagonals.

A run is a stretch of words with smallest period q (words q apart are identical) whose length
is at least ``min_length`` and ``min_exponent`` times q, and which no neighbouring word extends
at that period.  A text is read word by word.  At word i its earlier occurrences j are the
matches on the diagonals of lag i - j; an active lag whose word matches again grows by one,
one whose word differs ends, and if its stretch is long enough the run is emitted at once.

Two rules keep the set of active lags sparse, and neither loses a run:

* A run of period q has (e - 1) * q matches in a row, e the least exponent.  With s the largest
  power of two up to q, it therefore passes a multiple of s that has (e - 2) * s matches just
  before it.  A lag is opened at such positions only, so that at most n log n earlier
  occurrences are visited, also where one word fills the text.
* While a shorter lag q is active over a whole square, lags that are multiples of q and stay
  inside its stretch repeat it: they have a smaller period, and end where it ends.

Memory per text: a few integers per word, and its distinct words.  Null or empty texts have
no words and no runs; words are the maximal stretches without ASCII white space; rows are
returned one for one, so repeated rows and ids (null ones too) stay as they are.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import count

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.rows import free_name, in_small_batches

# bytes of a long text that are split at once
CHUNK_BYTES = 1 << 20
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
RUNS_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_ids(text: bytes) -> tuple[list[int], dict[bytes, int]]:
    """The words of a text as numbers, and the number of each distinct word."""
    ids: list[int] = []
    known: dict[bytes, int] = {}
    fresh = count()
    at = 0
    while at < len(text):
        cut = _WHITE.search(text, min(at + CHUNK_BYTES, len(text)))
        end = cut.start() if cut else len(text)
        # a number is drawn for every word, kept only for new ones
        ids.extend(map(known.setdefault, text[at:end].split(), fresh))
        at = end
    return ids, known


def _primes(n: int) -> list[int]:
    out, factor = [], 2
    while factor * factor <= n:
        if n % factor == 0:
            out.append(factor)
            while n % factor == 0:
                n //= factor
        factor += 1
    return out + [n] if n > 1 else out


def _smallest(ids: Sequence[int], start: int, end: int, period: int) -> bool:
    """Whether a stretch of at least two periods has no smaller period: any one divides it."""
    return all(
        ids[start:end - period // f] != ids[start + period // f:end] for f in _primes(period))


def runs(
    ids: Sequence[int], min_length: int = 6, min_exponent: int = 4
) -> list[tuple[int, int, int]]:
    """All runs as (start, length, period), sorted."""
    out: list[tuple[int, int, int]] = []
    active: dict[int, int] = {}  # lag -> position of its first match in a row
    last: dict[int, int] = {}
    before = array("q", bytes(8 * len(ids)))  # the previous occurrence of each word

    def ended(lag: int, at: int) -> None:
        start = active.pop(lag) - lag
        if at - start >= max(min_length, min_exponent * lag) and _smallest(ids, start, at, lag):
            out.append((start, at - start, lag))

    def opened(i: int, j: int, reach: int) -> None:
        """Open the lags of the occurrences before ``j`` that have matched long enough."""
        squares = [(lag, at - lag) for lag, at in active.items() if i - at + 1 >= lag]
        while j > reach and j >= 0:
            lag = i - j
            first = i - (min_exponent - 2) * (1 << lag.bit_length() - 1)
            inside = lag in active or first < lag
            for short, start in squares:
                if inside:
                    break
                if j >= start:
                    inside = lag % short == 0
                    if short == 1:  # one word fills the stretch
                        j = start
                else:  # where the shorter period broke off, this lag must match as well
                    inside = first < start <= i and ids[start - 1] != ids[start - 1 - lag]
            if not inside and ids[first] == ids[first - lag]:
                at = i
                while at > lag and ids[at - 1] == ids[at - 1 - lag]:
                    at -= 1
                if at <= first:
                    active[lag] = at
            j = before[j]

    for i, word in enumerate(ids):
        if active:
            for lag in [lag for lag in active if ids[i - lag] != word]:
                ended(lag, i)
        j = before[i] = last.get(word, -1)
        last[word] = i
        reach = i - ((i & -i) << 1)  # lags whose power of two divides i
        if j > reach and j >= 0:
            opened(i, j, reach)
    for lag in list(active):
        ended(lag, len(ids))
    return sorted(out)


def kept_words(n: int, found: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Ranges of the n words that stay when each run is cut down to its first period."""
    at = 0
    for start, end in sorted((s + q, s + length) for s, length, q in found):
        if start > at:
            yield at, start
        at = max(at, end)
    if at < n:
        yield at, n


def find_runs(
    docs: DataFrame, min_length: int = 6, min_exponent: int = 4, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the text without repeated periods.

    ``min_exponent`` is at least 2.  The collapsed text joins the kept words by one space.
    """
    if min_exponent < 2:
        raise ValueError("a run holds at least two periods")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
            sizes, found, collapsed = [], [], []
            for row in range(len(texts)):
                text = texts[row].as_py()
                ids, known = word_ids(text)
                own = runs(ids, min_length, min_exponent)
                word = {number: word for word, number in known.items()}
                collapsed.append(b" ".join(
                    word[x] for begin, end in kept_words(len(ids), own) for x in ids[begin:end]))
                sizes.append(len(ids))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, RUNS),
                 pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])

    narrow = in_small_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(
        searched, f"doc_id long, n_words long, runs {RUNS_TYPE}, collapsed string")


def longest(found: Column) -> Column:
    """The run of greatest length; of equal ones the first to start, then the shortest period."""
    return F.array_max(F.transform(found, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("finer"))))


def listed(found: Column) -> Column:
    """Every run's ``start,length,period`` and a line feed, one after the other."""
    return F.array_join(F.transform(found, lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def words_of(text: Column) -> Column:
    """The words of a text as an array; none of a null."""
    return F.filter(
        F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repeat the words of every tenth document (by crc32 of its id), so that runs are known.

    With g the crc32 divided by 10, the words from a = g % n on become a cycle of the
    1 + (n - a) div (3 + g % 8) words at a.  Documents with null ids stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words_col = free_name(docs, "words")
    words, n = F.col(words_col), F.size(words_col).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    cycle = F.transform(
        F.sequence(F.lit(0).cast("long"), n - 1),
        lambda i: words[F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")])
    planted = F.array_join(cycle, " ")
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    return docs.withColumn(
        words_col, F.when(chosen, words_of(F.col(text_col).cast("string")))
    ).withColumn(
        text_col, F.when(F.coalesce(n > 0, F.lit(False)) & chosen, planted)
        .otherwise(F.col(text_col))
    ).drop(words_col)
