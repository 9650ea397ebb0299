"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

An item contaminates a document when some stretch of the document is within
``max_ratio`` edits per character of it, both as lower-cased words joined by single spaces.

The CGK walk turns edit distance into Hamming distance: it reads a string of symbols (here
words) and after each step moves on or stays, by a random bit that depends on step and symbol
only, so that after an edit two strings soon walk in step again.  A *repetition* draws a walk,
a place in the items where it starts, a direction, and ``SAMPLED`` steps whose symbols it
samples.  Windows start at every word of every document; a window and an item collide when
all sampled symbols agree.  The walk of a window is followed only as long as the symbols
sampled so far lie in the table of some item, so nearly all windows end at the first sample.
Collisions give windows of the item's size and as far around as the edits allow.  Windows with
fewer character runs of the item than the edits must leave are dropped, which loses nothing;
the others are verified by exact edit distance (bit-parallel).

The number of repetitions is the smallest with which copies of the items, edited at random up
to the limit, by words and by characters, reach ``target_recall`` each; it depends on the
benchmark alone.  A warning tells if ``MAX_REPETITIONS`` do not suffice.

Items under ``SHORT`` words must occur word for word.  Items without words match nothing, nor
do null or empty texts.  An item set beyond ``MAX_INDEX_BYTES`` is handled block by block,
each against all documents.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from mnemoframe.llm.arrays import Words, in_words, lower_words, mix
from mnemoframe.llm.rows import in_small_batches

MAX_INDEX_BYTES = 16 << 20
SAMPLED = 3
STEPS = 8  # the last sample is at this step or before
LANES = 64 // STEPS
EARLY = 1
SHORT = 8
GRAM = 5
MAX_REPETITIONS = 256
NEAR = 8
# character runs are numbered by hash; the last number is that of none
GRAM_CODES = 1 << 16
NO_GRAM = GRAM_CODES - 1
WINDOW_CHARS = 1 << 14
MAX_RUN_PAIRS = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Repetition:
    """One walk: its seed, direction, start as a share of the item, and sampled steps."""

    number: int
    forward: bool
    share: float
    sampled: tuple[int, ...]

    @staticmethod
    def draw(number: int) -> Repetition:
        rng = np.random.default_rng(7_000 + number)
        # samples lie apart, as a walk may stay at a word for a few steps
        steps = np.cumsum([rng.integers(0, EARLY + 1), *rng.integers(2, 4, SAMPLED - 1)])
        forward = number % 2 == 0
        # starts lie all over the part of the item that leaves room for the walk
        share = 0.85 * ((number // 2 * 0.618) % 1.0)
        return Repetition(number, forward, share if forward else 1 - share,
                          tuple(steps.tolist()))

    def anchor(self, n_words: int) -> int:
        """The word of an item where the walk starts."""
        return min(int(self.share * n_words), n_words - 1)

    def bits(self, hashes: np.ndarray) -> np.ndarray:
        """The random bits of each symbol, one per step, from bit ``shift`` on."""
        return mix(hashes, 1_000 + self.number // LANES)

    @property
    def shift(self) -> int:
        return self.number % LANES * STEPS

    def _moves(self, bits: np.ndarray, step: int) -> np.ndarray:
        moves = ((bits >> np.uint64(self.shift + step)) & np.uint64(1)).astype(np.int64)
        return moves if self.forward else -moves

    @property
    def side(self) -> int:
        return 1 if self.forward else -1

    def _starts(self, bits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words from which the first step stays at, and goes to, one of the given words."""
        bit = np.uint64(1 << self.shift)
        stay = at[bits[at] & bit == 0]
        before = at - self.side
        before = before[(before >= 0) & (before < len(bits))]
        return stay, before[bits[before] & bit != 0]

    def walk(self, hashes: np.ndarray, start: np.ndarray, low, high, samples: int = SAMPLED):
        """Walks from the given words: (those that stay in low to high, their keys).

        The key is that of the first ``samples`` samples.
        """
        at, place, bits = start, np.arange(len(start)), self.bits(hashes)
        key = np.zeros(len(start), dtype=np.uint64)
        low, high = np.broadcast_to(low, start.shape), np.broadcast_to(high, start.shape)
        for step in range(self.sampled[samples - 1] + 1):
            if step in self.sampled:
                key = _add(key, hashes[at])
            if step == self.sampled[samples - 1]:
                break
            at = at + self._moves(bits[at], step)
            on = np.flatnonzero((at >= low[place]) & (at < high[place]))
            at, key, place = at[on], key[on], place[on]
        return place, key

    def collide(self, block: Block, bits: np.ndarray, tables: tuple[np.ndarray, ...]):
        """Walks from all words of a block: (words that agree with some item, their keys).

        A walk ends when its samples so far are not in the table of that sample.
        """
        known = tables[0].take(block.slots, mode="clip")
        end = len(known) - STEPS
        at = np.flatnonzero(known)
        if self.sampled[0]:
            # one step before the first sample: from that word or from the one beside it
            stay, move = self._starts(bits, at)
            start, at = np.concatenate([stay, move]), np.concatenate([stay, move + self.side])
        else:
            start = at
        inside = (start >= STEPS) & (start < end)
        place, at = start[inside] - STEPS, at[inside]
        key = block.first[at]
        for step in range(self.sampled[0], self.sampled[-1]):
            at = at + self._moves(bits[at], step)
            if step + 1 in self.sampled:
                key = _add(key, block.hashes[at])
                table = tables[self.sampled.index(step + 1)]
                on = np.flatnonzero(table[_slots(key, len(table))])
                at, key, place = at[on], key[on], place[on]
        return place, key


def _add(key: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    key = (key + symbols) * _FACTOR
    return key ^ (key >> np.uint64(29))


def _slots(key: np.ndarray, size: int) -> np.ndarray:
    return ((key >> np.uint64(40)) & np.uint64(size - 1)).astype(np.int64)


class Block:
    """Words of a block with room for a walk before and after, and all first samples."""

    def __init__(self, hashes: np.ndarray, table_size: int):
        self.hashes = np.zeros(len(hashes) + 2 * STEPS, dtype=np.uint64)
        self.hashes[STEPS:STEPS + len(hashes)] = hashes
        self.first = _add(np.zeros(len(self.hashes), dtype=np.uint64), self.hashes)
        self.slots = _slots(self.first, table_size)


def edits_within(item: str, text: str, limit: int) -> int:
    """Fewest edits between the item and any stretch of the text; ``limit + 1`` if more.

    The columns of the edit distance table are kept as bit vectors of differences.
    """
    size = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, now, best = full, 0, size, size
    for c in text:
        same = masks.get(c, 0)
        carried = same | down
        diagonal = ((((same & up) + up) ^ up) | same) & full
        rise = (down | ~(diagonal | up)) & full
        fall = up & diagonal
        if rise & top:
            now += 1
        elif fall & top:
            now -= 1
        # the first row stays 0: a stretch may begin anywhere
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up = (fall | ~(carried | rise)) & full
        down = rise & carried
        best = min(best, now)
    return best if best <= limit else limit + 1


def _may_hold(item: str, text: str, limit: int) -> bool:
    """Whether the text has as many character runs of the item as the edits must leave."""
    runs = {text[i:i + GRAM] for i in range(len(text) - GRAM + 1)}
    total = len(item) - GRAM + 1
    left = sum(item[i:i + GRAM] in runs for i in range(total))
    return left >= total - limit * GRAM


class Index:
    """Items as texts, and the keys that each repetition gives them.

    Only the texts and the repetitions travel to the tasks; tables and keys are made there.
    """

    def __init__(self, ids: list, texts: list[str], max_ratio: float,
                 repetitions: list[Repetition]):
        self.given = ids, texts, max_ratio, repetitions
        hashes, self.texts = _item_words(texts)
        self.ids, self.repetitions = ids, repetitions
        self.n_words = [len(h) for h in hashes]
        self.limits = [math.floor(max_ratio * len(t)) if n >= SHORT else 0
                       for t, n in zip(self.texts, self.n_words)]
        long = np.array([i for i, n in enumerate(self.n_words) if n >= SHORT], dtype=np.int64)
        own = [hashes[i] for i in long]
        self.table_size = 1 << min(20, max(16, math.ceil(math.log2(64 * len(long) + 1))))
        self.tables, self.keys, self.items, self.anchors = [], [], [], []
        offsets = [np.cumsum([0, *(len(x) + 1 for x in self.texts[i].split(" "))]) for i in long]
        for repetition in repetitions:
            tables = []
            for samples in range(1, SAMPLED + 1):
                table = np.zeros(self.table_size, dtype=bool)
                table[_slots(_item_keys(repetition, own, samples)[1], self.table_size)] = True
                tables.append(table)
            items, keys = _item_keys(repetition, own)
            order = np.argsort(keys, kind="stable")
            self.tables.append(tuple(tables))
            self.keys.append(keys[order])
            self.items.append(long[items][order])
            # characters before the word where the walk starts
            self.anchors.append(np.array(
                [offsets[i][repetition.anchor(len(own[i]))] for i in items[order].tolist()],
                dtype=np.int64))
        self.grams = [_grams(_points(t)) for t in self.texts]
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, h in enumerate(hashes):
            if 0 < len(h) < SHORT:
                key = int(_run_hash(h, len(h))[0])
                self.short.setdefault(len(h), {}).setdefault(key, []).append(i)

    def __reduce__(self):
        return Index, self.given


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(points: np.ndarray) -> np.ndarray:
    """The numbers of all runs of ``GRAM`` characters."""
    n = max(len(points) - GRAM + 1, 0)
    value = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        value = value * _FACTOR + points[k:n + k]
    value ^= value >> np.uint64(29)
    value *= _FACTOR
    return np.minimum(value >> np.uint64(48), np.uint64(NO_GRAM - 1)).astype(np.int64)


def _item_words(texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
    hashes, joined = [], []
    for row, end, w in lower_words(pa.array(texts, pa.large_string())):
        for k in range(end - row):
            a, b = w.bounds[k], w.bounds[k + 1]
            hashes.append(w.hashes[a:b])
            joined.append(_joined(w, a, b))
    return hashes, joined


def _joined(w: Words, a: int, b: int) -> str:
    """The words a to b of a block, joined by single spaces."""
    if a == b:
        return ""
    raw = w.data[w.starts[a]:w.ends[b - 1]]
    after = np.cumsum(w.ends[a:b] - w.starts[a:b] + 1)
    out = np.full(after[-1] - 1, ord(" "), dtype=np.uint8)
    of_words = np.ones(len(out), dtype=bool)
    of_words[after[:-1] - 1] = False
    out[of_words] = raw[in_words(raw)]
    return out.tobytes().decode()


def _begins(points: np.ndarray, n_words: int) -> np.ndarray:
    """Where each word of a joined text begins, and where one after the last would."""
    begins = np.zeros(n_words + 1, dtype=np.int64)
    begins[1:n_words] = np.flatnonzero(points == 32) + 1
    begins[n_words] = len(points) + 1 if n_words else 0
    return begins


def _run_hash(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = max(len(hashes) - size + 1, 0)
    value = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        value = mix(value * _FACTOR + hashes[k:n + k], 3)
    return value


def _item_keys(repetition: Repetition, hashes: list[np.ndarray], samples: int = SAMPLED):
    """(items that the walk stays inside of, their keys)."""
    if not hashes:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    sizes = np.array([len(h) for h in hashes])
    first = np.cumsum(sizes) - sizes
    start = first + np.array([repetition.anchor(n) for n in sizes])
    return repetition.walk(np.concatenate(hashes), start, first, first + sizes, samples)


def _edited(text: str, ratio: float, by_words: bool, rng: np.random.Generator) -> str:
    """A copy with words or characters replaced, left out or put in, ``ratio`` of them in all."""
    out = text.split(" ") if by_words else list(text)
    letters = "".join(sorted(set(text) - {" "})) or "a"
    for kind in rng.integers(0, 3, max(1, int(ratio * len(out)))):
        at = int(rng.integers(0, len(out)))
        new = "".join(letters[i] for i in rng.integers(0, len(letters), 5 if by_words else 1))
        if kind == 0:
            out[at] = new
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, new)
    return (" " if by_words else "").join(out)


def needed_repetitions(
    texts: list[str], max_ratio: float, target_recall: float, sample: int = 300
) -> list[Repetition]:
    """Draw repetitions until edited copies of the items collide as often as asked for.

    Uses ``sample`` items at most.  Half of the copies have ``max_ratio`` of their words
    edited, half have that share of their characters edited all over, which hits most words;
    each half must reach ``target_recall`` by itself.  One more repetition never lowers recall.
    """
    rng = np.random.default_rng(5)
    chosen: list[Repetition] = []
    if not texts:
        return chosen
    texts = [texts[i] for i in rng.permutation(len(texts))[:sample]]
    pairs = [(t, _edited(t, max_ratio, w, rng)) for t in texts for w in (True, False)]
    sizes, _ = _item_words([t for t, _ in pairs])
    copies, _ = _item_words([c for _, c in pairs])
    found = np.zeros(len(pairs), dtype=bool)
    recall = 0.0
    while len(chosen) < 4 or recall < target_recall:
        if len(chosen) == MAX_REPETITIONS:
            warnings.warn(f"recall {recall:.2f} instead of {target_recall} on edited copies")
            break
        repetition = Repetition.draw(len(chosen))
        chosen.append(repetition)
        items, keys = _item_keys(repetition, sizes)
        for item, key in zip(items.tolist(), keys.tolist()):
            if not found[item] and len(copies[item]):
                copy = copies[item]
                found[item] = key in repetition.walk(
                    copy, np.arange(len(copy)), 0, len(copy))[1].tolist()
        recall = min(found[0::2].mean(), found[1::2].mean())
    return chosen


def build_index(
    ids: list, texts: list[str], max_ratio: float = 0.15, target_recall: float = 0.95
) -> Index:
    """The index of a block of items, with as many repetitions as they need."""
    hashes, joined = _item_words(texts)
    long = [t for t, h in zip(joined, hashes) if len(h) >= SHORT]
    return Index(ids, texts, max_ratio, needed_repetitions(long, max_ratio, target_recall))


def candidates(index: Index, w: Words, grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Distinct (item, character where it would begin) pairs of a block that collide.

    ``grams``: the character runs of all words of the block joined, ``begins``: where each word
    begins.  Windows with fewer runs of the item than the edits must leave are left out.
    """
    found = [np.zeros((0, 2), dtype=np.int64)]
    block = Block(w.hashes, index.table_size)
    for number, repetition in enumerate(index.repetitions):
        keys = index.keys[number]
        if number % LANES == 0:
            bits = repetition.bits(block.hashes)
        place, own = repetition.collide(block, bits, index.tables[number])
        low = np.searchsorted(keys, own, side="left")
        count = np.searchsorted(keys, own, side="right") - low
        hit = np.repeat(np.arange(len(own)), count)
        which = low[hit] + np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)
        # where the item would begin, to the next multiple of NEAR
        start = begins[place[hit]] - index.anchors[number][which]
        found.append(np.column_stack([index.items[number][which], start // NEAR * NEAR]))
    pairs = np.concatenate(found)
    # one number per pair is sorted faster
    base = int(pairs[:, 1].min(initial=0))
    span = int(pairs[:, 1].max(initial=0)) - base + 1
    code = np.unique(pairs[:, 0] * span + pairs[:, 1] - base)
    pairs = np.column_stack([code // span, code % span + base])
    if len(pairs):
        pairs = pairs[_have_runs(index, grams, pairs)]
    found = [pairs]
    for size, known in index.short.items():
        for at, value in enumerate(_run_hash(w.hashes, size).tolist()):
            for item in known.get(value, ()):
                found.append(np.array([[item, begins[at]]]))
    return np.concatenate(found)


def _have_runs(index: Index, grams: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Whether the windows hold as many character runs of their items as edits must leave."""
    widest = max(len(t) + 2 * n for t, n in zip(index.texts, index.limits)) + NEAR
    # windows may reach over both ends of the block
    around = np.full(widest, NO_GRAM, dtype=np.uint16)
    # a quarter of the bytes to copy for the windows
    grams = np.concatenate([around, grams.astype(np.uint16), around])
    known, seen = np.zeros(GRAM_CODES, dtype=np.uint8), np.zeros(GRAM_CODES, dtype=bool)
    out = np.zeros(len(pairs), dtype=bool)
    cuts = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1)).tolist() + [len(pairs)]
    for x, y in zip(cuts[:-1], cuts[1:]):
        item = int(pairs[x, 0])
        size, limit, own = len(index.texts[item]), index.limits[item], index.grams[item]
        need = size - GRAM + 1 - limit * GRAM
        wide = max(NEAR + size + 2 * limit - GRAM + 1, 0)
        if need <= 0 or not wide:
            out[x:y] = need <= 0
            continue
        windows = np.ndarray((len(grams) - wide + 1, wide), np.uint16, grams, 0, (2, 2))
        low = np.clip(pairs[x:y, 1] - limit + widest, 0, len(windows) - 1)
        known[own] = 1
        step = WINDOW_CHARS // wide + 1
        for at in range(0, y - x, step):
            there = windows[low[at:at + step]]
            count = known.take(there, mode="clip").sum(axis=1, dtype=np.uint32)
            for k in np.flatnonzero(count >= need).tolist():
                # runs that a window repeats count once
                seen[there[k]] = True
                out[x + at + k] = np.count_nonzero(seen[own]) >= need
                seen[there[k]] = False
        known[own] = 0
    return out


def _in_step(own: np.ndarray, there: np.ndarray, limit: int) -> bool:
    """Whether as many runs of an item as edits must leave are in step with those of a window.

    Runs that edits leave keep their distance but for one character per edit, so the distances
    of all of them differ by ``limit`` at most.
    """
    order = np.argsort(own, kind="stable")
    known = own[order]
    low = np.searchsorted(known, there, side="left")
    count = np.searchsorted(known, there, side="right") - low
    total = int(count.sum())
    need = len(own) - limit * GRAM
    if need <= 0 or total > MAX_RUN_PAIRS:
        return True
    hit = np.repeat(np.arange(len(there)), count)
    which = order[low[hit] + np.arange(total) - np.repeat(np.cumsum(count) - count, count)]
    span = len(own) + len(there)
    run, apart = np.divmod(np.sort(which * span + hit - which + len(own)), span)
    # a run counts once, from the distance after its last one on
    since = np.maximum(apart - limit, 0)
    again = np.flatnonzero(run[1:] == run[:-1]) + 1
    since[again] = np.maximum(since[again], apart[again - 1] + 1)
    steps = np.bincount(since, minlength=span + 1) - np.bincount(apart + 1, minlength=span + 1)
    return bool(np.cumsum(steps).max() >= need)


def verify(
    index: Index, w: Words, text: str, grams: np.ndarray, begins: np.ndarray, pairs: np.ndarray
) -> dict[tuple[int, int], int]:
    """Fewest edits of the (row, item) pairs that hold."""
    windows: dict[tuple[int, int], list[list[int]]] = {}
    for item, start in pairs.tolist():
        size, limit = len(index.texts[item]), index.limits[item]
        middle = min(max(start + size // 2, 0), len(text) - 1)
        word = int(np.searchsorted(begins, middle, side="right")) - 1
        row = int(np.searchsorted(w.bounds, word, side="right")) - 1
        a = max(start - limit, int(begins[w.bounds[row]]))
        b = min(start + size + limit + (NEAR if limit else 0), int(begins[w.bounds[row + 1]]) - 1)
        own = windows.setdefault((row, item), [])
        # windows that overlap are gone through once; a passage found word for word is alone
        if limit and own and a <= own[-1][1]:
            own[-1][1] = max(own[-1][1], b)
        else:
            own.append([a, b])
    best: dict[tuple[int, int], int] = {}
    for (row, item), own in windows.items():
        passage, limit = index.texts[item], index.limits[item]
        for a, b in own:
            if best.get((row, item)) == 0:
                break
            if not limit:
                edits = 0 if passage == text[a:b] else 1
            elif _in_step(index.grams[item], grams[a:max(b - GRAM + 1, a)], limit):
                edits = edits_within(passage, text[a:b], limit)
            else:
                continue
            if edits <= limit:
                best[row, item] = min(edits, best.get((row, item), edits))
    return best


def contaminated(index: Index, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
    """(row, item, edits) of all texts that an item contaminates."""
    for row, _, w in lower_words(texts):
        text = _joined(w, 0, len(w.hashes))
        points = _points(text)
        begins, grams = _begins(points, len(w.hashes)), _grams(points)
        pairs = candidates(index, w, grams, begins)
        for (own, item), edits in sorted(verify(index, w, text, grams, begins, pairs).items()):
            yield row + own, item, edits


def _indexes(
    benchmark: DataFrame, id_col: str, text_col: str, max_ratio: float, target_recall: float,
    max_index_bytes: int,
) -> Iterator[Index]:
    """Indexes of all items, each of a block whose texts have about that many bytes."""
    items = benchmark.select(
        F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = total // max_index_bytes + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    for number in range(n_blocks):
        rows = items.filter(block == number).orderBy("item_id", "text").collect()
        yield build_index(
            [r["item_id"] for r in rows], [r["text"] for r in rows], max_ratio, target_recall)


def find(
    docs: DataFrame, benchmark: DataFrame, max_ratio: float = 0.15, target_recall: float = 0.95,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", max_index_bytes: int = MAX_INDEX_BYTES,
) -> DataFrame:
    """One row per document and item in it: doc_id, item_id, edits, item_chars."""
    narrow = in_small_batches(docs).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([
        narrow.schema["doc_id"], StructField("item_id", benchmark.schema[item_id_col].dataType),
        StructField("edits", LongType()), StructField("item_chars", LongType())])
    out = None
    for index in _indexes(
            benchmark, item_id_col, item_text_col, max_ratio, target_recall, max_index_bytes):
        part = narrow.mapInArrow(_finder(index, to_arrow_type(schema["item_id"].dataType)), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _finder(index: Index, id_type: pa.DataType):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = list(contaminated(index, batch.column("text")))
            rows = pa.array([row for row, _, _ in hits], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows),
                 pa.array([index.ids[item] for _, item, _ in hits], id_type),
                 pa.array([edits for _, _, edits in hits], pa.int64()),
                 pa.array([len(index.texts[item]) for _, item, _ in hits], pa.int64())],
                names=["doc_id", "item_id", "edits", "item_chars"])

    return found


def clean_rows(
    docs: DataFrame, benchmark: DataFrame, max_ratio: float = 0.15, target_recall: float = 0.95,
    text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    max_index_bytes: int = MAX_INDEX_BYTES,
) -> DataFrame:
    """The rows that no item contaminates, with all their columns; texts move nowhere."""
    docs = in_small_batches(docs)
    for index in _indexes(
            benchmark, item_id_col, item_text_col, max_ratio, target_recall, max_index_bytes):
        docs = docs.filter(_is_clean(index)(F.col(text_col).cast("string")))
    return docs


def _is_clean(index: Index):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        out = np.ones(len(texts), dtype=bool)
        out[[row for row, _, _ in contaminated(index, texts)]] = False
        return pa.array(out)

    return clean
