"""Texts of an Arrow batch as flat arrays: bytes, words and word hashes.

Tasks that need words get them here.  A batch is cut into blocks of whole rows of
about ``BLOCK_BYTES``; the arrays over the bytes of one block are the only memory that
grows with text, and a text longer than a block is hashed piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_PRIME, BLOCK_BYTES)
_DOWN = _powers(_INVERSE, BLOCK_BYTES)
_BYTE = np.random.default_rng(20240117).integers(0, 1 << 64, 256, dtype=np.uint64)

# a word is a run of ASCII letters and digits and of all other characters beyond ASCII
_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
for _first, _last in ("09", "AZ", "az"):
    _WORD[ord(_first):ord(_last) + 1] = True


def in_words(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    return _WORD[data]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit values over all bits; another seed gives another function."""
    x = np.asarray(x, dtype=np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % (1 << 64))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and where each begins; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    held = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return held[offsets[0]:offsets[-1]], offsets - offsets[0]


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each text."""
    before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return before[offsets[1:]] - before[offsets[:-1]]


def row_blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes; a longer text is alone in its range."""
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


@dataclass
class Words:
    """Words of some texts: byte ranges in ``data``, hashes, and each text's word range."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Find and hash the words of texts that lie one after the other in ``data``."""
    inside = _WORD[data]
    opens, closes = inside.copy(), inside.copy()
    if len(data):
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        opens[1:] &= ~inside[:-1]
        opens[cuts] = inside[cuts]
        closes[:-1] &= ~inside[1:]
        closes[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    hashes = np.empty(len(starts), dtype=np.uint64)
    word = 0
    while word < len(starts):
        first = starts[word]
        last = int(np.searchsorted(ends, first + BLOCK_BYTES, side="right"))
        if last == word:  # one word longer than a block
            hashes[word] = _long_hash(data[first:ends[word]])
            word += 1
            continue
        piece = data[first:ends[last - 1]]
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[piece] * _UP[:len(piece)], out=total[1:])
        begin = starts[word:last] - first
        hashes[word:last] = (total[ends[word:last] - first] - total[begin]) * _DOWN[begin]
        word = last
    return Words(data, starts, ends, mix(hashes), np.searchsorted(starts, offsets))


def _long_hash(piece: np.ndarray) -> np.uint64:
    total = np.zeros(1, dtype=np.uint64)
    for at in range(0, len(piece), BLOCK_BYTES):
        part = piece[at:at + BLOCK_BYTES]
        total = mix(total + np.sum(_BYTE[part] * _UP[:len(part)], dtype=np.uint64), 3)
    return total[0]


def lower_words(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """Blocks (first row, end row, words) of the lower-cased texts of a column."""
    lowered = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    data, offsets = utf8(lowered)
    for row, end in row_blocks(offsets):
        own = offsets[row:end + 1]
        yield row, end, words(data[own[0]:own[-1]], own - own[0])


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values of each row; rows may be empty."""
    before = np.zeros(len(values) + 1, dtype=np.result_type(values.dtype, np.int64))
    np.cumsum(values, out=before[1:])
    return before[bounds[1:]] - before[bounds[:-1]]
