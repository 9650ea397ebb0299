"""Exact deduplication with a cuckoo-filter index.

Texts are equal when nothing differs after all ASCII white space is deleted.  Every text
becomes a SHA-256 digest in an Arrow pass.  Each task folds its own copies first, so a
text that makes up a third of the corpus leaves a task as one row; the digests are then
dealt out by hash and each shard keeps a ``CuckooIndex`` of its live digests.  A row that
beats the row kept so far deletes the old live digest and inserts its own.  The decisions
are joined back to all rows; Spark splits a hot digest in that join.

Null counts as the empty text; all empty texts are copies of one another.  Of a group, the
row with the most code points in its original text stays, then the smallest doc_id (null
last), then the first row in the order of the files, so of repeated rows one stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.arrays import code_points, utf8
from mnemoframe.llm.rows import in_small_batches, scanned, with_row_key
from mnemoframe.operators.groups import stored

WHITE = b" \t\n\x0b\x0c\r"
DIGEST_SCHEMA = (
    "doc_id long, row_file long, row_number long, n_points long, n_bytes long, digest binary")
BEST_SCHEMA = (
    "digest binary, n_bytes long, n_points long, doc_id long, row_file long, row_number long, "
    "group_size long")
SLOTS = 4


class CuckooIndex:
    """A cuckoo filter over live digests, with the full digest behind every slot.

    Each digest has a 15-bit fingerprint and two buckets of four slots; the second bucket is
    the first one xor a hash of the fingerprint, so an entry can move knowing only itself.
    A fingerprint hit is checked against the content kept for that slot (digest and length),
    hence no false positive gets out.  When an insertion finds no room after ``max_moves``
    moves, the table doubles and is filled again from the stored keys.
    """

    def __init__(self, n_buckets: int = 64, max_moves: int = 128):
        self.max_moves = max_moves
        self.content: dict[int, tuple[bytes, int, object]] = {}
        self._next = 0
        self._seed = 0x2545F491
        self._clear(n_buckets)

    def _clear(self, n_buckets: int) -> None:
        self.n_buckets = n_buckets
        self.prints = np.zeros((n_buckets, SLOTS), dtype=np.uint16).tolist()
        self.slots = np.full((n_buckets, SLOTS), -1, dtype=np.int64).tolist()

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") >> 1 or 1
        first = int.from_bytes(digest[2:10], "little") & (self.n_buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (((mark * 0x5BD1E995) >> 7) & (self.n_buckets - 1))

    def __len__(self) -> int:
        return len(self.content)

    def _find(self, digest: bytes, length: int) -> tuple[int, int] | None:
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            prints = self.prints[bucket]
            if mark in prints:
                for slot in range(SLOTS):
                    if prints[slot] == mark:
                        held = self.content[self.slots[bucket][slot]]
                        if held[0] == digest and held[1] == length:
                            return bucket, slot
            if first == second:
                break
        return None

    def get(self, digest: bytes, length: int):
        """What was inserted with this digest and length; None if it isn't live."""
        at = self._find(digest, length)
        return None if at is None else self.content[self.slots[at[0]][at[1]]][2]

    def insert(self, digest: bytes, length: int, value) -> None:
        """Make a digest live.  It must not be live already."""
        key = self._next
        self._next += 1
        self.content[key] = (digest, length, value)
        if not self._place(digest, key):
            self._resize()

    def delete(self, digest: bytes, length: int) -> bool:
        """Retire a digest; False if it isn't live."""
        at = self._find(digest, length)
        if at is None:
            return False
        bucket, slot = at
        del self.content[self.slots[bucket][slot]]
        self.prints[bucket][slot], self.slots[bucket][slot] = 0, -1
        return True

    def _place(self, digest: bytes, key: int) -> bool:
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            if 0 in self.prints[bucket]:
                slot = self.prints[bucket].index(0)
                self.prints[bucket][slot], self.slots[bucket][slot] = mark, key
                return True
        bucket = second
        for _ in range(self.max_moves):
            self._seed = (self._seed * 1103515245 + 12345) & 0x7FFFFFFF
            slot = (self._seed >> 16) % SLOTS
            prints, slots = self.prints[bucket], self.slots[bucket]
            mark, prints[slot] = prints[slot], mark
            key, slots[slot] = slots[slot], key
            bucket = self._other(bucket, mark)
            if 0 in self.prints[bucket]:
                slot = self.prints[bucket].index(0)
                self.prints[bucket][slot], self.slots[bucket][slot] = mark, key
                return True
        return False

    def _resize(self) -> None:
        """Double until every stored key has a slot."""
        size = self.n_buckets
        done = False
        while not done:
            size *= 2
            self._clear(size)
            done = all(self._place(held[0], key) for key, held in self.content.items())


def _order(points: int, doc_id: int | None, file: int, row: int) -> tuple:
    return (-points, doc_id is None, doc_id or 0, file, row)


def _fold(rows: Iterator[tuple]) -> CuckooIndex:
    """Index the rows (digest, n_bytes, n_points, doc_id, file, row, n): the best of each group."""
    index = CuckooIndex()
    for digest, length, *row, n in rows:
        held = index.get(digest, length)
        if held is None:
            index.insert(digest, length, (row, n))
            continue
        index.delete(digest, length)
        best = row if _order(*row) < _order(*held[0]) else held[0]
        index.insert(digest, length, (best, held[1] + n))
    return index


def _best_batches(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    types = [pa.binary(), *[pa.int64()] * 6]
    names = [c.split()[0] for c in BEST_SCHEMA.split(", ")]
    held = list(index.content.values())
    for at in range(0, len(held), 10_000):
        rows = [(d, n, *row, size) for d, n, (row, size) in held[at:at + 10_000]]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        raw = data.tobytes()
        lengths, digests = [], []
        for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            bare = raw[begin:end].translate(None, WHITE)
            lengths.append(len(bare))
            digests.append(hashlib.sha256(bare).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_file"), batch.column("row_number"),
             pa.array(code_points(data, offsets)), pa.array(lengths, pa.int64()),
             pa.array(digests, pa.binary())],
            names=[c.split()[0] for c in DIGEST_SCHEMA.split(", ")])


def _own_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: one row per digest and bounded run of rows."""
    for batch in batches:
        c = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        yield from _best_batches(_fold(zip(
            c["digest"], c["n_bytes"], c["n_points"], c["doc_id"], c["row_file"],
            c["row_number"], [1] * len(batch))))


def _shard_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in BEST_SCHEMA.split(", ")]

    def rows():
        for batch in batches:
            yield from zip(*[batch.column(n).to_pylist() for n in names])

    yield from _best_batches(_fold(rows()))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its row key, digest, group size, and which row stays.

    Columns: doc_id, row_file, row_number, keep_id, group_size, kept, text_sha256.
    """
    keyed, (file, row) = with_row_key(scanned(in_small_batches(docs)))
    narrow = keyed.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(file).alias("row_file"),
        F.col(row).alias("row_number"), F.col(text_col).cast("string").alias("text"))
    rows = stored(narrow.mapInArrow(_digests, DIGEST_SCHEMA))
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = (
        rows.mapInArrow(_own_best, BEST_SCHEMA).repartition(shards, "digest")
        .mapInArrow(_shard_best, BEST_SCHEMA)
        .select("digest", F.col("doc_id").alias("keep_id"), F.col("row_file").alias("keep_file"),
                F.col("row_number").alias("keep_row"), "group_size"))
    stays = (F.col("row_file") == F.col("keep_file")) & (F.col("row_number") == F.col("keep_row"))
    return rows.join(best, "digest").select(
        "doc_id", "row_file", "row_number", "keep_id", "group_size", stays.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns as they were."""
    docs = scanned(docs)
    stays = deduplicate(docs, id_col, text_col).filter("kept")
    keyed, (file, row) = with_row_key(docs)
    keys = stays.select(F.col("row_file").alias(file), F.col("row_number").alias(row))
    return keyed.join(keys, [file, row], "left_semi").select(*docs.columns)
