"""Shards of near equal bytes by histogram sort.

Documents are ordered by a key: a digest of the text, then doc_id, so that equal texts lie side
by side and only a group that a shard boundary meets is divided, however large it is.  Shard
boundaries are found without sorting anything: rounds of probes (candidate boundaries) are
counted exactly, bytes and rows below each probe over all partitions, and each boundary's
interval shrinks to the two probes around its target, until the boundary meets the tolerance.
Probes of a round are keys drawn by hash from the open intervals, so keys of any distribution
and groups of any size take the same few rounds.  Then the rows are exchanged once, by ranges
of the probes counted before.  Since the rows below each range are known, a position in a
range is a position in its shard, and no shard has to meet in one task.

With tolerance 0 (the default) a boundary is the one between two documents whose bytes below
are nearest to its target, the lower one if two are: which shard a document goes to then
depends on the documents alone, neither on files nor on the draw.

Null texts count as empty; a document weighs its UTF-8 bytes plus 1, so empty ones count too.
Null ids come last among equal texts.  Repeated rows are divided like other equal texts.  Of
fewer documents than shards, some shards stay empty.  Columns keep their values whatever their
names; ``size``, ``text_crc32``, ``shard`` and ``slot`` get underscores where a name is taken.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.llm.arrays import mix
from mnemoframe.llm.rows import free_name, scanned, with_row_key
from mnemoframe.operators.groups import stored

KEY_BYTES = 33
# keys drawn in a round from all open intervals; the first round's probes bound the ranges too
PROBES = 4096
# ranges of the exchange per shuffle partition
RANGES = 4


def sort_key(text: Column, doc_id: Column, file: Column, row: Column) -> Column:
    """Digest of the text, then doc_id (null last), then the row's place: 33 bytes that sort."""
    flipped = doc_id.cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.concat(
        F.unhex(F.md5(text)), F.when(doc_id.isNull(), F.unhex(F.lit("01"))).otherwise(
            F.unhex(F.lit("00"))),
        F.unhex(F.lpad(F.hex(F.coalesce(flipped, F.lit(0).cast("long"))), 16, "0")),
        F.unhex(F.lpad(F.hex(F.xxhash64(file, row)), 16, "0")))


def _keys(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype=f"S{KEY_BYTES}")


def _counts(probes: list[bytes]):
    """Bytes and rows between neighbouring probes, summed per task."""
    edges = np.array(probes, dtype=f"S{KEY_BYTES}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_bytes = np.zeros(len(edges) + 1, dtype=np.int64)
        n_rows = np.zeros(len(edges) + 1, dtype=np.int64)
        for batch in batches:
            place = np.searchsorted(edges, _keys(batch.column("key")), side="right")
            sizes = batch.column("size").to_numpy()
            np.add.at(n_bytes, place, sizes)
            n_rows += np.bincount(place, minlength=len(edges) + 1)
        held = np.flatnonzero(n_rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int64()), pa.array(n_bytes[held]), pa.array(n_rows[held])],
            names=["place", "n_bytes", "n_rows"])

    return counted


def _draw(intervals: list[tuple[bytes, bytes]], shares: list[float], seed: int):
    """Of each interval [first, end) the share of keys whose hash is small enough."""
    firsts = np.array([a for a, _ in intervals], dtype=f"S{KEY_BYTES}")
    # the last interval may have no end
    ends = np.array([b or b"\xff" * KEY_BYTES for _, b in intervals], dtype=f"S{KEY_BYTES}")
    limits = np.array([min(int(share * 2.0 ** 64), (1 << 64) - 1) for share in shares], np.uint64)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch.column("key"))
            words = np.frombuffer(keys.tobytes(), np.uint8).reshape(len(keys), KEY_BYTES)
            words = np.ascontiguousarray(words[:, 1:]).view(np.uint64)
            order = mix(words[:, 0] ^ mix(words[:, 1] ^ mix(words[:, 2] ^ mix(words[:, 3], seed))))
            place = np.searchsorted(firsts, keys, side="right") - 1
            chosen = (place >= 0) & (keys < ends[place]) & (order <= limits[place])
            yield pa.RecordBatch.from_arrays(
                [pa.array(place[chosen], pa.int64()), batch.column("key").filter(pa.array(chosen)),
                 batch.column("size").filter(pa.array(chosen))], names=["interval", "key", "size"])

    return drawn


@dataclass
class Splitters:
    """Boundaries: the first key of each, with the bytes and rows below it."""

    shards: list[tuple[bytes, int, int]]
    probes: list[tuple[bytes, int, int]]
    total_bytes: int
    total_rows: int
    rounds: int


def find_splitters(
    rows: DataFrame, n_shards: int = 16, tolerance: float = 0.0, probes: int = PROBES
) -> Splitters:
    """Boundaries of shards over ``rows`` (key binary, size long), a stored table.

    ``tolerance`` is a share of a shard's bytes by which a boundary may miss its target.
    """
    whole = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    total, n_rows = whole["b"] or 0, whole["n"]
    end = (b"", total, n_rows)  # an empty key as the end of an interval: no end
    known: list[tuple[bytes, int, int]] = [(b"\0" * KEY_BYTES, 0, 0)]
    low = {k: (known[0], end) for k in range(1, n_shards)}
    found: dict[int, tuple[bytes, int, int]] = {}
    rounds = 0

    def miss(k: int, below: int) -> int:
        return abs(n_shards * below - k * total)

    def settle(k: int, boundaries: list[tuple[bytes, int, int]], exact: bool) -> None:
        """Take the nearest of two neighbouring boundaries, or narrow down to them."""
        at = bisect_right([n_shards * b for _, b, _ in boundaries], k * total) - 1
        pair = boundaries[at], boundaries[min(at + 1, len(boundaries) - 1)]
        best = min(pair, key=lambda x: (miss(k, x[1]), x[1]))
        if exact or pair[1][2] - pair[0][2] <= 1 or miss(k, best[1]) <= tolerance * total:
            found[k] = best
        low[k] = pair

    while n_rows and len(found) < n_shards - 1:
        rounds += 1
        open_ = sorted({(low[k][0][0], low[k][1][0]) for k in low if k not in found})
        each = max(32, probes // len(open_))
        inside = {(a[0], b[0]): (a, b) for k, (a, b) in low.items() if k not in found}
        shares = [each / max(1, inside[i][1][2] - inside[i][0][2]) for i in open_]
        held: dict[int, list[tuple[bytes, int]]] = {}
        # about ``each`` keys of every open interval
        for r in rows.mapInArrow(
                _draw(open_, shares, rounds), "interval long, key binary, size long").collect():
            held.setdefault(r["interval"], []).append((bytes(r["key"]), r["size"]))
        exact, asked = {}, []
        for i, interval in enumerate(open_):
            own = sorted(held.get(i, []))
            begin, stop = inside[interval]
            if len(own) == stop[2] - begin[2]:  # all rows of the interval were drawn
                below = list(accumulate((n for _, n in own), initial=begin[1]))
                exact[interval] = [
                    (key, b, begin[2] + j) for j, ((key, _), b) in enumerate(zip(own, below))
                ] + [stop]
            else:
                asked += [key for key, _ in own]
        if asked:
            edges = sorted(set(asked) | {key for key, _, _ in known})
            counted = rows.mapInArrow(_counts(edges), "place long, n_bytes long, n_rows long")
            in_place = {r["place"]: (r["b"], r["n"]) for r in counted.groupBy("place").agg(
                F.sum("n_bytes").alias("b"), F.sum("n_rows").alias("n")).collect()}
            known, b, n = [], 0, 0
            for place, key in enumerate(edges):
                b += in_place.get(place, (0, 0))[0]
                n += in_place.get(place, (0, 0))[1]
                known.append((key, b, n))
        for k in [k for k in low if k not in found]:
            interval = low[k][0][0], low[k][1][0]
            if interval in exact:
                settle(k, exact[interval], True)
            else:
                settle(k, [*known, end], False)
    shards = [found.get(k, end) for k in range(1, n_shards)]
    return Splitters(shards, known, total, n_rows, rounds)


def _ranges(split: Splitters, n_ranges: int) -> list[tuple[bytes, int, int]]:
    """Ranges of the exchange: first key, shard, and the slot of the first row."""
    step = max(1, split.total_rows // max(1, n_ranges))
    below, at = {b"\0" * KEY_BYTES: 0}, step
    for key, _, n in split.probes:
        if n >= at:
            below[key] = n
            at = n + step
    starts = sorted((key, n) for key, _, n in split.shards if key)
    below |= dict(starts)
    out, shard, begin = [], 0, 0
    for key, n in sorted(below.items()):
        while shard < len(starts) and starts[shard][0] <= key:
            begin = starts[shard][1]
            shard += 1
        out.append((key, shard, n - begin))
    return out


def place(rows: DataFrame, split: Splitters, key: str, shard: str, slot: str) -> DataFrame:
    """Add each row's shard and its position there (from 0, in the order of the key)."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = _ranges(split, RANGES * partitions)
    edges = np.array([first for first, _, _ in ranges], dtype=f"S{KEY_BYTES}")
    table = pd.DataFrame(
        {"number": range(len(ranges)), "shard": [s for _, s, _ in ranges],
         "first": [n for _, _, n in ranges]})

    @F.pandas_udf("number int, shard int, first long")
    def range_of(keys: pd.Series) -> pd.DataFrame:
        own = np.frombuffer(b"".join(keys), dtype=f"S{KEY_BYTES}")
        return table.iloc[np.searchsorted(edges, own, side="right") - 1].reset_index(drop=True)

    held = free_name(rows, "range")
    inside = Window.partitionBy(f"{held}.number").orderBy(key)
    return rows.withColumn(held, range_of(F.col(key))).select(
        *[F.col(f"`{c}`") for c in rows.columns], F.col(f"{held}.shard").alias(shard),
        (F.col(f"{held}.first") + F.row_number().over(inside) - 1).alias(slot))


def shard(
    docs: DataFrame, n_shards: int = 16, tolerance: float = 0.0, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All rows and columns of the documents, with size, text_crc32, shard and slot."""
    docs = scanned(docs)
    keyed, (file, row) = with_row_key(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    size, crc, key, number, slot = (
        free_name(keyed, c) for c in ("size", "text_crc32", "key", "shard", "slot"))
    keyed = keyed.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        (F.octet_length(text) + 1).cast("long").alias(size), F.crc32(text).alias(crc),
        sort_key(text, F.col(id_col), F.col(file), F.col(row)).alias(key))
    narrow = stored(keyed.select(F.col(key).alias("key"), F.col(size).alias("size")))
    split = find_splitters(narrow, n_shards, tolerance)
    return place(keyed, split, key, number, slot).drop(key)


def write_shards(docs: DataFrame, path: str, **parameters) -> None:
    """Write the shards as Parquet, one folder each; a file holds neighbouring slots in order."""
    out = shard(docs, **parameters)
    out.write.partitionBy(next(c for c in reversed(out.columns) if c.endswith("shard"))).parquet(path)
