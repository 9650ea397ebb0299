"""Vector functions: cosine similarity and the hash embedding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

EMBED_DIM = 64


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for null, empty, unequal-length or zero vectors.  One pass over both."""
    parts = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.struct(
            x.cast("double").alias("x"), y.cast("double").alias("y"))),
        F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy")),
        lambda acc, v: F.struct(
            (acc["xy"] + v["x"] * v["y"]).alias("xy"),
            (acc["xx"] + v["x"] * v["x"]).alias("xx"),
            (acc["yy"] + v["y"] * v["y"]).alias("yy")),
        lambda acc: F.when(
            (acc["xx"] > 0) & (acc["yy"] > 0),
            acc["xy"] / (F.sqrt(acc["xx"]) * F.sqrt(acc["yy"]))).otherwise(0.0))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(usable, parts).otherwise(F.lit(0.0))


def _flat(vectors: pa.Array) -> np.ndarray:
    return pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)


def cosine_batch(left: pa.Array, right: pa.Array) -> np.ndarray:
    """The same for a batch of vector pairs."""
    out = np.zeros(len(left))
    sizes = pc.fill_null(pc.list_value_length(left), 0).to_numpy(zero_copy_only=False)
    other = pc.fill_null(pc.list_value_length(right), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[(sizes > 0) & (sizes == other)]):
        at = np.flatnonzero((sizes == size) & (other == size))
        a = _flat(left.take(pa.array(at))).reshape(-1, size)
        b = _flat(right.take(pa.array(at))).reshape(-1, size)
        norms = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
        dots = (a * b).sum(axis=1)
        out[at] = np.divide(dots, norms, out=np.zeros(len(at)), where=norms > 0)
    return out


def cosine_similarity_arrow(a: Column, b: Column) -> Column:
    """Cosine similarity on Arrow batches: the faster form for many pairs."""
    @F.arrow_udf("double")
    def similarity(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(cosine_batch(x, y))

    return similarity(a, b)


# list elements that one step of array arithmetic takes
ELEMENTS_AT_ONCE = 1 << 18


def row_slices(lists: pa.Array, most: int = ELEMENTS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, number) of at most about ``most`` elements, one row at least."""
    before = np.zeros(len(lists) + 1, dtype=np.int64)
    np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False),
              out=before[1:])
    first = 0
    while first < len(lists):
        end = int(np.searchsorted(before, before[first] + most, side="right")) - 1
        end = max(end, first + 1)
        yield first, end - first
        first = end


def _md5_hash(token: str) -> int:
    return int.from_bytes(hashlib.md5(token.encode("utf-8")).digest()[:4], "big")


def _blake2b_hash(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8"), digest_size=4).digest(), "big")


TOKEN_HASHES = {"md5": _md5_hash, "blake2b": _blake2b_hash}


def hash_embed_batch(
    tokens: pa.Array, dim: int = EMBED_DIM, hash_name: str = "md5"
) -> np.ndarray:
    """Unit-length signed bag-of-hashes, one row per token list; null counts as no tokens.

    Each distinct token of the batch is hashed once; the rest is array arithmetic.
    """
    rows = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = pc.list_flatten(tokens).dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    hash_of = TOKEN_HASHES[hash_name]
    vocabulary = encoded.dictionary.to_pylist()
    hashes = np.fromiter((hash_of(t) for t in vocabulary), dtype=np.int64, count=len(vocabulary))
    slot, sign = hashes % dim, np.where((hashes >> 8) & 1, 1.0, -1.0)
    flat = np.bincount(
        rows * dim + slot[codes], weights=sign[codes], minlength=len(tokens) * dim
    ) if len(rows) else np.zeros(len(tokens) * dim)
    matrix = flat.reshape(len(tokens), dim)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    norms[norms == 0] = 1.0
    return matrix / norms


def hash_embedding(tokens: Column, dim: int = EMBED_DIM, hash_name: str = "md5") -> Column:
    """Hash embedding of a token array, computed on Arrow batches.

    ``md5`` is the default because every SQL engine has it; ``blake2b`` gives the
    hash used by the published vectors.
    """

    @F.arrow_udf("array<double>")
    def embed(batch: pa.Array) -> pa.Array:
        parts = [hash_embed_batch(batch.slice(*rows), dim, hash_name) for rows in row_slices(batch)]
        matrix = np.concatenate(parts) if parts else np.zeros((0, dim))
        offsets = np.arange(len(batch) + 1, dtype=np.int32) * dim
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))

    return embed(tokens)
