"""Read files that are one large JSON array, by byte ranges, as one row per element.

Spark's own reader takes such a file as one record of one task.  Here the file is read as text
with the closing brace as the line separator, which Spark splits into byte ranges like any
text.  Where a range begins in the structure (inside a string? how deep?) follows from the
ranges before it: every task reports, for either case at its start, the case at its end and
how the depth changes; folding these reports, one row per range, gives every range's start.
In a second pass each range emits the elements that lie in it whole, and the parts of those
that cross its ends, which are joined in order.  No task reads more than its range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_TOKEN = re.compile(r'\\.|["{}\[\]]', re.DOTALL)
_FIELDS = "file string, block long"
REPORT = _FIELDS + ", " + ", ".join(
    f"{name}_{start} {kind}" for start in ("out", "in")
    for name, kind in (("ends_in", "boolean"), ("change", "long"), ("lowest", "long")))
PIECE = _FIELDS + ", piece long, from_before boolean, goes_on boolean, text string"


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").cast("long").alias("block"), "value")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The fragments of each byte range in order, each with its separator again."""
    rows = (
        (file, block, value) for batch in batches for file, block, value in zip(
            *(batch.column(c).to_pylist() for c in ("file", "block", "value"))))
    for key, own in groupby(rows, key=lambda r: r[:2]):
        yield key, (value + "}" for _, _, value in own)


class _Walk:
    """Where a reader stands in the structure: inside a string, and how deep."""

    def __init__(self, in_string: bool, depth: int):
        self.in_string, self.depth = in_string, depth

    def marks(self, text: str) -> Iterator[tuple[str, int]]:
        """Brackets outside strings with their positions; the depth counts them already."""
        for found in _TOKEN.finditer(text):
            token = found.group()
            if token == '"':
                self.in_string = not self.in_string
            elif not self.in_string and len(token) == 1:
                self.depth += 1 if token in "{[" else -1
                yield token, found.start()


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, block), fragments in _by_block(batches):
        walks = [(_Walk(start, 0), [0]) for start in (False, True)]
        for text in fragments:
            for walk, lowest in walks:
                for _ in walk.marks(text):
                    lowest[0] = min(lowest[0], walk.depth)
        row = {"file": file, "block": block}
        for name, (walk, lowest) in zip(("out", "in"), walks):
            row |= {f"ends_in_{name}": walk.in_string, f"change_{name}": walk.depth,
                    f"lowest_{name}": lowest[0]}
        yield pa.RecordBatch.from_pylist([row])


def _pieces(starts: dict[tuple[str, int], tuple[bool, int]]):
    """Elements and parts of elements of each range, given where it starts."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fragments in _by_block(batches):
            walk = _Walk(*starts[key])
            held: list[str] | None = [] if walk.depth > 1 else None
            from_before, piece = held is not None, 0
            out = []
            for text in fragments:
                begin = 0
                for token, at in walk.marks(text):
                    if token in "{[" and walk.depth == 2:
                        held, begin = [], at
                    elif token in "}]" and walk.depth == 1 and held is not None:
                        held.append(text[begin:at + 1])
                        out.append((*key, piece, from_before, False, "".join(held)))
                        held, from_before, piece = None, False, piece + 1
                if held is not None:
                    held.append(text[begin:])
                if len(out) >= 64:
                    yield _batch(out)
                    out = []
            if held is not None:
                out.append((*key, piece, from_before, True, "".join(held)))
            if out:
                yield _batch(out)

    return cut


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["file", "block", "piece", "from_before", "goes_on", "text"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def fold_reports(reports: list) -> tuple[dict, dict]:
    """Per range: its start (in a string, depth), and the range where the element that is open
    at its start began."""
    starts, opened = {}, {}
    file, in_string, depth, head = None, False, 0, None
    for r in sorted(reports, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, in_string, depth, head = r["file"], False, 0, None
        key = r["file"], r["block"]
        starts[key] = in_string, depth
        if depth > 1:
            opened[key] = head
        case = "in" if in_string else "out"
        if depth <= 1 or depth + r[f"lowest_{case}"] <= 1:
            head = r["block"]  # what is open at the end began here
        in_string, depth = r[f"ends_in_{case}"], depth + r[f"change_{case}"]
    return starts, opened


def read_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The elements (objects) of the arrays under ``path`` as rows of ``schema``."""
    fragments = _fragments(spark, path)
    # one row per byte range
    reports = [r.asDict() for r in fragments.mapInArrow(_reports, REPORT).collect()]
    starts, opened = fold_reports(reports)
    pieces = fragments.mapInArrow(_pieces(starts), PIECE)
    whole = pieces.filter("not from_before and not goes_on").select("text")
    heads = spark.createDataFrame(
        [(file, block, head) for (file, block), head in opened.items()],
        _FIELDS + ", head long")
    parts = pieces.filter("from_before or goes_on").join(heads, ["file", "block"], "left")
    head = F.when(F.col("from_before"), F.col("head")).otherwise(F.col("block"))
    joined = parts.groupBy("file", head.alias("head")).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("block", "piece", "text")))["text"], "")
        .alias("text")).select("text")
    return whole.unionByName(joined).select(F.from_json("text", schema).alias("r")).select("r.*")
