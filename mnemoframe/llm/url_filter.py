"""URL filters by a sorted array of 64-bit digests.

A rule is a host and a path; it fits its host and all subdomains when the url's path starts
with the rule's path, and the longest rule wins.  The rules' xxhash64 digests lie sorted in a
file that every executor gets once and maps into memory; the rules' full texts lie beside it
in the same order.  Each url makes one candidate per pair of a rule-host length and a
rule-path length that it can have, candidates are looked up by a vectorised binary search,
and a hit counts only if the full text is equal.

The index is used up to ``MAX_INDEX_BYTES`` of rules (measured before it is built).  Beyond
that, the same candidates are joined to the rules by their text.

A null url or one without ``://`` has an empty host and path and fits no rule.  A url that no
rule fits gets the verdict ``default``.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoframe.operators.groups import shared_folder

MAX_INDEX_BYTES = 64 << 20
SEED = 42
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "verdict string, host string, path string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty without ``://``."""
    cut = F.instr(url, "://")
    rest = F.when(cut > 0, F.substring(url, cut + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)
    return F.translate(host, UPPER, LOWER), path


def _save(spark: SparkSession, name: str, values: np.ndarray) -> str:
    """Put an array into the shared folder and hand it to every executor once."""
    held = io.BytesIO()
    np.save(held, values)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        data = held.getvalue()
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at:at + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


class DigestArray:
    """Sorted digests, and the full texts they stand for."""

    def __init__(self, digests: np.ndarray, offsets: np.ndarray, texts: np.ndarray,
                 host_lengths: np.ndarray, verdicts: np.ndarray, names: list[str]):
        self.digests, self.offsets, self.texts = digests, offsets, texts
        self.host_lengths, self.verdicts, self.names = host_lengths, verdicts, names

    @staticmethod
    def parts(rules: list[tuple[str, str, str]], names: list[str]) -> dict[str, np.ndarray]:
        """The arrays of an index of rules (verdict, host, path), sorted by digest."""
        keyed = sorted(
            (xxhash.xxh64_intdigest((h + p).encode(), SEED), (h + p).encode(), len(h), names.index(v))
            for v, h, p in rules)
        ends = np.cumsum([0, *(len(k[1]) for k in keyed)], dtype=np.int64)
        return {
            "digests": np.array([k[0] for k in keyed], dtype=np.uint64), "offsets": ends,
            "texts": np.frombuffer(b"".join(k[1] for k in keyed), dtype=np.uint8),
            "host_lengths": np.array([k[2] for k in keyed], dtype=np.int32),
            "verdicts": np.array([k[3] for k in keyed], dtype=np.int32)}

    def text(self, at: int) -> bytes:
        return self.texts[self.offsets[at]:self.offsets[at + 1]].tobytes()

    def find(self, keys: list[bytes], host_lengths: list[int]) -> np.ndarray:
        """Place of each key in the array, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.digests) or not keys:
            return out
        asked = np.array([xxhash.xxh64_intdigest(k, SEED) for k in keys], dtype=np.uint64)
        at = np.searchsorted(self.digests, asked)
        hits = np.flatnonzero((at < len(self.digests))
                              & (self.digests[np.minimum(at, len(self.digests) - 1)] == asked))
        for i in hits.tolist():  # equal digests lie side by side
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == asked[i]:
                if self.text(j) == keys[i] and self.host_lengths[j] == host_lengths[i]:
                    out[i] = j
                    break
                j += 1
        return out


@lru_cache(maxsize=2)
def _mapped(files: tuple[tuple[str, str], ...], names: tuple[str, ...]) -> DigestArray:
    held = {part: np.load(SparkFiles.get(name), mmap_mode="r") for part, name in files}
    return DigestArray(**held, names=list(names))


def _candidates(host: str, path: str, hosts: list[int], paths: list[int]):
    """(key, host length) of all rules that could fit: whole labels of the host's end."""
    for n in hosts:
        if n == len(host) or 0 < n < len(host) and host[-n - 1] == ".":
            for m in paths:
                if m <= len(path):
                    yield (host[len(host) - n:] + path[:m]).encode(), n


def judge(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id",
    url_col: str = "url", max_index_bytes: int = MAX_INDEX_BYTES,
) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    ``rules``: verdict, host, path, all set, with hosts in lower case.  A rule given twice
    counts once; of two verdicts for one rule, the first in alphabetical order holds.
    """
    spark = pages.sparkSession
    own = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    host, path = host_and_path(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.select("page_id", F.coalesce("host", F.lit("")).alias("host"),
                       F.coalesce("path", F.lit("")).alias("path"))
    seen = own.agg(
        F.coalesce(F.sum(F.length("host") + F.length("path") + 24), F.lit(0)).alias("size"),
        F.sort_array(F.collect_set(F.length("host"))).alias("hosts"),
        F.sort_array(F.collect_set(F.length("path"))).alias("paths")).first()
    hosts, paths = list(seen["hosts"]), list(seen["paths"])
    if seen["size"] > max_index_bytes:
        return _judge_by_join(urls, own, default, hosts, paths)
    given = [(r["verdict"], r["host"], r["path"]) for r in own.collect()]
    names = sorted({v for v, _, _ in given})
    tag = uuid.uuid4().hex
    files = tuple(
        (part, _save(spark, f"urls-{tag}-{part}.npy", values))
        for part, values in DigestArray.parts(given, names).items())

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _mapped(files, tuple(names))
        for batch in batches:
            keys, lengths, rows = [], [], []
            for i, (h, p) in enumerate(zip(
                    batch.column("host").to_pylist(), batch.column("path").to_pylist())):
                for key, n in _candidates(h, p, hosts, paths) if h else ():
                    keys.append(key)
                    lengths.append(n)
                    rows.append(i)
            best: dict[int, tuple] = {}
            for key, n, i, at in zip(keys, lengths, rows, index.find(keys, lengths).tolist()):
                if at >= 0:
                    held = (len(key.decode()), n, key.decode(), names[index.verdicts[at]])
                    best[i] = max(best.get(i, held), held)
            none = (0, 0, None, default)
            chosen = [best.get(i, none) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([c[2] for c in chosen], pa.string()),
                 pa.array([c[3] for c in chosen], pa.string())],
                names=[*batch.schema.names, "rule", "verdict"])

    kind = dict(urls.dtypes)["page_id"]
    return urls.mapInArrow(
        judged, f"page_id {kind}, host string, path string, rule string, verdict string")


def _judge_by_join(
    urls: DataFrame, rules: DataFrame, default: str, hosts: list[int], paths: list[int]
) -> DataFrame:
    """The same verdicts for rules too large to hand out: candidates joined by text."""
    pairs = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("m"))
                      for n in hosts for m in paths])
    fits = lambda c: (
        (F.length("host") >= c["n"]) & (F.length("path") >= c["m"]) & (F.length("host") > 0)
        & ((F.length("host") == c["n"])
           | (F.substring("host", F.length("host") - c["n"], F.lit(1)) == ".")))
    cut = lambda c: F.struct(
        F.substring("host", F.length("host") - c["n"] + 1, c["n"]).alias("host"),
        F.substring("path", F.lit(1), c["m"]).alias("path"))
    # equal urls are judged once, which also keeps a hot host out of one task
    distinct = urls.select("host", "path").distinct()
    asked = distinct.select(
        "host", "path", F.explode(F.transform(F.filter(pairs, fits), cut)).alias("c"))
    r = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    hits = asked.join(
        r, (F.col("c.host") == F.col("rule_host")) & (F.col("c.path") == F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    longest = Window.partitionBy("host", "path").orderBy(
        F.length(rule).desc(), F.length("rule_host").desc())
    best = hits.withColumn("place", F.row_number().over(longest)).filter("place = 1").select(
        "host", "path", rule.alias("rule"), "verdict")
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
