"""Streaming reconciliation with keyed state: status events as memories and requests arrive.

Memories that can act on one another share scope, type and subject (texts without a subject
share their signature), so that is the key of the state.  Per key the state holds every
memory's signature, tokens, first successor and requests, in two maps: the open memories,
which nothing has acted on yet, and the settled ones.  A memory that arrives in order meets
the open ones of its key only; what other keys and earlier micro-batches hold is not read.

Rows may come in any order.  A late memory is compared with the settled ones of its key as
well: it takes over the older memories whose successor is newer than itself, and finds its
own first successor among the newer ones.  A request finds its target by a stream-stream join
on the id, whichever comes first, and then joins the target's key.  A request that arrives
after the successor it precedes takes the successor's effect back.

Each event is the whole current record of one memory with a version that counts its events;
the last version per memory equals what the batch operator gives for the rows so far.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from mnemoframe import constants as C
from mnemoframe.functions.text import (
    content_signature,
    subject_key,
    text_signals_supersession,
    tokenize,
)
from mnemoframe.operators.reconcile import DUPLICATE_CONFIDENCE, MIN_OVERLAP
from mnemoframe.settings import DEFAULTS, Settings

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

GROUP = ["scope_id", "mem_type", "topic"]
# what the state holds of a memory, after its number
RECORD = (
    "mem_id string, sig string, tokens array<string>, replaces boolean, newer_seq long, "
    "duplicate boolean, overlap double, newer_replaces boolean, asked_first {asked}, "
    "asked_last {asked}, action string, version int")
EVENT = (
    "scope_id {scope}, mem_type string, seq long, mem_id string, status string, newer_seq long, "
    "kind string, overlap double, confidence double, rel string, version int")


def topic(content: Column, mem_id: Column) -> Column:
    """The subject; without one the signature; an empty text has no others to meet."""
    subject = subject_key(content)
    return F.when(F.coalesce(content, F.lit("")) == "", mem_id).when(
        subject != "", F.concat(F.lit("s:"), subject)).otherwise(
        F.concat(F.lit("t:"), F.md5(content_signature(content))))


class _Memory:
    """One memory's record while its group is at work."""

    FIELDS = [c.split()[0] for c in RECORD.split(", ")]

    def __init__(self, seq: int, values: tuple):
        self.seq, self.known = seq, set(values[2] or ())
        for name, value in zip(self.FIELDS, values):
            setattr(self, name, value)

    def values(self) -> tuple:
        return tuple(getattr(self, name) for name in self.FIELDS)


class Reconciler(StatefulProcessor):
    """State of one (scope, type, topic)."""

    def __init__(self, settings: Settings, asked_type: str):
        self.settings, self.record = settings, RECORD.format(asked=asked_type)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "seq long", self.record)
        self.settled = handle.getMapState("settled", "seq long", self.record)
        self.newest = handle.getValueState("newest", "seq long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        memories, requests = [], []
        for row in rows:
            (requests if row.action is not None else memories).append(row)
        held = {"open": self._load(self.open), "settled": None}
        changed: dict[int, _Memory] = {}
        newest = self.newest.get()[0] if self.newest.exists() else None
        for row in sorted(memories, key=lambda r: r.seq):
            newest = self._arrive(row, newest, held, changed, key[2])
        if memories:
            self.newest.update((newest,))
        for row in requests:
            self._ask(row, held, changed)
        for seq in sorted(changed):
            yield self._event(key, changed[seq])

    @staticmethod
    def _load(state) -> dict[int, _Memory]:
        return {k[0]: _Memory(k[0], tuple(v)) for k, v in state.iterator()}

    def _store(self, memory: _Memory, held: dict, changed: dict) -> None:
        """Write a record to the map it belongs to; a settled memory never opens again."""
        memory.version += 1
        changed[memory.seq] = memory
        if memory.newer_seq is None:
            held["open"][memory.seq] = memory
            self.open.updateValue((memory.seq,), memory.values())
            return
        if held["open"].pop(memory.seq, None) is not None:
            self.open.removeKey((memory.seq,))
        if held["settled"] is not None:
            held["settled"][memory.seq] = memory
        self.settled.updateValue((memory.seq,), memory.values())

    def _acts(self, newer: _Memory, older: _Memory, subject: bool) -> tuple | None:
        """(duplicate, overlap) if the newer one acts on the older one."""
        if newer.sig == older.sig:
            merged = self.settings.enable_consolidation and (
                self.settings.consolidation_confidence_threshold <= DUPLICATE_CONFIDENCE)
            return (True, 1.0) if merged else None
        if not subject or not self.settings.enable_contradiction_detection:
            return None
        shared = len(newer.known & older.known)
        overlap = shared / max(1, min(len(newer.known), len(older.known)))
        return (False, overlap) if overlap >= MIN_OVERLAP else None

    def _arrive(self, row: Row, newest: int | None, held: dict, changed: dict, topic: str):
        late = newest is not None and row.seq <= newest
        if late and held["settled"] is None:
            held["settled"] = self._load(self.settled)
        if late and (row.seq in held["open"] or row.seq in held["settled"]):
            return newest  # the row came before
        new = _Memory(row.seq, (
            row.mem_id, row.sig, row.tokens, row.replaces, *[None] * 7, 0))
        subject = topic.startswith("s:")
        older = [m for m in held["open"].values() if m.seq < row.seq]
        if late:
            older += [m for m in held["settled"].values() if m.seq < row.seq < m.newer_seq]
            newer = [m for part in ("open", "settled") for m in held[part].values()
                     if m.seq > row.seq]
            for m in sorted(newer, key=lambda m: m.seq):
                act = self._acts(m, new, subject)
                if act:
                    self._settle(new, m, act)
                    break
        for m in older:
            act = self._acts(new, m, subject)
            if act:
                self._settle(m, new, act)
                self._store(m, held, changed)
        self._store(new, held, changed)
        return row.seq if newest is None else max(newest, row.seq)

    @staticmethod
    def _settle(older: _Memory, newer: _Memory, act: tuple) -> None:
        older.duplicate, older.overlap = act
        older.newer_seq, older.newer_replaces = newer.seq, newer.replaces

    def _ask(self, row: Row, held: dict, changed: dict) -> None:
        memory = changed.get(row.seq) or held["open"].get(row.seq)
        if memory is None:
            memory = _Memory(row.seq, tuple(self.settled.getValue((row.seq,))))
        if memory.asked_first is None or row.asked < memory.asked_first:
            memory.asked_first = row.asked
        if memory.asked_last is None or row.asked > memory.asked_last:
            memory.asked_last, memory.action = row.asked, row.action
        self._store(memory, held, changed)

    def _event(self, key, m: _Memory) -> Row:
        status, kind, confidence, rel, newer = C.ACTIVE, None, None, None, None
        if m.newer_seq is not None and (m.asked_first is None or m.newer_seq < m.asked_first):
            newer, kind = m.newer_seq, "duplicate" if m.duplicate else "conflict"
            confidence = DUPLICATE_CONFIDENCE if m.duplicate else min(1.0, 0.7 + m.overlap / 5)
            sure = confidence >= self.settings.contradiction_confidence_threshold
            rel, status = (
                ("consolidated_into", C.ARCHIVED) if m.duplicate
                else ("supersedes", C.SUPERSEDED) if sure and m.newer_replaces
                else ("contradicts", C.NEEDS_REVIEW))
        status = {"forget": C.DELETED, "archive": C.ARCHIVED}.get(m.action, status)
        return Row(
            scope_id=key[0], mem_type=key[1], seq=m.seq, mem_id=m.mem_id, status=status,
            newer_seq=newer, kind=kind, overlap=m.overlap if kind else None,
            confidence=confidence, rel=rel, version=m.version)


def status_events(
    memories: DataFrame, requests: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """The event stream of two streams: memories (scope_id, seq, mem_id, mem_type, content) and
    requests (scope_id, mem_id, action, seq).  Both sequences count on one scale."""
    types = dict(memories.dtypes) | {"asked": dict(requests.dtypes)["seq"]}
    content = F.col("content")
    arriving = memories.select(
        "scope_id", "mem_type", topic(content, F.col("mem_id")).alias("topic"),
        F.col("seq").cast("long").alias("seq"), "mem_id",
        F.md5(content_signature(content)).alias("sig"),
        F.array_distinct(tokenize(content)).alias("tokens"),
        text_signals_supersession(content).alias("replaces"))
    blank = {name: kind for name, kind in arriving.dtypes}
    targets = arriving.select(*GROUP, "mem_id", F.col("seq").alias("made_at"))
    asked = requests.select(
        F.col("scope_id").alias("r_scope"), F.col("mem_id").alias("r_mem"), "action",
        F.col("seq").alias("asked"))
    routed = asked.join(
        targets, (F.col("r_scope") == F.col("scope_id")) & (F.col("r_mem") == F.col("mem_id"))
        & (F.col("asked") > F.col("made_at")))
    routed = routed.select(
        *GROUP, F.col("made_at").alias("seq"), "mem_id",
        *[F.lit(None).cast(blank[c]).alias(c) for c in ("sig", "tokens", "replaces")],
        "action", "asked")
    both = arriving.select(
        "*", F.lit(None).cast("string").alias("action"),
        F.lit(None).cast(types["asked"]).alias("asked")).unionByName(routed)
    return both.groupBy(*GROUP).transformWithState(
        Reconciler(settings, types["asked"]), EVENT.format(scope=types["scope_id"]),
        "append", "none")


def current_records(events: DataFrame) -> DataFrame:
    """The last event of every memory."""
    last = events.groupBy("scope_id", "mem_id").agg(
        F.max_by(F.struct(*[c for c in events.columns if c not in ("scope_id", "mem_id")]),
                 "version").alias("e"))
    return last.select("scope_id", "mem_id", "e.*")


def start_reconcile(
    memories: DataFrame, requests: DataFrame, folder: str, settings: Settings = DEFAULTS
) -> StreamingQuery:
    """Take all rows available now; events go to ``folder/events`` exactly once.

    Keyed state needs the RocksDB state store, which is set for this query alone.
    """
    spark = memories.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return (
            status_events(memories, requests, settings).writeStream.format("parquet")
            .outputMode("append").option("path", f"{folder}/events")
            .option("checkpointLocation", f"{folder}/_checkpoint")
            .trigger(availableNow=True).start())
    finally:
        spark.conf.set(PROVIDER, before)
