"""Which newer memory replaces, contradicts or duplicates which older one.

A memory is compared, when it is created, with older memories that are still
active.  Whether a newer memory acts on an older one therefore depends only on
the older one's status, so every older memory is changed by exactly one other: its
first conflicting or duplicate successor.  Finding that first successor is all
that is needed; no pair list of a group is ever built.

1. Duplicates: the next memory with the same signature (a chunked ``lead``).
2. Conflicts, near: a window looks a few memories ahead within the subject key.
3. Conflicts, far: rows the window could not settle search the rest of their chunk of
   ``block_rows`` numbers in one bounded task, and then cells of doubling size: at each level a
   row of an even cell searches the whole next cell.  Settled rows drop out before the next
   level, and the levels come in the order of the numbers, so the first hit is the first
   successor.  Within a cell candidates come from a set-overlap join on rare tokens (see
   ``_overlap_entries``), not from pairs of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe import constants as C
from mnemoframe.functions.text import (
    content_signature,
    subject_key,
    text_signals_supersession,
    token_overlap,
    tokenize,
)
from mnemoframe.operators.groups import materialize, next_in_group, stored
from mnemoframe.settings import DEFAULTS, Settings

MIN_OVERLAP = 0.4
DUPLICATE_CONFIDENCE = 0.9
LOOK_AHEAD = 8
BLOCK_ROWS = 1024

_GROUP = ["scope_id", "mem_type", "subject"]


def _comparable(memories: DataFrame) -> DataFrame:
    """What comparison needs; the text itself is left behind."""
    content = F.col("content")
    return memories.filter(F.coalesce(content, F.lit("")) != "").select(
        "scope_id", "mem_type", "seq", "mem_id",
        F.md5(content_signature(content)).alias("sig"),
        subject_key(content).alias("subject"),
        F.array_distinct(tokenize(content)).alias("tokens"),
        text_signals_supersession(content).alias("replaces"),
    )


def _search_block(key, survivors: pd.DataFrame, later: pd.DataFrame) -> pd.DataFrame:
    """Earliest conflicting row of one block for every survivor of another block."""
    columns = ["scope_id", "mem_type", "seq", "killer_seq", "overlap", "replaces"]
    if survivors.empty or later.empty:
        return pd.DataFrame(columns=columns)
    later = later.sort_values("seq", ignore_index=True)
    lengths = later["tokens"].map(len).to_numpy()
    flat = np.concatenate(later["tokens"].to_numpy())
    rows = np.repeat(np.arange(len(later)), lengths)
    codes, words = pd.factorize(flat)
    by_code = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[by_code], np.arange(len(words) + 1))
    code_of = {w: i for i, w in enumerate(words)}
    later_seq, later_sig = later["seq"].to_numpy(), later["sig"].to_numpy()
    later_replaces = later["replaces"].to_numpy()
    found = []
    for s in survivors.itertuples(index=False):
        known = [code_of[t] for t in s.tokens if t in code_of]
        hits = [rows[by_code[bounds[c]:bounds[c + 1]]] for c in known]
        if not hits:
            continue
        shared = np.bincount(np.concatenate(hits), minlength=len(later))
        overlap = shared / np.maximum(1, np.minimum(len(s.tokens), lengths))
        match = (
            (overlap >= MIN_OVERLAP) & (later_seq > s.seen_to)
            & (later_sig != s.sig) & (later_seq < s.stop_at)
        )
        at = int(match.argmax())
        if match[at]:
            found.append((s.scope_id, s.mem_type, s.seq, later_seq[at], overlap[at],
                          later_replaces[at]))
    return pd.DataFrame(found, columns=columns)


def _fresh(df: DataFrame, *columns: str) -> DataFrame:
    """The columns under new identities, so both sides of a self-join stay apart."""
    return df.select(*[F.col(c).alias(c) for c in columns])


def _chunk_conflicts(survivors: DataFrame, rows: DataFrame, block_rows: int) -> DataFrame:
    """Search the rest of its chunk for every row the look-ahead could not settle."""
    keys = [*_GROUP, "block"]
    block = F.floor(F.col("seq") / block_rows).alias("block")
    left = survivors.select(*_GROUP, block, "seq", "sig", "tokens", "seen_to", "stop_at")
    right = _fresh(rows.select(*_GROUP, block, "seq", "sig", "tokens", "replaces"),
                   *keys, "seq", "sig", "tokens", "replaces")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = (
        f"scope_id {types['scope_id']}, mem_type string, seq {types['seq']}, "
        f"killer_seq {types['seq']}, overlap double, replaces boolean"
    )
    # chunks without a survivor are left out before the texts move
    right = right.join(left.select(*keys).distinct(), keys, "left_semi")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _search_block, schema)


def _sized(rows: DataFrame) -> DataFrame:
    """Add the number of tokens and how many a smaller set must share beyond the subject.

    Rows of a subject share its tokens.  A row that needs no more (``needed`` <= 0) conflicts
    with every row of its subject that is at least as long and has another signature.
    """
    subject = F.array_distinct(F.split("subject", " "))
    n = F.size("tokens")
    least = F.expr("(2 * size(tokens) + 4) div 5")  # the smallest share of 0.4
    return rows.withColumns({
        "n": n, "needed": least - F.size(subject), "rest": F.array_except("tokens", subject)})


def _overlap_entries(rows: DataFrame) -> DataFrame:
    """One row per memory and token beyond the subject: group, seq, n, token, rare.

    The smaller of two overlapping sets shares ``needed`` tokens with the larger, so any
    choice of all but ``needed - 1`` of its tokens holds a shared one.  ``rare`` marks that
    choice: the tokens that fewest rows of the group hold.  A pair is a candidate where a
    rare token of its smaller set occurs in the larger one.
    """
    exploded = rows.filter("needed > 0").select(
        *_GROUP, "seq", "n", "needed", F.size("rest").alias("n_rest"),
        F.explode("rest").alias("token"))
    frequency = exploded.groupBy(*_GROUP, "token").agg(F.count("*").alias("frequency"))
    by_rarity = Window.partitionBy("scope_id", "seq").orderBy("frequency", "token")
    return exploded.join(frequency, [*_GROUP, "token"]).select(
        *_GROUP, "seq", "n", "token",
        (F.row_number().over(by_rarity) <= F.col("n_rest") - F.col("needed") + 1).alias("rare"))


def _first_two(rows: DataFrame) -> DataFrame:
    """Per group and cell: the first row, and the first one of another signature."""
    keys = [*_GROUP, "cell"]
    row = F.struct("seq", "sig", "tokens", "replaces")
    first = rows.groupBy(*keys).agg(F.min_by(row, "seq").alias("first"))
    return rows.join(first, keys).groupBy(*keys).agg(
        F.min("first").alias("first"),
        F.min_by(F.when(F.col("sig") != F.col("first.sig"), row),
                 F.when(F.col("sig") != F.col("first.sig"), F.col("seq"))).alias("other"))


def _sharing_pairs(survivors: DataFrame, entries: DataFrame) -> DataFrame:
    """(scope_id, older, seq): rows of the named cell whose overlap may be large enough."""
    asked = survivors.select("scope_id", "seq", "cell")
    left = entries.drop("cell").join(asked, ["scope_id", "seq"]).select(
        *_GROUP, "cell", "token", F.col("seq").alias("older"), F.col("n").alias("older_n"),
        F.col("rare").alias("older_rare"))
    right = _fresh(entries, *_GROUP, "cell", "token", "seq", "n", "rare")
    shared = left.join(right, [*_GROUP, "cell", "token"]).filter(
        F.when(F.col("n") >= F.col("older_n"), F.col("older_rare")).otherwise(F.col("rare")))
    return shared.select("scope_id", "older", "seq").distinct()


def _cell_conflicts(survivors: DataFrame, rows: DataFrame, entries: DataFrame) -> DataFrame:
    """First conflicts of ``survivors`` with rows of the cell they name.

    Candidates: rows that share a rare token; the first rows short enough to conflict with
    all of the subject; and for a short survivor the first rows of the cell.
    """
    pairs = _sharing_pairs(survivors, entries)
    later = _fresh(rows, "scope_id", "seq", "sig", "tokens", "replaces")
    offered = pairs.join(later, ["scope_id", "seq"]).select(
        "scope_id", F.col("older").alias("older_seq"),
        F.struct("seq", "sig", "tokens", "replaces").alias("c"))
    named = survivors.select("scope_id", F.col("seq").alias("older_seq"), *_GROUP[1:], "cell",
                             "sig", "tokens", "needed", "stop_at")
    for firsts, fits in ((_first_two(rows.filter("needed <= 0")), F.lit(True)),
                         (_first_two(rows), F.col("needed") <= 0)):
        either = named.filter(fits).join(_fresh(firsts, *firsts.columns), [*_GROUP, "cell"])
        offered = offered.unionByName(either.select(
            "scope_id", "older_seq", F.explode(F.array("first", "other")).alias("c")))
    overlap = token_overlap(F.col("c.tokens"), F.col("tokens"))
    return offered.filter("c is not null").join(named, ["scope_id", "older_seq"]).filter(
        (F.col("c.sig") != F.col("sig")) & (F.col("c.seq") < F.col("stop_at"))
        & (overlap >= MIN_OVERLAP)
    ).groupBy("scope_id", "mem_type", F.col("older_seq").alias("seq")).agg(
        F.min(F.struct("c.seq", overlap.alias("overlap"), "c.replaces")).alias("f")).select(
        "scope_id", "mem_type", "seq", F.col("f.seq").alias("killer_seq"), "f.overlap",
        "f.replaces")


def _far_conflicts(
    survivors: DataFrame, rows: DataFrame, block_rows: int, last_seq: int
) -> DataFrame:
    """First conflicts beyond the look-ahead: chunk first, then cells of doubling size."""
    found = [materialize(_chunk_conflicts(survivors, rows, block_rows))]
    half = block_rows
    if half > last_seq:
        return found[0]
    left = materialize(_sized(survivors.join(
        found[0].select("scope_id", "seq"), ["scope_id", "seq"], "left_anti").filter(
        F.col("stop_at") > (F.floor(F.col("seq") / half) + 1) * half)))
    # only groups that still have unsettled rows
    rows = materialize(_sized(rows.join(
        left.select(*_GROUP).distinct(), _GROUP, "left_semi")))
    entries = materialize(_overlap_entries(rows))
    while half <= last_seq:
        cell = F.floor(F.col("seq") / half)
        asking = left.withColumn("cell", cell + 1).filter(
            (cell % 2 == 0) & (F.col("stop_at") > (cell + 1) * half))
        hits = materialize(_cell_conflicts(
            asking, rows.withColumn("cell", cell), entries.withColumn("cell", cell)))
        found.append(hits)
        left = materialize(left.join(
            hits.select("scope_id", "seq"), ["scope_id", "seq"], "left_anti"))
        half *= 2
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def first_successors(
    memories: DataFrame, settings: Settings = DEFAULTS,
    look_ahead: int = LOOK_AHEAD, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per memory that a later one acts on: its first successor.

    Columns: scope_id, mem_type, older_seq, newer_seq, kind ('duplicate' or
    'conflict'), overlap, replaces (the newer text signals a replacement).
    """
    # compressed, and most readers leave the tokens out
    rows = stored(_comparable(memories))
    linked = rows.drop("tokens", "replaces")
    merge_on = (
        settings.enable_consolidation
        and settings.consolidation_confidence_threshold <= DUPLICATE_CONFIDENCE
    )
    if merge_on:
        linked = next_in_group(linked, ["scope_id", "mem_type", "sig"], "seq", "duplicate_seq")
    else:
        linked = linked.withColumn("duplicate_seq", F.lit(None).cast("long"))
    duplicate = (
        F.lit("duplicate").alias("kind"), F.lit(1.0).alias("overlap"),
        F.lit(False).alias("replaces"))
    if not settings.enable_contradiction_detection:
        return linked.filter("duplicate_seq is not null").select(
            "scope_id", "mem_type", F.col("seq").alias("older_seq"),
            F.col("duplicate_seq").alias("newer_seq"), *duplicate)

    chunk = F.floor(F.col("seq") / block_rows)
    following = Window.partitionBy(*_GROUP, "chunk").orderBy("seq").rowsBetween(1, look_ahead)
    conflict = F.get(F.filter(
        "ahead",
        lambda n: (n["sig"] != F.col("sig"))
        & (token_overlap(n["tokens"], F.col("tokens")) >= MIN_OVERLAP),
    ), F.lit(0))
    near = (
        rows.filter("subject != ''").withColumn("chunk", chunk)
        .withColumn("ahead", F.collect_list(
            F.struct("seq", "sig", "tokens", "replaces")).over(following))
        .select(
            "scope_id", "seq", "chunk", F.size("ahead").alias("n_ahead"),
            F.get(F.col("ahead.seq"), F.size("ahead") - 1).alias("last_seen"), "tokens",
            conflict.alias("hit"))
        .select(
            "scope_id", "seq", "chunk", "n_ahead",
            F.coalesce("last_seen", "seq").alias("seen_to"),
            F.col("hit.seq").alias("near_seq"), F.col("hit.replaces").alias("replaces"),
            token_overlap(F.col("hit.tokens"), F.col("tokens")).alias("overlap"))
    )
    # narrow: numbers and flags only
    looked = materialize(linked.join(near, ["scope_id", "seq"], "left"))

    open_ended = F.coalesce("duplicate_seq", F.lit(2**62))
    candidates = looked.filter(
        F.col("n_ahead").isNotNull() & F.col("near_seq").isNull()
        & (open_ended > F.col("seen_to")))
    # groups may go on past the chunk where the window stopped
    last_chunk = looked.groupBy(*_GROUP).agg(F.max("chunk").alias("last_chunk"))
    unsettled = materialize(candidates.join(last_chunk, _GROUP).filter(
        (F.col("n_ahead") == look_ahead) | (F.col("last_chunk") > F.col("chunk"))))
    by_near = F.col("near_seq") < open_ended
    settled = looked.select(
        "scope_id", "mem_type", F.col("seq").alias("older_seq"),
        F.least("near_seq", "duplicate_seq").alias("newer_seq"),
        F.when(by_near, "conflict").otherwise("duplicate").alias("kind"),
        F.when(by_near, F.col("overlap")).otherwise(1.0).alias("overlap"),
        F.coalesce(by_near & F.col("replaces"), F.lit(False)).alias("replaces"),
    ).filter("newer_seq is not null")
    last_seq = unsettled.agg(F.max((F.col("last_chunk") + 1) * block_rows - 1)).first()[0]
    if last_seq is None:  # nothing unsettled, nothing to search
        return settled

    searched = unsettled.select("scope_id", "seq", "seen_to", open_ended.alias("stop_at")).join(
        rows, ["scope_id", "seq"])
    far = _far_conflicts(searched, rows.filter("subject != ''"), block_rows, last_seq).select(
        "scope_id", "mem_type", F.col("seq").alias("older_seq"),
        F.col("killer_seq").alias("newer_seq"), F.lit("conflict").alias("kind"), "overlap",
        "replaces")
    # a far conflict comes before the duplicate of the same memory, so it replaces it
    far = materialize(far)
    return settled.join(
        far.select("scope_id", "older_seq"), ["scope_id", "older_seq"], "left_anti"
    ).unionByName(far)


def memory_id(mem_type: str, seq: str):
    """Ids follow from type and number, so no join is needed to name a memory."""
    return F.concat_ws("#", mem_type, seq)


def reconcile(
    memories: DataFrame, settings: Settings = DEFAULTS, requests: DataFrame | None = None,
    unasked: DataFrame | None = None, **tuning,
) -> DataFrame:
    """One row per effective change of an older memory by a newer one.

    Adds newer/older ids, the relation, its confidence and the older one's new
    status.  ``requests`` (scope_id, mem_id, action, seq) made before a successor
    appeared keep that successor from acting.  ``unasked`` are the changes of the same memories
    and settings without requests, where they are at hand: successors are not sought again.
    """
    changes = _changes(memories, settings, **tuning) if unasked is None else unasked
    if requests is not None:
        first_request = _effective_requests(memories, requests).groupBy(
            "scope_id", F.col("mem_id").alias("older_id")
        ).agg(F.min("seq").alias("request_seq"))
        changes = changes.join(first_request, ["scope_id", "older_id"], "left").filter(
            F.col("request_seq").isNull() | (F.col("newer_seq") < F.col("request_seq")))
    return changes.select(
        "scope_id", "mem_type", "older_seq", "older_id", "newer_seq", "newer_id",
        "kind", "overlap", "confidence", "rel", "new_status")


def _changes(memories: DataFrame, settings: Settings, **tuning) -> DataFrame:
    """What every successor does, whatever was requested."""
    duplicate = F.col("kind") == "duplicate"
    confidence = F.when(duplicate, F.lit(DUPLICATE_CONFIDENCE)).otherwise(
        F.least(F.lit(1.0), F.lit(0.7) + F.col("overlap") / 5))
    sure = F.col("confidence") >= settings.contradiction_confidence_threshold
    relation = (
        F.when(duplicate, "consolidated_into")
        .when(sure & F.col("replaces"), "supersedes")
        .otherwise("contradicts"))
    status = (
        F.when(F.col("rel") == "consolidated_into", C.ARCHIVED)
        .when(F.col("rel") == "supersedes", C.SUPERSEDED)
        .otherwise(C.NEEDS_REVIEW))
    return (
        first_successors(memories, settings, **tuning)
        .withColumns({
            "older_id": memory_id("mem_type", "older_seq"),
            "newer_id": memory_id("mem_type", "newer_seq"),
            "confidence": confidence})
        .withColumn("rel", relation).withColumn("new_status", status))


def _effective_requests(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests whose target exists when they are made."""
    targets = memories.select("scope_id", "mem_id", F.col("seq").alias("made_at"))
    return requests.join(targets, ["scope_id", "mem_id"]).filter(
        F.col("seq") > F.col("made_at")).drop("made_at")


def reconcile_edges(changes: DataFrame) -> DataFrame:
    """supersedes / contradicts edges, newer -> older."""
    return changes.filter(F.col("kind") == "conflict").select(
        "scope_id", F.col("newer_id").alias("src_id"), F.col("mem_type").alias("src_type"),
        F.col("older_id").alias("dst_id"), F.col("mem_type").alias("dst_type"), "rel",
        F.col("newer_seq").alias("seq"),
    )


def consolidations(changes: DataFrame) -> DataFrame:
    """One record per newer duplicate.

    Only the previous copy can still be active when a new copy arrives, so a record
    always has exactly two sources.
    """
    return changes.filter(F.col("kind") == "duplicate").select(
        "scope_id", F.col("newer_seq").alias("seq"), "mem_type",
        F.concat(F.lit("memory_consolidation#"), F.col("newer_seq")).alias("consolidation_id"),
        F.array("older_id", "newer_id").alias("source_memory_ids"),
        F.col("newer_id").alias("consolidated_memory_id"),
        F.lit(C.DUPLICATE_REASON).alias("reason"), "confidence",
    )


def consolidation_edges(records: DataFrame) -> DataFrame:
    return records.select(
        "scope_id", F.explode("source_memory_ids").alias("src_id"),
        F.col("mem_type").alias("src_type"), F.col("consolidation_id").alias("dst_id"),
        F.lit("memory_consolidation").alias("dst_type"),
        F.lit("consolidated_into").alias("rel"), "seq",
    )


def with_status(
    memories: DataFrame, changes: DataFrame, requests: DataFrame | None = None
) -> DataFrame:
    """Current status: last request, else the first successor's effect, else active."""
    changed = changes.select("scope_id", F.col("older_seq").alias("seq"), "new_status")
    current = memories.drop("status").join(changed, ["scope_id", "seq"], "left")
    if requests is None:
        asked = F.lit(None).cast("string")
    else:
        latest = (
            _effective_requests(memories, requests).groupBy("scope_id", "mem_id")
            .agg(F.max_by("action", "seq").alias("_action"))
        )
        current = current.join(latest, ["scope_id", "mem_id"], "left")
        asked = F.when(F.col("_action") == "forget", C.DELETED).when(
            F.col("_action") == "archive", C.ARCHIVED)
    return current.withColumn(
        "status", F.coalesce(asked, "new_status", F.lit(C.ACTIVE))
    ).drop("new_status", "_action")


def lifecycle_audit(memories: DataFrame, relations: DataFrame) -> DataFrame:
    """Per memory: evidence, successors, conflicts, retrievals, answers, evaluations.

    Counts and one example per role, so a much-used memory stays one short row.
    """
    as_source = relations.select(
        "scope_id", F.col("src_id").alias("mem_id"), "rel", F.col("dst_id").alias("other"),
        F.lit("out").alias("way"))
    as_target = relations.select(
        "scope_id", F.col("dst_id").alias("mem_id"), "rel", F.col("src_id").alias("other"),
        F.lit("in").alias("way"))

    def role(rel: str, way: str):
        return (F.col("rel") == rel) & (F.col("way") == way)

    roles = {
        "n_sources": role("derived_from", "out"),
        "n_evidence": role("supports", "in"),
        "n_superseded_by": role("supersedes", "in"),
        "n_conflicts": F.col("rel") == "contradicts",
        "n_retrievals": role("retrieved_for", "out"),
        "n_answers": role("used_in_answer", "out"),
    }
    used = relations.filter(F.col("rel") == "used_in_answer").select(
        "scope_id", F.col("src_id").alias("mem_id"), F.col("dst_id").alias("answer_id"))
    judged = relations.filter(F.col("rel").isin("validated_by", "invalidated_by")).select(
        "scope_id", F.col("src_id").alias("answer_id"))
    evaluated = used.join(judged, ["scope_id", "answer_id"]).groupBy("scope_id", "mem_id").agg(
        F.count("*").alias("n_evaluations"))
    summary = (
        as_source.unionByName(as_target).groupBy("scope_id", "mem_id")
        .agg(*[F.count_if(cond).alias(name) for name, cond in roles.items()],
             F.min(F.when(roles["n_sources"], F.col("other"))).alias("source_obs"),
             F.min(F.when(roles["n_superseded_by"], F.col("other"))).alias("superseded_by"))
    )
    counted = [*roles, "n_evaluations"]
    return (
        memories.select("scope_id", "mem_id", "mem_type", "status")
        .join(summary, ["scope_id", "mem_id"], "left")
        .join(evaluated, ["scope_id", "mem_id"], "left")
        .fillna(0, subset=counted)
    )


def compact(memories: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop deleted memories and every edge that touches one."""
    gone = memories.filter(F.col("status") == C.DELETED).select("scope_id", "mem_id")
    kept = relations
    for end in ("src_id", "dst_id"):
        kept = kept.join(
            gone.withColumnRenamed("mem_id", end), ["scope_id", end], "left_anti")
    return memories.filter(F.col("status") != C.DELETED), kept
