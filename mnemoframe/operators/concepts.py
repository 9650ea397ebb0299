"""The concept (entity and topic) index over memories."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe import constants as C
from mnemoframe.functions.concepts import cap_concepts, named_concepts, with_normal
from mnemoframe.functions.text import normalize_concept
from mnemoframe.operators.groups import by_shuffle, materialize
from mnemoframe.operators.hooks import call_once
from mnemoframe.operators.retrieve import SCORE_DIGITS, vector_search, with_embedding
from mnemoframe.settings import DEFAULTS, Settings

# memory numbers of a scope that one cell of a concept spans
CELL_ROWS = 4096
# rows that one call compares, in as many keys as that takes
ROWS_PER_CALL = 4096


def provided_concepts(
    memories: DataFrame, extractor: Callable[[list, list], list],
    settings: Settings = DEFAULTS, **options,
) -> DataFrame:
    """Names from ``extractor(contents, types)``, capped and de-duplicated.

    Equal (content, type) is one call; a memory whose call fails has no concepts.
    """
    called = call_once(
        memories, ["content", "mem_type"], extractor, "array<string>", "concepts", **options)
    return called.drop("failure").withColumn(
        "concepts", cap_concepts(F.col("concepts"), settings.max_concepts_per_memory))


def _mentions(memories: DataFrame, settings: Settings) -> DataFrame:
    """(memory, concept name) rows; ``concepts`` is used when the column exists."""
    if "concepts" in memories.columns:
        names = with_normal(F.slice("concepts", 1, settings.max_concepts_per_memory))
    else:
        names = named_concepts(F.col("content"), settings.max_concepts_per_memory)
    return (
        memories.select(
            "scope_id", "seq", "mem_id", "mem_type",
            F.posexplode_outer(names).alias("pos", "n"))
        .filter("n.name is not null and n.normalized != ''")
        .select("scope_id", "seq", "mem_id", "mem_type", "pos", "n.name", "n.normalized")
    )


def concept_id() -> Column:
    return F.concat(F.lit("memory_concept#"), F.md5("normalized"))


def build_concepts(memories: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One concept per normal form: first-seen name and kind, mention count, aliases.

    Aliases are distinct surface forms; a normal form has few of them.
    """
    kind = F.when(F.col("mem_type") == C.PROCEDURAL, "topic").otherwise("entity")
    surfaces = (
        _mentions(memories, settings).withColumn("kind", kind)
        .groupBy("scope_id", "normalized", "name")
        .agg(F.min(F.struct("seq", "pos", "kind")).alias("seen"), F.count("*").alias("n"))
    )
    return surfaces.groupBy("scope_id", "normalized").agg(
        F.min(F.struct("seen.seq", "seen.pos", "name", "seen.kind")).alias("first"),
        F.sum("n").alias("mention_count"),
        F.array_sort(F.collect_list("name")).alias("surfaces"),
    ).select(
        "scope_id", concept_id().alias("concept_id"), "first.name", "first.kind", "normalized",
        F.array_remove("surfaces", F.col("first.name")).alias("aliases"),
        "mention_count", F.col("first.seq").alias("seq"),
    )


def about_entity_edges(memories: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Memory -> concept edges.  A concept id follows from its normal form, so no
    join with the concept table is needed."""
    return _mentions(memories, settings).select(
        "scope_id", F.col("mem_id").alias("src_id"), F.col("mem_type").alias("src_type"),
        concept_id().alias("dst_id"), F.lit(C.CONCEPT).alias("dst_type"),
        F.lit("about_entity").alias("rel"), "seq",
    )


def search_concepts(
    concepts: DataFrame, plans: DataFrame, limit: int, use_aliases: bool = False, **tuning
) -> DataFrame:
    """Vector top-k of concept texts (name, optionally with aliases) per question."""
    text = (
        F.concat_ws(" ", "name", F.array_join("aliases", " ")) if use_aliases else F.col("name"))
    searchable = with_embedding(
        concepts.select(
            "scope_id", F.col("concept_id").alias("mem_id"), F.lit(C.CLAIM).alias("mem_type"),
            F.lit(C.ACTIVE).alias("status"), F.trim(text).alias("content")),
        "content")
    every_type = plans.withColumn("types", F.array(F.lit(C.CLAIM)))
    return vector_search(searchable, every_type, limit, **tuning).withColumnRenamed(
        "mem_id", "concept_id")


def question_entities(plans: DataFrame) -> DataFrame:
    """(query_id, scope_id, normalized) rows of the names a question mentions."""
    # each normal form comes once, none is empty; the outer form adds no filter on the array
    names = F.transform(named_concepts(F.col("question")), lambda n: n["normalized"])
    return plans.select(
        "query_id", "scope_id", F.explode_outer(names).alias("normalized"),
    ).filter("normalized is not null")


def lookup_concepts(concepts: DataFrame, plans: DataFrame) -> DataFrame:
    """Concepts whose name or alias is named by the question, exactly."""
    forms = concepts.select(
        "scope_id", "concept_id",
        F.explode(F.array_distinct(F.concat(
            F.array("normalized"), F.transform("aliases", normalize_concept)))
        ).alias("normalized"),
    )
    return question_entities(plans).join(by_shuffle(forms), ["scope_id", "normalized"]).select(
        "query_id", "scope_id", "concept_id").distinct()


def meet_links(asked: DataFrame, links: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Join question rows with memory rows on (scope_id, concept_id), whatever its size.

    ``links`` has ``seq``, so a concept that every memory of a scope names is cut into cells of
    at most ``cell_rows`` numbers without counting it first; the question rows are repeated for
    the cells that exist, which is one summary row per concept and cell.
    """
    key = ["scope_id", "concept_id"]
    celled = links.withColumn("_cell", F.floor(F.col("seq") / cell_rows))
    cells = celled.select(*key, "_cell").distinct()
    cells = cells.select(*[F.col(c).alias(c) for c in cells.columns])
    return asked.join(by_shuffle(cells), key).join(
        by_shuffle(celled), [*key, "_cell"]).drop("_cell")


def facts_for_concepts(concept_hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (query, fact) rows linked to the hit concepts."""
    links = edges.filter(F.col("rel") == "about_entity").select(
        "scope_id", F.col("src_id").alias("mem_id"), F.col("dst_id").alias("concept_id"), "seq")
    hits = concept_hits.select("query_id", "scope_id", "concept_id")
    return meet_links(hits, links).select("query_id", "scope_id", "mem_id").distinct()


def entity_overlap(facts: DataFrame, edges: DataFrame, plans: DataFrame) -> DataFrame:
    """Number of question entities each (query, fact) pair is linked to."""
    named = question_entities(plans).withColumn("dst_id", concept_id()).select(
        "query_id", "scope_id", "dst_id")
    links = edges.filter(F.col("rel") == "about_entity").select("scope_id", "src_id", "dst_id")
    counted = (
        facts.select("query_id", "scope_id", F.col("mem_id").alias("src_id"))
        .join(links, ["scope_id", "src_id"])
        .join(named, ["query_id", "scope_id", "dst_id"])
        .groupBy("query_id", "scope_id", F.col("src_id").alias("mem_id"))
        .agg(F.count_distinct("dst_id").alias("n_shared"))
    )
    return facts.join(counted, ["query_id", "scope_id", "mem_id"], "left").fillna(
        0, subset=["n_shared"])


def _close_pairs(limit: float):
    """Pairs under the same key, each at the first key that both vectors have."""
    keys = ["scope_id", "key", "i", "j"]

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            v, w = np.vstack(left["v"]), np.vstack(right["v"])
            ids, others = left["id"].to_numpy(), right["id"].to_numpy()
            prefixes, theirs = left["prefix"].to_numpy(), right["prefix"].to_numpy()
            of_right = right.groupby(keys, sort=False).indices
            for (scope, key, x, y), rows in left.groupby(keys, sort=False).indices.items():
                cols = of_right.get((scope, key, x, y), ())
                if not len(cols):
                    continue
                similarity = np.round(v[rows] @ w[cols].T, SCORE_DIGITS)
                for m, n in zip(*np.nonzero(similarity >= limit)):
                    a, b = ids[rows[m]], others[cols[n]]
                    if a == b or (x == y and a > b):
                        continue
                    shared = set(theirs[cols[n]])
                    if next(k for k in prefixes[rows[m]] if k in shared) == key:
                        found.append((scope, min(a, b), max(a, b), similarity[m, n]))
        return pd.DataFrame(found, columns=["scope_id", "a", "b", "similarity"])

    return compare


def prefix_keys(vectors: DataFrame, limit: float) -> DataFrame:
    """Add ``prefix``: the keys under which a vector can meet one of cosine >= ``limit``.

    A key is a coordinate and its sign.  Coordinates are ordered by how few vectors of the
    scope use them.  What follows the prefix has a norm below ``limit``, so it alone cannot
    reach the limit with any unit vector (Cauchy-Schwarz); two vectors that do reach it share
    a key of both prefixes.
    """
    entries = vectors.select("scope_id", "id", F.posexplode("v").alias("at", "w")).filter("w != 0")
    used = entries.groupBy("scope_id", "at").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("scope_id", "id").orderBy("n", "at")
    following = rarest.rowsBetween(0, Window.unboundedFollowing)
    # the slack covers rounding of the sums
    kept = entries.join(by_shuffle(used), ["scope_id", "at"]).withColumn(
        "rest", F.sqrt(F.sum(F.col("w") * F.col("w")).over(following))
    ).filter(F.col("rest") >= limit - 1e-6)
    key = F.col("at") * 2 + (F.col("w") > 0).cast("int")
    prefixes = kept.groupBy("scope_id", "id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("n", "at", key.alias("key")))), lambda e: e["key"]
    ).alias("prefix"))
    return vectors.join(by_shuffle(prefixes), ["scope_id", "id"])


def similar_concepts(
    concepts: DataFrame, threshold: float | None = None, block_rows: int = 2048
) -> DataFrame:
    """same_entity_as pairs: concepts of a scope whose name vectors nearly agree, each once.

    Concepts with the very same vector are linked to the first of them only, never to each
    other.  Distinct vectors meet only under the keys of their prefixes; a key that many
    vectors have is cut into blocks, and each pair of blocks is one bounded matrix product.
    Vectors of zeros (names whose token hashes cancel) are like no other.
    """
    limit = DEFAULTS.concept_dedup_similarity if threshold is None else threshold
    # most coordinates of a short name are zero, and rounding goes through decimals
    rounded = F.transform("embedding", lambda x: F.when(x == 0, 0.0).otherwise(F.round(x, 12)))
    # read by five branches below
    vectors = materialize(with_embedding(
        concepts.select("scope_id", "concept_id", "normalized"), "normalized"
    ).select("scope_id", "concept_id", rounded.alias("v"))
        .filter(F.exists("v", lambda x: x != 0)))
    firsts = vectors.groupBy("scope_id", "v").agg(F.min("concept_id").alias("id"))
    same = vectors.join(by_shuffle(firsts), ["scope_id", "v"]).filter("concept_id != id").select(
        "scope_id", F.col("id").alias("a"), F.col("concept_id").alias("b"),
        F.lit(1.0).alias("similarity"))
    met = materialize(prefix_keys(firsts, limit)).withColumn("key", F.explode("prefix"))
    # a key that one vector has alone makes no pair
    blocks = met.groupBy("scope_id", "key").agg(
        F.count("*").alias("n"), F.ceil(F.count("*") / block_rows).cast("int").alias("n_blocks")
    ).filter("n > 1")
    placed = met.join(by_shuffle(blocks), ["scope_id", "key"]).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    left = placed.select(
        "scope_id", "key", "id", "v", "prefix", F.col("block").alias("i"),
        F.explode(F.sequence("block", F.col("n_blocks") - 1)).alias("j"))
    right = placed.select(
        "scope_id", "key", "id", "v", "prefix",
        F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"))
    # columns get new identities, because both sides come from the same rows
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    total = blocks.agg(F.sum(F.col("n") * F.col("n_blocks"))).first()[0] or 0
    call = F.pmod(F.xxhash64("scope_id", "key", "i", "j"), F.lit(total // ROWS_PER_CALL + 1))
    left, right = left.withColumn("call", call), right.withColumn("call", call)
    scope_type = dict(concepts.dtypes)["scope_id"]
    close = left.groupBy("call").cogroup(right.groupBy("call")).applyInPandas(
        _close_pairs(limit), f"scope_id {scope_type}, a string, b string, similarity double")
    return same.unionByName(close)


def merge_groups(pairs: DataFrame) -> DataFrame:
    """Connected components: every concept with the smallest id of its group.

    Each round takes the smallest root among the neighbours, then the root of that root, so
    labels travel twice as far each time; the loop ends when nothing moves.
    """
    pairs = materialize(pairs.select("scope_id", "a", "b"))
    edges = materialize(pairs.unionByName(
        pairs.select("scope_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = edges.select("scope_id", F.col("a").alias("concept_id")).distinct().withColumn(
        "root", F.col("concept_id"))
    moving = True
    while moving:
        labels = materialize(labels)
        offered = edges.join(
            by_shuffle(labels.withColumnRenamed("concept_id", "b")), ["scope_id", "b"]
        ).groupBy("scope_id", F.col("a").alias("concept_id")).agg(F.min("root").alias("offer"))
        moved = materialize(
            labels.join(by_shuffle(offered), ["scope_id", "concept_id"])
            .select("scope_id", "concept_id", "root", F.least("root", "offer").alias("near")))
        moving = not moved.filter("near < root").isEmpty()
        further = moved.select(
            "scope_id", F.col("concept_id").alias("near"), F.col("near").alias("far"))
        labels = moved.join(by_shuffle(further), ["scope_id", "near"]).select(
            "scope_id", "concept_id", F.least("near", "far").alias("root"))
    return labels
