"""One query per operator, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import (
    decontaminate,
    exact_dedup,
    html_text,
    lexical_search,
    mixing,
    near_dedup,
    periodic,
    pii,
    quality,
    sharding,
    token_counts,
    toxicity,
    url_filter,
)
from mnemoframe.llm.catalog import query

# the rules of the query, as its contract gives them
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def _judged(scored: DataFrame, modulus: int, remainder: int, cut: float) -> DataFrame:
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"))


@query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(
        quality.narrow(docs), table(spark, sf_dir, "labels"),
        ~quality.held_out(F.col("doc_id"), 5, 0))
    return _judged(quality.score(docs, model), 5, 0, 0.3)


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(
        toxicity.narrow(docs), table(spark, sf_dir, "labels"),
        ~quality.held_out(F.col("doc_id"), 3, 1))
    return _judged(toxicity.score(docs, model), 3, 1, 0.7)


@query(r"""
WITH rules(verdict, host, path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3)
                       ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM cut),
hits AS (
  SELECT page_id, r.host || r.path AS rule, verdict
  FROM parts p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC) = 1)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts p LEFT JOIN hits USING (page_id)
""")
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA)
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


@query(r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept,
       text_sha256
FROM d
WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query()
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group(table(spark, sf_dir, "documents"))


@query()
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query()
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = [F.col(k) for k in pii.BASE]
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined([F.col(k) for k in pii.KINDS]).alias("spans"))


@query(r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
i AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
needed AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
s AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
sized AS (
  SELECT doc_id, terms, 25 + (75 * len(terms) * docs) // total AS m FROM d, s WHERE len(terms) > 0),
f AS (SELECT doc_id, m, term, count(*) AS tf
      FROM (SELECT doc_id, m, unnest(terms) AS term FROM sized) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM f, s GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM needed JOIN w USING (term) JOIN f USING (term) GROUP BY ALL)
SELECT item_id,
       row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank,
       doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
""")
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(r"""
WITH bits AS (  -- crc32 of one byte, for all 256
  SELECT list(list_reduce(
    list_prepend(b, range(8)),
    lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END) ORDER BY b) AS t
  FROM range(256) r(b)),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(text, '')) AS digest,
         hex(encode(coalesce(text, ''))) AS raw FROM documents),
c AS (
  SELECT doc_id, size, digest, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(
      regexp_extract_all(raw, '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)])), 4294967295) AS text_crc32
  FROM d, bits),
o AS (
  SELECT *, (sum(size) OVER (ORDER BY digest, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING)
             - size)::BIGINT AS below, (sum(size) OVER ())::BIGINT AS total FROM c),
s AS (  -- a boundary lies before the document whose middle is the first beyond its target
  SELECT *, ((8 * (2 * below + size)) // total)::INT AS shard FROM o)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY below) - 1 AS slot,
       NULL::INT AS grown_shard
FROM s
""")
def op12_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query(r"""
WITH ids AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS own,
         list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(
             regexp_extract_all(doc_id::VARCHAR, '.'), lambda c: ascii(c)::BIGINT)),
           lambda a, c: list_reduce(
             list_prepend(xor(a, c), range(8)),
             lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)) AS r
  FROM documents),
h AS (SELECT doc_id, own, len(own) AS n, xor(r, 4294967295) AS h FROM ids),
cut AS (SELECT *, (h // 10) % greatest(n, 1) AS a, 3 + (h // 10) % 8 AS e FROM h),
w AS (
  SELECT doc_id, n, CASE
    WHEN h % 10 = 0 AND n > 0 THEN list_transform(
      range(n), lambda i: own[1 + CASE WHEN i < a THEN i
                                       ELSE a + (i - a) % (1 + (n - a) // e) END])
    ELSE own END AS words FROM cut),
t AS (SELECT doc_id, unnest(words) AS word, unnest(range(n)) AS i FROM w),
g AS (SELECT doc_id, i, hash(word, lead(word) OVER p, lead(word, 2) OVER p,
                             lead(word, 3) OVER p, lead(word, 4) OVER p) AS five, word
      FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
seeds AS (  -- five words in a row repeat at this lag; every run holds such a place
  SELECT DISTINCT y.doc_id, y.i - x.i AS lag FROM g x
  JOIN g y ON x.doc_id = y.doc_id AND x.five = y.five AND x.i < y.i),
m AS (
  SELECT s.doc_id, lag, y.i, y.i - row_number() OVER (PARTITION BY s.doc_id, lag ORDER BY y.i) AS k
  FROM seeds s JOIN t y ON y.doc_id = s.doc_id
  JOIN t x ON x.doc_id = s.doc_id AND x.i = y.i - lag AND x.word = y.word),
stretch AS (
  SELECT doc_id, lag AS period, min(i) - lag AS start, count(*) + lag AS length
  FROM m GROUP BY doc_id, lag, k HAVING count(*) + lag >= greatest(6, 4 * lag)),
runs AS (
  SELECT doc_id, start, length, period FROM stretch s WHERE NOT EXISTS (
    FROM stretch o WHERE o.doc_id = s.doc_id AND o.period < s.period AND o.start <= s.start
                     AND o.start + o.length >= s.start + s.length)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS text
  FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY t.doc_id),
best AS (
  SELECT * FROM runs
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(
    concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS list
  FROM runs GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start,
       length::BIGINT AS length, period::BIGINT AS period,
       ((1000 * length) // period)::BIGINT AS exponent_milli,
       sha256(coalesce(list, '')) AS runs_sha256, sha256(coalesce(left_over, '')) AS collapsed_sha256
FROM documents d LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id)
LEFT JOIN (SELECT doc_id, text AS left_over FROM kept) k USING (doc_id)
""")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(periodic.with_planted_runs(table(spark, sf_dir, "documents")))
    best = periodic.longest(F.col("runs"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["before"]).alias("start"),
        best["length"].alias("length"), (-best["finer"]).alias("period"),
        F.floor(1000 * best["length"] / -best["finer"]).cast("long").alias("exponent_milli"),
        F.sha2(periodic.listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
