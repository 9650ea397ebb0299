"""Literal cases of the text, time and quantity functions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mnemoframe.functions import concepts, numeric, temporal, vectors
from mnemoframe.functions import text as T
from mnemoframe.sources.conversations import parse_session_date


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize("text, want", [
    ("Été—Foo_1,  bar!!", "été foo_1 bar"), (None, ""), ("  ", ""), ("a\n\tb", "a b"),
    ("¿Qué tal?", "qué tal")])
def test_normalize(spark, text, want):
    assert one(spark, T.normalize, text) == want


def test_keywords_keep_first_seen_order_and_cap(spark):
    assert one(spark, T.extract_keywords, "The cat saw THE dog, a cat I x") == ["cat", "saw", "dog"]
    many = " ".join(f"w{i}" for i in range(30))
    assert one(spark, T.extract_keywords, many) == [f"w{i}" for i in range(20)]


@pytest.mark.parametrize("text, want", [
    ("Update: Ana now lives in Rome", "ana lives"), ("Ana lives in Bonn", "ana lives"),
    ("now so", ""), ("the the x", "the the")])
def test_subject_key(spark, text, want):
    assert one(spark, T.subject_key, text) == want


@pytest.mark.parametrize("text, want", [
    ("For future posts, keep it short", "procedural"), ("Yesterday I met Bo", "episodic"),
    ("The fund is large", "semantic"), ("don't call today", "procedural")])
def test_classify(spark, text, want):
    assert one(spark, T.classify_observation, text) == want


@pytest.mark.parametrize("text, want", [
    ("x Answer: y\nanswer:  z ", "z"), ("no marker ", "no marker"), ("ANSWER:", "ANSWER:")])
def test_answer_marker(spark, text, want):
    assert one(spark, T.answer_after_marker, text) == want


def test_small_parsers(spark):
    assert one(spark, T.verdict_is_yes, ' "Yes, it is') is True
    assert one(spark, T.verdict_is_yes, "no, yes") is False
    assert one(spark, T.id_number, "memory_claim#12") == 12
    assert one(spark, T.id_number, "memory_claim") == 0
    assert one(spark, parse_session_date, "2023/05/20 (Sat) 02:21") == datetime(2023, 5, 20, 2, 21)
    assert one(spark, parse_session_date, "2023/05/20") == datetime(2023, 5, 20)
    assert one(spark, parse_session_date, "20 May") is None
    assert one(spark, T.detect_required_data, "What is the target size and why, when?") == [
        "numeric_value", "temporal_value"]
    assert one(spark, T.detect_required_data, "tell me why it failed") == ["reason"]


def resolved(spark, text, anchor):
    df = spark.createDataFrame([(text, anchor)], "t string, a timestamp").select(
        "a", F.explode(temporal.find_temporal_refs(F.col("t"))).alias("m")).select("a", "m.*")
    rows = temporal.resolve_mentions(df, "text", "kind", "a").collect()
    return [(r.text, r.resolved_at, r.resolution_method) for r in rows]


def test_durations(spark):
    assert resolved(spark, "running for six weeks now", datetime(2023, 5, 25)) == [
        ("for six weeks", datetime(2023, 4, 13), "duration_start")]
    assert resolved(spark, "for about three months", datetime(2023, 5, 21)) == [
        ("for about three months", datetime(2023, 2, 21), "duration_start")]


def test_relative_dates_clamp_and_keep_the_time(spark):
    anchor = datetime(2023, 5, 31, 10, 30)
    assert resolved(spark, "Last month, a week ago, 2024-02-30 and 2024-02-10", anchor) == [
        ("2024-02-30", None, "unresolved"),
        ("2024-02-10", datetime(2024, 2, 10), "explicit_date"),
        ("a week ago", datetime(2023, 5, 24, 10, 30), "relative_to_observation"),
        ("Last month", datetime(2023, 4, 30, 10, 30), "relative_to_observation")]
    assert resolved(spark, "yesterday on May 26", None) == [
        ("yesterday", None, "unresolved"), ("May 26", None, "unresolved")]


def quantities(spark, text, strict=False):
    df = spark.createDataFrame([(text,)], "t string").select(
        "t", F.explode(numeric.quantity_matches(F.col("t"), strict)).alias("m"))
    rows = numeric.describe_quantities(df, "t", "m", strict).collect()
    return [(r.raw_value, r.value, r.unit, r.exactness, r.owner, r.property, r.can_sum_exactly)
            for r in rows]


def test_quantities_of_a_fund(spark):
    text = "Fund III target is $20-25M with around 36 investments and 25% reserves."
    assert quantities(spark, text) == [
        ("$20-25M", 22.5e6, "USD", "range", "Fund III", "target", False),
        ("25%", 25.0, "%", "exact", "Fund III", "investments", False),
        ("36 investments", 36.0, "investments", "exact", "Fund III", "investments", True)]


def test_quantity_quirks(spark):
    assert [q[:2] for q in quantities(spark, "x5 users 5 users")] == [("5 users", 5.0)]
    assert quantities(spark, "paid $5 tacos")[0][1] == 5e12
    assert quantities(spark, "paid $5 tacos", strict=True)[0][1] == 5.0
    assert quantities(spark, "$1,234")[0][1] == 1.0
    assert quantities(spark, "NASA got it. ACME Corp 7 paid $3")[0][4] == "Corp 7"
    assert quantities(spark, "Ana paid $3-4 then $9")[1][:2] == ("$9", 9.0)


def test_concepts(spark):
    assert one(spark, concepts.deterministic_concepts, "When The Big AT&T met Ana. big") == [
        "Big AT&T", "Ana", "when", "big", "met"]
    got = one(spark, concepts.deterministic_concepts, "The Fund III team. Fund III!")
    assert got[0] == "Fund III" and "fund" in got and len(got) <= 6


def test_hash_embedding_is_a_unit_vector(spark):
    df = spark.createDataFrame([("tokyo tower",), ("",)], "t string")
    rows = df.select(vectors.hash_embedding(T.tokenize(F.col("t"))).alias("v")).collect()
    assert abs(sum(x * x for x in rows[0].v) - 1) < 1e-12
    assert set(rows[1].v) == {0.0}
    assert vectors.TOKEN_HASHES["md5"]("tokyo") == 4010590479


def test_cosine_forms_agree(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([], [])],
        "a array<double>, b array<double>")
    rows = df.select(
        vectors.cosine_similarity(F.col("a"), F.col("b")).alias("x"),
        vectors.cosine_similarity_arrow(F.col("a"), F.col("b")).alias("y")).collect()
    assert [round(r.x, 12) for r in rows] == [0.8, 0.0, 0.0, 0.0]
    assert all(abs(r.x - r.y) < 1e-12 for r in rows)


def test_shorten(spark):
    import textwrap

    for text in ("Fund III target is", "one two three four five six", "abcdefghijklmnopqrstuvwxyz",
                 "short", "a  b\nc"):
        assert one(spark, lambda c: T.shorten(c, 20), text) == textwrap.shorten(text, 20)


@pytest.mark.parametrize("text, want", [
    ("Yesterday Núñez met Anna Müller in São Paulo", ["Yesterday Núñez", "Anna Müller", "São Paulo"]),
    ("the Éclair of Zoë Kravitz", ["Zoë Kravitz"]), ("über Alles", ["Alles"]), ("aÖBb Rest", ["Rest"])])
def test_concepts_with_accents(spark, text, want):
    assert one(spark, concepts.deterministic_concepts, text)[:len(want)] == want


@pytest.mark.parametrize("text, want", [
    ("two days ago", ["two days ago"]), ("two days agoü", []), ("ütwo days ago", []),
    ("two days ago", ["two days ago"])])
def test_times_next_to_other_letters(spark, text, want):
    assert [m["text"] for m in one(spark, temporal.find_temporal_refs, text)] == want


def test_quantities_next_to_other_letters_and_many_of_them(spark):
    found = one(spark, numeric.quantity_matches, "12 peopleü 7 people ü5 users")
    assert [m["raw"] for m in found] == ["7 people"]
    text = "é $5 and 3% " * 700
    for m in one(spark, numeric.quantity_matches, text):
        assert text[m["start"]:].startswith(m["raw"])


@pytest.mark.parametrize("text, want", [
    ("2023/5/2 (Tue) 2:01", datetime(2023, 5, 2, 2, 1)), ("2023/05/20 02:21", datetime(2023, 5, 20, 2, 21)),
    ("2023/12/1", datetime(2023, 12, 1)), ("2023-05-02", None), (None, None)])
def test_session_dates_in_all_forms(spark, text, want):
    assert one(spark, parse_session_date, text) == want


@pytest.mark.parametrize("text, want", [
    ("2023", None), ("12:30", None), ("2023-05-02", datetime(2023, 5, 2)), ("x", None), (None, None),
    ("2023-05-02T23:30:00+09:00", datetime(2023, 5, 2, 23, 30)), ("2023-02-30", None),
    ("2023-05-02T01:00:00Z", datetime(2023, 5, 2, 1)), ("2023-05-02 01:02", datetime(2023, 5, 2, 1, 2))])
def test_iso_timestamps(spark, text, want):
    assert one(spark, T.parse_iso_timestamp, text) == want
