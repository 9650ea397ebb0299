"""A table with what real tables hold: nulls, repeats, ties, very long texts, odd columns."""

LONG = "lorem ipsum dolor sit amet " * 40_000
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards box near twelve jolly quails"
ROWS = [
    (1, "a b\tc", "en", "s1"),
    (2, "abc", "en", "s1"),
    (2, "abc", "en", "s1"),
    (3, None, None, None),
    (4, "", "", ""),
    (None, "abc", "en", "s2"),
    (None, None, None, None),
    (5, WORDS, "en", "s2"),
    (6, WORDS + "!", "en", None),
    (7, LONG, "la", "s3"),
    (8, LONG + "end", "la", "s3"),
    (9, "x" * 300_000, "xx", "s3"),
    (10, "ñandú \u00a0 \u2003 été \U0001f600", "es", "s3"),
    (5, "another text under an id that repeats", "en", "s2"),
    (11, " \n\x0b\x0c\r ", "en", "s2"),
]
# names that operators use inside
EXTRA = ["score", "kept", "digest", "rep", "root", "bucket", "row_number", "row_file", "size", "hash",
         "copies", "place", "target", "kind", "start", "good", "verdict", "copy", "label_id", "gone_id"]


def documents(spark, folder=None, rows=None):
    """The table, as a Parquet scan if a folder is given."""
    extra = ", ".join(f"{c} string" for c in EXTRA)
    rows = ROWS if rows is None else rows
    df = spark.createDataFrame(
        [(*r, len(r[1] or ""), *["x"] * len(EXTRA)) for r in rows],
        f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    if folder is None:
        return df
    df.coalesce(2).write.parquet(str(folder))
    return spark.read.parquet(str(folder))
