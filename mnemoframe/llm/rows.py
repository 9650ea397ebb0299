"""A stable identity of the rows of a table, for operators whose ids may repeat or be null."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.operators.groups import in_small_batches, stored  # noqa: F401


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def scanned(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet scan: written to the shared folder if they are none yet."""
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        return stored(df)
    return df


def with_row_key(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add two columns that name each row: its file (hashed) and its place in the file.

    ``df`` is ``scanned``.  The key is the same in every reading, also after an executor is
    lost.
    """
    file, row = free_name(df, "row_file"), free_name(df, "row_number")
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.xxhash64(F.col("_metadata.file_path")).alias(file),
        F.col("_metadata.row_index").alias(row)), [file, row]
