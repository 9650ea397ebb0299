"""Token counts of whole texts without their token ids.

A text is cut into pre-tokens that no vocabulary piece crosses: a run of spaces with what
follows it, or a line break with what follows it.  For each block of documents the task
builds the pre-token frequencies per document, counts the pieces of each distinct pre-token
once, joins these counts to the frequencies and sums.  The join stays inside the block: the
pairs (document, pre-token) of a corpus weigh about as much as the corpus itself, and a
shuffle of them would cost more than reading the text.  Counts are remembered per task up to
``MEMO`` pre-tokens, then forgotten, which bounds memory and changes no result.

Null counts as empty; an empty text has 0 tokens.  Rows are returned one for one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.rows import in_small_batches

MEMO = 400_000
SPACE = "▁"
_PRETOKEN = re.compile(r" +[^ \n]*|\n[^ \n]*")
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


class PieceCounter:
    """Pieces of a text under a sentencepiece model, by counts of its distinct pre-tokens."""

    def __init__(self, model_file: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.memo: dict[str, int] = {" ": 1}
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        crossing = [p for p in pieces if SPACE in p.lstrip(SPACE) or "\n" in p]
        if crossing or self.model.encode(" a  b \n") != self.model.encode(" a  b \n\n")[:-1]:
            raise ValueError(f"pieces of this model cross pre-tokens: {crossing[:3]}")

    def frequencies(self, text: str) -> Counter:
        """Pre-tokens of a text and how often each occurs; an empty text has none."""
        if not text:
            return Counter()
        return Counter(_PRETOKEN.findall(" " + text.replace(SPACE, " ")))

    def learn(self, pretokens: list[str]) -> None:
        """Count the pieces of pre-tokens not counted so far.

        The library puts a space before every text.  It stands for the first space of a
        pre-token; before a line break it is one piece of its own.
        """
        asked = [p[1:] if p[0] == " " else p for p in pretokens]
        for pretoken, ids in zip(pretokens, self.model.encode(asked, num_threads=1)):
            self.memo[pretoken] = len(ids) - (pretoken[0] == "\n")

    def count(self, texts: list[str]) -> list[int]:
        per_text = [self.frequencies(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo = {" ": 1}
        new = set().union(*per_text) - self.memo.keys()
        if new:
            self.learn(list(new))
        memo = self.memo
        return [sum(n * memo[p] for p, n in freq.items()) for freq in per_text]


@lru_cache(maxsize=2)
def _counter(model_file: str) -> PieceCounter:
    return PieceCounter(model_file)


def count_tokens(
    docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id",
    text_col: str = "text", rows_at_once: int = 128,
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_file)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            n_tokens: list[int] = []
            for at in range(0, len(batch), rows_at_once):
                n_tokens += counter.count(texts.slice(at, rows_at_once).to_pylist())
            n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), n_bytes, pa.array(n_tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    narrow = in_small_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(counted, SCHEMA).withColumn(
        "over_limit", F.col("n_tokens") > F.lit(limit))
