import random

import public_tokenizers
import sentencepiece
from messy import ROWS, documents

from mnemoframe.llm import token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    parts = ["hello", " ", "  ", "\n", "\n\n", "\t", "▁", "<s>", "</s>", "<0x0A>", "ñandú", "你好", "😀",
             "\x00", "3.14", "foo_bar", "\u00a0", "\u3000", "ﬁ", "é", "\r\n", "-" * 40, " " * 30]
    texts = ["", " ", "\n", " \n ", "▁", *("".join(rng.choices(parts, k=rng.randint(1, 25)))
                                          for _ in range(600))]
    counter = token_counts.PieceCounter(MODEL)
    assert counter.count(texts) == [len(x) for x in library.encode(texts)]


def test_forgetting_changes_nothing(monkeypatch):
    texts = [f"word{i} other{i % 7}" for i in range(300)]
    want = token_counts.PieceCounter(MODEL).count(texts)
    monkeypatch.setattr(token_counts, "MEMO", 3)
    counter = token_counts.PieceCounter(MODEL)
    assert [counter.count([t])[0] for t in texts] == want


def test_messy_table(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = token_counts.count_tokens(documents(spark), MODEL).collect()
    want = [(r[0], len((r[1] or "").encode()), n, n > 4096)
            for r in ROWS for n in [len(library.encode(r[1] or ""))]]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert token_counts.count_tokens(documents(spark, rows=[]), MODEL).count() == 0
