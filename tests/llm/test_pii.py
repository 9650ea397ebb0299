import hashlib
import re

import pytest
from conftest import FOLDER
from messy import ROWS, documents

from mnemoframe.llm import pii
from mnemoframe.llm.queries import op10_pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IBAN = (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})"
        r"(?![A-Za-z0-9])")
ADDED = {
    "iban": IBAN,
    "local_phone": r"(?<![A-Za-z0-9(.+-])(?<!\+\d[ .-])(?<!\+\d\d[ .-])(?<!\+\d\d\d[ .-])"
                   r"(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])",
    "routing": r"(?<![A-Za-z0-9.-])\d{9}(?![A-Za-z0-9])",
}


def holds(kind, text):
    digits = [int(c) for c in text if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "iban":
        bare = text.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    if kind == "secret":
        return bool(re.search("[0-9]", text) and re.search("[A-Fa-f]", text))
    if kind == "routing":
        return any(digits) and sum(d * (3, 7, 1)[i % 3] for i, d in enumerate(digits)) % 10 == 0
    return True


def spans(text):
    out, text = [], text or ""
    for kind, pattern in (BASE | ADDED).items():
        found = list(re.finditer(pattern, text, re.A))
        ends = [0, *(m.end() for m in found)]
        starts = [*(m.start() for m in found), len(text)]
        kept = []
        for i, m in enumerate(found):
            near = text[max(ends[i], m.start() - 40):m.start()] + " " + text[m.end():starts[i + 1]][:40]
            certain = kind in BASE or kind == "iban" or re.search(pii.CONTEXT[kind], near)
            if certain and holds(kind, m[0]):
                kept.append(f"{kind}:{m.start()}:{m.end()}")
        out.append(kept)
    return out


TEXTS = [
    "", None, "write a@b.co, a.b+c@d-e.f.g. and @x.y a@b a@@b.c a@b.com_x@c.org ",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.02.003.255 0000001.1.1.1 99999999999999999999.1.1.1 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111110 4111  1111 12 3 4000001234567899 5",
    "+1 (555) 010-9999 ++49 30 1234567- +1 2 +123456789012345678 +(1) 2", "+1" + "." * 300 + "2345678",
    "ñ😀 a@b.cd 😀 10.0.0.1 IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, GB82WEST12345698765433",
    "a@b.co " * 700, "9" * 60_000, "a" * 60_000 + "@", "a@b" + ".c" * 30_000, "1." * 20_000, "+" * 30_000,
    "call +1 555 010 99 99 or mail: x@y.zz; card 4111111111111111",
    "phone (743) 555-3824, 743-555-3825 or +1 743 555 3826; part 743.555.3827 1743 555 3828",
    "order 743 555 3824 shipped " + "and more of the same " * 5 + "call 743 555 3829",
    'token = "0123456789abcdef0123456789abcdef01234567" ' + "x " * 40 + "f" * 40 + " md5 " + "0a" * 16,
    "secret " + "1" * 40 + " key " + "0A" * 32 + " key " + "0A" * 33 + " 0aA0" * 9,
    "routing 021000021, 021000022 aba 000000000 and transit no. 11-021000021",
]


def query(spark, texts):
    """The query's columns over own texts."""
    class Folder:
        read = None
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)],
                                 "doc_id long, text string, email string")
    class Reader:
        @staticmethod
        def parquet(_):
            return rows
    session = Folder()
    session.read = Reader
    return op10_pii(session, "")


def test_spans_by_brute_force(spark):
    found = {r["doc_id"]: r for r in query(spark, TEXTS).collect()}
    for i, text in enumerate(TEXTS):
        want = spans(text)
        assert found[i]["spans"] == ",".join(sum(want, []))
        base = ",".join(sum(want[:4], []))
        assert found[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [found[i][f"n_{k}"] for k in BASE] == [len(w) for w in want[:4]]


def test_documents_by_brute_force(spark):
    folder = FOLDER.replace("sf0.001", "sf0.01")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op10_pii(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["spans"] == ",".join(sum(spans(texts[r["doc_id"]]), []))


def test_context_raises_the_score(spark):
    rows = spark.createDataFrame([(1, "call +1 555 010 9999"), (2, "code +1 555 010 9999")],
                                 "doc_id long, text string")
    score = {r["doc_id"]: r["phone"][0]["score"] for r in pii.find(rows).collect()}
    assert score == {1: pytest.approx(0.8), 2: pytest.approx(0.6)}


def test_context_decides_over_added_kinds(spark):
    hexes = "0a1b" * 10
    rows = spark.createDataFrame([
        (1, f"Phone: (743) 555-3824. token = \"{hexes}\" routing 021000021"),
        (2, f"Order (743) 555-3824. commit {hexes} item 021000021"),
    ], "doc_id long, text string")
    kinds = ("local_phone", "secret", "routing")
    count = lambda found: {r["doc_id"]: [len(r[k]) for k in kinds] for r in found.collect()}
    assert count(pii.find(rows)) == {1: [1, 1, 1], 2: [0, 0, 0]}
    assert count(pii.find(rows, boost=0.0)) == {1: [0, 0, 0], 2: [0, 0, 0]}
    assert count(pii.find(rows, min_score=0.6)) == {1: [1, 1, 1], 2: [1, 1, 1]}


def test_plan_is_native(spark):
    plan = pii.find(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_messy_table(spark):
    rows = pii.find(documents(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    assert pii.find(documents(spark, rows=[])).count() == 0
