"""Personal data by regular expressions, checksums and context, in SQL functions only.

Base kinds: email, ip, card, phone, each leftmost and non-overlapping.  The patterns below
match what the published ones match, but possessively and only where a run begins (or where
the last match ended), so a long run without a match costs linear time.  Card numbers must
pass Luhn, address parts are at most 255; what fails is dropped without a retry.

Added kinds: iban, confirmed by mod 97; local_phone, ten digits in the groups 3-3-4 without a
country code; secret, 32 to 64 hexadecimal digits with letters and digits among them; routing,
nine digits confirmed by the weights 3, 7, 1.

Every span gets a score from 0 to 1: the kind's own, more if a word that names the kind is
near.  Base spans are always reported; added ones from ``min_score`` on.  An account number's
checksum is proof enough; the other added kinds look like many other things and count only
beside such a word.  Spans of different kinds may overlap.

Positions are code points, end exclusive.  Null counts as empty.  Rows are returned one for
one, whatever their ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "local_phone", "secret", "routing")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+"
            r"|[A-Z0-9]{11,30}+)(?![A-Za-z0-9])",
    "local_phone": r"(?<![A-Za-z0-9(.+-])(?<!\+[0-9]{1,3}[\x20.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])"
                   r"[0-9]{3}[\x20.-][0-9]{4}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])",
    "routing": r"(?<![A-Za-z0-9.-])[0-9]{9}(?![A-Za-z0-9])",
}
# a text without any of these has no match; looked for first, as that costs little
NEEDS = {"email": "@", "phone": "+"}
# own score of a kind, and the words near a span that raise it
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8,
          "local_phone": 0.6, "secret": 0.6, "routing": 0.6}
CONTEXT = {
    "email": r"(?i)mail|contact|write to|correo|courriel|kontakt",
    "ip": r"(?i)\bip\b|address|server|host|adresse|direcci",
    "card": r"(?i)card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"(?i)phone|call|tel|mobile|fax|anruf|appel|llam",
    "iban": r"(?i)iban|account|bank|transfer|konto|compte|cuenta",
    "local_phone": r"(?i)phone|call|\btel\b|mobile|cell|fax|dial|text me|reach|contact|anruf|appel|llam",
    "secret": r"(?i)token|secret|passw|api.?key|\bkey\b|credential|bearer|auth",
    "routing": r"(?i)routing|\baba\b|\brtn\b|transit",
}
NEAR = 40
BOOST = 0.2
BLOCK = 256


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _mod97(text: Column) -> Column:
    """An account number modulo 97: first four characters last, letters as 10 to 35."""
    bare = F.translate(text, " ", "")
    moved = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise(
            (rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(moved, "(?!^)(?!$)"), F.lit(0), step)


def confirmed(kind: str, text: Column) -> Column:
    """Whether a proposed span holds."""
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) < 4
        return F.forall(F.split(text, r"\."), lambda p: part(p) & (
            F.coalesce(F.regexp_extract(p, r"([0-9]{1,3})$", 1).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(text)).between(16, 19) & F.call_function("luhn_check", _digits(text))
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    if kind == "iban":
        return _mod97(text) == 1
    if kind == "secret":
        return text.rlike("[0-9]") & text.rlike("[A-Fa-f]")
    if kind == "routing":
        digit = lambda i: F.substring(text, i, 1).cast("int")
        total = reduce(lambda a, b: a + b, [digit(i + 1) * (3, 7, 1)[i % 3] for i in range(9)])
        return (total > 0) & (total % 10 == 0)
    return F.lit(True)


def _starts(lengths: Column, blocks: Column, i: Column) -> Column:
    """Sum of the lengths before place i: whole blocks, then the rest of its own block."""
    add = lambda a, x: a + x
    block = F.floor(i / BLOCK).cast("int")
    return (F.aggregate(F.slice(blocks, F.lit(1), block), F.lit(0), add)
            + F.aggregate(F.slice(lengths, block * BLOCK + 1, i % BLOCK), F.lit(0), add))


def _proposals(df: DataFrame, kind: str) -> DataFrame:
    """Add the matches of a kind, and the pieces of text between them, in own columns."""
    text, pattern = F.col("text"), F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    if kind in NEEDS:
        found = F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(
            F.array().cast("array<string>"))
    return df.withColumn(f"{kind}_found", found)


def _spans(kind: str, boost: float) -> Column:
    """Confirmed spans of a kind, from its columns."""
    found, pieces, lengths, blocks = (
        F.col(f"{kind}_{c}") for c in ("found", "pieces", "lengths", "blocks"))

    def span(match: Column, i: Column) -> Column:
        start = _starts(lengths, blocks, i) + F.length(F.get(pieces, i))
        near = F.concat_ws(
            " ", F.right(F.get(pieces, i), F.lit(NEAR)),
            F.left(F.get(pieces, i + 1), F.lit(NEAR)))
        score = F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT[kind]), boost).otherwise(0.0)
        return F.struct(
            F.lit(kind).alias("kind"), start.alias("start"),
            (start + F.length(match)).alias("end"), match.alias("text"), score.alias("score"),
            confirmed(kind, match).alias("holds"))

    return F.filter(F.transform(found, span), lambda s: s["holds"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         min_score: float = 0.8, boost: float = BOOST) -> DataFrame:
    """The id and one array of spans per kind, in the order of ``KINDS``.

    A span is a struct of kind, start, end, text, score.  ``boost`` is what a word near it adds.
    """
    df = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for kind in KINDS:
        df = _proposals(df, kind)
    # texts without a match need no positions; the split is that of the same matches
    none = F.array().cast("array<string>")
    columns = ["doc_id", *[f"{k}_found" for k in KINDS]]
    df = df.select(*columns, *[
        F.when(F.size(f"{k}_found") > 0, F.split("text", PATTERNS[k], -1)).otherwise(none)
        .alias(f"{k}_pieces") for k in KINDS])
    columns += [f"{k}_pieces" for k in KINDS]
    df = df.select(*columns, *[
        F.zip_with(f"{k}_found", F.slice(f"{k}_pieces", F.lit(1), F.size(f"{k}_found")),
                   lambda m, p: F.length(m) + F.length(p)).alias(f"{k}_lengths") for k in KINDS])
    columns += [f"{k}_lengths" for k in KINDS]
    sums = lambda c: F.transform(
        F.sequence(F.lit(0), F.floor(F.size(c) / BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice(c, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + x))
    df = df.select(*columns, *[sums(F.col(f"{k}_lengths")).alias(f"{k}_blocks") for k in KINDS])
    spans = {k: _spans(k, boost) for k in KINDS}
    added = {k: F.filter(spans[k], lambda s: s["score"] >= min_score) for k in KINDS if k not in BASE}
    return df.select("doc_id", *[(spans | added)[k].alias(k) for k in KINDS])


def joined(spans: list[Column]) -> Column:
    """kind:start:end of all spans, kind by kind, joined by commas."""
    lines = [F.transform(s, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))) for s in spans]
    return F.array_join(reduce(lambda a, b: F.concat(a, b), lines), ",")
