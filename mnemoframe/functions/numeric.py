"""Find quantities in text with an owner and a property for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe import constants as C
from mnemoframe.functions.text import any_contained, bind, unicode_pattern

# a code point that is no character; replaced by a blank should a text contain it
MARK = "\uffff"
# one of these is in every counted unit
COUNTED_STEMS = ("investment", "companies", "reserves", "year", "month", "day", "hour", "people", "users", "customers")
# lengths that are summed together when positions are counted
RUN = 128


# a word that starts upper-case and has a lower-case letter, and the two words after it
_BLANK, _SOLID = r"[\s\p{Z}]", r"[^\s\p{Z}]"
NAME_AND_NEXT = (
    rf"(?<!{_SOLID})[,.;:!?()\[\]\"']*(\p{{Lu}}{_SOLID}*?[\p{{Ll}}\p{{Lt}}]{_SOLID}*)"
    rf"(?:{_BLANK}+({_SOLID}+))?(?:{_BLANK}+({_SOLID}+))?"
)


def _multiplier(letter: Column) -> Column:
    out = F.lit(1.0)
    for key, factor in C.MULTIPLIERS.items():
        out = F.when(letter == key, F.lit(factor)).otherwise(out)
    return out


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """array<struct(kind, raw, start)> of every match; ``start`` counts from 0.

    Marks around every match cut the text into gaps and matches in turn, so the start of a
    match is the total length of the pieces before it.  Most texts have one match or two.
    """
    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0), lambda acc, x: acc + x)

    def match(raw: Column, start: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), raw.alias("raw"), start.alias("start"))

    def measured(pieces: Column) -> Column:
        lengths = F.transform(pieces, lambda p: F.length(p))
        return bind(lengths, lambda steps: F.struct(
            pieces.alias("pieces"), steps.alias("steps"),
            # sums of whole runs of steps, so that a place costs at most a run and the runs
            F.transform(
                F.sequence(F.lit(0), F.floor(F.size(steps) / RUN).cast("int")),
                lambda r: total(F.slice(steps, r * RUN + 1, F.lit(RUN)))).alias("runs")))

    def place(found: Column) -> Column:
        def start(i: Column) -> Column:
            run = F.floor(i / RUN).cast("int")
            before = total(F.slice(found["runs"], F.lit(1), run)) + total(
                F.slice(found["steps"], run * RUN + 1, i % RUN))
            return match(F.get(found["pieces"], i), before)

        # at least two matches, so the sequence has no other direction
        return F.transform(F.sequence(F.lit(1), F.size(found["pieces"]) - 2, F.lit(2)), start)

    def cut(pieces: Column) -> Column:
        first, second = F.get(pieces, F.lit(1)), F.get(pieces, F.lit(3))
        at = F.length(F.get(pieces, F.lit(0)))
        between = F.length(first) + F.length(F.get(pieces, F.lit(2)))
        size = F.size(pieces)
        return (
            F.when(size == 1, F.array().cast("array<struct<kind:string,raw:string,start:int>>"))
            .when(size == 3, F.array(match(first, at)))
            .when(size == 5, F.array(match(first, at), match(second, at + between)))
            .otherwise(bind(bind(pieces, measured), place)))

    marked = F.regexp_replace(text, pattern, f"{MARK}$0{MARK}")
    return bind(F.split(marked, MARK, -1), cut)


def _patterns(strict_units: bool) -> dict[str, str]:
    """In output order.  By default a multiplier letter may start a longer word, as
    in '$5 tacos'; strict units ask for a word boundary after it."""
    boundary = r"(?![A-Za-z])" if strict_units else ""
    return {
        "range": unicode_pattern(C.MONEY_RANGE.replace("([kmbt])?", f"([kmbt]{boundary})?")),
        "money": unicode_pattern(C.MONEY.replace("([kmbt])?", f"([kmbt]{boundary})?")),
        "percent": unicode_pattern(C.PERCENT),
        "counted": unicode_pattern(C.COUNTED_UNIT),
    }


def quantity_matches(text: Column, strict_units: bool = False) -> Column:
    """All quantity matches of a text: ranges, single amounts, percentages, counts."""
    patterns = _patterns(strict_units)
    body = F.coalesce(text, F.lit(""))
    # hardly ever true, and the test is far cheaper than the replacement
    body = F.when(F.contains(body, F.lit(MARK)), F.translate(body, MARK, " ")).otherwise(body)
    nothing = F.array().cast("array<struct<kind:string,raw:string,start:int>>")

    # plain searches spare most texts the patterns
    possible = {
        "$": F.contains(body, F.lit("$")), "%": F.contains(body, F.lit("%")),
        "unit": bind(F.lower(body), lambda low: any_contained(low, COUNTED_STEMS))}

    def found(kind: str, needed: str) -> Column:
        return F.when(
            possible[needed], _matches(body, kind, patterns[kind])).otherwise(nothing)

    def drop_range_heads(money: Column) -> Column:
        # an amount inside a range can only be the one at the range's own '$'
        starts = F.transform(money["ranges"], lambda m: m["start"])
        return F.concat(money["ranges"], F.filter(
            money["singles"], lambda m: ~F.array_contains(starts, m["start"])))

    money = bind(
        F.struct(found("range", "$").alias("ranges"), found("money", "$").alias("singles")),
        drop_range_heads)
    return F.concat(money, found("percent", "%"), found("counted", "unit"))


def describe_quantities(
    df: DataFrame, text: str, match: str, strict_units: bool = False
) -> DataFrame:
    """Add value, unit, exactness, owner, property and can_sum_exactly per match row.

    The steps are separate projections so that each is evaluated once.

    Owner: the first capitalised, not all-capital word of the sentence around the
    match, with up to two following words that are capitalised or digits.
    Property: the first word of a fixed list in the 40 characters before the match.
    """
    patterns = _patterns(strict_units)
    raw, start, kind = F.col("raw_value"), F.col("_start"), F.col("_kind")
    parts = df.withColumns({
        "raw_value": F.col(f"{match}.raw"), "_start": F.col(f"{match}.start"),
        "_kind": F.col(f"{match}.kind"), "_body": F.coalesce(text, F.lit(""))})
    parts = parts.withColumns({
        "_before": F.substring(F.col("_body"), F.lit(1), start),
        "_after": F.substring(F.col("_body"), start + F.length(raw) + 1, F.length("_body")),
        "_number": F.regexp_extract(raw, r"(\d+(?:\.\d+)?)", 1).cast("double"),
        "_upper": F.when(
            kind == "range", F.regexp_extract(raw, patterns["range"], 2).cast("double")),
        "_letter": F.lower(F.when(kind == "range", F.regexp_extract(raw, patterns["range"], 3))
                           .when(kind == "money", F.regexp_extract(raw, patterns["money"], 2))),
        "_counted": F.when(
            kind == "counted", F.lower(F.regexp_extract(raw, patterns["counted"], 2))),
    })
    opening = F.substring_index(F.substring_index("_before", ".", -1), "\n", -1)
    closing = (
        F.when(F.contains("_after", F.lit(".")), F.substring_index("_after", ".", 1))
        .when(F.contains("_after", F.lit("\n")), F.substring_index("_after", "\n", 1))
        .otherwise(F.lit("")))
    nearby = F.lower(F.substring(
        F.col("_before"), F.greatest(start - 40, F.lit(0)) + 1, F.lit(40)))
    parts = parts.withColumns({
        "_sentence": F.concat(opening, raw, closing), "_nearby": nearby})
    # only the start of the sentence up to the name is ever scanned
    parts = parts.withColumns({
        f"_w{k}": F.btrim(
            F.regexp_extract("_sentence", NAME_AND_NEXT, k + 1), F.lit(C.OWNER_EDGE_CHARS))
        for k in range(3)})
    continues = r"^(\p{Lu}|\p{Nd}+$)"
    second = F.col("_w1").rlike(continues)
    third = second & F.col("_w2").rlike(continues)
    prop = F.lit(None).cast("string")
    for word in reversed(C.PROPERTY_WORDS):
        prop = F.when(F.contains("_nearby", F.lit(word)), F.lit(word)).otherwise(prop)
    scale = _multiplier(F.col("_letter"))
    return parts.withColumns({
        "value": F.when(kind == "range", (F.col("_number") + F.col("_upper")) / 2 * scale)
        .when(kind == "money", F.col("_number") * scale).otherwise(F.col("_number")),
        "unit": F.when(kind.isin("range", "money"), "USD").when(kind == "percent", "%")
        .otherwise(F.col("_counted")),
        "exactness": F.when(kind == "range", "range").otherwise("exact"),
        "owner": F.when(F.col("_w0") != "", F.concat_ws(
            " ", "_w0", F.when(second, F.col("_w1")), F.when(third, F.col("_w2")))),
        "property": F.when(kind == "counted", F.col("_counted")).otherwise(prop),
        "can_sum_exactly": kind.isin("money", "counted"),
    }).drop("_start", "_kind", "_body", "_before", "_after", "_number", "_upper", "_letter",
            "_counted", "_sentence", "_nearby", "_w0", "_w1", "_w2")
