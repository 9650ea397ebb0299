"""Find time references in text and resolve them against an anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe import constants as C
from mnemoframe.functions.text import bind, first_distinct, unicode_pattern


def _mentions(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m.alias("text"), F.lit(kind).alias("kind")))


def _found_mentions(body: Column, low: Column) -> Column:
    nothing = F.array().cast("array<string>")

    def every(pattern: str, *needed: str) -> Column:
        """All matches; a plain substring test spares most texts the pattern."""
        possible = F.contains(low, F.lit(needed[0]))
        for word in needed[1:]:
            possible = possible | F.contains(low, F.lit(word))
        return F.when(
            possible, F.regexp_extract_all(body, F.lit(unicode_pattern(pattern)), 0)).otherwise(nothing)

    phrases = F.filter(
        F.array(*[F.lit(p) for p in C.FIXED_PHRASE_DAYS]), lambda p: F.contains(low, p))
    months = sorted({m[:3] for m in C.MONTH_NAMES.split("|")})
    return F.concat(
        _mentions(every(C.ISO_DATE, "-"), "iso"),
        _mentions(every(C.UNITS_AGO, "ago"), "relative"),
        _mentions(every(C.LAST_NEXT, "last", "next"), "relative"),
        _mentions(every(C.DURATION, "for"), "duration"),
        _mentions(phrases, "relative"),
        _mentions(every(C.MONTH_DAY, *months), "month_day"),
    )


def find_temporal_refs(text: Column) -> Column:
    """array<struct(text, kind)> in pattern order, each (lower text, kind) once."""
    body = F.coalesce(text, F.lit(""))
    both = F.struct(body.alias("body"), F.lower(body).alias("low"))
    found = bind(both, lambda t: _found_mentions(t["body"], t["low"]))
    return first_distinct(
        found, lambda m: F.concat_ws("|", F.lower(m["text"]), m["kind"]))


def _lookup(value: Column, table: dict) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), value)


def _amount(word: Column) -> Column:
    return F.coalesce(_lookup(word, C.NUMBER_WORDS), word.try_cast("int"))


def resolve_mentions(df: DataFrame, text: str, kind: str, anchor: str) -> DataFrame:
    """Add resolved_at, anchor_day, resolution_method and confidence per mention.

    Every relative form becomes a whole number of months plus a whole number of
    days; interval arithmetic clamps the day of month and keeps the time of day.
    The steps are separate projections so that each is evaluated once.
    """
    relative, lasting = F.col(kind) == "relative", F.col(kind) == "duration"
    parts = df.withColumns({
        "_low": F.lower(F.col(text)),
        "_explicit": F.when(
            (F.col(kind) == "iso") & ~F.startswith(F.col(text), F.lit("0000")),
            F.try_to_timestamp(F.col(text), F.lit("yyyy-MM-dd")),
        ),
    })
    parts = parts.withColumns({
        "_fixed": F.when(relative, _lookup(F.col("_low"), C.FIXED_PHRASE_DAYS)),
        "_n": F.when(lasting, _amount(F.regexp_extract("_low", C.DURATION, 1)))
        .when(relative, _amount(F.regexp_extract("_low", C.UNITS_AGO, 1))),
        "_unit": F.when(lasting, F.regexp_extract("_low", C.DURATION, 2))
        .when(relative, F.regexp_extract("_low", C.UNITS_AGO, 2)),
        "_turn": F.when(relative, _lookup(
            F.regexp_extract("_low", C.LAST_NEXT, 1), {"last": -1, "next": 1})),
        "_turn_months": _lookup(
            F.regexp_extract("_low", C.LAST_NEXT, 2), {"month": 1, "year": 12}),
    })
    n, unit = F.col("_n"), F.col("_unit")
    parts = parts.withColumns({
        "_months": F.when(F.col("_fixed").isNotNull(), 0)
        .when(unit == "month", -n).when(unit == "year", -12 * n)
        .when(unit.isin("day", "week"), 0)
        .otherwise(F.col("_turn") * F.col("_turn_months")),
        "_days": F.when(F.col("_fixed").isNotNull(), F.col("_fixed"))
        .when(unit == "day", -n).when(unit == "week", -7 * n).otherwise(0),
    })
    parts = parts.withColumn(
        "_shifted",
        F.col(anchor) + F.make_ym_interval(F.lit(0), "_months") + F.make_dt_interval("_days"),
    )
    parts = parts.withColumn(
        "resolution_method",
        F.when(F.col("_explicit").isNotNull(), "explicit_date")
        .when(F.col("_shifted").isNotNull() & relative, "relative_to_observation")
        .when(F.col("_shifted").isNotNull(), "duration_start")
        .otherwise("unresolved"),
    )
    confidences = {"explicit_date": 1.0, "relative_to_observation": 0.9,
                   "duration_start": 0.8, "unresolved": 0.5}
    return parts.withColumns({
        "resolved_at": F.coalesce("_explicit", "_shifted"),
        "anchor_day": F.when(
            F.col("_explicit").isNull(), F.date_format(anchor, "yyyy-MM-dd")),
        "confidence": _lookup(F.col("resolution_method"), confidences),
    }).drop("_low", "_explicit", "_fixed", "_n", "_unit", "_turn", "_turn_months",
            "_months", "_days", "_shifted")
