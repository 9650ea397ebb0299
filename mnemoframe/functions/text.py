"""Text scalar functions: every function takes and returns Columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemoframe import constants as C

# Unicode letters and digits are spelled out: a bare \w is ASCII-only on the JVM.
_NON_WORD_RUN = r"[^\p{L}\p{N}_]+"
# the blank characters stripped from the ends of a text
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"


_WORD = r"[\p{L}\p{N}_]"


def unicode_pattern(pattern: str) -> str:
    """A pattern whose word boundaries, word characters and blanks are those of Unicode.

    On the JVM a bare \\b, \\w and \\s know ASCII only.  The first boundary of a pattern comes
    before a word character; the others are spelled out in full.
    """
    boundary = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
    return (
        pattern.replace(r"[\w", r"[\p{L}\p{N}_").replace(r"\b", rf"(?<!{_WORD})", 1)
        .replace(r"\b", boundary).replace(r"\s", r"[\s\p{Z}\x1c-\x1f\x85]"))


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def strip(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))


def any_contained(text: Column, needles) -> Column:
    """True when any of the fixed substrings occurs in the text.

    Plain searches: alternatives of one pattern are tried at every character.
    """
    return reduce(or_, (F.contains(text, F.lit(n)) for n in needles))


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_distinct(items: Column, key) -> Column:
    """Keep, in order, the first element of every distinct ``key(element)``.

    ``key`` is a Column function applied to one element.
    """
    def keep(found: Column) -> Column:
        return bind(F.transform(found, key), lambda keys: F.filter(
            found, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1))

    return bind(items, keep)


# ------------------------------------------------------------ normal forms, tokens


def normalize(text: Column) -> Column:
    """Lower-case words joined by single spaces; null and blank become ''.

    A run of punctuation and blanks always ends up as one space, so a single
    replacement over everything that is not a word character is enough.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(lowered, _NON_WORD_RUN, " "))


content_signature = normalize
normalize_concept = normalize


def tokenize(text: Column) -> Column:
    return F.array_remove(F.split(normalize(text), " "), "")


def extract_keywords(
    text: Column, drop_stop_words: bool = True, min_len: int = 2, max_keywords: int = 20
) -> Column:
    """Distinct content words in first-seen order."""
    tokens = tokenize(text)
    if drop_stop_words:
        # array_except also removes repeats and keeps first-seen order
        distinct = F.array_except(tokens, _strings(C.STOP_WORDS))
    else:
        distinct = F.array_distinct(tokens)
    long_enough = F.filter(distinct, lambda t: F.length(t) >= min_len)
    return F.slice(long_enough, 1, max_keywords)


def subject_key(text: Column, n_tokens: int = 2) -> Column:
    kept = F.filter(tokenize(text), lambda t: ~t.isin(*C.SUBJECT_MARKERS))
    return F.array_join(F.slice(kept, 1, n_tokens), " ")


# ------------------------------------------------------------ cue-based classifiers


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))


def classify_observation(
    text: Column, procedural: Column | str = "procedural", episodic: Column | str = "episodic",
    semantic: Column | str = "semantic",
) -> Column:
    """'procedural', 'episodic' or 'semantic', or what is given in their place; procedural
    cues win."""
    def kind(low: Column) -> Column:
        return (
            F.when(any_contained(low, C.PROCEDURAL_CUES), procedural)
            .when(any_contained(low, C.EPISODIC_CUES), episodic)
            .otherwise(semantic))

    return bind(_padded(text), kind)


def text_signals_supersession(text: Column) -> Column:
    return bind(_padded(text), lambda low: any_contained(low, C.SUPERSESSION_CUES))


def query_mode(question: Column) -> Column:
    low = F.lower(F.coalesce(question, F.lit("")))
    return F.when(
        any_contained(low, C.DEEP_HINTS) | low.rlike(r"\d"), "deep"
    ).otherwise("standard")


def detect_required_data(question: Column) -> Column:
    low = F.lower(F.coalesce(question, F.lit("")))
    has_why = F.array_contains(F.split(F.regexp_replace(low, r"\s+", " "), " "), "why")
    return F.array_compact(
        F.array(
            F.when(low.rlike(C.NUMERIC_QUESTION), F.lit("numeric_value")),
            F.when(low.rlike(C.TEMPORAL_QUESTION), F.lit("temporal_value")),
            F.when(has_why, F.lit("reason")),
        )
    )


# ------------------------------------------------------------ scores


def keyword_score(keywords: Column, tokens: Column) -> Column:
    """Share of the (distinct) keywords found among the tokens."""
    hits = F.size(F.array_intersect(keywords, tokens))
    return F.when(F.size(keywords) > 0, hits / F.size(keywords)).otherwise(F.lit(0.0))


def token_overlap(left: Column, right: Column) -> Column:
    """Shared tokens over the smaller of two distinct-token arrays."""
    smaller = F.least(F.size(left), F.size(right))
    return F.size(F.array_intersect(left, right)) / F.greatest(F.lit(1), smaller)


def _coverage_words(text: Column) -> Column:
    words = F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1
    )
    distinct = F.array_except(words, _strings(C.COVERAGE_STOP_WORDS))
    return F.filter(distinct, lambda w: F.length(w) > 2)


def gold_coverage(gold: Column, context: Column) -> Column:
    """Share of the gold answer's content words present in the context."""
    wanted = _coverage_words(gold)
    found = F.size(F.array_intersect(wanted, _coverage_words(context)))
    return F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise(found / F.size(wanted))


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


# ------------------------------------------------------------ parsing model output


def answer_after_marker(text: Column) -> Column:
    """Text after the last 'ANSWER:' in any case; the whole text otherwise."""
    whole = strip(text)
    tail = F.regexp_extract(whole, r"(?is)^.*ANSWER:\s*(.*)$", 1)
    return F.coalesce(F.nullif(tail, F.lit("")), whole)


def verdict_is_yes(text: Column) -> Column:
    stripped = F.lower(strip(text))
    return F.startswith(F.ltrim(stripped, F.lit(".,:;!\"' ")), F.lit("yes"))


# ------------------------------------------------------------ request texts


def reader_request(context: Column, question_date: Column, question: Column,
                   scaffolded: bool = False) -> Column:
    """The text handed to a reader; the scaffolded layout asks for a marked answer."""
    head = F.concat(
        F.lit("Conversation history:\n"), context,
        F.lit("\n\nToday's date: "),
        F.coalesce(F.nullif(question_date, F.lit("")), F.lit("unknown")),
        F.lit("\nQuestion: "), question,
    )
    tail = (
        "\n\nReason step by step using the steps above, then end with a single line "
        "'ANSWER: <concise answer>'."
        if scaffolded
        else "\nAnswer:"
    )
    return F.concat(head, F.lit(tail))


# The grading texts a judge receives.
JUDGE_ABSTENTION = (
    "I will give you an unanswerable question and a model's response. The "
    "question cannot be answered from the available information, so the "
    "correct behavior is for the model to acknowledge that it does not know "
    "or that the information is unavailable.\n\n"
    "Question: {question}\nModel Response: {hypothesis}\n\n"
    "Did the model correctly abstain (say it does not know / has no such "
    "information) instead of fabricating an answer? Answer yes or no only."
)
JUDGE_PREFERENCE = (
    "I will give you a question, a rubric describing the desired "
    "personalized response, and a model's response. Answer yes if the "
    "response satisfies the rubric (it is consistent with and reflects the "
    "stated preference). Otherwise answer no.\n\n"
    "Question: {question}\nRubric (desired response): {answer}\n"
    "Model Response: {hypothesis}\n\n"
    "Does the response satisfy the rubric? Answer yes or no only."
)
JUDGE_DEFAULT = (
    "I will give you a question, the correct answer, and a model's "
    "response. Answer yes if the response contains the correct answer or is "
    "semantically equivalent to it. Answer no if it is missing, wrong, or "
    "only partially correct.{note}\n\n"
    "Question: {question}\nCorrect Answer: {answer}\n"
    "Model Response: {hypothesis}\n\n"
    "Is the model response correct? Answer yes or no only."
)
JUDGE_NOTES = {
    "temporal-reasoning": (
        " Pay attention to dates and temporal ordering; the answer must be "
        "consistent with the correct timeframe."
    ),
    "knowledge-update": (
        " The correct answer reflects the most recent update; an outdated "
        "value is incorrect."
    ),
}


def _fill(template: str, **columns: Column) -> Column:
    """Concatenate the literal pieces of a template with the named columns."""
    pieces, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            pieces.append(F.lit(head))
        name, _, rest = tail.partition("}") if brace else ("", "", "")
        if name:
            pieces.append(F.coalesce(columns[name], F.lit("")))
    return F.concat(*pieces)


def judge_request(question_type: Column, is_abstention: Column, question: Column,
                  answer: Column, hypothesis: Column) -> Column:
    note = F.lit("")
    for name, text in JUDGE_NOTES.items():
        note = F.when(question_type == name, F.lit(text)).otherwise(note)
    fields = {"question": question, "answer": answer, "hypothesis": hypothesis}
    return (
        F.when(is_abstention, _fill(JUDGE_ABSTENTION, **fields))
        .when(question_type == "single-session-preference", _fill(JUDGE_PREFERENCE, **fields))
        .otherwise(_fill(JUDGE_DEFAULT, note=note, **fields))
    )


# ------------------------------------------------------------ keys, ids, dates


def content_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL; used as a content-addressed cache key."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def id_number(object_id: Column) -> Column:
    """'type#12' -> 12; anything else -> 0."""
    digits = F.regexp_extract(F.coalesce(object_id, F.lit("")), r"#\s*([+-]?\d+)\s*$", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def date_only(moment: Column) -> Column:
    return F.coalesce(F.date_format(moment, "yyyy-MM-dd"), F.lit(""))


def parse_iso_timestamp(text: Column) -> Column:
    """ISO-8601 text, with or without a time and an offset or 'Z'; null when malformed.

    The local date and time of the text are kept; an offset does not move them.
    """
    whole = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?))?(?:Z|[+-]\d{2}:?\d{2})?$"
    day, time = F.regexp_extract(text, whole, 1), F.regexp_extract(text, whole, 2)
    return F.when(text.rlike(whole), F.try_to_timestamp(F.concat_ws(" ", day, F.nullif(time, F.lit("")))))


def shorten(text: Column, width: int) -> Column:
    """Collapse blanks and cut at a word end so that ' [...]' still fits.

    The longest prefix of whole words that leaves room for the marker is kept.
    """
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Z}]+", " "))
    marker = " [...]"
    room = width - len(marker)
    head = F.substring(flat, 1, room)
    ends_on_word = F.substring(flat, room + 1, 1) == " "
    whole_words = F.when(ends_on_word, head).otherwise(
        F.regexp_replace(head, r" ?[^ ]*$", "")
    )
    cut = F.when(whole_words == "", F.lit("[...]")).otherwise(
        F.concat(whole_words, F.lit(marker))
    )
    return F.when(F.length(flat) <= width, flat).otherwise(cut)
