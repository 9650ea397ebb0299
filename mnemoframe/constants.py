"""Fixed values.

Every list below must equal the published behaviour word for word, so each is
stated as plain text in one place.  Everything else in the package derives from
these values and from ``Settings``.
"""

from __future__ import annotations

# --- fixed values: memory types ------------------------------------------------
CLAIM = "memory_claim"
EPISODIC = "episodic_memory"
PROCEDURAL = "procedural_memory"
MEMORY_TYPES = (CLAIM, EPISODIC, PROCEDURAL)
OBSERVATION = "memory_observation"
CONCEPT = "memory_concept"

# short type name used by questions -> stored type name
SHORT_TYPE_NAMES = {
    "semantic": CLAIM,
    "episodic": EPISODIC,
    "procedural": PROCEDURAL,
}

# --- fixed values: statuses ----------------------------------------------------
ACTIVE = "active"
SUPERSEDED = "superseded"
ARCHIVED = "archived"
DELETED = "deleted"
NEEDS_REVIEW = "needs_review"
ALL_STATUSES = (ACTIVE, SUPERSEDED, ARCHIVED, DELETED, NEEDS_REVIEW)
ALWAYS_HIDDEN = (ARCHIVED, DELETED)

# --- fixed values: stop words for keyword extraction ---------------------------
STOP_WORDS = (
    "a an the and or but if then so to of in on at by for from with as is are was were "
    "be been being do does did have has had this that these those it its i you he she "
    "we they me my your his her our their about over under up down out into"
).split()

# --- fixed values: cues that make an observation procedural / episodic ---------
PROCEDURAL_CUES = (
    "use ", "prefer ", "always ", "never ", "avoid ", "for future", "should ",
    "don't ", "do not ", "keep it ", "make sure",
)
EPISODIC_CUES = (
    "yesterday", "today", "last week", "last month", " met ", " decided ",
    " happened ", " announced ", " signed ", " released ", " launched ",
    " on may", " on june", " on jan", " in q1", " in q2", " in q3", " in q4",
)

# --- fixed values: cues that a text replaces an older one ----------------------
SUPERSESSION_CUES = (
    " now ", " now,", "now called", " changed to ", " renamed ", " actually ",
    " correction", " correction:", " updated to ", " is now ", " was renamed",
)

# --- fixed values: discourse markers ignored by subject keys -------------------
SUBJECT_MARKERS = (
    "update", "updated", "actually", "correction", "note", "fyi", "btw", "so",
    "well", "okay", "ok", "now", "today", "yesterday", "edit", "fix",
)

# --- fixed values: hints that a question needs the deep mode -------------------
DEEP_HINTS = (
    "when", "timeline", "history", "list all", "every", "how many", "how much",
    "since", "before", "after", "compare", "contradict", "changed", "date",
    "dates", "year", "month",
)

# --- fixed values: required-data patterns --------------------------------------
NUMERIC_QUESTION = (
    r"\b(how much|how many|what is the|what's the)\b.*\b"
    r"(amount|number|target|size|count|percent|percentage|\$|%)"
)
TEMPORAL_QUESTION = r"\b(when|what date|what time)\b"

# extra search words a fallback adds per missing kind of evidence
FALLBACK_WORDS = {
    "numeric_value": "amount number target size reserves",
    "temporal_value": "date when year",
}

# --- fixed values: time expressions --------------------------------------------
FIXED_PHRASE_DAYS = {
    "today": 0,
    "yesterday": -1,
    "tomorrow": 1,
    "last week": -7,
    "next week": 7,
    "a week ago": -7,
    "an hour ago": 0,
    "the other day": -1,
}
NUMBER_WORDS = {
    "a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5,
    "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
}
_AMOUNT = r"(\d{1,3}|a|an|one|two|three|four|five|six|seven|eight|nine|ten)"
ISO_DATE = r"\b(\d{4})-(\d{2})-(\d{2})\b"
UNITS_AGO = r"(?i)\b" + _AMOUNT + r"\s+(day|week|month|year)s?\s+ago\b"
LAST_NEXT = r"(?i)\b(last|next)\s+(month|year)\b"
DURATION = (
    r"(?i)\bfor\s+(?:about\s+|around\s+|almost\s+|over\s+|nearly\s+)?"
    + _AMOUNT + r"\s+(day|week|month|year)s?\b"
)
MONTH_NAMES = (
    "january|february|march|april|may|june|july|august|september|october|"
    "november|december|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec"
)
MONTH_DAY = r"(?i)\b(" + MONTH_NAMES + r")\s+(\d{1,2})\b"

# --- fixed values: quantities --------------------------------------------------
MONEY_RANGE = r"(?i)\$(\d+(?:\.\d+)?)\s*[–—\-]\s*(\d+(?:\.\d+)?)\s*([kmbt])?"
MONEY = r"(?i)\$(\d+(?:\.\d+)?)\s*([kmbt])?"
PERCENT = r"(\d+(?:\.\d+)?)\s*%"
COUNTED_UNIT = (
    r"(?i)\b(\d+(?:\.\d+)?)\s*(investments?|companies|reserves|years?|months?|days?|"
    r"hours?|people|users|customers)\b"
)
MULTIPLIERS = {"k": 1e3, "m": 1e6, "b": 1e9, "t": 1e12}
PROPERTY_WORDS = (
    "target", "size", "reserves", "investments", "revenue", "margin", "growth",
    "valuation", "burn", "runway", "companies", "users", "customers",
)
OWNER_EDGE_CHARS = ",.;:!?()[]\"'"

# --- fixed values: concepts ----------------------------------------------------
CAPITALISED_PHRASE = r"\b([A-Z][\w&.\-]*(?:\s+[A-Z][\w&.\-]*){0,3})\b"
SENTENCE_LEADS = (
    "the", "a", "an", "this", "that", "these", "those", "i", "you", "he", "she",
    "we", "they", "it", "his", "her", "their", "our", "my", "your", "if", "when",
    "while", "but", "and", "or", "so", "then", "also",
)

# --- fixed values: stop words of the answer-coverage measure -------------------
COVERAGE_STOP_WORDS = (
    "the a an and or of to in on for with at by from as is are was were be been "
    "this that these those it its their his her your you i we they he she my our "
    "what when where which who how why do does did had has have will would should "
    "could can about into over under more most than then them me us also if not no "
    "yes any some all each per via using used use"
).split()

# --- fixed values: texts that downstream readers parse -------------------------
NO_MEMORY_ANSWER = "I don't have any stored memory that answers this question."
NO_MEMORY_ANSWER_GENERAL = (
    "I don't have stored memory for this; the answer would rely on general knowledge."
)
NO_CONTENT_ANSWER = "Retrieved memories had no usable content."
NO_CONTEXT = "(no relevant memory retrieved)"
AUTO_EVALUATION_NOTE = (
    "Auto-generated baseline evaluation. Replace via benchmark or user feedback."
)
DUPLICATE_REASON = "Exact normalized-content duplicate."

# --- fixed values: relation name -> (allowed source types, allowed target types)
# An empty source tuple means any source.
RELATION_ENDPOINTS = {
    "derived_from": (MEMORY_TYPES + ("quantity_claim", "temporal_ref"), (OBSERVATION,)),
    "supports": ((OBSERVATION,) + MEMORY_TYPES, MEMORY_TYPES + ("memory_answer",)),
    "contradicts": (MEMORY_TYPES, MEMORY_TYPES),
    "supersedes": (MEMORY_TYPES, MEMORY_TYPES),
    "retrieved_for": (MEMORY_TYPES, ("memory_query", "memory_retrieval_result")),
    "used_in_answer": (MEMORY_TYPES, ("memory_answer",)),
    "has_quantity": (MEMORY_TYPES + (OBSERVATION,), ("quantity_claim",)),
    "has_temporal_ref": (MEMORY_TYPES + (OBSERVATION,), ("temporal_ref",)),
    "validated_by": (("memory_answer",) + MEMORY_TYPES, ("memory_evaluation",)),
    "invalidated_by": (("memory_answer",) + MEMORY_TYPES, ("memory_evaluation",)),
    "consolidated_into": (MEMORY_TYPES, MEMORY_TYPES + ("memory_consolidation",)),
    "governed_by_policy": ((), ("memory_policy",)),
    "about_entity": (MEMORY_TYPES, (CONCEPT,)),
    "same_entity_as": ((CONCEPT,), (CONCEPT,)),
}
