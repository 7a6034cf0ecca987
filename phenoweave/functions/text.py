"""Tokens and text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: English function words, then words of almost every description
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can", "this", "that",
    "these", "those", "it", "its", "as", "not", "no", "nor", "so", "yet", "both", "either", "neither", "each", "few", "more", "most",
    "other", "some", "such", "than", "too", "very", "also", "however", "therefore",
    "patient", "patients", "disease", "disorder", "syndrome", "condition", "rare", "characterized", "characterised", "including",
    "include", "associated", "association", "presents", "present", "clinical", "features", "feature", "signs", "sign", "symptoms",
    "symptom", "type", "types", "form", "forms", "onset", "usually", "often", "typically", "reported", "cases", "case", "affected",
    "individuals", "individual", "common", "commonly", "due", "caused",
)
# fixed values: words that negate a finding, looked for in the characters before it
NEGATIONS = ("no", "not", "without", "denies", "denied", "negative for", "absence of")
NEGATION_WINDOW = 50


def tokens(text: Column, extra: tuple[str, ...] = ()) -> Column:
    """Runs of ASCII letters in lower case, three letters or more, no stopwords, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return F.filter(words, lambda w: (F.char_length(w) >= 3) & ~w.isin(*STOPWORDS, *extra))  # a hash set


def normalize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]", " "), r"\s+", " "))


def is_negated(text: Column, start: Column) -> Column:
    """Whether a negation occurs, even inside a word, in the window before ``start`` (from 0)."""
    begin = F.greatest(start - NEGATION_WINDOW, F.lit(0))
    before = F.substring(text, begin + 1, start - begin)
    out = F.lit(False)
    for w in NEGATIONS:
        out = out | before.contains(w)
    return out


def starts_of(text: Column, word: str) -> Column:
    """Where a word that can't overlap itself occurs, from 0, in order, as an array."""
    parts = F.split(text, rf"\Q{word}\E")
    state = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("end"))
    step = lambda s, part: F.struct(F.array_append(s["at"], s["end"] + F.char_length(part)).alias("at"), (s["end"] + F.char_length(part) + len(word)).alias("end"))
    return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), state, step, lambda s: s["at"])


def first_text(description: Column, label: Column) -> Column:
    """The description, or the label where that is blank."""
    return F.coalesce(F.nullif(F.regexp_replace(description, r"^\s+|\s+$", ""), F.lit("")), label)


def used_fallback(description: Column) -> Column:
    return ~F.coalesce(description.rlike(r"\S"), F.lit(False))


def embedding_text(labels: Column, description: Column, most: int = 400) -> Column:
    """Labels joined by ``; `` and the start of the description, for dense encoders; blank parts are left out."""
    phenotypes = F.when(F.size(labels) > 0, F.array_join(labels, "; "))
    rest = F.nullif(F.substring(F.regexp_replace(description, r"^\s+|\s+$", ""), 1, most), F.lit(""))
    return F.concat_ws(". ", phenotypes, rest)
