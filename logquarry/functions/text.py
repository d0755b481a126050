"""Text features, cleaning, tokens and document texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry import dims
from logquarry.functions.temporal import flag

URL_PATTERN = r"(?i)https?://"
IP_PATTERN = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
TERM_PATTERN = r"[0-9a-z_]{2,}"
LETTER_PATTERN = r"[a-z]{2,}"  # finds in a text the words that TERM_PATTERN finds in it once cleaned


def any_of(phrases: list[str]) -> str:
    """A pattern that finds any of the phrases, taken literally."""
    return "|".join(re.escape(p).replace(r"\ ", " ") for p in phrases)


def mentions(text: Column, phrases: list[str]) -> Column:
    """Any of the lower-case phrases occurs, ignoring case.

    One regex test refers to the text once. A chain or loop of substring tests would repeat
    the text's own expression for every phrase when the optimizer pushes the test down.
    """
    return F.lower(text).rlike(any_of(phrases))


def contains_ignoring_case(text: Column, term: str) -> Column:
    return F.contains(F.lower(text), F.lit(term.lower()))


def counts(text: Column) -> dict[str, Column]:
    def n(pattern):
        return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))

    length = F.coalesce(F.length(text), F.lit(0))
    return {
        "message_length": length,
        "word_count": n(r"\S+"),
        "char_count": length,
        "number_count": n(r"\d"),
        "uppercase_count": n(r"[A-Z]"),
        "special_char_count": n(r"[^a-zA-Z0-9\s]"),
    }


def flags(text: Column) -> dict[str, Column]:
    out = {"has_url": flag(text.rlike(URL_PATTERN)), "has_ip": flag(text.rlike(IP_PATTERN))}
    for word in dims.ERROR_WORDS:
        out[f"has_{word}"] = flag(contains_ignoring_case(text, word))
    for word in dims.RESOURCE_WORDS:
        out[f"mentions_{word}"] = flag(contains_ignoring_case(text, word))
    return out


def clean(text: Column) -> Column:
    """Lower case, everything but ASCII letters to one blank; null becomes empty."""
    letters = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z]+", " ")
    return F.trim(letters)


def tokens(text: Column, stop_words: list[str] | None = None, min_length: int = 3) -> Column:
    """Words of the cleaned text without stop words and short words."""
    words = F.split(clean(text), " ")
    return drop_stop_words(words, stop_words, min_length)


def words(text: Column, stop_words: list[str] | None = None, pattern: str = TERM_PATTERN) -> Column:
    """Single words of at least two characters."""
    return drop_stop_words(
        F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0)),
        stop_words,
    )


def terms(text: Column, stop_words: list[str] | None = None, among: list[str] | None = None,
          pattern: str = TERM_PATTERN) -> Column:
    """Words followed by pairs of neighbouring words; with ``among`` only those made of its words."""
    found = words(text, stop_words, pattern)
    # Bound once as a lambda variable, so that the words are not found again for every use.
    if among is None:
        return F.transform(F.array(found), lambda w: F.concat(w, neighbour_pairs(w)))[0]
    known = F.transform(found, lambda w: F.when(w.isin(among), w))  # other words keep their place as nulls
    return F.transform(F.array(known), lambda w: F.filter(F.concat(w, neighbour_pairs(w)), lambda t: t.isNotNull()))[0]


def neighbour_pairs(words: Column) -> Column:
    head = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    tail = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.zip_with(head, tail, lambda a, b: F.concat(a, F.lit(" "), b))


def drop_stop_words(words: Column, stop_words=None, min_length: int = 1) -> Column:
    stops = dims.STOP_WORDS if stop_words is None else stop_words
    if not stops:
        return F.filter(words, lambda w: F.length(w) >= min_length)
    return F.filter(words, lambda w: (F.length(w) >= min_length) & ~w.isin(stops))


def truncate(text: Column, limit: int = dims.MAX_TEXT_LENGTH) -> Column:
    """Cut at the last blank if that keeps more than 80 % of the limit; mark the cut."""
    head = F.substring(text, 1, limit)
    from_end = F.locate(" ", F.reverse(head))
    last_blank = F.lit(limit) - from_end
    cut = F.when((from_end > 0) & (last_blank > limit * 0.8), F.substr(head, F.lit(1), last_blank))
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(cut.otherwise(head), F.lit("..."))
    )


def log_text(service: Column, level: Column, message: Column, instance: Column) -> Column:
    """The text stored and searched for one log line."""
    blank = F.lit("")
    head = F.concat(
        F.coalesce(service, blank), F.lit(" "), F.coalesce(level, blank), F.lit(": "),
        F.coalesce(message, blank),
    )
    return F.concat(
        head,
        F.when(F.coalesce(instance, blank) != "", F.concat(F.lit(" [Instance: "), instance, F.lit("]")))
        .otherwise(blank),
    )


def document_key(*parts: Column) -> Column:
    """Stable hash of the identifying fields; nulls count as empty so positions stay fixed."""
    joined = F.concat_ws("_", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.md5(joined)


def keyword_flags(cleaned: Column) -> dict[str, Column]:
    """Flags of the first ten important words on cleaned text.

    ``connection_lost`` holds an underscore that cleaning removes, so it is always 0.
    """
    return {f"has_{w}": flag(F.contains(cleaned, F.lit(w))) for w in dims.IMPORTANT_WORDS[:10]}
