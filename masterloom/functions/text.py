"""Text, list and date expressions. Everything here is a native Column."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fv
from .decomposition import nfkd

# All characters Unicode counts as whitespace, control separators included.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _compatibility_pairs() -> tuple[str, str]:
    """Characters whose compatibility form (NFKD) is one ASCII character."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char)
        if len(plain) == 1 and plain != char and plain < "\x80":
            source.append(char)
            target.append(plain)
    return "".join(source), "".join(target)


_WIDE, _NARROW = _compatibility_pairs()


def strip_space(text: Column) -> Column:
    """Trim every kind of whitespace, touching only the ends of the text."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_missing(trimmed: Column) -> Column:
    """Whether a trimmed text only spells out a missing value. Just short
    texts can, so long ones are not examined."""
    longest = max(len(w) for w in fv.MISSING_WORDS)
    words = "|".join(w for w in fv.MISSING_WORDS if w)
    return (F.octet_length(trimmed) <= longest) & trimmed.rlike(f"^(?i:{words})?$")


def clean(text: Column) -> Column:
    """Trim; texts that only spell out a missing value become null."""
    trimmed = strip_space(text.cast("string"))
    return F.when(~is_missing(trimmed), trimmed)


def compatibility_form(text: Column, exact: bool = True) -> Column:
    """Rewrite full-width and similar characters to their plain form.

    This is full NFKD, of texts with non-ASCII characters only. ``exact=False`` covers
    every character with a one-character ASCII equivalent.
    """
    if not exact:
        return F.translate(text, _WIDE, _NARROW)
    return F.when(text.rlike(r"[^\x00-\x7F]"), nfkd(text)).otherwise(text)


def strip_noise(text: Column, exact: bool = True) -> Column:
    """Drop whitespace and the separators ``-``, ``,``, ``/``; upper-case."""
    plain = compatibility_form(text, exact)
    return F.upper(F.regexp_replace(plain, r"(?U)[\s\x1c-\x1f\-,/]+", ""))


def title_key(title: Column) -> Column:
    """Key that ignores case, punctuation and spacing; null if nothing is left."""
    words = F.regexp_replace(F.lower(title), "[^a-z0-9]+", " ")
    return F.nullif(F.trim(words), F.lit(""))


def split_names(text: Column) -> Column:
    """Comma list to array: items trimmed, empty ones dropped, null gives []."""
    items = F.transform(F.split(text, ","), strip_space)
    return F.coalesce(F.filter(items, lambda name: name != ""), no_strings())


def no_strings() -> Column:
    return F.array().cast("array<string>")


# Numeric spellings of a date -> year-month-day. A time of day is dropped.
_TIME = "([T ][0-9]{1,2}:.*)?$"
_DATE_SPELLINGS = (
    ("^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})" + _TIME, "$3-$1-$2"),
    # Two digits of a year: 1969 to 2068.
    ("^([0-9]{1,2})[/-]([0-9]{1,2})[/-](69|[7-9][0-9])" + _TIME, "19$3-$1-$2"),
    ("^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2})" + _TIME, "20$3-$1-$2"),
    ("^([0-9]{4})[/-]?([0-9]{1,2})[/-]?([0-9]{1,2})" + _TIME, "$1-$2-$3"),
)
_NAMED_MONTH = "^[A-Z][a-z]{2,8} [0-9]{1,2}, [0-9]{4}$|^[0-9]{1,2} [A-Z][a-z]{2,8} [0-9]{4}$"
_NAMED_FORMATS = ("MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy")


def _year_first(text: Column) -> Column:
    for spelling, order in _DATE_SPELLINGS:
        text = F.regexp_replace(text, spelling, order)
    return text


def _parsed(text: Column) -> Column:
    """Date of a text from :func:`_year_first`. Month before day, unless only
    the other order is a date."""
    named = F.when(text.rlike(_NAMED_MONTH), F.coalesce(*[F.try_to_date(text, f) for f in _NAMED_FORMATS]))
    numeric = F.when(text.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.coalesce(
        F.try_to_date(text, "yyyy-M-d"), F.try_to_date(text, "yyyy-d-M")))
    return F.coalesce(numeric, named)


def with_clean(df: DataFrame, texts: Iterable[str], dates: Iterable[str] = ()) -> DataFrame:
    """Clean the named text columns and turn the named date columns to dates.
    A column the frame lacks becomes null."""
    have = set(df.columns)
    texts, dates = list(texts), list(dates)
    values = {n: F.col(n) if n in have else F.lit(None) for n in texts + dates}
    # In two steps, so that a text is trimmed once.
    df = df.withColumns({n: strip_space(v.cast("string")) for n, v in values.items()})
    df = df.withColumns({n: F.when(~is_missing(F.col(n)), F.col(n)) for n in values})
    if dates:
        df = df.withColumns({n: _year_first(F.col(n)) for n in dates})
        df = df.withColumns({n: _parsed(F.col(n)) for n in dates})
    return df


def iso(date: Column) -> Column:
    return date.cast("string")
