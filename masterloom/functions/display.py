"""Expressions that shape values for reading: labels, dates, short lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv

DASH = "—"


def display_number(normalized: Column, raw: Column) -> Column:
    return F.coalesce(normalized, raw, F.lit(DASH))


def format_date(date: Column) -> Column:
    """``Mon D, YYYY``, or a dash."""
    return F.coalesce(F.date_format(date, "MMM d, yyyy"), F.lit(DASH))


def year_of(date: Column) -> Column:
    return F.year(date)


def decade(date: Column) -> Column:
    """``1990s`` for any date of those years."""
    return F.concat((F.floor(F.year(date) / 10) * 10).cast("string"), F.lit("s"))


def status_label(status: Column) -> Column:
    known = [s for s in fv.STATUSES if s != "unknown"]
    return F.when(status.isin(*known), F.initcap(status)).otherwise("Unknown")


def short_list(items: Column, shown: int = 3) -> Column:
    """The first items and how many more there are: ``a, b, c +2``."""
    head = F.array_join(F.slice(items, 1, shown), ", ")
    more = F.size(items) - shown
    return F.when(more > 0, F.concat(head, F.lit(" +"), more.cast("string"))).otherwise(head)


def encode_component(text: Column) -> Column:
    """Percent-encoding that leaves ``!'()*~`` as they are and writes a space as %20."""
    encoded = F.url_encode(text)
    for escaped, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(escaped), F.lit(plain))
    return encoded


def external_link(url: Column, normalized: Column) -> Column:
    return F.coalesce(url, F.concat(F.lit(fv.LINK_BASE), encode_component(normalized)))


def split_line(product_line: Column) -> Column:
    """``Sink/IOT`` -> struct(primary 'Sink', secondary ['IOT'])."""
    parts = F.transform(F.split(product_line, "/"), lambda part: F.trim(part))
    parts = F.filter(parts, lambda part: part != "")
    return F.struct(
        F.get(parts, F.lit(0)).alias("primary"),
        F.coalesce(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.array().cast("array<string>")).alias("secondary"),
    )
