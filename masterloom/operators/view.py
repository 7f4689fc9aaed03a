"""The record table: trimmed rows, filters, sorting, paging, export rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import iso

SORT_KEYS = ("normalized_number", "title", "status", "country", "product_line", "filing_date",
             "grant_date", "expiration_date")


def table_rows(master: DataFrame) -> DataFrame:
    """The columns the table shows; long texts stay unread. ``seq`` is kept as
    the order of equal rows."""
    return master.select(
        "seq", "id", "normalized_number", "raw_number",
        F.col("title.value").alias("title"),
        F.col("status.value").alias("status"),
        F.col("status.sub_tag").alias("status_sub_tag"),
        "country", "patent_type",
        F.col("product_line.value").alias("product_line"),
        F.col("model.value").alias("model"),
        F.col("filing_date.value").alias("filing_date"),
        F.col("grant_date.value").alias("grant_date"),
        F.col("expiration_date.value").alias("expiration_date"),
        F.coalesce("inventors.value", F.array().cast("array<string>")).alias("inventors"),
        F.col("assignee.normalized").alias("assignee"),
        F.col("assignee.is_confirmed_owner").alias("is_confirmed_owner"),
        "is_placeholder", "family_id",
        F.col("data_quality_flags").alias("flags"),
    )


def filtered(rows: DataFrame, statuses: Sequence[str] = (), product_lines: Sequence[str] = (),
             countries: Sequence[str] = (), types: Sequence[str] = (),
             filed: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """Rows in every chosen set; an empty set chooses all. A missing value is
    in no set. ``filed`` bounds the filing date on both ends, inclusive."""
    for name, chosen in (("status", statuses), ("product_line", product_lines), ("country", countries),
                         ("patent_type", types)):
        if chosen:
            rows = rows.where(F.col(name).isin(*chosen))
    first, last = filed
    if first:
        rows = rows.where(F.col("filing_date") >= F.lit(first).cast("date"))
    if last:
        rows = rows.where(F.col("filing_date") <= F.lit(last).cast("date"))
    return rows


def _ordering(sort_key: str, descending: bool, ties: Sequence[str]) -> list[Column]:
    if sort_key not in SORT_KEYS:
        raise ValueError(f"cannot sort by {sort_key!r}; choose one of {', '.join(SORT_KEYS)}")
    value = F.coalesce(F.col(sort_key).cast("string"), F.lit(""))
    return [value.desc() if descending else value.asc(), *[F.col(t).asc() for t in ties]]


def sorted_rows(rows: DataFrame, sort_key: str = "filing_date", descending: bool = True,
                ties: Sequence[str] = ("seq",)) -> DataFrame:
    """Sort with missing values as empty text. ``ties`` must be unique, which
    also lets a sort on few distinct values split into many ranges."""
    return rows.orderBy(*_ordering(sort_key, descending, ties))


def page(rows: DataFrame, number: int = 0, size: int = fv.PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 0) of sorted rows: a distributed top-k.

    Every task keeps the rows of all pages up to this one, so this suits the
    first pages; :func:`page_after` costs one page however deep.
    """
    return rows.offset(number * size).limit(size)


def page_after(rows: DataFrame, value: str | None, seq: int | None, sort_key: str = "filing_date",
               descending: bool = True, size: int = fv.PAGE_SIZE) -> DataFrame:
    """The page after a row, given its sort value (as text, empty if missing) and
    ``seq``; the first page without them. Rows are ordered as by :func:`sorted_rows`."""
    if seq is not None:
        own, last = F.coalesce(F.col(sort_key).cast("string"), F.lit("")), F.lit(value or "")
        beyond = own < last if descending else own > last
        rows = rows.where(beyond | ((own == last) & (F.col("seq") > seq)))
    return sorted_rows(rows, sort_key, descending).limit(size)


def page_count(rows: DataFrame, size: int = fv.PAGE_SIZE) -> DataFrame:
    n = F.count("*")
    return rows.agg(n.alias("rows"), F.greatest(F.lit(1).cast("long"), F.ceil(n / size)).alias("pages"))


def export_rows(rows: DataFrame) -> DataFrame:
    """The export columns as text: lists joined by ``; ``, nulls empty."""
    values = (
        "id", "normalized_number", "title", "status", "status_sub_tag", "country", "patent_type",
        "product_line", "model", "filing_date", "grant_date", "expiration_date", "inventors", "assignee",
        "is_confirmed_owner", "family_id", "flags",
    )
    lists = {"inventors", "flags"}

    def as_text(name: str) -> Column:
        text = F.array_join(name, "; ") if name in lists else F.col(name).cast("string")
        return F.coalesce(text, F.lit(""))

    return rows.select(*[as_text(v).alias(c) for v, c in zip(values, fv.EXPORT_COLUMNS, strict=True)])
