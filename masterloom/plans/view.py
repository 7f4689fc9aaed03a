"""The record table as one call: filter, search, sort, page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.overrides import apply_overrides
from ..operators.search import search
from ..operators.view import filtered, page, sorted_rows, table_rows
from ..sources.published import Published


def published_rows(published: Published, tie: str | None = None) -> DataFrame:
    """The rows of the table as people corrected them: the published master with the latest
    overrides, which stay in force when a refresh replaces the master."""
    return table_rows(apply_overrides(published.master(), published.overrides(), tie))


def view(rows: DataFrame, query: str = "", statuses: Sequence[str] = (), product_lines: Sequence[str] = (),
         countries: Sequence[str] = (), sort_key: str = "filing_date", descending: bool = True,
         page_number: int | None = None) -> DataFrame:
    """The chosen rows in display order; all of them unless a page is named.

    Filters run before the search, which costs more. Rows that sort equal are
    ordered by how well they match, then by emission.
    """
    chosen = search(filtered(rows, statuses, product_lines, countries), query, ranked=bool(query.strip()))
    ties = ("rank", "seq") if query.strip() else ("seq",)
    ordered = sorted_rows(chosen, sort_key, descending, ties)
    return ordered if page_number is None else page(ordered, page_number)
