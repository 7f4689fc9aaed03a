"""Pages by number at a cost that doesn't depend on the number.

An order of the table is cut into ranges of ``RANGE_ROWS`` rows. A table of bounds says
with which row each range begins and how many rows are before it; a page then reads the one or
two ranges it lies in. The bounds are made by one sort, of the sort column and ``seq`` only, and kept
while the rows stay as they are: those of a published version never change.

Defined cases: missing values sort as empty text, as in ``view.sorted_rows``; a page beyond the
last is empty; an empty table has no bounds and no pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..session import written
from .view import SORT_KEYS, sorted_rows

RANGE_ROWS = 10_000
# An id made by Spark counts the rows of a partition in its low bits.
PLACE = (1 << 33) - 1


def _value(sort_key: str) -> Column:
    if sort_key not in SORT_KEYS:
        raise ValueError(f"cannot sort by {sort_key!r}; choose one of {', '.join(SORT_KEYS)}")
    return F.coalesce(F.col(sort_key).cast("string"), F.lit(""))


def page_bounds(rows: DataFrame, sort_key: str = "filing_date", descending: bool = True,
                range_rows: int = RANGE_ROWS) -> DataFrame:
    """(before, value, seq) of the first row of each range: a row per ``range_rows`` rows.

    The sorted columns are written once, with the partition and the place of each row;
    only the counts of partitions meet in one task.
    """
    value = _value(sort_key)
    ordered = sorted_rows(rows.select("seq", F.col(sort_key)), sort_key, descending).select(
        value.alias("value"), "seq", F.monotonically_increasing_id().alias("id"))
    placed = written(ordered.select(
        "value", "seq", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND(F.lit(PLACE)).alias("place")), "page-order")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    before = F.col("start") + F.col("place")
    # A row per partition of the sort.
    return placed.join(F.broadcast(starts), "part").where(before % range_rows == 0).select(before.alias("before"), "value", "seq")


def page_by_number(rows: DataFrame, bounds: DataFrame, number: int, sort_key: str = "filing_date", descending: bool = True,
                   size: int = fv.PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 0) of ``rows`` in the order that the ``bounds`` are of."""
    first, value = number * size, _value(sort_key)

    def nearest(side: DataFrame, latest: bool) -> tuple | None:
        found = side.orderBy(F.desc("before") if latest else F.asc("before")).first()
        return None if found is None else (found["before"], found["value"], found["seq"])

    begin = nearest(bounds.where(F.col("before") <= first), True)
    if begin is None:
        return rows.limit(0)
    end = nearest(bounds.where(F.col("before") >= first + size), False)

    def from_on(bound: tuple) -> Column:
        beyond = value < bound[1] if descending else value > bound[1]
        return beyond | ((value == bound[1]) & (F.col("seq") >= bound[2]))

    inside = rows.where(from_on(begin))
    if end is not None:
        inside = inside.where(~from_on(end))
    return sorted_rows(inside, sort_key, descending).offset(first - begin[0]).limit(size)
