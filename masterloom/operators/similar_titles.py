"""Links by similar titles: a similarity join on edit distance, exact at any size.

Two title keys are similar if the edits between them are at most ``100 - percent`` percent of
the longer one, rounded down. Within k edits of each other two texts share all but ``k * GRAM``
grams of the longer one, so of each title's grams in one common order the first
``k * GRAM + 1`` hold a common one. The order is by frequency: each title is indexed by its
rarest grams, and pairs meet only there (prefix filter). A pair is compared once, at the
first gram both are indexed by, if the lengths allow it, by an edit distance that stops
beyond k. Titles so short that the bound leaves nothing to share are also indexed under one
mark more. Nothing is dropped: grams that index many titles are cut into tiles.

Title keys consist of ``a-z``, ``0-9`` and spaces, so there are at most 37^3 whole grams,
which bounds the broadcast table of their frequencies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .skew import TILE_ROWS, tiled_join

GRAM = 3
PERCENT = 90


def _edits(length: int, percent: int) -> int:
    return length * (100 - percent) // 100


def allowed_edits(length: Column, percent: int) -> Column:
    """Edits allowed between two titles, the longer of this length."""
    return F.floor(length * (100 - percent) / 100).cast("int")


def _short(percent: int) -> int:
    """Length up to which two similar titles may have no gram in common."""
    return max((n for n in range(1, 400) if _edits(n, percent) and n - GRAM + 1 - GRAM * _edits(n, percent) < 1), default=0)


def _grams(title: Column) -> Column:
    """All grams of a title; one shorter than a gram is its own."""
    last = F.greatest(F.length(title) - (GRAM - 1), F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda k: F.substr(title, k, F.lit(GRAM)))


def _marks(grams: Column) -> Column:
    """A hash for each of some grams and its number among equal ones, which stand side by side."""
    start = F.struct(F.lit("").alias("gram"), F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("marks"))

    def step(acc: Column, g: Column) -> Column:
        n = F.when(acc["gram"] == g, acc["n"] + 1).otherwise(F.lit(0))
        return F.struct(g.alias("gram"), n.alias("n"), F.array_append(acc["marks"], F.xxhash64(g, n)).alias("marks"))

    return F.aggregate(grams, start, step, lambda acc: acc["marks"])


def _indexed(titles: DataFrame, frequency: DataFrame, percent: int) -> DataFrame:
    """``titles`` with a row per mark: mark, and marks, all that index the title, rarest first.

    The titles come partitioned by title; neither the broadcast join nor the lists of grams,
    which are as long as the title, move them again.
    """
    others = [c for c in titles.columns if c != "title"]
    each = titles.withColumn("gram", F.explode(_grams(F.col("title"))))
    ordered = each.join(F.broadcast(frequency), "gram").groupBy("title").agg(
        F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("grams"), *[F.first(c).alias(c) for c in others])
    length = F.length("title")
    # No similar title is longer than this; edits are allowed by the longer one.
    longest = F.floor(length * 100 / percent) + 1
    wanted = allowed_edits(longest, percent) * GRAM + 1
    marks = F.slice(_marks(F.transform("grams", lambda g: g["gram"])), F.lit(1), wanted)
    short = F.when(length <= _short(percent), F.array(F.xxhash64(F.lit("short")))).otherwise(F.array().cast("array<bigint>"))
    return ordered.select("title", *others, F.concat(marks, short).alias("marks")).withColumn("mark", F.explode("marks"))


def similar_titles(left: DataFrame, right: DataFrame, percent: int = PERCENT, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(title, other, distance) of all similar, different titles of two tables of distinct
    title keys (title), other columns of ``right`` included."""
    if not 100 - 100 / GRAM < percent <= 100:
        raise ValueError(f"percent must be above {100 - 100 // GRAM} and at most 100, not {percent}")
    left = written(left.select("title").where("title IS NOT NULL").distinct(), "left_titles")
    more = [c for c in right.columns if c != "title"]
    right = written(right.where("title IS NOT NULL"), "right_titles")
    frequency = left.select("title").unionByName(right.select("title")).select(
        F.explode(_grams(F.col("title"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    # One shuffle by title each, which the lists of grams then reuse.
    a = _indexed(left.repartition("title"), frequency, percent)
    b = _indexed(right.repartition("title"), frequency, percent).withColumnsRenamed({"title": "other", "marks": "other_marks"})
    a, b = written(a, "left_index"), written(b, "right_index")
    met = tiled_join(a, b, "mark", "title", "other", tile_rows)
    limit = allowed_edits(F.greatest(F.length("title"), F.length("other")), percent)
    met = met.withColumn("limit", limit).where(
        (F.abs(F.length("title") - F.length("other")) <= F.col("limit"))
        & (F.get(F.array_intersect("marks", "other_marks"), F.lit(0)) == F.col("mark")))
    return met.withColumn("distance", F.expr("levenshtein(title, other, `limit`)")).where("distance > 0").select(
        "title", "other", "distance", *more)


def best_similar(left: DataFrame, claims: DataFrame, percent: int = PERCENT, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(title, family_no, other, distance): for each title of ``left`` with a similar one in
    ``claims`` (title, family_no), the most similar; of equally similar ones the first family."""
    share = F.col("distance") / F.greatest(F.length("title"), F.length("other"))
    found = similar_titles(left, claims, percent, tile_rows)
    # A title may have many similar ones: only the best leaves each task.
    best = found.groupBy("title").agg(F.min(F.struct(share.alias("share"), "family_no", "other", "distance")).alias("best"))
    return best.select("title", "best.family_no", "best.other", "best.distance")
